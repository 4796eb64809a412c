"""Scores: rank fusion, split boost, re-ranking signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import rerank_terms

RRF_K = 60
SPLIT_STEP, SPLIT_MOST = 0.1, 1.5
# What the path and chunk-type signals look for.
TEST_PARTS = ["_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".spec.tsx", ".spec.jsx", "_test.py", "test_"]
TEST_DIRS = ["/test/", "/tests/", "\\test\\", "\\tests\\"]
TEST_STARTS = ["test/", "tests/"]
MOCK_PARTS = ["mock_", "_mock."]
VERB_ENDS = ["ing", "ed", "ate", "ize", "ify"]
VERB_STARTS = ["get", "set", "do", "is", "has", "can", "make", "create", "update", "delete", "handle", "process", "parse", "load", "save", "send", "receive"]
NOUN_ENDS = ["er", "or", "tion", "sion", "ment", "ness", "ity", "ance", "ence"]
FUNCTION_TYPES, CLASS_TYPES = ["function", "method"], ["class", "struct", "type"]
SIGNALS = ["name_match", "exact_phrase", "path_match", "test_penalty", "recency", "chunk_type"]


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    """1/(k + rank + 1) of a 0-based rank, 0 where absent (null or -1)."""
    k = k if k > 0 else RRF_K
    return F.when(rank >= 0, 1.0 / (k + rank + 1)).otherwise(0.0)


def match_source(vector_rank: Column, keyword_rank: Column) -> Column:
    v, k = vector_rank >= 0, keyword_rank >= 0
    return F.when(v & k, "both").when(v, "vector").when(k, "keyword").otherwise("none")


def split_boost(score: Column, matches: Column) -> Column:
    """A hit found through several of its splits gains a tenth per further one, up to half, capped at 1."""
    factor = F.least(F.lit(SPLIT_MOST), 1 + SPLIT_STEP * (matches - 1))
    return F.when(matches <= 1, score).otherwise(F.least(F.lit(1.0), score * factor))


def _matches(text: Column, terms: list[str], step: float, most: float) -> Column:
    lowered = F.lower(text)
    n = sum((lowered.contains(t).cast("int") for t in terms), F.lit(0))
    return F.coalesce(F.least(F.lit(most), n * step), F.lit(0.0))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def name_match(name: Column, query: str) -> Column:
    return _matches(name, rerank_terms(query), 0.1, 0.2)


def exact_phrase(content: Column, query: str) -> Column:
    return F.when(F.lower(content).contains(query.lower()), 0.15).otherwise(0.0) if query else F.lit(0.0)


def path_match(path: Column, query: str) -> Column:
    return _matches(path, rerank_terms(query), 0.075, 0.15)


def test_penalty(path: Column) -> Column:
    low = F.lower(path)
    is_test = _any([low.contains(p) for p in TEST_PARTS + TEST_DIRS] + [low.startswith(p) for p in TEST_STARTS])
    return F.when(is_test, -0.15).when(_any([low.contains(p) for p in MOCK_PARTS]), -0.1).otherwise(0.0)


def recency(modified_at: Column, now: Column) -> Column:
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(modified_at.cast("timestamp"))) / 3.6e9
    return F.when(hours < 0, 0.0).when(hours < 24, 0.1).when(hours < 168, 0.05).when(hours < 720, 0.02).otherwise(0.0)


def chunk_type_signal(chunk_type: Column, query: str) -> Column:
    q = query.lower()
    verb = q.endswith(tuple(VERB_ENDS)) or q.startswith(tuple(VERB_STARTS))
    noun = q.endswith(tuple(NOUN_ENDS))
    wanted = (FUNCTION_TYPES if verb else []) + (CLASS_TYPES if noun else [])
    return F.when(F.lower(chunk_type).isin(wanted), 0.05).otherwise(0.0) if wanted else F.lit(0.0)


def final_score(base: Column, signals: list[Column]) -> Column:
    """70 % of the base, 30 % of the base times one plus all signals."""
    total = F.lit(0.0)
    for s in signals:
        total = total + s
    return base * 0.7 + base * 0.3 * (1 + total)
