"""Text expressions: query preprocessing, sanitising, tokens and estimates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search intent.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "it", "this", "that", "be", "as", "are", "was",
    "were", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "i",
    "you", "he", "she", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "what", "which", "who", "when",
    "where", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "not", "only", "same", "so", "than", "too",
    "very", "just", "also", "now", "here", "there", "then",
]
#: Word of a query: letters, digits and underscores of any script.
QUERY_WORD = r"[\p{L}\p{N}_]+"
PHRASE = r'"([^"]+)"'
#: Replaced by a space before keyword search; longer ones first.
SYNTAX = r"--|/\*|\*/|[{}\[\]^~@#$%&;()]"
#: Trimmed from the terms that re-ranking and reasons use.
TERM_EDGES = ".,;:!?\"'()[]{}|"


@dataclass(frozen=True)
class ProcessedQuery:
    """What a single query string is made of."""

    original: str
    terms: tuple[str, ...]
    phrases: tuple[str, ...]

    @property
    def has_phrases(self) -> bool:
        return bool(self.phrases)

    @property
    def fts(self) -> str:
        return " OR ".join([*(f'"{p}"' for p in self.phrases), *self.terms])


def preprocess(query: str) -> ProcessedQuery:
    phrases = tuple(p.strip() for p in re.findall(PHRASE, query) if p.strip())
    words = (w.lower() for w in re.findall(r"\w+", re.sub(PHRASE, " ", query)))
    terms = tuple(w for w in words if w not in STOPWORDS and (len(w.encode()) > 1 or w.isdigit()))
    return ProcessedQuery(query, terms, phrases)


def query_phrases(query: Column) -> Column:
    found = F.transform(F.regexp_extract_all(query, F.lit(PHRASE), F.lit(1)), F.trim)
    return F.filter(found, lambda p: p != "")


def query_terms(query: Column) -> Column:
    """Lower-case words without stop-words and single-byte words that aren't digits."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(query, PHRASE, " ")), F.lit(QUERY_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & ((F.octet_length(w) > 1) | w.rlike(r"^\p{Nd}$")))


def fts_query(query: Column) -> Column:
    quoted = F.transform(query_phrases(query), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.array_join(F.concat(quoted, query_terms(query)), " OR ")


def sanitize(query: Column) -> Column:
    """Drops syntax that keyword search doesn't know; keeps quotes, stars and colons."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, SYNTAX, " "), " +", " "))


def rerank_terms(query: str) -> list[str]:
    """Terms of a query for signals and reasons: split at white space, edges trimmed, more than one byte, lower case."""
    terms = (t.strip(TERM_EDGES) for t in query.split())
    return [t.lower() for t in terms if len(t.encode()) > 1]


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: keyword search's tokens before diacritics and stems."""
    # splitting at everything else costs half of extracting the runs
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def embedding_tokens(text: Column) -> Column:
    """Estimate by bytes: int(bytes / 3.5)."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 3.5).cast("long")


def chars_for_tokens(tokens: Column) -> Column:
    return F.floor(tokens * 3.5).cast("long")


def max_chars_for_tokens(tokens: Column) -> Column:
    return F.floor(tokens * 3.2).cast("long")


def metric_tokens(text: Column) -> Column:
    """Estimate for metrics: words plus half of the punctuation and symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))
    marks = F.regexp_count(text, F.lit(r"[\p{P}\p{S}]"))
    return (words + F.floor(marks / 2)).cast("long")
