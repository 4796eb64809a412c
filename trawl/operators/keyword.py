"""Keyword search: tokens, BM25 and a query grammar; ``postings`` holds the index they work on.

A chunk's searchable fields are content, name and path. Ranking follows the usual BM25
with k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5)/(n + 0.5)) floored at 1e-6; frequencies and
lengths are summed over the fields.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.stemming import fold, stem, stems
from trawl.functions.text import search_tokens

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FIELDS = ("content", "name", "path")


def tokenized(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """chunk_id and the token array of each field."""
    out = chunks.select("chunk_id", *[search_tokens(F.col(f)).alias(f) for f in FIELDS])
    return out.select("chunk_id", *[stems(F.col(f)).alias(f) for f in FIELDS]) if stemmed else out


def doc_lengths(tokens: DataFrame) -> DataFrame:
    n = sum((F.size(f) for f in FIELDS), F.lit(0))
    return tokens.select("chunk_id", n.cast("long").alias("n_tokens"))


def idf(n_docs: Column | int, n_with: Column) -> Column:
    n_docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    raw = F.ln((n_docs - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, IDF_FLOOR).otherwise(raw)


def bm25_part(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


# --- query grammar -------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; the last may be a prefix; ``field`` restricts where."""

    tokens: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, NOT
    left: Node | Phrase
    right: Node | Phrase


_LEXER = re.compile(r'(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s"*:]+))(\s*\*|\*)?')
_OPERATORS = ("AND", "OR", "NOT")


def parse(query: str, stemmed: bool = True) -> Node | Phrase | None:
    """Phrases in quotes, ``x*`` prefixes, ``name:x`` fields, AND (or nothing), OR, NOT.

    OR binds weaker than AND, AND weaker than NOT. Characters that aren't letters or digits
    separate the tokens of a phrase.
    """
    clean = (lambda t: stem(t)) if stemmed else fold
    items: list[Phrase | str] = []
    for m in _LEXER.finditer(query):
        field, quoted, bare, star = m.groups()
        if bare in _OPERATORS and not field and not star:
            items.append(bare)
            continue
        tokens = re.findall(r"[^\W_]+", quoted if quoted is not None else bare)
        if tokens:
            if star:
                done = [*map(clean, tokens[:-1]), fold(tokens[-1])]
            else:
                done = [*map(clean, tokens)]
            items.append(Phrase(tuple(done), bool(star), field if field in FIELDS else None))

    def chain(parts: list, op: str) -> Node | Phrase | None:
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else Node(op, out, p)
        return out

    def split(items: list, op: str) -> list[list]:
        groups: list[list] = [[]]
        for x in items:
            if x == op:
                groups.append([])
            else:
                groups[-1].append(x)
        return groups

    def conjunction(items: list) -> Node | Phrase | None:
        kept, *gone = split(items, "NOT")
        out = chain([x for x in kept if x != "AND"], "AND")
        for g in gone:
            # NOT takes the next phrase only; what follows it is joined by AND
            phrases = [x for x in g if x != "AND"]
            if out is not None and phrases:
                out = Node("NOT", out, phrases[0])
                out = chain([out, *phrases[1:]], "AND")
        return out

    return chain([conjunction(g) for g in split(items, "OR")], "OR")


def phrases_of(node: Node | Phrase) -> list[Phrase]:
    return [node] if isinstance(node, Phrase) else phrases_of(node.left) + phrases_of(node.right)
