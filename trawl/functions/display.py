"""Reasons, previews and result lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import rerank_terms

MOST_REASONS, SHOWN_SIGNAL, REASON_SIGNAL, PREVIEW = 5, 0.01, 0.05, 120
# Wording of reasons and sources.
SIGNAL_REASONS = {
    "name_match": "name relevance boost",
    "path_match": "path relevance boost",
    "exact_phrase": "exact phrase boost",
    "recency": "recently modified",
    "chunk_type": "chunk type relevance",
}
SOURCE_LABELS = {"vector": "semantic match", "keyword": "keyword match", "both": "semantic + keyword"}


def preview(content: Column, most: int = PREVIEW) -> Column:
    """One line: white space collapsed, cut to ``most`` bytes of ASCII (characters otherwise) with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(content, "[\n\t]", " "), " +", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def compact_line(index: Column, path: Column, start: Column, end: Column, level: Column, name: Column, score: Column) -> Column:
    named = F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), name))
    return F.concat(F.format_string("[%d] %s:%d-%d (%s)", index, path, start, end, level), named, F.format_string(" [%.3f]", score))


def source_label(source: Column) -> Column:
    out = source
    for k, v in SOURCE_LABELS.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def score_breakdown(scores: dict[str, Column]) -> Column:
    """name=score for scores above zero, joined by bars."""
    parts = [F.when(s > 0, F.format_string(f"{n}=%.4f", s)) for n, s in scores.items()]
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def verbose_block(index: Column, path: Column, start: Column, end: Column, level: Column, name: Column, score: Column, source: Column, reasons: Column, content: Column) -> Column:
    """Several lines: location, level and name, score and source, reasons, preview."""
    named = F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" | Name: "), name))
    lines = F.array(
        F.format_string("[%d] %s:%d-%d", index, path, start, end),
        F.concat(F.lit("    Level: "), level, named),
        F.concat(F.format_string("    Score: %.4f", score), F.when(source != "", F.concat(F.lit(" | Source: "), source)).otherwise(F.lit(""))),
        F.when(F.size(reasons) > 0, F.concat(F.lit("    Reasons: "), F.array_join(reasons, ", "))),
        F.when(content != "", F.concat(F.lit("    Preview: "), preview(content))),
    )
    return F.array_join(F.array_compact(lines), "\n")


def match_reasons(query: str, source: Column, name: Column, path: Column, content: Column, signals: dict[str, Column]) -> Column:
    """Why a result matched: its source, terms in name and path, the phrase, strong signals; five at most."""
    terms = rerank_terms(query)
    if not query:
        return F.array().cast("array<string>")

    def first(text: Column, before: str, after: str) -> Column:
        hit = F.lit(None).cast("string")
        for t in reversed(terms):
            hit = F.when(F.lower(text).contains(t), F.lit(f"{before}'{t}'{after}")).otherwise(hit)
        return hit

    parts = [
        F.when(source.isin("vector", "both"), "semantic similarity"),
        F.when(source.isin("keyword", "both"), "keyword match via BM25"),
        first(name, "contains ", " in name"),
        first(path, "file path contains ", ""),
        F.when((content != "") & F.lower(content).contains(query.lower()), "exact phrase match"),
        *[F.when(s > REASON_SIGNAL, SIGNAL_REASONS[n]) for n, s in signals.items() if n in SIGNAL_REASONS],
    ]
    found = F.slice(F.array_distinct(F.array_compact(F.array(*parts))), 1, MOST_REASONS)
    return F.when(F.size(found) == 0, F.array(F.lit("semantic similarity"))).otherwise(found)


def eta_text(seconds: Column) -> Column:
    """Time left in words; zero is not known yet."""
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return (
        F.when(seconds == 0, "Calculating...")
        .when(s < 60, F.format_string("%ds", s))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("%dh %dm", hours, minutes % 60))
    )


def as_json(columns: list[str]) -> Column:
    """Columns as one JSON object; null ones are left out."""
    return F.to_json(F.struct(*columns))


def text_table(rows: list[dict], columns: list[str]) -> str:
    """A few rows as aligned columns under their names."""
    cells = [columns, *([str(r.get(c) if r.get(c) is not None else "") for c in columns] for r in rows)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])
