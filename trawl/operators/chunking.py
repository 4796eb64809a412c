"""Files into chunks: whole files, policies for long ones, line windows, classes and methods.

Sizes are bytes, tokens are int(bytes / 3.5). Whole-file chunks and the truncation
policies are column expressions; windows depend on the window before and parsing needs a
parser, so these two run over Arrow batches.
"""

from __future__ import annotations

import bisect
import hashlib
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import paths
from trawl.functions.identity import chunk_id, content_hash
from trawl.operators.declarations import PARSED, declarations
from trawl.shipping import ship

ship(__name__)

MAX_TOKENS, MAX_FILE_CHUNK, OVERLAP_TOKENS, LEAST_TARGET = 8000, 102400, 256, 100
BYTES_PER_TOKEN, SAFE_BYTES_PER_TOKEN = 3.5, 3.2
TRUNCATED = "\n// ... [truncated]"
LONG_LINE, SINGLE_LINE, BLANK_FLOOR, BLANK_FROM = 500, 10240, 0.05, 1024


# --- minified files ------------------------------------------------------------------------


def is_minified(path: Column, content: Column) -> Column:
    size = F.octet_length(content)
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    blanks = F.length(content) - F.length(F.translate(content, " \t\n", ""))
    per_line = F.floor(size / F.greatest(newlines, F.lit(1)))
    looks = (
        F.lower(path).contains(".min.")
        | (per_line > LONG_LINE)
        | ((newlines == 0) & (size > SINGLE_LINE))
        | ((size >= BLANK_FROM) & (blanks / size < BLANK_FLOOR))
    )
    return (size > 0) & looks


def is_minified_name(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for end in paths.MINIFIED_ENDS:
        out = out | low.endswith(end)
    return out


# --- whole files and truncation ------------------------------------------------------------


def file_chunks(files: DataFrame) -> DataFrame:
    """One chunk a file (path, content, language): all its lines, named by its path."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    out = files.select("path", "language", "content", F.lit("file").alias("level"), F.col("path").alias("name"), F.lit(1).alias("start_line"), lines.alias("end_line"))
    return out.withColumn("chunk_id", chunk_id(F.col("path"), F.col("level"), F.col("start_line"), F.col("end_line"))).withColumn("content_hash", content_hash(F.col("content")))


def tokens(content: Column) -> Column:
    return F.floor(F.octet_length(content) / BYTES_PER_TOKEN)


def truncate(content: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The first bytes that surely fit, up to the last line end, and a mark."""
    most = int(max_tokens * SAFE_BYTES_PER_TOKEN)
    head = F.substring(F.encode(content, "UTF-8"), 1, most)
    # cut before the last line end that isn't the first byte; without one, before a broken character
    text = F.make_valid_utf8(head.cast("string"))
    at_line = F.regexp_extract(text, r"(?s)^(.+)\n", 1)
    whole = F.regexp_replace(text, "\ufffd+$", "")
    return F.concat(F.when(at_line != "", at_line).otherwise(whole), F.lit(TRUNCATED))


def file_policy(chunks: DataFrame, max_tokens: int = MAX_TOKENS, largest: int = MAX_FILE_CHUNK) -> DataFrame:
    """File chunks: dropped above ``largest`` bytes, truncated above ``max_tokens``."""
    return class_policy(chunks.filter(F.octet_length("content") <= largest), max_tokens)


def class_policy(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Class chunks: truncated above ``max_tokens``."""
    long = tokens(F.col("content")) > max_tokens
    return chunks.withColumn("is_partial", long).withColumn("content", F.when(long, truncate(F.col("content"), max_tokens)).otherwise(F.col("content")))


# --- line windows --------------------------------------------------------------------------


def window_ranges(sizes: list[int], max_tokens: int) -> list[tuple[int, int]]:
    """Half-open line ranges of the windows over lines of these token sizes.

    A window takes lines up to the target and at least one. The next begins with as many of
    the last lines as make up the overlap's tokens, or after the window where that wouldn't
    advance; a last window may thus hold nothing but overlap.
    """
    target = max(LEAST_TARGET, max_tokens - OVERLAP_TOKENS)
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    out, start, n = [], 0, len(sizes)
    while start < n:
        end = max(start + 1, bisect.bisect_right(upto, upto[start] + target) - 1)
        out.append((start, end))
        # the last place from which the lines before ``end`` make up the overlap
        back = max(0, bisect.bisect_right(upto, upto[end] - OVERLAP_TOKENS, 0, end) - 1)
        start = back if back > start else end
    return out


def split_methods(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Method chunks (chunk_id, path, level, start_line, content) above ``max_tokens`` become windows of lines."""

    def over(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                text = r.content or ""
                if int(len(text.encode()) / BYTES_PER_TOKEN) <= max_tokens:
                    rows.append((r.chunk_id, "", 0, r.start_line, r.start_line + text.count("\n"), False, text))
                    continue
                lines = text.split("\n")
                sizes = [int(len(x.encode()) / BYTES_PER_TOKEN) for x in lines]
                for i, (a, b) in enumerate(window_ranges(sizes, max_tokens)):
                    first, last = r.start_line + a, r.start_line + b - 1
                    own = hashlib.sha256(f"{r.path}:{r.level}:{first}:{last}".encode()).hexdigest()[:32]
                    rows.append((own, r.chunk_id, i, first, last, True, "\n".join(lines[a:b])))
            yield pd.DataFrame(rows, columns=["chunk_id", "parent_chunk_id", "chunk_index", "start_line", "end_line", "is_partial", "content"])

    kinds = "chunk_id string, parent_chunk_id string, chunk_index int, start_line int, end_line int, is_partial boolean, content string"
    return chunks.select("chunk_id", "path", "level", "start_line", "content").mapInPandas(over, kinds)


# --- classes and methods -------------------------------------------------------------------


def declaration_chunks(files: DataFrame) -> DataFrame:
    """Class and method chunks of files (path, content, language) in a parsed language."""

    def own_id(path: str, level: str, a: int, b: int) -> str:
        return hashlib.sha256(f"{path}:{level}:{a}:{b}".encode()).hexdigest()[:32]

    def over(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                text = r.content or ""
                lines = text.split("\n")
                found = declarations(text, r.language)
                file_id = own_id(r.path, "file", 1, len(lines))
                latest = {}  # of two chunks with one id the later stays
                starts = [0, *accumulate(len(x) + 1 for x in lines)]
                line_of = lambda at: bisect.bisect_right(starts, at, 0, len(lines))
                for level, name, start, end, parent in found:
                    up = found[parent] if parent >= 0 else None
                    parent_id = own_id(r.path, up.level, line_of(up.start), line_of(up.end - 1)) if up else file_id
                    content, a, b = text[start:end], line_of(start), line_of(end - 1)
                    latest[own_id(r.path, level, a, b)] = (parent_id, r.path, r.language, level, name, content.split("\n", 1)[0].strip(), a, b, content)
                rows += [(k, *v) for k, v in latest.items()]
            yield pd.DataFrame(rows, columns=["chunk_id", "parent_id", "path", "language", "level", "name", "signature", "start_line", "end_line", "content"])

    kinds = "chunk_id string, parent_id string, path string, language string, level string, name string, signature string, start_line int, end_line int, content string"
    parsed = files.filter(F.col("language").isin(*PARSED))
    return parsed.select("path", "content", "language").mapInPandas(over, kinds)


def chunk_files(files: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All chunks of files (path, content): file, class and method level after the policies; minified files give none."""
    known = files.filter(~is_minified(F.col("path"), F.col("content"))).withColumn("language", paths.language(F.col("path")))
    whole = file_policy(file_chunks(known), max_tokens)
    parts = declaration_chunks(known)
    classes = class_policy(parts.filter("level = 'class'"), max_tokens)
    methods = parts.filter("level = 'method'")
    windows = split_methods(methods, max_tokens)
    about = methods.select(F.col("chunk_id").alias("_of"), "parent_id", "path", "language", "level", "name", "signature")
    source = F.when(F.col("parent_chunk_id") == "", F.col("chunk_id")).otherwise(F.col("parent_chunk_id"))
    split = windows.withColumn("_of", source).join(about, "_of").drop("_of")
    text = F.lit(None).cast("string")
    tail = {"parent_chunk_id": F.lit(""), "chunk_index": F.lit(0)}
    columns = ["chunk_id", "parent_id", "path", "language", "level", "name", "signature", "start_line", "end_line", "content", "parent_chunk_id", "chunk_index", "is_partial"]
    whole = whole.withColumns({"parent_id": text, "signature": text, **tail}).select(*columns)
    out = whole.unionByName(classes.withColumns(tail).select(*columns)).unionByName(split.select(*columns))
    return out.withColumn("content_hash", content_hash(F.col("content")))
