"""Ids and validity of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(path: Column, level: Column, start_line: Column, end_line: Column) -> Column:
    """First 16 bytes of SHA-256 of path:level:start:end, in hex."""
    return F.substring(F.sha2(F.concat_ws(":", path, level, start_line.cast("string"), end_line.cast("string")), 256), 1, 32)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def line_count(start_line: Column, end_line: Column) -> Column:
    return end_line - start_line + 1


def is_valid(path: Column, start_line: Column, end_line: Column, content: Column, level: Column) -> Column:
    filled = (F.coalesce(path, F.lit("")) != "") & (F.coalesce(level, F.lit("")) != "")
    return filled & (start_line >= 1) & (end_line >= start_line) & (F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " ")) != "")
