"""Exact nearest neighbours: top-k, filtered before or after, and many queries at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import paths
from trawl.functions.vectors import l2_distance, literal
from trawl.shipping import ship

ship(__name__)

#: Queries that are collected and shipped at a time, in expectation.
QUERY_BLOCK = 4096


def with_distance(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    return vectors.withColumn("distance", F.round(l2_distance(F.col(column), literal(query)), 6))


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """The k nearest by rounded L2 distance, then key. Plans as TakeOrderedAndProject: a heap of k per partition."""
    return with_distance(vectors, query).drop("embedding").orderBy("distance", key).limit(max(0, k))


def level_filter(levels: list[str] | None) -> Column:
    return F.col("level").isin(list(levels)) if levels else F.lit(True)


def knn_prefiltered(vectors: DataFrame, query: list[float], k: int, levels: list[str] | None = None, like_prefix: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Filters first, so k results come back where k rows pass."""
    rows = vectors.filter(level_filter(levels))
    if like_prefix:
        rows = rows.filter(paths.like_prefix(F.col("path"), like_prefix))
    if ids is not None:
        rows = rows.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    return knn(rows, query, k)


def knn_postfiltered(vectors: DataFrame, query: list[float], k: int, levels: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Takes k and filters those, so fewer may come back. The filter stays above the limit."""
    rows = knn(vectors, query, k).filter(level_filter(levels))
    return rows.filter(F.col("path").startswith(prefix)) if prefix else rows


def knn_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, distance, rank) of the k nearest to each of a bounded batch of queries.

    Each Arrow batch is one matrix product against all queries and keeps the k nearest of
    every query; only those (k per query and batch) are ranked across partitions. Distances
    of the survivors are computed exactly, by differences.
    """
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    squares = (matrix**2).sum(axis=1)

    def nearest(batches):
        for batch in batches:
            flat = batch.column(1)
            keep = flat.is_valid().to_numpy(zero_copy_only=False)
            names = batch.column(0).filter(pa.array(keep))
            x = np.array(flat.drop_null().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(names), -1)
            if not len(x) or not len(ids):
                continue
            rough = (x**2).sum(axis=1)[:, None] + squares - 2 * (x @ matrix.T)
            n = min(k, len(x))
            # ties at the k-th place all stay, the ranking below breaks them by key
            limit = np.partition(rough, n - 1, axis=0)[n - 1] + 1e-6
            row, q = np.nonzero(rough <= limit)
            exact = np.sqrt(((x[row] - matrix[q]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), names.take(pa.array(row)), pa.array(exact)], ["query_id", key, "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    found = vectors.select(key, "embedding").mapInArrow(nearest, f"query_id bigint, {key} {kind}, distance double")
    found = found.withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", block: int = QUERY_BLOCK) -> DataFrame:
    """``knn_batch`` for a table of queries (query_id, embedding) of any size.

    Queries are dealt to blocks by a hash of their id, and only one block at a time is
    collected and shipped; each block reads the vectors once.
    """
    asked = queries.filter("embedding is not null")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").collect()
        if rows:
            parts.append(knn_batch(vectors, [(r["query_id"], list(r["embedding"])) for r in rows], k, key))
    if not parts:
        return knn_batch(vectors.limit(0), [], k, key)
    return reduce(DataFrame.unionByName, parts)
