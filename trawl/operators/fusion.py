"""Reciprocal rank fusion of a vector and a keyword list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scoring import RRF_K, match_source, rrf_term


def ranked(hits: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Adds the 0-based rank of a short list (limited before), per ``by`` where given."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(window) - 1)


def rrf(vector: DataFrame, keyword: DataFrame, limit: int, k: int = RRF_K, by: list[str] | None = None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Fuses (chunk_id, score, rank) lists; unweighted unless told otherwise. Absent ranks are -1, absent scores 0."""
    keys = [*(by or []), "chunk_id"]
    v = vector.select(*keys, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    w = keyword.select(*keys, F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    both = v.join(w, keys, "full_outer").select(
        *keys,
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        F.coalesce("vector_rank", F.lit(-1)).alias("vector_rank"),
        F.coalesce("keyword_rank", F.lit(-1)).alias("keyword_rank"),
    )
    total = weights[0] * rrf_term(F.col("vector_rank"), k) + weights[1] * rrf_term(F.col("keyword_rank"), k)
    fused = both.withColumn("rrf_score", F.round(total, 9)).withColumn("match_source", match_source(F.col("vector_rank"), F.col("keyword_rank")))
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rrf_score"), "chunk_id"))
        return fused.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")
    return fused.orderBy(F.desc("rrf_score"), "chunk_id").limit(max(0, limit))


def vector_only(vector: DataFrame, limit: int) -> DataFrame:
    """With hybrid search off the vector score stands for the fused one."""
    out = vector.select(
        "chunk_id",
        F.col("score").alias("vector_score"),
        F.lit(0.0).alias("keyword_score"),
        F.col("rank").alias("vector_rank"),
        F.lit(-1).alias("keyword_rank"),
        F.col("score").alias("rrf_score"),
        F.lit("vector").alias("match_source"),
    )
    return out.orderBy(F.desc("rrf_score"), "chunk_id").limit(max(0, limit))
