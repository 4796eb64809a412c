"""Results that are parts of one split chunk are collapsed into their best part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scoring import split_boost


def collapse_splits(hits: DataFrame) -> DataFrame:
    """hits: chunk_id, parent_chunk_id, score. Keeps each parent's best part with a boosted score.

    ``matched_splits`` counts the parts found, 0 for whole chunks.
    """
    own = F.nullif(F.col("parent_chunk_id"), F.lit(""))
    group = Window.partitionBy(F.coalesce(own, F.col("chunk_id")))
    best = F.row_number().over(group.orderBy(F.desc("score"), "chunk_id"))
    out = hits.withColumns({"_best": best, "_n": F.count("*").over(group)})
    matched = F.when(F.col("_n") > 1, F.col("_n")).when(own.isNull(), 0).otherwise(1)
    out = out.filter("_best = 1").withColumn("matched_splits", matched.cast("long")).withColumn("score", F.round(split_boost(F.col("score"), F.col("_n")), 9))
    return out.drop("_best", "_n").orderBy(F.desc("score"), "chunk_id")
