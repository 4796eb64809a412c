"""Metrics of searches and of indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import metric_tokens

TOKENS_PER_LINE, BASELINE_FILES, BASELINE_LINES, ROLLING = 10, 500, 100, 10


def search_metrics(results: DataFrame) -> DataFrame:
    """result_count, total_tokens and total_lines of results (content, start_line, end_line)."""
    return results.agg(
        F.count("*").alias("result_count"),
        F.coalesce(F.sum(metric_tokens(F.col("content"))), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("total_lines"),
    )


def savings(total_tokens: Column, files: int = BASELINE_FILES, lines: int = BASELINE_LINES) -> dict[str, Column]:
    """Against reading whole files line by line."""
    baseline = F.lit(files * lines * TOKENS_PER_LINE).cast("long")
    saved = F.greatest(F.lit(0).cast("long"), baseline - total_tokens)
    percent = F.when(baseline > 0, saved / baseline * 100).otherwise(0.0)
    return {"baseline_tokens": baseline, "tokens_saved": saved, "percent_saved": percent}


def index_progress(batches: DataFrame, total: Column, by: list[str] | None = None) -> DataFrame:
    """batches: seq, chunks, seconds. Completed chunks, percent, rate and seconds left after each batch.

    The rate covers the last ten batches with positive chunks and time; the rest only counts
    as completed. Seconds left are 0 until two such batches are known.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("seq")
    timed = (F.col("chunks") > 0) & (F.col("seconds") > 0)
    out = batches.withColumn("_n", F.sum(F.when(timed, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # frames count timed batches only, so the window runs over their running number
    last = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_n").rangeBetween(-(ROLLING - 1), 0)
    chunks, seconds = (F.sum(F.when(timed, F.col(c))).over(last) for c in ("chunks", "seconds"))
    done = F.sum(F.greatest("chunks", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"completed": done.cast("long"), "_chunks": chunks, "_seconds": seconds, "_total": total.cast("long")})
    rate = F.when(F.col("_seconds") > 0, F.col("_chunks") / F.col("_seconds")).otherwise(0.0)
    left = F.col("_total") - F.col("completed")
    percent = F.when(F.col("_total") == 0, 100.0).otherwise(F.col("completed") / F.col("_total") * 100)
    out = out.withColumns({"percent": percent, "rate": rate})
    eta = F.when((F.col("_n") >= 2) & (left > 0) & (F.col("rate") > 0), F.floor(left / F.col("rate"))).otherwise(0).cast("long")
    return out.withColumn("eta_seconds", eta).drop("_n", "_chunks", "_seconds", "_total")
