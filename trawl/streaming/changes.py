"""Change capture: file events are debounced per path, coalesced and applied.

A burst of events on one path ends once the path is quiet for the gap: a session window.
Of a burst the first operation stays, but a leading ``modify`` gives way to the first other
operation. The batch and the streaming form share their aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.functions import paths

GAP = "500 milliseconds"
# Raw file system flags and what they mean, the strongest first.
RAW_OPS = {"create": "create", "remove": "delete", "rename": "rename", "write": "modify", "chmod": "modify"}


def operation(raw: Column) -> Column:
    """One operation of a set of raw flags such as ``CREATE|WRITE``; null if none is known."""
    low, out = F.lower(raw), F.lit(None).cast("string")
    for flag, op in reversed(RAW_OPS.items()):
        out = F.when(low.contains(flag), op).otherwise(out)
    return out


def relevant(events: DataFrame, rules: list[paths.IgnoreRule]) -> DataFrame:
    """Drops ignored paths and directories (``is_directory`` where present)."""
    out = events.filter(~paths.ignored(F.col("path"), rules))
    return out.filter(~F.col("is_directory")) if "is_directory" in events.columns else out


def coalesced(op: Column, ts: Column) -> Column:
    other = F.min_by(F.when(op != "modify", op), F.when(op != "modify", ts))
    return F.when(F.min_by(op, ts) != "modify", F.min_by(op, ts)).otherwise(F.coalesce(other, F.lit("modify")))


def debounce(events: DataFrame, gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """events: path, op, ts. One row a burst: path, op, started, ended (last event plus gap), n_events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    window = F.session_window("ts", gap)
    out = rows.groupBy("path", window).agg(coalesced(F.col("op"), F.col("ts")).alias("op"), F.count("*").alias("n_events"))
    return out.select("path", "op", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events")


def plan_changes(changes: DataFrame) -> DataFrame:
    """Each path's last change as an action: create and modify index, delete and rename delete."""
    last = changes.groupBy("path").agg(F.max_by("op", "ended").alias("op"))
    return last.select("path", F.when(F.col("op").isin("create", "modify"), "index").otherwise("delete").alias("action"))


def apply_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, once: bool = False) -> StreamingQuery:
    """Runs ``apply(actions, batch)`` on every micro-batch of finished bursts; late events beyond the gap are dropped.

    The checkpoint replaces pid and state files: a restart goes on where the last one ended.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply(plan_changes(batch), number)

    writer = debounce(events, gap, watermark=gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON event files (path, op, ts) as a stream; the trigger's bound is the back-pressure."""
    return spark.readStream.schema("path string, op string, ts timestamp").option("maxFilesPerTrigger", files_per_trigger).json(folder)
