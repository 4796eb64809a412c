"""Start-up reconciliation of a directory with its index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_diff(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and change (added, modified, deleted) from two (path, modified_at) tables; unchanged paths don't appear."""
    d = disk.select("path", F.col("modified_at").alias("now"))
    i = indexed.select("path", F.col("modified_at").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("then"), "modified")
    return d.join(i, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")
