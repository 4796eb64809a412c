"""Subprojects: detection by marker files, declared overrides, synchronisation, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import paths


def detect(files: DataFrame) -> DataFrame:
    """id, path, marker_file, language_hint of every directory (but the root) with a marker; its strongest counts."""
    named = files.select("path").withColumn("marker_file", paths.base_name(F.col("path"))).withColumn("dir", paths.directory(F.col("path")))
    marked = named.withColumn("priority", paths.marker_priority(F.col("marker_file"))).filter(F.col("priority").isNotNull() & (F.col("dir") != "."))
    marked = marked.filter(~paths.in_excluded_directory(F.col("dir")))
    best = marked.groupBy("dir").agg(F.min(F.struct("priority", "marker_file"))["marker_file"].alias("marker_file"))
    return best.select(paths.subproject_slug(F.col("dir")).alias("id"), F.col("dir").alias("path"), "marker_file", paths.language_hint(F.col("marker_file")).alias("language_hint"))


def merge_overrides(detected: DataFrame, declared: DataFrame) -> DataFrame:
    """Detected and declared (id, path, name) subprojects by path: a declaration wins and inherits what it leaves blank."""
    d = detected.select("path", F.col("id").alias("d_id"), "marker_file", "language_hint")
    c = declared.select("path", F.nullif(F.col("id"), F.lit("")).alias("c_id"), F.nullif(F.col("name"), F.lit("")).alias("name"), F.lit(True).alias("declared"))
    return d.join(c, "path", "full_outer").select(
        F.coalesce("c_id", "d_id", paths.path_slug(F.col("path"))).alias("id"),
        "path",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("marker_file", F.lit("")).alias("marker_file"),
        F.coalesce("language_hint", F.lit("")).alias("language_hint"),
        F.col("declared").isNull().alias("auto_detected"),
    )


def sync(existing: DataFrame, merged: DataFrame) -> DataFrame:
    """id and change: added, removed (only rows once detected), unchanged, or kept though gone."""
    e = existing.select("id", F.col("auto_detected").alias("was_auto"))
    m = merged.select("id", F.lit(True).alias("now"))
    change = F.when(F.col("was_auto").isNull(), "added").when(F.col("now"), "unchanged").when(F.col("was_auto"), "removed").otherwise("kept")
    return e.join(m, "id", "full_outer").select("id", change.alias("change"))


def assign(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    """path and the id and path of its most specific subproject (null if none).

    Every directory prefix of a path meets the subprojects in an equi-join, so no range or
    cross join is needed however many there are.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    spread = files.select("path").distinct().select("path", F.explode(F.concat(F.array(F.lit(".")), prefixes)).alias("sub_path"))
    found = spread.join(subprojects.select(F.col("id").alias("sub_id"), F.col("path").alias("sub_path")), "sub_path", "left")
    place = F.when(F.col("sub_id").isNotNull(), F.struct(F.when(F.col("sub_path") == ".", 0).otherwise(F.length("sub_path")).alias("n"), "sub_id", "sub_path"))
    best = found.groupBy("path").agg(F.max(place).alias("b"))
    return best.select("path", F.col("b.sub_id").alias("subproject_id"), F.col("b.sub_path").alias("subproject_path"))
