"""Source trees as tables."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import paths
from trawl.sources import folders

T = TypeVar("T")


#: Times a read is tried, and the seconds before the next.
ATTEMPTS, PAUSE = 3, 0.1


def _columns(raw: DataFrame, root: str) -> DataFrame:
    base = root.split("://")[-1].rstrip("/")
    relative = F.substring_index(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/"), base + "/", -1)
    return raw.select(relative.alias("path"), F.col("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root``: path (relative), content, size, modified_at.

    Files that vanish meanwhile are skipped; unreadable ones fail the read, so that they
    don't look deleted (Spark tries a task again before it gives up).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    return _columns(raw, root)


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Some files of a tree by their relative paths; other files aren't opened. Missing ones are skipped."""
    there = [f"{root.rstrip('/')}/{n}" for n in names]
    there = [p for p in there if with_retry(lambda p=p: folders.exists(spark, p))]
    if not there:
        return read_tree(spark, root).limit(0)
    # a path isn't a pattern
    escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in there]
    return _columns(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(escaped), root)


def with_retry(call: Callable[[], T], attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> T:
    """Calls again after errors, as a locked file gives, a little later each time."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(pause * (k + 1))
    raise AssertionError("unreachable")


def indexable(files: DataFrame, include: Iterable[str], exclude: Iterable[str] = (), ignore: Iterable[paths.IgnoreRule] = (), max_size: int = paths.MAX_FILE_SIZE) -> DataFrame:
    """Files that pass globs, ignore rules and size; the state directory never does."""
    path = F.col("path")
    return files.filter(paths.included(path, include, exclude) & ~paths.ignored(path, ignore or paths.ignore_rules()) & paths.readable_size(F.col("size"), max_size))


def decoded(files: DataFrame) -> DataFrame:
    """Binary content as text (UTF-8, broken characters replaced) with language and hash."""
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("language", paths.language(F.col("path")))


def detect_extensions(files: DataFrame) -> DataFrame:
    """Known extensions and languages of a tree, without hidden and dependency directories, in order."""
    seen = files.filter(~paths.skipped_in_detection(F.col("path"))).select(paths.extension(F.col("path")).alias("extension")).distinct()
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in paths.LANGUAGE_OF.items() for x in kv]), "extension"), F.lit(""))
    return seen.withColumn("language", known).filter("language <> ''").orderBy("extension")
