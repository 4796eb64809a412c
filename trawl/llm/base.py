"""What the corpus operators share: inputs, tokens, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trawl.sources.folders import hadoop_path, shared_folder

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Spark inlines a projected column into lambda bodies, where it would be evaluated
    again for every element; a one-element array binds it to a variable.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Rows of some 16 to 60 bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the written table's counted rows allow it."""
    return F.broadcast(df) if rows(df) <= BROADCAST_ROWS else df


def rows(df: DataFrame) -> int:
    """The number of rows, counted as ``Scratch`` wrote them or else now."""
    known = vars(df).get("_rows")
    return df.count() if known is None else known


def numbered(df: DataFrame, n: int) -> DataFrame:
    """``df``, known to have ``n`` rows, or no more than these."""
    df._rows = n
    return df


def joined(df: DataFrame, end: str, other: DataFrame) -> DataFrame:
    """``df`` with the other columns of ``other`` (id, ...) where id is column ``end``; two longs sort faster than a struct of them."""
    other = other.select(F.col("id").alias("_id"), *other.columns[1:])
    on = [F.col(f"{end}.{d}") == F.col(f"_id.{d}") for d in ("d1", "d2")]
    return df.join(other, on).drop("_id")


class Scratch:
    """Tables written to the folder all executors share (``spark.checkpoint.dir``).

    A written table cuts lineage and survives lost executors. Its rows are counted by the
    job that writes it: a job of its own for each count is a plan, stages and tasks that
    the driver keeps in memory. Tables are removed by
    ``drop`` when an operator is through with them, the rest when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        self.paths[name] = path = f"{self.root}/{name}"
        schema, seen = df.schema, Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**(options or {})).parquet(path)
        self._fs(path, lambda fs, p: fs.deleteOnExit(p))
        return numbered(self.spark.read.schema(schema).parquet(path), seen.get["n"])

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs(self.paths.pop(name), lambda fs, p: fs.delete(p, True))

    def keep(self, *names: str) -> None:
        """Removes all tables but these, which a result still reads."""
        self.drop(*[n for n in self.paths if n not in names])

    def _fs(self, path: str, act) -> None:
        p, fs = hadoop_path(self.spark, path)
        act(fs, p)
