"""Index tables: keyed upserts, cascading deletes, embeddings and metadata.

Tables are DataFrames; a mutation is a new DataFrame. ``IndexStore`` keeps them as Parquet
under one root and publishes every change in one step.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.sources import folders

PROVIDER_KEYS = ("embedding_provider", "embedding_model", "embedding_dimensions")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: one row per key, the greatest by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of the same key."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files at the paths of ``gone``, their chunks and those chunks' embeddings."""
    lost = chunks.join(gone.select("path").distinct(), "path", "left_semi").select("chunk_id")
    return delete(files, gone, ["path"]), delete(chunks, gone, ["path"]), delete(embeddings, lost, ["chunk_id"])


def embed_missing(chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Embeddings of chunks by content hash, and the vector table extended by those that were missing.

    Every distinct content is embedded once, however many chunks share it.
    """
    wanted = chunks.select("content_hash", "content").dropDuplicates(["content_hash"])
    missing = wanted.join(vectors.select("content_hash"), "content_hash", "left_anti")
    fresh = embed(missing).select("content_hash", "embedding")
    known = vectors.select("content_hash", "embedding").unionByName(fresh)
    return chunks.select("chunk_id", "content_hash").join(known, "content_hash").select("chunk_id", "embedding"), known


def cache_metrics(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Requested contents, and how many of them found a stored vector."""
    hit = vectors.select("content_hash", F.lit(1).alias("hit")).distinct()
    joined = requests.select("content_hash").join(hit, "content_hash", "left")
    return joined.agg(F.count("*").alias("requests"), F.count("hit").alias("hits"), F.count(F.when(F.col("hit").isNull(), 1)).alias("misses"))


def provider_changed(stored: dict[str, str], provider: str, model: str) -> bool:
    """Whether vectors must be made anew; never if none were stored."""
    if not stored.get(PROVIDER_KEYS[0]):
        return False
    return (stored[PROVIDER_KEYS[0]], stored.get(PROVIDER_KEYS[1])) != (provider, model)


class ConflictError(RuntimeError):
    """Another writer published a version of the table meanwhile."""


class IndexStore:
    """Named Parquet tables under one root in any file system Spark reaches.

    A table is dealt to folders by a hash of one column (``path``, or ``content_hash`` for
    vectors). A change reads and writes the folders of the keys it touches only. The manifest
    of a table lists the files' folders that count and is replaced in one step, so readers see
    a version whole; two writers of one table can't both publish the same version.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _manifest(self, name: str) -> dict | None:
        text = folders.read_text(self.spark, f"{self.root}/{name}/CURRENT")
        return json.loads(text) if text else None

    def exists(self, name: str) -> bool:
        return folders.exists(self.spark, f"{self.root}/{name}/CURRENT")

    def version(self, name: str) -> int:
        now = self._manifest(name)
        return now["version"] if now else 0

    def read(self, name: str) -> DataFrame:
        return self._folders(self._manifest(name))

    def _folders(self, now: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        paths = [p for b, ps in now["parts"].items() if only is None or int(b) in only for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, by: str, n: int) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")

    def _save(self, name: str, df: DataFrame, by: str, n: int, version: int) -> dict[str, list[str]]:
        """Writes rows into folders by bucket; the folders by bucket."""
        path = f"{self.root}/{name}/v{version}"
        rows = df.withColumn("_bucket", self._bucket(by, n))
        rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        p, fs = folders.hadoop_path(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {x.split("=")[1]: [f"{path}/{x}"] for x in names if x.startswith("_bucket=")}

    def _publish(self, name: str, now: dict, expected: int) -> None:
        if self.version(name) != expected:
            raise ConflictError(f"{name} is at version {self.version(name)}, not {expected}")
        folders.publish(self.spark, f"{self.root}/{name}/CURRENT", json.dumps(now))

    def _clean(self, name: str, keep: tuple[dict | None, ...]) -> None:
        """Drops versions that neither the current nor the last manifest uses."""
        used = {p.rsplit("/", 2)[1] for m in keep if m for ps in m["parts"].values() for p in ps}
        p, fs = folders.hadoop_path(self.spark, f"{self.root}/{name}")
        for s in fs.listStatus(p):
            if s.isDirectory() and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def write(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Replaces the whole table."""
        old = self._manifest(name)
        by = by or (old["by"] if old else df.columns[0])
        version = (old["version"] if old else 0) + 1
        now = {"version": version, "by": by, "buckets": self.buckets, "schema": json.loads(df.schema.json())}
        now["parts"] = self._save(name, df, by, self.buckets, version)
        self._publish(name, now, version - 1)
        self._clean(name, (old, now))
        return self._folders(now)

    def change(self, name: str, rows: DataFrame, gone: DataFrame) -> None:
        """Drops the rows whose key column's value is in ``gone`` and adds ``rows``; other folders stay as they are.

        The table's key column is the one it is dealt by; values of ``rows`` belong in ``gone`` too.
        """
        old = self._manifest(name)
        by, n, version = old["by"], old["buckets"], old["version"] + 1
        keys = gone.select(by).unionByName(rows.select(by)).distinct()
        touched = {r[0] for r in keys.select(self._bucket(by, n)).distinct().collect()}  # at most ``buckets`` values
        kept = self._folders(old, touched).join(gone.select(by).distinct(), by, "left_anti")
        new = kept.unionByName(rows, allowMissingColumns=True)
        # columns that are new go behind the others; older folders read them as null
        schema = StructType.fromJson(old["schema"])
        schema = StructType([*schema.fields, *(f for f in new.schema.fields if f.name not in schema.names)])
        saved = self._save(name, new.select(*schema.names), by, n, version)
        parts = {b: ps for b, ps in old["parts"].items() if int(b) not in touched} | saved
        now = {"version": version, "by": by, "buckets": n, "schema": json.loads(schema.json()), "parts": parts}
        self._publish(name, now, version - 1)
        self._clean(name, (old, now))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows of new keys beside the folders there are."""
        old = self._manifest(name)
        version = old["version"] + 1
        saved = self._save(name, rows.select(*[f["name"] for f in old["schema"]["fields"]]), old["by"], old["buckets"], version)
        parts = {b: [*old["parts"].get(b, []), *saved.get(b, [])] for b in {**old["parts"], **saved}}
        self._publish(name, old | {"version": version, "parts": parts}, version - 1)

    def upsert(self, name: str, changes: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, upsert(self.read(name), changes, keys) if self.exists(name) else changes)

    def lookup(self, name: str, values: list, column: str | None = None) -> DataFrame:
        """The rows with one of the values; by the key column only their folders are read."""
        now = self._manifest(name)
        column = column or now["by"]
        only = None
        if column == now["by"] and values:
            asked = self.spark.createDataFrame([(v,) for v in values], [column])
            only = {r[0] for r in asked.select(self._bucket(column, now["buckets"])).distinct().collect()}
        return self._folders(now, only).filter(F.col(column).isin(list(values)))

    def clear(self, *names: str) -> None:
        for name in names:
            folders.remove(self.spark, f"{self.root}/{name}")

    # --- metadata and migrations -----------------------------------------------------------

    def metadata(self) -> dict[str, str]:
        text = folders.read_text(self.spark, f"{self.root}/METADATA")
        return json.loads(text) if text else {}

    def set_metadata(self, **values: str) -> None:
        folders.publish(self.spark, f"{self.root}/METADATA", json.dumps(self.metadata() | values))

    def delete_metadata(self, *keys: str) -> None:
        """Keys that aren't there are fine."""
        folders.publish(self.spark, f"{self.root}/METADATA", json.dumps({k: v for k, v in self.metadata().items() if k not in keys}))

    def migrate(self, steps: list[Callable[[IndexStore], None]] | None = None) -> int:
        """Runs the steps beyond the stored schema version, each recorded once done; the version reached."""
        steps = MIGRATIONS if steps is None else steps
        at = int(self.metadata().get("schema_version", "0"))
        for number, step in list(enumerate(steps, 1))[at:]:
            step(self)
            self.set_metadata(schema_version=str(number))
        return max(at, len(steps))


def add_columns(table: str, **kinds: str) -> Callable[[IndexStore], None]:
    """A step that adds columns (name: type) to a table's schema; rows there read them as null."""

    def step(store: IndexStore) -> None:
        now = store._manifest(table)
        if now:
            schema = StructType.fromJson(now["schema"])
            for column, kind in kinds.items():
                if column not in schema.names:
                    schema = schema.add(column, kind)
            store._publish(table, now | {"version": now["version"] + 1, "schema": json.loads(schema.json())}, now["version"])

    return step


#: Steps of the schema, in order; additive, as readers of older folders need.
MIGRATIONS: list[Callable[[IndexStore], None]] = [
    add_columns("files", language="string", size="long"),
    add_columns("chunks", parent_chunk_id="string", chunk_index="integer", is_partial="boolean"),
    add_columns("chunks", subproject_id="string", subproject_path="string"),
    add_columns("subprojects", name="string", auto_detected="boolean"),
]
