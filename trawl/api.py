"""The engine's surface: index a tree, keep it up to date, search it, report on it."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.config import Config
from trawl.errors import RequestError
from trawl.functions import paths
from trawl.functions.text import metric_tokens
from trawl.operators import chunking, metrics, scan, store, subprojects
from trawl.operators.postings import KeywordIndex
from trawl.plans.search import SearchRequest, search, with_parents
from trawl.sources import files, folders
from trawl.sources.embedders import Cached, Embedder, MockEmbedder, embed_column, model_of
from trawl.streaming.changes import apply_stream, relevant

TABLES = ("files", "chunks", "embeddings", "vectors", "subprojects")
#: Changed files that are opened by name; beyond it the tree is listed once and joined.
NAMED_FILES = 10_000


class Engine:
    """An index of one source tree, kept as tables under ``root``."""

    def __init__(self, spark: SparkSession, tree: str, root: str, config: Config | None = None, embedder: Embedder | None = None, ignore: Iterable[str] = ()):
        self.spark, self.tree, self.root = spark, tree, root.rstrip("/")
        self.store = store.IndexStore(spark, root)
        self.store.migrate()
        self.config, self.embedder = config or Config(), embedder or MockEmbedder()
        self.queries = Cached(self.embedder, self.config.cache_size)
        self.keywords = KeywordIndex(spark, f"{self.root}/keywords")
        self.rules = paths.ignore_rules(ignore)

    # --- indexing --------------------------------------------------------------------------

    def _indexable(self, found: DataFrame) -> DataFrame:
        return files.indexable(found, self.config.include, self.config.exclude, self.rules, self.config.max_file_size)

    def _tables(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        text = files.decoded(found)
        about = text.select("path", "content_hash", "size", "modified_at", "language").withColumn("indexed_at", F.current_timestamp())
        chunks = chunking.chunk_files(text.select("path", "content"), self.config.max_tokens).filter(F.col("level").isin(*self.config.chunk_levels))
        chunks = chunks.join(about.select("path", "modified_at"), "path")
        own = subprojects.assign(about, self.store.read("subprojects"))
        return about, chunks.join(own, "path", "left")

    def _provider(self) -> dict[str, str]:
        return {"embedding_provider": self.embedder.name, "embedding_model": model_of(self.embedder), "embedding_dimensions": str(self.embedder.dimensions)}

    def _embed(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, path, embedding) of written chunks; contents embedded before aren't embedded again."""
        if not self.store.exists("vectors"):
            self.store.write("vectors", self.spark.createDataFrame([], "content_hash string, embedding array<float>"), by="content_hash")
        known = self.store.read("vectors").select("content_hash")
        wanted = chunks.select("content_hash", "content").dropDuplicates(["content_hash"])
        missing = wanted.join(known, "content_hash", "left_anti")
        self.store.append("vectors", embed_column(missing, self.embedder).select("content_hash", "embedding"))
        return chunks.select("chunk_id", "path", "content_hash").join(self.store.read("vectors"), "content_hash").select("chunk_id", "path", "embedding")

    def _find_subprojects(self) -> None:
        """Detected and declared ones; what was detected before and is gone goes, declarations stay."""
        found = subprojects.detect(files.read_tree(self.spark, self.tree).select("path")) if self.config.auto_detect else None
        found = found if found is not None else self.spark.createDataFrame([], "id string, path string, marker_file string, language_hint string")
        merged = subprojects.merge_overrides(found, self.spark.createDataFrame(list(self.config.subprojects), "id string, path string, name string"))
        if self.store.exists("subprojects"):
            old = self.store.read("subprojects")
            kept = subprojects.sync(old.select("id", "auto_detected"), merged).filter("change = 'kept'").select("id")
            merged = merged.unionByName(old.join(kept, "id", "left_semi"), allowMissingColumns=True)
        self.store.write("subprojects", merged, by="id")

    def reindex(self) -> dict[str, int]:
        """Everything anew; vectors of known content are reused unless provider or model changed."""
        if store.provider_changed(self.store.metadata(), self.embedder.name, model_of(self.embedder)):
            self.store.clear("vectors")
        self._find_subprojects()
        with Progress(self.spark, self.root) as progress:
            about, chunks = self._tables(self._indexable(files.read_tree(self.spark, self.tree)))
            progress.step("chunks")
            chunks = self.store.write("chunks", chunks, by="path")
            progress.step("embeddings")
            self.store.write("embeddings", self._embed(chunks), by="path")
            progress.step("keywords")
            self.keywords.rebuild(chunks)
            progress.step("files")
            self.store.write("files", about, by="path")
        self.store.set_metadata(**self._provider(), last_indexed=str(int(time.time())))
        return self.status()

    def update(self, actions: DataFrame) -> None:
        """Applies (path, action) rows: ``index`` reads the file again, ``delete`` forgets it.

        Only the named files are opened, and only the folders of their paths are rewritten.
        Files are recorded last: after a crash ``reconcile`` finds what wasn't applied.
        """
        if not self.store.exists("files"):
            raise RequestError("NOT_INDEXED")
        rows = actions.select("path", "action").distinct().limit(NAMED_FILES + 1).collect()
        if len(rows) <= NAMED_FILES:
            touched = self.spark.createDataFrame([(r["path"],) for r in rows], "path string")
            found = files.read_files(self.spark, self.tree, [r["path"] for r in rows if r["action"] == "index"])
            old = self.store.lookup("chunks", [r["path"] for r in rows]).select("chunk_id")
        else:
            touched = actions.select("path").distinct()
            found = files.read_tree(self.spark, self.tree).join(actions.filter("action = 'index'").select("path"), "path", "left_semi")
            old = self.store.read("chunks").join(touched, "path", "left_semi").select("chunk_id")
        about, chunks = self._tables(self._indexable(found))
        draft = f"{self.root}/changes"
        chunks.write.mode("overwrite").parquet(draft)
        chunks = self.spark.read.schema(chunks.schema).parquet(draft)
        self.store.change("embeddings", self._embed(chunks), touched)
        self.keywords.add(chunks, gone=old)
        self.store.change("chunks", chunks, touched)
        self.store.change("files", about, touched)
        folders.remove(self.spark, draft)
        self.store.set_metadata(**self._provider(), last_indexed=str(int(time.time())))

    def reconcile(self) -> DataFrame:
        """Differences between tree and index, as actions."""
        diff = scan.scan_diff(self._indexable(files.read_tree(self.spark, self.tree)), self.store.read("files"))
        return diff.select("path", F.when(F.col("change") == "deleted", "delete").otherwise("index").alias("action"))

    def watch(self, events: DataFrame, checkpoint: str, once: bool = False):
        """Keeps the index up to date from a stream of events (path, op, ts); indexes all if nothing is yet.

        Events on ignored paths and on directories (``is_directory``, where present) are dropped.
        """
        if not self.store.exists("files"):
            self.reindex()
        return apply_stream(relevant(events, self.rules), lambda actions, _: self.update(actions), checkpoint, f"{self.config.debounce_ms} milliseconds", once)

    # --- reading ---------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        return self.store.read("chunks").join(self.store.read("embeddings").drop("path"), "chunk_id", "left").withColumnRenamed("subproject_id", "subproject")

    def search(self, query: str, **options) -> DataFrame:
        """Results with their parents' id, name and level."""
        if not query.strip():
            raise RequestError("QUERY_EMPTY")
        if not self.store.exists("chunks"):
            raise RequestError("NOT_INDEXED")
        request = SearchRequest(query, self.queries.embed([query])[0], **options)
        found = search(self.chunks(), request, F.current_timestamp(), self.config, self.keywords)
        return with_parents(found, self.store.read("chunks"))

    def file(self, path: str) -> DataFrame:
        return self.store.lookup("files", [path])

    def chunks_of(self, path: str) -> DataFrame:
        return self.store.lookup("chunks", [path]).orderBy("start_line", F.desc("end_line"), "chunk_id")

    def chunks_by_id(self, ids: list[str]) -> DataFrame:
        return self.store.lookup("chunks", ids, "chunk_id")

    def subprojects(self) -> DataFrame:
        """By path."""
        return self.store.read("subprojects").orderBy("path")

    def put_subproject(self, id_: str, path: str, name: str = "") -> None:
        """Inserts or replaces one that is declared, not detected."""
        if not id_ or not path:
            raise RequestError("INVALID_REQUEST", "a subproject needs an id and a path")
        row = self.spark.createDataFrame([(id_, path, name, "", "", False)], "id string, path string, name string, marker_file string, language_hint string, auto_detected boolean")
        if self.store.exists("subprojects"):
            self.store.change("subprojects", row, row.select("id"))
        else:
            self.store.write("subprojects", row, by="id")

    def delete_subproject(self, id_: str) -> None:
        gone = self.spark.createDataFrame([(id_,)], "id string")
        self.store.change("subprojects", self.store.read("subprojects").limit(0), gone)

    def savings(self, results: DataFrame) -> DataFrame:
        """Metrics of results against reading every indexed file."""
        out = metrics.search_metrics(results)
        return out.withColumns(metrics.savings(F.col("total_tokens"), self.status()["files"]))

    def health(self) -> dict[str, str]:
        return {"status": "healthy" if self.store.exists("chunks") else "empty"}

    def status(self) -> dict[str, int]:
        return {t: self.store.read(t).count() if self.store.exists(t) else 0 for t in TABLES}

    def progress(self) -> dict | None:
        """The running reindex's steps, share and seconds left; None while none runs."""
        return Progress.of(self.spark, self.root)

    def clear(self) -> None:
        self.store.clear(*TABLES, "keywords")
        self.keywords = KeywordIndex(self.spark, f"{self.root}/keywords")

    def tokens(self) -> DataFrame:
        return self.store.read("chunks").agg(F.sum(metric_tokens(F.col("content"))).alias("tokens"))


class Progress:
    """Publishes where a reindex is, for other sessions to read; also says that one is running."""

    STEPS = ("chunks", "embeddings", "keywords", "files")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path, self.began, self.name = spark, f"{root}/PROGRESS", time.time(), ""

    def __enter__(self) -> Progress:
        if folders.exists(self.spark, self.path):
            raise RequestError("INDEXING_IN_PROGRESS")
        return self

    def step(self, name: str) -> None:
        done = self.STEPS.index(name)
        took = time.time() - self.began
        left = took / done * (len(self.STEPS) - done) if done else 0.0
        about = {"step": name, "steps": len(self.STEPS), "done": done, "percent": 100 * done / len(self.STEPS), "started": self.began, "eta_seconds": round(left, 1)}
        folders.publish(self.spark, self.path, json.dumps(about))

    def __exit__(self, *_: object) -> None:
        folders.remove(self.spark, self.path)

    @staticmethod
    def of(spark: SparkSession, root: str) -> dict | None:
        text = folders.read_text(spark, f"{root.rstrip('/')}/PROGRESS")
        return json.loads(text) if text else None
