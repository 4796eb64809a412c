"""A search request as one logical plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.config import Config
from trawl.errors import RequestError
from trawl.functions import display, paths, scoring, text
from trawl.functions.vectors import similarity
from trawl.operators import fusion, keyword, postings, rerank, splits, vector

Index = postings.Unstored | postings.KeywordIndex
MODES = ("hybrid", "service", "daemon")
SCOPES = ("auto", "all", "path", "subproject")


#: Bytes of the longest query.
LONGEST_QUERY = 10_000


@dataclass(frozen=True)
class SearchRequest:
    query: str
    vector: list[float] = field(repr=False)
    limit: int = 0
    levels: tuple[str, ...] = ()
    path_prefix: str | None = None
    subproject: str | None = None
    scope: str = "auto"
    mode: str = "hybrid"
    hybrid: bool = True
    rerank: bool = True

    def checked(self, config: Config) -> SearchRequest:
        if not self.query.strip():
            raise RequestError("QUERY_EMPTY")
        if len(self.query.encode()) > LONGEST_QUERY:
            raise RequestError("QUERY_TOO_LONG")
        if self.mode not in MODES or self.scope not in SCOPES:
            raise RequestError("INVALID_REQUEST", f"mode is one of {MODES}, scope one of {SCOPES}")
        if self.path_prefix and self.subproject:
            raise RequestError("INVALID_REQUEST", "give a path or a subproject, not both")
        if self.limit > 0:
            return self
        return SearchRequest(**{**self.__dict__, "limit": config.default_limit})


def in_scope(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """The chunks a request may see; ``auto`` and ``all`` see everything without a path or subproject."""
    out = chunks.filter(vector.level_filter(list(request.levels)))
    if request.scope != "all" and request.path_prefix:
        out = out.filter(paths.has_prefix(F.col("path"), request.path_prefix))
    if request.scope != "all" and request.subproject:
        out = out.filter(F.col("subproject") == request.subproject)
    return out


def vector_list(chunks: DataFrame, request: SearchRequest, limit: int, mode: str) -> DataFrame:
    hits = vector.knn(chunks.select("chunk_id", "embedding"), request.vector, limit)
    hits = hits.withColumn("score", F.round(similarity(F.col("distance"), mode), 6))
    return fusion.ranked(hits, "score").select("chunk_id", "score", "rank")


def keyword_list(index: Index, request: SearchRequest, limit: int, within: DataFrame | None = None) -> DataFrame:
    """Empty where the query has no terms, so that the vector list alone decides."""
    hits = postings.search(index, text.preprocess(request.query).fts, limit, within)
    return fusion.ranked(hits, "score")


def retrieve(chunks: DataFrame, request: SearchRequest, limit: int, config: Config, index: Index) -> DataFrame:
    """Fused candidates of a hybrid search; each side fetches twice the limit."""
    seen = in_scope(chunks, request)
    near = vector_list(seen.filter("embedding is not null"), request, 2 * limit, "hybrid")
    if not (request.hybrid and config.hybrid.enabled):
        return fusion.vector_only(near, limit)
    scoped = request.levels or (request.scope != "all" and (request.path_prefix or request.subproject))
    words = keyword_list(index, request, 2 * limit, seen if scoped else None)
    return fusion.rrf(near, words, limit, config.hybrid.rrf_k)


def search(chunks: DataFrame, request: SearchRequest, now: Column, config: Config | None = None, index: Index | None = None) -> DataFrame:
    """Results of a request over chunks (chunk_id, path, level, name, content, modified_at, embedding, ...).

    ``hybrid`` fuses, re-ranks and explains; ``service`` filters, takes the nearest and
    collapses splits; ``daemon`` takes the nearest and filters those. Chunks without a vector
    are found by keywords only. Without an index, the chunks are tokenized anew.
    """
    config = config or Config()
    request = request.checked(config)
    about = chunks.drop("embedding")
    if request.mode == "daemon":
        hits = vector.knn_postfiltered(chunks.filter("embedding is not null"), request.vector, request.limit, list(request.levels), request.path_prefix)
        hits = hits.withColumn("score", F.round(similarity(F.col("distance"), "daemon"), 7))
        return hits.orderBy(F.desc("score"), "chunk_id")
    if request.mode == "service":
        hits = vector.knn(in_scope(chunks, request).filter("embedding is not null"), request.vector, request.limit)
        hits = hits.withColumn("score", F.round(similarity(F.col("distance"), "service"), 6))
        if "parent_chunk_id" not in hits.columns:
            hits = hits.withColumn("parent_chunk_id", F.lit(""))
        return splits.collapse_splits(hits).limit(request.limit)

    pool = max(request.limit, config.rerank.candidates)
    index = index or postings.Unstored(keyword.tokenized(chunks))
    # at most ``pool`` rows, so the chunks are read past a broadcast of their ids
    found = about.join(F.broadcast(retrieve(chunks, request, pool, config, index)), "chunk_id")
    found = found.withColumn("base_score", F.col("rrf_score")).withColumn("chunk_type", F.col("level"))
    if request.rerank and config.rerank.enabled:
        found = rerank.rerank(found, request.query, now)
    else:
        found = found.withColumns(rerank.signals(request.query, now)).withColumn("final_score", F.col("base_score"))
    signals = {s: F.col(s) for s in scoring.SIGNALS}
    reasons = display.match_reasons(request.query, F.col("match_source"), F.col("name"), F.col("path"), F.col("content"), signals)
    return found.withColumn("match_reasons", reasons).orderBy(F.desc("final_score"), "chunk_id").limit(request.limit)


def with_parents(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds parent_name and parent_level by ``parent_id``; few results, so the chunks are read past their broadcast."""
    if "parent_id" not in results.columns:
        return results
    order = [F.desc(c) for c in ("final_score", "score") if c in results.columns][:1]
    wanted = F.broadcast(results.select("parent_id").distinct())
    up = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("level").alias("parent_level")).join(wanted, "parent_id", "left_semi")
    return results.join(F.broadcast(up), "parent_id", "left").orderBy(*order, "chunk_id")


def requests(lines: DataFrame, *keys: str) -> DataFrame:
    """A table of JSON requests (value) as columns beside ``keys``; fields that don't parse are null, unknown ones are dropped."""
    kinds = "query string, limit int, levels array<string>, path_prefix string, scope struct<mode: string, value: string>, hybrid_enabled boolean, rerank_enabled boolean"
    out = lines.select(*keys, F.from_json("value", kinds).alias("r")).select(*keys, "r.*")
    return out.withColumn("error", F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "QUERY_EMPTY"))
