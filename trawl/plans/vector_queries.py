"""Vector search, fusion, re-ranking and presentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import display, scoring, vectors
from trawl.functions.text import preprocess
from trawl.operators import fusion, postings, rerank, splits, vector
from trawl.plans.registry import query
from trawl.plans.search import SearchRequest, search
from trawl.session import table
from trawl.sources.corpus import CORPUS_SQL, NOW, corpus, embedded, keyword_index, query_vector

K, QUERY = 10, "the handler and update tion"
_Q = "q as (select embedding::double[] as qv from embeddings where vec_id = 7)"
_EMB = "emb as (select c.*, e.embedding::double[] as ev from corpus c join embeddings e on e.vec_id = c.doc_id)"
_DIST = "round(list_distance(ev, qv), 6)"
_NEAR = f"near as (select * from (select emb.*, {_DIST} as distance from emb, q) order by distance, chunk_id limit {K})"


@query(f"with {CORPUS_SQL}, {_Q}, {_EMB}, {_NEAR} select chunk_id, path, distance, round(case when distance <= 0 then 1 else 1 / (1 + distance) end, 6) as score from near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn(embedded(spark, sf_dir), query_vector(spark, sf_dir, 7), K)
    return found.select("chunk_id", "path", "distance", F.round(vectors.similarity(F.col("distance")), 6).alias("score"))


@query("""with q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 100 = 0),
d as (select query_id, vec_id, round(list_distance(embedding::double[], qv), 6) as distance from embeddings, q),
r as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from d)
select query_id, vec_id, distance, rank from r where rank <= 10""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    asked = every.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn_many(every, asked, K, "vec_id").select("query_id", "vec_id", "distance", "rank")


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB} select chunk_id, level, path, {_DIST} as distance from emb, q
where level in ('class', 'method') and path ilike 'SRC/src1%' order by distance, chunk_id limit {K}""")
def vector_prefilter_level_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    found = vector.knn_prefiltered(rows, query_vector(spark, sf_dir, 7), K, ["class", "method"], "SRC/src1", rows.select("chunk_id"))
    return found.select("chunk_id", "level", "path", "distance")


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB}, {_NEAR} select chunk_id, level, distance, round(greatest(0, 1 - distance / 2), 7) as score
from near where level in ('class', 'method') and starts_with(path, 'src/')""")
def vector_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn_postfiltered(embedded(spark, sf_dir), query_vector(spark, sf_dir, 7), K, ["class", "method"], "src/")
    return found.select("chunk_id", "level", "distance", F.round(vectors.similarity(F.col("distance"), "daemon"), 7).alias("score"))


@query(f"""with {_Q}, d as (select vec_id, round(list_distance(embedding::double[], qv), 6) as d from embeddings, q)
select vec_id, round(case when d <= 0 then 1 else 1 / (1 + d) end, 8) as service, round(1 - d, 8) as hybrid, round(greatest(0, 1 - d / 2), 8) as daemon from d""")
def score_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector.with_distance(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir, 7))
    return rows.select("vec_id", *[F.round(vectors.similarity(F.col("distance"), m), 8).alias(m) for m in vectors.SCORE_MODES])


@query(f"""with {_Q}, e as (select vec_id, embedding::double[] as ev from embeddings)
select vec_id, round(list_cosine_similarity(ev, qv), 6) as cosine, round(list_inner_product(ev, qv), 6) as dot, round(sqrt(list_inner_product(ev, ev)), 6) as norm from e, q""")
def vector_cosine_dot_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = vectors.literal(query_vector(spark, sf_dir, 7)), F.col("embedding")
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(vectors.cosine(e, q), 6).alias("cosine"), F.round(vectors.dot(e, q), 6).alias("dot"), F.round(vectors.norm(e), 6).alias("norm"))


@query("""with d as (select doc_id, sha256(text) as h from documents),
r as (select doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(h, (2 * (i % 32) + 1)::int, 2))::int / 255.0 * 0.5 + i / 16.0 * 0.5) as raw from d)
select doc_id, list_transform(raw, lambda x: round(x / sqrt(list_inner_product(raw, raw)), 6)) as embedding from r""")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector_ = vectors.mock_embedding(F.col("text"), 16)
    return table(spark, sf_dir, "documents").select("doc_id", vector_.alias("v")).select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


# --- fusion --------------------------------------------------------------------------------

_TERMS = list(preprocess(QUERY).terms)
_TERM_LIST = ", ".join(f"'{t}'" for t in _TERMS)
_HITS = rf"""toks as (select chunk_id, list_concat(list_concat(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+')),
    regexp_extract_all(lower(path), '[\p{{L}}\p{{N}}]+')) as t from corpus),
stat as (select count(*) as n, avg(len(t)) as a from toks),
tf as (select chunk_id, len(t) as dl, q.term, len(list_filter(t, lambda x: x = q.term)) as tf from toks, (select unnest([{_TERM_LIST}]) as term) q),
df as (select term, count(*) as df from tf where tf > 0 group by term),
bm as (select chunk_id, round(sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from tf join df using (term), stat where tf > 0 group by chunk_id)"""


def _lists(limit: int) -> str:
    return f"""v as (select chunk_id, round(1 - distance, 6) as score from (select chunk_id, {_DIST} as distance from emb, q order by distance, chunk_id limit {2 * limit})),
vr as (select *, row_number() over (order by score desc, chunk_id) - 1 as rank from v),
kr as (select *, row_number() over (order by score desc, chunk_id) - 1 as rank from (select * from bm order by score desc, chunk_id limit {2 * limit})),
fused as (select coalesce(vr.chunk_id, kr.chunk_id) as chunk_id, coalesce(vr.score, 0) as vector_score, coalesce(kr.score, 0) as keyword_score,
    coalesce(vr.rank, -1)::int as vector_rank, coalesce(kr.rank, -1)::int as keyword_rank,
    round(case when vr.rank is null then 0 else 1.0 / (60 + vr.rank + 1) end + case when kr.rank is null then 0 else 1.0 / (60 + kr.rank + 1) end, 9) as rrf_score,
    case when vr.rank is not null and kr.rank is not null then 'both' when vr.rank is not null then 'vector' else 'keyword' end as match_source
    from vr full join kr on vr.chunk_id = kr.chunk_id),
top as (select * from fused order by rrf_score desc, chunk_id limit {limit})"""


def _request(spark: SparkSession, sf_dir: str, **options) -> SearchRequest:
    return SearchRequest(QUERY, query_vector(spark, sf_dir, 7), K, **options)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpus rows, with a vector where there is one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return corpus(spark, sf_dir).join(e, "doc_id", "left")


def _two_lists(spark: SparkSession, sf_dir: str, limit: int) -> tuple[DataFrame, DataFrame]:
    rows = _chunks(spark, sf_dir)
    near = vector.knn(rows.filter("embedding is not null").select("chunk_id", "embedding"), query_vector(spark, sf_dir, 7), 2 * limit)
    near = fusion.ranked(near.withColumn("score", F.round(vectors.similarity(F.col("distance"), "hybrid"), 6)), "score")
    words = postings.search(keyword_index(spark, sf_dir), preprocess(QUERY).fts, 2 * limit)
    return near, fusion.ranked(words, "score")


@query(f"with {CORPUS_SQL}, {_Q}, {_EMB}, {_HITS}, {_lists(K)} select * from top")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_two_lists(spark, sf_dir, K), K)


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB}, {_HITS}, {_lists(K)} select chunk_id, score as vector_score, 0.0::double as keyword_score, rank::int as vector_rank, -1 as keyword_rank,
score as rrf_score, 'vector' as match_source from vr order by score desc, chunk_id limit {K}""")
def rrf_vector_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.vector_only(_two_lists(spark, sf_dir, K)[0], K)


@query(f"with {CORPUS_SQL}, {_Q}, {_EMB}, {_HITS}, {_lists(50)} select match_source, count(*) as n from fused group by match_source")
def match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_two_lists(spark, sf_dir, 50), 200).groupBy("match_source").agg(F.count("*").alias("n"))


# --- re-ranking ----------------------------------------------------------------------------

_R_TERMS = ["the", "handler", "and", "update", "tion"]


def _count(column: str, step: float, most: float) -> str:
    return f"least({most}, ({' + '.join(f'contains(lower({column}), {chr(39)}{t}{chr(39)})::int' for t in _R_TERMS)}) * {step})"


def _any_of(column: str, parts: list[str]) -> str:
    return " or ".join(f"contains(lower({column}), '{p}')" for p in parts)


_SIGNALS = f"""{_count('name', 0.1, 0.2)}::double as name_match, case when contains(lower(content), '{QUERY}') then 0.15::double else 0 end as exact_phrase,
    {_count('path', 0.075, 0.15)}::double as path_match,
    case when {_any_of('path', scoring.TEST_PARTS + scoring.TEST_DIRS[:2])} or starts_with(path, 'test/') or starts_with(path, 'tests/') then -0.15::double
         when {_any_of('path', scoring.MOCK_PARTS)} then -0.1 else 0 end as test_penalty,
    case when modified_at > timestamp '{NOW}' then 0::double when epoch(timestamp '{NOW}') - epoch(modified_at) < 86400 then 0.1
         when epoch(timestamp '{NOW}') - epoch(modified_at) < 604800 then 0.05 when epoch(timestamp '{NOW}') - epoch(modified_at) < 2592000 then 0.02 else 0 end as recency,
    case when level in ('class', 'struct', 'type') then 0.05::double else 0 end as chunk_type"""
_TOTAL = "(name_match + exact_phrase + path_match + test_penalty + recency + chunk_type)"


@query(f"with {CORPUS_SQL} select chunk_id, {', '.join(f'round({s}, 6) as {s}' for s in scoring.SIGNALS)} from (select chunk_id, {_SIGNALS} from corpus)")
def rerank_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("chunk_type", F.col("level"))
    out = rerank.with_signals(rows, QUERY, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("chunk_id", *[F.round(s, 6).alias(s) for s in scoring.SIGNALS])


@query(f"""with {CORPUS_SQL}, s as (select chunk_id, (doc_id % 97) / 97.0::double as base, {_SIGNALS} from corpus)
select chunk_id, round(base, 6) as base_score, round(base * 0.7 + base * 0.3 * (1 + {_TOTAL}), 6) as final_score from s order by round(base * 0.7 + base * 0.3 * (1 + {_TOTAL}), 9) desc, chunk_id limit 100""")
def rerank_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("chunk_type", F.col("level")).withColumn("base_score", F.col("doc_id") % 97 / 97.0)
    out = rerank.rerank(rows, QUERY, F.lit(NOW).cast("timestamp_ntz")).limit(100)
    return out.select("chunk_id", F.round("base_score", 6).alias("base_score"), F.round("final_score", 6).alias("final_score"))


_REASONS = f"""list_slice(list_filter([case when match_source in ('vector', 'both') then 'semantic similarity' end, case when match_source in ('keyword', 'both') then 'keyword match via BM25' end,
    case {' '.join(f"when contains(lower(name), '{t}') then 'contains ''{t}'' in name'" for t in _R_TERMS)} end,
    case {' '.join(f"when contains(lower(path), '{t}') then 'file path contains ''{t}'''" for t in _R_TERMS)} end,
    case when contains(lower(content), '{QUERY}') then 'exact phrase match' end,
    case when name_match > 0.05 then 'name relevance boost' end, case when exact_phrase > 0.05 then 'exact phrase boost' end, case when path_match > 0.05 then 'path relevance boost' end,
    case when recency > 0.05 then 'recently modified' end, case when chunk_type > 0.05 then 'chunk type relevance' end], lambda x: x is not null), 1, 5)"""


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB}, {_HITS}, {_lists(20)},
s as (select top.*, c.path, c.name, c.content, c.level, {_SIGNALS} from top join corpus c using (chunk_id)),
f as (select *, round(rrf_score * 0.7 + rrf_score * 0.3 * (1 + {_TOTAL}), 9) as final_score from s)
select chunk_id, path, match_source, rrf_score, final_score, array_to_string({_REASONS}, '; ') as match_reasons from f order by final_score desc, chunk_id limit {K}""")
def hybrid_reranked_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: scope, both retrieval arms, fusion, re-ranking, reasons, in one plan."""
    now = F.lit(NOW).cast("timestamp_ntz")
    out = search(_chunks(spark, sf_dir), _request(spark, sf_dir), now, index=keyword_index(spark, sf_dir))
    return out.select("chunk_id", "path", "match_source", "rrf_score", "final_score", F.array_join("match_reasons", "; ").alias("match_reasons"))


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB}, {_NEAR} select chunk_id, round(greatest(0, 1 - distance / 2), 7) as score from near where level in ('method')""")
def search_daemon_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_chunks(spark, sf_dir), _request(spark, sf_dir, mode="daemon", levels=("method",)), F.current_timestamp()).select("chunk_id", "score")


@query(f"""with {CORPUS_SQL}, {_Q}, {_EMB} select chunk_id, round(case when d <= 0 then 1 else 1 / (1 + d) end, 6) as score
from (select chunk_id, {_DIST} as d from emb, q where path like 'src/src3/%' order by d, chunk_id limit {K})""")
def search_service_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = _request(spark, sf_dir, mode="service", path_prefix="src/src3")
    return search(_chunks(spark, sf_dir), request, F.current_timestamp()).select("chunk_id", "score")


# --- splits, parents, presentation ---------------------------------------------------------


@query(f"""with {CORPUS_SQL}, h as (select chunk_id, case when doc_id % 4 = 3 then '' else 'p' || doc_id // 4 end as parent, round((doc_id % 89) / 100.0, 6)::double as score from corpus),
r as (select *, row_number() over (partition by g order by score desc, chunk_id) as r, count(*) over (partition by g) as n from (select *, coalesce(nullif(parent, ''), chunk_id) as g from h))
select chunk_id, round(case when n <= 1 then score else least(1, score * least(1.5, 1 + 0.1 * (n - 1))) end, 6) as score, case when n > 1 then n when parent = '' then 0 else 1 end as matched_splits from r where r = 1""")
def split_dedup_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")))
    hits = corpus(spark, sf_dir).select("chunk_id", part.alias("parent_chunk_id"), F.round(F.col("doc_id") % 89 / 100, 6).alias("score"))
    return splits.collapse_splits(hits).select("chunk_id", F.round("score", 6).alias("score"), "matched_splits")


@query(f"""with {CORPUS_SQL} select c.chunk_id, c.level, p.chunk_id as parent_id, p.name as parent_name from corpus c
left join corpus p on p.doc_id = c.doc_id - c.doc_id % 3 and c.level <> 'file'""")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    up = rows.select(F.col("doc_id").alias("up"), F.col("chunk_id").alias("parent_id"), F.col("name").alias("parent_name"))
    own = F.when(F.col("level") != "file", F.col("doc_id") - F.col("doc_id") % 3)
    return rows.withColumn("own", own).join(up, F.col("own") == F.col("up"), "left").select("chunk_id", "level", "parent_id", "parent_name")


@query(f"""with {CORPUS_SQL}, s as (select *, case when doc_id % 2 = 0 then 'both' else 'keyword' end as match_source, {_SIGNALS} from corpus)
select chunk_id, array_to_string({_REASONS}, '; ') as reasons from s""")
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("chunk_type", F.col("level"))
    rows = rerank.with_signals(rows, QUERY, F.lit(NOW).cast("timestamp_ntz"))
    source = F.when(F.col("doc_id") % 2 == 0, "both").otherwise("keyword")
    found = display.match_reasons(QUERY, source, F.col("name"), F.col("path"), F.col("content"), {s: F.col(s) for s in scoring.SIGNALS})
    return rows.select("chunk_id", F.array_join(found, "; ").alias("reasons"))


_FLAT = "trim(regexp_replace(regexp_replace(content, '[\n\t]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""with {CORPUS_SQL} select chunk_id, case when length({_FLAT}) <= 120 then {_FLAT} else substr({_FLAT}, 1, 117) || '...' end as preview,
printf('[%d] %s:%d-%d (%s) %s [%.3f]', doc_id + 1, path, start_line, end_line, level, name, (doc_id % 8) / 8.0::double) as line from corpus""")
def format_compact_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    line = display.compact_line(c("doc_id") + 1, c("path"), c("start_line"), c("end_line"), c("level"), c("name"), (c("doc_id") % 8 / 8).cast("double"))
    return corpus(spark, sf_dir).select("chunk_id", display.preview(c("content")).alias("preview"), line.alias("line"))
