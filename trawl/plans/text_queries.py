"""Keyword search, token estimates and metrics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text
from trawl.operators import keyword, metrics, postings
from trawl.plans.registry import query
from trawl.session import table
from trawl.sources.corpus import CORPUS_SQL, corpus, keyword_index
from trawl.sources.folders import shared_folder

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_FIELDS = {"content": "content", "name": "name", "path": "path"}


def _tokens(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


_TOKS = f"toks as (select chunk_id, list_concat(list_concat({_tokens('content')}, {_tokens('name')}), {_tokens('path')}) as t from corpus)"


@query(rf"""with w as (select item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: x not in ({_STOP}) and (octet_length(encode(x)) > 1 or regexp_matches(x, '^\p{{Nd}}$'))) as t from benchmark)
select item_id, array_to_string(t, ' ') as terms, array_to_string(t, ' OR ') as fts, len(t)::int as n_terms from w""")
def query_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text.query_terms(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", terms.alias("t"), text.fts_query(F.col("text")).alias("fts"))
    return rows.select("item_id", F.array_join("t", " ").alias("terms"), "fts", F.size("t").alias("n_terms"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(text, '--|/\*|\*/|[{}\[\]^~@#$%&;()]', ' ', 'g'), ' +', ' ', 'g')) as clean from documents""")
def fts_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text")).alias("clean"))


@query(f"""with {CORPUS_SQL}, p as (select 'content' as field, unnest({_tokens('content')}) as term from corpus union all select 'name', unnest({_tokens('name')}) from corpus
union all select 'path', unnest({_tokens('path')}) from corpus) select field, term, count(*) as n from p group by field, term""")
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(keyword_index(spark, sf_dir))


@query(f"with {CORPUS_SQL}, {_TOKS} select chunk_id, len(t) as n_tokens from toks")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.doc_lengths(keyword.tokenized(corpus(spark, sf_dir), stemmed=False))


def _bm25(queries: str) -> str:
    return f"""with {CORPUS_SQL}, {_TOKS}, stat as (select count(*) as n, avg(len(t)) as a from toks),
x as (select chunk_id, len(t) as dl, unnest(t) as term from toks), tf as (select chunk_id, dl, term, count(*) as tf from x group by all),
df as (select term, count(*) as df from tf group by term), {queries},
s as (select query_id, chunk_id, round(sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from wanted join tf using (term) join df using (term), stat group by query_id, chunk_id)
select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) where rank <= 20"""


@query(_bm25("wanted as (select 0 as query_id, unnest(['handler', 'erst', 'thing', 'para']) as term)"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search_batch(keyword_index(spark, sf_dir), [(0, ["handler", "erst", "thing", "para"])], 20)


@query(_bm25(f"wanted as (select distinct item_id as query_id, unnest(list_filter({_tokens('text')}, lambda x: x not in ({_STOP}))) as term from benchmark)"))
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(text.search_tokens(F.col("text")), lambda t: ~t.isin(text.STOPWORDS))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return postings.search_batch(keyword_index(spark, sf_dir), asked, 20)


_CHANGED = """changed as (select chunk_id, case when doc_id % 5 = 0 then content || ' ' || content || ' freshly indexed' else content end as content, name, path, doc_id from corpus where doc_id % 7 <> 3)"""
_CHANGED_TERMS = f"""select field, term, count(*) as n from (select 'content' as field, unnest({_tokens('content')}) as term from changed union all select 'name', unnest({_tokens('name')}) from changed
union all select 'path', unnest({_tokens('path')}) from changed) group by field, term"""


def _term_counts(index: postings.KeywordIndex) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n")) for f in keyword.FIELDS])
    return index.every().select("term", F.explode(each).alias("x")).filter("x.n > 0").groupBy("x.field", "term").agg(F.sum("x.n").alias("n"))


def _changed_index(spark: SparkSession, sf_dir: str) -> postings.KeywordIndex:
    """Two of three rows inserted first, the rest added; then a fifth replaced and a seventh removed."""
    rows = corpus(spark, sf_dir).select("chunk_id", "content", "name", "path", "doc_id")
    index = postings.KeywordIndex(spark, f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}", stemmed=False)
    index.rebuild(rows.filter("doc_id % 3 <> 1"))
    index.add(rows.filter("doc_id % 3 = 1"))
    index.add(rows.filter("doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" "), "content", F.lit(" freshly indexed"))))
    index.remove(rows.filter("doc_id % 7 = 3"))
    return index


@query(f"with {CORPUS_SQL}, {_CHANGED} {_CHANGED_TERMS}")
def fts_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, replaced and removed chunks, read through segments and tombstones."""
    return _term_counts(_changed_index(spark, sf_dir))


@query(f"with {CORPUS_SQL}, {_CHANGED} {_CHANGED_TERMS}")
def fts_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after its segments were merged."""
    index = _changed_index(spark, sf_dir)
    index.compact()
    return _term_counts(index)


def _found(condition: str) -> str:
    return f"with {CORPUS_SQL}, t as (select chunk_id, {_tokens('content')} as c, {_tokens('name')} as n, {_tokens('path')} as p from corpus) select chunk_id from t where {condition}"


def _match(spark: SparkSession, sf_dir: str, raw: str) -> DataFrame:
    return postings.search(keyword_index(spark, sf_dir), raw, 1 << 30).select("chunk_id")


_PHRASE = "len(list_filter(range(1, len({0})), lambda i: {0}[i::int] = 'of' and {0}[(i + 1)::int] = 'the')) > 0"


@query(_found(" or ".join(_PHRASE.format(f) for f in "cnp")))
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, '"of the"')


@query(_found(" or ".join(f"len(list_filter({f}, lambda x: starts_with(x, 'handl') or starts_with(x, 'erst'))) > 0" for f in "cnp")))
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "handl* OR erst*")


def _has(word: str) -> str:
    return "(" + " or ".join(f"list_contains({f}, '{word}')" for f in "cnp") + ")"


@query(_found(f"{_has('the')} and {_has('and')} and not {_has('with')} or {_has('para')}"))
def bool_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "the AND and NOT with OR para")


@query(_found("list_contains(p, 'src3') and list_contains(n, 'the')"))
def field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "path:src3 name:the")


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems aren't expressible in DuckDB; tests compare with SQLite's full-text search."""
    return postings.search(keyword_index(spark, sf_dir, stemmed=True), "things OR handling OR connected", 50)


@query("select doc_id, floor(octet_length(encode(text)) / 3.5)::bigint as tokens, floor(floor(octet_length(encode(text)) / 3.5) * 3.2)::bigint as safe_chars from documents")
def tokens_embed_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.embedding_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), text.max_chars_for_tokens(n).alias("safe_chars"))


_METRIC = r"(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')) + len(regexp_extract_all({0}, '[\p{{P}}\p{{S}}]')) // 2)::bigint"


@query(f"select doc_id, {_METRIC.format('text')} as tokens from documents")
def tokens_metric_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.metric_tokens(F.col("text")).alias("tokens"))


@query(f"""with {CORPUS_SQL}, m as (select count(*) as result_count, sum({_METRIC.format('content')})::bigint as total_tokens, sum(end_line - start_line + 1)::bigint as total_lines from corpus where level = 'method')
select *, 5000000000::bigint as baseline_tokens, greatest(0, 5000000000 - total_tokens)::bigint as tokens_saved, round(greatest(0, 5000000000 - total_tokens) / 5000000000.0 * 100, 6) as percent_saved from m""")
def search_metrics_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.search_metrics(corpus(spark, sf_dir).filter("level = 'method'"))
    saved = metrics.savings(F.col("total_tokens"), 5_000_000, 100)
    return out.withColumns(saved).withColumn("percent_saved", F.round("percent_saved", 6))
