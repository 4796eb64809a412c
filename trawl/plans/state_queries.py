"""Index maintenance, subprojects, change capture and status queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import metrics, scan, store, subprojects
from trawl.plans.registry import query
from trawl.session import table
from trawl.sources.corpus import CORPUS_SQL, corpus
from trawl.streaming import changes

_OPS = {"click": "modify", "view": "modify", "purchase": "create", "signup": "rename", "logout": "delete"}
_OP_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _OPS.items()) + " else 'modify' end"
_EVENTS = f"ev as (select event_id, 'f' || user_id as path, {_OP_SQL} as op, ts from events)"
GAP_HOURS = 1


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _OPS.items() for x in kv]), "event_type"), F.lit("modify"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), "ts")


@query(f"with {_EVENTS} select path, op, event_id from (select *, row_number() over (partition by path order by ts desc, event_id desc) as r from ev) where r = 1")
def upsert_latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_events(spark, sf_dir), ["path"], ["ts", "event_id"]).select("path", "op", "event_id")


_GONE = "gone as (select path from corpus where doc_id % 3 = 0)"


@query(f"""with {CORPUS_SQL}, {_GONE}, left_ as (select * from corpus where path not in (select path from gone))
select 'files' as kind, count(*) as n from left_ union all select 'chunks', count(*) from left_
union all select 'embeddings', count(*) from embeddings e join left_ on e.vec_id = left_.doc_id""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).join(rows.select("doc_id", "chunk_id"), "doc_id")
    parts = store.delete_cascade(rows.select("path"), rows.select("chunk_id", "path"), vectors.select("chunk_id"), rows.filter("doc_id % 3 = 0"))
    counted = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("files", "chunks", "embeddings"), parts, strict=True)]
    return counted[0].union(counted[1]).union(counted[2])


@query("""with n as (select doc_id, source from documents where doc_id % 5 = 0), o as (select doc_id, lang as source from documents where doc_id % 2 = 0)
select doc_id, source from o where doc_id not in (select doc_id from n) union all select doc_id, source from n""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("source"))
    return store.upsert(old, docs.filter("doc_id % 5 = 0").select("doc_id", "source"), ["doc_id"])


@query("""with d as (select 'f' || doc_id as path, n_chars as at from documents where doc_id % 10 <> 9),
i as (select 'f' || doc_id as path, n_chars - case when doc_id % 4 = 0 then 1 else 0 end as at from documents where doc_id % 10 <> 8)
select * from (select coalesce(d.path, i.path) as path, case when i.path is null then 'added' when d.path is null then 'deleted' when d.at > i.at then 'modified' end as change from d full join i on d.path = i.path) where change is not null""")
def startup_scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("modified_at"))
    disk = rows.filter("doc_id % 10 <> 9")
    index = rows.filter("doc_id % 10 <> 8").withColumn("modified_at", F.col("modified_at") - F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0))
    return scan.scan_diff(disk, index)


_SUBS = [("root", "."), ("one", "src/src1"), ("tests-one", "src/src1/tests"), ("three", "src/src3")]
_SUBS_SQL = "subs(id, path) as (values " + ", ".join(f"('{i}', '{p}')" for i, p in _SUBS) + ")"


@query(f"""with {CORPUS_SQL}, {_SUBS_SQL}, m as (select c.path, s.id, s.path as sp, row_number() over (partition by c.path order by case when s.path = '.' then 0 else length(s.path) end desc) as r
from (select distinct path from corpus) c left join subs s on s.path = '.' or c.path = s.path or starts_with(c.path, s.path || '/'))
select path, id as subproject_id, sp as subproject_path from m where r = 1""")
def subproject_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subprojects.assign(corpus(spark, sf_dir), spark.createDataFrame(_SUBS, "id string, path string"))


_MARKED = """f as (select 'apps/S_' || source || '/d.' || doc_id % 700 || '/' || case doc_id % 6 when 0 then 'go.mod' when 1 then 'package.json' when 2 then 'x.csproj' when 3 then 'readme.md' when 4 then 'setup.py' else 'node_modules/pom.xml' end as path from documents)"""


@query(f"""with {_MARKED}, p as (select regexp_replace(path, '/[^/]*$', '') as dir, regexp_extract(path, '[^/]*$') as m from f),
k as (select *, case when ends_with(m, '.csproj') or m in ('go.mod', 'pom.xml') then 2 when m in ('package.json', 'setup.py') then 3 end as pr from p where not contains(dir, 'node_modules')),
b as (select dir, min(row(pr, m)) as x from k where pr is not null group by dir)
select regexp_replace(lower(regexp_extract(dir, '[^/]*$')), '[^a-z0-9-]', '-', 'g') as id, dir as path, x[2] as marker_file,
case when x[2] = 'go.mod' then 'go' when x[2] = 'package.json' then 'javascript' when x[2] = 'setup.py' then 'python' else 'csharp' end as language_hint from b""")
def subproject_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("go.mod", "package.json", "x.csproj", "readme.md", "setup.py", "node_modules/pom.xml")])
    rows = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("apps/S_"), "source", F.lit("/d."), (F.col("doc_id") % 700).cast("string"), F.lit("/"), F.get(names, (F.col("doc_id") % 6).cast("int")))
    return subprojects.detect(rows.select(path.alias("path")))


_DECLARED = [("api", "src/src1", "The API"), ("", "src/src2", ""), ("web", "extra/web.app", "Web"), ("", "extra/x.y", "")]
_DECLARED_SQL = "decl(id, path, name) as (values " + ", ".join(f"('{i}', '{p}', '{n}')" for i, p, n in _DECLARED) + ")"
_DETECTED_SQL = "det as (select distinct source as id, 'src/' || source as path, 'go.mod' as marker, 'go' as hint from documents)"
_MERGED_SQL = f"""{_DETECTED_SQL}, {_DECLARED_SQL}, merged as (select coalesce(nullif(c.id, ''), d.id, regexp_replace(coalesce(c.path, d.path), '[/\\.]', '-', 'g')) as id, coalesce(c.path, d.path) as path,
coalesce(nullif(c.name, ''), '') as name, coalesce(marker, '') as marker_file, coalesce(hint, '') as language_hint, c.path is null as auto_detected from det d full join decl c on d.path = c.path)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("source").distinct()
    found = found.select(F.col("source").alias("id"), F.concat(F.lit("src/"), "source").alias("path"), F.lit("go.mod").alias("marker_file"), F.lit("go").alias("language_hint"))
    return subprojects.merge_overrides(found, spark.createDataFrame(_DECLARED, "id string, path string, name string"))


@query(f"with {_MERGED_SQL} select * from merged")
def config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"""with {_MERGED_SQL}, ex(id, auto) as (values ('src3', true), ('old-auto', true), ('old-declared', false), ('web', false))
select coalesce(ex.id, m.id) as id, case when ex.id is null then 'added' when m.id is not null then 'unchanged' when auto then 'removed' else 'kept' end as change from ex full join merged m on ex.id = m.id""")
def subproject_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("src3", True), ("old-auto", True), ("old-declared", False), ("web", False)]
    return subprojects.sync(spark.createDataFrame(rows, "id string, auto_detected boolean"), _merged(spark, sf_dir))


# --- change capture ------------------------------------------------------------------------

_BURSTS = f"""{_EVENTS}, g as (select *, case when lag(ts) over (partition by path order by ts) + interval {GAP_HOURS} hour > ts then 0 else 1 end as new from ev),
s as (select *, sum(new) over (partition by path order by ts rows unbounded preceding) as b from g),
burst as (select path, case when arg_min(op, ts) <> 'modify' then arg_min(op, ts) else coalesce(arg_min(op, ts) filter (where op <> 'modify'), 'modify') end as op,
    min(ts) as started, max(ts) + interval {GAP_HOURS} hour as ended, count(*) as n_events from s group by path, b)"""


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.debounce(_events(spark, sf_dir), f"{GAP_HOURS} hours")


@query(f"with {_BURSTS} select path, started, ended, n_events from burst")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    naive = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")]
    return _bursts(spark, sf_dir).select("path", *naive, "n_events")


@query(f"with {_BURSTS} select path, started, op from burst")
def op_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(spark, sf_dir).select("path", F.col("started").cast("timestamp_ntz").alias("started"), "op")


@query(f"with {_BURSTS} select path, case when arg_max(op, ended) in ('create', 'modify') then 'index' else 'delete' end as action from burst group by path")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.plan_changes(_bursts(spark, sf_dir))


@query("""with b as (select user_id, event_id as seq, (event_id % 9)::int as chunks, (event_id % 4)::double / 2 as seconds from events),
t as (select *, case when chunks > 0 and seconds > 0 then 1 else 0 end as ok from b),
n as (select *, sum(ok) over (partition by user_id order by seq rows unbounded preceding) as k, sum(chunks) over (partition by user_id order by seq rows unbounded preceding) as completed from t),
r as (select *, sum(case when ok = 1 then chunks end) over w as c, sum(case when ok = 1 then seconds end) over w as s from n window w as (partition by user_id order by k range between 9 preceding and current row))
select user_id, seq, completed::bigint as completed, round(completed / 2.0, 6) as percent, round(case when s > 0 then c / s else 0 end, 6) as rate,
case when k >= 2 and 200 - completed > 0 and c / s > 0 then floor((200 - completed) / (c / s))::bigint else 0 end as eta_seconds from r""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    batches = e.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 9).cast("int").alias("chunks"), (F.col("event_id") % 4 / 2).alias("seconds"))
    out = metrics.index_progress(batches, F.lit(200), ["user_id"])
    return out.select("user_id", "seq", "completed", F.round("percent", 6).alias("percent"), F.round("rate", 6).alias("rate"), "eta_seconds")


@query("""select 'documents' as name, count(*) as n, max(doc_id) as top from documents union all select 'embeddings', count(*), max(vec_id) from embeddings
union all select 'events', count(*), max(event_id) from events union all select 'labels', count(*), coalesce(max(doc_id), 0) from labels""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "labels": "doc_id"}
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.coalesce(F.max(k), F.lit(0)).alias("top")).select(F.lit(t).alias("name"), "n", "top") for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""with v as (select distinct sha256(text) as h from documents where doc_id % 2 = 0), r as (select sha256(text) as h from documents)
select count(*) as requests, count(v.h) as hits, count(*) - count(v.h) as misses from r left join v on r.h = v.h""")
def embed_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return store.cache_metrics(hashed, hashed.filter("doc_id % 2 = 0"))
