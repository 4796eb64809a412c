"""Paths, events, stored tables and presentation: queries over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import display, paths
from trawl.operators import store
from trawl.plans.registry import query
from trawl.plans.search import requests
from trawl.session import table
from trawl.sources import embedders
from trawl.sources.corpus import CORPUS_SQL, corpus
from trawl.sources.folders import shared_folder
from trawl.streaming import changes


def _store(spark: SparkSession) -> store.IndexStore:
    return store.IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=16)


@query("select doc_id, n_chars > 0 and n_chars <= 5000 as readable from documents")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", paths.readable_size(F.col("n_chars"), 5000).alias("readable"))


@query(rf"""with {CORPUS_SQL}, r as (select doc_id, './' || replace(path, '/', '\') || '//' as raw, path from corpus)
select doc_id, path as normal, regexp_extract(path, '[^/]*$') as base, regexp_replace(path, '/[^/]*$', '') as dir, regexp_extract(path, '\.[^.]*$') as ext from r""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("./"), F.translate("path", "/", "\\"), F.lit("//"))
    rows = corpus(spark, sf_dir).select("doc_id", paths.normalize(raw).alias("normal"))
    path = F.col("normal")
    return rows.select("doc_id", "normal", paths.base_name(path).alias("base"), paths.directory(path).alias("dir"), paths.extension(path).alias("ext"))


@query(f"""with {CORPUS_SQL} select path, starts_with(path, 'src/src1/') as below, path = 'src/src1' or starts_with(path, 'src/src1/tests/') as deeper,
starts_with(path, 'src/') as scoped, path ilike 'SRC/src1%' as alike from corpus""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    inside = lambda p: paths.contains_path(F.lit(p), path)
    deeper = paths.has_prefix(path, "src/src1/tests") | (path == "src/src1")
    return corpus(spark, sf_dir).select("path", inside("src/src1").alias("below"), deeper.alias("deeper"), (inside("src") & inside(".")).alias("scoped"), paths.like_prefix(path, "SRC/src1").alias("alike"))


@query("""with e as (select event_id, (event_id * 37) % 20000 as s from events) select event_id, case when s = 0 then 'Calculating...' when s < 60 then s || 's'
when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' else (s // 3600) || 'h ' || (s // 60 % 60) || 'm' end as eta from e""")
def eta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", display.eta_text((F.col("event_id") * 37) % 20000).alias("eta"))


_RAW = ("CREATE", "WRITE", "REMOVE", "RENAME", "CHMOD", "CREATE|WRITE", "NOTHING")


@query(f"""with e as (select event_id, user_id, [{", ".join(f"'{r}'" for r in _RAW)}][(event_id % 7 + 1)::int] as raw from events),
p as (select event_id, case when user_id % 3 = 0 then 'node_modules/' else 'src/' end || 'f' || user_id || case when user_id % 4 = 0 then '.log' else '.py' end as path, event_id % 11 = 0 as is_directory,
    case when raw like '%CREATE%' then 'create' when raw = 'REMOVE' then 'delete' when raw = 'RENAME' then 'rename' when raw in ('WRITE', 'CHMOD') then 'modify' end as op from e)
select event_id, path, op from p where not is_directory and not starts_with(path, 'node_modules/') and not ends_with(path, '.log')""")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flags as operations; ignored paths and directories go."""
    raw = F.get(F.array(*[F.lit(r) for r in _RAW]), (F.col("event_id") % 7).cast("int"))
    path = F.concat(F.when(F.col("user_id") % 3 == 0, "node_modules/").otherwise("src/"), F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 4 == 0, ".log").otherwise(".py"))
    rows = table(spark, sf_dir, "events").select("event_id", path.alias("path"), (F.col("event_id") % 11 == 0).alias("is_directory"), changes.operation(raw).alias("op"))
    return changes.relevant(rows, paths.ignore_rules(["node_modules/", "*.log"])).select("event_id", "path", "op")


@query(f"""with {CORPUS_SQL}, f as (select path, sha256(content) as file_hash, octet_length(encode(content)) as size from corpus)
select c.chunk_id, c.level, f.path, f.file_hash, f.size from corpus c join f on c.path = f.path""")
def chunks_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    files = rows.select("path", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("size"))
    return rows.select("chunk_id", "level", "path").join(files, "path").select("chunk_id", "level", "path", "file_hash", "size")


@query(f"""with {CORPUS_SQL} select path, chunk_id, level from corpus where path in ('src/src1/doc_21.py', 'src/src3/doc_3.py', 'src/src2/tests/doc_10.py') or doc_id in (7, 77, 777)""")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the key's folders and by another column."""
    s, rows = _store(spark), corpus(spark, sf_dir).select("path", "chunk_id", "level", "doc_id")
    s.write("chunks", rows, by="path")
    found = s.lookup("chunks", ["src/src1/doc_21.py", "src/src3/doc_3.py", "src/src2/tests/doc_10.py"]).union(s.lookup("chunks", [7, 77, 777], "doc_id"))
    return found.distinct().select("path", "chunk_id", "level")


_INCREMENTAL = f"""{CORPUS_SQL}, now as (select path, case when doc_id % 5 = 0 then 'new ' || level else level end as level, doc_id % 5 = 0 as touched from corpus where doc_id % 7 <> 3 or doc_id % 5 = 0
union all select 'extra/' || doc_id || '.py', 'file', true from corpus where doc_id % 10 = 0)"""


@query(f"with {_INCREMENTAL} select path, level, touched from now")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed, new and deleted files through the folders of their paths."""
    s, rows = _store(spark), corpus(spark, sf_dir).select("path", "level", "doc_id")
    s.write("chunks", rows.drop("doc_id"), by="path")
    changed = rows.filter("doc_id % 5 = 0").select("path", F.concat(F.lit("new "), "level").alias("level"), F.lit(True).alias("touched"))
    added = rows.filter("doc_id % 10 = 0").select(F.concat(F.lit("extra/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("file").alias("level"), F.lit(True).alias("touched"))
    s.change("chunks", changed.union(added), rows.filter("doc_id % 5 = 0 or doc_id % 7 = 3").select("path"))
    return s.read("chunks").withColumn("touched", F.coalesce("touched", F.lit(False)))


@query("""with n as (select vec_id, list_transform(embedding::double[], lambda x: round(x * 10000)::int) as v from embeddings)
select vec_id, case when vec_id % 3 = 0 then list_reverse(v) else v end as embedding from n where vec_id % 4 <> 1 or vec_id % 3 = 0""")
def embeddings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 10000).cast("int")).alias("embedding"))
    s.write("embeddings", rows, by="vec_id")
    s.change("embeddings", rows.filter("vec_id % 3 = 0").withColumn("embedding", F.reverse("embedding")), rows.filter("vec_id % 3 = 0 or vec_id % 4 = 1").select("vec_id"))
    return s.read("embeddings")


@query("""with d as (select doc_id, sha256(text) as h from documents),
r as (select doc_id, list_transform(range(0, 24), lambda i: ('0x' || substr(h, (2 * (i % 32) + 1)::int, 2))::int / 255.0 * 0.5 + i / 24.0 * 0.5) as raw from d)
select doc_id, list_transform(raw, lambda x: round(100 * x / sqrt(list_inner_product(raw, raw)))::int) as embedding from r""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding backend over Arrow batches."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    out = embedders.embed_column(rows, embedders.MockEmbedder(24), element="double")
    return out.select("doc_id", F.transform("embedding", lambda x: F.round(x * 100).cast("int")).alias("embedding"))


@query("""select item_id, trim(regexp_replace(text, '["\\\\]', '', 'g')) as query, (item_id % 20)::int as "limit", case when item_id % 2 = 0 then 'src' end as value,
case when trim(regexp_replace(text, '["\\\\]', '', 'g')) = '' then 'QUERY_EMPTY' end as error from benchmark""")
def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of JSON requests."""
    clean = F.trim(F.regexp_replace("text", r'["\\]', ""))
    scope = F.when(F.col("item_id") % 2 == 0, F.struct(F.lit("path").alias("mode"), F.lit("src").alias("value")))
    sent = F.to_json(F.struct(clean.alias("query"), (F.col("item_id") % 20).alias("limit"), scope.alias("scope"), F.lit(1).alias("unknown")))
    lines = table(spark, sf_dir, "benchmark").select("item_id", sent.alias("value"))
    return requests(lines, "item_id").select("item_id", "query", "limit", "scope.value", "error")


@query(f"""with {CORPUS_SQL} select chunk_id, printf('[%d] %s:%d-%d', doc_id + 1, path, start_line, end_line) || chr(10) || '    Level: ' || level || case when name = '' then '' else ' | Name: ' || name end || chr(10)
|| printf('    Score: %.4f', (doc_id % 8) / 8.0::double) || ' | Source: ' || case when doc_id % 2 = 0 then 'semantic + keyword' else 'keyword match' end || chr(10) || '    Reasons: a, b' as block,
array_to_string(list_filter([case when doc_id % 8 > 0 then printf('rrf=%.4f', (doc_id % 8) / 8.0::double) end, case when doc_id % 4 > 0 then printf('vector=%.4f', (doc_id % 4) / 4.0::double) end], lambda x: x is not null), ' | ') as scores,
'{{"chunk_id":"' || chunk_id || '","level":"' || level || '","end_line":' || end_line || '}}' as json from corpus""")
def format_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    score = (c("doc_id") % 8 / 8).cast("double")
    source = display.source_label(F.when(c("doc_id") % 2 == 0, "both").otherwise("keyword"))
    block = display.verbose_block(c("doc_id") + 1, c("path"), c("start_line"), c("end_line"), c("level"), c("name"), score, source, F.array(F.lit("a"), F.lit("b")), F.lit(""))
    scores = display.score_breakdown({"rrf": score, "vector": (c("doc_id") % 4 / 4).cast("double")})
    return corpus(spark, sf_dir).select("chunk_id", block.alias("block"), scores.alias("scores"), display.as_json(["chunk_id", "level", "end_line"]).alias("json"))
