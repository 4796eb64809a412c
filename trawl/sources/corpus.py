"""The document tables seen as a source tree, so that every operator has data to run on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.paths import language
from trawl.operators.postings import KeywordIndex
from trawl.session import table
from trawl.sources import folders

EXT = {"en": ".py", "fr": ".js", "de": ".go", "es": ".java"}
NOW = "2024-01-31 00:00:00"

_EXT_SQL = "case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.go' when 'es' then '.java' else '' end"
_LANGUAGE_SQL = "case lang when 'en' then 'python' when 'fr' then 'javascript' when 'de' then 'go' when 'es' then 'java' else 'unknown' end"
#: The same view in DuckDB SQL.
CORPUS_SQL = rf"""corpus as (select printf('doc-%08d', doc_id) as chunk_id, doc_id,
    'src/' || source || '/' || case when doc_id % 10 = 0 then 'tests/' else '' end || 'doc_' || doc_id || {_EXT_SQL} as path,
    case doc_id % 3 when 0 then 'file' when 1 then 'class' else 'method' end as level, {_LANGUAGE_SQL} as language,
    regexp_extract(text, '[\p{{L}}\p{{N}}_]+') as name, text as content, 1 as start_line,
    (length(text) - length(replace(text, chr(10), '')) + 1)::int as end_line,
    timestamp '{NOW}' - to_hours(doc_id) as modified_at, source as subproject from documents)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ext = F.create_map(*[F.lit(x) for kv in EXT.items() for x in kv])
    inner = F.when(F.col("doc_id") % 10 == 0, "tests/").otherwise("")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), inner, F.lit("doc_"), F.col("doc_id").cast("string"), F.coalesce(F.try_element_at(ext, "lang"), F.lit("")))
    level = F.when(F.col("doc_id") % 3 == 0, "file").when(F.col("doc_id") % 3 == 1, "class").otherwise("method")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return docs.select(
        F.format_string("doc-%08d", "doc_id").alias("chunk_id"),
        "doc_id",
        path.alias("path"),
        level.alias("level"),
        language(path).alias("language"),
        F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0).alias("name"),
        F.col("text").alias("content"),
        F.lit(1).alias("start_line"),
        lines.alias("end_line"),
        F.expr(f"timestamp_ntz '{NOW}' - make_dt_interval(0, doc_id)").alias("modified_at"),
        F.col("source").alias("subproject"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus rows that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return corpus(spark, sf_dir).join(vectors, "doc_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, standing in for an embedded query."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


_indexes: dict[tuple, KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> KeywordIndex:
    """The corpus's stored keyword index; built at the first use and again when the table's files change."""
    path, fs = folders.hadoop_path(spark, f"{sf_dir}/documents.parquet")
    about = fs.getContentSummary(path)
    key = (spark.sparkContext.applicationId, sf_dir, stemmed, about.getLength(), about.getFileCount(), fs.getFileStatus(path).getModificationTime())
    if key not in _indexes:
        index = KeywordIndex(spark, f"{folders.shared_folder(spark)}/keywords-{uuid.uuid4().hex}", stemmed)
        index.rebuild(corpus(spark, sf_dir))
        _indexes[key] = index
    return _indexes[key]
