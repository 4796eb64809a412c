"""Source tree, chunking and identity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import identity, paths
from trawl.operators import chunking
from trawl.plans.registry import query
from trawl.session import table
from trawl.sources.corpus import CORPUS_SQL, corpus
from trawl.sources.files import detect_extensions

_DOC_FILES = "files as (select path, language, content from corpus)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", "language", "content")


_MINIFIED = """(octet_length(encode({t})) > 0 and (contains(lower({p}), '.min.') or octet_length(encode({t})) // greatest(nl, 1) > 500 or (nl = 0 and octet_length(encode({t})) > 10240)
    or (octet_length(encode({t})) >= 1024 and blanks / octet_length(encode({t})) < 0.05)))"""


@query(f"""with f as (select 'd' || doc_id as key, case when doc_id % 50 = 0 then 'dist/App.MIN.js' else 'a.js' end as path, text as t from documents
union all select 'p' || page_id, url, html from pages), c as (select *, length(t) - length(replace(t, chr(10), '')) as nl, length(t) - length(translate(t, ' ' || chr(9) || chr(10), '')) as blanks from f)
select key, {_MINIFIED.format(t='t', p='path')} as minified, ends_with(lower(path), '.min.js') as by_name from c""")
def minified_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 50 == 0, "dist/App.MIN.js").otherwise("a.js")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), name.alias("path"), F.col("text").alias("t"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("path"), F.col("html").alias("t"))
    path = F.col("path")
    return docs.unionByName(pages).select("key", chunking.is_minified(path, F.col("t")).alias("minified"), chunking.is_minified_name(path).alias("by_name"))


@query(f"""with {CORPUS_SQL} select path, ends_with(path, '.py') or (starts_with(path, 'src/src1/') and ends_with(path, '.go')) as any_match,
(ends_with(path, '.py') or (starts_with(path, 'src/src1/') and ends_with(path, '.go'))) and not contains(path, '/tests/') as kept from corpus""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, include = F.col("path"), ["**/*.py", "src/src1/**/*.go"]
    return corpus(spark, sf_dir).select("path", paths.any_glob(path, include).alias("any_match"), paths.included(path, include, ["src/*/tests/**"]).alias("kept"))


@query(f"""with {CORPUS_SQL} select path, case when contains(path, 'src3/') and not contains(path, 'src13/') then true when contains(path, '/doc_1') then false
when ends_with(path, '.java') then true when contains(path, '/tests/') then true else false end as ignored from corpus""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = paths.ignore_rules(["# comment", "tests/", "*.java"], ["!src/*/doc_1", "!**/doc_1*"], ["src3/"])
    return corpus(spark, sf_dir).select("path", paths.ignored(F.col("path"), rules).alias("ignored"))


@query(f"with {CORPUS_SQL} select language, count(*) as n from corpus group by language")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("path").withColumn("language", paths.language(F.col("path")))
    return rows.groupBy("language").agg(F.count("*").alias("n"))


@query(f"with {CORPUS_SQL} select distinct regexp_extract(path, '\\.[^.]*$') as extension, language from corpus where language <> 'unknown'")
def lang_autodetect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_extensions(corpus(spark, sf_dir).select("path"))


@query(f"""with {CORPUS_SQL} select path, substr(sha256(path || ':' || level || ':' || start_line || ':' || end_line), 1, 32) as chunk_id,
substr(sha256(content), 1, 32) as content_hash, end_line - start_line + 1 as n_lines from corpus""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = identity.chunk_id(c("path"), c("level"), c("start_line"), c("end_line"))
    return corpus(spark, sf_dir).select("path", own.alias("chunk_id"), identity.content_hash(c("content")).alias("content_hash"), identity.line_count(c("start_line"), c("end_line")).alias("n_lines"))


@query("select doc_id, sha256(text) as file_hash from documents")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", identity.file_hash(F.col("text")).alias("file_hash"))


@query(f"""with {CORPUS_SQL}, v as (select chunk_id, path, level, content, (doc_id % 7)::int as a, (doc_id % 5)::int as b from corpus)
select chunk_id, a >= 1 and b >= a and trim(content) <> '' as valid from v""")
def chunk_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 5).cast("int")
    return corpus(spark, sf_dir).select("chunk_id", identity.is_valid(F.col("path"), a, b, F.col("content"), F.col("level")).alias("valid"))


@query(f"""with {CORPUS_SQL}, s as (select path, content, length(content) - length(replace(content, chr(10), '')) + 1 as n from corpus)
select substr(sha256(path || ':file:1:' || n), 1, 32) as chunk_id, path, path as name, 'file' as level, 1 as start_line, n::int as end_line, substr(sha256(content), 1, 32) as content_hash from s""")
def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_chunks(_files(spark, sf_dir)).select("chunk_id", "path", "name", "level", "start_line", F.col("end_line").cast("int").alias("end_line"), "content_hash")


def _policy(most: str) -> str:
    # bytes as pairs of hexadecimal digits: up to the last line end, else the characters that are whole
    character = "[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB]."
    cut = f"case when regexp_extract(h, '^((?:..)+)0A', 1) <> '' then regexp_extract(h, '^((?:..)+)0A', 1) else regexp_extract(h, '^((?:{character})*)', 1) end"
    return f"""with {CORPUS_SQL}, c as (select *, substr(hex(encode(content)), 1, 640) as h, floor(octet_length(encode(content)) / 3.5) > 100 as is_partial from corpus where {most})
    select path, is_partial, case when is_partial then sha256(unhex({cut} || hex(encode(chr(10) || '// ... [truncated]')))) else sha256(content) end as digest from c"""


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "is_partial", F.sha2("content", 256).alias("digest"))


@query(_policy("octet_length(encode(content)) <= 2000"))
def file_chunk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunking.file_policy(_files(spark, sf_dir), 100, 2000))


@query(_policy("true"))
def class_chunk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunking.class_policy(_files(spark, sf_dir), 100))


@query(f"""with recursive {CORPUS_SQL},
l as (select path, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10)))))::int as i from corpus where floor(octet_length(encode(content)) / 3.5) > 500),
a as (select path, list(floor(octet_length(encode(line)) / 3.5)::int order by i) as s from l group by path),
w as (select path, s, 0 as k, 0 as b, greatest(1, len(list_filter(range(1, len(s) + 1), lambda j: list_sum(s[1:j::int]) <= 244)))::int as e from a
union all select path, s, k + 1, n, greatest(n + 1, n + len(list_filter(range(n + 1, len(s) + 1), lambda j: list_sum(s[n + 1:j::int]) <= 244)))::int
from (select path, s, k, b, e, case when back > b then back else e end::int as n from (select *, len(list_filter(range(1, e), lambda j: list_sum(s[(j + 1)::int:e]) >= 256)) as back from w)) where n < len(s))
select path, k::int as chunk_index, b + 1 as start_line, e as end_line, substr(sha256(path || ':method:' || (b + 1) || ':' || e), 1, 32) as chunk_id from w""")
def method_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("chunk_id", "path", F.lit("method").alias("level"), F.lit(1).alias("start_line"), "content")
    windows = chunking.split_methods(rows, 500).filter("is_partial")
    named = rows.select(F.col("chunk_id").alias("parent_chunk_id"), "path")
    return windows.join(named, "parent_chunk_id").select("path", "chunk_index", "start_line", "end_line", "chunk_id")


SNIPPETS = {
    "calc.py": "class Calculator:\n    def add(self, a, b):\n        return a + b\n\n    @staticmethod\n    def zero():\n        return 0\n\n\ndef main():\n    print(Calculator().add(1, 2))\n",
    "auth.js": "export class Auth {\n  constructor(store) {\n    this.store = store;\n  }\n  async login(user) {\n    if (user) { return this.store.get(user); }\n  }\n}\nfunction logout(user) {\n  return true;\n}\n",
    "cache.go": "package cache\n\ntype Cache struct {\n\tdata map[string]int\n}\n\nfunc New() *Cache {\n\treturn &Cache{}\n}\n\nfunc (c *Cache) Get(k string) int {\n\treturn c.data[k]\n}\n",
    "App.java": "public class App {\n    private int n;\n    public App(int n) {\n        this.n = n;\n    }\n    public int twice() {\n        return 2 * n;\n    }\n}\n",
    "lib.rs": "pub struct Point {\n    x: i32,\n}\n\nimpl Point {\n    pub fn x(&self) -> i32 {\n        self.x\n    }\n}\n",
}


#: By language: how a text's words become a comment line, what stands around them, and the chunks that gives as
#: (level, name, first line, last line) with n for the number of the text's lines.
SOURCES = {
    "python": ("        # ", "class {0}:\n    def first(self):\n", "\n        return 0\n\ndef last():\n    return 1\n", [("class", "{0}", "1", "n + 3"), ("method", "first", "2", "n + 3"), ("method", "last", "n + 5", "n + 6")]),
    "javascript": ("    // ", "class {0} {{\n  first() {{\n", "\n    return 0;\n  }}\n}}\nfunction last() {{\n  return 1;\n}}\n", [("class", "{0}", "1", "n + 5"), ("method", "first", "2", "n + 4"), ("method", "last", "n + 6", "n + 8")]),
    "go": ("\t// ", "type {0} struct {{\n", "\n}}\nfunc last() int {{\n\treturn 1\n}}\n", [("class", "{0}", "1", "n + 2"), ("method", "last", "n + 3", "n + 5")]),
    "java": ("    // ", "public class {0} {{\n  public int first() {{\n", "\n    return 0;\n  }}\n}}\n", [("class", "{0}", "1", "n + 5"), ("method", "first", "2", "n + 4")]),
}
_PLAIN = "regexp_replace(content, '[^\\p{L}\\p{N} \\n]', ' ', 'g')"


def _declared_sql() -> str:
    parts = []
    for lang, (_, _, _, chunks) in SOURCES.items():
        for level, name, a, b in chunks:
            own = "'C' || doc_id" if name == "{0}" else f"'{name}'"
            parts.append(f"select path, '{level}' as level, {own} as name, ({a})::int as start_line, ({b})::int as end_line from t where language = '{lang}'")
    return f"with {CORPUS_SQL}, t as (select *, len(string_split({_PLAIN}, chr(10))) as n from corpus) " + " union all ".join(parts)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a source file of its path's language, its lines as comments of a declaration."""
    rows = corpus(spark, sf_dir)
    lines = F.split(F.regexp_replace("content", r"[^\p{L}\p{N} \n]", " "), "\n")
    body = F.lit(None).cast("string")
    for lang, (mark, before, after, _) in SOURCES.items():
        name = F.concat(F.lit("C"), F.col("doc_id").cast("string"))
        head, tail = before.replace("{{", "{"), after.replace("{{", "{").replace("}}", "}")
        start, rest = head.split("{0}")
        inner = F.concat(F.lit(mark), F.array_join(lines, f"\n{mark}"))
        body = F.when(F.col("language") == lang, F.concat(F.lit(start), name, F.lit(rest), inner, F.lit(tail))).otherwise(body)
    return rows.select("path", "language", body.alias("content")).filter("content is not null")


@query(_declared_sql())
def chunk_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and methods of all texts, dressed as source files."""
    return chunking.declaration_chunks(source_files(spark, sf_dir)).select("path", "level", "name", "start_line", "end_line")
