"""Fusion, splits, re-ranking, query preprocessing and keyword search on worked examples."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from trawl.config import Config, ConfigError
from trawl.functions import text
from trawl.functions.stemming import porter
from trawl.operators import fusion, keyword, postings, rerank, splits, vector
from trawl.plans.search import RequestError, SearchRequest, search

RANKED = "chunk_id string, score double, rank int"
CHUNK = "chunk_id string, content string, name string, path string"


def test_rrf(spark):
    v = spark.createDataFrame([("chunk-1", 0.9, 0), ("chunk-2", 0.7, 1)], RANKED)
    k = spark.createDataFrame([("chunk-1", 0.8, 0), ("chunk-3", 0.6, 1)], RANKED)
    rows = fusion.rrf(v, k, 10).collect()
    assert [r.chunk_id for r in rows] == ["chunk-1", "chunk-2", "chunk-3"]
    assert rows[0].rrf_score == pytest.approx(2 / 61, abs=1e-9) and rows[1].rrf_score == pytest.approx(1 / 62, abs=1e-9)
    assert [r.match_source for r in rows] == ["both", "vector", "keyword"]
    assert rows[1].keyword_rank == -1
    assert fusion.rrf(v, k, 0).count() == 0
    assert fusion.rrf(v, k.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))), 10).count() == 4


@pytest.mark.parametrize(
    ("hits", "want"),
    [
        ([("s1", "p", 0.8), ("s2", "p", 0.7)], [("s1", 0.88, 2)]),
        ([("s1", "p", 0.7), ("s2", "p", 0.9), ("s3", "p", 0.6)], [("s2", 1.0, 3)]),
        ([("a", "", 0.85), ("s1", "p", 0.75), ("s2", "p", 0.7), ("b", None, 0.6)], [("a", 0.85, 0), ("s1", 0.825, 2), ("b", 0.6, 0)]),
        ([("a1", "p1", 0.8), ("a2", "p1", 0.7), ("b1", "p2", 0.6), ("b2", "p2", 0.65)], [("a1", 0.88, 2), ("b2", 0.715, 2)]),
        ([("s1", "p", 0.5)], [("s1", 0.5, 1)]),
    ],
)
def test_splits(spark, hits, want):
    rows = splits.collapse_splits(spark.createDataFrame(hits, "chunk_id string, parent_chunk_id string, score double")).collect()
    assert [(r.chunk_id, round(r.score, 9), r.matched_splits) for r in rows] == want


CANDIDATE = "chunk_id string, content string, name string, path string, chunk_type string, base_score double, modified_at timestamp"


@pytest.mark.parametrize(
    ("query", "rows", "winner"),
    [
        ("parseConfig", [("no", "x", "otherFunc", "a.go", "function", 0.8, None), ("match", "x", "parseConfig", "b.go", "function", 0.79, None)], "match"),
        ("authentication flow", [("no", "x", "a", "a.go", "", 0.8, None), ("has", "the authentication flow", "b", "b.go", "", 0.79, None)], "has"),
        ("handler", [("test", "x", "a", "handler_test.go", "", 0.81, None), ("prod", "x", "a", "handler.go", "", 0.8, None)], "prod"),
        ("parse config", [("all", "parse config", "parseConfig", "config/parse.go", "function", 0.7, None), ("no", "x", "y", "z.go", "", 0.8, None)], "all"),
    ],
)
def test_rerank(spark, query, rows, winner):
    out = rerank.rerank(spark.createDataFrame(rows, CANDIDATE), query, F.lit("2024-01-31").cast("timestamp")).collect()
    assert out[0].chunk_id == winner
    if query == "handler":
        assert [round(r.final_score, 6) for r in out] == [0.818, 0.791775]


def test_fallback_reranker(spark):
    def broken(*_):
        raise RuntimeError

    rows = spark.createDataFrame([("a", "x", "n", "p", "t", 0.5, None)], CANDIDATE)
    assert rerank.FallbackReranker(broken)(rows, "q", F.current_timestamp()).count() == 1
    assert rerank.FallbackReranker(lambda d, *_: d.limit(0))(rows, "q", F.current_timestamp()).count() == 0


@pytest.mark.parametrize(
    ("raw", "terms"),
    [("database", ["database"]), ("the database", ["database"]), ("the a an", []), ("Database CONNECTION", ["database", "connection"]), ("error 404", ["error", "404"]), ("", []), ("函数 función", ["函数", "función"]), ("x 7", ["7"])],
)
def test_preprocess(spark, raw, terms):
    assert list(text.preprocess(raw).terms) == terms
    assert spark.createDataFrame([(raw,)], "q string").select(text.query_terms(F.col("q")).alias("t")).first().t == terms


def test_preprocess_phrases():
    q = text.preprocess('"exact phrase" search')
    assert q.phrases == ("exact phrase",) and q.has_phrases and q.fts == '"exact phrase" OR search'
    assert text.preprocess("database connection").fts == "database OR connection"


ROWS = [
    ("c1", "database connection pooling", "pool", "/db/pool.go"),
    ("c2", "http server connection", "server", "/http/server.go"),
    ("c3", "database database query builder", "query", "/db/query.go"),
    ("c4", "file reader", "read_file", "/io/reader.go"),
    ("c5", "nothing here at all", "x", "/a.py"),
    ("c6", "connections connecting", "y", "/b.py"),
    ("c7", "más café", "z", "/c.py"),
]


@pytest.mark.parametrize("query", ["database", "connection", '"database connection"', "database OR connection", "read_file", "cafe", "data*", "database NOT query", "name:pool", "http server", "nothing AND here"])
def test_keyword_like_sqlite(spark, query):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(chunk_id unindexed, content, name, file_path, tokenize='porter unicode61')")
    c.executemany("insert into t values (?, ?, ?, ?)", ROWS)
    want = c.execute("select chunk_id, -bm25(t) from t where t match ?", (query,)).fetchall()
    got = postings.search(postings.Unstored(keyword.tokenized(spark.createDataFrame(ROWS, CHUNK))), query, 10).collect()
    assert {r.chunk_id: round(r.score, 5) for r in got} == {k: round(v, 5) for k, v in want}


def test_porter_like_sqlite():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing filing happy sky relational conditional rational valenci digitizer conformabli radicalli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adoption communism activate effective bowdlerize probate rate cease controll roll handler handling database databases".split()
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    c.execute("create virtual table v using fts5vocab(t, row)")
    for w in words:
        c.execute("delete from t")
        c.execute("insert into t values (?)", (w,))
        assert porter(w) == c.execute("select term from v").fetchone()[0], w


def test_prefilter_and_postfilter_differ(spark):
    rows = [(f"c{i}", "method" if i % 4 == 0 else "file", f"src/{i}", [float(i), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, level string, path string, embedding array<float>")
    assert vector.knn_prefiltered(df, [0.0, 0.0], 10, ["method"]).count() == 10
    assert vector.knn_postfiltered(df, [0.0, 0.0], 10, ["method"]).count() == 3
    assert vector.knn(df, [0.0, 0.0], 0).count() == 0


def test_batch_equals_single(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>").repartition(5)
    asked = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(4)]
    got = {(r.query_id, r["rank"]): r.chunk_id for r in vector.knn_batch(df, asked, 7).collect()}
    for q, v in asked:
        assert [got[q, i + 1] for i in range(7)] == [r.chunk_id for r in vector.knn(df.filter("embedding is not null"), v, 7).collect()]


def test_queries_in_blocks(spark):
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    asked = df.select(F.col("chunk_id").alias("query_id"), "embedding").filter("query_id % 3 = 0 or query_id = 500")
    key = lambda out: sorted((r.query_id, r["rank"], r.chunk_id) for r in out.collect())
    want = key(vector.knn_many(df, asked, 4))
    assert len(want) == 160 and key(vector.knn_many(df, asked, 4, block=7)) == want
    assert vector.knn_many(df, asked.limit(0), 4).count() == 0


def test_request_checks(spark):
    with pytest.raises(RequestError, match="QUERY_EMPTY"):
        SearchRequest(" ", [0.0]).checked(Config())
    with pytest.raises(RequestError):
        SearchRequest("x", [0.0], path_prefix="a", subproject="b").checked(Config())
    assert SearchRequest("x", [0.0]).checked(Config()).limit == 10


def test_config():
    c = Config().merge({"default_limit": 5}, {"hybrid": {"rrf_k": 10}})
    assert (c.default_limit, c.get("hybrid.rrf_k"), c.hybrid.enabled) == (5, 10, True)
    for bad in ({"nope": 1}, {"default_limit": 0}, {"chunk_levels": ["x"]}):
        with pytest.raises(ConfigError):
            Config().merge(bad)


def test_scopes_and_weights(spark):
    rows = [(f"c{i}", "method", f"p{i % 2}/f{i}.py", f"name{i}", "alpha beta" if i < 3 else "gamma", f"s{i % 2}", [float(i), 1.0]) for i in range(8)]
    kinds = "chunk_id string, level string, path string, name string, content string, subproject string, embedding array<float>"
    df = spark.createDataFrame(rows, kinds).withColumn("modified_at", F.lit(None).cast("timestamp"))
    now = F.current_timestamp()
    ask = lambda **o: [r.chunk_id for r in search(df, SearchRequest("alpha", [0.0, 1.0], 3, **o), now).collect()]
    assert ask()[0] == "c0"
    assert set(ask(subproject="s1")) <= {"c1", "c3", "c5", "c7"} and set(ask(path_prefix="p1")) <= {"c1", "c3", "c5", "c7"}
    assert ask(scope="all", subproject="s1")[0] == "c0"
    assert len(ask(hybrid=False, rerank=False)) == 3
