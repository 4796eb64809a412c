"""The pipeline's stages, each on its own input."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from tests.conftest import TINY
from tests.llm.test_operators import AWKWARD, DOCS
from trawl.llm import decontaminate, neardocs, simhash
from trawl.llm.base import Scratch


def test_stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = scratch.save(stage(spark, docs, TINY), name)
        if k < len(p.STAGES) - 1:
            assert out.columns == columns and out.count() <= docs.count()
        if name == "language_id":
            assert out.count() > 0.98 * n
        if name == "line_dedup":
            lines = out.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
            assert lines.count() == lines.distinct().count()
        if name == "simhash_near_dedup":
            found = simhash.near_duplicates(docs, spark)
            assert out.count() == found.select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            hit = decontaminate.matches(docs, spark.read.parquet(f"{TINY}/benchmark.parquet"), spark).select("doc_id").distinct()
            assert out.count() == docs.count() - hit.count() and out.join(hit, "doc_id").count() == 0
        docs = out
    assert {"probability", "weight"} <= set(docs.columns) and docs.count() > 0


def test_stages_awkward(spark, tmp_path):
    spark.createDataFrame([(1, "a benchmark item of several words that nobody else holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([*AWKWARD, (8, None, None, None, None)], DOCS)
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in p.STAGES:
            out = Scratch(spark).save(stage(spark, out, str(tmp_path)), "x")
        assert out.count() <= rows.count()


def test_near_copies_of_similarity_0_8_go(spark):
    """Pairs beyond the 4 bits of op9, and a clean document."""
    text = [f"w{k}" for k in range(300)]
    near = list(text)
    for k in (50, 150, 250):
        near[k] = f"x{k}"
    apart = text[:150] + [f"y{k}" for k in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate((text, near, apart))], DOCS)
    bits = [simhash.fingerprint(" ".join(t)) for t in (text, near)]
    assert ((bits[0] ^ bits[1]) & ((1 << 64) - 1)).bit_count() > simhash.RADIUS
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, TINY).collect()) == [0, 2]


def test_tables_go_with_their_stage(spark, monkeypatch):
    """What a stage leaves on disk is what its result reads: digests and places, no texts."""
    made, saved, init, save = [], [], Scratch.__init__, Scratch.save

    def noted(self, spark):
        made.append(self)
        init(self, spark)

    def kept(self, df, name, options=None):
        out = save(self, df, name, options)
        saved.append((name, {"text", "line"} & set(out.columns) and out.count()))
        return out

    monkeypatch.setattr(Scratch, "__init__", noted)
    monkeypatch.setattr(Scratch, "save", kept)
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    out = p.line_dedup(spark, docs, TINY)
    assert [name for s in made for name in s.paths] == ["dropped"] and out.count() > 0
    made.clear()
    saved.clear()
    out = p.near_dedup(spark, docs, TINY)
    assert sorted(name for s in made for name in s.paths) == ["gone", "gone", "named", "prints"] and out.count() > 0
    # of the texts only those that meet others are written
    assert [name for name, n in saved if n] in ([], ["met-lines"]) and all((n or 0) < docs.count() for _, n in saved)


def test_repeated_texts_meet_once(spark):
    """Texts aren't made distinct before their signatures: copies, near copies of copies and equal rows."""
    text = [f"w{k}" for k in range(300)]
    near, apart = ["x"] + text[1:], text[:150] + [f"y{k}" for k in range(150)]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate((near, text, text, text, apart, apart))]
    rows += [rows[4], (None, "", "en", "s", 0), (9, None, "en", "s", 0), (None, " ".join(near), "en", "s", 0)]
    out = neardocs.keep_one(spark.createDataFrame(rows, DOCS), spark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 0), (False, 4), (False, 9)]
    out = simhash.keep_one(spark.createDataFrame(rows, DOCS), spark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 0), (False, 4), (False, 9)]
