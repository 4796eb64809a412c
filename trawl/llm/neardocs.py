"""Near-duplicate documents: MinHash over 5-word shingles, verified by exact Jaccard similarity.

Bands, buckets and verification are those of line deduplication, with a text's distinct
shingles (shorter texts: all their words) in place of a line's; pairs of similarity 0.8 or
more are linked. Texts without a word are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import linededup, minhash, runs
from trawl.llm.base import Scratch, fresh, small

SHINGLE = 5


class Words:
    """The runs of words of ``line``, A-Z lower-cased, in numpy over Arrow batches."""

    def __init__(self, measure: tuple, num: int, den: int):
        self.measure, self.num, self.den = measure, num, den

    def keyed(self, lines: DataFrame, bands: tuple[int, int], scratch: Scratch, name: str) -> DataFrame:
        """(id, n, k0, k1, ...) of (id, n, line), or of (id, line) that may repeat."""
        bands = minhash.COARSE if bands == runs.COARSE else minhash.FINE
        names = ["d1", "d2", "n", *[f"k{i}" for i in range(2 * bands[0])]]
        flat = lines.select("id.d1", "id.d2", F.col("n") if "n" in lines.columns else F.lit(1).cast("long").alias("n"), "line")
        signed = flat.mapInArrow(minhash.signed(self.measure, bands, 3, names), ", ".join(f"{c} long" for c in names))
        if "n" not in lines.columns:
            signed = signed.groupBy("d1", "d2").agg(F.sum("n").alias("n"), *[F.first(k).alias(k) for k in names[3:]])
        signed = scratch.save(signed, name, {"parquet.enable.dictionary": "false"})
        return signed.select(F.struct("d1", "d2").alias("id"), *names[2:])

    def sketched(self, lines: DataFrame) -> None:
        """No pair is ruled out before it is compared."""

    def similar(self, both: DataFrame, longest: int | None = None) -> DataFrame:
        """The pairs (a, b) of (a, b, x, y) whose exact Jaccard similarity is num / den or more."""
        flat = both.select("a.d1", "a.d2", F.col("b.d1").alias("e1"), F.col("b.d2").alias("e2"), "x", "y")
        near = flat.mapInArrow(minhash.similar(self.measure, self.num, self.den), "d1 long, d2 long, e1 long, e2 long")
        return near.select(F.struct("d1", "d2").alias("a"), F.struct(F.col("e1").alias("d1"), F.col("e2").alias("d2")).alias("b"))

    def shingles(self, lines: DataFrame, *names: str, longest: int | None = None) -> DataFrame:
        """Columns ``names`` and h: the distinct digests of each line."""
        rest = lines.select(*names, "line")
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1]), "n long, h long"])
        return rest.mapInArrow(minhash.shingled(self.measure, len(names), [*names, "n", "h"]), schema).drop("n")


WORDS = Words(minhash.word_runs(SHINGLE), linededup.NUM, linededup.DEN)


def keep_one(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of ``docs``, one for each component: the smallest id's (null ids last, ties by the text's digest).

    Whole texts are neither exchanged nor written, but for those that share a band with others.
    """
    scratch = Scratch(spark)
    id_ = F.struct(F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), F.col("text")).alias("d2")).alias("id")
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.xxhash64("text").alias("th")).alias("at")
    texts = docs.select(at, id_, F.coalesce("text", F.lit("")).alias("line"))
    places = scratch.save(texts.select("at", "id"), "all-places")
    counts = scratch.save(places.groupBy("id").agg(F.count("*").alias("n")), "counts")
    between = Scratch(spark)
    roots = scratch.save(linededup.line_components(texts.select("id", "line"), between, WORDS), "roots")
    between.keep()
    doc, th = fresh(docs, "doc", "th")
    gone = linededup.dropped(places, counts, roots, scratch).select(F.col("at.doc_id").alias(doc), F.col("at.th").alias(th)).distinct()
    gone = small(scratch.save(gone, "gone"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]) & F.xxhash64(docs["text"]).eqNullSafe(gone[th]), "left_anti")
    repeated = not places.groupBy("at").count().filter("count > 1").isEmpty()
    scratch.keep("gone")
    return kept if not repeated else kept.dropDuplicates(["doc_id", "text"])
