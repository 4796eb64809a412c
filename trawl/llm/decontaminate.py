"""Benchmark decontamination by SimHash over item-sized windows.

Texts and items are lower-cased and stripped of everything but letters, digits and white
space; items and windows are compared as multisets of 5-word shingles (shorter items: all
their words). A document is contaminated by an item if some window of the item's number of
words has a weighted Jaccard similarity (sum of minima over sum of maxima of shingle
counts) of 0.8 or more.

1. Anchors: such a window shares a shingle with the item, namely one of the item's rarest
   ones (prefix filtering). Documents' exploded shingle digests meet these in an equi-join;
   every item-sized window that covers a meeting is a candidate. Those with too few shingles
   of the item to be similar, whatever their counts, go before anything is signed.
2. SimHash: windows and items get 64-bit fingerprints of their weighted shingles. Fingerprints
   are cut into RADIUS + 1 blocks; fingerprints within RADIUS bits agree in one block at
   least, so the equi-join on (item, block number, block) finds all of them.
3. Verification: exact weighted similarity of what lies within RADIUS.

At similarity 0.8 some 10 of 64 bits differ (standard deviation 3), hence the radius.
Only windows that can't be similar are never fingerprinted. Defined cases: null and empty texts and items match nothing; a text shorter
than the item is one window; rows that agree in id and text are one result; null ids are
kept; repeated items are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.base import Scratch, fresh, let, words

SHINGLE, RADIUS = 5, 24
#: Similarity as a fraction.
NUM, DEN = 4, 5
#: Shingles found in at most this many items always anchor; commoner ones only in the items that need them.
COMMON = 4
#: Anchor rows (some 40 bytes) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def normal_words(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def shingles(w: Column, size: Column) -> Column:
    """Digests of the runs of ``size`` words, in order, with repeats."""
    n = F.size(w) - size + 1
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    )


def simhash(h: Column) -> Column:
    """64-bit SimHash of an array of digests.

    Bits are counted three at a time in 20-bit lanes of one sum, so an array of up to
    2^20 - 1 digests takes 22 sums instead of 64; a longer one has its bits counted one by one.
    """
    lanes, most = 0b111, 1 << 20

    def spread(x: Column) -> Column:
        return (
            x.bitwiseAND(F.lit(1))
            .bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(2)), 19))
            .bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(4)), 38))
        )

    def bits(k: int) -> Column:
        total = F.aggregate(
            h, F.lit(0).cast("long"), lambda a, x: a + spread(F.shiftrightunsigned(x, 3 * k).bitwiseAND(F.lit(lanes).cast("long")))
        )

        def over(t: Column) -> Column:
            out = F.lit(0).cast("long")
            for lane in range(3 if k < 21 else 1):
                count = F.shiftrightunsigned(t, 20 * lane).bitwiseAND(F.lit((1 << 20) - 1).cast("long"))
                out = out.bitwiseOR(F.when(2 * count > F.size(h), F.shiftleft(F.lit(1).cast("long"), 3 * k + lane)).otherwise(F.lit(0).cast("long")))
            return out

        return let(total, over)

    def bit(k: int) -> Column:
        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1)))
        return F.when(2 * total > F.size(h), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    def joined(part: Callable[[int], Column], n: int) -> Column:
        out = part(0)
        for k in range(1, n):
            out = out.bitwiseOR(part(k))
        return out

    return F.when(F.size(h) < most, joined(bits, 22)).otherwise(joined(bit, 64))


def blocks(fp: Column, radius: int) -> Column:
    """(number, block) of the radius + 1 blocks of a fingerprint."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    cut = [
        F.struct(
            F.lit(i).cast("short").alias("block"),
            F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"),
        )
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    return F.array(*cut)


def shared_weight(x: Column, y: Column) -> Column:
    """Sum over shingles of the smaller count."""
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    both = F.array_intersect(x, y)
    counted = F.aggregate(
        both,
        F.lit(0),
        lambda a, s: a + F.least(F.size(F.filter(x, lambda v: v == s)), F.size(F.filter(y, lambda v: v == s))),
    )
    return F.when(plain, F.size(both)).otherwise(counted)


def _items(benchmark: DataFrame) -> DataFrame:
    return (
        benchmark.select("item_id", normal_words(F.col("text")).alias("w"))
        .filter(F.size("w") > 0)
        .distinct()
        .withColumn("length", F.size("w"))
        .withColumn("size", F.least(F.lit(SHINGLE), "length"))
        .withColumn("h", shingles(F.col("w"), F.col("size")))
        .withColumn("fp", simhash(F.col("h")))
        .select("item_id", F.xxhash64("item_id", "w").alias("item"), "length", "size", "h", "fp")
    )


def _anchors(items: DataFrame) -> DataFrame:
    """(digest, size, item, length): an item's anchoring shingles."""
    placed = items.select("item", "length", "size", F.size("h").alias("n"), F.posexplode("h").alias("place", "digest"))
    spread = placed.groupBy("digest", "size").agg(F.count_distinct("item").alias("items"))
    ranked = placed.join(spread, ["digest", "size"]).groupBy("item", "length", "size", "n").agg(
        F.array_sort(F.collect_list(F.struct("items", "digest", "place"))).alias("all")
    )
    # a multiset of similarity t shares at least t of the item's shingles, however short the text
    needed = F.ceil(NUM * F.col("n") / DEN).cast("int")
    return (
        ranked.withColumn("prefix", F.col("n") - needed + 1)
        .select("item", "length", "size", "prefix", F.posexplode("all").alias("rank", "x"))
        .filter((F.col("rank") < F.col("prefix")) | (F.col("x.items") <= COMMON))
        .select(F.col("x.digest").alias("digest"), "size", "item", "length")
        .distinct()
    )


def _windows(h: Column, own: Column, ats: Column, length: Column, size: Column) -> Column:
    """(start, x) of a text's windows that cover one of the anchors ``ats`` and may be similar to an item.

    h: the text's shingles; own: the item's. Starts are listed once, however many anchors a
    window covers. x: the window's shingles.
    """
    n = F.size(own)
    last = F.greatest(F.size(h) - n, F.lit(0))  # of the starts

    def covering(p: Column) -> Column:
        """``p``: anchors in order, so that each adds the starts beyond those of the one before."""

        def added(at: Column, k: Column) -> Column:
            before = F.when(k > 0, F.least(F.get(p, k - 1), last) + 1).otherwise(F.lit(0))
            a, b = F.greatest(at - length + size, before, F.lit(0)), F.least(at, last)
            return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(p, added))

    def over(marks: Column) -> Column:
        def enough(a: Column) -> Column:
            here = F.slice(marks, a + 1, n)
            return (DEN + NUM) * F.size(F.filter(here, lambda m: m)) >= NUM * (n + F.size(here))

        starts = F.filter(let(F.array_sort(ats), covering), enough)
        return F.transform(starts, lambda a: F.struct(a.alias("start"), F.slice(h, a + 1, n).alias("x")))

    return let(F.transform(h, lambda s: F.array_contains(own, s)), over)


def matches(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (digest of the text), item_id, similarity and start (word of the best window)."""
    scratch = Scratch(spark)
    items = scratch.save(_items(benchmark), "items")
    anchors = scratch.save(_anchors(items), "anchors")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most SHINGLE values
    anchors = F.broadcast(anchors) if anchors.count() <= BROADCAST_ROWS else anchors
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    by_size = F.array(*[F.struct(F.lit(s).alias("size"), shingles(F.col("w"), F.lit(s)).alias("h")) for s in sizes])
    hits = (
        texts.select("doc_id", "th", normal_words(F.col("text")).alias("w"))
        .select("doc_id", "th", F.explode(by_size).alias("s"))
        .select("doc_id", "th", "s.size", F.posexplode("s.h").alias("at", "digest"))
        .join(anchors, ["digest", "size"])
        .select(
            "doc_id",
            "th",
            "item",
            "at",
        )
        if sizes
        else texts.select("doc_id", "th", F.lit(0).cast("long").alias("item"), F.lit(0).alias("at")).limit(0)
    )
    hits = scratch.save(hits.groupBy("doc_id", "th", "item").agg(F.collect_set("at").alias("ats")), "hits")

    # the texts of documents with an anchor, once each
    met = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    found = texts.join(met, texts["doc_id"].eqNullSafe(met["d"]) & (texts["th"] == met["t"]), "left_semi")
    found = found.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), normal_words(F.col("text")).alias("w"))
    item = items.select("item", "length", "size", "h", "fp")
    near = lambda h: _windows(h, F.col("h"), F.col("ats"), F.col("length"), F.col("size"))
    windows = (
        hits.join(found, hits["doc_id"].eqNullSafe(found["d"]) & (hits["th"] == found["t"]))
        .join(item.select("item", "length", "size", "h"), "item")
        .select("doc_id", "th", "item", F.explode(let(shingles(F.col("w"), F.col("size")), near)).alias("n"))
        .select("doc_id", "th", "item", "n.start", "n.x")
        .withColumn("print", simhash(F.col("x")))
    )
    windows = scratch.save(windows, "windows")
    cut = windows.select("doc_id", "th", "item", "start", "x", "print", F.explode(blocks(F.col("print"), radius)).alias("b"))
    own = item.select("item", "h", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    close = (
        cut.select("doc_id", "th", "item", "start", "print", "b.block", "b.value")
        .join(own.select("item", "fp", "b.block", "b.value"), ["item", "block", "value"])
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("fp"))) <= radius)
        .select("doc_id", "th", "item", "start")
        .distinct()
    )
    shared = shared_weight(F.col("x"), F.col("h"))
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("th") == F.col("t"), F.col("item") == F.col("i"), F.col("start") == F.col("s")]
    kept = close.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("item").alias("i"), F.col("start").alias("s"))
    judged = (
        windows.join(kept, same, "left_semi")
        .join(item.select("item", "h"), "item")
        .withColumn("shared", shared)
        .withColumn("total", F.size("x") + F.size("h") - F.col("shared"))
        .filter(DEN * F.col("shared") >= NUM * F.col("total"))
        .withColumn("similarity", F.col("shared") / F.col("total"))
    )
    best = judged.groupBy("doc_id", "th", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.join(items.select("item", "item_id"), "item").select(
        "doc_id", "th", "item_id", "best.similarity", (-F.col("best.s")).alias("start")
    )


def clean(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    d, t = fresh(docs, "doc", "th")
    bad = matches(docs, benchmark, spark).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[d]) & F.xxhash64(docs["text"]).eqNullSafe(bad[t]), "left_anti")
