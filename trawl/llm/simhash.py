"""SimHash near-duplicates by a grid join over segment popcounts.

Fingerprints are SimHashes of word shingles. Each distinct fingerprint is embedded as the
bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so a pair within ``radius`` bits spends
at most ``radius`` units over the coordinates: with the coordinates dealt to G groups, at
least G - radius groups agree entirely. The grid has one cell for every choice of
G - radius groups and every value of their counts; the range join under Manhattan distance
is thus an equi-join on cells. Pairs met in a cell are kept if their Manhattan distance is within
the radius, and then verified on all 64 bits.

Within a cell pairs aren't listed: members are absorbed breadth-first, each compared with
what isn't absorbed yet, which yields a spanning forest of the cell's true links. Cells
beyond ``TILE`` members are cut into tiles and every pair of tiles is handled by itself.
A distributed union-find joins the forests; no link is lost.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows
with equal ids stay separate rows; a null id gets the smallest non-null id reachable, or
null; an empty table yields none. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.base import Scratch, fresh, small
from trawl.llm.components import components
from trawl.shipping import ship

ship(__name__)

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a cell that one task compares with each other.
TILE = 20_000
#: Up to this many distinct fingerprints, so many groups of coordinates (results don't depend on it).
GROUPS = ((1 << 20, 6), (1 << 26, 7), (1 << 62, 8))
#: Shingles hashed at a time, which bounds memory on long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + size - 1 : to + size - 1], strict=True)])
        bits = np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            fps = [fingerprint(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])


def masks(groups: int, radius: int) -> list[int]:
    """Bit masks of the grid's cells: every choice of groups - radius groups of segments."""
    cuts = np.array_split(np.arange(32), groups)
    own = [sum(3 << (2 * int(s)) for s in cut) for cut in cuts]
    return [sum(own[i] for i in pick) for pick in combinations(range(groups), groups - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fps: DataFrame, groups: int, radius: int) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(0x5555555555555555))
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # 32 two-bit sums, without carries
    cells = [
        F.struct(F.lit(i).cast("short").alias("choice"), F.col("counts").bitwiseAND(F.lit(_signed(m))).alias("cell"))
        for i, m in enumerate(masks(groups, radius))
    ]
    return fps.withColumn("counts", counts).select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.choice", "c.cell")


_LOW = np.uint64(0x5555555555555555)


def embedding(f: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments as runs of ones, so that their Manhattan distance is that many differing bits."""
    low, high = f & _LOW, (f >> np.uint64(1)) & _LOW
    return (low | high) | ((low & high) << np.uint64(1))


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints are within ``radius``: the lower bound first, then all bits of what it leaves."""
    near = np.bitwise_count(embedding(x) ^ embedding(y)) <= radius
    some = np.flatnonzero(near)
    near[some] = np.bitwise_count((x if x.ndim == 0 else x[some]) ^ (y if y.ndim == 0 else y[some])) <= radius
    return near


def _absorb(f: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links among f."""
    left, a, b = f, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(left, x, radius)
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    return a, b


def _links(radius: int, few: int = 24):
    def of(group: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """group: ids in order; f: fingerprints."""
        a, b = [], []
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[at, len(f)])
        small = np.repeat(sizes <= few, sizes)
        g, x = group[small], f[small]
        for d in range(1, few):
            same = np.flatnonzero(g[d:] == g[:-d]) if len(g) > d else []
            if not len(same):
                break
            near = same[_near(x[same], x[same + d], radius)]
            a.append(x[near])
            b.append(x[near + d])
        for i in np.flatnonzero(sizes > few):
            more = _absorb(f[at[i] : at[i] + sizes[i]], radius)
            a += more[0]
            b += more[1]
        ends = [np.concatenate(e).view(np.int64) if e else np.zeros(0, np.int64) for e in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

    def over(batches):
        """Batches are sorted by the group columns; the last group waits for the next batch."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            keys = [t.column(c).to_numpy() for c in ("choice", "cell", "i", "j")]
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            group = np.cumsum(new)
            whole = int(np.searchsorted(group, group[-1]))
            rest = t.slice(whole)
            if whole:
                yield of(group[:whole], t.column("fp").to_numpy()[:whole].view(np.uint64))
        if rest is not None:
            yield of(np.zeros(rest.num_rows, dtype=np.int64), rest.column("fp").to_numpy().view(np.uint64))

    return over


def near_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius``; fps: distinct (fp), n of them."""
    groups = next(g for most, g in GROUPS if n <= most) + max(0, radius - RADIUS)
    cells = _cells(fps, groups, radius)
    sizes = cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        cells.join(sizes, ["choice", "cell"])
        .withColumn("t", tile)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("choice", "cell", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp")
    )
    by = ["choice", "cell", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, spark: SparkSession, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (digest of the text), fp and component_id (smallest doc_id reachable), one row per row of ``docs``."""
    scratch = Scratch(spark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    prints = scratch.save(texts.mapInArrow(_fingerprints, f"doc_id {kind}, th long, fp long"), "prints")
    fps = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    links = scratch.save(near_links(fps.select("fp"), fps.count(), radius), "links")
    roots = components(links, scratch)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    # written sides: one component or fingerprint may hold a third of the rows, whose join Spark can split then
    least = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.save(rooted.join(small(least), "root").select("fp", "component_id"), "named")
    scratch.keep("prints", "named")
    return prints.join(small(named), "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, spark: SparkSession, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one for each component: the smallest id's (null ids last, ties by the text's digest)."""
    scratch = Scratch(spark)
    found = scratch.save(near_duplicates(docs, spark, radius), "found")
    # components without any id are told apart by their fingerprints' root, so group those by fingerprint
    own = F.when(F.col("component_id").isNull(), F.col("fp"))
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th").alias("at")
    rows = found.select(F.struct("component_id", own.alias("own")).alias("component"), at)
    firsts = rows.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = scratch.save(firsts, "firsts")
    d, t = fresh(docs, "doc", "th")
    # what goes is joined, not what stays: it is few rows, so that texts aren't exchanged
    gone = rows.join(small(firsts), "component").filter("at <> first").select(F.col("at.doc_id").alias(d), F.col("at.th").alias(t)).distinct()
    gone = small(scratch.save(gone, "gone"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone[d]) & F.xxhash64(docs["text"]).eqNullSafe(gone[t]), "left_anti")
    repeated = not found.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    scratch.keep("gone")
    return kept if not repeated else kept.dropDuplicates(["doc_id", "text"])
