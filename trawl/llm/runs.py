"""Runs of characters of lines as DataFrame expressions: MinHash keys, exact similarity, shingles.

A line in UTF-32 has its runs at multiples of four bytes, so each is a slice whose XXH64 is
its digest; lines are handled in pieces of ``PIECE`` runs, so a line of any length is never
exploded from one array. No Python runs on the executors.

A key hashes ``rows`` minima, and a minimum is the digest next to a fixed point by exclusive
or. Digests divisible by ``EVERY`` come first in that order, so that only they are grouped
(each minimum is still a MinHash). A line with few of them varies more, so lines with fewer
than ``FEW`` such digests (counted in 64 bits) have keys of all their digests as well;
lines of up to ``SHORT`` runs have them from the start, in the same pass.

A line's sketch is a bitmap of its digests. Bits that two sketches don't share are digests
that the lines don't share, so pairs whose sketches differ too much can't be similar: no
estimate, and the others are compared exactly.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trawl.llm.base import BROADCAST_ROWS, Scratch, joined, let

#: (keys, rows): 8 keys of 3 minima, which pairs of similarity 0.8 miss in 0.3 %; 16 of 4, missed in 0.02 %.
COARSE, FINE = (8, 3), (16, 4)
PIECE = 1 << 14
EVERY, FEW, SHORT = 4, 16, 96
#: Longs of a sketch, a power of two.
SKETCH = 16
#: Rows of keys: of a line's sample, of a short line's sample, of all digests.
SAMPLED, BRIEF, WHOLE = 0, 1, 2
#: Pairs with a line of more characters are compared by exploded digests, the others by arrays.
LONG = 1 << 16


def _points(n: int) -> list[int]:
    """Points of 64 bits, apart in the upper bits."""
    rng = random.Random(n)
    return [((i << 64) // n) - (1 << 63) ^ rng.getrandbits(56) for i in range(n)]


class Characters:
    """The runs of ``run`` characters at every position of ``line``; a shorter line is its own."""

    def __init__(self, run: int, num: int, den: int):
        self.run, self.num, self.den = run, num, den

    def _digest(self, code: Column, i: Column) -> Column:
        return F.xxhash64(F.substring(code, i * 4 + 1, F.lit(4 * self.run)))

    def exploded(self, lines: DataFrame, *names: str, of: str = "line") -> DataFrame:
        """Columns ``names`` of ``lines``, h and first: a row for every run of ``of``."""
        last = F.greatest((F.length("_code") / 4).cast("int") - self.run, F.lit(0))
        at = F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("_at")
        pieces = lines.select(*names, F.encode(of, "UTF-32").alias("_code")).select(*names, "_code", last.alias("_last"), at)
        piece = F.substring("_code", F.col("_at") * 4 + 1, F.lit(4 * (PIECE + self.run - 1)))
        ends = F.least(F.col("_last") - F.col("_at"), F.lit(PIECE - 1))
        flat = pieces.select(*names, "_at", piece.alias("_piece"), ends.alias("_end"))
        flat = flat.select(*names, "_at", "_piece", F.explode(F.sequence(F.lit(0), F.col("_end"))).alias("_i"))
        return flat.select(*names, self._digest(F.col("_piece"), F.col("_i")).alias("h"), (F.col("_at") + F.col("_i") == 0).alias("first"))

    def _keys(self, flat: DataFrame, bands: tuple[int, int], *more: Column) -> DataFrame:
        """Of runs (d1, d2, kind, first, h, and n or not) the keys of each line and kind; without n, the lines' number."""
        n, rows = bands
        own = ["n"] if "n" in flat.columns else []
        number = [] if own else [F.count_if("first").alias("n")]
        least = [F.min(F.col("h").bitwiseXOR(F.lit(p))).alias(f"_m{i}") for i, p in enumerate(_points(n * rows))]
        found = flat.groupBy("d1", "d2", *own, "kind").agg(*least, *number, *more)
        whole = (F.col("kind") == WHOLE).cast("int") * n
        # neighbouring points go to different keys
        keys = [F.when(F.col("_m0").isNotNull(), F.xxhash64(whole + i, *[f"_m{i + r * n}" for r in range(rows)])) for i in range(n)]
        return found.select("d1", "d2", "n", *[k.alias(f"k{i}") for i, k in enumerate(keys)], *[c for c in found.columns if c in ("kind", "few")])

    def keyed(self, lines: DataFrame, bands: tuple[int, int], scratch: Scratch, name: str) -> DataFrame:
        """(id, n, k0, k1, ...) of (id, n, line), or of (id, line) that may repeat; short lines and those with few digests in the sample have two rows of different keys."""
        plain, own = {"parquet.enable.dictionary": "false"}, ["n"] if "n" in lines.columns else []
        flat = lines.select("id.d1", "id.d2", *own, "line")
        kinds = F.when(F.length("line") < SHORT + self.run, F.array(F.lit(BRIEF), F.lit(WHOLE))).otherwise(F.array(F.lit(SAMPLED)))
        runs = self.exploded(flat.select("d1", "d2", *own, "line", F.explode(kinds).alias("kind")), "d1", "d2", *own, "kind")
        taken = (F.col("h").bitwiseAND(F.lit(EVERY - 1)) == 0) | (F.col("kind") == WHOLE)
        # the first run stands for a line that has no digest in the sample
        some = runs.filter(F.col("first") | taken).select("d1", "d2", *own, "kind", "first", F.when(taken, F.col("h")).alias("h"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63)).cast("int"))
        few = F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)) < FEW
        seen, poor = Observation(), (F.col("kind") == SAMPLED) & F.col("few")
        found = self._keys(some, bands, few.alias("few")).observe(seen, F.count_if(poor).alias("n"))
        found = scratch.save(found, f"{name}-some", plain)
        keys = [F.struct("d1", "d2").alias("id"), "n", *[f"k{i}" for i in range(bands[0])]]
        weak, number = found.filter(poor).select("d1", "d2"), seen.get["n"]
        if not number:
            return found.select(*keys)
        weak = F.broadcast(weak) if number <= BROADCAST_ROWS else weak
        runs = self.exploded(flat.join(weak, ["d1", "d2"], "left_semi"), "d1", "d2", *own).withColumn("kind", F.lit(WHOLE))
        every = scratch.save(self._keys(runs, bands), f"{name}-every", plain)
        return found.select(*keys).union(every.select(*keys))

    def sketched(self, lines: DataFrame) -> DataFrame:
        """(id, size, b0, b1, ...) of (id, line): the number of runs, which bounds that of digests, and a bitmap of the digests."""
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit")
        word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SKETCH - 1)).alias("word")
        flat = self.exploded(lines.select("id.d1", "id.d2", "line"), "d1", "d2").select("d1", "d2", bit, word)
        maps = [F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0)).alias(f"b{k}") for k in range(SKETCH)]
        found = flat.groupBy("d1", "d2").agg(F.count("*").alias("size"), *maps)
        return found.select(F.struct("d1", "d2").alias("id"), "size", *[f"b{k}" for k in range(SKETCH)])

    def possible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches don't rule out a similarity of num / den.

        Sets of n and m digests, d of them in one only, have (n + m - d) / 2 in common.
        """
        for end in "ab":
            pairs = joined(pairs, end, sketches.select("id", *[F.col(k).alias(f"{end}_{k}") for k in sketches.columns[1:]]))
        apart = sum(F.bit_count(F.col(f"a_b{k}").bitwiseXOR(F.col(f"b_b{k}"))) for k in range(SKETCH))
        near = (self.den + self.num) * apart <= (self.den - self.num) * (F.col("a_size") + F.col("b_size"))
        return pairs.filter(near).select("a", "b")

    def _digests(self, line: str) -> Column:
        """An array of the digests of all runs."""
        places = lambda code: F.sequence(F.lit(1), F.greatest(F.length(code) - 4 * self.run, F.lit(0)) + 1, F.lit(4))
        return let(F.encode(line, "UTF-32"), lambda code: F.transform(places(code), lambda at: F.xxhash64(F.substring(code, at, F.lit(4 * self.run)))))

    def similar(self, both: DataFrame, longest: int | None = None) -> DataFrame:
        """The pairs (a, b) of (a, b, x, y) whose exact Jaccard similarity is num / den or more.

        ``longest`` is the most characters of a line, if known: without long lines, the joins that ``both`` stands for run once instead of twice.
        """
        if longest is not None and longest <= LONG:
            return self._near(both)
        long = F.greatest(F.length("x"), F.length("y")) > LONG
        more = both.filter(long)
        sides = [self.exploded(more, "a", "b", of=c).select("a", "b", "h", F.lit(k).alias("side")) for k, c in enumerate("xy")]
        each = sides[0].union(sides[1]).groupBy("a", "b", "h").agg((F.min("side") < F.max("side")).cast("int").alias("shared"))
        sums = each.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.count("*").alias("union"))
        return self._near(both.filter(~long)).union(sums.filter(self.den * F.col("shared") >= self.num * F.col("union")).select("a", "b"))

    def _near(self, both: DataFrame) -> DataFrame:
        """``similar`` for lines that aren't long."""
        # exploded, so that the arrays are computed once
        sets = both.select("a", "b", F.inline(F.array(F.struct(self._digests("x").alias("u"), self._digests("y").alias("v")))))
        sets = sets.select("a", "b", "u", "v", F.explode(F.array(F.size(F.array_intersect("u", "v")))).alias("s"))
        # runs that repeat count once in the union: it is no larger than this, and found only where that doesn't do
        most, union = F.size("u") + F.size("v") - F.col("s"), F.size(F.array_union("u", "v"))
        return sets.filter((self.den * F.col("s") >= self.num * most) | (self.den * F.col("s") >= self.num * union)).select("a", "b")

    def shingles(self, lines: DataFrame, *names: str, longest: int | None = None) -> DataFrame:
        """Columns ``names`` and h: the distinct digests of each line; ``longest`` as for ``similar``."""
        long = F.length("line") > LONG
        none = longest is not None and longest <= LONG
        flat = (lines if none else lines.filter(~long)).select(*names, F.explode(F.array_distinct(self._digests("line"))).alias("h"))
        return flat if none else flat.union(self.exploded(lines.filter(long), *names).select(*names, "h").distinct())
