"""Connected components of an edge table, as a distributed union-find.

Alternates the large-star and small-star contractions until every node points at the
smallest node of its component. Only DataFrame operations: neighbourhoods are reduced to
their minimum by partial aggregation and never gathered, so a component of any size is
contracted without one task holding it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trawl.llm.base import BROADCAST_ROWS, Scratch, numbered, small


def _parents(edges: DataFrame, few: bool, scratch: Scratch, name: str) -> DataFrame:
    """(at, top): the smallest smaller neighbour of every node; broadcast if there are ``few`` edges.

    Beyond that bound it is written, so that both sides of its joins are exchanged for the
    join alone and Spark can split a hub's edges over tasks.
    """
    up = edges.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("top"))
    return F.broadcast(up) if few else small(scratch.save(up, name))


def _large_star(edges: DataFrame, up: DataFrame) -> DataFrame:
    """Every node goes to the smallest node its smaller neighbours know."""
    return edges.join(up, edges["lo"] == up["at"], "left").select("hi", F.coalesce("top", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, up: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node itself, go to the smallest of them."""
    both = edges.join(up, edges["hi"] == up["at"]).select(
        F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("top").alias("lo")), F.struct("hi", F.col("top").alias("lo")))).alias("e")
    )
    return both.select("e.hi", "e.lo").filter("hi <> lo").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the root of its component.

    Self loops, repeated edges and either direction are fine; null ends are dropped.
    """

    def save(df: DataFrame, at: int) -> tuple[DataFrame, dict]:
        """The edges as written, and by the same job their number and digests."""
        seen, xor = Observation(), [F.bit_xor(F.xxhash64(*ends)).alias("".join(ends)) for ends in (("hi", "lo"), ("lo", "hi"))]
        return scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *xor), f"{name}-{at}"), seen.get

    now, seen = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), 0)
    state, round_ = None, 0
    while True:
        if seen == state or seen["n"] == 0:
            return numbered(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")), seen["n"])
        state, round_ = seen, round_ + 1
        few = seen["n"] <= BROADCAST_ROWS  # parents are no more than edges
        large = _large_star(now, _parents(now, few, scratch, f"{name}-up"))
        large = large if few else scratch.save(large, f"{name}-large")
        now, seen = save(_small_star(large, _parents(large, few, scratch, f"{name}-down")), round_)
        scratch.drop(*[n for n in (f"{name}-{round_ - 1}", f"{name}-up", f"{name}-large", f"{name}-down") if n in scratch.paths])
