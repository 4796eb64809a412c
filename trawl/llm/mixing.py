"""Mixing sources to target weights by iterative proportional fitting.

Tokens are tabulated by (source, lang, topic). Raking scales the table's cells in turn until
its source, language and topic marginals meet their targets, within ``TOLERANCE`` of each;
a cell's weight is its fitted over its actual tokens. Documents are sampled with probability
min(1, c * weight), where c is calibrated so that the expected tokens equal the budget, by a
digest of their id, so that a document's fate doesn't depend on order or partitioning.

Targets are tables (value, share) of each margin, normalised over the values that have
tokens; values they don't name get nothing. A margin without targets is tempered: a share s
becomes s^t, normalised, with t of ``TEMPER``, which damps hot sources and languages. The
topic is a column of the documents or any expression; where there is neither, ``genre`` gives
a coarse one. Targets that no weighting of the cells meets (a topic that only exists in a
source that is to vanish, say) raise ``NoFit``.

The table has a row for each combination of categories, however many documents there are.
Counted and small, it is raked and calibrated at the driver; beyond ``DRIVER_CELLS`` the same
steps are sums and joins of DataFrames.

Defined cases: null sources, languages and topics are categories of their own; documents
without words, or of weight 0, have probability 0 and are never sampled; a null id is sampled
by the digest of its text; rows with equal ids share their fate; an empty table yields none.
The columns of the input stay, but those named like added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.base import Scratch, fresh, words

#: Margins, and the power their shares are raised to where they have no targets (1: as they are).
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
MARGINS = tuple(TEMPER)
BUDGET, SEED = 0.7, "mix-1"
#: Largest relative distance of a fitted marginal from its target, and the most rounds to get there.
TOLERANCE, MOST_ROUNDS = 1e-12, 2000
#: Calibrations settle once no further cell is sampled for sure.
MOST_CALIBRATIONS = 200
#: Cells (some 100 bytes) that may be collected and broadcast to the documents.
DRIVER_CELLS = 100_000
ADDED = ("topic", "n_tokens", "weight", "probability", "kept")


class NoFit(ValueError):
    """The targets contradict each other on the cells there are."""


def genre(text: Column) -> Column:
    """A coarse topic of texts: tables, symbol-laden, emphatic or plain prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("***") | text.contains("$$$"), "symbols")
        .when(text.contains("!!"), "emphatic")
        .otherwise("prose")
    )


def _settled(shares: list[float]) -> list[float]:
    total = math.fsum(shares)
    return [s / total for s in shares] if total > 0 else shares


# --- small tables, at the driver -----------------------------------------------------------


def _rake(cells: list[tuple], targets: dict[str, dict]) -> list[float]:
    """Fitted tokens of each cell (source, lang, topic, tokens)."""
    total = float(sum(c[-1] for c in cells))
    fitted = [float(c[-1]) for c in cells]
    want, place = [], []
    for k, m in enumerate(MARGINS):
        tokens: dict = {}
        for c in cells:
            tokens[c[k]] = tokens.get(c[k], 0) + c[-1]
        values = list(tokens)
        given = targets.get(m)
        shares = [given.get(v, 0.0) for v in values] if given is not None else [float(tokens[v]) ** TEMPER[m] for v in values]
        want.append([total * s for s in _settled(shares)])
        number = {v: i for i, v in enumerate(values)}
        place.append([number[c[k]] for c in cells])
    for _ in range(MOST_ROUNDS):
        off = 0.0
        for goal, at in zip(want, place, strict=True):
            sums = [0.0] * len(goal)
            for f, i in zip(fitted, at, strict=True):
                sums[i] += f
            factor = [g / s if s > 0 else 0.0 for g, s in zip(goal, sums, strict=True)]
            off = max([off, *(abs(s - g) / g if g > 0 else 0.0 for g, s in zip(goal, sums, strict=True))])
            fitted = [f * factor[i] for f, i in zip(fitted, at, strict=True)]
        if off <= TOLERANCE:
            return fitted
    raise NoFit(f"after {MOST_ROUNDS} rounds a marginal is still {off:.3g} from its target")


def _calibrate(tokens: list[int], weights: list[float]) -> float:
    """c such that the sum of tokens * min(1, c * weight) is the budget."""
    c, budget, sure = 0.0, BUDGET * sum(tokens), -1
    for _ in range(MOST_CALIBRATIONS):
        full = [c * w >= 1 for w in weights]
        rest = math.fsum(t * w for t, w, f in zip(tokens, weights, full, strict=True) if not f)
        if sum(full) == sure or not rest:
            break
        sure = sum(full)
        c = (budget - sum(t for t, f in zip(tokens, full, strict=True) if f)) / rest
    return c


# --- large tables --------------------------------------------------------------------------


def _rake_apart(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """The same over a table of any size: source, lang, topic, tokens, fitted."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    now, goals = cells.withColumn("fitted", F.col("tokens").cast("double")), {}
    for m in MARGINS:
        own = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("t"))
        if m in targets:
            given = targets[m].groupBy(F.col("value").alias("_v")).agg(F.sum("share").alias("share"))
            own = own.join(given, F.col("value").eqNullSafe(F.col("_v")), "left").select("value", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            own = own.select("value", F.pow(F.col("t").cast("double"), F.lit(TEMPER[m])).alias("share"))
        own = scratch.save(own, f"target-{m}")
        every = own.agg(F.sum("share")).first()[0]
        goals[m] = own.select(F.col("value").alias("_value"), (F.col("share") * (total / every if every else 0.0)).alias("_goal"))
    last = None
    for round_ in range(MOST_ROUNDS):
        off = 0.0
        for m in MARGINS:
            sums = now.groupBy(F.col(m).alias("_of")).agg(F.sum("fitted").alias("_sum"))
            factor = sums.join(goals[m], F.col("_of").eqNullSafe(F.col("_value"))).select("_of", "_goal", "_sum", F.when(F.col("_sum") > 0, F.col("_goal") / F.col("_sum")).otherwise(0.0).alias("_factor"))
            factor = scratch.save(factor, f"factor-{m}-{round_}")
            off = max(off, factor.agg(F.max(F.when(F.col("_goal") > 0, F.abs(F.col("_sum") - F.col("_goal")) / F.col("_goal")))).first()[0] or 0.0)
            # a hot value's cells can be split over tasks, as the factors are written
            now = now.join(factor.select("_of", "_factor"), F.col(m).eqNullSafe(F.col("_of"))).select(*MARGINS, "tokens", (F.col("fitted") * F.col("_factor")).alias("fitted"))
        now = scratch.save(now, f"fitted-{round_}")
        if last:
            scratch.drop(*last)
        last = [f"fitted-{round_}", *(f"factor-{m}-{round_}" for m in MARGINS)]
        if off <= TOLERANCE:
            return now
    raise NoFit(f"after {MOST_ROUNDS} rounds a marginal is still {off:.3g} from its target")


def _calibrate_apart(weighted: DataFrame) -> float:
    c, sure = 0.0, -1
    for _ in range(MOST_CALIBRATIONS):
        full = c * F.col("weight") >= 1
        total, n, held, rest = weighted.agg(
            F.sum("tokens"),
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == sure or not rest:
            break
        sure = n
        c = (BUDGET * total - held) / rest
    return c


# --- documents -----------------------------------------------------------------------------


def odds(cells: DataFrame, spark: SparkSession, targets: dict[str, DataFrame] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """source, lang, topic, weight and odds of every cell of ``cells`` (source, lang, topic, tokens > 0)."""
    targets = targets or {}
    scratch = scratch or Scratch(spark)
    kinds = {m: cells.schema[m].dataType.simpleString() for m in MARGINS}
    schema = ", ".join([*(f"{m} {k}" for m, k in kinds.items()), "weight double", "odds double"])
    rows = cells.select(*MARGINS, "tokens").limit(DRIVER_CELLS + 1).collect()
    if not rows:
        return spark.createDataFrame([], schema)
    if len(rows) <= DRIVER_CELLS:
        rows = sorted(map(tuple, rows), key=repr)
        # targets are joined with the cells' values, so no more of them are collected than cells
        named = {m: cells.select(F.col(m).alias("value")).distinct().join(t, "value").groupBy("value").agg(F.sum("share").alias("share")) for m, t in targets.items()}
        fitted = _rake(rows, {m: {r["value"]: float(r["share"]) for r in t.collect()} for m, t in named.items()})
        weights = [f / r[-1] for f, r in zip(fitted, rows, strict=True)]
        c = _calibrate([r[-1] for r in rows], weights)
        return F.broadcast(spark.createDataFrame([(*r[:-1], w, min(1.0, c * w)) for r, w in zip(rows, weights, strict=True)], schema))
    fitted = _rake_apart(cells, targets, scratch).select(*MARGINS, "tokens", (F.col("fitted") / F.col("tokens")).alias("weight"))
    fitted = scratch.save(fitted, "weights")
    c = _calibrate_apart(fitted)
    return scratch.save(fitted.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * c).alias("odds")), "odds")


def dice(doc_id: Column, text: Column) -> Column:
    """Uniform in [0, 1) from 52 bits of a digest of the id."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{SEED}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, spark: SparkSession, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with topic, n_tokens, weight, probability and kept.

    targets: margin -> (value, share). topic: an expression over ``docs``.
    """
    scratch = Scratch(spark)
    if topic is None:
        topic = F.col("topic") if "topic" in docs.columns else genre(F.coalesce("text", F.lit("")))
    rest = [c for c in docs.columns if c.lower() not in ADDED]
    ready = docs.select(*[docs[c] for c in rest], topic.alias("topic"), F.size(words(docs["text"])).cast("long").alias("n_tokens"))
    cells = ready.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    found = odds(scratch.save(cells, "cells"), spark, targets, scratch)
    names = dict(zip((*MARGINS, "weight", "odds"), fresh(ready, *MARGINS, "weight", "odds"), strict=True))
    found = found.withColumnsRenamed(names)
    same = [ready[m].eqNullSafe(found[names[m]]) for m in MARGINS]
    has = F.col("n_tokens") > 0
    return (
        ready.join(found, same, "left")
        .withColumn("weight", F.when(has, found[names["weight"]]).otherwise(0.0))
        .withColumn("probability", F.when(has, found[names["odds"]]).otherwise(0.0))
        .withColumn("kept", dice(F.col("doc_id"), F.col("text")) < F.col("probability"))
        .select(*[f"`{c}`" for c in rest], *ADDED)
    )
