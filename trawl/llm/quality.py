"""Quality rules with thresholds that adapt to each language and source.

Every document gets integer rates (mean word length, symbol share, share of repeated
lines and of words in repeated windows). Their distribution in each (language, source)
is kept as a mergeable quantile sketch: a histogram over buckets whose width is at most
1/32 of their value, so that merging two sketches adds their counts. Sketches of small
groups are replaced by their language's, or by the whole corpus's, which are merged from
the groups'. Thresholds are quantiles of the sketches and nothing else: Tukey fences on the
quartiles where these differ; where they don't, as for rates that are zero in most documents,
the quantile ``TAIL`` (so that a rule takes a hundredth of its group at most). A join
brings them back to the documents.

Defined cases: a null or empty text has no words and fails the base rule; null languages
and sources form groups of their own; repeated rows yield repeated rows; an empty table
yields none. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.base import WORD, Scratch, let, words

SYMBOLS = r"[#*$%&|<>]"
#: rate -> whether low values are outliers too
RATES = {
    "word_length": True,  # hundredths of a character
    "symbols": False,  # ten-thousandths of the characters in words
    "dup_lines": False,  # ten-thousandths of the lines with words
    "repeats": False,  # ten-thousandths of the words
}
#: Quartile distances of the fences, and the tail in hundredths.
FENCE, TAIL = 3, 1
#: Groups with fewer documents use the thresholds of their language, or of all documents.
MIN_GROUP = 20
#: Groups (some 100 bytes) whose thresholds may be broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 100_000


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words of ``w`` that lie in ``size``-word windows found twice or more, the first included.

    Window digests are sorted with their positions, so equal ones become neighbours; the
    starts found are put in order and each adds the words up to the next, at most ``size``.
    """

    def marked(t: Column) -> Column:
        n = F.size(t)
        twin = F.filter(
            t,
            lambda x, k: ((k > 0) & (F.get(t, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(t, k + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        t = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(t, lambda t: let(marked(t), covered))
        )

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) < size + 1, F.lit(0)).otherwise(let(windows, of)).cast("long")


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the base rule and n_lines, one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    got = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    n_symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return docs.select("doc_id", "lang", "source", got.alias("w"), line.alias("l"), n_symbols.alias("n_symbols")).select(
        "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines"
    )


def _rates(features: DataFrame) -> DataFrame:
    def share(a: str, b: str, unit: int) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"{unit} * {a} div {b}")).otherwise(F.lit(0).cast("long"))

    return (
        features.withColumn(
            "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        )
        .withColumn("word_length", share("word_chars", "n_words", 100))
        .withColumn("symbols", share("n_symbols", "word_chars", 10000))
        .withColumn("dup_lines", share("n_dup_lines", "n_lines", 10000))
        .withColumn("repeats", share("n_repeat_words", "n_words", 10000))
    )


def sketch(rated: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, rate, bucket, n); merging is adding n."""
    pairs = ", ".join(f"'{r}', {r}" for r in RATES)
    return (
        rated.filter("not base_failed")
        .selectExpr("lang", "source", f"stack({len(RATES)}, {pairs}) as (rate, v)")
        .withColumn("s", F.expr("greatest(length(bin(v)) - 6, 0)"))
        .withColumn("bucket", F.expr("s * 32 + shiftright(v, s)"))
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


#: name -> share in hundredths, and whether a bucket's upper end stands for it
QUANTILES = {"bottom": (TAIL, False), "q1": (25, False), "q3": (75, False), "top": (100 - TAIL, True)}


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merged over ``keys``: group size and QUANTILES of each rate, in one row."""
    group = [*keys, "rate"]
    merged = sketches.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    # a rate has some two thousand buckets at most, so a group's rows fit one task
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        merged.withColumn("upto", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
        .withColumn("s", F.expr("if(bucket < 64, 0L, bucket div 32 - 1)"))
        .withColumn("low", F.expr("shiftleft(bucket - s * 32, cast(s as int))"))
        .withColumn("high", F.expr("shiftleft(bucket - s * 32 + 1, cast(s as int)) - 1"))
    )
    found = [
        F.min(F.when((F.col("rate") == r) & (100 * F.col("upto") >= share * F.col("total")), F.col("high" if upper else "low"))).alias(f"{r}_{q}")
        for r in RATES
        for q, (share, upper) in QUANTILES.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), *found)


def thresholds(sketches: DataFrame) -> DataFrame:
    """(t_lang, t_source) -> low and high threshold of each rate."""
    own, lang = _quantiles(sketches, ["lang", "source"]), _quantiles(sketches, ["lang"])
    names = [c for c in own.columns if c not in ("lang", "source")]
    every = _quantiles(sketches, []).first()  # one row
    lang = lang.select(F.col("lang").alias("l_lang"), *[F.col(c).alias(f"l_{c}") for c in names])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")

    def pick(c: str) -> Column:
        return (
            F.when(F.col("total") >= MIN_GROUP, F.col(c))
            .when(F.col("l_total") >= MIN_GROUP, F.col(f"l_{c}"))
            .otherwise(F.lit(every[c]).cast("long"))
        )

    limits = []
    for r, low in RATES.items():
        bottom, q1, q3, top = (pick(f"{r}_{q}") for q in QUANTILES)
        limits.append(F.when(q3 > q1, q3 + FENCE * (q3 - q1)).otherwise(top).alias(f"{r}_high"))
        limits.append((F.when(q3 > q1, q1 - FENCE * (q3 - q1)).otherwise(bottom) if low else F.lit(-1).cast("long")).alias(f"{r}_low"))
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *limits)


def judge(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Counts, rates, base verdict and final verdict ``kept``, one row per row of ``docs``."""
    scratch = Scratch(spark)
    rated = scratch.save(_rates(base_features(docs)), "rated")
    sketches = scratch.save(sketch(rated), "sketches")
    # written, so that beyond the bound a hot group's documents can be split over tasks
    limits = scratch.save(thresholds(sketches), "limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    within = F.lit(True)
    for r in RATES:
        within = within & F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return rated.join(limits, same, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(*rated.columns, "kept")
