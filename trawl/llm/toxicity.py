"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents whatever their label the
unlabelled. A linear classifier over hashed words (runs of letters in lower case, presence
only) minimises the class-prior-corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

in numpy; where the second term falls below zero its gradient is reversed, so that the
risk can't be driven negative by overfitting. The prior is the toxic share of the labels.

Only rows whose crc32(doc_id as text) mod 5 isn't 0 are learnt from, and only text enters
a score. Defined cases: null and empty texts get the score of a text without features;
without a single toxic label every score is the prior (0 with no labels). Labels that
repeat or disagree count as toxic if any says so. Extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.langid import remainder
from trawl.shipping import ship

ship(__name__)

#: Expected numbers of positives and of unlabelled documents that are learnt from.
POSITIVES, UNLABELLED = 4000, 8000
BITS, FEATURES, SEED = 20, 512, 11
#: Distinct words of a text of the sample.
MOST_WORDS = 4000
#: A feature occurs in this share of the positives at least, and is this many times as frequent as in the unlabelled.
SUPPORT, ENRICHED = 0.01, 4
STEPS, RATE, DECAY = 400, 0.05, 1e-4
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


_memo: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _memo:
        _memo["letters"] = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), dtype=bool)
    return _memo["letters"]


def features(text: str | None) -> np.ndarray:
    """Hashed words (runs of letters, lower case) of a whole text, in order, with repeats."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = np.r_[False, _letters()[c], False]
    starts = np.flatnonzero(letter[1:] & ~letter[:-1])
    ends = np.flatnonzero(~letter[1:] & letter[:-1])
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(c)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(c)]))
    h = c.astype(np.uint64) * _FACTORS[0] + place.astype(np.uint64) * _FACTORS[1]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[2]
    h ^= h >> np.uint64(32)
    sums = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]  # wraps around, as differences may
    h = (sums[ends] - sums[starts]) * _FACTORS[0]
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier over presence features, with logistic loss."""
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def grad(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        slope = (slope / len(rows)).astype(np.float32)
        return np.append(slope @ rows, slope.sum())

    for step in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        corrected = grad(u, _sigmoid(gu)) - prior * grad(p, _sigmoid(gp))
        g = prior * grad(p, _sigmoid(gp) - 1) + corrected if rest >= 0 else -corrected
        g[:-1] += DECAY * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - np.float32(move[-1])
    return w, float(b)


def _select(p: list[np.ndarray], u: list[np.ndarray]) -> np.ndarray:
    """The features most enriched among the positives, by the likelihood ratio of their document shares."""
    dp, du = (np.bincount(np.concatenate(x), minlength=1 << BITS) if x else np.zeros(1 << BITS) for x in (p, u))
    sp, su = (dp + 0.5) / (len(p) + 1), (du + 0.5) / (len(u) + 1)
    gain = np.where((dp >= max(3, SUPPORT * len(p))) & (sp > ENRICHED * su), dp * np.log(sp / su), 0)
    top = np.argsort(-gain, kind="stable")[:FEATURES]
    return top[gain[top] > 0]


def _presence(docs: list[np.ndarray], table: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(docs), n), np.float32)
    for i, d in enumerate(docs):
        f = table[d]
        x[i, f[f >= 0]] = 1
    return x


def _sample(texts: DataFrame, most: int) -> list:
    """Distinct features of at most ``most`` texts, cut where they are read, so that no text travels.

    A text of more distinct words than MOST_WORDS is represented by those of smallest hash,
    which bounds the sample in bytes; texts are scored by all their words.
    """

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                f = pa.array([np.unique(features(t))[:MOST_WORDS] for t in part.column(2).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), f], ["doc_id", "th", "f"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "th", "text").mapInArrow(over, f"doc_id {kind}, th long, f array<long>")
    return [r["f"] for r in rows.orderBy("doc_id", "th").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from a bounded sample; ``weights`` holds the weight of each hashed word."""
    known = (
        labels.filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    )
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    model = {"prior": prior, "weights": np.zeros(1 << BITS, np.float32), "bias": None}
    if not 0 < prior < 1:
        return model
    chance = lambda *c: F.pmod(F.xxhash64(*c, F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter((F.col("toxic") == 1) & (chance("doc_id") < min(1.0, POSITIVES / toxic))).select("doc_id").limit(2 * POSITIVES)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter(remainder(F.col("doc_id")) != 0)
    total = texts.count()
    # at most 2 * POSITIVES ids of 8 bytes
    pos = _sample(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), 2 * POSITIVES)
    unl = _sample(texts.filter(chance("doc_id", "th") < min(1.0, UNLABELLED / max(total, 1))), 2 * UNLABELLED)
    if not len(pos) or not len(unl):
        return model
    p, u = ([np.array(f, np.int64) for f in x] for x in (pos, unl))
    top = _select(p, u)
    table = np.full(1 << BITS, -1, np.int32)
    table[top] = np.arange(len(top))
    w, b = nnpu(_presence(p, table, len(top)), _presence(u, table, len(top)), prior)
    model["weights"][top], model["bias"] = w, b
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``."""
    ready = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    if model["bias"] is None:
        out = ready.select("doc_id", "held_out", F.lit(float(model["prior"])).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    hot = np.flatnonzero(model["weights"])
    weight, bias = model["weights"][hot].astype(np.float64), model["bias"]

    def apply(batches):
        table = np.full(1 << BITS, -1, np.int32)
        table[hot] = np.arange(len(hot))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                g = []
                for t in part.column(1).to_pylist():
                    f = table[features(t)]
                    g.append(bias + weight[np.unique(f[f >= 0])].sum())
                s = _sigmoid(np.array(g))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return ready.mapInArrow(apply, f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
