"""Language identification by a byte convolutional network.

Bytes are embedded, passed through filters of several widths, max-pooled over a window
of fixed length and classified by a softmax layer; everything is trained in numpy on a
bounded, hash-chosen sample of labelled rows. A text is cut into overlapping windows that
cover all of it, and its log-probabilities are the mean over its windows.

Learning uses text and non-null lang of rows whose crc32(doc_id as text) mod 5 isn't 0;
rows without an id are never learnt from. Defined cases: null texts and texts without a
letter are ``und`` with score 0; with no labelled row at all every text is ``und``.
Repeated rows yield repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.base import fresh
from trawl.shipping import ship

ship(__name__)

#: Labelled documents of each language that are learnt from (one window each), in expectation.
PER_LANGUAGE = 3000
#: Languages that are learnt.
MOST_LANGUAGES = 200
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
WIDEST = max(WIDTHS)
#: Passes over the sample; small samples are passed over more often, up to LEAST_STEPS batches.
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 5, 500, 64, 0.01, 7
UNDETERMINED = "und"


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


# --- the network ---------------------------------------------------------------------------


def _start(n_classes: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    embed[0] = 0  # padding
    # filters of every width share one matrix; rows beyond a filter's width stay zero
    conv = rng.normal(0, 0.3, (WIDEST * EMBED, FILTERS * len(WIDTHS))).astype(np.float32)
    mask = np.zeros_like(conv)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    n = conv.shape[1]
    return {"embed": embed, "conv": conv * mask, "mask": mask, "bias": np.zeros(n, np.float32), "out": rng.normal(0, 0.1, (n, n_classes)).astype(np.float32), "out_bias": np.zeros(n_classes, np.float32)}


def _columns(model: dict, x: np.ndarray) -> np.ndarray:
    """(windows, positions, WIDEST * EMBED) of embedded bytes."""
    e = model["embed"][x].reshape(len(x), -1)
    v = np.lib.stride_tricks.sliding_window_view(e, WIDEST * EMBED, axis=1)[:, ::EMBED]
    return np.ascontiguousarray(v)


def _pooled(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = _columns(model, x)
    r = (c.reshape(-1, c.shape[2]) @ model["conv"]).reshape(len(x), c.shape[1], -1)
    return r, c


def log_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    r, _ = _pooled(model, x)
    h = np.maximum(r.max(axis=1) + model["bias"], 0)
    z = h @ model["out"] + model["out_bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, n_classes: int) -> dict[str, np.ndarray]:
    """x: (n, WINDOW) bytes, y: class numbers."""
    model, rng = _start(n_classes), np.random.default_rng(SEED)
    learnt = ("embed", "conv", "bias", "out", "out_bias")
    m1 = {k: np.zeros_like(model[k]) for k in learnt}
    m2 = {k: np.zeros_like(model[k]) for k in learnt}
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(x), BATCH)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            xb, n = x[pick], len(pick)
            r, c = _pooled(model, xb)
            best = r.argmax(axis=1)
            top = np.take_along_axis(r, best[:, None], axis=1)[:, 0] + model["bias"]
            h = np.maximum(top, 0)
            z = h @ model["out"] + model["out_bias"]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p /= n
            dh = (p @ model["out"].T) * (top > 0)
            at_best = c[np.arange(n)[:, None], best]  # (n, filters, WIDEST * EMBED): only maxima pass gradients
            d_conv = np.einsum("nf,nfd->df", dh, at_best) * model["mask"]
            d_in = np.einsum("nf,df->nfd", dh, model["conv"]).reshape(n, -1, WIDEST, EMBED)
            seen = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDEST)]
            d_embed = np.zeros_like(model["embed"])
            np.add.at(d_embed, seen.reshape(-1), d_in.reshape(-1, EMBED))
            d_embed[0] = 0
            grads = {"embed": d_embed, "conv": d_conv, "bias": dh.sum(axis=0), "out": h.T @ p, "out_bias": p.sum(axis=0)}
            step += 1
            for k in learnt:
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                model[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items() if k != "mask"}


# --- texts ---------------------------------------------------------------------------------


def windows(raw: bytes) -> np.ndarray:
    """Overlapping windows over all bytes of a text, the last padded with zeros."""
    stride = WINDOW - (WIDEST - 1)
    n = max(1, -(-(len(raw) - (WIDEST - 1)) // stride))
    padded = np.zeros((n - 1) * stride + WINDOW, dtype=np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::stride]


def to_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def predict(model: dict, texts: list[str], at_once: int = 64) -> np.ndarray:
    """(texts, classes): mean log-probabilities over the windows of each text, normalised."""
    cut = [windows(to_bytes(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    x = np.concatenate(cut)
    total = np.zeros((len(texts), len(model["out_bias"])))
    for at in range(0, len(x), at_once):
        np.add.at(total, owner[at : at + at_once], log_probabilities(model, x[at : at + at_once]))
    mean = total / np.array([len(c) for c in cut])[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> tuple[list[str], dict]:
    """Languages and the network, from a bounded sample of the rows that may be learnt from.

    At most MOST_LANGUAGES languages are learnt, the most frequent ones. The dice are cast on
    id and text, so that rows under one id have their own; a limit holds whatever they say.
    """
    may = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id")) != 0))
    sizes = {r["lang"]: r["count"] for r in may.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return [], {}
    langs = sorted(sizes)
    rates = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / sizes[k])))])
    own = F.xxhash64("doc_id", "text")
    dice = F.pmod(F.xxhash64(own, F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    spot = F.pmod(F.xxhash64(own, F.lit(SEED + 1)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    # windows of many lengths, so that short texts are familiar too
    length = F.lit(WINDOW) - F.pmod(F.xxhash64(own, F.lit(SEED + 2)), F.lit(WINDOW - 16))
    rows = (
        may.filter(F.col("lang").isin(langs) & (dice < rates[F.col("lang")]))
        .select("doc_id", "lang", F.substring("text", (spot + 1).cast("int"), length.cast("int")).alias("part"), dice.alias("dice"))
        .orderBy("dice", "part")
        .limit(2 * PER_LANGUAGE * len(langs))
        .toPandas()
        .sort_values(["doc_id", "lang", "part"])
    )
    x = np.concatenate([windows(to_bytes(t)[:WINDOW])[:1] for t in rows["part"]])
    y = np.array([langs.index(v) for v in rows["lang"]])
    return langs, train(x, y, len(langs))


def identify(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and held_out, lang_pred, score; learns from ``docs`` itself."""
    langs, model = fit(docs)
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    (letter,) = fresh(docs, "letter")
    ready = docs.select(
        *[docs[c] for c in keep],
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter),
    )
    if not langs:
        return ready.drop(letter).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    schema = ready.drop(letter).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    at_text, at_letter, names = ready.columns.index("text"), ready.columns.index(letter), schema.names

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                some_letter = part.column(at_letter).to_pylist()
                some = [t for t, ok in zip(part.column(at_text).to_pylist(), some_letter, strict=True) if ok]
                p = predict(model, some) if some else np.zeros((0, len(langs)))
                found = iter(zip(p.argmax(axis=1), p.max(axis=1), strict=True))
                out = [next(found) if ok else None for ok in some_letter]
                pred = pa.array([langs[o[0]] if o else UNDETERMINED for o in out], pa.string())
                score = pa.array([float(o[1]) if o else 0.0 for o in out], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:at_letter], pred, score], names)

    return ready.mapInArrow(apply, schema)
