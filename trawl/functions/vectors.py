"""Vector expressions: distances, norms, scores and a deterministic stand-in embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_MODES = ("service", "hybrid", "daemon")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def similarity(distance: Column, mode: str = "service") -> Column:
    """Score of a distance: service 1/(1+d), 1 for d <= 0; hybrid 1-d; daemon max(0, 1-d/2)."""
    if mode == "service":
        return F.when(distance <= 0, 1.0).otherwise(1 / (1 + distance))
    if mode == "hybrid":
        return 1 - distance
    if mode == "daemon":
        return F.greatest(F.lit(0.0), 1 - distance / 2)
    raise ValueError(f"unknown score mode {mode!r}; one of {SCORE_MODES}")


def mock_embedding(text: Column, dims: int = 768) -> Column:
    """Unit vector from the bytes of the text's SHA-256: byte/255 * 0.5 + i/dims * 0.5, normalised."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)

    def byte(i: Column) -> Column:
        pair = F.substring(digest, 2 * (i % 32) + 1, F.lit(2))
        return F.conv(pair, 16, 10).cast("double")

    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i) / 255 * 0.5 + i.cast("double") / dims * 0.5)
    length = F.transform(F.array(raw), lambda r: F.sqrt(_sum(F.transform(r, lambda x: x * x))))[0]
    return F.transform(F.array(F.struct(raw.alias("r"), length.alias("n"))), lambda s: F.transform(s["r"], lambda x: x / s["n"]))[0]
