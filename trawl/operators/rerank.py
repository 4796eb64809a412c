"""Heuristic re-ranking by transparent signals, and the choice between re-rankers."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import scoring


def signals(query: str, now: Column) -> dict[str, Column]:
    """Signals over name, content, path, chunk_type and modified_at."""
    return {
        "name_match": scoring.name_match(F.col("name"), query),
        "exact_phrase": scoring.exact_phrase(F.col("content"), query),
        "path_match": scoring.path_match(F.col("path"), query),
        "test_penalty": scoring.test_penalty(F.col("path")),
        "recency": scoring.recency(F.col("modified_at"), now),
        "chunk_type": scoring.chunk_type_signal(F.col("chunk_type"), query),
    }


def with_signals(candidates: DataFrame, query: str, now: Column) -> DataFrame:
    return candidates.withColumns(signals(query, now))


def rerank(candidates: DataFrame, query: str, now: Column) -> DataFrame:
    """Adds the signals, their map of non-zero ones and ``final_score``; best first, then chunk id."""
    out = with_signals(candidates, query, now)
    final = F.round(scoring.final_score(F.col("base_score"), [F.col(s) for s in scoring.SIGNALS]), 9)
    pairs = F.create_map(*[x for s in scoring.SIGNALS for x in (F.lit(s), F.col(s))])
    out = out.withColumn("final_score", final).withColumn("signal_scores", F.map_filter(pairs, lambda _, v: v != 0))
    return out.orderBy(F.desc("final_score"), "chunk_id")


Reranker = Callable[[DataFrame, str, Column], DataFrame]


@dataclass
class FallbackReranker:
    """The primary where it is available and done in time, else the secondary.

    Plans are lazy, so the primary's results are computed within the attempt: at most
    ``candidates`` rows, the most a re-ranker is given.
    """

    primary: Reranker
    secondary: Reranker = rerank
    available: Callable[[], bool] = lambda: True
    timeout: float = 2.0
    candidates: int = 20

    def __call__(self, candidates: DataFrame, query: str, now: Column) -> DataFrame:
        if self.available():
            pool = ThreadPoolExecutor(1)
            try:
                few = candidates.orderBy(F.desc("base_score"), "chunk_id").limit(self.candidates)
                return pool.submit(self._computed, few, query, now).result(self.timeout)
            except Exception:  # any failure of a foreign re-ranker, or its delay, falls back
                pass
            finally:
                pool.shutdown(wait=False)
        return self.secondary(candidates, query, now)

    def _computed(self, candidates: DataFrame, query: str, now: Column) -> DataFrame:
        out = self.primary(candidates, query, now)
        return out.sparkSession.createDataFrame(out.collect(), out.schema)
