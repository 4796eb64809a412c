"""Embedding backends behind one interface, applied to Arrow batches.

A backend turns a list of texts into vectors. HTTP backends batch, retry with back-off and
honour Retry-After; they are created on the executors. ``MockEmbedder`` needs no network.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from trawl.shipping import ship

ship(__name__)

RETRIES, BASE_DELAY, MOST_DELAY = 3, 1.0, 30.0
CACHE = 1000
# Providers and models with dimensions and context sizes.
PROVIDERS = {"ollama": 768, "ollama-remote": 768, "openai": 1536, "voyage": 1024}
API_PROVIDERS = ("openai", "voyage")
MODELS = {"v2": (768, 8192), "v4": (1024, 32768)}
DEFAULT_MODEL = {"ollama": "v2", "ollama-remote": "v2"}


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbeddingError(RuntimeError):
    def __init__(self, message: str, retryable: bool = False, retry_after: float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after


def model_of(embedder: Embedder) -> str:
    """The model's name where there is one, so that two models of equal size are told apart."""
    return getattr(embedder, "model", "") or f"{embedder.name}-{embedder.dimensions}"


def embedder_for(provider: str, model: str = "", key: str = "", url: str = "", dimensions: int = 0) -> Embedder:
    """The backend a configuration names; blank settings take the provider's defaults."""
    if provider == "mock":
        return MockEmbedder(dimensions or 768)
    if provider not in PROVIDERS:
        raise EmbeddingError(f"unknown provider {provider}; one of {sorted(PROVIDERS)}")
    if provider in API_PROVIDERS and not key:
        raise EmbeddingError(f"{provider} needs a key")
    known = MODELS.get(model)
    size = dimensions or (known[0] if known else PROVIDERS[provider])
    made = {"openai": openai, "voyage": voyage, "ollama": ollama, "ollama-remote": ollama}[provider]
    args = {k: v for k, v in (("model", model or DEFAULT_MODEL.get(provider, "")), ("url", url)) if v}
    out = made(**args, **({"key": key} if provider in API_PROVIDERS else {}))
    return replace(out, dimensions=size, name=provider)


@dataclass(frozen=True)
class MockEmbedder:
    """Unit vectors from SHA-256: equal texts, equal vectors."""

    dimensions: int = 768
    name: str = "mock"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        digest = hashlib.sha256(text.encode()).digest()
        raw = [digest[i % 32] / 255 * 0.5 + i / self.dimensions * 0.5 for i in range(self.dimensions)]
        length = sum(x * x for x in raw) ** 0.5
        return [x / length for x in raw] if length else raw


def with_retry(call: Callable[[], list], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> list:
    """Tries again after retryable errors, waiting as told or ever longer."""
    for attempt in range(retries + 1):
        try:
            return call()
        except EmbeddingError as e:
            if not e.retryable or attempt == retries:
                raise
            sleep(e.retry_after if e.retry_after is not None else min(MOST_DELAY, BASE_DELAY * 2**attempt))
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class HttpEmbedder:
    """POSTs {model, input} and reads vectors from ``data[].embedding`` (ordered by index) or ``embeddings``."""

    url: str
    model: str
    dimensions: int
    key: str = ""
    extra: dict = field(default_factory=dict)
    timeout: float = 60.0
    name: str = "http"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return with_retry(lambda: self._post(texts)) if texts else []

    def _post(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": texts} | self.extra).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as r:
                got = json.load(r)
        except urllib.error.HTTPError as e:
            wait = e.headers.get("Retry-After") if e.headers else None
            raise EmbeddingError(f"status {e.code}", e.code == 429 or e.code >= 500, float(wait) if wait and wait.isdigit() else None) from e
        except OSError as e:
            raise EmbeddingError(str(e), True) from e
        vectors = [d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])] if "data" in got else got["embeddings"]
        if len(vectors) != len(texts):
            raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors


def openai(model: str = "text-embedding-3-small", key: str = "", url: str = "https://api.openai.com/v1/embeddings") -> HttpEmbedder:
    return HttpEmbedder(url, model, PROVIDERS["openai"], key, name="openai")


def voyage(model: str = "voyage-code-3", key: str = "", url: str = "https://api.voyageai.com/v1/embeddings") -> HttpEmbedder:
    return HttpEmbedder(url, model, PROVIDERS["voyage"], key, {"input_type": "document"}, name="voyage")


def ollama(model: str, url: str = "http://localhost:11434/api/embed") -> HttpEmbedder:
    return HttpEmbedder(url, model, PROVIDERS["ollama"], name="ollama")


class Cached:
    """The most recent vectors by text; only misses reach the backend."""

    def __init__(self, inner: Embedder, size: int = CACHE):
        self.inner, self.size, self.hits, self.misses = inner, size, 0, 0
        self.name, self.dimensions, self.model = inner.name, inner.dimensions, model_of(inner)
        self._kept: OrderedDict[str, list[float]] = OrderedDict()

    def embed(self, texts: list[str]) -> list[list[float]]:
        known = {t: self._kept[t] for t in texts if t in self._kept}
        wanted = [t for t in dict.fromkeys(texts) if t not in known]
        self.hits += sum(t in known for t in texts)
        self.misses += sum(t not in known for t in texts)
        known |= dict(zip(wanted, self.inner.embed(wanted), strict=True)) if wanted else {}
        for t in texts:
            self._kept[t] = known[t]
            self._kept.move_to_end(t)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return [known[t] for t in texts]


def embed_column(rows: DataFrame, embedder: Embedder, text: str = "content", batch: int = 64, element: str = "float") -> DataFrame:
    """``rows`` with an ``embedding`` column; stored vectors are floats, ``element`` "double" keeps what the backend returned."""

    def over(batches):
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in embedder.embed(texts[at : at + batch])]
            yield pdf.assign(embedding=pd.Series(vectors, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(over, f"{fields}, embedding array<{element}>")
