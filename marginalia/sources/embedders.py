"""Embedders: texts to vectors of length 1, in batches on the workers.

An embedder is built from a small configuration on every worker, once, so no model or connection travels with a task.
``hash`` needs nothing, ``remote`` calls a server with an OpenAI-style endpoint, ``local`` needs a sentence-transformers
installation.

Defined results: null texts have no vector; empty texts have the embedder's vector of an empty text (zeros for ``hash``);
a zero vector stays zero; vectors that aren't finite or of another length than the others are an error.
"""

from __future__ import annotations

import json
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from marginalia.operators.library import LibraryError
from marginalia.sources.documents import plan_batches


class Embedder(Protocol):
    """Documents have no prefix; a query has the model's instruction."""

    model_name: str
    dimension: int

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, zero rows as they are."""
    x = np.asarray(x, np.float64).reshape(len(x), -1)
    if not np.isfinite(x).all():
        raise LibraryError("invalid", "the embedder gave numbers that aren't finite")
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.where(length > 0, length, 1.0)).astype(np.float32)


def query_prefix(explicit: str | None, prompts: dict[str, str] | None = None) -> str:
    """What stands before a query: what is given, even if empty, else the model's own prompt, else nothing."""
    if explicit is not None:
        return explicit
    return (prompts or {}).get("query", "")


@dataclass
class HashEmbedder:
    """Trigrams of the lower-cased text, hashed into buckets and counted: a deterministic stand-in for a model."""

    dimension: int = 256
    prefix: str | None = None
    model_name: str = "hashed-trigrams"

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            low = text.lower()
            grams = [zlib.crc32(low[i : i + 3].encode("utf-8", "surrogatepass")) % self.dimension for i in range(len(low) - 2)]
            row += np.bincount(grams, minlength=self.dimension) if grams else 0
        return normalized(out)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([query_prefix(self.prefix) + text])[0]


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
        return r.read()


class RemoteEmbedder:
    """Batches over HTTP: retries with doubling pauses, answers put in order by ``index`` and counted."""

    def __init__(
        self, url: str, model_name: str, batch: int = 64, attempts: int = 4, prefix: str | None = None, key: str | None = None, timeout: float = 60.0,
        post: Callable[[str, bytes, dict[str, str], float], bytes] = _post, pause: Callable[[float], None] = time.sleep,
    ) -> None:
        self.url, self.model_name, self.batch, self.attempts, self.prefix, self.timeout = url.rstrip("/") + "/embeddings", model_name, batch, attempts, prefix, timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        self.post, self.pause, self._dimension = post, pause, None

    @property
    def dimension(self) -> int:
        """Asked of the server once."""
        if self._dimension is None:
            self._dimension = len(self._batch(["dimension"])[0])
        return self._dimension

    def _batch(self, texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model_name, "input": list(texts)}).encode()
        for attempt in range(self.attempts):
            try:
                data = json.loads(self.post(self.url, body, self.headers, self.timeout))["data"]
                break
            except Exception:
                if attempt + 1 == self.attempts:
                    raise
                self.pause(2.0**attempt)
        rows = [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        if len(rows) != len(texts) or len({len(r) for r in rows}) != 1 or (self._dimension or len(rows[0])) != len(rows[0]):
            raise LibraryError("invalid", f"{self.url} answered {len(rows)} vectors for {len(texts)} texts, or of unequal lengths")
        return rows

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        rows = [r for lo in range(0, len(texts), self.batch) for r in self._batch(texts[lo : lo + self.batch])]
        if not rows:
            return np.zeros((0, self.dimension), np.float32)
        self._dimension = len(rows[0])
        return normalized(np.array(rows))

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([query_prefix(self.prefix) + text])[0]


class LocalEmbedder:
    """A sentence-transformers model, if that is installed."""

    def __init__(self, model_name: str, prefix: str | None = None) -> None:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise LibraryError("invalid", "local models need sentence-transformers") from e
        self.model, self.model_name = SentenceTransformer(model_name), model_name
        self.prefix = query_prefix(prefix, getattr(self.model, "prompts", None))
        self.dimension = self.model.get_sentence_embedding_dimension()

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        return normalized(self.model.encode(list(texts), prompt=""))

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([self.prefix + text])[0]


_KINDS = {"hash": HashEmbedder, "remote": RemoteEmbedder, "openai": RemoteEmbedder, "local": LocalEmbedder}


def make(kind: str, **options) -> Embedder:
    if kind not in _KINDS:
        raise LibraryError("invalid", f"no embedder {kind!r}; there are {', '.join(sorted(_KINDS))}")
    return _KINDS[kind](**options)


def embed_rows(rows: DataFrame, kind: str, budget: int = 24_576, **options) -> DataFrame:
    """``rows`` (id, text) to id and embedding, in batches of similar lengths whose padded words stay within ``budget``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for f in frames:
            embedder = embedder or make(kind, **options)
            texts = f["text"].tolist()
            out: list = [None] * len(f)
            some = [i for i, t in enumerate(texts) if t is not None]
            for batch in plan_batches([len(texts[i].split()) for i in some], budget):
                for k, v in zip(batch, embedder.embed_documents([texts[some[k]] for k in batch])):
                    out[some[k]] = v
            yield pd.DataFrame({"id": f["id"], "embedding": out})

    return rows.selectExpr("cast(id as string) id", "text").mapInPandas(run, "id string, embedding array<float>")
