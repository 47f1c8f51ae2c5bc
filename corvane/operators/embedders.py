"""Embedders as Arrow-batched functions, and what models there are by name."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.errors import BackendUnavailableError

#: Models by name, whether they give multi-vectors, and other spellings.
MODELS = {"colmodernvbert": True, "colpali": True, "colqwen2": True, "modernvbert": False, "nomic": False, "tomoro-colqwen3": True}
MODEL_ALIASES = {"col-modernvbert": "colmodernvbert", "colqwen": "colqwen2", "colqwen3": "tomoro-colqwen3", "modern-vbert": "modernvbert", "nomic-dense": "nomic", "tomoro": "tomoro-colqwen3"}


def image_key(pixels: Column, width: Column, height: Column) -> Column:
    """What the deterministic embedder hashes of an image: its size and the first 8192 bytes."""
    return F.concat(F.concat(F.lit("img:"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")).cast("binary"), F.substring(pixels, 1, 8192))


class Embedder(ABC):
    """Texts or images to multi-vectors; a model is loaded once in each Python worker."""

    multi_vector = True

    @abstractmethod
    def embed(self, values: list[bytes]) -> list[np.ndarray]: ...

    @abstractmethod
    def embed_query(self, text: str) -> np.ndarray: ...

    def of_image(self, pixels: Column, width: Column, height: Column) -> Column:
        """What column() is given of an image."""
        return pixels

    def column(self, values: Column) -> Column:
        """array<array<float>> of a binary column."""
        own = self

        @F.pandas_udf("array<array<float>>")
        def run(xs: pd.Series) -> pd.Series:
            return pd.Series([[row.tolist() for row in np.atleast_2d(v)] for v in own.embed([bytes(x or b"") for x in xs])])

        return run(values)


class DeterministicEmbedder(Embedder):
    """Unit vectors from a generator that the value's SHA-256 seeds."""

    def __init__(self, dim: int = 32, num_tokens: int = 8, multi_vector: bool = True):
        if dim < 1 or num_tokens < 1:
            raise ValueError("dim and num_tokens must be positive")
        self.dim, self.num_tokens, self.multi_vector = dim, num_tokens, multi_vector

    def of_image(self, pixels: Column, width: Column, height: Column) -> Column:
        return image_key(pixels, width, height)

    def _vectors(self, key: bytes, n: int) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(key).digest()[:8], "little")
        rows = np.random.default_rng(seed).standard_normal((n, self.dim)).astype(np.float32)
        return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)

    def embed(self, values: list[bytes]) -> list[np.ndarray]:
        n = self.num_tokens if self.multi_vector else 1
        return [self._vectors(x, n).astype(np.float16).astype(np.float32) for x in values]

    def embed_query(self, text: str) -> np.ndarray:
        n = max(2, len(text.split())) if self.multi_vector else 1
        return self._vectors(b"query:" + text.encode(), n)


#: Bytes of texts whose tokens are told apart at once.
SLICE = 1 << 18
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


@lru_cache(50_000)
def _token_vector(token: str, dim: int) -> np.ndarray:
    digest = hashlib.sha256(token.encode()).digest()
    raw = np.array([digest[k % 32] / 127.5 - 1.0 for k in range(dim)])
    return raw / (np.linalg.norm(raw) or 1.0)


class BagEmbedder(Embedder):
    """One unit vector a text: the sum of its tokens' vectors; a query is embedded as a page is."""

    multi_vector = False

    def __init__(self, dim: int = 16):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = dim

    def embed(self, values: list[bytes]) -> list[np.ndarray]:
        return [*self._bags(values)]

    def embed_query(self, text: str) -> np.ndarray:
        return self._bags([text.encode()])[0]

    def _bags(self, values: list[bytes]) -> np.ndarray:
        """A row a text, slice by slice of SLICE bytes; a longer text is a slice of its own."""
        sizes, first, out = np.cumsum([len(x) for x in values]), 0, np.zeros((len(values), self.dim))
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE, side="right")))
            self._sum(values[first:last], out[first:last])
            first = last
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1.0, norm)

    def _sum(self, values: list[bytes], out: np.ndarray) -> None:
        lowered = [x.decode().lower().encode() for x in values]
        data = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)  # no token crosses a text's end
        edges = np.flatnonzero(np.diff(_IN_TOKEN[data].view(np.int8), prepend=np.int8(0)))
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in lowered]), edges[::2], side="right")
        empty = np.setdiff1d(np.arange(len(values)), text)
        if len(empty):
            out[empty] = _token_vector("<empty>", self.dim)
        if not len(edges):
            return
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()  # tokens, and between them what parts them
        codes, n = coded.indices.to_numpy()[::2], len(coded.dictionary)
        each, times = np.unique(text * n + codes, return_counts=True)
        used, at = np.unique(each % n, return_inverse=True)
        vectors = np.array([_token_vector(t.decode(), self.dim) for t in coded.dictionary.take(pa.array(used)).to_pylist()])
        some, begins = np.unique(each // n, return_index=True)
        for k in range(self.dim):  # a column at a time, so that a long text's vectors are not all there at once
            out[some, k] = np.add.reduceat(vectors[at, k] * times, begins)

    def column(self, values: Column) -> Column:
        """array<double> of a binary column."""
        own = self

        @F.arrow_udf("array<double>")
        def run(xs: pa.Array) -> pa.Array:
            found = own._bags([x or b"" for x in xs.to_pylist()])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * own.dim), pa.array(found.ravel()))

        # else a filter on the vectors is moved below them and makes them again
        return run.asNondeterministic()(values)


class ColourEmbedder(Embedder):
    """Patches of an RGB image as their colours, and words for colours as theirs: a model small enough to check by eye."""

    COLOURS = {"red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0)}

    def embed(self, values: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x[: len(x) // 3 * 3], np.uint8).reshape(-1, 3)[:256].astype(np.float32) / 255 for x in values]

    def embed_query(self, text: str) -> np.ndarray:
        found = [self.COLOURS[w] for w in text.lower().split() if w in self.COLOURS]
        return np.array(found or [(1 / 3,) * 3], np.float32)


def model_name(name: str) -> str:
    key = name.strip().lower()
    key = MODEL_ALIASES.get(key, key)
    if key not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return key


def get_embedder(name: str, **options) -> Embedder:
    """An embedder by name; those whose weights are not installed say so."""
    if name.strip().lower() == "deterministic":
        return DeterministicEmbedder(**options)
    if name.strip().lower() == "colours":
        return ColourEmbedder()
    if name.strip().lower() == "bag":
        return BagEmbedder(**options)
    raise BackendUnavailableError(f"{model_name(name)}: its weights are not installed")
