"""Embedders: what turns texts into vectors. Any object with ``embed(texts, dim)`` will do."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import EMBEDDING_MODEL

DIM = 64
WORD = re.compile(r"\w{2,}")


class Embedder(Protocol):
    def embed(self, texts: list[str], dim: int) -> np.ndarray: ...


@lru_cache(1 << 16)
def _hash(piece: str) -> int:
    return zlib.crc32(piece.encode())


def _hashed(words: Iterable[str], dim: int) -> np.ndarray:
    """Counts of words and their letter trigrams by hash, a row each; whole numbers, so sums do not depend on their order. Each
    different trigram is hashed once."""
    words = list(words)
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.repeat(np.cumsum(sizes + 2) - sizes - 2 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    codes, place = np.unique(letters[first] << 42 | letters[first + 1] << 21 | letters[first + 2], return_inverse=True)
    low = (1 << 21) - 1
    pieces = [_hash(chr(c >> 42) + chr(c >> 21 & low) + chr(c & low)) for c in codes.tolist()]
    h = np.concatenate((np.array(pieces)[place], [zlib.crc32(w.encode()) for w in words]))
    at = np.concatenate((np.repeat(np.arange(len(words)), sizes), np.arange(len(words)))) * dim + h % dim
    return np.bincount(at, np.where(h >> 16 & 1, 1.0, -1.0), len(words) * dim).reshape(-1, dim)


class HashedNgrams:
    """Unit vectors from hashed words and letter trigrams: a stand-in that needs no model. Within SLAB words, of one text or of
    many, each different word is hashed once."""

    SLAB = 1 << 15

    def embed(self, texts: list[str], dim: int) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        at, owners, starts, places = [], [], [], {}

        def add() -> None:
            out[owners] += np.add.reduceat(_hashed(places, dim)[at], starts, axis=0)
            for kept in (at, owners, starts, places):
                kept.clear()

        for i, text in enumerate(texts):
            words = text.lower().split()
            for a in range(0, len(words), self.SLAB):
                owners.append(i)
                starts.append(len(at))
                at += [places.setdefault(w, len(places)) for w in words[a : a + self.SLAB]]
                if len(at) >= self.SLAB:
                    add()
        if at:
            add()
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class LearnedWords:
    """Vectors of texts from a table of ``word_vectors.learn``, whose size its vocabulary bounds: the weighted mean of the words'
    vectors at length one; zeros where no word is known."""

    def __init__(self, learned: DataFrame):
        rows = learned.select("word", "weight", "vector").collect()
        self.places = {r["word"]: i for i, r in enumerate(rows)}
        self.rows = np.array([[r["weight"] * x for x in r["vector"]] for r in rows]).reshape(len(rows), -1)

    def embed(self, texts: list[str], dim: int) -> np.ndarray:
        if len(self.places) and self.rows.shape[1] != dim:
            raise ValueError(f"words have {self.rows.shape[1]} dimensions, not {dim}")
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            at = [i for w in WORD.findall(text.lower()) if (i := self.places.get(w)) is not None]
            if at:
                row += self.rows[at].sum(axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


_models: dict[str, object] = {}


class SentenceModel:
    """Vectors of a sentence model, by its name; loaded once in a worker. Needs sentence-transformers."""

    def __init__(self, name: str = EMBEDDING_MODEL):
        self.name = name

    def embed(self, texts: list[str], dim: int) -> np.ndarray:
        if self.name not in _models:
            from sentence_transformers import SentenceTransformer

            _models[self.name] = SentenceTransformer(self.name)
        found = np.asarray(_models[self.name].encode(texts)).reshape(len(texts), -1)
        if len(texts) and found.shape[1] != dim:
            raise ValueError(f"{self.name} gives {found.shape[1]} dimensions, not {dim}")
        return found


def embedded(text: Column, embedder: Embedder = HashedNgrams(), dim: int = DIM) -> Column:
    """The vector of a text; null counts as empty. The embedder is sent to the workers once per task. The function is marked so that
    the planner neither repeats it in filters that it infers nor moves it below joins, where it would meet rows that they drop."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed([t or "" for t in texts], dim).astype(np.float32)))

    return run.asNondeterministic()(text)
