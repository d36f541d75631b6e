"""Corpus build: pieces to a fact store and a chunk index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions import vocabulary as v
from groundwork.operators import chunks as c
from groundwork.operators import facts as f

#: Texts to vectors, a batch at a time.
Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Loaded:
    """A model that ``load`` makes, once in each Python worker; ``name`` tells models apart. Stands wherever an embedder or counter does."""

    name: str
    load: Callable[[], Callable]

    def __call__(self, *args: object) -> object:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name](*args)


#: Models of this worker by name.
_LOADED: dict[str, Callable] = {}


def hashed_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Stand-in for an embedding model: counts of hashed words, of unit length."""
    import re
    import zlib

    import numpy as np

    out = np.zeros((len(texts), size))
    for i, s in enumerate(texts):
        for w in re.findall("[a-z0-9]+", (s or "").lower()):
            out[i, zlib.crc32(w.encode()) % size] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0).tolist()


def embedded(df: DataFrame, text_col: str = "text", embedder: Embedder = hashed_embedder, query: bool = False, batch: int = 32) -> DataFrame:
    """``df`` with ``embedding``; questions get the search prefix.

    Equal texts of an Arrow batch are encoded once, and texts of like length
    together, so that a model pads little.
    """
    prefix = v.QUERY_PREFIX if query else ""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("")
            distinct = sorted(set(texts), key=len)
            vectors = [e for i in range(0, len(distinct), batch) for e in embedder([prefix + x for x in distinct[i : i + batch]])]
            known = dict(zip(distinct, vectors, strict=True))
            yield pd.Series([known[x] for x in texts], dtype=object)

    return df.withColumn("embedding", embed(F.col(text_col)))


def build_fact_store(pieces: DataFrame) -> DataFrame:
    """Deduplicated facts with entry ids from pieces with ``piece_index``."""
    return f.with_entry_ids(f.dedup(f.table_to_facts(pieces)))


def build_chunk_index(pieces: DataFrame, embedder: Embedder = hashed_embedder, count: c.Counter = c.count_tokens, id_digits: int = 8) -> DataFrame:
    """Chunks with embeddings from pieces. Of an id that is met again only the first stays; 32 ``id_digits`` tell all texts apart."""
    return embedded(c.build_chunks(pieces, count, id_digits), "text", embedder)
