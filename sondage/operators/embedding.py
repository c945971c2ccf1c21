"""Local hash embedding, vectorised over Arrow batches, and its configuration."""

from __future__ import annotations

import hashlib
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from sondage.functions.text import PUNCTUATION, STOP_WORDS
from sondage.session import small_batches

LOCAL_MODEL = "local-hash"
DEFAULT_DIMS = 768
CACHE_TEXTS = 10_000
CACHE_WORDS = 1 << 16
_STOP = frozenset(STOP_WORDS)
_TABLE = str.maketrans(dict.fromkeys(PUNCTUATION, " "))


@dataclass(frozen=True)
class EmbedderConfig:
    """``embed`` maps texts to vectors (or None for one it can't embed); without it the local hash is used."""

    dims: int = DEFAULT_DIMS
    model: str = LOCAL_MODEL
    retries: int = 2
    embed: Callable[[list[str]], list[list[float] | None]] | None = None

    def resolved(self) -> EmbedderConfig:
        """With the dimension that is configured, else that of a first answer of the service, else ``DEFAULT_DIMS``."""
        if self.dims:
            return self
        first = self.embed(["dimension"])[0] if self.embed else None
        return replace(self, dims=len(first) if first else DEFAULT_DIMS)


def fnv1a32(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


@lru_cache(CACHE_WORDS)
def _word_hash(word: str) -> int:
    return fnv1a32(word.encode())


def hash_vector(text: str, dims: int = 768) -> np.ndarray:
    out = np.zeros(dims, np.float32)
    digest = hashlib.sha256(text.encode()).digest()
    for i, word in enumerate(text.lower().translate(_TABLE).split()):
        if word not in _STOP:
            out[_word_hash(word) % dims] += np.float32(1.0) + np.float32(digest[i] / 255.0 if i < len(digest) else 0.0)
    size = np.float32(np.sqrt(np.sum((out * out).astype(np.float64))))  # squares are single, their sum is double
    if size > 0:
        return out / size
    out[0] = 1.0
    return out


class VectorCache:
    """The vectors of a service that were used last, by model, dimension and text digest; a worker process keeps one.

    Kept as single floats, an eighth of a list: a column of vectors has no more digits.
    """

    def __init__(self, most: int = CACHE_TEXTS):
        self.most = most
        self.kept: OrderedDict[tuple, array] = OrderedDict()

    def ask(self, texts: list[str], config: EmbedderConfig) -> list[list[float] | None]:
        """Vectors of distinct ``texts``; only those that aren't kept are asked for, and only fitting answers are kept."""
        keys = [(config.model, config.dims, hashlib.sha256(t.encode()).digest()[:16]) for t in texts]
        todo = [t for t, k in zip(texts, keys) if k not in self.kept]
        fresh = dict(zip(todo, config.embed(todo))) if todo else {}
        out = []
        for text, key in zip(texts, keys):
            if key in self.kept:
                self.kept.move_to_end(key)
                out.append(self.kept[key].tolist())
                continue
            out.append(fresh[text])
            if fresh[text] is not None and len(fresh[text]) == config.dims:
                self.kept[key] = array("f", fresh[text])
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return out


@lru_cache(1)
def _cache() -> VectorCache:
    return VectorCache()


def embed(df: DataFrame, text: str = "content", config: EmbedderConfig = EmbedderConfig()) -> DataFrame:
    """Adds embedding, embedding_model and embedding_dim. Equal texts of a batch, and those a worker asked for lately, are
    embedded once; a vector that is missing or of another length is replaced by the local hash and labelled so. Batches are small."""
    config = config.resolved()
    small_batches(df.sparkSession)
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            known: dict[str, tuple[np.ndarray, str]] = {}
            distinct = list(dict.fromkeys(texts))
            remote = _cache().ask(distinct, config) if config.embed else [None] * len(distinct)
            for t, v in zip(distinct, remote):
                known[t] = (np.asarray(v, np.float32), config.model) if v is not None and len(v) == config.dims else (hash_vector(t, config.dims), LOCAL_MODEL)
            vectors = pa.array([known[t][0] for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors, pa.array([known[t][1] for t in texts])], names=[*names, "embedding", "embedding_model"])

    schema = StructType([*df.schema.fields]).add("embedding", ArrayType(FloatType())).add("embedding_model", "string")
    return df.mapInArrow(run, schema).withColumn("embedding_dim", F.size("embedding"))
