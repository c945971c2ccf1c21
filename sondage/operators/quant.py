"""Quantized vector sidecars: random rotation, scalar codes per coordinate, one-bit sketch of the residual.

A sidecar holds ``bits`` bits a dimension: ``bits - 1`` for the codes and one for the sketch, which makes inner products
unbiased. Scores rank a shortlist; exact cosine ranks its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sondage.operators.search import vector_topk

VERSION, SHORTLIST = 1, 200
META = "struct<codec_version:int,dimension:int,bit_width:int,quantizer_mode:string,projection_seed:bigint,norm:float>"


@dataclass(frozen=True)
class QuantConfig:
    bits: int = 4
    mode: str = "turbo-prod"
    seed: int = 42
    shortlist: int = SHORTLIST
    exact: bool = True

    def __post_init__(self) -> None:
        if self.bits not in (2, 3, 4):
            raise ValueError(f"bit width {self.bits} is not 2, 3 or 4")


@lru_cache(8)
def _levels(bits: int) -> np.ndarray:
    """Centroids of the best scalar quantizer for a standard normal coordinate, by Lloyd's iteration on its density."""
    x = np.linspace(-6, 6, 24001)
    weight = np.exp(-x * x / 2)
    levels = np.linspace(-2, 2, 1 << bits)
    for _ in range(500):
        own = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        levels = np.bincount(own, weight * x, len(levels)) / np.maximum(np.bincount(own, weight, len(levels)), 1e-300)
    return levels


@lru_cache(8)
def _matrices(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and the sketch: both follow from the seed, so no task needs them shipped."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r)), rng.standard_normal((dim, dim))


def encode(vectors: np.ndarray, config: QuantConfig) -> tuple[list[bytes], np.ndarray]:
    """Codes of each row and the rows' norms. A code: residual norm (float32), codes, signs; a zero row stays zero."""
    dim = vectors.shape[1]
    rotation, sketch = _matrices(dim, config.seed)
    norms = np.linalg.norm(vectors, axis=1)
    turned = vectors / np.maximum(norms, 1e-30)[:, None] @ rotation.T
    levels = _levels(config.bits - 1) / math.sqrt(dim)
    codes = np.searchsorted((levels[1:] + levels[:-1]) / 2, turned).astype(np.uint8)
    rest = turned - levels[codes]
    planes = (codes[:, :, None] >> np.arange(config.bits - 1, dtype=np.uint8)) & 1
    packed = np.packbits(planes.reshape(len(vectors), -1), axis=1)
    signs = np.packbits(rest @ sketch.T >= 0, axis=1)
    sizes = np.linalg.norm(rest, axis=1).astype("<f4")
    return [s.tobytes() + p.tobytes() + g.tobytes() for s, p, g in zip(sizes, packed, signs)], norms


def inner_products(codes: list[bytes], query: np.ndarray, config: QuantConfig) -> np.ndarray:
    """Estimates of query . v / |v| from codes of the query's dimension."""
    dim, low = len(query), config.bits - 1
    width = (dim * low + 7) // 8
    rotation, sketch = _matrices(dim, config.seed)
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), 4 + width + (dim + 7) // 8)
    size = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0]
    planes = np.unpackbits(raw[:, 4 : 4 + width], axis=1, count=dim * low).reshape(len(codes), dim, low)
    index = (planes << np.arange(low, dtype=np.uint8)).sum(axis=2)
    signs = np.unpackbits(raw[:, 4 + width :], axis=1, count=dim) * 2.0 - 1
    own = rotation @ query
    return (_levels(low) / math.sqrt(dim))[index] @ own + size * math.sqrt(math.pi / 2) / dim * (signs @ (sketch @ own))


def with_sidecar(vectors: DataFrame, config: QuantConfig = QuantConfig()) -> DataFrame:
    """Adds quant and quant_meta (both null for a null or empty embedding); the dimension is each row's own."""
    base = vectors.drop("quant", "quant_meta")
    at = base.columns.index("embedding")
    names = [*base.columns, "quant", "quant_norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(at).to_pylist()
            blobs: list[bytes | None] = [None] * len(own)
            norms: list[float | None] = [None] * len(own)
            for dim in {len(v) for v in own if v}:
                rows = [i for i, v in enumerate(own) if v and len(v) == dim]
                coded, size = encode(np.asarray([own[i] for i in rows], np.float64), config)
                for i, c, n in zip(rows, coded, size):
                    blobs[i], norms[i] = c, float(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blobs, pa.binary()), pa.array(norms, pa.float32())], names=names)

    done = base.mapInArrow(run, StructType([*base.schema.fields]).add("quant", "binary").add("quant_norm", "float"))
    meta = F.struct(F.lit(VERSION).alias("codec_version"), F.size("embedding").alias("dimension"), F.lit(config.bits).alias("bit_width"), F.lit(config.mode).alias("quantizer_mode"), F.lit(config.seed).cast("long").alias("projection_seed"), F.col("quant_norm").alias("norm"))
    return done.withColumn("quant_meta", F.when(F.col("quant").isNotNull(), meta)).drop("quant_norm")


def having_sidecar(chunks: DataFrame, has: bool = True) -> DataFrame:
    return chunks.where(F.col("quant").isNotNull() if has else F.col("quant").isNull())


def clear_sidecars(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"quant": F.lit(None).cast("binary"), "quant_meta": F.lit(None).cast(META)})


def backfill(chunks: DataFrame, config: QuantConfig = QuantConfig()) -> DataFrame:
    """Rows without a sidecar get one; the others pass as they are."""
    return having_sidecar(chunks).unionByName(with_sidecar(having_sidecar(chunks, False), config).select(chunks.columns))


def quantized_search(chunks: DataFrame, query: list[float], limit: int, config: QuantConfig = QuantConfig()) -> DataFrame:
    """uuid, vector_rank, cosine_score from a shortlist of at least ``config.shortlist`` rows by estimated score.

    Sidecars of another version, width, seed or dimension are passed over; where none fits, the exact scan answers.
    """
    meta = F.col("quant_meta")
    fits = (meta["codec_version"] == VERSION) & (meta["dimension"] == len(query)) & (meta["bit_width"] == config.bits) & (meta["projection_seed"] == config.seed)
    coded = having_sidecar(chunks).where(fits).select("uuid", "quant")
    if limit <= 0 or coded.limit(1).count() == 0:
        return vector_topk(chunks, query, limit)
    own = np.asarray(query, np.float64)
    own = own / max(float(np.linalg.norm(own)), 1e-30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = inner_products(batch.column(1).to_pylist(), own, config) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["uuid", "cosine_score"])

    scored = coded.mapInArrow(run, StructType([coded.schema["uuid"]]).add("cosine_score", DoubleType()))
    short = scored.orderBy(F.desc("cosine_score"), "uuid").limit(max(limit, config.shortlist))
    if config.exact:
        return vector_topk(chunks.join(F.broadcast(short.select("uuid")), "uuid", "left_semi"), query, limit)
    from sondage.operators.search import ranked

    return ranked(short.withColumn("cosine_score", F.round("cosine_score", 6)).orderBy(F.desc("cosine_score"), "uuid").limit(limit), "vector_rank", "cosine_score")
