"""Vector expressions over array<float>: products in float, sums in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, FloatType, StructType


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: (x * x).cast("double"))))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """0 for null, unequal lengths and zero vectors."""
    scale = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def signature(a: Column, dim: int) -> Column:
    """Sign bits (1 for v >= 0), one long per 64 dimensions, lowest bit first."""
    words = []
    for w in range(0, dim, 64):
        bits = F.transform(F.slice(a, w + 1, 64), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing sign bits; the largest integer where a signature is missing or of another length."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), apart).otherwise(F.lit(2**31 - 1))


def mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: ((x + y) / 2).cast("float"))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero; what becomes zero keeps its sign, as IEEE and DuckDB have it (``round`` goes by a decimal, which has none)."""
    near = F.round(x, digits)
    return F.when(near == 0, x * F.lit(0).cast("float")).otherwise(near)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def to_bytes(df: DataFrame, vector: str = "embedding", name: str = "bytes") -> DataFrame:
    """Adds the vector as little-endian single floats, as other stores keep it; null stays null."""
    return _coded(df, vector, name, BinaryType(), pa.binary(), lambda v: np.asarray(v, "<f4").tobytes())


def from_bytes(df: DataFrame, data: str = "bytes", name: str = "embedding") -> DataFrame:
    """Adds the vector that little-endian single floats stand for; null and odd lengths give null."""
    return _coded(df, data, name, ArrayType(FloatType()), pa.list_(pa.float32()), lambda b: None if len(b) % 4 else np.frombuffer(b, "<f4"))


def _coded(df: DataFrame, source: str, name: str, kind: DataType, arrow: pa.DataType, code) -> DataFrame:
    at, names = df.columns.index(source), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else code(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, kind))


def saved(vectors: DataFrame, dim: int) -> DataFrame:
    """With the norm and the sign bits that a store keeps beside each vector."""
    return vectors.withColumns({"norm": norm(F.col("embedding")).cast("float"), "signature": signature(F.col("embedding"), dim)})
