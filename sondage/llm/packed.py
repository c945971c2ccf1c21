"""Columns of numbers packed by bucket of a hash: a row holds the numbers of one bucket, so a shuffle moves few rows.

The number of buckets follows the size of the texts, so that what a task unpacks at once stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 10, 30
BUCKET_BYTES = 24 << 20  # of text whose words share a bucket


def bits_for(docs: DataFrame) -> int:
    """Bits of the bucket number for the texts of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (int(size) // BUCKET_BYTES).bit_length()))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of ``x``, all first bytes first: these columns compress where rows of them do not."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(parts: list[bytes], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) for x in parts])


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """Unpacked columns of each bucket; rows come sorted by bucket."""
    held: list[list[bytes]] = [[] for _ in kinds]
    last = None
    for batch in batches:
        own = batch.column(0).to_pylist()
        columns = [batch.column(i + 1).to_pylist() for i in range(len(kinds))]
        for i, bucket in enumerate(own):
            if bucket != last and held[0]:
                yield [_unplanes(h, kind) for h, kind in zip(held, kinds)]
                held = [[] for _ in kinds]
            last = bucket
            for h, column in zip(held, columns):
                h.append(column[i])
    if held[0]:
        yield [_unplanes(h, kind) for h, kind in zip(held, kinds)]


def packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row per bucket with what ``columns`` have of it, in their order."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
    columns = [c[order] for c in columns]
    data = [pa.array([int(own[a]) for a in cuts[:-1]], pa.int32()), *(pa.array([_planes(c[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns)]
    return pa.RecordBatch.from_arrays(data, names=["bucket", *(f"c{i}" for i in range(len(columns)))])
