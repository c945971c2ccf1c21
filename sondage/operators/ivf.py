"""Inverted file over vectors: centroids by Lloyd steps, vectors stored in a folder for each bucket, pruned probes.

Bucket numbers grow with the square root of the rows, from 4 to ``MOST_BUCKETS``; centroids are the only thing that
stands on the driver or is shipped to tasks (buckets x dimensions floats).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

LEAST_BUCKETS, MOST_BUCKETS = 4, 4096
ITERATIONS = 3
THRESHOLD = 128  # rows from which an index pays
RESEEDS = 3


def bucket_count(n: int) -> int:
    return min(n, MOST_BUCKETS, max(LEAST_BUCKETS, math.isqrt(n))) if n else 0


def probe_count(k: int) -> int:
    return min(k, max(3, math.isqrt(k) + 1))


def needs_rebuild(changed: int, total: int) -> bool:
    """Over a tenth of the rows changed since the build."""
    return changed * 10 > total


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(at).to_pylist(), np.float64).reshape(batch.num_rows, dim)


def nearest(vectors: DataFrame, centroids: np.ndarray, score: bool = False) -> DataFrame:
    """``vectors`` with the bucket of the centroid of highest cosine (lowest number on ties), and that cosine if ``score``."""
    table = unit(np.asarray(centroids, np.float64))
    at = vectors.columns.index("embedding")
    names = [*vectors.columns, "bucket", *(["cosine"] if score else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.round(unit(_matrix(batch, at, table.shape[1])) @ table.T, 9)
            best = near.argmax(axis=1).astype(np.int32)
            more = [pa.array(near[np.arange(len(best)), best], pa.float64())] if score else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), *more], names=names)

    schema = StructType([*vectors.schema.fields]).add("bucket", IntegerType())
    return vectors.mapInArrow(run, schema.add("cosine", "double") if score else schema)


def means(vectors: DataFrame, centroids: np.ndarray) -> dict[int, np.ndarray]:
    """Mean of the vectors of each bucket that has any: a task sends one partial sum for a bucket."""
    table = unit(np.asarray(centroids, np.float64))
    k, dim = table.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            own = _matrix(batch, 0, dim)
            best = np.round(unit(own) @ table.T, 9).argmax(axis=1)
            np.add.at(total, best, own)
            n += np.bincount(best, minlength=k)
        use = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array(n[use]), pa.array(list(total[use]), pa.list_(pa.float64()))], names=["bucket", "n", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum(np.asarray(group.column("total").to_pylist()), axis=0) / sum(group.column("n").to_pylist())
        return pa.table({"bucket": group.column("bucket")[:1], "mean": pa.array([total.tolist()], pa.list_(pa.float64()))})

    sums = vectors.select("embedding").mapInArrow(partial, "bucket int, n long, total array<double>")
    return {r["bucket"]: np.asarray(r["mean"]) for r in sums.groupBy("bucket").applyInArrow(add, "bucket int, mean array<double>").collect()}


def reseed(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Empty buckets take the members that lie farthest from the centroids of the largest buckets."""
    k = len(centroids)
    for _ in range(RESEEDS):
        placed = nearest(vectors.select("uuid", "embedding"), centroids, True)
        sizes = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        empty = [b for b in range(k) if b not in sizes]
        rich = sorted((b for b in sizes if sizes[b] > 1), key=lambda b: (-sizes[b], b))[: len(empty)]
        if not empty or not rich:
            break
        far = placed.where(F.col("bucket").isin(rich)).groupBy("bucket").agg(F.min_by("embedding", F.struct("cosine", "uuid")).alias("v"))
        found = {r["bucket"]: r["v"] for r in far.collect()}
        for b, source in zip(empty, rich):
            centroids[b] = found[source]
    return centroids


def build(vectors: DataFrame, iterations: int = ITERATIONS) -> np.ndarray:
    """Centroids of ``vectors`` (uuid, embedding): seeds spread by a hash of the uuid, Lloyd steps by cosine, no empty bucket if it can be."""
    k = bucket_count(vectors.count())
    seeds = vectors.select("uuid", "embedding").orderBy(F.xxhash64("uuid"), "uuid").limit(k).collect()
    centroids = np.asarray([r["embedding"] for r in seeds], np.float64)
    if not k:
        return centroids.reshape(0, 0)
    for _ in range(iterations):
        for bucket, mean in means(vectors, centroids).items():
            centroids[bucket] = mean
    return reseed(vectors, centroids)


def probes(centroids: np.ndarray, query: list[float], sizes: dict[int, int] | None = None, count: int = 0) -> list[int] | None:
    """Buckets to read (``count``, or as many as ``probe_count`` says), nearest first; None where they hold over half of the
    rows, so a scan is as good."""
    if not len(centroids):
        return []
    score = np.round(unit(np.asarray(centroids)) @ unit(np.asarray([query], np.float64))[0], 9)
    found = sorted(range(len(centroids)), key=lambda i: (-score[i], i))[: count or probe_count(len(centroids))]
    if sizes and 2 * sum(sizes.get(b, 0) for b in found) > sum(sizes.values()):
        return None
    return found


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: ``folder``/vectors by bucket, centroids and bucket sizes; ``state`` tells of what it was built."""

    folder: str
    centroids: np.ndarray
    sizes: dict[int, int]
    state: dict

    @property
    def ready(self) -> bool:
        return len(self.centroids) > 0

    @property
    def rows(self) -> int:
        return sum(self.sizes.values())

    def read(self, spark: SparkSession, query: list[float]) -> DataFrame | None:
        """Rows of the probed buckets only (a partition filter); None where a scan is as good."""
        found = probes(self.centroids, query, self.sizes)
        return None if found is None else spark.read.parquet(f"{self.folder}/vectors").where(F.col("bucket").isin(found)).drop("bucket")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def save(vectors: DataFrame, folder: str, state: dict) -> VectorIndex:
    """Build and write; the state is written last, so a broken write is never read."""
    spark = vectors.sparkSession
    centroids = build(vectors)
    nearest(vectors, centroids).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/vectors")
    sizes = {r["bucket"]: r["n"] for r in spark.read.parquet(f"{folder}/vectors").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    rows = [(b, sizes.get(b, 0), [float(x) for x in c]) for b, c in enumerate(centroids)]
    spark.createDataFrame(rows, "bucket int, n long, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")
    return VectorIndex(folder, centroids, sizes, state)


def load(spark: SparkSession, folder: str) -> VectorIndex | None:
    """The stored index, None if there is none or it isn't complete."""
    system, done = _folder(spark, f"{folder}/state/_SUCCESS")
    if not system.exists(done):
        return None
    state = json.loads(spark.read.text(f"{folder}/state").first()[0])
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("bucket").collect()
    centroids = np.asarray([r["centroid"] for r in rows], np.float64)
    return VectorIndex(folder, centroids, {r["bucket"]: r["n"] for r in rows}, state)


def discard(spark: SparkSession, folder: str) -> None:
    system, path = _folder(spark, folder)
    system.delete(path, True)


def update(lists: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """(uuid, bucket) without the uuids of ``gone`` and ``fresh``, plus ``fresh``."""
    out = gone.select("uuid").unionByName(fresh.select("uuid")).distinct()
    return lists.join(out, "uuid", "left_anti").select("uuid", "bucket").unionByName(fresh.select("uuid", "bucket"))
