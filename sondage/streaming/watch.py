"""Continuous indexing: a stream of changes applied to versioned snapshots, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sondage.operators.store import latest


class Snapshots:
    """Versions of a relation as Parquet folders; a version is complete once its marker is written."""

    marker = "_SUCCESS"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        """The last complete version, -1 if there is none. Reads the folder through Spark's file system."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return -1
        names = [s.getPath() for s in fs.listStatus(folder)]
        return max((int(p.getName()[1:]) for p in names if p.getName()[:1] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(p, self.marker))), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v >= 0 else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        v = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        return v


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: path, ts, op (upsert or delete) and the columns of ``current``; the last change of a path counts."""
    last = latest(changes)
    kept = current.join(last.select("path"), "path", "left_anti").select(current.columns)
    return kept.unionByName(last.where(F.col("op") != "delete").select(current.columns))


def watch(changes: DataFrame, target: Snapshots, checkpoint: str, seconds: float = 0.5, once: bool = False, then: Callable[[int], None] | None = None, listing: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Apply each micro-batch (the quiet period) as one new version. ``listing`` (path): what is there; rows of paths that it
    doesn't have go out with the batch, as file sources tell of no deletes."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            new = apply_changes(target.read(), rows)
            v = target.write(new.join(listing().select("path").distinct(), "path", "left_semi").select(new.columns) if listing else new)
            if then:
                then(v)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def bursts(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Event-time bursts of changes per path: session windows with a watermark."""
    return changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"), F.max("ts").alias("last")).select("path", "w.start", "w.end", "changes", "last")
