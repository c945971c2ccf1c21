"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.session import small_batches as small_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session that names none gets a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sondage-")
        sc.setCheckpointDir(named)
    return named


def spool(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, has fixed row order in files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spool_path = path
    return out


def unspool(*spooled: DataFrame) -> None:
    """Delete what ``spool`` wrote; only for frames that nothing unwritten still reads."""
    for df in spooled:
        jvm, path = df.sparkSession._jvm, df.spool_path
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
