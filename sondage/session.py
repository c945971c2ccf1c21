"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of texts stay small however long the texts are.
BATCH_ROWS = 512
BATCH_BYTES = "16m"


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "sondage", **conf: str) -> SparkSession:
    """A local session; a cluster brings its own and never calls this."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> None:
    """Bound the rows and the bytes of the Arrow batches that Python workers get.

    Plans read these settings when they run, so they stay set in the session that runs them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
