"""Incremental Bronze landing from a file drop (the AutoLoader stand-in).

``readStream`` picks up new files only (the checkpoint remembers which were
read); each micro-batch is tagged and written to its own ``_epoch=<id>``
directory with overwrite, so a replayed epoch after a failure rewrites the
same files instead of duplicating rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.plans.medallion import tag_bronze
from tally.session import ensure_checkpoint_dir


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def stream_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/bronze_stream/{table}"


def ingest_files(spark: SparkSession, landing_dir: str, schema: T.StructType, root: str, table: str,
                 checkpoint: str | None = None, max_files_per_trigger: int | None = None, fmt: str = "parquet",
                 shape: Callable[[DataFrame], DataFrame] | None = None):
    """Start an availableNow stream landing new files of ``landing_dir``; returns the query.

    ``shape`` maps the files' rows to the table's before they are tagged."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(landing_dir)
    if shape:
        src = shape(src)
    target = stream_path(root, table)

    def land(df: DataFrame, epoch_id: int) -> None:
        tagged = tag_bronze(df, f"stream-{table}-{epoch_id}")
        # rebalance: one file set per date, AQE splits a hot date and merges tiny ones
        tagged.hint("rebalance", "business_date").write.mode("overwrite").partitionBy("business_date").parquet(f"{target}/_epoch={epoch_id}")

    return (src.writeStream.foreachBatch(land)
            .option("checkpointLocation", checkpoint or checkpoint_location(spark, f"ingest-{table}"))
            .trigger(availableNow=True).start())


def read_landed(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(stream_path(root, table)).withColumn("business_date", F.col("business_date").cast("string"))
