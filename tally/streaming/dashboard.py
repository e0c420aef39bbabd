"""Sliding-window velocity dashboard (approximate view, never the per-transfer rule).

Counts transfers per sender in aligned sliding windows.  In append mode a window with at
least ``count`` transfers is emitted once the watermark closes it; ``keep_windows`` runs the
stream in update mode, so windows that are still open at the end are there too.  It answers "some aligned window had >= N", not the per-transfer
look-back of :func:`tally.operators.aml.velocity`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.aml import VELOCITY_COUNT, VELOCITY_WINDOW


def velocity_windows(transfers: DataFrame, size: str = VELOCITY_WINDOW, slide: str = "1 minute",
                     count: int = VELOCITY_COUNT, lateness: str = "10 minutes") -> DataFrame:
    return (transfers.withColumn("_et", F.col("created_at").cast("timestamp")).withWatermark("_et", lateness)
            .groupBy(F.window("_et", size, slide).alias("w"), "from_account_id")
            .agg(F.count(F.lit(1)).alias("transfers"))
            .filter(F.col("transfers") >= count)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "from_account_id", "transfers"))


def keep_windows(windows: DataFrame, out: str, checkpoint: str):
    """Start an availableNow stream that saves every window that a micro-batch changed; returns the query."""

    def save(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")

    return (windows.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def saved_windows(spark: SparkSession, windows: DataFrame, out: str) -> DataFrame:
    """The windows as last saved, closed or open; counts only grow."""
    saved = spark.read.schema(windows.schema).parquet(out)
    return saved.groupBy("window_start", "window_end", "from_account_id").agg(F.max("transfers").alias("transfers"))
