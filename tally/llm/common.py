"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import ensure_checkpoint_dir

# ASCII white space of the word and text rules: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: computed once, lineage cut,
    readable by every executor after any of them is lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(spark: SparkSession) -> int:
    """How many ways a hot key is split; follows the parallelism of the job."""
    return max(32, shuffle_partitions(spark))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of the same names in which nulls are equal; the right copies go."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in on])


def salted(df: DataFrame, *tie: str) -> DataFrame:
    """Adds ``_salt``, spread by the given columns."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in tie]), F.lit(salts(df.sparkSession))).cast("int"))


def attach_groups(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column],
                  enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Joins group results back to the rows without gathering a hot group.

    ``df`` has ``_salt``.  Rows are first reduced per (key, salt); a key then has
    at most ``salts`` rows, whether it holds two rows or a third of the table, and
    the result returns to the rows along (key, salt).  ``enrich`` may add columns to
    the table of one row per key before that.
    """
    parts = df.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    whole = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
    if enrich:
        whole = enrich(whole)
    spread = same(parts.select(*keys, "_salt"), whole, keys, "inner")
    return same(df, spread, [*keys, "_salt"], "inner")


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches end at so many bytes: a worker holds one batch, however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
