"""Ordered work on keys of any size: rows in slices of about equal size, and what slices hand on.

A window over a key gathers the key in one task, whatever holds a third of all rows.  Here rows are
partitioned by ranges of (key, order) instead, so a busy key lies in as many slices as it
needs; each slice is worked on alone, and a second, small step over one row per (key, slice)
carries on what the slices before it leave (a prefix sum, the last value, a state).
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.session import ensure_checkpoint_dir

SLICE = "_slice"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, there for every executor after any is lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slice_count(df: DataFrame, slices: int | None = None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(df: DataFrame, *order: str, slices: int | None = None, name: str = "slices") -> DataFrame:
    """``df`` with ``_slice``: consecutive rows of ``order``, ascending, in slices of about equal size.

    The table is stored, as the ranges are drawn from a sample of each run.  Rows equal in all
    of ``order`` share a slice, so its last column should be an id.
    """
    ranged = df.repartitionByRange(slice_count(df, slices), *order).withColumn(SLICE, F.spark_partition_id())
    return stored(ranged, name)


def joined_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which nulls are equal; the right copies go."""
    right = right.select(*[F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on])
    return left.join(right, same, how).drop(*[f"_r{c}" for c in on])


def prefix_sums(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over the rows of the same key up to each row; ``rows`` are :func:`sliced` by (key, order)."""
    part = [*key, SLICE]
    rows = rows.select("*", *[c.alias(f"_x{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.sum(f"_x{n}").over(upto).alias(f"_in{n}") for n in sums])
    totals = rows.groupBy(*part).agg(*[F.sum(f"_x{n}").alias(f"_t{n}") for n in sums])
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_c{n}") for n in sums])
    out = joined_on(within, carry, part)
    made = {f"{p}{n}" for n in sums for p in ("_x", "_in", "_c")}
    return out.select(*[c for c in out.columns if c not in made], *[(F.col(f"_in{n}") + F.col(f"_c{n}")).alias(n) for n in sums])


def previous(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the value of the row before within the key; ``rows`` are :func:`sliced` by (key, order)."""
    part = [*key, SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    within = rows.select("*", F.lag(value).over(w).alias("_lag"), F.row_number().over(w).alias("_rn"))
    last = rows.groupBy(*part).agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_last"))
    carry = last.select(*part, F.lag("_last._v").over(Window.partitionBy(*key).orderBy(SLICE)).alias("_carry"))
    joined = joined_on(within, carry, part)
    return joined.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("_lag", "_rn", "_carry")
