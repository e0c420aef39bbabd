"""Helpers to build negative-test scenarios from real rows (typed overrides,
partition clones, deterministic templates, key lookups)."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def override(df: DataFrame, **values) -> DataFrame:
    """Replace columns by literals cast to each column's declared type."""
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


def clone_partition(df: DataFrame, business_date: str, to_date: str) -> DataFrame:
    return df.filter(F.col("business_date") == business_date).withColumn("business_date", F.lit(to_date))


def template_row(df: DataFrame, order_by: str) -> DataFrame:
    """One deterministic sample row (smallest key)."""
    return df.orderBy(order_by).limit(1)


def lookup(df: DataFrame, column: str, keys: Iterable | DataFrame) -> DataFrame:
    """Rows whose ``column`` is in ``keys`` (a list becomes an IN filter that
    reaches the scan; a DataFrame becomes a semi-join)."""
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
        return df.join(k, df[column] == k["_k"], "left_semi")
    return df.filter(F.col(column).isin(list(keys)))
