"""Parquet table reader for the driver-generated star schema.

Columns are always selected explicitly so the scan's ReadSchema holds only what
the caller uses.  Files are listed anew for every query; only the schema is
remembered per session and path, so footers are read once.
"""
from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SCHEMAS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = _SCHEMAS.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    df = spark.read.schema(known[path]).parquet(path)
    return df.select(*columns) if columns else df
