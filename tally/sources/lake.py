"""A partitioned parquet lake with snapshot publishing.

Layout: ``<root>/<layer>/<table>/business_date=<d>/_snapshot_id=<s>/part-*.parquet``.

* Every write of a (table, date) goes to a *new* snapshot directory; the
  committer's ``_SUCCESS`` marker publishes it.  A crashed or half-written job
  therefore never changes what readers see, reruns are idempotent, and
  earlier snapshots stay readable (time travel by snapshot id).
* The *current* snapshot of a date is its newest published one.  Readers
  resolve current snapshots from directory listings (metadata only, on the
  driver, like Spark's own file listing) and read just those paths, so a
  date filter prunes at path level.
* Writes are checked against the table's schema: additive columns are
  fine (old snapshots read them as NULL through ``mergeSchema``), a type
  change is rejected before anything is written.
* An empty DataFrame still publishes an (empty) snapshot, so an empty
  quarantine replaces yesterday's rows instead of leaving them visible.
"""
from __future__ import annotations

import time
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.operators.contract import check_write_compatible

DATE = "business_date"
SNAPSHOT = "_snapshot_id"


def table_path(root: str, layer: str, table: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{table}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _list_dirs(spark: SparkSession, path: str, prefix: str) -> list:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p)
                  if s.isDirectory() and s.getPath().getName().startswith(prefix))


def _published(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def snapshots(spark: SparkSession, root: str, layer: str, table: str, business_date: str) -> list:
    """Published snapshot ids of one date, oldest first."""
    base = f"{table_path(root, layer, table)}/{DATE}={business_date}"
    ids = [d.split("=", 1)[1] for d in _list_dirs(spark, base, f"{SNAPSHOT}=")]
    return [s for s in ids if _published(spark, f"{base}/{SNAPSHOT}={s}")]


def dates(spark: SparkSession, root: str, layer: str, table: str) -> list:
    return [d.split("=", 1)[1] for d in _list_dirs(spark, table_path(root, layer, table), f"{DATE}=")]


def new_snapshot_id() -> str:
    return f"{time.time_ns():020d}"


def registered_schema(spark: SparkSession, root: str, layer: str, table: str) -> T.StructType | None:
    """Merged schema of the table's current snapshots (None when the table is new)."""
    paths = current_paths(spark, root, layer, table)
    if not paths:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*paths).schema


def write_partition(df: DataFrame, root: str, layer: str, table: str, business_date: str,
                    snapshot_id: str | None = None, check_schema: bool = True) -> str:
    """Publish ``df`` (without its business_date column) as a new snapshot of one date."""
    spark = df.sparkSession
    data = df.drop(DATE, SNAPSHOT)
    if check_schema:
        reg = registered_schema(spark, root, layer, table)
        if reg is not None:
            check_write_compatible(data, T.StructType([f for f in reg.fields if f.name not in (DATE, SNAPSHOT)]))
    sid = snapshot_id or new_snapshot_id()
    path = f"{table_path(root, layer, table)}/{DATE}={business_date}/{SNAPSHOT}={sid}"
    data.write.mode("overwrite").parquet(path)
    return path


def current_paths(spark: SparkSession, root: str, layer: str, table: str,
                  business_dates: Iterable[str] | None = None, as_of_snapshot: str | None = None) -> list:
    base = table_path(root, layer, table)
    out = []
    for d in (business_dates if business_dates is not None else dates(spark, root, layer, table)):
        snaps = snapshots(spark, root, layer, table, d)
        if as_of_snapshot is not None:
            snaps = [s for s in snaps if s <= as_of_snapshot]
        if snaps:
            out.append(f"{base}/{DATE}={d}/{SNAPSHOT}={snaps[-1]}")
    return out


def read_table(spark: SparkSession, root: str, layer: str, table: str, business_dates: Iterable[str] | None = None,
               as_of_snapshot: str | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """Current rows of a lake table (optionally some dates / as of a snapshot).

    ``business_date`` and ``_snapshot_id`` come back as string columns.
    Returns None when nothing is published.
    """
    paths = current_paths(spark, root, layer, table, business_dates, as_of_snapshot)
    if not paths:
        return None
    reader = spark.read.option("basePath", table_path(root, layer, table)).option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*paths)
    return df.withColumn(DATE, F.col(DATE).cast("string")).withColumn(SNAPSHOT, F.col(SNAPSHOT).cast("string"))


def read_snapshot(spark: SparkSession, root: str, layer: str, table: str, business_date: str,
                  snapshot_id: str) -> DataFrame:
    """One specific (possibly superseded) snapshot of a date."""
    path = f"{table_path(root, layer, table)}/{DATE}={business_date}/{SNAPSHOT}={snapshot_id}"
    return spark.read.parquet(path).withColumn(DATE, F.lit(business_date))


def create_once(spark: SparkSession, path: str) -> bool:
    """Creates an empty file unless it is there; of several callers exactly one gets True
    (on file systems whose create without overwrite is atomic, as HDFS)."""
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, path)
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def append(df: DataFrame, root: str, layer: str, table: str) -> None:
    """Append-only event tables (audit log)."""
    df.write.mode("append").parquet(table_path(root, layer, table))


def read_events(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame | None:
    path = table_path(root, layer, table)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.option("mergeSchema", "true").parquet(path)


def register_views(spark: SparkSession, root: str, tables: dict) -> list:
    """Register ``<layer>_<table>`` temp views for every published table; absent ones are skipped."""
    done = []
    for layer, names in tables.items():
        for t in names:
            df = read_table(spark, root, layer, t)
            if df is not None:
                df.createOrReplaceTempView(f"{layer}_{t}")
                done.append(f"{layer}_{t}")
    return done
