"""JDBC source tables.

A full-table JDBC read is one task unless it is split: with a numeric
``partition_column`` the read is cut into ``num_partitions`` range queries
(bounds from a cheap min/max query when not given), with a UUID ``key_column``
into as many key ranges, so a large source table is extracted in parallel.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tally.operators.contract import declared_schema


def key_ranges(column: str, parts: int) -> list[str]:
    """Predicates that cut UUID keys (or lower-case hex strings) into ranges; each row, NULL
    keys included, is in exactly one."""
    bounds = [str(uuid.UUID(int=(i << 128) // parts)) for i in range(1, parts)]
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= '{lo}' AND {column} < '{hi}'" for lo, hi in zip(bounds, bounds[1:])]
    return [f"{column} < '{bounds[0]}' OR {column} IS NULL", *inner, f"{column} >= '{bounds[-1]}'"]


def read_by_key(spark: SparkSession, url: str, table: str, key_column: str, num_partitions: int = 8,
                properties: dict | None = None, fetch_size: int = 10_000) -> DataFrame:
    """Parallel read of a table with UUID keys, a task per key range."""
    return spark.read.jdbc(url, table, predicates=key_ranges(key_column, num_partitions),
                           properties={"fetchsize": str(fetch_size), **(properties or {})})


def read_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
               partition_column: str | None = None, num_partitions: int = 8,
               lower_bound: int | None = None, upper_bound: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    props = dict(properties or {})
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    for k, v in props.items():
        reader = reader.option(k, v)
    if partition_column is None:
        return reader.load()
    if lower_bound is None or upper_bound is None:
        b = (spark.read.format("jdbc").option("url", url)
             .option("query", f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}")
             .options(**props).load().first())
        if b is None or b[0] is None:
            return reader.load()
        lower_bound, upper_bound = int(b[0]), int(b[1])
    return (reader.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
            .option("upperBound", upper_bound + 1).option("numPartitions", num_partitions).load())


def nullable_columns(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> dict[str, bool]:
    """Per column whether the database lets it be NULL, from JDBC's own catalogue (Spark reads every
    column as nullable); none for a table that it doesn't have."""
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        schema, _, name = table.rpartition(".")
        for spelled in (str, str.upper, str.lower):  # databases fold unquoted names either way
            rows, found = connection.getMetaData().getColumns(None, spelled(schema) or None, spelled(name), None), {}
            while rows.next():
                found[rows.getString("COLUMN_NAME")] = rows.getString("IS_NULLABLE") != "NO"
            if found:
                return found
        return {}
    finally:
        connection.close()


def live_contract(spark: SparkSession, url: str, tables: list[str], properties: dict | None = None) -> DataFrame:
    """(table, column, type, nullable) as the database declares them, for the contract diff.  Only
    metadata is read; a column is nullable where NULL is allowed, whether or not it holds one.
    A table that the database doesn't have has no rows."""
    found = {}
    for name in tables:
        nullable = nullable_columns(spark, url, name, properties)
        if nullable:
            schema = read_table(spark, url, name, properties).schema
            found[name] = T.StructType([T.StructField(f.name, f.dataType, nullable.get(f.name, True)) for f in schema.fields])
    return declared_schema(spark, found)
