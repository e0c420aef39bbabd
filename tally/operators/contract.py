"""Source schema contract: declared (table, column, type, nullable) vs the live schema.

Kinds, in precedence order: missing_table, missing_column, type_changed,
nullability_loosened, ok; live columns absent from the contract are
``new_column`` warnings (not breaking).  Live nullability is what the database declares
(``sources/jdbc.py: live_contract``); for files it is *observed* (a column is nullable
when it holds a NULL), because parquet readers report every column as nullable.
"""
from __future__ import annotations

import json
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT_SCHEMA = "table_name string, column_name string, data_type string, nullable boolean"


def canonical_type(dt: T.DataType) -> str:
    """SQL spelling shared with the DuckDB oracle."""
    if isinstance(dt, T.LongType):
        return "BIGINT"
    if isinstance(dt, T.IntegerType):
        return "INTEGER"
    if isinstance(dt, T.ShortType):
        return "SMALLINT"
    if isinstance(dt, T.DoubleType):
        return "DOUBLE"
    if isinstance(dt, T.FloatType):
        return "FLOAT"
    if isinstance(dt, T.StringType):
        return "VARCHAR"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return canonical_type(dt.elementType) + "[]"
    return dt.simpleString().upper()


def load_contract(spark: SparkSession, path: str) -> DataFrame:
    """Contract JSON ``{"tables": {table: {column: {"type", "nullable"}}}}`` as a DataFrame."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return contract_frame(spark, doc)


def contract_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(t, c, spec["type"], bool(spec["nullable"])) for t, cols in doc["tables"].items() for c, spec in cols.items()]
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def live_schema(spark: SparkSession, tables: dict) -> DataFrame:
    """(table, column, type, observed nullable) for every column of every table.

    Types come from each DataFrame's schema (metadata only); nullability from
    one null-count aggregate per table.
    """
    out = None
    for name, df in tables.items():
        if not df.columns:
            continue
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        rows = F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                     F.lit(canonical_type(df.schema[c].dataType)).alias("data_type"), (F.col(c) > 0).alias("nullable"))
            for c in df.columns
        ])
        part = nulls.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], CONTRACT_SCHEMA)
    return out


def declared_schema(spark: SparkSession, schemas: dict) -> DataFrame:
    """(table, column, type, nullable) of schemas whose nullability is declared, by table."""
    rows = [(t, f.name, canonical_type(f.dataType), f.nullable) for t, schema in schemas.items() for f in schema.fields]
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def contract_diff(contract: DataFrame, live: DataFrame) -> DataFrame:
    """One row per contracted column plus one per uncontracted live column."""
    c = contract.select("table_name", "column_name", F.col("data_type").alias("c_type"),
                        F.col("nullable").alias("c_nullable"))
    lv = live.select("table_name", "column_name", F.col("data_type").alias("l_type"),
                     F.col("nullable").alias("l_nullable"))
    live_tables = live.select("table_name").distinct().withColumn("_present", F.lit(True))
    j = c.join(lv, ["table_name", "column_name"], "full_outer").join(live_tables, "table_name", "left")
    kind = (
        F.when(F.col("c_type").isNull(), "new_column")
        .when(F.col("_present").isNull(), "missing_table")
        .when(F.col("l_type").isNull(), "missing_column")
        .when(F.col("l_type") != F.col("c_type"), "type_changed")
        .when(F.col("l_nullable") & ~F.col("c_nullable"), "nullability_loosened")
        .otherwise("ok")
    )
    detail = (
        F.when(F.col("c_type").isNull(), F.concat(F.col("l_type"), F.lit(" column not in the contract")))
        .when(F.col("_present").isNull(), F.concat(F.col("table_name"), F.lit(" does not exist")))
        .when(F.col("l_type").isNull(), F.concat(F.col("table_name"), F.lit("."), F.col("column_name"),
                                                 F.lit(" no longer exists")))
        .when(F.col("l_type") != F.col("c_type"), F.concat(F.col("c_type"), F.lit(" -> "), F.col("l_type")))
        .when(F.col("l_nullable") & ~F.col("c_nullable"), F.lit("was NOT NULL, now nullable"))
        .otherwise(F.lit(""))
    )
    return j.select(
        "table_name", "column_name", kind.alias("kind"),
        (~kind.isin("ok", "new_column")).alias("breaking"),
        F.when(kind == "new_column", F.lit("warning")).otherwise(F.lit("critical")).alias("severity"),
        detail.alias("detail"),
    )


def breaking_changes(diff_rows: Iterable) -> list:
    return [f"{r['table_name']}.{r['column_name']}: {r['kind']} ({r['detail']})" for r in diff_rows if r["breaking"]]


def check_write_compatible(df: DataFrame, registered: T.StructType) -> None:
    """Reject a write whose columns change type against the registered table schema
    (additive columns are allowed)."""
    reg = {f.name: f.dataType for f in registered.fields}
    bad = [f"{f.name}: {reg[f.name].simpleString()} -> {f.dataType.simpleString()}"
           for f in df.schema.fields if f.name in reg and reg[f.name] != f.dataType]
    if bad:
        raise TypeError(f"incompatible schema change: {bad}")
