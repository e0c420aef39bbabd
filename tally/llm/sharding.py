"""Sharding: proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within each source by a seeded hash and ranked; rank over count is
the row's fractional rank.  All rows sorted by it form one sequence in which every
stretch holds the sources in their proportions, and the sequence is cut into shards
whose row counts differ by at most one (law ``rows``).

A source keeps a phase of its own (a hash of its name), so that many small sources
do not all fall at the same place.  Null sources are one source.  A null text has no
bytes; repeated rows are rows of their own; ties in the hash go by id, size and crc.
An empty table gives an empty result.  Only the id, text and source are read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.common import same, written

ROWS_PER_BUCKET = 256  # aimed at; buckets grow beyond 2^MOST_BITS of them
MOST_BITS = 14


def unit(*cols: Column, seed: int) -> Column:
    """A 63-bit hash of the columns, not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def _ranked(df: DataFrame, part: list[str], bucket: str, order: list[str], rank: str, total: str | None = None) -> DataFrame:
    """Adds the row's 0-based rank within ``part``: the counts of lower buckets plus
    its place in its own bucket, so no window holds more than one bucket's rows."""
    counts = df.groupBy(*part, bucket).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*part) if part else W.partitionBy()
    sums = [F.coalesce(F.sum("_c").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below")]
    if total:
        sums.append(F.sum("_c").over(w).alias(total))
    counts = counts.select(*part, bucket, *sums)
    inner = W.partitionBy(*part, bucket).orderBy(*order)
    return (same(df, counts, [*part, bucket], "inner")
            .withColumn(rank, F.col("_below") + F.row_number().over(inner) - 1).drop("_below"))


def interleaved_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                       source_col: str = "source", seed: int = 17) -> DataFrame:
    """Id, source, size, text_crc32, shard and slot (gapless from 0) of every row."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))
    rows = written(rows.withColumn("u", unit(F.col("id"), seed=seed)), "shard-rows")
    n = rows.count()
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, n / ROWS_PER_BUCKET)))))
    rows = rows.withColumn("b", F.shiftright("u", 63 - bits).cast("int"))
    ranked = _ranked(rows, ["source"], "b", ["u", "id", "size", "crc"], "rank", total="of")
    phase = unit(F.col("source"), seed=seed + 1) / F.lit(float(2 ** 63))
    ranked = ranked.withColumn("f", (F.col("rank") + phase) / F.col("of"))
    ranked = written(ranked.withColumn("g", F.least(F.floor(F.col("f") * (1 << bits)), F.lit((1 << bits) - 1)).cast("int"))
                     .select("id", "source", "size", "crc", "u", "f", "g"), "shard-ranks")
    placed = _ranked(ranked, [], "g", ["f", "u", "source", "id", "size", "crc"], "pos")
    shard = F.expr(f"pos * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {max(n, 1)} + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("pos") - first).cast("long"))
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("crc").alias("text_crc32"),
                    "shard", "slot"))
