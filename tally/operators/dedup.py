"""Keep the newest row per key.

Written as a grouped ``max`` over a struct whose leading fields are the
ordering columns: Spark combines map-side, so a key holding a third of the table
is reduced to one row per input partition before the shuffle (a window over the
key would sort all of its rows in one task).  Remaining columns break ties, so
the winner is deterministic even when ordering values are equal.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], veto: str | None = None) -> DataFrame:
    """Newest row per key.  With ``veto`` (a boolean column), keys having any
    TRUE veto row are dropped entirely; the veto column is not returned."""
    keys = list(keys)
    order = list(order)
    cols_out = [c for c in df.columns if c != veto]
    rest = [c for c in cols_out if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)])
    aggs = [F.max(packed).alias("_w")]
    if veto is not None:
        aggs.append(F.bool_or(F.col(veto)).alias("_veto"))
    agg = df.groupBy(*keys).agg(*aggs)
    if veto is not None:
        agg = agg.filter(~F.coalesce(F.col("_veto"), F.lit(False)))
    cols = []
    for c in cols_out:
        if c in keys:
            cols.append(F.col(c))
        elif c in order:
            cols.append(F.col(f"_w._o{order.index(c)}").alias(c))
        else:
            cols.append(F.col(f"_w._r{rest.index(c)}").alias(c))
    return agg.select(*cols)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "occurrences") -> DataFrame:
    """GROUP BY keys HAVING count(*) > 1."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias(count_name)).filter(F.col(count_name) > 1)
