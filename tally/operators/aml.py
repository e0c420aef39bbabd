"""Anti-money-laundering rules over a transfer table.

* threshold    amount > threshold (strict)
* velocity     >= N transfers from the same account in the last W (strict cutoff:
               a transfer exactly W old is outside), the current one included
* structuring  >= N transfers with min <= amount <= threshold in the last W;
               the current transfer need not qualify itself
* flags        one record per (transfer, failed rule), customer senders only

A look-back count is the difference of two prefix counts: of all qualifying transfers of
the account up to now, and of those up to the start of the window.  Transfers are first
counted per (account, instant); each instant gives its counts and, for each window, a mark at
the window's start; all are put in slices by (account, time) and summed up there.  No row
is copied, the length of a window doesn't matter, and a busy account lies in many slices.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.money import MONEY
from tally.operators.slices import prefix_sums, sliced

# Reference defaults (parameters of every function).
THRESHOLD = "1000000.00"
VELOCITY_COUNT = 5
VELOCITY_WINDOW = "10 minutes"
STRUCTURING_COUNT = 3
STRUCTURING_WINDOW = "24 hours"
STRUCTURING_MINIMUM = "900000.00"

FLAG_AMOUNT = "decimal(19,2)"


def _micros(interval: str) -> int:
    n, unit = interval.split()
    n = int(n)
    unit = unit.rstrip("s").lower()
    scale = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
             "hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    return n * scale


def _ts_micros(col: str = "created_at"):
    return F.unix_micros(F.col(col).cast("timestamp"))


def look_back_counts(transfers: DataFrame, looks: dict[str, tuple[str, Column | None]], account: str = "from_account_id",
                     ts: str = "created_at", slices: int | None = None) -> DataFrame:
    """For every transfer and each (window, qualifying) of ``looks``: how many qualifying transfers
    (all, if None) of the same account fall in (t - window, t], peers with equal t included.
    A transfer without a time counts 0."""
    names = list(looks)
    base = transfers.withColumn("_t", _ts_micros(ts))
    weigh = [F.sum(F.coalesce(F.lit(1) if q is None else q.cast("int"), F.lit(0))).alias(f"_n{i}") for i, (_, q) in enumerate(looks.values())]
    instants = base.filter(F.col("_t").isNotNull()).groupBy(F.col(account).alias("_key"), "_t").agg(*weigh)
    # at the same time, the transfers (kind 0) come before the marks: a transfer just a window old is outside
    marks = [F.struct(F.col("_t").alias("at"), F.lit(0).alias("kind"))]
    marks += [F.struct((F.col("_t") - F.lit(_micros(w))).alias("at"), F.lit(i).alias("kind")) for i, (w, _) in enumerate(looks.values(), 1)]
    points = instants.withColumn("_m", F.explode(F.array(*marks))).select(
        "_key", F.col("_m.at").alias("_at"), F.col("_m.kind").alias("_kind"), "_t",
        *[F.when(F.col("_m.kind") == 0, F.col(f"_n{i}")).otherwise(0).alias(f"_n{i}") for i in range(len(names))])
    order = ["_at", "_kind", "_t"]
    rows = sliced(points, "_key", *order, slices=slices, name="instants")
    sums = prefix_sums(rows, ["_key"], order, {f"_sum{i}": F.col(f"_n{i}") for i in range(len(names))})
    counts = sums.groupBy("_key", F.col("_t").alias("_of")).agg(
        *[F.sum(F.when(F.col("_kind") == 0, F.col(f"_sum{i}")).when(F.col("_kind") == i + 1, -F.col(f"_sum{i}"))).cast("long").alias(f"_count{i}")
          for i in range(len(names))])
    out = base.join(counts, F.col(account).eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_of")), "left")
    return out.select(*transfers.columns, *[F.coalesce(F.col(f"_count{i}"), F.lit(0)).cast("long").alias(n) for i, n in enumerate(names)])


def window_counts(transfers: DataFrame, window: str, qualifying: Column | None = None, account: str = "from_account_id",
                  ts: str = "created_at", out: str = "window_count", slices: int | None = None) -> DataFrame:
    """The one count of :func:`look_back_counts`."""
    return look_back_counts(transfers, {out: (window, qualifying)}, account, ts, slices)


def threshold_hits(transfers: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    return transfers.filter(F.col("amount") > F.lit(threshold).cast(MONEY))


def qualifies(minimum: str, threshold: str) -> Column:
    return (F.col("amount") >= F.lit(minimum).cast(MONEY)) & (F.col("amount") <= F.lit(threshold).cast(MONEY))


def velocity(transfers: DataFrame, count: int = VELOCITY_COUNT, window: str = VELOCITY_WINDOW,
             slices: int | None = None) -> DataFrame:
    return window_counts(transfers, window, out="velocity_count", slices=slices).withColumn(
        "velocity_flag", F.col("velocity_count") >= count)


def structuring(transfers: DataFrame, count: int = STRUCTURING_COUNT, window: str = STRUCTURING_WINDOW,
                minimum: str = STRUCTURING_MINIMUM, threshold: str = THRESHOLD, slices: int | None = None) -> DataFrame:
    return window_counts(transfers, window, qualifying=qualifies(minimum, threshold), out="structuring_count",
                         slices=slices).withColumn("structuring_flag", F.col("structuring_count") >= count)


def aml_flags(transfers: DataFrame, accounts: DataFrame, threshold: str = THRESHOLD,
              velocity_count: int = VELOCITY_COUNT, velocity_window: str = VELOCITY_WINDOW,
              structuring_count: int = STRUCTURING_COUNT, structuring_window: str = STRUCTURING_WINDOW,
              structuring_minimum: str = STRUCTURING_MINIMUM) -> DataFrame:
    """Suspicious-activity records for customer transfers (up to three per transfer).

    SYSTEM senders are left out before any window is computed; both windows are
    counted in one pass.
    """
    senders = accounts.filter(F.col("account_type") == "CUSTOMER").select(
        F.col("id").alias("_acc"), F.col("owner_user_id").alias("user_id"))
    t = transfers.join(senders, transfers.from_account_id == senders._acc).drop("_acc")
    t = look_back_counts(t, {"_velocity": (velocity_window, None),
                             "_structuring": (structuring_window, qualifies(structuring_minimum, threshold))})
    reasons = F.array_compact(F.array(
        F.when(F.col("amount") > F.lit(threshold).cast(MONEY), F.lit("THRESHOLD")),
        F.when(F.col("_velocity") >= velocity_count, F.lit("VELOCITY")),
        F.when(F.col("_structuring") >= structuring_count, F.lit("STRUCTURING")),
    ))
    return t.select(
        "user_id", F.col("id").alias("transfer_id"), F.explode(reasons).alias("reason"),
        F.col("amount").cast(FLAG_AMOUNT).alias("amount"), F.lit("OPEN").alias("status"), "created_at",
    ).withColumn("id", F.concat_ws(":", F.col("transfer_id").cast("string"), F.col("reason")))


def open_queue(flags: DataFrame) -> DataFrame:
    """Review queue: OPEN flags, newest first."""
    return flags.filter(F.col("status") == "OPEN").orderBy(F.col("created_at").desc(), F.col("id"))


def review(flags: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark flags REVIEWED by id.  Returns (updated flags, action ids with no flag)."""
    a = actions.select(F.col("flag_id").alias("_rid")).distinct().withColumn("_hit", F.lit(True))
    updated = flags.join(a, flags.id == a._rid, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("REVIEWED")).otherwise(F.col("status"))).drop("_rid", "_hit")
    missing = actions.join(flags.select(F.col("id").alias("_fid")), F.col("flag_id") == F.col("_fid"), "left_anti")
    return updated, missing
