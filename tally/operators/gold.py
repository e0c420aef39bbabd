"""Gold aggregates over Silver: reconciliation totals, transfer volume, per-account movement.

Every builder groups by ``business_date`` so one job can build all dates of a
backfill at once; a single-date build is the same call on a date-filtered input
(the filter prunes partitions).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.money import TOTAL, credit_part, debit_part, total

DATE = "business_date"


def reconciliation_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(DATE).agg(
        total(debit_part(F.col("entry_type"), F.col("amount"))).alias("total_debits"),
        total(credit_part(F.col("entry_type"), F.col("amount"))).alias("total_credits"),
        F.count(F.lit(1)).cast("long").alias("row_count"),
    )


def daily_transfer_volume(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy(DATE).agg(
        F.count(F.lit(1)).cast("long").alias("transfer_count"),
        total(F.col("amount")).alias("total_transfer_amount"),
    )


def account_ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(DATE, "account_id").agg(
        total(debit_part(F.col("entry_type"), F.col("amount"))).alias("total_debits"),
        total(credit_part(F.col("entry_type"), F.col("amount"))).alias("total_credits"),
    ).withColumn("net_movement", (F.col("total_credits") - F.col("total_debits")).cast(TOTAL))


def global_summary(ledger: DataFrame) -> DataFrame:
    """Single-row totals (zero, not NULL, on an empty ledger)."""
    return ledger.agg(
        total(debit_part(F.col("entry_type"), F.col("amount"))).alias("total_debits"),
        total(credit_part(F.col("entry_type"), F.col("amount"))).alias("total_credits"),
        F.count(F.lit(1)).cast("long").alias("row_count"),
    )


def reconcile(gold: DataFrame, source: DataFrame, tolerance: str = "0.0001") -> DataFrame:
    """Gold totals vs source totals per business_date.

    diff = max(|d debits|, |d credits|); within_tolerance = diff <= tolerance;
    also reports row-count agreement and whether the source itself balances.
    A date missing on either side is reported with zero totals on that side.
    """
    g = gold.select(DATE, F.col("total_debits").alias("gold_total_debits"),
                    F.col("total_credits").alias("gold_total_credits"), F.col("row_count").alias("gold_row_count"))
    s = source.select(DATE, F.col("total_debits").alias("source_total_debits"),
                      F.col("total_credits").alias("source_total_credits"),
                      F.col("row_count").alias("source_row_count"))
    j = s.join(g, DATE, "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(TOTAL)
    zc = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    diff = F.greatest(F.abs(z("gold_total_debits") - z("source_total_debits")),
                      F.abs(z("gold_total_credits") - z("source_total_credits"))).cast(TOTAL)
    return j.select(
        DATE,
        z("source_total_debits").alias("source_total_debits"), z("source_total_credits").alias("source_total_credits"),
        z("gold_total_debits").alias("gold_total_debits"), z("gold_total_credits").alias("gold_total_credits"),
        zc("source_row_count").alias("source_row_count"), zc("gold_row_count").alias("gold_row_count"),
        diff.alias("diff_amount"),
        (diff <= F.lit(tolerance).cast(TOTAL)).alias("within_tolerance"),
        (zc("source_row_count") == zc("gold_row_count")).alias("row_counts_match"),
        (z("source_total_debits") == z("source_total_credits")).alias("globally_balanced"),
    )
