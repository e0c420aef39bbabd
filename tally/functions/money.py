"""Money columns: always decimal, never double."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(19, 4)
# Aggregated money is reported at a fixed wide type so results compare across engines.
TOTAL = DecimalType(38, 4)


def money(col: Column) -> Column:
    return col.cast(MONEY)


def total(col: Column) -> Column:
    """sum(col) as decimal(38,4); zero (not NULL) over no rows."""
    return F.coalesce(F.sum(col), F.lit(0)).cast(TOTAL)


def signed_amount(entry_type: Column, amount: Column) -> Column:
    """CREDIT adds to the account, DEBIT takes from it."""
    return F.when(entry_type == "CREDIT", amount).when(entry_type == "DEBIT", -amount).otherwise(F.lit(0))


def debit_part(entry_type: Column, amount: Column) -> Column:
    return F.when(entry_type == "DEBIT", amount).otherwise(F.lit(0))


def credit_part(entry_type: Column, amount: Column) -> Column:
    return F.when(entry_type == "CREDIT", amount).otherwise(F.lit(0))
