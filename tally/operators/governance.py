"""Masked views: PII replaced, shape kept, so queries written against the full
column list keep working."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.text import MASK_TEXT, mask_keep_two


def masked_accounts(accounts: DataFrame) -> DataFrame:
    """owner_name fully masked; owner_user_id left out."""
    return accounts.select(
        "id", "account_number", F.lit(MASK_TEXT).alias("owner_name"), "status", "currency", "balance",
        "account_type", "created_at", "updated_at",
    )


def masked_users(users: DataFrame) -> DataFrame:
    """username keeps its first two characters, the rest become '*'."""
    return users.select("id", mask_keep_two(F.col("username")).alias("username"), "role")


def register_masked_views(spark, accounts: DataFrame, users: DataFrame, prefix: str = "restricted_") -> None:
    masked_accounts(accounts).createOrReplaceTempView(f"{prefix}accounts")
    masked_users(users).createOrReplaceTempView(f"{prefix}users")
