"""Single-pass rules: reference semantics and the bad-row quarantine scenario."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally.operators import rules as R
from tally.plans import medallion as M

ACC = ("id long, account_number string, owner_name string, status string, currency string, balance decimal(19,4), "
       "account_type string, owner_user_id long")
LED = "id long, transaction_id long, account_id long, entry_type string, amount decimal(19,4)"


def _accounts(spark):
    rows = [
        (1, "ACC-1", "a", "ACTIVE", "JPY", Decimal("100"), "CUSTOMER", 1),
        (2, "ACC-2", "b", "ACTIVE", "JPY", Decimal("5"), "CUSTOMER", 2),
        (9, "SYS-1", "clearing", "ACTIVE", "JPY", Decimal("-1000"), "SYSTEM", None),   # exempt
        (10, "ACC-10", "neg", "ACTIVE", "JPY", Decimal("-50"), "CUSTOMER", 3),        # negative_balance
        (11, "ACC-11", "bogus", "BOGUS", "JPY", Decimal("1"), "CUSTOMER", 4),         # invalid_status
        (12, "ACC-DUP", "dupa", "ACTIVE", "JPY", Decimal("1"), "CUSTOMER", 5),        # duplicate a
        (13, "ACC-DUP", "dupb", "ACTIVE", "JPY", Decimal("1"), "CUSTOMER", 6),        # duplicate b
        (None, "ACC-N", "nullid", "ACTIVE", "JPY", Decimal("1"), "CUSTOMER", 7),      # null_id
        (14, "ACC-14", "nullstatus", None, "JPY", None, "CUSTOMER", 8),               # NULLs pass isin/non_negative
    ]
    return spark.createDataFrame(rows, ACC).withColumn("_ingested_at", F.current_timestamp())


def test_accounts_quarantine_scenario(spark):
    res = M.silver(_accounts(spark), "accounts")
    counts = {r["rule_name"]: r["rows_failed"] for r in res.counts().collect()}
    assert counts == {"not_null:id": 1, "not_null:account_number": 0, "unique:account_number": 2,
                      "isin:status": 1, "non_negative:balance": 1}
    clean = sorted(r["id"] for r in res.clean.collect())
    assert clean == [1, 2, 9, 14]
    q = {r["id"]: r["failed_rules"] for r in res.quarantined.collect()}
    assert q[10] == ["non_negative:balance"] and q[11] == ["isin:status"]
    assert q[12] == ["unique:account_number"] and q[13] == ["unique:account_number"]
    assert q[None] == ["not_null:id"]
    # bronze = silver + quarantine
    assert res.clean.count() + res.quarantined.count() == _accounts(spark).count()


def test_ledger_rules_with_ri(spark):
    acc = M.silver(_accounts(spark), "accounts").clean
    rows = [
        (1, 1, 1, "DEBIT", Decimal("10")),
        (2, 1, 2, "CREDIT", Decimal("10")),
        (3, 2, 777, "DEBIT", Decimal("10")),     # orphan_account
        (4, 3, 1, "DEBIT", Decimal("0")),        # non_positive_amount
        (5, 4, 1, "REFUND", Decimal("10")),      # invalid_entry_type
        (6, 5, None, "CREDIT", Decimal("10")),   # null_account_id (and RI)
        (7, 6, 10, "DEBIT", Decimal("10")),      # account quarantined upstream -> RI cascade
        (8, 7, 1, "DEBIT", None),                # NULL amount passes positive (no not_null rule)
    ]
    led = spark.createDataFrame(rows, LED).withColumn("_ingested_at", F.current_timestamp())
    res = M.silver(led, "ledger_entries", acc)
    counts = {r["rule_name"]: r["rows_failed"] for r in res.counts().collect()}
    assert counts == {"not_null:account_id": 1, "isin:entry_type": 1, "positive:amount": 1,
                      "referential_integrity:account_id->id": 3}
    assert sorted(r["id"] for r in res.clean.collect()) == [1, 2, 8]
    assert sorted(r["id"] for r in res.quarantined.collect()) == [3, 4, 5, 6, 7]


def test_quarantine_is_by_id(spark):
    # two rows share id 1; one fails -> both leave (K4)
    df = spark.createDataFrame([(1, Decimal("5")), (1, Decimal("-5")), (2, Decimal("1"))], "id long, amount decimal(19,4)")
    ev = R.evaluate(df, [R.positive("amount")])
    assert sorted(r["id"] for r in ev.clean().collect()) == [2]
    assert ev.quarantined().count() == 2


def test_warning_counts_but_never_quarantines(spark):
    df = spark.createDataFrame([(1, -1), (2, 3)], "id long, v long")
    ev = R.evaluate(df, [R.positive("v").with_severity(R.WARNING)])
    assert ev.clean().count() == 2
    assert ev.counts().first()["rows_failed"] == 1


def test_user_defined_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, s string")
    long_s = R.row_rule("len_le_1", F.length("s") > 1)
    odd = R.frame_rule("odd_ids", lambda d: d.filter(F.col("_row_id") % 2 == 1))
    ev = R.evaluate(df, [long_s, odd])
    counts = {r["rule_name"]: r["rows_failed"] for r in ev.counts().collect()}
    assert counts == {"len_le_1": 1, "odd_ids": 2}
    assert sorted(r["id"] for r in ev.clean().collect()) == []


def test_gate_rules_catch_bypassed_rows(spark):
    rows = [(1, "A1", "x", "ACTIVE", "JPY", Decimal("-1"), "CUSTOMER", 1),
            (2, "A1", "y", "BOGUS", "JPY", Decimal("1"), "CUSTOMER", 2),
            (None, "A3", "z", "ACTIVE", "JPY", Decimal("-9"), "SYSTEM", None)]
    df = spark.createDataFrame(rows, ACC)
    got = {r["rule_name"]: r["rows_failed"] for r in R.gate_counts(df, M.gate_rules("accounts")).collect()}
    assert got == {"gx:expect_column_values_to_not_be_null:id": 1,
                   "gx:expect_column_values_to_be_unique:account_number": 2,
                   "gx:expect_column_values_to_be_in_set:status": 1,
                   "gx:expect_column_values_to_be_between:balance": 1}
    with pytest.raises(R.GateFailed):
        R.assert_gate([{**r.asDict(), "table_name": "accounts"} for r in
                       R.gate_counts(df, M.gate_rules("accounts")).collect()])


def test_single_pass_plan_scans_bronze_once_per_output(spark):
    """Row rules add no joins: the counts aggregate reads the source once."""
    df = spark.createDataFrame([(1, 5)], "id long, v long")
    ev = R.evaluate(df, [R.not_null("v"), R.positive("v"), R.isin("v", ["1"])])
    plan = ev.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
