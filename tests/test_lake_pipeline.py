"""Lake partitions/snapshots and the daily run with audit trail and recovery."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally.operators import checks as C
from tally.plans import daily_run
from tally.sources import lake

D = "2026-01-05"
T = dt.datetime(2026, 1, 5, 10, 0, 0)


def test_partition_overwrite_snapshots_and_empty(spark, tmp_root):
    df = spark.createDataFrame([(1, 10.0)], "id long, amount double")
    lake.write_partition(df, tmp_root, "silver", "t", D)
    lake.write_partition(df.withColumn("amount", F.lit(99.0)), tmp_root, "silver", "t", D)
    cur = lake.read_table(spark, tmp_root, "silver", "t")
    assert [r["amount"] for r in cur.collect()] == [99.0]
    snaps = lake.snapshots(spark, tmp_root, "silver", "t", D)
    assert len(snaps) == 2
    assert [r["amount"] for r in lake.read_snapshot(spark, tmp_root, "silver", "t", D, snaps[0]).collect()] == [10.0]
    assert [r["amount"] for r in lake.read_table(spark, tmp_root, "silver", "t", as_of_snapshot=snaps[0]).collect()] == [10.0]
    # an empty result replaces the partition's rows
    lake.write_partition(df.limit(0), tmp_root, "silver", "t", D)
    assert lake.read_table(spark, tmp_root, "silver", "t").count() == 0


def test_additive_column_and_type_change(spark, tmp_root):
    lake.write_partition(spark.createDataFrame([(1, 10.0)], "id long, amount double"), tmp_root, "bronze", "x", "2026-01-01")
    lake.write_partition(spark.createDataFrame([(2, 5.0, "n")], "id long, amount double, nickname string"),
                         tmp_root, "bronze", "x", "2026-01-02")
    rows = {r["id"]: r["nickname"] for r in lake.read_table(spark, tmp_root, "bronze", "x").collect()}
    assert rows == {1: None, 2: "n"}
    with pytest.raises(TypeError):
        lake.write_partition(spark.createDataFrame([(3, "bad")], "id long, amount string"), tmp_root, "bronze", "x",
                             "2026-01-03")
    assert lake.dates(spark, tmp_root, "bronze", "x") == ["2026-01-01", "2026-01-02"]
    # date filter prunes at path level
    assert lake.read_table(spark, tmp_root, "bronze", "x", ["2026-01-02"]).count() == 1


def _drill_sources(spark):
    """3 accounts (SYSTEM clearing negative), deposit 1000 then transfer 100."""
    acc = spark.createDataFrame([
        (1, "SYS-CLEARING", "clearing", "ACTIVE", "JPY", Decimal("-1000"), T, T, "SYSTEM", None),
        (2, "ACC-A", "alice", "ACTIVE", "JPY", Decimal("900"), T, T, "CUSTOMER", 10),
        (3, "ACC-B", "bob", "ACTIVE", "JPY", Decimal("100"), T, T, "CUSTOMER", 11)],
        "id long, account_number string, owner_name string, status string, currency string, balance decimal(19,4), "
        "created_at timestamp, updated_at timestamp, account_type string, owner_user_id long")
    led = spark.createDataFrame([
        (1, 100, 1, "DEBIT", Decimal(1000), T), (2, 100, 2, "CREDIT", Decimal(1000), T),
        (3, 200, 2, "DEBIT", Decimal(100), T), (4, 200, 3, "CREDIT", Decimal(100), T)],
        "id long, transaction_id long, account_id long, entry_type string, amount decimal(19,4), created_at timestamp")
    trf = spark.createDataFrame([(100, "k1", 1, 2, Decimal(1000), T), (200, "k2", 2, 3, Decimal(100), T)],
                                "id long, idempotency_key string, from_account_id long, to_account_id long, "
                                "amount decimal(19,4), created_at timestamp")
    return {"accounts": acc, "ledger_entries": led, "transfers": trf}


def test_daily_run_clean_and_audit(spark, tmp_root):
    src = _drill_sources(spark)
    daily_run.run_day(spark, src, tmp_root, D, "run-1")
    g = lake.read_table(spark, tmp_root, "gold", "reconciliation_summary").first()
    assert g["total_debits"] == Decimal(1100) and g["total_credits"] == Decimal(1100) and g["row_count"] == 4
    ev = lake.read_events(spark, tmp_root, "audit", "batch_control")
    done = {(r["layer"], r["source_table"]) for r in ev.filter("status = 'SUCCESS'").collect()}
    assert done == {s for s in daily_run.audit.EXPECTED_SLOTS if s != ("contract", "source")}
    rec = lake.read_events(spark, tmp_root, "audit", "reconciliation_results").first()
    assert rec["within_tolerance"] and rec["diff_amount"] == 0
    dq = lake.read_events(spark, tmp_root, "audit", "dq_results")
    assert dq.filter(~F.col("passed")).count() == 0
    assert dq.filter(F.col("rule_name").like("gx:%")).count() == 8
    # rerun of the same run skips every slot: nothing new in the audit log
    before = ev.count()
    daily_run.run_day(spark, src, tmp_root, D, "run-1")
    assert lake.read_events(spark, tmp_root, "audit", "batch_control").count() == before
    # another run may not take the slots
    with pytest.raises(daily_run.SlotRefused):
        daily_run.run_day(spark, src, tmp_root, D, "run-2")


def test_failure_then_recovery(spark, tmp_root):
    src = _drill_sources(spark)
    with pytest.raises(RuntimeError):
        daily_run.run_day(spark, src, tmp_root, D, "run-1", fail_at="silver_transform.ledger_entries")
    ev = lake.read_events(spark, tmp_root, "audit", "batch_control")
    assert ev.filter("status = 'FAILED' AND source_table = 'ledger_entries' AND layer = 'silver'").count() == 1
    daily_run.run_day(spark, src, tmp_root, D, "run-1")
    ev = lake.read_events(spark, tmp_root, "audit", "batch_control")
    # accounts silver ran once; ledger silver failed once then succeeded
    assert ev.filter("layer = 'silver' AND source_table = 'accounts' AND status = 'SUCCESS'").count() == 1
    assert ev.filter("layer = 'silver' AND source_table = 'ledger_entries' AND status = 'SUCCESS'").count() == 1
    assert ev.filter("layer = 'reconcile' AND status = 'SUCCESS'").count() == 1


def test_gate_stops_gold_when_rules_bypassed(spark, tmp_root):
    src = _drill_sources(spark)
    # a bad row written straight into Silver (bypassing the rules) fails the gate
    bad = src["accounts"].limit(1).withColumn("status", F.lit("BOGUS")).withColumn("id", F.lit(99).cast("long")) \
        .withColumn("business_date", F.lit(D)).withColumn("_batch_id", F.lit("x")).withColumn(
        "_ingested_at", F.current_timestamp())
    with pytest.raises(RuntimeError):
        daily_run.run_day(spark, src, tmp_root, D, "run-1", fail_at="gate_validate_silver")
    cur = lake.read_table(spark, tmp_root, "silver", "accounts", [D]).drop(lake.SNAPSHOT)
    lake.write_partition(cur.unionByName(bad.select(*cur.columns)), tmp_root, "silver", "accounts", D)
    with pytest.raises(RuntimeError, match="gate failed"):
        daily_run.run_day(spark, src, tmp_root, D, "run-1")
    assert lake.read_table(spark, tmp_root, "gold", "reconciliation_summary") is None
    dq = lake.read_events(spark, tmp_root, "audit", "dq_results")
    ev = lake.read_events(spark, tmp_root, "audit", "batch_control")
    failed = daily_run.audit.run_failures(dq, ev, "run-1", layer="dq_gx")
    # the injected copy repeats an account number and carries a bad status
    assert {r["rule_name"] for r in failed.collect()} == {"gx:expect_column_values_to_be_in_set:status",
                                                          "gx:expect_column_values_to_be_unique:account_number"}
    assert '"engine":"tally"' in dq.first()["details"]


def test_sql_checks_find_bad_source_rows(spark):
    src = _drill_sources(spark)
    led = src["ledger_entries"].unionByName(spark.createDataFrame(
        [(5, 300, 2, "DEBIT", Decimal(50), T), (6, 300, 77, "CREDIT", Decimal(40), T)], src["ledger_entries"].schema))
    trf = src["transfers"].unionByName(src["transfers"].limit(1).withColumn("id", F.lit(999).cast("long")))
    led.createOrReplaceTempView("source_ledger_entries")
    trf.createOrReplaceTempView("source_transfers")
    src["accounts"].createOrReplaceTempView("source_accounts")
    checks = [c for c in C.load_checks() if c.engine == "source"]
    res = {r["rule_name"]: r["rows_failed"] for r in C.run_checks(spark, checks, D)}
    assert res == {"sql:duplicate_transfer_idempotency_key": 1, "sql:orphan_ledger_entries": 1,
                   "sql:unbalanced_ledger_transactions": 1}
    with pytest.raises(C.ChecksFailed):
        C.raise_on_failures(C.run_checks(spark, checks, D))


def test_daily_run_on_testdata_detects_quarantine_gap(spark, tmp_root):
    """On the derived bank tables, entries of quarantined (overdrawn) accounts are
    held back from Silver, so Gold no longer reconciles with the source: the run
    stops at the reconcile step and records the difference."""
    from tests.conftest import SF
    from tally.sources import bank

    src = {"accounts": bank.accounts(spark, SF), "ledger_entries": bank.ledger_entries(spark, SF),
           "transfers": bank.transfers(spark, SF)}
    led = src["ledger_entries"]
    q = daily_run.M.silver_all(daily_run.M.bronze_tables(spark, SF))["ledger_entries"].quarantined
    day = q.select("business_date").orderBy("business_date").first()[0]
    with pytest.raises(RuntimeError, match="reconciliation mismatch"):
        daily_run.run_day(spark, src, tmp_root, day, "run-td")
    rec = lake.read_events(spark, tmp_root, "audit", "reconciliation_results").first()
    assert not rec["within_tolerance"] and rec["diff_amount"] > 0
    src_rows = led.filter(F.date_format("created_at", "yyyy-MM-dd") == day).count()
    assert rec["source_row_count"] == src_rows and rec["gold_row_count"] < src_rows


def test_two_runs_cannot_both_start_a_slot(spark, tmp_root):
    """Both read the log before either writes to it; one gets the marker, the other is refused."""
    a, b = (daily_run.Run(spark, tmp_root, D, name) for name in ("a", "b"))
    assert a.decision("bronze", "accounts")[0] == b.decision("bronze", "accounts")[0] == "PROCEED"
    assert [a.claim("bronze", "accounts", 0), b.claim("bronze", "accounts", 0)] == [True, False]
    assert b.claim("bronze", "transfers", 0)
    with pytest.raises(daily_run.SlotRefused):
        b.step("t", "bronze", "accounts", lambda batch: (0, 0))


def test_audit_rows_tell_attempts_and_times(spark, tmp_root):
    run = daily_run.Run(spark, tmp_root, D, "r", fail_at="t")
    with pytest.raises(RuntimeError):
        run.step("t", "bronze", "accounts", lambda batch: (0, 0))
    run.fail_at = None
    run.step("t", "bronze", "accounts", lambda batch: (3, 2))
    ev = lake.read_events(spark, tmp_root, "audit", "batch_control").collect()
    assert sorted((r["attempt"], r["status"]) for r in ev) == [(1, "FAILED"), (1, "RUNNING"), (2, "RUNNING"), (2, "SUCCESS")]
    assert all((r["ended_at"] is None) == (r["status"] == "RUNNING") for r in ev)
    assert all(r["ended_at"] >= r["started_at"] for r in ev if r["ended_at"])
