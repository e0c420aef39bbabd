"""One business date through the lake: contract -> bronze -> silver -> gate ->
gold -> reconcile -> SQL checks, with an append-only audit trail.

Every step is a *slot* (layer, source_table, business_date).  Before a step
runs, the slot decision over the batch log says PROCEED, SKIP (already done by
this run: a retry resumes where it failed) or REFUSE (held by another run).
Each step appends RUNNING, then SUCCESS or FAILED events; rule results and the
reconciliation land in their own audit tables.  The ``fail_at`` argument
injects a failure for recovery tests.
"""
from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tally import __version__
from tally.operators import audit, checks, contract, gold, rules
from tally.plans import medallion as M
from tally.sources import lake

CONTRACT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "checks", "contracts", "source_contract.json")
EVENT_SCHEMA = ("batch_id string, dag_run_id string, task_id string, attempt int, layer string, source_table string, "
                "business_date string, status string, started_at timestamp, ended_at timestamp, rows_read long, "
                "rows_written long, error_message string")
DQ_SCHEMA = ("check_id string, batch_id string, rule_name string, layer string, table_name string, severity string, "
             "rows_checked long, rows_failed long, passed boolean, details string, business_date string, created_at timestamp")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class SlotRefused(RuntimeError):
    pass


class Run:
    def __init__(self, spark: SparkSession, root: str, business_date: str, run_id: str, fail_at: str | None = None):
        self.spark, self.root, self.date, self.run_id, self.fail_at = spark, root, business_date, run_id, fail_at

    # ------------------------------------------------------------ audit
    def _event(self, batch_id, task_id, attempt, layer, table, status, started, rows_read=None, rows_written=None, error=None):
        row = [(batch_id, self.run_id, task_id, attempt, layer, table, self.date, status, started,
                None if status == "RUNNING" else _now(), rows_read, rows_written, error)]
        lake.append(self.spark.createDataFrame(row, EVENT_SCHEMA), self.root, "audit", "batch_control")

    def decision(self, layer: str, table: str) -> tuple[str, int, int]:
        """What to do about a slot, how often it was started, and how often by this run."""
        events = lake.read_events(self.spark, self.root, "audit", "batch_control")
        if events is None:
            return "PROCEED", 0, 0
        req = self.spark.createDataFrame([(layer, table, self.date, self.run_id)],
                                         "layer string, source_table string, business_date string, dag_run_id string")
        mine = (F.col("layer") == layer) & (F.col("source_table") == table) & (F.col("business_date") == self.date)
        n = events.filter(mine & (F.col("status") == "RUNNING")).agg(
            F.count("*").alias("all"), F.count_if(F.col("dag_run_id") == self.run_id).alias("own")).first()
        return audit.slot_decision(req, events).first()["decision"], n["all"], n["own"]

    def claim(self, layer: str, table: str, started: int) -> bool:
        """Takes the slot's next start.  Two runs that read the same log try to create the
        same marker, and one of them gets it."""
        return lake.create_once(self.spark, f"{self.root.rstrip('/')}/audit/_claims/{layer}.{table}.{self.date}.{started}")

    def record_dq(self, batch_id: str, counts: DataFrame, layer: str, table: str) -> list:
        details = F.to_json(F.struct(F.lit("tally").alias("engine"), F.lit(__version__).alias("version"),
                                     F.lit(self.run_id).alias("run")))
        rows = counts.withColumn("check_id", F.uuid()).withColumn("created_at", F.lit(_now())).withColumn(
            "batch_id", F.lit(batch_id)).withColumn("layer", F.lit(layer)).withColumn(
            "table_name", F.lit(table)).withColumn("details", details).withColumn(
            "business_date", F.lit(self.date)).select(*[c.split()[0] for c in DQ_SCHEMA.split(", ")])
        collected = rows.collect()  # one row per rule: bounded by the rule set
        lake.append(self.spark.createDataFrame(collected, DQ_SCHEMA), self.root, "audit", "dq_results")
        return collected

    def step(self, task_id: str, layer: str, table: str, fn):
        d, starts, own = self.decision(layer, table)
        if d == "SKIP":
            return None
        if d == "REFUSE" or not self.claim(layer, table, starts):
            raise SlotRefused(f"slot ({layer}, {table}, {self.date}) is held by another run")
        batch_id, began, attempt = str(uuid.uuid4()), _now(), own + 1
        self._event(batch_id, task_id, attempt, layer, table, "RUNNING", began)
        try:
            if self.fail_at == task_id:
                raise RuntimeError(f"simulated failure injected for {task_id}")
            read, written = fn(batch_id)
        except Exception as exc:  # noqa: BLE001 - recorded, then re-raised
            self._event(batch_id, task_id, attempt, layer, table, "FAILED", began, error=str(exc))
            raise
        self._event(batch_id, task_id, attempt, layer, table, "SUCCESS", began, read, written)
        return batch_id


def run_day(spark: SparkSession, sources: dict, root: str, business_date: str, run_id: str,
            contract_doc: dict | None = None, fail_at: str | None = None, live: DataFrame | None = None) -> Run:
    """``sources``: source DataFrames ``accounts`` (full snapshot), ``ledger_entries`` and
    ``transfers`` (rows of the day are selected by created_at).  ``live`` is the source's schema as
    its database declares it, which the contract is held against; without it NULLs are looked for."""
    r = Run(spark, root, business_date, run_id, fail_at)
    begin = dt.date.fromisoformat(business_date)
    # a range on the bare column, so that it reaches the scan or the database
    of_day = (F.col("created_at") >= F.lit(begin).cast("timestamp_ntz")) & (
        F.col("created_at") < F.lit(begin + dt.timedelta(days=1)).cast("timestamp_ntz"))
    day = {"accounts": sources["accounts"], **{t: sources[t].filter(of_day) for t in ("ledger_entries", "transfers")}}

    # contract gate
    if contract_doc is not None:
        def _contract(batch_id):
            seen = contract.live_schema(spark, sources) if live is None else live
            diff = contract.contract_diff(contract.contract_frame(spark, contract_doc), seen)
            counts = diff.select(
                F.concat(F.lit("contract:"), F.when(F.col("kind") == "new_column", F.lit("new_column:")).otherwise(F.lit("")),
                         F.col("table_name"), F.lit("."), F.col("column_name")).alias("rule_name"),
                "severity", F.lit(1).cast("long").alias("rows_checked"),
                F.when(F.col("kind") == "ok", 0).otherwise(1).cast("long").alias("rows_failed"),
            ).withColumn("passed", F.col("rows_failed") == 0)
            rows = r.record_dq(batch_id, counts, "contract", "source")
            broken = [x["rule_name"] for x in rows if not x["passed"] and x["severity"] == "critical"]
            if broken:
                raise RuntimeError(f"source contract broken, extraction stopped: {broken}")
            return len(rows), len(rows)
        r.step("source_contract_check", "contract", "source", _contract)

    # bronze: tag, count while writing (Observation: one pass), publish
    for t in M.TABLES:
        def _bronze(batch_id, t=t):
            obs = Observation(f"bronze_{t}_{batch_id[:8]}")
            tagged = M.tag_bronze(day[t], batch_id, business_date=business_date).observe(obs, F.count(F.lit(1)).alias("n"))
            lake.write_partition(tagged, root, "bronze", t, business_date)
            n = obs.get["n"]
            return n, n
        r.step(f"bronze_ingest.{t}", "bronze", t, _bronze)

    # silver: accounts first, then the RI-dependent tables
    def silver_accounts_current():
        return lake.read_table(spark, root, "silver", "accounts", [business_date])

    for t in M.TABLES:
        def _silver(batch_id, t=t):
            bronze = lake.read_table(spark, root, "bronze", t, [business_date]).drop(lake.SNAPSHOT)
            ref = None if t == "accounts" else silver_accounts_current()
            ev = rules.evaluate(bronze, M.silver_rules(t, ref), id_column="id")
            ev.flagged = ev.flagged.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                r.record_dq(batch_id, ev.counts(), "silver", t)
                clean = ev.clean_latest(["_ingested_at"])
                oc, oq = Observation(f"c_{batch_id[:8]}"), Observation(f"q_{batch_id[:8]}")
                lake.write_partition(clean.observe(oc, F.count(F.lit(1)).alias("n")), root, "silver", t, business_date)
                lake.write_partition(ev.quarantined().observe(oq, F.count(F.lit(1)).alias("n")), root, "silver",
                                     f"{t}_quarantine", business_date)
                nc, nq = oc.get["n"], oq.get["n"]
            finally:
                ev.flagged.unpersist()
            return nc + nq, nc
        r.step(f"silver_transform.{t}", "silver", t, _silver)

    # gate on Silver output
    def _gate(batch_id):
        failed, checked = [], 0
        for t in ("accounts", "ledger_entries"):
            df = lake.read_table(spark, root, "silver", t, [business_date])
            rows = r.record_dq(batch_id, rules.gate_counts(df, M.gate_rules(t)), "silver", t)
            checked += rows[0]["rows_checked"] if rows else 0
            failed += [f"{t}.{x['rule_name']} ({x['rows_failed']} rows)" for x in rows if not x["passed"]]
        if failed:
            raise rules.GateFailed(f"gate failed on Silver output, Gold not built: {failed}")
        return checked, checked
    r.step("gate_validate_silver", "dq_gx", "silver", _gate)

    # gold
    def _gold(batch_id):
        led = lake.read_table(spark, root, "silver", "ledger_entries", [business_date])
        trf = lake.read_table(spark, root, "silver", "transfers", [business_date])
        n = 0
        for name, df in (("reconciliation_summary", gold.reconciliation_summary(led)),
                         ("daily_transfer_volume", gold.daily_transfer_volume(trf)),
                         ("account_ledger_summary", gold.account_ledger_summary(led))):
            o = Observation(f"g_{name}_{batch_id[:8]}")
            lake.write_partition(df.observe(o, F.count(F.lit(1)).alias("n")), root, "gold", name, business_date)
            n += o.get["n"]
        return n, n
    r.step("gold_aggregate", "gold", "gold_aggregate", _gold)

    # reconcile gold against the source ledger of the same snapshot
    def _reconcile(batch_id):
        g = lake.read_table(spark, root, "gold", "reconciliation_summary", [business_date])
        if g is None or g.limit(1).count() == 0:
            raise RuntimeError(f"no gold.reconciliation_summary row for business_date={business_date}")
        src = gold.reconciliation_summary(day["ledger_entries"].withColumn("business_date", F.lit(business_date)))
        res = gold.reconcile(g.drop(lake.SNAPSHOT), src).withColumns({
            "batch_id": F.lit(batch_id), "recon_id": F.lit(str(uuid.uuid4())), "created_at": F.lit(_now())})
        row = res.first()
        lake.append(res, root, "audit", "reconciliation_results")
        if not row["within_tolerance"]:
            raise RuntimeError(f"reconciliation mismatch on {business_date}: diff={row['diff_amount']}")
        return row["source_row_count"], 1
    r.step("reconcile", "reconcile", "ledger_entries", _reconcile)

    # SQL checks over lake views and source views
    def _checks(batch_id):
        lake.register_views(spark, root, {"bronze": list(M.TABLES),
                                          "silver": list(M.TABLES) + [f"{t}_quarantine" for t in M.TABLES]})
        for t, df in sources.items():
            df.createOrReplaceTempView(f"source_{t}")
        results = checks.run_checks(spark, checks.load_checks(), business_date)
        counts = spark.createDataFrame(
            [(x["rule_name"], "critical", None, x["rows_failed"], x["passed"]) for x in results],
            "rule_name string, severity string, rows_checked long, rows_failed long, passed boolean")
        r.record_dq(batch_id, counts, "dq_checks", "sql_checks")
        checks.raise_on_failures(results)
        return len(results), len(results)
    r.step("sql_checks", "dq_checks", "sql_checks", _checks)
    return r


def main(argv=None) -> None:
    """Run one business date of the bank tables derived from a test-data folder."""
    import argparse

    from tally.session import ensure_checkpoint_dir, local_session
    from tally.sources import bank
    from tally.sources.testdata import table

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--date", required=True)
    ap.add_argument("--run-id", required=True)
    ap.add_argument("--root", help="lake root (default: <spark.checkpoint.dir>/lake)")
    ap.add_argument("--fail-at", default=None)
    a = ap.parse_args(argv)
    spark = local_session()
    root = a.root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lake"
    sources = {"accounts": bank.accounts(spark, a.sf_dir), "ledger_entries": bank.ledger_entries(spark, a.sf_dir),
               "transfers": bank.transfers(spark, a.sf_dir)}
    with open(CONTRACT, encoding="utf-8") as f:
        doc = json.load(f)
    live = contract.live_schema(spark, {t: table(spark, a.sf_dir, t, *columns) for t, columns in doc["tables"].items()})
    run_day(spark, sources, root, a.date, a.run_id, doc, a.fail_at, live)
    print(root)


if __name__ == "__main__":
    main()
