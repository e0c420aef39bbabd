"""Audit trail as append-only event tables, and the questions asked of it.

``batch_control`` is a log of batch *events* (one row per state change); the
current state of a slot (layer, source_table, business_date) is its newest
event.  All questions below are set-oriented: they answer for every slot, run
or date at once.
"""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.dates import is_weekday

# The eleven batch slots of one daily run.
EXPECTED_SLOTS = [
    ("contract", "source"),
    ("bronze", "accounts"),
    ("bronze", "ledger_entries"),
    ("bronze", "transfers"),
    ("silver", "accounts"),
    ("silver", "ledger_entries"),
    ("silver", "transfers"),
    ("dq_gx", "silver"),
    ("gold", "gold_aggregate"),
    ("reconcile", "ledger_entries"),
    ("dq_checks", "sql_checks"),
]
SLOT = ["layer", "source_table", "business_date"]
HOLDING = ["RUNNING", "SUCCESS", "RECOVERED"]


def expected_slots_column() -> Column:
    return F.array(*[F.struct(F.lit(l).alias("layer"), F.lit(t).alias("source_table")) for l, t in EXPECTED_SLOTS])


def batch_states(events: DataFrame) -> DataFrame:
    """Current state of every batch: its newest event (a terminal status wins a
    timestamp tie with RUNNING), stamped with the batch's first event time."""
    terminal = F.when(F.col("status") == "RUNNING", F.lit(0)).otherwise(F.lit(1))
    last = F.max(F.struct(F.col("started_at").alias("t"), terminal.alias("k"), F.col("status").alias("s")))
    return events.groupBy("batch_id", "dag_run_id", *SLOT).agg(
        last.alias("_last"), F.min("started_at").alias("started_at")).select(
        "batch_id", "dag_run_id", *SLOT, F.col("_last.s").alias("status"), "started_at")


def latest_per_slot(events: DataFrame, statuses: Iterable[str] | None = HOLDING) -> DataFrame:
    """Newest batch per slot among batches in ``statuses`` (ties broken by batch
    id), via partial aggregates (a hot slot collapses map-side)."""
    b = batch_states(events)
    b = b if statuses is None else b.filter(F.col("status").isin(list(statuses)))
    packed = F.struct("started_at", "batch_id", "status", "dag_run_id")
    return b.groupBy(*SLOT).agg(F.max(packed).alias("_l")).select(
        *SLOT, F.col("_l.status").alias("latest_status"), F.col("_l.dag_run_id").alias("latest_run"),
        F.col("_l.started_at").alias("latest_started_at"))


def slot_decision(requests: DataFrame, events: DataFrame) -> DataFrame:
    """PROCEED / SKIP / REFUSE for every (slot, run) request.

    none or FAILED -> PROCEED; SUCCESS by the same run -> SKIP; held by another
    run -> REFUSE; RUNNING under the same run -> REFUSE.
    """
    latest = latest_per_slot(events)
    j = requests.join(latest, SLOT, "left")
    decision = (
        F.when(F.col("latest_status").isNull(), "PROCEED")
        .when(F.col("latest_run") != F.col("dag_run_id"), "REFUSE")
        .when(F.col("latest_status").isin("SUCCESS", "RECOVERED"), "SKIP")
        .otherwise("REFUSE")
    )
    return j.select(*SLOT, "dag_run_id", F.col("latest_status"), decision.alias("decision"))


def latest_clean_run(events: DataFrame) -> DataFrame:
    """Newest (run, date) whose events are all SUCCESS and include a reconcile step."""
    g = events.groupBy("dag_run_id", "business_date").agg(
        F.bool_and(F.col("status") == "SUCCESS").alias("_all_ok"),
        F.bool_or(F.col("layer") == "reconcile").alias("_reconciled"),
        F.max("started_at").alias("last_started_at"),
    )
    return (g.filter(F.col("_all_ok") & F.col("_reconciled"))
            .orderBy(F.col("last_started_at").desc(), F.col("dag_run_id").desc())
            .limit(1).select("dag_run_id", "business_date", "last_started_at"))


def audit_completeness(events: DataFrame) -> DataFrame:
    """Per run: missing slots, non-SUCCESS events, SUCCESS events lacking counts,
    distinct business dates; ``complete`` when all are clean."""
    runs = events.select("dag_run_id").distinct()
    expected = runs.select("dag_run_id", F.explode(expected_slots_column()).alias("s")).select(
        "dag_run_id", F.col("s.layer").alias("layer"), F.col("s.source_table").alias("source_table"))
    seen = events.select("dag_run_id", "layer", "source_table").distinct()
    missing = (expected.join(seen, ["dag_run_id", "layer", "source_table"], "left_anti")
               .groupBy("dag_run_id").agg(F.count(F.lit(1)).alias("missing_slots")))
    per_run = events.groupBy("dag_run_id").agg(
        F.count_if(F.col("status") != "SUCCESS").alias("non_success_events"),
        F.count_if((F.col("status") == "SUCCESS") & (F.col("rows_read").isNull() | F.col("rows_written").isNull()))
        .alias("success_without_counts"),
        F.countDistinct("business_date").alias("business_dates"),
    )
    out = per_run.join(missing, "dag_run_id", "left").select(
        "dag_run_id",
        F.coalesce(F.col("missing_slots"), F.lit(0)).cast("long").alias("missing_slots"),
        F.col("non_success_events").cast("long").alias("non_success_events"),
        F.col("success_without_counts").cast("long").alias("success_without_counts"),
        F.col("business_dates").cast("long").alias("business_dates"),
    )
    return out.withColumn("complete", (F.col("missing_slots") == 0) & (F.col("non_success_events") == 0)
                          & (F.col("success_without_counts") == 0) & (F.col("business_dates") == 1))


def backfill_plan(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Weekdays in [start, end] not yet processed (some expected slot lacks SUCCESS)."""
    n_slots = len(EXPECTED_SLOTS)
    done = (events.filter(F.col("status") == "SUCCESS")
            .select("business_date", "layer", "source_table").distinct()
            .join(events.sparkSession.createDataFrame(EXPECTED_SLOTS, "layer string, source_table string"),
                  ["layer", "source_table"], "left_semi")
            .groupBy("business_date").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == n_slots).select("business_date"))
    days = events.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("d"))
    todo = days.filter(is_weekday(F.col("d"))).select(F.date_format("d", "yyyy-MM-dd").alias("business_date"))
    return todo.join(done, "business_date", "left_anti")


def layer_parity(bronze: dict, silver: dict, quarantine: dict) -> DataFrame:
    """bronze = silver + quarantine + removed duplicates, per table and business date."""
    def counts(frames: dict, name: str) -> DataFrame:
        out = None
        for t, df in frames.items():
            c = df.groupBy("business_date").agg(F.count(F.lit(1)).alias(name)).withColumn("table_name", F.lit(t))
            out = c if out is None else out.unionByName(c)
        return out

    b, s, q = counts(bronze, "b"), counts(silver, "s"), counts(quarantine, "q")
    j = b.join(s, ["table_name", "business_date"], "left").join(q, ["table_name", "business_date"], "left")
    sc, qc = F.coalesce(F.col("s"), F.lit(0)), F.coalesce(F.col("q"), F.lit(0))
    return j.select(
        "table_name", "business_date", F.col("b").cast("long").alias("bronze_count"),
        sc.cast("long").alias("silver_count"), qc.cast("long").alias("quarantine_count"),
        (F.col("b") - sc - qc).cast("long").alias("deduplicated_count"),
        (F.col("b") == sc + qc).alias("parity"),
    )


def parity(evaluations: dict, order: tuple = ("_ingested_at",)) -> DataFrame:
    """:func:`layer_parity` of rule evaluations by table, from one pass over each table."""
    out = None
    for t, evaluation in evaluations.items():
        counts = evaluation.layer_counts(list(order)).withColumn("table_name", F.lit(t))
        out = counts if out is None else out.unionByName(counts)
    left = F.col("bronze") - F.col("silver") - F.col("quarantine")
    return out.select("table_name", "business_date", F.col("bronze").alias("bronze_count"), F.col("silver").alias("silver_count"),
                      F.col("quarantine").alias("quarantine_count"), left.alias("deduplicated_count"), (left == 0).alias("parity"))


def critical_failures(dq_results: DataFrame) -> DataFrame:
    """Critical rules that failed, per table and business date."""
    return dq_results.filter((F.col("severity") == "critical") & ~F.col("passed"))


def rules_that_ran(declared: dict, results: DataFrame) -> DataFrame:
    """Every declared (table, rule), on how many dates ``results`` has it, and whether it ran at all: a
    rule that silently did not run fails nothing, so its absence must show."""
    rows = [(t, name) for t, names in declared.items() for name in names]
    wanted = results.sparkSession.createDataFrame(rows, "table_name string, rule_name string")
    seen = results.groupBy("table_name", "rule_name").agg(F.countDistinct("business_date").alias("dates_checked"))
    dates = F.coalesce(F.col("dates_checked"), F.lit(0)).cast("long")
    return wanted.join(seen, ["table_name", "rule_name"], "left").select(
        "table_name", "rule_name", dates.alias("dates_checked"), (dates > 0).alias("ran"))


def multiset_print(df: DataFrame) -> DataFrame:
    """One row that doesn't depend on the order of rows: their count and the sums of two 64-bit hashes of
    each; a NULL counts as a value of its own."""
    values = [c for name in df.columns for c in (F.col(name), F.col(name).isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n"), *sums)


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether a and b hold the same rows with the same multiplicities.

    Equal sides are told by one pass over each (:func:`multiset_print`); only sides that differ are
    shuffled to count the rows that one has and the other hasn't.
    """
    spark = a.sparkSession
    typed = b.select(*[F.col(y).cast(t).alias(x) for (x, t), y in zip(a.dtypes, b.columns, strict=True)])
    if multiset_print(a).first() == multiset_print(typed).first():
        return spark.range(1).select(F.lit(0).cast("long").alias("only_left"), F.lit(0).cast("long").alias("only_right"),
                                     F.lit(True).alias("equal"))
    diff = a.exceptAll(b).select(F.lit(1).alias("_side")).unionByName(b.exceptAll(a).select(F.lit(2).alias("_side")))
    return diff.agg(F.count_if(F.col("_side") == 1).alias("only_left"),
                    F.count_if(F.col("_side") == 2).alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``target`` (ON CONFLICT DO NOTHING)."""
    return incoming.join(target.select(key), key, "left_anti")


def run_failures(dq_results: DataFrame, batches: DataFrame, run_id: str, layer: str | None = None,
                 severity: str = "critical") -> DataFrame:
    """Failed rules of one run: rule results joined to their batches on batch_id."""
    b = batches.filter(F.col("dag_run_id") == run_id).select("batch_id", "dag_run_id",
                                                            F.col("layer").alias("batch_layer")).distinct()
    out = dq_results.join(b, "batch_id").filter((F.col("severity") == severity) & ~F.col("passed"))
    if layer is not None:
        out = out.filter(F.col("batch_layer") == layer)
    return out
