"""Streaming twins agree with their batch operators on in-order arrival."""
import os
import tempfile
import time

from pyspark.sql import functions as F

from tally.operators import aml, ledger, sessions
from tally.sources import bank
from tally.streaming import dashboard, ingest, stateful
from tests.conftest import SF

V_WIN, S_WIN, S_MIN, THR = "30 days", "365 days", "400000.00", "450000.00"


def _land_in_time_order(df, ts_col, parts=3):
    """Write df as `parts` parquet files, each later in event time than the previous."""
    d = tempfile.mkdtemp(prefix="tally-landing-")
    rows = df.orderBy(ts_col).collect()
    n = len(rows)
    for i in range(parts):
        chunk = rows[i * n // parts:(i + 1) * n // parts]
        # keep equal timestamps in one file
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.parquet(os.path.join(d, f"f{i:02d}"))
    return d


def _run_memory(stream_df, name):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode("append") \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="tally-ckpt-")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream_df.sparkSession.table(name)


def _read_stream(spark, d, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)


def test_ingest_is_incremental_and_idempotent(spark, tmp_root):
    t = bank.transfers(spark, SF)
    d = tempfile.mkdtemp(prefix="tally-drop-")
    t.filter("id % 2 = 0").write.parquet(os.path.join(d, "a"))
    ck = tempfile.mkdtemp(prefix="tally-ckpt-")
    q = ingest.ingest_files(spark, d + "/*", t.schema, tmp_root, "transfers", checkpoint=ck)
    q.awaitTermination()
    first = ingest.read_landed(spark, tmp_root, "transfers").count()
    assert first == t.filter("id % 2 = 0").count()
    # nothing new: a rerun lands nothing
    ingest.ingest_files(spark, d + "/*", t.schema, tmp_root, "transfers", checkpoint=ck).awaitTermination()
    assert ingest.read_landed(spark, tmp_root, "transfers").count() == first
    t.filter("id % 2 = 1").write.parquet(os.path.join(d, "b"))
    ingest.ingest_files(spark, d + "/*", t.schema, tmp_root, "transfers", checkpoint=ck).awaitTermination()
    landed = ingest.read_landed(spark, tmp_root, "transfers")
    assert landed.count() == t.count() and landed.select("id").distinct().count() == t.count()


def test_aml_stream_matches_batch(spark):
    t = bank.transfers(spark, SF)
    d = _land_in_time_order(t, "created_at")
    s = _read_stream(spark, d, t.schema)
    out = _run_memory(stateful.aml_stream(s, 3, V_WIN, 2, S_WIN, S_MIN, THR, lateness="1 day"), "aml_stream_out")
    got = {r["id"]: (r["velocity_count"], r["structuring_count"]) for r in out.collect()}
    v = {r["id"]: r["velocity_count"] for r in aml.velocity(t, 3, V_WIN).collect()}
    st = {r["id"]: r["structuring_count"] for r in aml.structuring(t, 2, S_WIN, S_MIN, THR).collect()}
    assert got == {i: (v[i], st[i]) for i in v}


def test_aml_history_stream_matches_batch(spark, tmp_root):
    """Several micro-batches: each equals the batch operator, and reads only the spans that it can reach."""
    t = bank.transfers(spark, SF)
    d = _land_in_time_order(t, "created_at", parts=4)
    out = f"{tmp_root}/aml"
    q = stateful.aml_history_stream(_read_stream(spark, d, t.schema), out, f"{tmp_root}/ck", 3, V_WIN, 2, S_WIN, S_MIN, THR)
    q.awaitTermination()
    rows = spark.read.parquet(out)
    got = {r["id"]: (r["velocity_count"], r["structuring_count"], r["late"]) for r in rows.collect()}
    both = aml.look_back_counts(t, {"v": (V_WIN, None), "s": (S_WIN, aml.qualifies(S_MIN, THR))})
    assert got == {r["id"]: (r["v"], r["s"], False) for r in both.collect()}
    assert rows.select("_epoch").distinct().count() == 4 and rows.select("_span").distinct().count() > 3
    plan = rows.filter("_span >= 30")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_span" in plan


def test_late_rows_are_counted(spark, tmp_root):
    """A transfer from long before: marked by the history stream, counted as dropped by the windows."""
    t = bank.transfers(spark, SF)
    d = f"{tmp_root}/late"
    cut = F.lit(t.select("created_at").orderBy("created_at").limit(6).collect()[-1][0])
    new = t.filter(F.col("created_at") > cut).orderBy("created_at")
    half = new.limit(new.count() // 2).agg(F.max("created_at")).first()[0]
    for part in (F.col("created_at") <= half, F.col("created_at") > half):  # a watermark holds from the second batch after it on
        new.filter(part).coalesce(1).write.mode("append").parquet(f"{d}/a")
        time.sleep(1.1)
    old = t.filter(F.col("created_at") <= cut)
    n = old.count()
    assert n >= 6
    time.sleep(1.1)  # files are read in the order of their times
    old.coalesce(1).write.parquet(f"{d}/b")
    q = stateful.aml_history_stream(_read_stream(spark, d, t.schema), f"{tmp_root}/out", f"{tmp_root}/ck", 3, V_WIN, 2, S_WIN, S_MIN, THR)
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_root}/out").filter("late").count() == n
    w = dashboard.velocity_windows(_read_stream(spark, d, t.schema), "30 days", "10 days", 1, lateness="1 day")
    q = dashboard.keep_windows(w, f"{tmp_root}/win", f"{tmp_root}/ckw")
    q.awaitTermination()
    assert stateful.late_rows(q) == 3 * n  # each in three windows
    landed = dashboard.saved_windows(spark, w, f"{tmp_root}/win").agg(F.sum("transfers")).first()[0]
    assert landed + 3 * n == 3 * t.count()


def test_login_stream_keeps_failures_and_forgets_the_rest(spark, tmp_root):
    """Two failures, days of silence, a third: locked, as in the batch operator.  Users without failures leave no state."""
    import datetime as dt

    t0, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    rows = [[(1, "x", "u", t0, False), (2, "x", "u", t0 + day / 24, False), (3, "y", "v", t0, True), (4, "y", "w", t0, False)],
            [(5, "z", "other", t0 + 3 * day, True)], [(6, "z", "other", t0 + 4 * day, True)],
            [(7, "x", "u", t0 + 5 * day, False), (8, "x", "u", t0 + 5 * day + day / 24, True), (9, "y", "w", t0 + 5 * day, True)],
            [(10, "z", "other", t0 + 7 * day, True)], [(11, "z", "other", t0 + 8 * day, True)]]
    schema = "attempt_id long, ip string, username string, ts timestamp_ntz, success boolean"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_root}/in/f{k}")
    whole = spark.createDataFrame(sum(rows, []), schema)
    s = stateful.login_stream(_read_stream(spark, f"{tmp_root}/in", whole.schema), lateness="1 hour")
    q = (s.writeStream.format("parquet").option("path", f"{tmp_root}/out").option("checkpointLocation", f"{tmp_root}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {x["attempt_id"]: (x["outcome"], x["failed_attempts"]) for x in spark.read.schema(s.schema).parquet(f"{tmp_root}/out").collect()}
    want = {x["attempt_id"]: (x["outcome"], x["failed_attempts"]) for x in sessions.login_outcomes(whole).collect()}
    assert got == want and got[7] == ("FAILED", 3) and got[8][0] == "LOCKED"
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert totals[-1] <= 2  # u, still counted, and the last batch's user


def test_replay_stream_matches_batch(spark, tmp_root):
    r = ledger.own_reason(bank.transfer_requests(spark, SF), bank.accounts(spark, SF), bank.users(spark, SF))
    d = _land_in_time_order(r, "requested_at")
    stateful.replay_stream(_read_stream(spark, d, r.schema), f"{tmp_root}/replay", f"{tmp_root}/ck").awaitTermination()
    got = {x["request_id"]: x["replay_status"] for x in spark.read.parquet(f"{tmp_root}/replay").collect()}
    want = {x["request_id"]: x["replay_status"] for x in ledger.replay_classification(r, accepted=ledger.SAVED).collect()}
    assert got == want and set(want.values()) >= {"EXECUTED", "REJECTED"}
    dedup = _run_memory(stateful.replay_suppressed(_read_stream(spark, d, r.schema)), "dedup_out")
    assert dedup.count() == r.select("idempotency_key").distinct().count()


def test_stream_queries_read_directories_of_unordered_files(spark, tmp_root):
    """The same rows as several part files, out of time order, give the same stream results."""
    from tally.plans.catalog import QUERIES

    d = f"{tmp_root}/sf"
    for name in ("orders", "events", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{d}/{name}.parquet")
    for name in ("stream_replay", "stream_login", "stream_bronze_ingest", "stream_aml_counts"):
        a, b = (sorted(map(str, QUERIES[name](spark, x).collect())) for x in (SF, d))
        assert a == b and a, name


def test_login_stream_matches_batch(spark):
    a = bank.login_attempts(spark, SF)
    d = _land_in_time_order(a, "ts")
    out = _run_memory(stateful.login_stream(_read_stream(spark, d, a.schema), lateness="1 hour"), "login_out")
    got = {x["attempt_id"]: (x["outcome"], x["failed_attempts"]) for x in out.collect()}
    want = {x["attempt_id"]: (x["outcome"], x["failed_attempts"]) for x in sessions.login_outcomes(a).collect()}
    assert got == want


def test_velocity_dashboard_windows(spark):
    t = bank.transfers(spark, SF)
    d = _land_in_time_order(t, "created_at")
    out = _run_memory(dashboard.velocity_windows(_read_stream(spark, d, t.schema), "30 days", "10 days", 2,
                                                 lateness="1 day"), "dash_out")
    batch = (t.groupBy(F.window(F.col("created_at").cast("timestamp"), "30 days", "10 days").alias("w"), "from_account_id")
             .agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))
    # every window emitted in append mode is a real one; the final (still open) windows are missing there
    got = {(r["window_start"], r["from_account_id"], r["transfers"]) for r in out.collect()}
    want = {(r["w"]["start"], r["from_account_id"], r["n"]) for r in batch.collect()}
    assert got and got <= want
    w = dashboard.velocity_windows(_read_stream(spark, d, t.schema), "30 days", "10 days", 2, lateness="1 day")
    places = tempfile.mkdtemp(prefix="tally-win-")
    dashboard.keep_windows(w, f"{places}/out", f"{places}/ck").awaitTermination()
    assert {(r["window_start"], r["from_account_id"], r["transfers"]) for r in dashboard.saved_windows(spark, w, f"{places}/out").collect()} == want
