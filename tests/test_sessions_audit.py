"""Login limiter / lockout (vs a brute-force model), tokens, transitions, audit decisions."""
import datetime as dt

from pyspark.sql import functions as F

from tally.operators import audit, sessions
from tally.sources import bank
from tests.conftest import SF

T0 = dt.datetime(2024, 3, 2, 9, 0, 0)
ATT = "attempt_id long, ip string, username string, ts timestamp_ntz, success boolean"


def _outcomes(spark, rows):
    df = spark.createDataFrame(rows, ATT)
    return {r["attempt_id"]: r for r in sessions.login_outcomes(df, partitions=2).collect()}


def test_limiter_golden(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [(i, "1.1.1.1", "alice", s(i), False) for i in range(1, 7)]          # 6th in the window rejected
    rows += [(7, "1.1.1.1", "alice", s(61), False)]                                # window over -> allowed again
    rows += [(i, "2.2.2.2", "bob", s(i), True) for i in range(10, 17)]            # success resets every time
    rows += [(20, "3.3.3.3", "carol", s(0), False), (21, "4.4.4.4", "carol", s(0), False)]  # keys per ip
    out = _outcomes(spark, rows)
    assert [out[i]["outcome"] != "RATE_LIMITED" for i in range(1, 7)] == [True] * 5 + [False]
    assert out[6]["retry_after_seconds"] == 55
    assert out[7]["outcome"] != "RATE_LIMITED"
    assert all(out[i]["outcome"] == "SUCCESS" for i in range(10, 17))
    assert out[21]["outcome"] != "RATE_LIMITED"


def test_lockout_golden(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(1, "ip", "u", h(0), False), (2, "ip", "u", h(1), False), (3, "ip", "u", h(2), False),  # 3rd locks
            (4, "ip", "u", h(3), True),                                   # locked: success ignored
            (5, "ip", "u", h(27), False),                                 # lock expired, counter kept -> locks again
            (6, "ip", "u", h(60), True),                                  # success resets
            (7, "ip", "u", h(61), False)]
    out = _outcomes(spark, rows)
    assert [out[i]["outcome"] for i in range(1, 8)] == ["FAILED", "FAILED", "FAILED", "LOCKED", "FAILED", "SUCCESS",
                                                       "FAILED"]
    assert out[3]["locked_until"] == h(26)
    assert out[5]["failed_attempts"] == 4 and out[5]["locked_until"] == h(51)
    assert out[7]["failed_attempts"] == 1 and out[7]["locked_until"] is None


def _brute(rows, window=60, max_req=5, lock_after=3, lock_h=24, with_lock=False):
    out, state = {}, {}
    for aid, ip, user, ts, ok in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        st = state.setdefault(user, {"w": {}, "f": 0, "lock": None})
        w = st["w"].get(ip)
        if w is None or ts >= w[0] + dt.timedelta(seconds=window):
            w = (ts, 1)
        else:
            w = (w[0], w[1] + 1)
        st["w"][ip] = w
        if w[1] > max_req:
            out[aid] = "RATE_LIMITED"
        elif st["lock"] is not None and st["lock"] > ts:
            out[aid] = "LOCKED"
        elif not ok:
            st["f"] += 1
            if st["f"] >= lock_after:
                st["lock"] = ts + dt.timedelta(hours=lock_h)
            out[aid] = "FAILED"
        else:
            st["w"].pop(ip, None)
            st["f"], st["lock"] = 0, None
            out[aid] = "SUCCESS"
        if with_lock:
            out[aid] = (out[aid], st["f"], st["lock"])
    return out


def test_login_outcomes_match_brute_force_on_events(spark):
    att = bank.login_attempts(spark, SF)
    rows = [tuple(r) for r in att.collect()]
    want = _brute(rows, with_lock=True)
    got = {r["attempt_id"]: (r["outcome"], r["failed_attempts"], r["locked_until"])
           for r in sessions.login_outcomes(att, partitions=3).collect()}
    assert got == want


def test_token_status_and_reuse(spark):
    tok = spark.createDataFrame([
        (1, 7, "h1", "f", T0 + dt.timedelta(days=30), T0, T0 + dt.timedelta(hours=1)),
        (2, 7, "h2", "f", T0 + dt.timedelta(days=30), T0 + dt.timedelta(hours=1), None),
        (3, 8, "h3", "g", T0 + dt.timedelta(hours=2), T0, None)],
        "id long, user_id long, token_hash string, family_id string, expires_at timestamp_ntz, created_at timestamp_ntz, "
        "revoked_at timestamp_ntz")
    st = {r["id"]: r["status"] for r in sessions.token_status(tok, F.lit(T0 + dt.timedelta(hours=3))).collect()}
    assert st == {1: "REVOKED", 2: "ACTIVE", 3: "EXPIRED"}
    import hashlib

    tok2 = tok.withColumn("token_hash", F.sha2(F.concat(F.lit("raw"), F.col("id").cast("string")), 256))
    pres = spark.createDataFrame([(1, "raw1", T0 + dt.timedelta(hours=5)), (2, "raw2", T0 + dt.timedelta(hours=5)),
                                  (3, "nope", T0)], "presentation_id long, raw_token string, ts timestamp_ntz")
    chk = {r["presentation_id"]: r["verdict"] for r in sessions.presentation_checks(pres, tok2).collect()}
    assert chk == {1: "REUSED", 2: "VALID", 3: "UNKNOWN"}
    fam = sessions.token_family_audit(pres, tok2).collect()
    assert [(r["family_id"], r["reuse_count"], r["active_tokens_revoked"]) for r in fam] == [("f", 1, 1)]
    assert hashlib.sha256(b"raw1").hexdigest() == tok2.filter("id = 1").first()["token_hash"]


def test_transitions_across_buckets(spark):
    snaps = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 31), 1, "OPEN"), (1, dt.datetime(2024, 2, 1), 2, "ACTIVE"),
        (1, dt.datetime(2024, 4, 1), 3, "OPEN"), (1, dt.datetime(2024, 4, 2), 4, "OPEN"),
        (2, dt.datetime(2024, 1, 1), 1, "ACTIVE"), (2, dt.datetime(2024, 1, 2), 2, "CLOSED"),
        (2, dt.datetime(2024, 3, 1), 3, "ACTIVE")],
        "entity_id long, as_of timestamp_ntz, seq long, status string")
    bad = {(r["entity_id"], r["from_status"], r["to_status"]) for r in
           sessions.invalid_transitions(snaps, sessions.ACCOUNT_TRANSITIONS).collect()}
    assert bad == {(1, "ACTIVE", "OPEN"), (2, "CLOSED", "ACTIVE")}


EV = ("batch_id string, dag_run_id string, layer string, source_table string, business_date string, status string, "
      "started_at timestamp, rows_read long, rows_written long")


def test_slot_decision_golden(spark):
    d = "2026-03-02"
    ev = spark.createDataFrame([
        ("b1", "r1", "bronze", "failed", d, "FAILED", T0, None, None),
        ("b2", "r1", "bronze", "running", d, "RUNNING", T0, None, None),
        ("b3", "r1", "bronze", "done", d, "SUCCESS", T0, 1, 1)], EV)
    req = spark.createDataFrame([(t, r) for t in ("none", "failed", "running", "done") for r in ("r1", "r2")],
                                "source_table string, dag_run_id string").select(
        F.lit("bronze").alias("layer"), "source_table", F.lit(d).alias("business_date"), "dag_run_id")
    got = {(r["source_table"], r["dag_run_id"]): r["decision"] for r in audit.slot_decision(req, ev).collect()}
    assert got == {("none", "r1"): "PROCEED", ("none", "r2"): "PROCEED", ("failed", "r1"): "PROCEED",
                   ("failed", "r2"): "PROCEED", ("running", "r1"): "REFUSE", ("running", "r2"): "REFUSE",
                   ("done", "r1"): "SKIP", ("done", "r2"): "REFUSE"}


def test_weekdays_and_backfill_plan(spark):
    from tally.functions.dates import is_weekday, previous_weekday

    days = spark.range(7).select(F.date_add(F.lit("2026-03-02").cast("date"), F.col("id").cast("int")).alias("d"))
    assert [r[0] for r in days.select(is_weekday(F.col("d"))).collect()] == [True] * 5 + [False] * 2
    prev = [str(r[0]) for r in days.select(previous_weekday(F.col("d"))).collect()]
    assert prev == ["2026-02-27", "2026-03-02", "2026-03-03", "2026-03-04", "2026-03-05", "2026-03-06", "2026-03-06"]
    rows = [(f"b{i}", "r", l, t, "2026-03-06", "SUCCESS", T0, 1, 1) for i, (l, t) in enumerate(audit.EXPECTED_SLOTS)]
    ev = spark.createDataFrame(rows, EV)
    plan = [r[0] for r in audit.backfill_plan(ev, F.lit("2026-03-06").cast("date"), F.lit("2026-03-09").cast("date"))
            .collect()]
    assert plan == ["2026-03-09"]  # Friday done, weekend skipped, Monday to do
    comp = audit.audit_completeness(ev).first()
    assert comp["missing_slots"] == 0 and comp["complete"]
