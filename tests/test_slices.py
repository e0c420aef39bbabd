"""Busy keys: a third of all rows and more under one key, cut into slices, against plain Python."""
import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.operators import aml, ledger, sessions
from tally.operators.slices import SLICE, prefix_sums, previous, sliced

T0 = dt.datetime(2024, 1, 1)
ATTEMPTS = "attempt_id long, ip string, username string, ts timestamp_ntz, success boolean"


def attempts(seed, hot, gap, fail, ips, n=1200):
    """Attempts of which a share goes to one user, ``gap`` seconds apart on average."""
    r = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += r.expovariate(1 / gap)
        user = "hot" if r.random() < hot else r.choice([None, "a", "b", "zoe"])
        rows.append((i, r.choice([None, *(f"ip{k}" for k in range(ips))]), user, T0 + dt.timedelta(seconds=int(at)), r.random() >= fail))
    r.shuffle(rows)
    return rows


def model_outcomes(rows):
    out, users = {}, {}
    for i, ip, user, ts, ok in sorted(rows, key=lambda r: (r[3], r[0])):
        s = users.setdefault(user, {"w": {}, "f": 0, "lock": None})
        w = s["w"].get(ip)
        s["w"][ip] = w = [ts, 1] if w is None or ts >= w[0] + dt.timedelta(seconds=60) else [w[0], w[1] + 1]
        retry = 0
        if w[1] > 5:
            outcome, retry = "RATE_LIMITED", int((w[0] + dt.timedelta(seconds=60) - ts).total_seconds())
        elif s["lock"] and s["lock"] > ts:
            outcome = "LOCKED"
        elif ok:
            outcome = "SUCCESS"
            s["w"].pop(ip)
            s["f"], s["lock"] = 0, None
        else:
            outcome = "FAILED"
            s["f"] += 1
            if s["f"] >= 3:
                s["lock"] = ts + dt.timedelta(hours=24)
        out[i] = (outcome, retry, s["f"], s["lock"])
    return out


@pytest.mark.parametrize(("hot", "gap", "fail", "ips"), [(0.4, 2, 0.3, 3), (0.9, 8, 0.55, 1), (0.5, 3000, 0.9, 2), (0.6, 1, 1.0, 2)])
def test_login_of_a_busy_user(spark, hot, gap, fail, ips):
    """Many logins, few, locks that run out, and an attack that never gets in."""
    rows = attempts(int(gap), hot, gap, fail, ips)
    got = sessions.login_outcomes(spark.createDataFrame(rows, ATTEMPTS), partitions=7)
    assert got.columns == sessions.LOGIN_COLUMNS
    assert {r[0]: (r[5], r[6], r[7], r[8]) for r in got.collect()} == model_outcomes(rows)
    assert got.count() == len(rows)


def test_login_edges(spark):
    assert sessions.login_outcomes(spark.createDataFrame([], ATTEMPTS), partitions=3).count() == 0
    one = spark.createDataFrame([(1, "x", "u", T0, False)], ATTEMPTS)
    assert sessions.login_outcomes(one, partitions=5).first().outcome == "FAILED"


def test_lock_times_hold_whatever_memory_held_before():
    """Unlocked rows beside locked ones, after large floats filled and left the same memory."""
    for n in range(1, 120):
        junk = [np.full(n, 1e300) for _ in range(4)]
        del junk
        locked = [None if i % 3 else 1_700_000_000_000_000 + i for i in range(n)]
        got = pd.Series(sessions.login_times(locked))
        assert got.isna().tolist() == [x is None for x in locked]
        assert got.dropna().astype("int64").tolist() == [x for x in locked if x is not None]


def test_expired_windows_are_forgotten():
    m = sessions.LoginMachine(60_000_000, 5, 3, 1)
    for i in range(100_000):
        m.step(f"ip{i}", i * 1_000_000, True)
        m.step(f"jp{i}", i * 1_000_000, False)
    assert len(m.windows) <= 260
    text = m.export(100_000 * 1_000_000)
    other = sessions.LoginMachine(60_000_000, 5, 3, 1)
    other.restore(text)
    assert other.export(100_000 * 1_000_000) == text


def test_running_balance_of_a_clearing_account(spark):
    """All its entries on one day: its rows lie in several slices, sums go on across them."""
    r = random.Random(1)
    rows = [(i, i, 7 if i % 3 else 100 + i % 50, r.choice(["DEBIT", "CREDIT"]), Decimal(r.randrange(1, 10_000)) / 100,
             T0 + dt.timedelta(seconds=r.randrange(5))) for i in range(900)]
    e = spark.createDataFrame(rows, "id long, transaction_id long, account_id long, entry_type string, amount decimal(19,4), created_at timestamp_ntz")
    want, total = {}, Counter()
    for i, _, account, kind, amount, _ in sorted(rows, key=lambda x: (x[2], x[5], x[0])):
        total[account] += -amount if kind == "DEBIT" else amount
        want[i] = total[account]
    got = {x["id"]: x["running_balance"] for x in ledger.running_balance(e, slices=6).collect()}
    assert got == want
    parts = sliced(e, "account_id", "created_at", "id", slices=6).filter("account_id = 7").select(SLICE).distinct().count()
    assert parts >= 3


def test_look_backs_of_a_busy_sender(spark):
    """Two windows in one pass; many transfers at one instant; rows with null sender or time."""
    r = random.Random(2)
    rows = [(i, 1 if i % 2 else r.choice([None, 2, 3]), T0 + dt.timedelta(seconds=r.choice([0, r.randrange(3000)])), Decimal(r.randrange(100)))
            for i in range(1000)]
    rows.append((5000, 1, None, Decimal(5)))
    t = spark.createDataFrame(rows, "id long, from_account_id long, created_at timestamp_ntz, amount decimal(19,4)")
    large = F.col("amount") >= 50
    got = aml.look_back_counts(t, {"n": ("10 minutes", None), "big": ("1 hour", large)}, slices=5)
    assert got.columns == [*t.columns, "n", "big"]
    by = defaultdict(list)
    for _, a, ts, amount in rows:
        if ts:
            by[a].append((ts, amount))
    inside = lambda a, ts, s: [x for x in by[a] if ts - dt.timedelta(seconds=s) < x[0] <= ts] if ts else []
    want = {i: (len(inside(a, ts, 600)), sum(x[1] >= 50 for x in inside(a, ts, 3600))) for i, a, ts, _ in rows}
    assert {x["id"]: (x["n"], x["big"]) for x in got.collect()} == want


def test_slice_helpers(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2]), i, i * i) for i in range(300)]
    df = sliced(spark.createDataFrame(rows, "k long, o long, v long"), "k", "o", slices=8)
    total, last, want = Counter(), {}, {}
    for k, o, v in rows:
        total[k] += v
        want[o] = (total[k], last.get(k))
        last[k] = v
    sums = prefix_sums(df, ["k"], ["o"], {"s": F.col("v")})
    assert sums.columns == ["k", "o", "v", SLICE, "s"]
    assert {x["o"]: x["s"] for x in sums.collect()} == {o: s for o, (s, _) in want.items()}
    assert {x["o"]: x["p"] for x in previous(df, ["k"], ["o"], "v", "p").collect()} == {o: p for o, (_, p) in want.items()}
