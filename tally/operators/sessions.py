"""Per-key state machines over event tables: login limiter + lockout, refresh
token status and reuse, and status-transition checks.

Login outcomes are sequential per user (each window anchor and lock depends on what
came before), yet a user may hold a third of all attempts.  Attempts are cut into
slices of about equal size by (user, time, id), and all slices are replayed at once, each
from an empty state.  Only the first user of a slice can go on from the slice before; where
the state left there is not the one that the replay assumed, that user's rows of the slice
are replayed from it, again all such slices at once, until every slice has begun with the
state that its predecessor left.  A slice whose end doesn't depend on its beginning (a login
succeeded, windows ran out) stops the chain, so a few rounds over few slices are usual; an
attack on one user that never lets a login through costs a round for each of that user's slices.
"""
from __future__ import annotations

import hashlib
import json
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.slices import SLICE, joined_on, previous, slice_count, sliced, stored

# Fixed values (reference defaults; parameters of the functions).
LIMIT_WINDOW_SECONDS = 60
LIMIT_MAX_REQUESTS = 5
LOCK_AFTER_FAILURES = 3
LOCK_HOURS = 24
TOKEN_TTL_DAYS = 30

ACCOUNT_TRANSITIONS = [("OPEN", "ACTIVE"), ("FROZEN", "ACTIVE"), ("ACTIVE", "FROZEN"), ("ACTIVE", "CLOSED")]
KYC_TRANSITIONS = [("UNVERIFIED", "PENDING"), ("PENDING", "VERIFIED"), ("PENDING", "REJECTED")]

LOGIN_SCHEMA = (
    "attempt_id long, ip string, username string, ts timestamp_ntz, success boolean, "
    "outcome string, retry_after_seconds long, failed_attempts int, locked_until timestamp_ntz"
)


class LoginMachine:
    """Limiter + lockout state of one username (times in epoch microseconds).

    Shared by the batch operator and the streaming one, so both apply the
    same rules.  Windows that have run out are forgotten: they act like none.
    """

    def __init__(self, window_us: int, max_requests: int, lock_after: int, lock_us: int):
        self.window_us, self.max_requests, self.lock_after, self.lock_us = window_us, max_requests, lock_after, lock_us
        self.windows: dict = {}
        self.failures = 0
        self.locked_until = None
        self._most = 64  # windows to hold before those that have run out are looked for

    def step(self, ip, now: int, success: bool):
        """Returns (outcome, retry_after_seconds, failures, locked_until)."""
        w = self.windows.get(ip)
        if w is None or now >= w[0] + self.window_us:
            w = (now, 1)
        else:
            w = (w[0], w[1] + 1)
        self.windows[ip] = w
        if len(self.windows) > self._most:
            self.forget(now)
            self._most = max(64, 2 * len(self.windows))
        retry = 0
        if w[1] > self.max_requests:
            outcome = "RATE_LIMITED"
            retry = max(0, (w[0] + self.window_us - now) // 1_000_000)
        elif self.locked_until is not None and self.locked_until > now:
            outcome = "LOCKED"
        elif not success:
            self.failures += 1
            if self.failures >= self.lock_after:
                self.locked_until = now + self.lock_us
            outcome = "FAILED"
        else:
            self.windows.pop(ip, None)
            self.failures, self.locked_until = 0, None
            outcome = "SUCCESS"
        return outcome, retry, self.failures, self.locked_until

    def forget(self, now: int) -> None:
        self.windows = {ip: w for ip, w in self.windows.items() if w[0] + self.window_us > now}

    def export(self, now: int) -> str:
        """The state after an attempt at ``now``, the same text for the same state."""
        self.forget(now)
        windows = sorted(([ip, *w] for ip, w in self.windows.items()), key=lambda x: (x[0] is not None, x[0] or ""))
        return json.dumps([windows, self.failures, self.locked_until])

    def restore(self, state: str) -> None:
        windows, self.failures, self.locked_until = json.loads(state)
        self.windows = {ip: (start, count) for ip, start, count in windows}


NO_STATE = json.dumps([[], 0, None])
LOGIN_COLUMNS = [c.split()[0] for c in LOGIN_SCHEMA.split(", ")]
REPLAYED = f"{LOGIN_SCHEMA}, _t long, {SLICE} int, _first boolean, _state string"


def login_times(locked: list) -> np.ndarray:
    """Microseconds or None as datetimes, without a float between."""
    out = np.full(len(locked), np.iinfo(np.int64).min)
    for i, t in enumerate(locked):
        if t is not None:
            out[i] = t
    return out.view("datetime64[us]")


def login_steps(pdf: pd.DataFrame, machines: list) -> pd.DataFrame:
    """The four outcome columns of attempts, each taken by its machine in turn."""
    steps = [m.step(ip, t, bool(ok)) for m, ip, t, ok in
             zip(machines, pdf["ip"].tolist(), pdf["_t"].tolist(), pdf["success"].tolist(), strict=True)]
    outcome, retry, fails, locked = zip(*steps, strict=True) if steps else ((), (), (), ())
    return pdf.assign(outcome=np.array(outcome, object), retry_after_seconds=np.array(retry, np.int64),
                      failed_attempts=np.array(fails, np.int32), locked_until=login_times(locked))


def _replayed(*rules: int):
    """Replays attempts ordered by (slice, user, time, id).  A (slice, user) starts from the
    state in ``_in`` of its first row, or empty; the last row of a slice gets the state after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, machine, held = None, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            slices, users, times, starts = (pdf[c].tolist() for c in (SLICE, "username", "_t", "_in"))
            machines, first, state = [], np.zeros(len(pdf), bool), np.full(len(pdf), None, object)
            if held is not None:
                if at[0] != slices[0]:
                    held.loc[held.index[-1], "_state"] = machine.export(int(held["_t"].iloc[-1]))
                yield held
            ends = []  # the rows after which a slice ends, with their machines
            for i, now in enumerate(zip(slices, users, strict=True)):
                if now != at:
                    first[i] = at is None or at[0] != now[0]
                    if first[i] and i:
                        ends.append((i - 1, machine))
                    at, machine = now, LoginMachine(*rules)
                    if starts[i] is not None:
                        machine.restore(starts[i])
                machines.append(machine)
            out = login_steps(pdf, machines)
            for i, m in ends:
                state[i] = m.export(times[i])
            held = out.assign(_first=first, _state=state)[[*LOGIN_COLUMNS, "_t", SLICE, "_first", "_state"]]
        if held is not None:
            held.loc[held.index[-1], "_state"] = machine.export(int(held["_t"].iloc[-1]))
            yield held

    return run


def login_outcomes(attempts: DataFrame, window_seconds: int = LIMIT_WINDOW_SECONDS,
                   max_requests: int = LIMIT_MAX_REQUESTS, lock_after: int = LOCK_AFTER_FAILURES,
                   lock_hours: int = LOCK_HOURS, partitions: int | None = None) -> DataFrame:
    """Outcome of every login attempt: RATE_LIMITED, LOCKED, FAILED or SUCCESS.

    Limiter (per ip + username): a window opens at the first attempt and lasts
    ``window_seconds``; the next attempt at or after its end opens a new one;
    attempts beyond ``max_requests`` in a window are rejected (and still
    counted); a successful login removes the window.  Lockout (per username):
    the ``lock_after``-th counted failure locks for ``lock_hours``; failures
    while locked are ignored; success resets; the counter is not reset when a
    lock expires, so the next failure locks again.
    """
    spark = attempts.sparkSession
    n = slice_count(attempts, partitions)
    src = attempts.select(
        "attempt_id", "ip", "username", F.col("ts").cast("timestamp_ntz").alias("ts"), "success",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"),
    )
    replay = _replayed(window_seconds * 1_000_000, max_requests, lock_after, lock_hours * 3_600_000_000)
    order = ["username", "_t", "attempt_id"]
    ranged = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(SLICE, F.spark_partition_id()).withColumn("_in", F.lit(None).cast("string"))
    rounds = [stored(ranged.mapInPandas(replay, REPLAYED), "login-slices")]
    whole = rounds[0].groupBy(SLICE).agg(
        F.max(F.when(F.col("_first"), F.struct("username"))).alias("first"),
        F.max(F.when(F.col("_state").isNotNull(), F.struct("username", F.sha2("_state", 256).alias("state")))).alias("last"))
    ends = sorted(whole.collect(), key=lambda r: r[0])  # a row a slice
    before = {b[0]: a[0] for a, b in zip(ends, ends[1:], strict=False) if a["last"]["username"] == b["first"]["username"]}
    user = {r[0]: r["first"]["username"] for r in ends}
    whole_user = {r[0] for r in ends if r["first"]["username"] == r["last"]["username"]}
    state = {r[0]: r["last"]["state"] for r in ends}
    nothing = hashlib.sha256(NO_STATE.encode()).hexdigest()
    begun, made = dict.fromkeys(before, nothing), dict.fromkeys(state, 0)  # made: the round with a slice's rows of its first user
    ending = dict.fromkeys(state, 0)  # the round with the state at a slice's end
    while wrong := [s for s, p in before.items() if begun[s] != state[p]]:
        left = [rounds[k].filter(F.col("_state").isNotNull()).select(F.lit(k).alias("_round"), F.col(SLICE).alias("_before"), F.col("_state").alias("_in"))
                for k in sorted({ending[before[s]] for s in wrong})]
        states = left[0]
        for more in left[1:]:
            states = states.unionByName(more)
        todo = spark.createDataFrame([(s, before[s], ending[before[s]]) for s in wrong], f"{SLICE} int, _before int, _round int")
        todo = todo.join(states, ["_before", "_round"]).select(SLICE, "_in")
        names = spark.createDataFrame([(s, user[s]) for s in wrong], f"{SLICE} int, username string")
        again = joined_on(rounds[0].select(*src.columns, SLICE, "_first"), names, [SLICE, "username"], "left_semi")
        again = again.join(todo, SLICE).withColumn("_in", F.when(F.col("_first"), F.col("_in"))).drop("_first")
        again = again.repartition(n, SLICE).sortWithinPartitions(SLICE, "_t", "attempt_id")
        rounds.append(stored(again.select(*src.columns, SLICE, "_in").mapInPandas(replay, REPLAYED), "login-again"))
        for s in wrong:
            begun[s], made[s] = state[before[s]], len(rounds) - 1
        for r in rounds[-1].filter(F.col("_state").isNotNull()).select(SLICE, F.sha2("_state", 256)).collect():
            if r[0] in whole_user:
                state[r[0]], ending[r[0]] = r[1], len(rounds) - 1
    replaced = [(s, user[s]) for s, k in made.items() if k]
    if not replaced:
        return rounds[0].select(*LOGIN_COLUMNS)
    out = joined_on(rounds[0], spark.createDataFrame(replaced, f"{SLICE} int, username string"), [SLICE, "username"], "left_anti")
    for k, rows in enumerate(rounds[1:], 1):
        last = [s for s, r in made.items() if r == k]
        if last:
            out = out.unionByName(rows.filter(F.col(SLICE).isin(last)))
    return out.select(*LOGIN_COLUMNS)


def token_status(tokens: DataFrame, as_of: Column) -> DataFrame:
    """REVOKED if revoked at or before ``as_of``, EXPIRED if expires_at <= as_of,
    ACTIVE otherwise; tokens issued after ``as_of`` are left out."""
    t = tokens.filter(F.col("created_at") <= as_of)
    status = (F.when(F.col("revoked_at").isNotNull() & (F.col("revoked_at") <= as_of), "REVOKED")
              .when(F.col("expires_at") <= as_of, "EXPIRED").otherwise("ACTIVE"))
    return t.select("id", "user_id", "family_id", status.alias("status"))


def presentation_checks(presentations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Classify each presented raw token at its presentation time.

    UNKNOWN (no such hash), REUSED (revoked before it was presented: the family
    is compromised), EXPIRED, or VALID.
    """
    p = presentations.withColumn("_hash", F.sha2(F.col("raw_token"), 256))
    t = tokens.select(F.col("token_hash").alias("_hash"), F.col("id").alias("token_id"), "family_id",
                      "created_at", "expires_at", "revoked_at")
    j = p.join(t, "_hash", "left")
    verdict = (F.when(F.col("token_id").isNull(), "UNKNOWN")
               .when(F.col("revoked_at").isNotNull() & (F.col("revoked_at") < F.col("ts")), "REUSED")
               .when(F.col("expires_at") <= F.col("ts"), "EXPIRED").otherwise("VALID"))
    return j.select("presentation_id", "token_id", "family_id", "created_at", "ts", verdict.alias("verdict"))


def token_family_audit(presentations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Families to revoke: first reuse time, number of reuses, and how many of
    the family's tokens were still active at the first reuse.

    The first reuse revokes every token that the family has by then, so whatever is
    presented of them later is a reuse as well.
    """
    checks = presentation_checks(presentations, tokens).filter(F.col("family_id").isNotNull())
    reused = F.col("verdict") == "REUSED"
    first = checks.filter(reused).groupBy("family_id").agg(F.min("ts").alias("first_reuse_at"))
    revoked_then = (F.col("created_at") <= F.col("first_reuse_at")) & (F.col("ts") > F.col("first_reuse_at"))
    fam = (checks.join(first, "family_id").filter(reused | revoked_then)
           .groupBy("family_id", "first_reuse_at").agg(F.count(F.lit(1)).cast("long").alias("reuse_count")))
    live = tokens.join(fam, "family_id").filter(
        (F.col("created_at") <= F.col("first_reuse_at"))
        & (F.col("revoked_at").isNull() | (F.col("revoked_at") > F.col("first_reuse_at")))
        & (F.col("expires_at") > F.col("first_reuse_at"))
    ).groupBy("family_id").agg(F.count(F.lit(1)).cast("long").alias("active_tokens_revoked"))
    return fam.join(live, "family_id", "left").select(
        "family_id", "first_reuse_at", "reuse_count",
        F.coalesce(F.col("active_tokens_revoked"), F.lit(0)).cast("long").alias("active_tokens_revoked"))


def previous_value(df: DataFrame, key: str, order: list, value: str, bucket: Column, out: str = "prev",
                   descending: bool = False) -> DataFrame:
    """``lag(value)`` per key in ``order`` (``lead`` when ``descending``),
    computed per (key, bucket) with a fix-up from the neighbouring non-empty
    bucket, so one busy key is spread over its buckets instead of one task."""
    b = df.withColumn("_bk", bucket)
    ords = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w = Window.partitionBy(key, "_bk").orderBy(*ords)
    inner = b.withColumn("_lag", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    edge = F.min if descending else F.max  # the row a neighbouring bucket hands over
    last = b.groupBy(key, "_bk").agg(edge(F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))).alias("_last"))
    wb = Window.partitionBy(key).orderBy(F.col("_bk").desc() if descending else F.col("_bk").asc())
    carry = last.select(key, "_bk", F.lag(F.col("_last._v")).over(wb).alias("_carry"))
    return (inner.join(carry, [key, "_bk"])
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_bk", "_lag", "_rn", "_carry"))


def invalid_transitions(snapshots: DataFrame, allowed: list, slices: int | None = None) -> DataFrame:
    """Consecutive status changes per entity that are not allowed.

    ``snapshots``: (entity_id, as_of, seq, status); an unchanged status is not a
    transition.  A busy entity lies in several slices.
    """
    order = ["as_of", "seq"]
    rows = sliced(snapshots.select("entity_id", *order, "status"), "entity_id", *order, slices=slices, name="snapshots")
    prev = previous(rows, ["entity_id"], order, "status", "from_status")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("from_status") == a) & (F.col("status") == b))
    return prev.filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")) & ~ok).select(
        "entity_id", "as_of", "seq", "from_status", F.col("status").alias("to_status"))
