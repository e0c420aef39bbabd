"""Stateful stream twins of the per-key batch operators.

Each runs ``groupBy(key).applyInPandasWithState`` with an event-time timeout,
so state lives in Spark's state store (checkpointed, survives executor loss)
and is dropped once the watermark passes the longest look-back.  Semantics:
rows are evaluated when they arrive, in event-time order within a
micro-batch; with in-order arrival the result equals the batch operator
(``tally.operators.aml`` / ``ledger`` / ``sessions``), which the tests check.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tally.operators import aml, ledger, sessions
from tally.operators.slices import joined_on


def _set_timeout(state: GroupState, ms: int) -> None:
    """Event-time timeout, never at or behind the current watermark."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


# ---------------------------------------------------------------- ST2: AML velocity + structuring

AML_KEYS = ("id", "from_account_id", "created_at", "amount")  # of the types the transfers have
AML_OUT = [("velocity_count", T.LongType()), ("structuring_count", T.LongType()), ("velocity_flag", T.BooleanType()),
           ("structuring_flag", T.BooleanType())]
AML_STATE = "ts array<long>, qual array<int>"


def aml_stream(transfers: DataFrame, velocity_count: int = aml.VELOCITY_COUNT, velocity_window: str = aml.VELOCITY_WINDOW,
               structuring_count: int = aml.STRUCTURING_COUNT, structuring_window: str = aml.STRUCTURING_WINDOW,
               minimum: str = aml.STRUCTURING_MINIMUM, threshold: str = aml.THRESHOLD,
               lateness: str = "10 minutes") -> DataFrame:
    """Velocity and structuring counts per arriving transfer.

    State per sender: (time, qualifies) of its transfers within the longest
    window; counting is two ``searchsorted`` calls per batch (vectorised).
    """
    wv, ws = aml._micros(velocity_window), aml._micros(structuring_window)
    horizon = max(wv, ws)
    src = (transfers.withColumn("_et", F.col("created_at").cast("timestamp")).withWatermark("_et", lateness)
           .withColumn("_t", F.unix_micros(F.col("created_at").cast("timestamp")))
           .withColumn("_q", ((F.col("amount") >= F.lit(minimum).cast("decimal(19,4)"))
                              & (F.col("amount") <= F.lit(threshold).cast("decimal(19,4)"))).cast("int")))

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(pdfs), ignore_index=True)
        if state.exists:
            hist_t, hist_q = state.get
            hist_t, hist_q = np.asarray(hist_t, np.int64), np.asarray(hist_q, np.int64)
        else:
            hist_t, hist_q = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new_t = new["_t"].to_numpy(np.int64)
        new_q = new["_q"].fillna(0).to_numpy(np.int64)
        all_t = np.concatenate([hist_t, new_t])
        all_q = np.concatenate([hist_q, new_q])
        order = np.argsort(all_t, kind="stable")
        all_t, all_q = all_t[order], all_q[order]
        cum_q = np.concatenate([[0], np.cumsum(all_q)])
        upto = np.searchsorted(all_t, new_t, side="right")
        v_from = np.searchsorted(all_t, new_t - wv, side="right")
        s_from = np.searchsorted(all_t, new_t - ws, side="right")
        vc = upto - v_from
        sc = cum_q[upto] - cum_q[s_from]
        keep = all_t > all_t.max() - horizon
        state.update((all_t[keep].tolist(), all_q[keep].astype(int).tolist()))
        _set_timeout(state, int(all_t.max() // 1000 + horizon // 1000))
        yield pd.DataFrame({
            "id": new["id"], "from_account_id": new["from_account_id"], "created_at": new["created_at"],
            "amount": new["amount"], "velocity_count": vc, "structuring_count": sc,
            "velocity_flag": vc >= velocity_count, "structuring_flag": sc >= structuring_count,
        })

    out = T.StructType([*(transfers.schema[c] for c in AML_KEYS), *(T.StructField(n, t) for n, t in AML_OUT)])
    return src.groupBy("from_account_id").applyInPandasWithState(
        fn, out, AML_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def aml_history_stream(transfers: DataFrame, out: str, checkpoint: str, velocity_count: int = aml.VELOCITY_COUNT,
                       velocity_window: str = aml.VELOCITY_WINDOW, structuring_count: int = aml.STRUCTURING_COUNT,
                       structuring_window: str = aml.STRUCTURING_WINDOW, minimum: str = aml.STRUCTURING_MINIMUM,
                       threshold: str = aml.THRESHOLD, lateness: str = "10 minutes"):
    """Start an availableNow stream of velocity and structuring counts; returns the query.

    Each micro-batch is counted by the batch operator together with the earlier transfers of its
    senders that its look-backs can reach.  Those are read from the results themselves, which lie
    at ``out`` in a folder per epoch and per span of the longest window, so what a batch reads
    is bounded by a few windows' traffic, not by the history; a busy sender is spread as in the
    batch operator.  No row is dropped: one that comes more than ``lateness`` behind the newest row of
    earlier batches is counted all the same and marked in the column ``late``.  A repeated
    epoch rewrites its folder and reads only earlier ones; a new checkpoint needs a new ``out``.
    """
    horizon = max(aml._micros(velocity_window), aml._micros(structuring_window))
    kept = T.StructType([*(transfers.schema[c] for c in AML_KEYS), *(T.StructField(n, t) for n, t in AML_OUT),
                         T.StructField("late", T.BooleanType()), T.StructField("_t", T.LongType()),
                         T.StructField("_epoch", T.LongType()), T.StructField("_span", T.LongType())])
    looks = {"velocity_count": (velocity_window, None),
             "structuring_count": (structuring_window, aml.qualifies(minimum, threshold))}

    def decide(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.select(*AML_KEYS, F.unix_micros(F.col("created_at").cast("timestamp")).alias("_t"))
        first, last = new.agg(F.min("_t"), F.max("_t")).first()
        newest, known = None, new.withColumn("_new", F.lit(True))
        if epoch and first is not None:
            saved = spark.read.schema(kept).parquet(out).filter((F.col("_epoch") < epoch) & (F.col("_span") >= first // horizon - 1))
            newest = saved.agg(F.max("_t")).first()[0]
            reached = saved.filter(F.col("_span") <= last // horizon).select(*new.columns, F.lit(False).alias("_new"))
            known = known.unionByName(joined_on(reached, new.select("from_account_id").distinct(), ["from_account_id"], "left_semi"))
        counted = aml.look_back_counts(known, looks).filter("_new")
        behind = F.lit(False) if newest is None else F.coalesce(F.col("_t") < newest - aml._micros(lateness), F.lit(False))
        (counted.withColumn("velocity_flag", F.col("velocity_count") >= velocity_count)
         .withColumn("structuring_flag", F.col("structuring_count") >= structuring_count)
         .withColumn("late", behind).withColumn("_span", F.floor(F.coalesce("_t", F.lit(0)) / horizon))
         .select(*[f.name for f in kept if f.name != "_epoch"])
         .write.mode("overwrite").partitionBy("_span").parquet(f"{out}/_epoch={epoch}"))

    return (transfers.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def late_rows(query) -> int:
    """Rows that the stateful operators of a finished stream dropped behind its watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


# ---------------------------------------------------------------- ST3: replay / conflict per idempotency key



def replay_stream(requests: DataFrame, out: str, checkpoint: str):
    """Start an availableNow stream that classifies arriving requests; returns the query.

    ``requests`` has the boolean column ``accepted`` (see ``ledger.own_reason``).  Each
    micro-batch is held against the transfers saved by earlier ones and then decided by
    the batch operator, so a key is remembered for ever, a busy key is spread as in the
    batch operator, and no row is too late.  The results at ``out``, in a folder per
    epoch, are the store: a repeated epoch rewrites its folder and reads only earlier ones.
    """
    columns = ["request_id", "idempotency_key", "from_account_id", "to_account_id", "amount"]
    schema = T.StructType([*(requests.schema[c] for c in columns), T.StructField("replay_status", T.StringType()),
                           T.StructField("_epoch", T.LongType())])

    def decide(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        saved = spark.createDataFrame([], schema)
        if epoch:
            saved = spark.read.schema(schema).parquet(out).filter((F.col("_epoch") < epoch) & (F.col("replay_status") == "EXECUTED"))
        saved = saved.select("idempotency_key", F.struct("from_account_id", "to_account_id", "amount").alias("_saved"))
        known = df.join(saved, "idempotency_key", "left")
        payload = F.struct("from_account_id", "to_account_id", "amount")
        late = known.filter(F.col("_saved").isNotNull()).select(
            *columns, F.when(payload == F.col("_saved"), "REPLAY").otherwise("CONFLICT").alias("replay_status"))
        fresh = known.filter(F.col("_saved").isNull()).drop("_saved")
        fresh = ledger.replay_classification(fresh, accepted=ledger.SAVED).select(*columns, "replay_status")
        late.unionByName(fresh).write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")

    return (requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def replay_suppressed(requests: DataFrame) -> DataFrame:
    """Only the first arrival per idempotency key; keys are remembered for ever."""
    return requests.dropDuplicates(["idempotency_key"])


# ---------------------------------------------------------------- ST4: login limiter + lockout

LOGIN_STATE = "state string"


def login_stream(attempts: DataFrame, window_seconds: int = sessions.LIMIT_WINDOW_SECONDS,
                 max_requests: int = sessions.LIMIT_MAX_REQUESTS, lock_after: int = sessions.LOCK_AFTER_FAILURES,
                 lock_hours: int = sessions.LOCK_HOURS, lateness: str = "1 minute") -> DataFrame:
    """Streaming twin of :func:`tally.operators.sessions.login_outcomes`.

    The state of a user is its open windows, failure count and lock.  Windows go when they have
    run out, and a user without failures goes with the last of them.
    """
    lock_us = lock_hours * 3_600_000_000
    src = (attempts.withColumn("_et", F.col("ts").cast("timestamp")).withWatermark("_et", lateness)
           .select("_et", "attempt_id", "ip", "username", F.col("ts").cast("timestamp_ntz").alias("ts"), "success",
                   F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")))

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            m = sessions.LoginMachine(window_seconds * 1_000_000, max_requests, lock_after, lock_us)
            m.restore(state.get[0])
            if m.failures or m.locked_until is not None:  # failures count until a login succeeds, however long that takes
                state.update((m.export(state.getCurrentWatermarkMs() * 1000),))
            else:
                state.remove()
            return
        new = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "attempt_id"], kind="stable")
        m = sessions.LoginMachine(window_seconds * 1_000_000, max_requests, lock_after, lock_us)
        if state.exists:
            m.restore(state.get[0])
        out = sessions.login_steps(new, [m] * len(new))
        last = int(new["_t"].max())
        state.update((m.export(last),))
        _set_timeout(state, (last + window_seconds * 1_000_000) // 1000 + 1)
        yield out[sessions.LOGIN_COLUMNS]

    return src.groupBy("username").applyInPandasWithState(
        fn, sessions.LOGIN_SCHEMA, LOGIN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
