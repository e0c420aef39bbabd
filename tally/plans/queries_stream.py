"""Catalogue: the streaming twins, run to completion (availableNow) over the
orders / events files and written to a parquet sink under the shared
checkpoint folder; the query returns a batch read of that sink."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.plans.queries_aml import CAT_STRUCT_COUNT, CAT_STRUCT_MIN, CAT_STRUCT_WINDOW, CAT_THRESHOLD, \
    CAT_VELOCITY_COUNT, CAT_VELOCITY_WINDOW, REQUESTS_SQL, _US_30D, _US_365D
from tally.operators import ledger
from tally.plans.queries_misc import _login_oracle
from tally.plans.registry import register
from tally.session import ensure_checkpoint_dir
from tally.sources import bank
from tally.sources.testdata import table
from tally.streaming import dashboard, ingest, stateful


def _stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(_landing(sf_dir, name))


def _landing(sf_dir: str, name: str) -> str:
    """A pattern that finds the table as one file and as a directory of part files."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def _stream_transfers(spark, sf_dir):
    n = table(spark, sf_dir, "customer", "c_custkey").count()  # one scalar, fixed for the stream
    orders = _stream_of(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return bank.transfers_from_orders(orders, F.lit(n))


def _places(spark: SparkSession, name: str) -> tuple[str, str]:
    """Folders of a run for results and for the checkpoint."""
    base, run = ensure_checkpoint_dir(spark).rstrip("/"), uuid.uuid4().hex[:12]
    return f"{base}/stream-out/{name}-{run}", f"{base}/streams/{name}-{run}"


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out, checkpoint = _places(spark, name)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("stream_aml_counts", f"""
SELECT id, from_account_id,
       CAST(count(*) OVER (PARTITION BY from_account_id ORDER BY created_at
             RANGE BETWEEN to_microseconds({_US_30D}) PRECEDING AND CURRENT ROW) AS BIGINT) AS velocity_count,
       CAST(sum(CASE WHEN amount BETWEEN {CAT_STRUCT_MIN} AND {CAT_THRESHOLD} THEN 1 ELSE 0 END)
            OVER (PARTITION BY from_account_id ORDER BY created_at
                  RANGE BETWEEN to_microseconds({_US_365D}) PRECEDING AND CURRENT ROW) AS BIGINT) AS structuring_count
FROM transfers
""")
def stream_aml_counts(spark, sf_dir):
    out, checkpoint = _places(spark, "aml")
    stateful.aml_history_stream(_stream_transfers(spark, sf_dir), out, checkpoint, CAT_VELOCITY_COUNT, CAT_VELOCITY_WINDOW,
                                CAT_STRUCT_COUNT, CAT_STRUCT_WINDOW, CAT_STRUCT_MIN, CAT_THRESHOLD).awaitTermination()
    return spark.read.parquet(out).select("id", "from_account_id", "velocity_count", "structuring_count")


@register("stream_replay", REQUESTS_SQL + """
SELECT request_id, idempotency_key, replay_status FROM held
""")
def stream_replay(spark, sf_dir):
    t = _stream_transfers(spark, sf_dir).select(
        F.col("id").alias("request_id"), "idempotency_key", "from_account_id", "to_account_id", "amount",
        F.col("created_at").alias("requested_at"), F.col("from_account_id").alias("caller_user_id"))
    out, checkpoint = _places(spark, "replay")
    checked = ledger.own_reason(t, bank.accounts(spark, sf_dir), bank.users(spark, sf_dir))
    stateful.replay_stream(checked, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("request_id", "idempotency_key", "replay_status")


@register("stream_login", _login_oracle("""
SELECT attempt_id, username, outcome, CAST(fails AS INTEGER) AS failed_attempts FROM s
"""), prelude=True)
def stream_login(spark, sf_dir):
    """Streaming limiter + lockout; one micro-batch holds every attempt, so it
    equals the batch state machine (same recursive-CTE oracle)."""
    ev = _stream_of(spark, sf_dir, "events")
    att = ev.select(F.col("event_id").alias("attempt_id"),
                    F.concat(F.lit("10.0."), F.col("user_id").cast("string")).alias("ip"),
                    F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), "ts",
                    (F.col("event_type") != "error").alias("success"))
    return _drain(spark, stateful.login_stream(att, lateness="1 hour"), "login").select(
        "attempt_id", "username", "outcome", "failed_attempts")


@register("stream_velocity_windows", f"""
, b AS (SELECT from_account_id, created_at, unnest(generate_series(0, 2)) AS k FROM transfers),
win AS (SELECT from_account_id,
               epoch_ms(CAST(floor(epoch_ms(created_at) / 864000000.0) AS BIGINT) * 864000000 - k * 864000000)
                 AS window_start
        FROM b)
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, from_account_id,
       CAST(count(*) AS BIGINT) AS transfers
FROM win GROUP BY window_start, from_account_id
HAVING count(*) >= {CAT_VELOCITY_COUNT}
""".replace("\n, b AS", ", b AS", 1))
def stream_velocity_windows(spark, sf_dir):
    """Sliding-window dashboard: all windows, those that are still open at the end included."""
    windows = dashboard.velocity_windows(_stream_transfers(spark, sf_dir), "30 days", "10 days", CAT_VELOCITY_COUNT, lateness="1 day")
    out, checkpoint = _places(spark, "dashboard")
    dashboard.keep_windows(windows, out, checkpoint).awaitTermination()
    saved = dashboard.saved_windows(spark, windows, out)
    return saved.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz"))


@register("stream_bronze_ingest", """
SELECT id, idempotency_key, from_account_id, to_account_id, amount, created_at,
       strftime(created_at, '%Y-%m-%d') AS business_date
FROM transfers
""")
def stream_bronze_ingest(spark, sf_dir):
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    root = f"{base}/stream-lake-{run}"
    n = table(spark, sf_dir, "customer", "c_custkey").count()
    ingest.ingest_files(spark, _landing(sf_dir, "orders"), table(spark, sf_dir, "orders").schema, root, "transfers",
                        checkpoint=f"{base}/streams/ingest-{run}",
                        shape=lambda orders: bank.transfers_from_orders(orders, F.lit(n))).awaitTermination()
    return ingest.read_landed(spark, root, "transfers").select(
        "id", "idempotency_key", "from_account_id", "to_account_id", "amount", "created_at", "business_date")
