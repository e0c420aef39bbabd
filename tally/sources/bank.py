"""Bank source tables derived from the driver's star-schema parquet.

The ledger model needs accounts, users, transfers and ledger entries; the test
data ships customers, suppliers, orders and events.  This module maps one onto
the other with plain DataFrame expressions, so every downstream job reads real,
scaling input.  ``tally.plans.oracle`` holds the same mapping as DuckDB SQL.

Mapping (all deterministic):

* accounts   customers -> CUSTOMER accounts (id = c_custkey, owned by user
             c_custkey); suppliers -> SYSTEM clearing accounts (id = 1e6 + key).
* users      one per customer; KYC status from the customer's region.
* transfers  one per order: from the ordering customer to another customer,
             ``to = (from + 1 + orderkey mod 7) mod n_customers`` (never self).
* ledger     double-entry posting of every transfer, with two settlement flaws
             carried by the source: pending orders ('P') lack their CREDIT leg,
             urgent orders settle the CREDIT leg in whole yen.
* logins, refresh tokens, status snapshots come from ``events`` / ``orders``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.money import MONEY, money
from tally.sources.testdata import table

SYSTEM_ID_OFFSET = 1_000_000
ACCOUNT_EPOCH = "1994-12-31 00:00:00"

# Fixed values of the mapping (must equal the oracle's SQL).
SEGMENT_STATUS = {
    "AUTOMOBILE": "ACTIVE",
    "BUILDING": "ACTIVE",
    "MACHINERY": "ACTIVE",
    "FURNITURE": "FROZEN",
    "HOUSEHOLD": "OPEN",
}
REGION_KYC = {0: "UNVERIFIED", 1: "PENDING", 2: "VERIFIED", 3: "VERIFIED", 4: "REJECTED"}
ORDER_STATUS_ACCOUNT = {"O": "ACTIVE", "F": "FROZEN", "P": "OPEN"}
EVENT_KYC = {
    "signup": "UNVERIFIED",
    "view": "PENDING",
    "click": "PENDING",
    "purchase": "VERIFIED",
    "error": "REJECTED",
}


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default) if default is not None else col)


def _epoch() -> Column:
    return F.to_timestamp_ntz(F.lit(ACCOUNT_EPOCH))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    customers = cust.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("ACC-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("account_number"),
        F.col("c_name").alias("owner_name"),
        _case(F.col("c_mktsegment"), SEGMENT_STATUS).alias("status"),
        F.lit("JPY").alias("currency"),
        money(F.col("c_acctbal")).alias("balance"),
        _epoch().alias("created_at"),
        _epoch().alias("updated_at"),
        F.lit("CUSTOMER").alias("account_type"),
        F.col("c_custkey").alias("owner_user_id"),
    )
    system = supp.select(
        (F.col("s_suppkey") + SYSTEM_ID_OFFSET).alias("id"),
        F.concat(F.lit("SYS-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("account_number"),
        F.col("s_name").alias("owner_name"),
        F.lit("ACTIVE").alias("status"),
        F.lit("JPY").alias("currency"),
        money(F.col("s_acctbal")).alias("balance"),
        _epoch().alias("created_at"),
        _epoch().alias("updated_at"),
        F.lit("SYSTEM").alias("account_type"),
        F.lit(None).cast("bigint").alias("owner_user_id"),
    )
    return customers.unionByName(system)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"),
        F.lit("CUSTOMER").alias("role"),
        F.lit(0).alias("failed_login_attempts"),
        F.lit(None).cast("timestamp_ntz").alias("locked_until"),
        _case(F.col("n_regionkey"), REGION_KYC, "UNVERIFIED").alias("kyc_status"),
    )


def _customer_count(spark: SparkSession, sf_dir: str) -> Column:
    # scalar subquery over a one-row aggregate
    return table(spark, sf_dir, "customer", "c_custkey").agg(F.count(F.lit(1))).scalar()


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return transfers_from_orders(orders, _customer_count(spark, sf_dir))


def transfers_from_orders(orders: DataFrame, n: Column, keep=()) -> DataFrame:
    """Map order rows (batch or streaming) to transfers; ``n`` = number of customers."""
    return orders.select(
        *keep,
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("k"), F.col("o_custkey").cast("string"), F.lit("-"),
                 F.date_format("o_orderdate", "yyyyMMdd")).alias("idempotency_key"),
        F.col("o_custkey").alias("from_account_id"),
        F.pmod(F.col("o_custkey") + 1 + F.pmod(F.col("o_orderkey"), F.lit(7)), n).alias("to_account_id"),
        money(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderdate").alias("created_at"),
    )


def transfers_with_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers plus the order's settlement columns, from one scan of orders."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                   "o_orderstatus", "o_orderpriority")
    return transfers_from_orders(orders, _customer_count(spark, sf_dir), keep=("o_orderstatus", "o_orderpriority"))


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ledger: posting of every transfer, with the settlement flaws."""
    t = transfers_with_settlement(spark, sf_dir)
    credit_amount = F.when(F.col("o_orderpriority") == "1-URGENT", F.floor("amount").cast(MONEY)).otherwise(F.col("amount"))
    legs = F.array(
        F.struct(F.lit("DEBIT").alias("entry_type"), F.col("from_account_id").alias("account_id"),
                 F.col("amount").alias("amount"), F.lit(0).alias("leg")),
        F.when(F.col("o_orderstatus") != "P",
               F.struct(F.lit("CREDIT").alias("entry_type"), F.col("to_account_id").alias("account_id"),
                        credit_amount.alias("amount"), F.lit(1).alias("leg"))),
    )
    return (
        t.select("id", "created_at", F.explode(F.array_compact(legs)).alias("e"))
        .select(
            (F.col("id") * 2 + F.col("e.leg")).alias("id"),
            F.col("id").alias("transaction_id"),
            F.col("e.account_id").alias("account_id"),
            F.col("e.entry_type").alias("entry_type"),
            F.col("e.amount").alias("amount"),
            F.col("created_at"),
        )
    )


def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return ev.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("10.0."), F.col("user_id").cast("string")).alias("ip"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.col("ts"),
        (F.col("event_type") != "error").alias("success"),
    )


def refresh_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event rotates its user's token: the new token replaces the previous one.

    The rotation chain is one family per user; ``revoked_at``/``replaced_by``
    point at the next token of the same user (a bucketed ``lead``, so one very
    active user is not one task).
    """
    from tally.operators.sessions import previous_value

    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    day = F.date_trunc("day", F.col("ts"))
    nxt = ev.withColumn("_next", F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("id")))
    nxt = previous_value(nxt, "user_id", ["ts", "event_id"], "_next", day, out="_n", descending=True)
    return nxt.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.sha2(F.concat(F.lit("tok-"), F.col("event_id").cast("string")), 256).alias("token_hash"),
        F.concat(F.lit("fam-"), F.col("user_id").cast("string")).alias("family_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.col("ts").alias("created_at"),
        F.col("_n.ts").alias("revoked_at"),
        F.col("_n.id").alias("replaced_by"),
    )


def token_presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event presents its user's current token; error events replay an older one."""
    from tally.operators.sessions import previous_value

    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    day = F.date_trunc("day", F.col("ts"))
    p1 = previous_value(ev, "user_id", ["ts", "event_id"], "event_id", day, out="_p1")
    p2 = previous_value(p1, "user_id", ["ts", "event_id"], "_p1", day, out="_p2")
    presented = F.when(F.col("event_type") == "error", F.col("_p2")).otherwise(F.col("_p1"))
    return (
        p2.select(F.col("event_id").alias("presentation_id"), presented.alias("_tok"), F.col("ts"))
        .filter(F.col("_tok").isNotNull())
        .select("presentation_id", F.concat(F.lit("tok-"), F.col("_tok").cast("string")).alias("raw_token"), "ts")
    )


def account_status_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").alias("as_of"),
        F.col("o_orderkey").alias("seq"),
        _case(F.col("o_orderstatus"), ORDER_STATUS_ACCOUNT).alias("status"),
    )


def kyc_status_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return ev.select(
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("as_of"),
        F.col("event_id").alias("seq"),
        _case(F.col("event_type"), EVENT_KYC).alias("status"),
    )


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose the bank tables as temp views (source layer)."""
    for name, fn in {
        "accounts": accounts, "users": users, "transfers": transfers, "ledger_entries": ledger_entries,
        "login_attempts": login_attempts, "refresh_tokens": refresh_tokens,
    }.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)


def transfer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a customer transfer request, sent by the account's owner."""
    t = transfers(spark, sf_dir)
    return t.select(
        F.col("id").alias("request_id"), "idempotency_key", "from_account_id", "to_account_id", "amount",
        F.col("created_at").alias("requested_at"), F.col("from_account_id").alias("caller_user_id"),
    )


EVENT_BATCH_STATUS = {"purchase": "SUCCESS", "view": "SUCCESS", "signup": "SUCCESS", "click": "RUNNING",
                      "error": "FAILED"}


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch-control event log derived from ``events``.

    One run per (user, day); the slot is chosen by the event's ``k`` property,
    the status by its type; rows_written is missing on events with value < 1.
    """
    from tally.operators.audit import EXPECTED_SLOTS as _SLOTS

    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    slot_idx = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(len(_SLOTS)))
    slots = F.array(*[F.struct(F.lit(l).alias("layer"), F.lit(t).alias("source_table")) for l, t in _SLOTS])
    bd = F.date_format("ts", "yyyy-MM-dd")
    return ev.select(
        F.concat(F.lit("b-"), F.col("event_id").cast("string")).alias("batch_id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-"), bd).alias("dag_run_id"),
        F.element_at(slots, slot_idx + 1)["layer"].alias("layer"),
        F.element_at(slots, slot_idx + 1)["source_table"].alias("source_table"),
        bd.alias("business_date"),
        _case(F.col("event_type"), EVENT_BATCH_STATUS, "FAILED").alias("status"),
        F.col("ts").alias("started_at"),
        F.floor("value").cast("long").alias("rows_read"),
        F.when(F.col("value") >= 1, F.floor("value").cast("long")).alias("rows_written"),
    )
