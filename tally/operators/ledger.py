"""Double-entry ledger operators: posting, balances, drift, reconciliation,
transfer eligibility and replay classification.

Sign convention: the *from* account gets the DEBIT leg (withdrawal), the *to*
account the CREDIT leg (deposit); an account's balance is credits minus debits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.money import MONEY, TOTAL, credit_part, debit_part, signed_amount, total
from tally.operators.slices import prefix_sums, sliced

# Fixed values (reference defaults; all are parameters).
KYC_TRANSFER_THRESHOLD = "100000.00"

ENTRY_COLUMNS = ["id", "transaction_id", "account_id", "entry_type", "amount", "created_at"]


def uuid_of(name: Column) -> Column:
    """A UUID string (version 3 layout) that depends on the name only."""
    h = F.md5(name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def post_transfers(transfers: DataFrame) -> DataFrame:
    """Each valid transfer becomes a DEBIT (from) and a CREDIT (to) entry.

    Self-transfers are rejected (no entries).  Entry ids are derived from the
    transfer id so reruns are repeatable: 2*id and 2*id+1 of a whole number, for
    other keys (UUID strings) a name-based UUID of the id and the leg.
    """
    if isinstance(transfers.schema["id"].dataType, T.IntegralType):
        entry_id = F.col("id") * 2 + F.col("e.leg")
    else:
        entry_id = uuid_of(F.concat_ws(":", F.col("id"), F.col("e.entry_type")))
    legs = F.array(
        F.struct(F.lit("DEBIT").alias("entry_type"), F.col("from_account_id").alias("account_id"), F.lit(0).alias("leg")),
        F.struct(F.lit("CREDIT").alias("entry_type"), F.col("to_account_id").alias("account_id"), F.lit(1).alias("leg")),
    )
    return (
        transfers.filter(F.col("from_account_id") != F.col("to_account_id"))
        .select("id", "amount", "created_at", F.explode(legs).alias("e"))
        .select(
            entry_id.alias("id"),
            F.col("id").alias("transaction_id"),
            F.col("e.account_id").alias("account_id"),
            F.col("e.entry_type").alias("entry_type"),
            F.col("amount").cast(MONEY).alias("amount"),
            F.col("created_at"),
        )
    )


def post_deposits(deposits: DataFrame, clearing_account_id) -> DataFrame:
    """A deposit is a transfer from the clearing account to the customer."""
    return post_transfers(deposits.withColumn("from_account_id", F.lit(clearing_account_id)))


def balances(entries: DataFrame) -> DataFrame:
    """Ledger balance per account (credits - debits)."""
    return entries.groupBy("account_id").agg(total(signed_amount(F.col("entry_type"), F.col("amount"))).alias("ledger_balance"))


def balance_drift(accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """Accounts whose stored balance differs from the sum of their entries.

    Full outer join: an account without entries has ledger balance 0, entries
    for an unknown account have stored balance 0.
    """
    led = balances(entries)
    acc = accounts.select(F.col("id").alias("account_id"), F.col("balance").alias("_stored"))
    j = acc.join(led, "account_id", "full_outer")
    stored = F.coalesce(F.col("_stored"), F.lit(0)).cast(TOTAL)
    ledger = F.coalesce(F.col("ledger_balance"), F.lit(0)).cast(TOTAL)
    return (
        j.select(
            "account_id",
            stored.alias("stored_balance"),
            ledger.alias("ledger_balance"),
            (stored - ledger).cast(TOTAL).alias("drift"),
            F.col("_stored").isNull().alias("unknown_account"),
        ).filter(F.col("drift") != 0)
    )


def transaction_legs(entries: DataFrame) -> DataFrame:
    """Per transaction: leg counts and debit / credit totals."""
    return entries.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(F.col("entry_type") == "DEBIT").alias("debit_count"),
        F.count_if(F.col("entry_type") == "CREDIT").alias("credit_count"),
        total(debit_part(F.col("entry_type"), F.col("amount"))).alias("debit_total"),
        total(credit_part(F.col("entry_type"), F.col("amount"))).alias("credit_total"),
    )


def is_balanced_pair() -> Column:
    return (
        (F.col("entry_count") == 2) & (F.col("debit_count") == 1) & (F.col("credit_count") == 1)
        & (F.col("debit_total") == F.col("credit_total"))
    )


def unbalanced_transactions(entries: DataFrame) -> DataFrame:
    """Transactions that are not exactly one DEBIT and one CREDIT of equal amount."""
    return transaction_legs(entries).filter(~is_balanced_pair()).select(
        "transaction_id",
        F.col("debit_count").cast("long").alias("debit_count"),
        F.col("credit_count").cast("long").alias("credit_count"),
        "debit_total",
        "credit_total",
    )


def reconciliation_report(entries: DataFrame) -> DataFrame:
    """Whole-ledger report in one row: totals, global balance, unbalanced count.

    The unbalanced ids themselves are :func:`unbalanced_transactions` — they are
    not gathered into this row, which would put an unbounded list in one task.
    """
    legs = transaction_legs(entries)
    return legs.agg(
        F.coalesce(F.sum("debit_total"), F.lit(0)).cast(TOTAL).alias("total_debits"),
        F.coalesce(F.sum("credit_total"), F.lit(0)).cast(TOTAL).alias("total_credits"),
        F.coalesce(F.sum("entry_count"), F.lit(0)).cast("long").alias("entry_count"),
        F.count_if(~is_balanced_pair()).cast("long").alias("unbalanced_count"),
    ).select(
        "total_debits", "total_credits", "entry_count", "unbalanced_count",
        (F.col("total_debits") == F.col("total_credits")).alias("globally_balanced"),
        ((F.col("total_debits") == F.col("total_credits")) & (F.col("unbalanced_count") == 0)).alias("is_clean"),
    )


def running_balance(entries: DataFrame, accounts: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Balance after every entry, per account, in (created_at, id) order.

    Entries are cut into slices of about equal size by (account, time, id); a slice's
    own running sum starts from the total of the account's earlier slices.  A clearing
    account, or one day of it, lies in as many slices as it needs.  With
    ``accounts`` the stored balance is the opening balance and CUSTOMER rows
    going below zero are marked as overdraft.
    """
    e = entries.select("id", "account_id", "created_at", signed_amount(F.col("entry_type"), F.col("amount")).cast(TOTAL).alias("delta"))
    rows = sliced(e, "account_id", "created_at", "id", slices=slices, name="entries")
    out = prefix_sums(rows, ["account_id"], ["created_at", "id"], {"running": F.col("delta")})
    running = F.col("running").cast(TOTAL)
    if accounts is None:
        return out.select("id", "account_id", "created_at", "delta", running.alias("running_balance"))
    acc = accounts.select(F.col("id").alias("account_id"), F.col("balance").alias("_open"), "account_type")
    out = out.join(acc, "account_id", "left")
    bal = (F.coalesce(F.col("_open"), F.lit(0)) + running).cast(TOTAL)
    return out.select(
        "id", "account_id", "created_at", "delta", bal.alias("running_balance"),
        ((F.col("account_type") == "CUSTOMER") & (bal < 0)).alias("overdraft"),
    )


SAVED = "accepted"


def replay_classification(requests: DataFrame, key: str = "idempotency_key", order=("requested_at", "request_id"),
                          accepted: str | None = None) -> DataFrame:
    """How each request fares under its idempotency key.

    A key belongs to the first request that passes every other check (boolean column
    ``accepted``; without one all pass), as only saved transfers are looked up: that one
    is EXECUTED.  Requests before it, or under a key that nobody owns, are REJECTED.
    Requests after it are REPLAY with the same payload and CONFLICT with another.

    Skew-safe: the owner of a key comes from a partial aggregate (min over a struct),
    joined back instead of a window over the key.
    """
    order_struct = F.struct(*[F.col(c) for c in order])
    passing = requests.filter(F.col(accepted)) if accepted else requests
    owner = passing.groupBy(key).agg(
        F.min(F.struct(order_struct.alias("o"), F.col("from_account_id").alias("f"), F.col("to_account_id").alias("t"),
                       F.col("amount").alias("a"))).alias("_owner")
    )
    j = requests.join(owner, key, "left")
    same = (
        (F.col("from_account_id") == F.col("_owner.f")) & (F.col("to_account_id") == F.col("_owner.t"))
        & (F.col("amount") == F.col("_owner.a"))
    )
    return j.withColumn(
        "replay_status",
        F.when(F.col("_owner").isNull() | (order_struct < F.col("_owner.o")), "REJECTED")
        .when(order_struct == F.col("_owner.o"), "EXECUTED").when(same, "REPLAY").otherwise("CONFLICT")
    ).drop("_owner")


def own_reason(requests: DataFrame, accounts: DataFrame, users: DataFrame,
               kyc_threshold: str = KYC_TRANSFER_THRESHOLD, customer_transfer: bool = True) -> DataFrame:
    """Adds ``own_reason``, why a request fails whatever its key (NULL: it passes), and ``accepted``.

    The first reason in this order wins: INVALID_REQUEST (missing ids, amounts not above
    zero) -> SELF_TRANSFER -> ACCOUNT_NOT_FOUND -> SYSTEM_FROM -> SYSTEM_TO -> NOT_OWNER ->
    KYC_LIMIT -> FROM_NOT_ACTIVE -> INSUFFICIENT_FUNDS -> TO_NOT_ACTIVE.  Works on streams
    (accounts and users are static sides).
    """
    fa = accounts.select(F.col("id").alias("_f_id"), F.col("status").alias("_f_status"),
                         F.col("account_type").alias("_f_type"), F.col("balance").alias("_f_balance"),
                         F.col("owner_user_id").alias("_f_owner"))
    ta = accounts.select(F.col("id").alias("_t_id"), F.col("status").alias("_t_status"),
                         F.col("account_type").alias("_t_type"))
    u = users.select(F.col("id").alias("_u_id"), F.col("kyc_status").alias("_kyc"))
    j = (requests.join(fa, F.col("from_account_id") == F.col("_f_id"), "left")
         .join(ta, F.col("to_account_id") == F.col("_t_id"), "left")
         .join(u, F.col("_f_owner") == F.col("_u_id"), "left"))
    amt = F.col("amount")
    missing = (F.col("from_account_id").isNull() | F.col("to_account_id").isNull() | amt.isNull()
               | F.col("idempotency_key").isNull())
    reason = (
        F.when(missing | ~(amt > 0), "INVALID_REQUEST")
        .when(F.col("from_account_id") == F.col("to_account_id"), "SELF_TRANSFER")
        .when(F.col("_f_id").isNull() | F.col("_t_id").isNull(), "ACCOUNT_NOT_FOUND")
    )
    if customer_transfer:
        reason = (
            reason.when(F.col("_f_type") == "SYSTEM", "SYSTEM_FROM")
            .when(F.col("_t_type") == "SYSTEM", "SYSTEM_TO")
            .when(F.col("_f_owner").isNull() | F.col("caller_user_id").isNull()
                  | (F.col("_f_owner") != F.col("caller_user_id")), "NOT_OWNER")
            .when((amt > F.lit(kyc_threshold).cast(MONEY)) & (F.col("_kyc") == "UNVERIFIED"), "KYC_LIMIT")
        )
    reason = (
        reason.when(F.col("_f_status") != "ACTIVE", "FROM_NOT_ACTIVE")
        .when((F.col("_f_type") == "CUSTOMER") & (amt > F.col("_f_balance")), "INSUFFICIENT_FUNDS")
        .when(F.col("_t_status") != "ACTIVE", "TO_NOT_ACTIVE")
    )
    return j.select(*requests.columns, reason.alias("own_reason")).withColumn(SAVED, F.col("own_reason").isNull())


def transfer_eligibility(requests: DataFrame, accounts: DataFrame, users: DataFrame,
                         kyc_threshold: str = KYC_TRANSFER_THRESHOLD, customer_transfer: bool = True) -> DataFrame:
    """Decide every transfer request against a balance snapshot.

    An invalid request is rejected before its key is looked at; then a key that an
    earlier request owns decides (REPLAY or CONFLICT); then the request's own reason.
    """
    decided = replay_classification(own_reason(requests, accounts, users, kyc_threshold, customer_transfer), accepted=SAVED)
    by_key = F.col("replay_status").isin("REPLAY", "CONFLICT") & ~F.coalesce(F.col("own_reason") == "INVALID_REQUEST", F.lit(False))
    reason = F.when(by_key, F.col("replay_status")).otherwise(F.col("own_reason"))
    decision = F.when(reason.isNull(), "EXECUTED").when(reason == "REPLAY", "REPLAY").otherwise("REJECTED")
    return decided.select("request_id", "idempotency_key", decision.alias("decision"), reason.alias("reason"))


def kyc_limit_audit(transfers: DataFrame, accounts: DataFrame, users: DataFrame,
                    kyc_threshold: str = KYC_TRANSFER_THRESHOLD) -> DataFrame:
    """Transfers above the KYC threshold sent by an UNVERIFIED owner (equal amount passes)."""
    acc = accounts.select(F.col("id").alias("_a_id"), F.col("owner_user_id").alias("_owner"))
    u = users.select(F.col("id").alias("_u_id"), F.col("kyc_status"))
    return (
        transfers.filter(F.col("amount") > F.lit(kyc_threshold).cast(MONEY))
        .join(acc, F.col("from_account_id") == F.col("_a_id"))
        .join(u, F.col("_owner") == F.col("_u_id"))
        .filter(F.col("kyc_status") == "UNVERIFIED")
        .select(F.col("id").alias("transfer_id"), F.col("_owner").alias("user_id"), "amount", "kyc_status")
    )


def account_statement(entries: DataFrame, accounts: DataFrame, owner_user_id=None) -> DataFrame:
    """Entries of accounts visible to their owner (all owners when none is given)."""
    acc = accounts.filter(F.col("owner_user_id").isNotNull())
    if owner_user_id is not None:
        acc = acc.filter(F.col("owner_user_id") == F.lit(owner_user_id))
    acc = acc.select(F.col("id").alias("_acc"), F.col("owner_user_id"))
    return entries.join(acc, entries.account_id == acc._acc).select(
        "owner_user_id", "account_id", "id", "transaction_id", "entry_type", "amount"
    )


def account_summary(accounts: DataFrame) -> DataFrame:
    return accounts.select("id", "account_number", "status", "currency", "balance", "account_type")
