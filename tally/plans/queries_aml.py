"""Catalogue: AML rules, transfer eligibility, replay, KYC, statements, SQL checks.

The reference limits (1 000 000 threshold, 5 in 10 min, 3 in 24 h from
900 000) never trigger on the test data (orders top out near 500 000 and are
dated by day), so the catalogue runs the same operators with limits scaled to
the data; every limit is a plain parameter.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import aml, ledger
from tally.operators.dedup import duplicate_keys
from tally.plans.registry import register
from tally.sources import bank

# Scaled limits used by the catalogue (parameters of the operators).
CAT_THRESHOLD = "450000.00"
CAT_VELOCITY_COUNT = 3
CAT_VELOCITY_WINDOW = "30 days"
CAT_STRUCT_COUNT = 2
CAT_STRUCT_WINDOW = "365 days"
CAT_STRUCT_MIN = "400000.00"

_US_30D = 30 * 86_400_000_000 - 1
_US_365D = 365 * 86_400_000_000 - 1


@register("aml_threshold", f"""
SELECT id AS transfer_id, from_account_id, amount FROM transfers WHERE amount > {CAT_THRESHOLD}
""")
def aml_threshold(spark, sf_dir):
    t = aml.threshold_hits(bank.transfers(spark, sf_dir), CAT_THRESHOLD)
    return t.select(F.col("id").alias("transfer_id"), "from_account_id", "amount")


@register("aml_velocity", f"""
SELECT id AS transfer_id, from_account_id, created_at,
       CAST(count(*) OVER (PARTITION BY from_account_id ORDER BY created_at
             RANGE BETWEEN to_microseconds({_US_30D}) PRECEDING AND CURRENT ROW) AS BIGINT) AS velocity_count
FROM transfers
QUALIFY velocity_count >= {CAT_VELOCITY_COUNT}
""")
def aml_velocity(spark, sf_dir):
    t = aml.velocity(bank.transfers(spark, sf_dir), CAT_VELOCITY_COUNT, CAT_VELOCITY_WINDOW)
    return t.filter("velocity_flag").select(F.col("id").alias("transfer_id"), "from_account_id", "created_at",
                                            "velocity_count")


@register("aml_structuring", f"""
SELECT id AS transfer_id, from_account_id, created_at,
       CAST(sum(CASE WHEN amount BETWEEN {CAT_STRUCT_MIN} AND {CAT_THRESHOLD} THEN 1 ELSE 0 END)
            OVER (PARTITION BY from_account_id ORDER BY created_at
                  RANGE BETWEEN to_microseconds({_US_365D}) PRECEDING AND CURRENT ROW) AS BIGINT) AS structuring_count
FROM transfers
QUALIFY structuring_count >= {CAT_STRUCT_COUNT}
""")
def aml_structuring(spark, sf_dir):
    t = aml.structuring(bank.transfers(spark, sf_dir), CAT_STRUCT_COUNT, CAT_STRUCT_WINDOW, CAT_STRUCT_MIN, CAT_THRESHOLD)
    return t.filter("structuring_flag").select(F.col("id").alias("transfer_id"), "from_account_id", "created_at",
                                               "structuring_count")


_FLAGS_SQL = f"""
, ct AS (
    SELECT t.*, a.owner_user_id AS user_id,
           count(*) OVER w30 AS vc,
           sum(CASE WHEN t.amount BETWEEN {CAT_STRUCT_MIN} AND {CAT_THRESHOLD} THEN 1 ELSE 0 END) OVER w365 AS sc
    FROM transfers t JOIN accounts a ON a.id = t.from_account_id AND a.account_type = 'CUSTOMER'
    WINDOW w30 AS (PARTITION BY t.from_account_id ORDER BY t.created_at
                   RANGE BETWEEN to_microseconds({_US_30D}) PRECEDING AND CURRENT ROW),
           w365 AS (PARTITION BY t.from_account_id ORDER BY t.created_at
                   RANGE BETWEEN to_microseconds({_US_365D}) PRECEDING AND CURRENT ROW)),
flags AS (
    SELECT user_id, id AS transfer_id, 'THRESHOLD' AS reason, amount, created_at FROM ct WHERE amount > {CAT_THRESHOLD}
    UNION ALL SELECT user_id, id, 'VELOCITY', amount, created_at FROM ct WHERE vc >= {CAT_VELOCITY_COUNT}
    UNION ALL SELECT user_id, id, 'STRUCTURING', amount, created_at FROM ct WHERE sc >= {CAT_STRUCT_COUNT})
"""


def _flags(spark, sf_dir):
    return aml.aml_flags(bank.transfers(spark, sf_dir), bank.accounts(spark, sf_dir), CAT_THRESHOLD,
                         CAT_VELOCITY_COUNT, CAT_VELOCITY_WINDOW, CAT_STRUCT_COUNT, CAT_STRUCT_WINDOW, CAT_STRUCT_MIN)


@register("aml_flags", _FLAGS_SQL + """
SELECT CAST(transfer_id AS VARCHAR) || ':' || reason AS id, user_id, transfer_id, reason,
       CAST(amount AS DECIMAL(19,2)) AS amount, 'OPEN' AS status, created_at
FROM flags
""")
def aml_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("id", "user_id", "transfer_id", "reason", "amount", "status", "created_at")


@register("open_flags_queue", _FLAGS_SQL + """
SELECT CAST(transfer_id AS VARCHAR) || ':' || reason AS id, user_id, transfer_id, reason, created_at
FROM flags ORDER BY created_at DESC, id
""")
def open_flags_queue(spark, sf_dir):
    return aml.open_queue(_flags(spark, sf_dir)).select("id", "user_id", "transfer_id", "reason", "created_at")


@register("review_flags", _FLAGS_SQL + """
, f2 AS (SELECT CAST(transfer_id AS VARCHAR) || ':' || reason AS id, user_id, reason FROM flags),
acts AS (SELECT f2.id AS flag_id FROM f2 JOIN users u ON u.id = f2.user_id WHERE u.kyc_status = 'VERIFIED')
SELECT id, reason,
       CASE WHEN id IN (SELECT flag_id FROM acts) THEN 'REVIEWED' ELSE 'OPEN' END AS status
FROM f2
""")
def review_flags(spark, sf_dir):
    flags = _flags(spark, sf_dir)
    u = bank.users(spark, sf_dir).filter(F.col("kyc_status") == "VERIFIED").select(F.col("id").alias("_uid"))
    actions = flags.join(u, flags.user_id == u._uid).select(F.col("id").alias("flag_id"))
    updated, _missing = aml.review(flags, actions)
    return updated.select("id", "reason", "status")


@register("kyc_limit_audit", """
SELECT t.id AS transfer_id, a.owner_user_id AS user_id, t.amount, u.kyc_status
FROM transfers t JOIN accounts a ON a.id = t.from_account_id JOIN users u ON u.id = a.owner_user_id
WHERE t.amount > 100000.00 AND u.kyc_status = 'UNVERIFIED'
""")
def kyc_limit_audit(spark, sf_dir):
    return ledger.kyc_limit_audit(bank.transfers(spark, sf_dir), bank.accounts(spark, sf_dir), bank.users(spark, sf_dir))


# From the transfer service: a request is checked on its own; the transfer that is saved first under a
# key is the one that later requests are held against; a request that fails saves nothing.
REQUESTS_SQL = """
, request AS (SELECT id AS request_id, idempotency_key, from_account_id, to_account_id, amount,
                     created_at AS requested_at, from_account_id AS caller_user_id FROM transfers),
checked AS (
    SELECT q.*, CASE
        WHEN q.idempotency_key IS NULL OR coalesce(q.amount <= 0, TRUE) OR coalesce(q.from_account_id, q.to_account_id) IS NULL
             OR q.from_account_id IS NULL OR q.to_account_id IS NULL THEN 'INVALID_REQUEST'
        WHEN q.from_account_id = q.to_account_id THEN 'SELF_TRANSFER'
        WHEN payer.id IS NULL OR payee.id IS NULL THEN 'ACCOUNT_NOT_FOUND'
        WHEN payer.account_type = 'SYSTEM' THEN 'SYSTEM_FROM'
        WHEN payee.account_type = 'SYSTEM' THEN 'SYSTEM_TO'
        WHEN payer.owner_user_id IS DISTINCT FROM q.caller_user_id OR q.caller_user_id IS NULL THEN 'NOT_OWNER'
        WHEN q.amount > 100000.00 AND owner.kyc_status = 'UNVERIFIED' THEN 'KYC_LIMIT'
        WHEN payer.status <> 'ACTIVE' THEN 'FROM_NOT_ACTIVE'
        WHEN payer.account_type = 'CUSTOMER' AND payer.balance < q.amount THEN 'INSUFFICIENT_FUNDS'
        WHEN payee.status <> 'ACTIVE' THEN 'TO_NOT_ACTIVE' END AS own
    FROM request q LEFT JOIN accounts payer ON payer.id = q.from_account_id
                   LEFT JOIN accounts payee ON payee.id = q.to_account_id
                   LEFT JOIN users owner ON owner.id = payer.owner_user_id),
saved AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY requested_at, request_id) AS nth
          FROM checked WHERE own IS NULL),
held AS (
    SELECT c.*, CASE
        WHEN s.request_id IS NULL OR (c.requested_at, c.request_id) < (s.requested_at, s.request_id) THEN 'REJECTED'
        WHEN c.request_id = s.request_id THEN 'EXECUTED'
        WHEN (c.from_account_id, c.to_account_id, c.amount) = (s.from_account_id, s.to_account_id, s.amount) THEN 'REPLAY'
        ELSE 'CONFLICT' END AS replay_status
    FROM checked c LEFT JOIN saved s ON s.idempotency_key = c.idempotency_key AND s.nth = 1)
"""


@register("replay_classification", REQUESTS_SQL + """
SELECT request_id, idempotency_key, replay_status FROM held
""")
def replay_classification(spark, sf_dir):
    checked = ledger.own_reason(bank.transfer_requests(spark, sf_dir), bank.accounts(spark, sf_dir), bank.users(spark, sf_dir))
    return ledger.replay_classification(checked, accepted=ledger.SAVED).select("request_id", "idempotency_key", "replay_status")


@register("transfer_eligibility", REQUESTS_SQL + """
, answered AS (SELECT *, CASE WHEN own IS DISTINCT FROM 'INVALID_REQUEST' AND replay_status IN ('REPLAY', 'CONFLICT')
                              THEN replay_status ELSE own END AS reason FROM held)
SELECT request_id, idempotency_key, reason,
       CASE reason WHEN 'REPLAY' THEN 'REPLAY' ELSE if(reason IS NULL, 'EXECUTED', 'REJECTED') END AS decision
FROM answered
""")
def transfer_eligibility(spark, sf_dir):
    return ledger.transfer_eligibility(bank.transfer_requests(spark, sf_dir), bank.accounts(spark, sf_dir),
                                       bank.users(spark, sf_dir))


@register("account_statement", """
SELECT a.owner_user_id, l.account_id, l.id, l.transaction_id, l.entry_type, l.amount
FROM ledger_entries l JOIN accounts a ON a.id = l.account_id WHERE a.owner_user_id IS NOT NULL
""")
def account_statement(spark, sf_dir):
    return ledger.account_statement(bank.ledger_entries(spark, sf_dir), bank.accounts(spark, sf_dir))


# ---------------------------------------------------------------- shipped SQL checks (Q7)

@register("duplicate_idempotency_key", """
SELECT idempotency_key, CAST(count(*) AS BIGINT) AS occurrences
FROM transfers GROUP BY idempotency_key HAVING count(*) > 1
""")
def duplicate_idempotency_key(spark, sf_dir):
    return duplicate_keys(bank.transfers(spark, sf_dir), ["idempotency_key"])


@register("orphan_entries", """
, booked AS (SELECT id, account_id FROM ledger_entries
             UNION ALL SELECT -id, account_id + 1000000000 FROM ledger_entries WHERE amount > 400000)
SELECT id, account_id FROM booked WHERE account_id NOT IN (SELECT id FROM accounts)
""")
def orphan_entries(spark, sf_dir):
    """Entries without a source account, over the ledger and over copies of its large entries
    that name accounts nobody has."""
    le = bank.ledger_entries(spark, sf_dir).select("id", "account_id", "amount")
    lost = le.filter(F.col("amount") > 400000).select((-F.col("id")).alias("id"), (F.col("account_id") + 1_000_000_000).alias("account_id"))
    booked = le.select("id", "account_id").unionByName(lost)
    known = bank.accounts(spark, sf_dir).select(F.col("id").alias("_aid"))
    return booked.join(known, booked.account_id == known._aid, "left_anti")


@register("silver_duplicate_account_ids", """
, landed AS (SELECT business_date, id FROM silver_accounts
             UNION ALL SELECT business_date, id FROM silver_accounts WHERE account_type = 'SYSTEM' OR balance > 5000)
SELECT business_date, id, CAST(count(*) AS BIGINT) AS occurrences
FROM landed GROUP BY business_date, id HAVING count(*) > 1
""")
def silver_duplicate_account_ids(spark, sf_dir):
    """Accounts that stand twice on a date: Silver itself has none, so clearing accounts and
    those with large balances are landed a second time."""
    from tally.plans.queries_ledger import _silver

    silver = _silver(spark, sf_dir)["accounts"].clean.select("business_date", "id", "account_type", "balance")
    again = silver.filter((F.col("account_type") == "SYSTEM") | (F.col("balance") > 5000))
    return duplicate_keys(silver.unionByName(again), ["business_date", "id"])


@register("row_count_parity", """
, b AS (SELECT 'accounts' AS table_name, business_date, count(*) AS n FROM bronze_accounts GROUP BY 2
        UNION ALL SELECT 'ledger_entries', business_date, count(*) FROM bronze_ledger_entries GROUP BY 2
        UNION ALL SELECT 'transfers', business_date, count(*) FROM bronze_transfers GROUP BY 2),
s AS (SELECT 'accounts' AS table_name, business_date, count(*) AS n FROM silver_accounts GROUP BY 2
        UNION ALL SELECT 'ledger_entries', business_date, count(*) FROM silver_ledger_entries GROUP BY 2
        UNION ALL SELECT 'transfers', business_date, count(*) FROM silver_transfers GROUP BY 2),
qq AS (SELECT 'accounts' AS table_name, business_date, count(*) AS n FROM accounts_flags f
          WHERE EXISTS (SELECT 1 FROM accounts_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id) GROUP BY 2
        UNION ALL SELECT 'ledger_entries', business_date, count(*) FROM ledger_flags f
          WHERE EXISTS (SELECT 1 FROM ledger_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id) GROUP BY 2
        UNION ALL SELECT 'transfers', business_date, count(*) FROM transfers_flags f
          WHERE EXISTS (SELECT 1 FROM transfers_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id) GROUP BY 2)
SELECT b.table_name, b.business_date, CAST(b.n AS BIGINT) AS bronze_count,
       CAST(coalesce(s.n, 0) AS BIGINT) AS silver_count, CAST(coalesce(qq.n, 0) AS BIGINT) AS quarantine_count,
       CAST(b.n - coalesce(s.n, 0) - coalesce(qq.n, 0) AS BIGINT) AS deduplicated_count,
       b.n = coalesce(s.n, 0) + coalesce(qq.n, 0) AS parity
FROM b LEFT JOIN s ON s.table_name = b.table_name AND s.business_date = b.business_date
       LEFT JOIN qq ON qq.table_name = b.table_name AND qq.business_date = b.business_date
""")
def row_count_parity(spark, sf_dir):
    from tally.operators.audit import parity
    from tally.plans import medallion as M

    s = M.silver_all(M.bronze_tables(spark, sf_dir), share=True)
    return parity({t: s[t].evaluation for t in M.TABLES})
