"""The bank-table mapping of ``tally.sources.bank`` written as DuckDB SQL.

Used only by the correctness oracle: every oracle query is ``PRELUDE`` + its
own ``SELECT``, run by DuckDB over the same parquet files.
"""

PRELUDE = r"""
WITH
n_cust AS (SELECT count(*) AS n FROM customer),
accounts AS (
    SELECT c_custkey AS id,
           'ACC-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_number,
           c_name AS owner_name,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ACTIVE' WHEN 'BUILDING' THEN 'ACTIVE'
                WHEN 'MACHINERY' THEN 'ACTIVE' WHEN 'FURNITURE' THEN 'FROZEN'
                WHEN 'HOUSEHOLD' THEN 'OPEN' ELSE c_mktsegment END AS status,
           'JPY' AS currency,
           CAST(c_acctbal AS DECIMAL(19,4)) AS balance,
           TIMESTAMP '1994-12-31 00:00:00' AS created_at,
           TIMESTAMP '1994-12-31 00:00:00' AS updated_at,
           'CUSTOMER' AS account_type,
           c_custkey AS owner_user_id
    FROM customer
    UNION ALL
    SELECT s_suppkey + 1000000, 'SYS-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), s_name, 'ACTIVE', 'JPY',
           CAST(s_acctbal AS DECIMAL(19,4)), TIMESTAMP '1994-12-31 00:00:00', TIMESTAMP '1994-12-31 00:00:00',
           'SYSTEM', CAST(NULL AS BIGINT)
    FROM supplier
),
users AS (
    SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) AS username, 'CUSTOMER' AS role,
           CASE n_regionkey WHEN 0 THEN 'UNVERIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'VERIFIED'
                WHEN 3 THEN 'VERIFIED' WHEN 4 THEN 'REJECTED' ELSE 'UNVERIFIED' END AS kyc_status
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
transfers AS (
    SELECT o_orderkey AS id,
           'k' || CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m%d') AS idempotency_key,
           o_custkey AS from_account_id,
           (o_custkey + 1 + (o_orderkey % 7)) % (SELECT n FROM n_cust) AS to_account_id,
           CAST(o_totalprice AS DECIMAL(19,4)) AS amount,
           o_orderdate AS created_at
    FROM orders
),
ledger_entries AS (
    SELECT t.id * 2 AS id, t.id AS transaction_id, t.from_account_id AS account_id, 'DEBIT' AS entry_type,
           t.amount AS amount, t.created_at AS created_at
    FROM transfers t
    UNION ALL
    SELECT t.id * 2 + 1, t.id, t.to_account_id, 'CREDIT',
           CASE WHEN o.o_orderpriority = '1-URGENT' THEN CAST(floor(t.amount) AS DECIMAL(19,4)) ELSE t.amount END,
           t.created_at
    FROM transfers t JOIN orders o ON o.o_orderkey = t.id
    WHERE o.o_orderstatus <> 'P'
),
bronze_accounts AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS business_date FROM accounts),
bronze_ledger_entries AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS business_date FROM ledger_entries),
bronze_transfers AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS business_date FROM transfers),
accounts_flags AS (
    SELECT a.*,
           a.id IS NULL AS f_not_null_id,
           a.account_number IS NULL AS f_not_null_account_number,
           a.account_number IN (SELECT account_number FROM bronze_accounts WHERE account_number IS NOT NULL
                                GROUP BY account_number HAVING count(*) > 1) AS f_unique_account_number,
           coalesce(NOT (a.status IN ('OPEN', 'ACTIVE', 'FROZEN', 'CLOSED')), false) AS f_isin_status,
           coalesce(a.balance < 0 AND NOT (a.account_type = 'SYSTEM'), false) AS f_non_negative_balance
    FROM bronze_accounts a
),
accounts_failing_ids AS (
    SELECT DISTINCT id FROM accounts_flags
    WHERE f_not_null_id OR f_not_null_account_number OR f_unique_account_number OR f_isin_status OR f_non_negative_balance
),
silver_accounts AS (
    SELECT * EXCLUDE (f_not_null_id, f_not_null_account_number, f_unique_account_number, f_isin_status,
                      f_non_negative_balance)
    FROM accounts_flags f
    WHERE NOT EXISTS (SELECT 1 FROM accounts_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
),
ledger_flags AS (
    SELECT l.*,
           l.account_id IS NULL AS f_not_null_account_id,
           coalesce(NOT (l.entry_type IN ('DEBIT', 'CREDIT')), false) AS f_isin_entry_type,
           coalesce(NOT (l.amount > 0), false) AS f_positive_amount,
           NOT EXISTS (SELECT 1 FROM silver_accounts s WHERE s.id = l.account_id) AS f_ri_account_id
    FROM bronze_ledger_entries l
),
ledger_failing_ids AS (
    SELECT DISTINCT id FROM ledger_flags
    WHERE f_not_null_account_id OR f_isin_entry_type OR f_positive_amount OR f_ri_account_id
),
silver_ledger_entries AS (
    SELECT * EXCLUDE (f_not_null_account_id, f_isin_entry_type, f_positive_amount, f_ri_account_id)
    FROM ledger_flags f
    WHERE NOT EXISTS (SELECT 1 FROM ledger_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
),
transfers_flags AS (
    SELECT t.*,
           t.from_account_id IS NULL AS f_not_null_from,
           t.to_account_id IS NULL AS f_not_null_to,
           coalesce(NOT (t.amount > 0), false) AS f_positive_amount,
           NOT EXISTS (SELECT 1 FROM silver_accounts s WHERE s.id = t.from_account_id) AS f_ri_from,
           NOT EXISTS (SELECT 1 FROM silver_accounts s WHERE s.id = t.to_account_id) AS f_ri_to
    FROM bronze_transfers t
),
transfers_failing_ids AS (
    SELECT DISTINCT id FROM transfers_flags
    WHERE f_not_null_from OR f_not_null_to OR f_positive_amount OR f_ri_from OR f_ri_to
),
batch_events AS (
    SELECT 'b-' || CAST(event_id AS VARCHAR) AS batch_id,
           'run-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS dag_run_id,
           (['contract', 'bronze', 'bronze', 'bronze', 'silver', 'silver', 'silver', 'dq_gx', 'gold',
             'reconcile', 'dq_checks'])[(CAST(json_extract_string(props, '$.k') AS INTEGER) % 11) + 1] AS layer,
           (['source', 'accounts', 'ledger_entries', 'transfers', 'accounts', 'ledger_entries', 'transfers',
             'silver', 'gold_aggregate', 'ledger_entries', 'sql_checks'])
             [(CAST(json_extract_string(props, '$.k') AS INTEGER) % 11) + 1] AS source_table,
           strftime(ts, '%Y-%m-%d') AS business_date,
           CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'SUCCESS' WHEN 'signup' THEN 'SUCCESS'
                WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'FAILED' END AS status,
           ts AS started_at,
           CAST(floor(value) AS BIGINT) AS rows_read,
           CASE WHEN value >= 1 THEN CAST(floor(value) AS BIGINT) END AS rows_written
    FROM events
),
silver_transfers AS (
    SELECT * EXCLUDE (f_not_null_from, f_not_null_to, f_positive_amount, f_ri_from, f_ri_to)
    FROM transfers_flags f
    WHERE NOT EXISTS (SELECT 1 FROM transfers_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
)
"""


def q(body: str) -> str:
    return PRELUDE + body
