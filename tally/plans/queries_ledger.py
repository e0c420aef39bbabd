"""Catalogue: Gold, ledger and Silver queries with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import gold, ledger
from tally.operators import rules as R
from tally.operators.dedup import duplicate_keys, latest_per_key
from tally.plans import medallion as M
from tally.plans.registry import ORACLE, QUERIES, register
from tally.sources import bank
from tally.sources.testdata import table


def _silver(spark, sf_dir, share=False):
    return M.silver_all(M.bronze_tables(spark, sf_dir), share)


def _no_meta(df):
    return df.drop("_batch_id", "_ingested_at")


# ---------------------------------------------------------------- Gold (A2-A4)

@register("reconciliation_summary", """
SELECT business_date,
       CAST(coalesce(sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS total_debits,
       CAST(coalesce(sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS total_credits,
       CAST(count(*) AS BIGINT) AS row_count
FROM silver_ledger_entries GROUP BY business_date
""")
def reconciliation_summary(spark, sf_dir):
    return gold.reconciliation_summary(_silver(spark, sf_dir)["ledger_entries"].clean)


@register("daily_transfer_volume", """
SELECT business_date, CAST(count(*) AS BIGINT) AS transfer_count,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,4)) AS total_transfer_amount
FROM silver_transfers GROUP BY business_date
""")
def daily_transfer_volume(spark, sf_dir):
    return gold.daily_transfer_volume(_silver(spark, sf_dir)["transfers"].clean)


@register("account_ledger_summary", """
SELECT business_date, account_id,
       CAST(sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END) AS DECIMAL(38,4)) AS total_debits,
       CAST(sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END) AS DECIMAL(38,4)) AS total_credits,
       CAST(sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END)
            - sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END) AS DECIMAL(38,4)) AS net_movement
FROM silver_ledger_entries GROUP BY business_date, account_id
""")
def account_ledger_summary(spark, sf_dir):
    return gold.account_ledger_summary(_silver(spark, sf_dir)["ledger_entries"].clean)


@register("gold_reconcile", """
, g AS (
    SELECT business_date,
           CAST(coalesce(sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS d,
           CAST(coalesce(sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS c,
           count(*) AS n
    FROM silver_ledger_entries GROUP BY business_date),
s AS (
    SELECT strftime(created_at, '%Y-%m-%d') AS business_date,
           CAST(coalesce(sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS d,
           CAST(coalesce(sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,4)) AS c,
           count(*) AS n
    FROM ledger_entries GROUP BY 1)
SELECT coalesce(s.business_date, g.business_date) AS business_date,
       CAST(coalesce(s.d, 0) AS DECIMAL(38,4)) AS source_total_debits,
       CAST(coalesce(s.c, 0) AS DECIMAL(38,4)) AS source_total_credits,
       CAST(coalesce(g.d, 0) AS DECIMAL(38,4)) AS gold_total_debits,
       CAST(coalesce(g.c, 0) AS DECIMAL(38,4)) AS gold_total_credits,
       CAST(coalesce(s.n, 0) AS BIGINT) AS source_row_count,
       CAST(coalesce(g.n, 0) AS BIGINT) AS gold_row_count,
       CAST(greatest(abs(coalesce(g.d, 0) - coalesce(s.d, 0)), abs(coalesce(g.c, 0) - coalesce(s.c, 0))) AS DECIMAL(38,4)) AS diff_amount,
       greatest(abs(coalesce(g.d, 0) - coalesce(s.d, 0)), abs(coalesce(g.c, 0) - coalesce(s.c, 0))) <= 0.0001 AS within_tolerance,
       coalesce(s.n, 0) = coalesce(g.n, 0) AS row_counts_match,
       coalesce(s.d, 0) = coalesce(s.c, 0) AS globally_balanced
FROM s FULL OUTER JOIN g ON s.business_date = g.business_date
""".replace("\n, g AS", ", g AS", 1))
def gold_reconcile(spark, sf_dir):
    silver_gold = gold.reconciliation_summary(_silver(spark, sf_dir)["ledger_entries"].clean)
    src = M.tag_bronze(bank.ledger_entries(spark, sf_dir), "source")
    return gold.reconcile(silver_gold, gold.reconciliation_summary(src))


# ---------------------------------------------------------------- ledger

@register("ledger_posting", """
SELECT id * 2 AS id, id AS transaction_id, from_account_id AS account_id, 'DEBIT' AS entry_type, amount, created_at
FROM transfers WHERE from_account_id <> to_account_id
UNION ALL
SELECT id * 2 + 1, id, to_account_id, 'CREDIT', amount, created_at
FROM transfers WHERE from_account_id <> to_account_id
""")
def ledger_posting(spark, sf_dir):
    return ledger.post_transfers(bank.transfers(spark, sf_dir))


@register("account_balances", """
SELECT account_id,
       CAST(coalesce(sum(CASE WHEN entry_type = 'CREDIT' THEN amount WHEN entry_type = 'DEBIT' THEN -amount ELSE 0 END), 0)
            AS DECIMAL(38,4)) AS ledger_balance
FROM ledger_entries GROUP BY account_id
""")
def account_balances(spark, sf_dir):
    return ledger.balances(bank.ledger_entries(spark, sf_dir))


@register("unbalanced_transactions", """
, leg AS (SELECT transaction_id, entry_type, count(*) AS n, sum(amount) AS total FROM ledger_entries GROUP BY ALL),
tx AS (SELECT transaction_id, sum(n) AS n FROM leg GROUP BY transaction_id),
sides AS (SELECT tx.transaction_id, tx.n, coalesce(d.n, 0) AS dn, coalesce(c.n, 0) AS cn,
                 coalesce(d.total, 0) AS dt, coalesce(c.total, 0) AS ct
          FROM tx LEFT JOIN leg d ON d.transaction_id = tx.transaction_id AND d.entry_type = 'DEBIT'
                  LEFT JOIN leg c ON c.transaction_id = tx.transaction_id AND c.entry_type = 'CREDIT')
SELECT transaction_id, CAST(dn AS BIGINT) AS debit_count, CAST(cn AS BIGINT) AS credit_count,
       CAST(dt AS DECIMAL(38,4)) AS debit_total, CAST(ct AS DECIMAL(38,4)) AS credit_total
FROM sides WHERE (n, dn, cn, dt - ct) <> (2, 1, 1, 0)
""")
def unbalanced_transactions(spark, sf_dir):
    return ledger.unbalanced_transactions(bank.ledger_entries(spark, sf_dir))


@register("reconciliation_report", """
, legs AS (
    SELECT transaction_id, count(*) AS n,
           count(*) FILTER (WHERE entry_type = 'DEBIT') AS nd,
           count(*) FILTER (WHERE entry_type = 'CREDIT') AS nc,
           sum(CASE WHEN entry_type = 'DEBIT' THEN amount ELSE 0 END) AS d,
           sum(CASE WHEN entry_type = 'CREDIT' THEN amount ELSE 0 END) AS c
    FROM ledger_entries GROUP BY transaction_id)
SELECT CAST(coalesce(sum(d), 0) AS DECIMAL(38,4)) AS total_debits,
       CAST(coalesce(sum(c), 0) AS DECIMAL(38,4)) AS total_credits,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS entry_count,
       CAST(count(*) FILTER (WHERE NOT (n = 2 AND nd = 1 AND nc = 1 AND d = c)) AS BIGINT) AS unbalanced_count,
       coalesce(sum(d), 0) = coalesce(sum(c), 0) AS globally_balanced,
       coalesce(sum(d), 0) = coalesce(sum(c), 0)
         AND count(*) FILTER (WHERE NOT (n = 2 AND nd = 1 AND nc = 1 AND d = c)) = 0 AS is_clean
FROM legs
""".replace("\n, legs AS", ", legs AS", 1))
def reconciliation_report(spark, sf_dir):
    return ledger.reconciliation_report(bank.ledger_entries(spark, sf_dir))


@register("balance_drift", """
, led AS (
    SELECT account_id,
           sum(CASE WHEN entry_type = 'CREDIT' THEN amount WHEN entry_type = 'DEBIT' THEN -amount ELSE 0 END) AS lb
    FROM ledger_entries GROUP BY account_id),
j AS (
    SELECT coalesce(a.id, led.account_id) AS account_id,
           CAST(coalesce(a.balance, 0) AS DECIMAL(38,4)) AS stored_balance,
           CAST(coalesce(led.lb, 0) AS DECIMAL(38,4)) AS ledger_balance,
           a.id IS NULL AS unknown_account
    FROM accounts a FULL OUTER JOIN led ON a.id = led.account_id)
SELECT account_id, stored_balance, ledger_balance,
       CAST(stored_balance - ledger_balance AS DECIMAL(38,4)) AS drift, unknown_account
FROM j WHERE stored_balance - ledger_balance <> 0
""".replace("\n, led AS", ", led AS", 1))
def balance_drift(spark, sf_dir):
    return ledger.balance_drift(bank.accounts(spark, sf_dir), bank.ledger_entries(spark, sf_dir))


@register("running_balance", """
SELECT l.id, l.account_id, l.created_at,
       CAST(CASE WHEN entry_type = 'CREDIT' THEN amount WHEN entry_type = 'DEBIT' THEN -amount ELSE 0 END AS DECIMAL(38,4)) AS delta,
       CAST(coalesce(a.balance, 0) + sum(CASE WHEN entry_type = 'CREDIT' THEN amount WHEN entry_type = 'DEBIT' THEN -amount ELSE 0 END)
            OVER (PARTITION BY l.account_id ORDER BY l.created_at, l.id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,4)) AS running_balance,
       coalesce(a.account_type = 'CUSTOMER', false) AND
       (coalesce(a.balance, 0) + sum(CASE WHEN entry_type = 'CREDIT' THEN amount WHEN entry_type = 'DEBIT' THEN -amount ELSE 0 END)
            OVER (PARTITION BY l.account_id ORDER BY l.created_at, l.id ROWS UNBOUNDED PRECEDING)) < 0 AS overdraft
FROM ledger_entries l LEFT JOIN accounts a ON a.id = l.account_id
""")
def running_balance(spark, sf_dir):
    out = ledger.running_balance(bank.ledger_entries(spark, sf_dir), bank.accounts(spark, sf_dir))
    return out.withColumn("overdraft", F.coalesce(F.col("overdraft"), F.lit(False)))


# ---------------------------------------------------------------- Silver

_SILVER_COLS = {
    "accounts": "id, account_number, owner_name, status, currency, balance, created_at, updated_at, account_type, owner_user_id, business_date",
    "ledger_entries": "id, transaction_id, account_id, entry_type, amount, created_at, business_date",
    "transfers": "id, idempotency_key, from_account_id, to_account_id, amount, created_at, business_date",
}


@register("silver_accounts", f"SELECT {_SILVER_COLS['accounts']} FROM silver_accounts")
def silver_accounts(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["accounts"].clean)


@register("silver_ledger", f"SELECT {_SILVER_COLS['ledger_entries']} FROM silver_ledger_entries")
def silver_ledger(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["ledger_entries"].clean)


@register("silver_transfers", f"SELECT {_SILVER_COLS['transfers']} FROM silver_transfers")
def silver_transfers(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["transfers"].clean)


@register("silver_accounts_quarantine", f"""
SELECT {_SILVER_COLS['accounts']},
       list_filter([CASE WHEN f_not_null_id THEN 'not_null:id' END,
                    CASE WHEN f_not_null_account_number THEN 'not_null:account_number' END,
                    CASE WHEN f_unique_account_number THEN 'unique:account_number' END,
                    CASE WHEN f_isin_status THEN 'isin:status' END,
                    CASE WHEN f_non_negative_balance THEN 'non_negative:balance' END], lambda x: x IS NOT NULL) AS failed_rules
FROM accounts_flags f
WHERE EXISTS (SELECT 1 FROM accounts_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
""")
def silver_accounts_quarantine(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["accounts"].quarantined)


@register("silver_ledger_quarantine", f"""
SELECT {_SILVER_COLS['ledger_entries']},
       list_filter([CASE WHEN f_not_null_account_id THEN 'not_null:account_id' END,
                    CASE WHEN f_isin_entry_type THEN 'isin:entry_type' END,
                    CASE WHEN f_positive_amount THEN 'positive:amount' END,
                    CASE WHEN f_ri_account_id THEN 'referential_integrity:account_id->id' END], lambda x: x IS NOT NULL) AS failed_rules
FROM ledger_flags f
WHERE EXISTS (SELECT 1 FROM ledger_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
""")
def silver_ledger_quarantine(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["ledger_entries"].quarantined)


@register("silver_transfers_quarantine", f"""
SELECT {_SILVER_COLS['transfers']},
       list_filter([CASE WHEN f_not_null_from THEN 'not_null:from_account_id' END,
                    CASE WHEN f_not_null_to THEN 'not_null:to_account_id' END,
                    CASE WHEN f_positive_amount THEN 'positive:amount' END,
                    CASE WHEN f_ri_from THEN 'referential_integrity:from_account_id->id' END,
                    CASE WHEN f_ri_to THEN 'referential_integrity:to_account_id->id' END], lambda x: x IS NOT NULL) AS failed_rules
FROM transfers_flags f
WHERE EXISTS (SELECT 1 FROM transfers_failing_ids q WHERE q.id IS NOT DISTINCT FROM f.id)
""")
def silver_transfers_quarantine(spark, sf_dir):
    return _no_meta(_silver(spark, sf_dir)["transfers"].quarantined)


@register("dq_results", """
SELECT 'accounts' AS table_name, rule_name, 'critical' AS severity, CAST(rows_checked AS BIGINT) AS rows_checked,
       CAST(rows_failed AS BIGINT) AS rows_failed, rows_failed = 0 AS passed
FROM (SELECT count(*) AS rows_checked,
             count(*) FILTER (WHERE f_not_null_id) AS "not_null:id",
             count(*) FILTER (WHERE f_not_null_account_number) AS "not_null:account_number",
             count(*) FILTER (WHERE f_unique_account_number) AS "unique:account_number",
             count(*) FILTER (WHERE f_isin_status) AS "isin:status",
             count(*) FILTER (WHERE f_non_negative_balance) AS "non_negative:balance"
      FROM accounts_flags)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:id", "not_null:account_number", "unique:account_number",
                                        "isin:status", "non_negative:balance"))
UNION ALL
SELECT 'ledger_entries', rule_name, 'critical', CAST(rows_checked AS BIGINT), CAST(rows_failed AS BIGINT), rows_failed = 0
FROM (SELECT count(*) AS rows_checked,
             count(*) FILTER (WHERE f_not_null_account_id) AS "not_null:account_id",
             count(*) FILTER (WHERE f_isin_entry_type) AS "isin:entry_type",
             count(*) FILTER (WHERE f_positive_amount) AS "positive:amount",
             count(*) FILTER (WHERE f_ri_account_id) AS "referential_integrity:account_id->id"
      FROM ledger_flags)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:account_id", "isin:entry_type", "positive:amount",
                                        "referential_integrity:account_id->id"))
UNION ALL
SELECT 'transfers', rule_name, 'critical', CAST(rows_checked AS BIGINT), CAST(rows_failed AS BIGINT), rows_failed = 0
FROM (SELECT count(*) AS rows_checked,
             count(*) FILTER (WHERE f_not_null_from) AS "not_null:from_account_id",
             count(*) FILTER (WHERE f_not_null_to) AS "not_null:to_account_id",
             count(*) FILTER (WHERE f_positive_amount) AS "positive:amount",
             count(*) FILTER (WHERE f_ri_from) AS "referential_integrity:from_account_id->id",
             count(*) FILTER (WHERE f_ri_to) AS "referential_integrity:to_account_id->id"
      FROM transfers_flags)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:from_account_id", "not_null:to_account_id", "positive:amount",
                                        "referential_integrity:from_account_id->id",
                                        "referential_integrity:to_account_id->id"))
""")
def dq_results(spark, sf_dir):
    s = _silver(spark, sf_dir, share=True)
    out = None
    for t in M.TABLES:
        c = s[t].counts().withColumn("table_name", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out.select("table_name", "rule_name", "severity", "rows_checked", "rows_failed", "passed")


_GATE_SQL = """
SELECT 'accounts' AS table_name, 'gx:expect_column_values_to_not_be_null:id' AS rule_name,
       CAST((SELECT count(*) FROM sa) AS BIGINT) AS rows_checked,
       CAST((SELECT count(*) FROM sa WHERE id IS NULL) AS BIGINT) AS rows_failed
UNION ALL SELECT 'accounts', 'gx:expect_column_values_to_be_unique:account_number', (SELECT count(*) FROM sa),
       (SELECT count(*) FROM sa WHERE account_number IN
           (SELECT account_number FROM sa WHERE account_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'accounts', 'gx:expect_column_values_to_be_in_set:status', (SELECT count(*) FROM sa),
       (SELECT count(*) FROM sa WHERE NOT status IN ('OPEN', 'ACTIVE', 'FROZEN', 'CLOSED'))
UNION ALL SELECT 'accounts', 'gx:expect_column_values_to_be_between:balance', (SELECT count(*) FROM sa),
       (SELECT count(*) FROM sa WHERE account_type <> 'SYSTEM' AND NOT (balance >= 0))
UNION ALL SELECT 'ledger_entries', 'gx:expect_column_values_to_be_unique:id', (SELECT count(*) FROM sl),
       (SELECT count(*) FROM sl WHERE id IN (SELECT id FROM sl WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'ledger_entries', 'gx:expect_column_values_to_not_be_null:account_id', (SELECT count(*) FROM sl),
       (SELECT count(*) FROM sl WHERE account_id IS NULL)
UNION ALL SELECT 'ledger_entries', 'gx:expect_column_values_to_be_in_set:entry_type', (SELECT count(*) FROM sl),
       (SELECT count(*) FROM sl WHERE NOT entry_type IN ('DEBIT', 'CREDIT'))
UNION ALL SELECT 'ledger_entries', 'gx:expect_column_values_to_be_between:amount', (SELECT count(*) FROM sl),
       (SELECT count(*) FROM sl WHERE NOT (amount > 0))
"""


@register("gate_results", ", sa AS (SELECT * FROM silver_accounts), sl AS (SELECT * FROM silver_ledger_entries)" + _GATE_SQL)
def gate_results(spark, sf_dir):
    s = _silver(spark, sf_dir)
    return _gate({t: s[t].clean for t in ("accounts", "ledger_entries")})


def _gate(frames):
    from tally.operators.rules import gate_counts

    out = None
    for t, df in frames.items():
        c = gate_counts(df, M.gate_rules(t)).withColumn("table_name", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out.select("table_name", "rule_name", "rows_checked", "rows_failed")


@register("gate_failures", """
, sa AS (SELECT id, account_number, status, account_type, balance FROM silver_accounts
         UNION ALL SELECT CASE WHEN id % 5 <> 0 THEN id END, account_number, CASE WHEN id % 3 = 0 THEN 'LOST' ELSE status END,
                          account_type, -balance - 1 FROM silver_accounts WHERE id % 2 = 0),
sl AS (SELECT id, account_id, entry_type, amount FROM silver_ledger_entries
       UNION ALL SELECT id, CASE WHEN id % 4 <> 0 THEN account_id END, CASE WHEN id % 7 = 0 THEN 'REFUND' ELSE entry_type END,
                        CASE WHEN id % 6 = 0 THEN amount - amount ELSE amount END FROM silver_ledger_entries WHERE amount > 200000)
""".rstrip() + _GATE_SQL)
def gate_failures(spark, sf_dir):
    """The gate over Silver output that was damaged afterwards: copies of half the accounts and of large
    entries with lost ids, unknown states and amounts that are not positive."""
    s = _silver(spark, sf_dir)
    acc = s["accounts"].clean.select("id", "account_number", "status", "account_type", "balance")
    led = s["ledger_entries"].clean.select("id", "account_id", "entry_type", "amount")
    pick = lambda column, n, other: F.when(F.col("id") % n == 0, other).otherwise(F.col(column))
    lost = acc.filter("id % 2 = 0").select(
        pick("id", 5, F.lit(None)).alias("id"), "account_number", pick("status", 3, F.lit("LOST")).alias("status"), "account_type",
        (-F.col("balance") - 1).cast(acc.schema["balance"].dataType).alias("balance"))
    bad = led.filter("amount > 200000").select(
        "id", pick("account_id", 4, F.lit(None)).alias("account_id"), pick("entry_type", 7, F.lit("REFUND")).alias("entry_type"),
        pick("amount", 6, F.col("amount") - F.col("amount")).cast(led.schema["amount"].dataType).alias("amount"))
    return _gate({"accounts": acc.unionByName(lost), "ledger_entries": led.unionByName(bad)})


@register("dedup_latest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                                            l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                                            l_linestatus DESC) AS rn
      FROM lineitem)
WHERE rn = 1
""")
def dedup_latest(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return latest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@register("duplicate_line_keys", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS occurrences
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_line_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return duplicate_keys(li, ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- deposits, account numbers, calendar

CLEARING_ACCOUNT = bank.SYSTEM_ID_OFFSET  # supplier 0 acts as the clearing account


@register("deposit_posting", f"""
SELECT id * 2 AS id, id AS transaction_id, account_id, entry_type, amount, created_at FROM (
    SELECT c_custkey AS id, {CLEARING_ACCOUNT} AS account_id, 'DEBIT' AS entry_type,
           CAST(c_acctbal AS DECIMAL(19,4)) AS amount, TIMESTAMP '1994-12-31 00:00:00' AS created_at
    FROM customer WHERE c_acctbal > 0)
UNION ALL
SELECT c_custkey * 2 + 1, c_custkey, c_custkey, 'CREDIT', CAST(c_acctbal AS DECIMAL(19,4)),
       TIMESTAMP '1994-12-31 00:00:00'
FROM customer WHERE c_acctbal > 0
""")
def deposit_posting(spark, sf_dir):
    """Opening deposits: every customer with a positive balance is funded from the clearing account."""
    acc = bank.accounts(spark, sf_dir).filter((F.col("account_type") == "CUSTOMER") & (F.col("balance") > 0))
    deposits = acc.select("id", F.col("id").alias("to_account_id"), F.col("balance").alias("amount"), "created_at")
    return ledger.post_deposits(deposits, CLEARING_ACCOUNT)


@register("account_numbers_from_keys", """
SELECT c_custkey AS id, 'ACC-' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS account_number
FROM customer
""")
def account_numbers_from_keys(spark, sf_dir):
    from tally.functions.text import account_number_from_key

    c = table(spark, sf_dir, "customer", "c_custkey")
    return c.select(F.col("c_custkey").alias("id"), account_number_from_key(F.col("c_custkey")).alias("account_number"))


@register("business_calendar", """
SELECT d AS business_date, isodow(CAST(d AS DATE)) <= 5 AS is_weekday,
       strftime(CAST(d AS DATE) - CAST(CASE isodow(CAST(d AS DATE)) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INTEGER),
                '%Y-%m-%d') AS previous_weekday
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
""")
def business_calendar(spark, sf_dir):
    from tally.functions.dates import is_weekday, previous_weekday

    d = table(spark, sf_dir, "orders", "o_orderdate").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("business_date")).distinct()
    day = F.col("business_date").cast("date")
    return d.select("business_date", is_weekday(day).alias("is_weekday"),
                    F.date_format(previous_weekday(day), "yyyy-MM-dd").alias("previous_weekday"))


# ---------------------------------------------------------------- single rules: the failing rows

def _failing(df, rule, id_col="id"):
    from tally.operators import rules as R

    ev = R.evaluate(df, [rule], id_column=id_col)
    return ev.flagged.filter(F.col(ev.flag_columns[0])).select(*df.columns)


@register("rule_not_null", """
SELECT id, owner_user_id FROM accounts WHERE owner_user_id IS NULL
""")
def rule_not_null(spark, sf_dir):
    from tally.operators import rules as R

    acc = bank.accounts(spark, sf_dir).select("id", "owner_user_id")
    return _failing(acc, R.not_null("owner_user_id"))


@register("rule_positive", """
SELECT id, balance FROM accounts WHERE NOT (balance > 0)
""")
def rule_positive(spark, sf_dir):
    from tally.operators import rules as R

    return _failing(bank.accounts(spark, sf_dir).select("id", "balance"), R.positive("balance"))


@register("rule_non_negative_unless", """
SELECT id, balance, account_type FROM accounts WHERE balance < 0 AND NOT (account_type = 'SYSTEM')
""")
def rule_non_negative_unless(spark, sf_dir):
    from tally.operators import rules as R

    acc = bank.accounts(spark, sf_dir).select("id", "balance", "account_type")
    return _failing(acc, R.non_negative("balance", unless=F.col("account_type") == "SYSTEM"))


@register("rule_isin", """
SELECT id, o_orderpriority AS priority FROM (SELECT o_orderkey AS id, o_orderpriority FROM orders)
WHERE NOT (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
""")
def rule_isin(spark, sf_dir):
    from tally.operators import rules as R

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return _failing(o, R.isin("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]))


@register("rule_unique", """
SELECT id, idempotency_key FROM transfers
WHERE idempotency_key IN (SELECT idempotency_key FROM transfers WHERE idempotency_key IS NOT NULL
                          GROUP BY idempotency_key HAVING count(*) > 1)
""")
def rule_unique(spark, sf_dir):
    from tally.operators import rules as R

    return _failing(bank.transfers(spark, sf_dir).select("id", "idempotency_key"), R.unique("idempotency_key"))


@register("rule_referential_integrity", """
SELECT l.id, l.account_id FROM ledger_entries l
WHERE NOT EXISTS (SELECT 1 FROM silver_accounts s WHERE s.id = l.account_id)
""")
def rule_referential_integrity(spark, sf_dir):
    from tally.operators import rules as R

    acc = _silver(spark, sf_dir)["accounts"].clean
    le = bank.ledger_entries(spark, sf_dir).select("id", "account_id")
    return _failing(le, R.referential_integrity("account_id", acc, "id"))


@register("account_summary", """
SELECT id, account_number, status, currency, balance, account_type FROM accounts
""")
def account_summary(spark, sf_dir):
    return ledger.account_summary(bank.accounts(spark, sf_dir))


@register("rule_result_counts", f"""
SELECT table_name, CAST(count(*) AS BIGINT) AS rules, CAST(sum(CAST(NOT passed AS INTEGER)) AS BIGINT) AS rules_failed,
       CAST(sum(rows_failed) AS BIGINT) AS rows_failed
FROM ({ORACLE["dq_results"]}) GROUP BY table_name
""", prelude=False)
def rule_result_counts(spark, sf_dir):
    """Per table, how many rule results were recorded and how many of them failed."""
    return QUERIES["dq_results"](spark, sf_dir).groupBy("table_name").agg(
        F.count("*").alias("rules"), F.count_if(~F.col("passed")).alias("rules_failed"), F.sum("rows_failed").alias("rows_failed"))


@register("transfer_constraints", """
, t AS (SELECT * FROM transfers UNION ALL
        SELECT o_orderkey, NULL, o_custkey, o_custkey, CAST(-o_totalprice AS DECIMAL(19,4)), CAST(o_orderdate AS TIMESTAMP)
        FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT rule_name, CAST(count(*) AS BIGINT) AS rows_checked, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS rows_failed
FROM (SELECT unnest([
    {'rule_name': 'not_null:id', 'failed': id IS NULL},
    {'rule_name': 'not_null:idempotency_key', 'failed': idempotency_key IS NULL},
    {'rule_name': 'distinct_accounts', 'failed': coalesce(from_account_id = to_account_id, FALSE)},
    {'rule_name': 'positive:amount', 'failed': coalesce(NOT amount > 0, FALSE)}], recursive := true) FROM t)
GROUP BY rule_name
""")
def transfer_constraints(spark, sf_dir):
    """What the source's transfer table forbids, over the transfers and over corrupted rows that
    urgent orders give (no key, the same account twice, a negative amount)."""
    t = bank.transfers(spark, sf_dir)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    bad = o.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("idempotency_key"), F.col("o_custkey").alias("from_account_id"),
        F.col("o_custkey").alias("to_account_id"), (-F.col("o_totalprice")).cast("decimal(19,4)").alias("amount"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    both = t.select(*bad.columns).unionByName(bad)
    evaluated = R.evaluate(both, [R.not_null("id"), R.not_null("idempotency_key"), R.distinct_columns("from_account_id", "to_account_id"),
                                  R.positive("amount")], id_column="id")
    return evaluated.counts().select("rule_name", "rows_checked", "rows_failed")
