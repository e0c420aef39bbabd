"""Catalogue: audit-trail questions over the batch event log, and Silver rule results per date."""
from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import audit, ledger
from tally.plans import medallion as M
from tally.plans import queries_aml
from tally.plans.registry import register
from tally.sources import bank


@register("slot_decision", """
, req AS (SELECT DISTINCT layer, source_table, business_date, dag_run_id FROM batch_events
          UNION SELECT DISTINCT layer, source_table, business_date, 'manual-rerun' FROM batch_events),
latest AS (SELECT layer, source_table, business_date, status AS latest_status, dag_run_id AS latest_run
           FROM batch_events WHERE status IN ('RUNNING', 'SUCCESS', 'RECOVERED')
           QUALIFY row_number() OVER (PARTITION BY layer, source_table, business_date
                                      ORDER BY started_at DESC, batch_id DESC) = 1)
SELECT req.layer, req.source_table, req.business_date, req.dag_run_id, latest.latest_status,
       CASE WHEN latest.latest_status IS NULL THEN 'PROCEED'
            WHEN latest.latest_run <> req.dag_run_id THEN 'REFUSE'
            WHEN latest.latest_status IN ('SUCCESS', 'RECOVERED') THEN 'SKIP'
            ELSE 'REFUSE' END AS decision
FROM req LEFT JOIN latest USING (layer, source_table, business_date)
""".replace("\n, req AS", ", req AS", 1))
def slot_decision(spark, sf_dir):
    ev = bank.batch_events(spark, sf_dir)
    req = ev.select(*audit.SLOT, "dag_run_id").unionByName(
        ev.select(*audit.SLOT, F.lit("manual-rerun").alias("dag_run_id"))).distinct()
    return audit.slot_decision(req, ev)


@register("latest_clean_run", """
SELECT dag_run_id, business_date, max(started_at) AS last_started_at
FROM batch_events GROUP BY dag_run_id, business_date
HAVING bool_and(status = 'SUCCESS') AND bool_or(layer = 'reconcile')
ORDER BY max(started_at) DESC, dag_run_id DESC LIMIT 1
""")
def latest_clean_run(spark, sf_dir):
    return audit.latest_clean_run(bank.batch_events(spark, sf_dir))


@register("audit_completeness", """
, slots AS (SELECT * FROM (VALUES ('contract', 'source'), ('bronze', 'accounts'), ('bronze', 'ledger_entries'),
        ('bronze', 'transfers'), ('silver', 'accounts'), ('silver', 'ledger_entries'), ('silver', 'transfers'),
        ('dq_gx', 'silver'), ('gold', 'gold_aggregate'), ('reconcile', 'ledger_entries'),
        ('dq_checks', 'sql_checks')) v(layer, source_table)),
runs AS (SELECT DISTINCT dag_run_id FROM batch_events),
missing AS (SELECT r.dag_run_id, count(*) AS n FROM runs r, slots s
            WHERE NOT EXISTS (SELECT 1 FROM batch_events e WHERE e.dag_run_id = r.dag_run_id
                              AND e.layer = s.layer AND e.source_table = s.source_table)
            GROUP BY r.dag_run_id),
per_run AS (SELECT dag_run_id, count(*) FILTER (WHERE status <> 'SUCCESS') AS nse,
                   count(*) FILTER (WHERE status = 'SUCCESS' AND (rows_read IS NULL OR rows_written IS NULL)) AS swc,
                   count(DISTINCT business_date) AS bd
            FROM batch_events GROUP BY dag_run_id)
SELECT p.dag_run_id, CAST(coalesce(m.n, 0) AS BIGINT) AS missing_slots, CAST(nse AS BIGINT) AS non_success_events,
       CAST(swc AS BIGINT) AS success_without_counts, CAST(bd AS BIGINT) AS business_dates,
       coalesce(m.n, 0) = 0 AND nse = 0 AND swc = 0 AND bd = 1 AS complete
FROM per_run p LEFT JOIN missing m ON m.dag_run_id = p.dag_run_id
""".replace("\n, slots AS", ", slots AS", 1))
def audit_completeness(spark, sf_dir):
    return audit.audit_completeness(bank.batch_events(spark, sf_dir))


@register("backfill_plan", """
, slots AS (SELECT * FROM (VALUES ('contract', 'source'), ('bronze', 'accounts'), ('bronze', 'ledger_entries'),
        ('bronze', 'transfers'), ('silver', 'accounts'), ('silver', 'ledger_entries'), ('silver', 'transfers'),
        ('dq_gx', 'silver'), ('gold', 'gold_aggregate'), ('reconcile', 'ledger_entries'),
        ('dq_checks', 'sql_checks')) v(layer, source_table)),
done AS (SELECT business_date FROM (SELECT DISTINCT business_date, layer, source_table FROM batch_events
                                     WHERE status = 'SUCCESS') e
         JOIN slots USING (layer, source_table) GROUP BY business_date HAVING count(*) = 11),
days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(
            (SELECT CAST(min(started_at) AS DATE) - INTERVAL 3 DAY FROM batch_events),
            (SELECT CAST(max(started_at) AS DATE) + INTERVAL 3 DAY FROM batch_events), INTERVAL 1 DAY) t(d))
SELECT strftime(d, '%Y-%m-%d') AS business_date FROM days
WHERE isodow(d) <= 5 AND strftime(d, '%Y-%m-%d') NOT IN (SELECT business_date FROM done)
""".replace("\n, slots AS", ", slots AS", 1))
def backfill_plan(spark, sf_dir):
    ev = bank.batch_events(spark, sf_dir)
    start = F.date_sub(ev.agg(F.min("started_at").cast("date")).scalar(), 3)
    end = F.date_add(ev.agg(F.max("started_at").cast("date")).scalar(), 3)
    return audit.backfill_plan(ev, start, end)


@register("critical_failures", """
SELECT 'accounts' AS table_name, business_date, rule_name, CAST(rows_failed AS BIGINT) AS rows_failed
FROM (SELECT business_date,
             count(*) FILTER (WHERE f_not_null_id) AS "not_null:id",
             count(*) FILTER (WHERE f_not_null_account_number) AS "not_null:account_number",
             count(*) FILTER (WHERE f_unique_account_number) AS "unique:account_number",
             count(*) FILTER (WHERE f_isin_status) AS "isin:status",
             count(*) FILTER (WHERE f_non_negative_balance) AS "non_negative:balance"
      FROM accounts_flags GROUP BY business_date)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:id", "not_null:account_number", "unique:account_number",
                                        "isin:status", "non_negative:balance"))
WHERE rows_failed > 0
UNION ALL
SELECT 'ledger_entries', business_date, rule_name, CAST(rows_failed AS BIGINT)
FROM (SELECT business_date,
             count(*) FILTER (WHERE f_not_null_account_id) AS "not_null:account_id",
             count(*) FILTER (WHERE f_isin_entry_type) AS "isin:entry_type",
             count(*) FILTER (WHERE f_positive_amount) AS "positive:amount",
             count(*) FILTER (WHERE f_ri_account_id) AS "referential_integrity:account_id->id"
      FROM ledger_flags GROUP BY business_date)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:account_id", "isin:entry_type", "positive:amount",
                                        "referential_integrity:account_id->id"))
WHERE rows_failed > 0
UNION ALL
SELECT 'transfers', business_date, rule_name, CAST(rows_failed AS BIGINT)
FROM (SELECT business_date,
             count(*) FILTER (WHERE f_not_null_from) AS "not_null:from_account_id",
             count(*) FILTER (WHERE f_not_null_to) AS "not_null:to_account_id",
             count(*) FILTER (WHERE f_positive_amount) AS "positive:amount",
             count(*) FILTER (WHERE f_ri_from) AS "referential_integrity:from_account_id->id",
             count(*) FILTER (WHERE f_ri_to) AS "referential_integrity:to_account_id->id"
      FROM transfers_flags GROUP BY business_date)
UNPIVOT (rows_failed FOR rule_name IN ("not_null:from_account_id", "not_null:to_account_id", "positive:amount",
                                        "referential_integrity:from_account_id->id",
                                        "referential_integrity:to_account_id->id"))
WHERE rows_failed > 0
""")
def critical_failures(spark, sf_dir):
    return audit.critical_failures(_daily_counts(spark, sf_dir)[0]).select("table_name", "business_date", "rule_name", "rows_failed")


def _daily_counts(spark, sf_dir):
    """Results of all rules per table and date, and the Silver results that they come from."""
    from tally.plans.queries_ledger import _silver

    s = _silver(spark, sf_dir, share=True)
    out = None
    for t in M.TABLES:
        c = s[t].evaluation.counts(by=["business_date"]).withColumn("table_name", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out, s


@register("rules_that_ran", """
, declared AS (SELECT * FROM (VALUES
    ('accounts', ['not_null:id', 'not_null:account_number', 'unique:account_number', 'isin:status', 'non_negative:balance']),
    ('ledger_entries', ['not_null:account_id', 'isin:entry_type', 'positive:amount', 'referential_integrity:account_id->id']),
    ('transfers', ['not_null:from_account_id', 'not_null:to_account_id', 'positive:amount',
                   'referential_integrity:from_account_id->id', 'referential_integrity:to_account_id->id'])) AS v(table_name, rules)),
days AS (SELECT 'accounts' AS table_name, count(DISTINCT business_date) AS n FROM bronze_accounts
         UNION ALL SELECT 'ledger_entries', count(DISTINCT business_date) FROM bronze_ledger_entries
         UNION ALL SELECT 'transfers', count(DISTINCT business_date) FROM bronze_transfers)
SELECT table_name, unnest(rules) AS rule_name, CAST(n AS BIGINT) AS dates_checked, TRUE AS ran
FROM declared JOIN days USING (table_name)
""")
def rules_that_ran(spark, sf_dir):
    """On how many dates every declared rule left a result; one that left none did not run."""
    results, s = _daily_counts(spark, sf_dir)
    return audit.rules_that_ran({t: [r.name for r in s[t].evaluation.rules] for t in M.TABLES}, results)


@register("posting_vs_source", """
, p AS (SELECT id * 2 AS id, id AS transaction_id, from_account_id AS account_id, 'DEBIT' AS entry_type, amount, created_at
        FROM transfers WHERE from_account_id <> to_account_id
        UNION ALL
        SELECT id * 2 + 1, id, to_account_id, 'CREDIT', amount, created_at
        FROM transfers WHERE from_account_id <> to_account_id),
l AS (SELECT count(*) AS n FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM ledger_entries)),
r AS (SELECT count(*) AS n FROM (SELECT * FROM ledger_entries EXCEPT ALL SELECT * FROM p))
SELECT CAST(l.n AS BIGINT) AS only_left, CAST(r.n AS BIGINT) AS only_right, l.n = 0 AND r.n = 0 AS equal FROM l, r
""".replace("\n, p AS", ", p AS", 1))
def posting_vs_source(spark, sf_dir):
    """Multiset comparison of a clean re-posting with the source ledger."""
    return audit.multiset_equal(ledger.post_transfers(bank.transfers(spark, sf_dir)), bank.ledger_entries(spark, sf_dir))


@register("batch_status_counts", """
SELECT layer, source_table, status, CAST(count(*) AS BIGINT) AS batches
FROM batch_events GROUP BY layer, source_table, status
""")
def batch_status_counts(spark, sf_dir):
    return (audit.batch_states(bank.batch_events(spark, sf_dir)).groupBy("layer", "source_table", "status")
            .agg(F.count(F.lit(1)).cast("long").alias("batches")))


@register("foreign_key_audit", queries_aml._FLAGS_SQL + """
, tok AS (SELECT event_id AS id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS replaced_by
          FROM events)
SELECT 'accounts.owner_user_id' AS relation, CAST(count(*) AS BIGINT) AS rows_checked,
       CAST(count(*) FILTER (WHERE owner_user_id IS NOT NULL
                             AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = a.owner_user_id)) AS BIGINT) AS orphans
FROM accounts a
UNION ALL
SELECT 'ledger_entries.account_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = l.account_id)) FROM ledger_entries l
UNION ALL
SELECT 'transfers.from_account_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = t.from_account_id)) FROM transfers t
UNION ALL
SELECT 'transfers.to_account_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = t.to_account_id)) FROM transfers t
UNION ALL
SELECT 'suspicious_activities.user_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = f.user_id)) FROM flags f
UNION ALL
SELECT 'suspicious_activities.transfer_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM transfers t WHERE t.id = f.transfer_id)) FROM flags f
UNION ALL
SELECT 'refresh_tokens.user_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = k.user_id)) FROM tok k
UNION ALL
SELECT 'refresh_tokens.replaced_by', count(*),
       count(*) FILTER (WHERE replaced_by IS NOT NULL
                        AND NOT EXISTS (SELECT 1 FROM tok k2 WHERE k2.id = k.replaced_by)) FROM tok k
""")
def foreign_key_audit(spark, sf_dir):
    """Referential integrity of every foreign key (optional keys may be NULL)."""
    from tally.operators import rules as R

    acc, users = bank.accounts(spark, sf_dir), bank.users(spark, sf_dir)
    tok = bank.refresh_tokens(spark, sf_dir)
    flags = queries_aml._flags(spark, sf_dir)
    checks = [
        ("accounts.owner_user_id", acc, R.referential_integrity("owner_user_id", users, "id", allow_null=True)),
        ("ledger_entries.account_id", bank.ledger_entries(spark, sf_dir), R.referential_integrity("account_id", acc, "id")),
        ("transfers.from_account_id", bank.transfers(spark, sf_dir), R.referential_integrity("from_account_id", acc, "id")),
        ("transfers.to_account_id", bank.transfers(spark, sf_dir), R.referential_integrity("to_account_id", acc, "id")),
        ("suspicious_activities.user_id", flags, R.referential_integrity("user_id", users, "id")),
        ("suspicious_activities.transfer_id", flags, R.referential_integrity("transfer_id", bank.transfers(spark, sf_dir), "id")),
        ("refresh_tokens.user_id", tok, R.referential_integrity("user_id", users, "id")),
        ("refresh_tokens.replaced_by", tok, R.referential_integrity("replaced_by", tok, "id", allow_null=True)),
    ]
    out = None
    for name, df, rule in checks:
        c = R.evaluate(df, [rule]).counts().select(F.lit(name).alias("relation"), "rows_checked",
                                                   F.col("rows_failed").alias("orphans"))
        out = c if out is None else out.unionByName(c)
    return out
