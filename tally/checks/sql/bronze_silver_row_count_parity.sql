-- engine: spark
-- expect: zero_rows
-- description: Bronze rows = Silver + quarantine + removed duplicates for every table on the business date; a row here means Silver lost or invented rows.
SELECT b.table_name, b.bronze_count, coalesce(s.n, 0) AS silver_count, coalesce(q.n, 0) AS quarantine_count
FROM (SELECT 'accounts' AS table_name, count(*) AS bronze_count FROM bronze_accounts WHERE business_date = :business_date
      UNION ALL SELECT 'ledger_entries', count(*) FROM bronze_ledger_entries WHERE business_date = :business_date
      UNION ALL SELECT 'transfers', count(*) FROM bronze_transfers WHERE business_date = :business_date) b
LEFT JOIN (SELECT 'accounts' AS table_name, count(*) AS n FROM silver_accounts WHERE business_date = :business_date
      UNION ALL SELECT 'ledger_entries', count(*) FROM silver_ledger_entries WHERE business_date = :business_date
      UNION ALL SELECT 'transfers', count(*) FROM silver_transfers WHERE business_date = :business_date) s
  ON s.table_name = b.table_name
LEFT JOIN (SELECT 'accounts' AS table_name, count(*) AS n FROM silver_accounts_quarantine WHERE business_date = :business_date
      UNION ALL SELECT 'ledger_entries', count(*) FROM silver_ledger_entries_quarantine WHERE business_date = :business_date
      UNION ALL SELECT 'transfers', count(*) FROM silver_transfers_quarantine WHERE business_date = :business_date) q
  ON q.table_name = b.table_name
WHERE b.bronze_count <> coalesce(s.n, 0) + coalesce(q.n, 0)
