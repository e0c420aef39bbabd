-- engine: source
-- expect: zero_rows
-- description: Every source transaction must be exactly one DEBIT and one CREDIT of equal amount.
WITH legs AS (
  SELECT transaction_id, entry_type, count(*) AS entries, sum(amount) AS total
  FROM source_ledger_entries GROUP BY transaction_id, entry_type
), pairs AS (
  SELECT transaction_id, array_sort(collect_list(struct(entry_type, entries))) AS found, max(total) - min(total) AS gap
  FROM legs GROUP BY transaction_id
)
SELECT transaction_id, found, gap
FROM pairs
WHERE NOT (found = array(named_struct('entry_type', 'CREDIT', 'entries', 1L), named_struct('entry_type', 'DEBIT', 'entries', 1L)) AND gap <=> 0)
