-- engine: source
-- expect: zero_rows
-- description: Every source ledger entry must reference an existing account.
SELECT le.id, le.account_id
FROM source_ledger_entries le
LEFT ANTI JOIN source_accounts a ON a.id = le.account_id
