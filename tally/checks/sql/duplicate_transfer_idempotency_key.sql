-- engine: source
-- expect: zero_rows
-- description: idempotency_key must be unique in the source transfers.
SELECT idempotency_key, count(*) AS occurrences
FROM source_transfers
GROUP BY idempotency_key
HAVING count(*) > 1
