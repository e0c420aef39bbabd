-- engine: spark
-- expect: zero_rows
-- description: Silver accounts must hold one row per id on the business date.
SELECT id, count(*) AS occurrences
FROM silver_accounts
WHERE business_date = :business_date
GROUP BY id
HAVING count(*) > 1
