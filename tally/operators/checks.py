"""SQL check files: a header (engine / expect / description) and one query;
zero rows means the check passes.  All checks run before any failure is
raised, so the audit trail records every result."""
from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = re.compile(r"^--\s*(engine|expect|description):\s*(.*)$")
CHECK_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "checks", "sql")


@dataclass
class SqlCheck:
    name: str
    engine: str
    expect: str
    description: str
    sql: str


def parse_check(path: str) -> SqlCheck:
    meta = {"engine": "spark", "expect": "zero_rows", "description": ""}
    body = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = HEADER.match(line.strip())
            if m and not body:
                meta[m.group(1)] = m.group(2).strip()
            else:
                body.append(line)
    name = os.path.splitext(os.path.basename(path))[0]
    return SqlCheck(name, meta["engine"], meta["expect"], meta["description"], "".join(body).strip().rstrip(";"))


def load_checks(check_dir: str = CHECK_DIR) -> list:
    return [parse_check(p) for p in sorted(glob.glob(os.path.join(check_dir, "*.sql")))]


class ChecksFailed(RuntimeError):
    pass


def check_rows(spark: SparkSession, check: SqlCheck, business_date: str) -> DataFrame:
    """The failing rows of a check, all of them."""
    args = {"business_date": business_date} if ":business_date" in check.sql else None
    return spark.sql(check.sql, args=args)


def failing_rows(spark: SparkSession, checks: list, business_date: str) -> DataFrame:
    """(rule_name, failing_row as JSON) of all checks."""
    rows = [check_rows(spark, c, business_date).select(F.lit(f"sql:{c.name}").alias("rule_name"),
                                                       F.to_json(F.struct("*")).alias("failing_row")) for c in checks]
    return reduce(DataFrame.unionByName, rows)


def run_checks(spark: SparkSession, checks: list, business_date: str) -> list:
    """Run every check once; returns dicts (rule_name, engine, rows_failed, passed).
    :func:`failing_rows` gives the rows themselves, as a table to write."""
    results = []
    for c in checks:
        n = check_rows(spark, c, business_date).count()
        results.append({"rule_name": f"sql:{c.name}", "engine": c.engine, "rows_failed": n, "passed": n == 0})
    return results


def raise_on_failures(results: list) -> None:
    failed = [r["rule_name"] for r in results if not r["passed"]]
    if failed:
        raise ChecksFailed(f"SQL checks failed: {failed}")
