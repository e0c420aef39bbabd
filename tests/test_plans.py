"""Physical-plan properties the scale design relies on."""
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from tally.operators import retrieval
from tally.sources.testdata import table
from tests.conftest import SF


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # run once so AQE shows the final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = E.queries()["aml_threshold"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    orders_scans = [line for line in plan.splitlines() if "orders.parquet" in line]
    assert orders_scans and all("o_orderpriority" not in line and "o_orderstatus" not in line for line in orders_scans)


def test_silver_clean_shuffles_ledger_once(spark):
    plan = _plan(E.queries()["silver_ledger"](spark, SF))
    # one hash exchange per table on its id (the veto/dedup aggregate of ledger entries and of the
    # accounts feeding the RI rule); no null-safe self-join shuffles
    assert plan.count("Exchange hashpartitioning(id#") == 2
    assert "hashpartitioning(coalesce(" not in plan


def test_topk_limits_before_the_shuffle(spark):
    emb = table(spark, SF, "embeddings", "vec_id", "embedding", "label")
    df = retrieval.cosine_topk(emb.select(F.col("vec_id").alias("doc_id"), "embedding"),
                               retrieval.label_centroids(emb), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_is_a_partial_aggregate(spark):
    plan = E.queries()["dedup_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_no_window_holds_a_whole_account(spark):
    """Look-backs and running balances: rows in windows by (key, slice), over the key alone only slice totals."""
    for name, key in (("aml_velocity", "_key"), ("running_balance", "account_id")):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        parts = re.findall(r" Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
        assert any("_slice#" in by and key in by for by, _ in parts), name
        assert all("_slice#" in by or order.startswith("_slice#") for by, order in parts), name


def test_parity_reads_each_table_few_times(spark):
    """Bronze, Silver and quarantine counts come from one pass over a table; 54 scans when each was built by itself."""
    plan = E.queries()["row_count_parity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 18


def test_lake_date_filter_prunes_paths(spark, tmp_root):
    from tally.sources import lake

    df = spark.createDataFrame([(1,)], "id long")
    for d in ("2026-01-01", "2026-01-02", "2026-01-03"):
        lake.write_partition(df, tmp_root, "silver", "t", d)
    one = lake.read_table(spark, tmp_root, "silver", "t", ["2026-01-02"])
    files = one.inputFiles()
    assert files and all("business_date=2026-01-02" in f for f in files)
