"""JDBC and corpus sources, model provider hook, scenario helpers."""
import json
import os
import tempfile
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally.functions.text import account_number_from_key
from tally.operators import audit, retrieval, scenarios
from tally.sources import corpus, jdbc

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_partitioned_read(spark):
    url = "jdbc:derby:memory:tallytest;create=true"
    rows = [(i, f"k{i}", Decimal(i) / 4) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "ID long, IDEMPOTENCY_KEY string, AMOUNT decimal(19,4)")
    df.write.format("jdbc").option("url", url).option("dbtable", "transfers").option("driver", DERBY) \
        .mode("overwrite").save()
    got = jdbc.read_table(spark, url, "transfers", {"driver": DERBY}, partition_column="ID", num_partitions=4)
    assert got.rdd.getNumPartitions() == 4
    assert got.count() == 100 and got.agg(F.sum("AMOUNT")).first()[0] == sum(r[2] for r in rows)
    assert jdbc.read_table(spark, url, "transfers", {"driver": DERBY}).count() == 100


def test_jdbc_read_by_uuid_key(spark):
    """Each row comes once, from the range of its key; the first range takes NULL keys."""
    url = "jdbc:derby:memory:tallyuuid;create=true"
    rows = [(str(uuid.uuid5(uuid.NAMESPACE_URL, str(i))), i) for i in range(200)]
    spark.createDataFrame(rows, "ID string, N long").write.format("jdbc").option("url", url).option("dbtable", "keyed") \
        .option("driver", DERBY).option("createTableColumnTypes", "ID VARCHAR(36)").mode("overwrite").save()
    got = jdbc.read_by_key(spark, url, "keyed", "ID", 5, {"driver": DERBY})
    assert got.rdd.getNumPartitions() == 5 and sorted(r["N"] for r in got.collect()) == list(range(200))
    assert jdbc.key_ranges("id", 1) == ["1 = 1"] and "id IS NULL" in jdbc.key_ranges("id", 3)[0]


def _write(text):
    d = tempfile.mkdtemp(prefix="tally-corpus-")
    p = os.path.join(d, "faq.json")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_corpus_loader(spark):
    entries = [{"id": f"faq-{i:03d}", "question": f"q{i}", "answer": f"a{i}"} for i in range(25)]
    df = corpus.load_corpus(spark, _write(json.dumps(entries, ensure_ascii=False, indent=1)))
    assert df.count() == 25 and set(df.columns) == {"faq_id", "question", "answer"}
    with pytest.raises(corpus.CorpusError, match="array"):
        corpus.load_corpus(spark, _write(json.dumps(entries[0])))
    with pytest.raises(corpus.CorpusError, match="empty"):
        corpus.load_corpus(spark, _write("  []"))
    with pytest.raises(corpus.CorpusError, match="unique"):
        corpus.load_corpus(spark, _write(json.dumps(entries + entries[:1])))
    with pytest.raises(corpus.CorpusError, match="miss"):
        corpus.load_corpus(spark, _write(json.dumps([{"id": "x", "question": "q"}])))


def _toy_model():
    def embed(texts):
        return [[float(len(t)), 1.0, 0.0] for t in texts]
    return embed


def test_model_provider_hook(spark):
    p = retrieval.ModelProvider(_toy_model, dimensions=3)
    df = spark.createDataFrame([("abc",), ("  ",)], "t string")
    got = [r[0] for r in df.select(p.embed_document(F.col("t"))).collect()]
    assert got[0] == [float(len("passage: abc")), 1.0, 0.0] and got[1] == [float(len("passage:   ")), 1.0, 0.0]
    bad = retrieval.ModelProvider(_toy_model, dimensions=4)
    with pytest.raises(Exception, match="dimensions"):
        df.select(bad.embed_query(F.col("t"))).collect()


def test_scenario_helpers_and_small_functions(spark):
    df = spark.createDataFrame([(2, Decimal(5), "2026-01-05"), (1, Decimal(7), "2026-01-05")],
                               "id long, balance decimal(19,4), business_date string")
    o = scenarios.override(df, balance=-50)
    assert o.schema["balance"].dataType == df.schema["balance"].dataType
    assert [r["balance"] for r in o.collect()] == [Decimal(-50)] * 2
    assert scenarios.clone_partition(df, "2026-01-05", "2026-01-06").select("business_date").distinct().first()[0] == "2026-01-06"
    assert scenarios.template_row(df, "id").first()["id"] == 1
    assert scenarios.lookup(df, "id", [2]).count() == 1
    assert scenarios.lookup(df, "id", spark.createDataFrame([(1,), (1,)], "k long")).count() == 1
    new = spark.createDataFrame([(1, Decimal(0), "x"), (3, Decimal(0), "x")], df.schema)
    assert [r["id"] for r in audit.insert_if_absent(df, new, "id").collect()] == [3]
    eq = audit.multiset_equal(df, df.unionByName(df.limit(1))).first()
    assert (eq["only_left"], eq["only_right"], eq["equal"]) == (0, 1, False)
    acc = spark.range(1).select(account_number_from_key(F.lit("00000000-0000-0000-0000-000000000001"))).first()[0]
    assert acc.startswith("ACC-") and len(acc) == 12 and acc[4:] == acc[4:].upper()


def test_multisets_are_compared_by_print_first(spark):
    """Equal sides in another order and type; a NULL that moves to the next column; a row twice instead of another."""
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b"), (3, "c", "d")], "i int, x string, y string")
    same = df.orderBy(F.desc("i")).select(F.col("i").cast("long").alias("j"), "x", "y")
    assert tuple(audit.multiset_equal(df, same).first()) == (0, 0, True)
    moved = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, None, "b"), (3, "c", "d")], df.schema)
    assert tuple(audit.multiset_equal(df, moved).first()) == (1, 1, False)
    twice = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "c", "d"), (3, "c", "d")], df.schema)
    assert tuple(audit.multiset_equal(df, twice).first()) == (1, 1, False)
    assert tuple(audit.multiset_equal(df.limit(0), df).first()) == (0, 4, False)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from tally import session

    class Conf:
        get = staticmethod(lambda *a: None)

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]", "getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_a_rule_that_did_not_run_shows(spark):
    results = spark.createDataFrame([("t", "a", "d1"), ("t", "a", "d2"), ("u", "a", "d1")], "table_name string, rule_name string, business_date string")
    got = audit.rules_that_ran({"t": ["a", "b"], "u": ["a"]}, results).collect()
    assert sorted(map(tuple, got)) == [("t", "a", 2, True), ("t", "b", 0, False), ("u", "a", 1, True)]
