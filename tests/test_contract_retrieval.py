"""Source contract mutations, text functions, retrieval and upsert."""
import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.functions.text import is_blank, mask_keep_two, yen_amounts
from tally.functions.vectors import fake_embedding
from tally.operators import contract, retrieval
from tally.sources.testdata import table
from tests.conftest import SF

DOC = {"tables": {
    "accounts": {"id": {"type": "BIGINT", "nullable": False}, "balance": {"type": "DECIMAL(19,4)", "nullable": False},
                 "account_type": {"type": "VARCHAR", "nullable": False},
                 "owner_user_id": {"type": "BIGINT", "nullable": True}},
    "ledger_entries": {"amount": {"type": "DECIMAL(19,4)", "nullable": False},
                       "entry_type": {"type": "VARCHAR", "nullable": False},
                       "account_id": {"type": "BIGINT", "nullable": False}},
    "transfers": {"amount": {"type": "DECIMAL(19,4)", "nullable": False}},
}}


def _live(spark, drop=(), retype=None, nulls=(), add=None, missing_table=None):
    from decimal import Decimal

    acc = spark.createDataFrame([(1, Decimal(1), "CUSTOMER", 5)],
                                "id long, balance decimal(19,4), account_type string, owner_user_id long")
    led = spark.createDataFrame([(Decimal(1), "DEBIT", 1)], "amount decimal(19,4), entry_type string, account_id long")
    trf = spark.createDataFrame([(Decimal(1),)], "amount decimal(19,4)")
    tables = {"accounts": acc, "ledger_entries": led, "transfers": trf}
    for t, c in drop:
        tables[t] = tables[t].drop(c)
    for (t, c), typ in (retype or {}).items():
        tables[t] = tables[t].withColumn(c, F.col(c).cast(typ))
    for t, c in nulls:
        tables[t] = tables[t].unionByName(tables[t].withColumn(c, F.lit(None).cast(tables[t].schema[c].dataType)))
    if add:
        t, c = add
        tables[t] = tables[t].withColumn(c, F.lit("x"))
    if missing_table:
        tables.pop(missing_table)
    return contract.live_schema(spark, tables)


def _kinds(spark, **kw):
    diff = contract.contract_diff(contract.contract_frame(spark, DOC), _live(spark, **kw))
    return {(r["table_name"], r["column_name"]): (r["kind"], r["breaking"]) for r in diff.collect()}


def test_contract_mutations(spark):
    k = _kinds(spark)
    assert all(v == ("ok", False) for v in k.values())
    assert _kinds(spark, drop=[("ledger_entries", "amount")])[("ledger_entries", "amount")] == ("missing_column", True)
    assert _kinds(spark, retype={("transfers", "amount"): "string"})[("transfers", "amount")] == ("type_changed", True)
    assert _kinds(spark, nulls=[("accounts", "balance")])[("accounts", "balance")] == ("nullability_loosened", True)
    assert _kinds(spark, nulls=[("accounts", "owner_user_id")])[("accounts", "owner_user_id")] == ("ok", False)
    assert _kinds(spark, missing_table="transfers")[("transfers", "amount")] == ("missing_table", True)
    assert _kinds(spark, add=("accounts", "nickname"))[("accounts", "nickname")] == ("new_column", False)


def test_yen_amounts_and_text(spark):
    df = spark.createDataFrame([("100万円以上の振込は？",), ("1,000,000円を送金",), ("１００万円と 5 円",), ("なし",), (None,)], "t string")
    got = [r[0] for r in df.select(yen_amounts(F.col("t"))).collect()]
    assert [[int(x) for x in g] if g is not None else None for g in got] == [[1000000], [1000000], [5, 1000000], [], None]
    blanks = [r[0] for r in spark.createDataFrame([("",), ("  ",), ("　",), ("a",), (None,)], "t string")
              .select(is_blank(F.col("t"))).collect()]
    assert blanks == [True, True, True, False, True]
    assert spark.range(1).select(mask_keep_two(F.lit("alice")), mask_keep_two(F.lit("a"))).first() == ("al***", "a")


def test_yen_amounts_of_any_length(spark):
    """Amounts beyond every decimal type and digits of other scripts are kept exactly."""
    long = "9" * 60
    df = spark.createDataFrame([(f"{long}万円と{long}円",), ("٣٤円",), ("000円 007万円",)], "t string")
    got = [r[0] for r in df.select(yen_amounts(F.col("t"))).collect()]
    assert [[int(x) for x in g] for g in got] == [[int(long), int(long) * 10000], [34], [0, 70000]]


def test_topk_leaves_out_vectors_without_a_distance(spark):
    """Zero vectors, missing ones and those of another length are no candidates, whatever the queries' lengths."""
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "doc_id long, embedding array<double>")
    for queries in ([(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.5]), (3, [0.0, 0.0]), (4, None)]):
        q = spark.createDataFrame(queries, "query_id long, query_embedding array<double>")
        for dim in (None, 2):
            got = [(r.query_id, r.doc_id, r["rank"]) for r in retrieval.cosine_topk(docs, q, 5, dim).orderBy("query_id", "rank").collect()]
            assert got == [(1, 1, 1), (1, 5, 2)] + ([(2, 3, 1)] if len(queries) > 1 and dim is None else [])


def test_topk_over_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    vectors = [(i, [float(i % 7) + 1, float(i % 5) + 1]) for i in range(40)]
    docs = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(vectors[:10], "query_id long, query_embedding array<double>")
    few = sorted(map(tuple, retrieval.cosine_topk(docs, q, 4, 2).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 1000)
    assert few == sorted(map(tuple, retrieval.cosine_topk(docs, q, 4, 2).collect())) and len(few) == 40


def test_fake_embedding_matches_python(spark):
    texts = ["hello", "日本語のテキスト", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts] + [("   ",)], "t string")
    got = [r[0] for r in df.select(fake_embedding(F.col("t"), 8)).collect()]
    for t, g in zip(texts, got):
        v = sum(t.encode("utf-8")) % 1000
        assert g == [((v + i) % 1000) / 1000.0 for i in range(8)]
    assert got[-1] is None


def test_cosine_topk_matches_numpy(spark):
    emb = table(spark, SF, "embeddings", "vec_id", "embedding", "label")
    q = retrieval.label_centroids(emb)
    got = retrieval.cosine_topk(emb.select(F.col("vec_id").alias("doc_id"), "embedding"), q, 3)
    rows = emb.collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    for qr in q.collect():
        qv = np.array(qr["query_embedding"])
        d = 1 - (m @ qv) / (np.linalg.norm(m, axis=1) * np.linalg.norm(qv))
        order = sorted(range(len(ids)), key=lambda i: (round(d[i], 9), ids[i]))[:3]
        mine = [r["doc_id"] for r in got.filter(F.col("query_id") == qr["query_id"]).orderBy("rank").collect()]
        assert mine == [int(ids[i]) for i in order]


def test_rerank_puts_amount_match_first(spark):
    docs = spark.createDataFrame([(1, "振込の上限について"), (2, "100万円以上の振込について"), (3, "口座の開設")],
                                 "doc_id long, question string")
    docs = retrieval.embed_corpus(docs)
    qs = spark.createDataFrame([(1, "100万円以上の振込の手続き"), (2, "口座")], "query_id long, query_text string")
    res = retrieval.retrieve(docs, qs, limit=2)
    first = {r["query_id"]: r["doc_id"] for r in res.filter("final_rank = 1").collect()}
    assert first[1] == 2
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, qs, limit=0)
    blank = spark.createDataFrame([(9, "   ")], "query_id long, query_text string")
    assert retrieval.retrieve(docs, blank, limit=1).count() == 0


def test_upsert_inserts_then_updates(spark):
    corpus = spark.createDataFrame([(f"faq-{i:03d}", f"q{i}", f"a{i}") for i in range(25)],
                                   "faq_id string, question string, answer string")
    empty = retrieval.embed_corpus(corpus.limit(0))
    first = retrieval.upsert(empty, retrieval.embed_corpus(corpus))
    assert first.count() == 25
    changed = retrieval.embed_corpus(corpus.withColumn("answer", F.concat(F.col("answer"), F.lit("!"))))
    second = retrieval.upsert(first, changed)
    assert second.count() == 25 and second.filter(F.col("answer").endswith("!")).count() == 25
    assert retrieval.validate_embeddings(second, 8).count() == 0
    bad = copy.deepcopy(DOC)
    assert bad == DOC


def test_declared_nullability_breaks_the_contract_without_a_null(spark, tmp_root):
    """The database's own declarations: NOT NULL -> nullable stops the run although no NULL is there."""
    from decimal import Decimal

    from pyspark.sql import types as T

    from tally.plans.daily_run import run_day
    from tally.sources import bank, jdbc
    from tests.test_sources_helpers import DERBY

    url, props = "jdbc:derby:memory:tallycontract;create=true", {"driver": DERBY}

    def land(name, rows, *fields):
        schema = T.StructType([T.StructField(n, t, null) for n, t, null in fields])
        spark.createDataFrame(rows, schema).write.mode("overwrite").jdbc(url, name, properties=props)

    def accounts(null, kind=T.LongType()):
        land("accounts", [(1, Decimal(1))] if kind == T.LongType() else [("1", Decimal(1))], ("id", kind, False), ("balance", T.DecimalType(19, 4), null))

    doc = {"tables": {"accounts": {"id": {"type": "BIGINT", "nullable": False}, "balance": {"type": "DECIMAL(19,4)", "nullable": False}},
                      "transfers": {"amount": {"type": "DECIMAL(19,4)", "nullable": True}}}}
    kinds = lambda: {(r["table_name"], r["column_name"]): r["kind"] for r in contract.contract_diff(
        contract.contract_frame(spark, doc), jdbc.live_contract(spark, url, ["accounts", "transfers"], props)).collect()}
    accounts(False)
    assert kinds()[("transfers", "amount")] == "missing_table"
    land("transfers", [(Decimal(2),)], ("amount", T.DecimalType(19, 4), True))
    assert set(kinds().values()) == {"ok"}
    accounts(True)
    assert kinds() == {("accounts", "id"): "ok", ("accounts", "balance"): "nullability_loosened", ("transfers", "amount"): "ok"}
    sources = {"accounts": bank.accounts(spark, SF), "ledger_entries": bank.ledger_entries(spark, SF), "transfers": bank.transfers(spark, SF)}
    with pytest.raises(RuntimeError, match="accounts.balance"):
        run_day(spark, sources, tmp_root, "1995-01-02", "r1", doc, live=jdbc.live_contract(spark, url, ["accounts", "transfers"], props))
