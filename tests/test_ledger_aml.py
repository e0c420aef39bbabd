"""Ledger, reconciliation, eligibility, replay and AML golden cases."""
import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from tally.operators import aml, ledger

LED = "id long, transaction_id long, account_id long, entry_type string, amount decimal(19,4)"
TRF = "id long, idempotency_key string, from_account_id long, to_account_id long, amount decimal(19,4), created_at timestamp_ntz"


def _report(spark, rows):
    df = spark.createDataFrame(rows, LED)
    return ledger.reconciliation_report(df).first(), {r["transaction_id"] for r in ledger.unbalanced_transactions(df).collect()}


def test_reconciliation_report_cases(spark):
    r, bad = _report(spark, [])
    assert r["total_debits"] == 0 and r["total_credits"] == 0 and r["is_clean"] and not bad
    r, bad = _report(spark, [(1, 1, 1, "DEBIT", Decimal(100))])
    assert not r["is_clean"] and bad == {1}
    r, bad = _report(spark, [(1, 1, 1, "DEBIT", Decimal(100)), (2, 1, 2, "DEBIT", Decimal(100))])
    assert bad == {1}
    r, bad = _report(spark, [(1, 1, 1, "DEBIT", Decimal(100)), (2, 1, 2, "CREDIT", Decimal(90))])
    assert bad == {1} and not r["globally_balanced"]
    # lone debit and lone credit in different transactions: globally balanced, not clean
    r, bad = _report(spark, [(1, 1, 1, "DEBIT", Decimal(100)), (2, 2, 2, "CREDIT", Decimal(100))])
    assert r["globally_balanced"] and not r["is_clean"] and bad == {1, 2}
    r, bad = _report(spark, [(1, 1, 1, "DEBIT", Decimal(100)), (2, 1, 2, "CREDIT", Decimal("100.0000"))])
    assert r["is_clean"] and not bad


def test_posting_and_deposit(spark):
    t = spark.createDataFrame([(5, "k", 1, 2, Decimal(100), dt.datetime(2024, 1, 1)),
                               (6, "s", 3, 3, Decimal(1), dt.datetime(2024, 1, 1))], TRF)
    e = {(r["id"], r["account_id"], r["entry_type"]) for r in ledger.post_transfers(t).collect()}
    assert e == {(10, 1, "DEBIT"), (11, 2, "CREDIT")}  # self-transfer rejected
    d = spark.createDataFrame([(7, 4, Decimal(500), dt.datetime(2024, 1, 1))],
                              "id long, to_account_id long, amount decimal(19,4), created_at timestamp_ntz")
    e = {(r["account_id"], r["entry_type"]) for r in ledger.post_deposits(d, 900).collect()}
    assert e == {(900, "DEBIT"), (4, "CREDIT")}
    bal = {r["account_id"]: r["ledger_balance"] for r in ledger.balances(ledger.post_deposits(d, 900)).collect()}
    assert bal == {900: Decimal(-500), 4: Decimal(500)}


def _accounts(spark):
    return spark.createDataFrame([
        (1, "ACTIVE", "CUSTOMER", Decimal(200000), 1), (2, "ACTIVE", "CUSTOMER", Decimal(0), 2),
        (3, "FROZEN", "CUSTOMER", Decimal(10), 3), (9, "ACTIVE", "SYSTEM", Decimal(-5), None),
        (4, "ACTIVE", "CUSTOMER", Decimal(500000), 4)],
        "id long, status string, account_type string, balance decimal(19,4), owner_user_id long")


def _users(spark):
    return spark.createDataFrame([(1, "UNVERIFIED"), (2, "VERIFIED"), (3, "VERIFIED"), (4, "VERIFIED")],
                                 "id long, kyc_status string")


def test_eligibility_precedence_and_kyc(spark):
    T0 = dt.datetime(2024, 1, 1)
    req = [
        (1, "a", 1, 2, Decimal(100000), T0, 1),          # KYC boundary: equal passes
        (2, "b", 1, 2, Decimal("100000.01"), T0, 1),     # UNVERIFIED above -> KYC_LIMIT
        (3, "c", 1, 1, Decimal(5), T0, 1),               # SELF_TRANSFER
        (4, "d", 1, 77, Decimal(5), T0, 1),              # ACCOUNT_NOT_FOUND
        (5, "e", 9, 2, Decimal(5), T0, None),            # SYSTEM_FROM
        (6, "f", 2, 9, Decimal(5), T0, 2),               # SYSTEM_TO
        (7, "g", 2, 1, Decimal(5), T0, 1),               # NOT_OWNER
        (8, "h", 3, 1, Decimal(5), T0, 3),               # FROM_NOT_ACTIVE
        (9, "i", 2, 1, Decimal(5), T0, 2),               # INSUFFICIENT_FUNDS
        (10, "j", 4, 3, Decimal(5), T0, 4),              # TO_NOT_ACTIVE
        (11, "a", 1, 2, Decimal(100000), T0 + dt.timedelta(seconds=1), 1),  # REPLAY
        (12, "a", 1, 2, Decimal(99), T0 + dt.timedelta(seconds=2), 1),      # CONFLICT
        (13, "k", 4, 2, Decimal(0), T0, 4),              # non-positive amount
    ]
    df = spark.createDataFrame(req, "request_id long, idempotency_key string, from_account_id long, to_account_id long, "
                                    "amount decimal(19,4), requested_at timestamp_ntz, caller_user_id long")
    got = {r["request_id"]: (r["decision"], r["reason"]) for r in
           ledger.transfer_eligibility(df, _accounts(spark), _users(spark)).collect()}
    assert got == {
        1: ("EXECUTED", None), 2: ("REJECTED", "KYC_LIMIT"), 3: ("REJECTED", "SELF_TRANSFER"),
        4: ("REJECTED", "ACCOUNT_NOT_FOUND"), 5: ("REJECTED", "SYSTEM_FROM"), 6: ("REJECTED", "SYSTEM_TO"),
        7: ("REJECTED", "NOT_OWNER"), 8: ("REJECTED", "FROM_NOT_ACTIVE"), 9: ("REJECTED", "INSUFFICIENT_FUNDS"),
        10: ("REJECTED", "TO_NOT_ACTIVE"), 11: ("REPLAY", "REPLAY"), 12: ("REJECTED", "CONFLICT"),
        13: ("REJECTED", "INVALID_REQUEST"),
    }


def test_posting_of_uuid_keys(spark):
    """Keys as the source tables have them: entry ids are UUIDs that depend on transfer and leg only."""
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, str(i))) for i in range(4)]
    t = spark.createDataFrame([(ids[0], ids[1], ids[2], Decimal(5), dt.datetime(2024, 1, 1))],
                              "id string, from_account_id string, to_account_id string, amount decimal(19,4), created_at timestamp_ntz")
    a, b = ([tuple(r) for r in ledger.post_transfers(t).orderBy("entry_type").collect()] for _ in range(2))
    assert a == b and len({r[0] for r in a}) == 2 and all(str(uuid.UUID(r[0])) == r[0] for r in a)
    assert {(r[1], r[2], r[3]) for r in a} == {(ids[0], ids[1], "DEBIT"), (ids[0], ids[2], "CREDIT")}
    assert ledger.unbalanced_transactions(ledger.post_transfers(t)).count() == 0


def test_a_rejected_request_does_not_own_its_key(spark):
    """Rejected then retried, rejected then changed, and a changed one after the transfer was saved."""
    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    req = [
        (1, "a", 2, 1, Decimal(5), at(0), 2),            # more than the balance
        (2, "a", 2, 1, Decimal(5), at(1), 2),            # the same again: rejected again, no replay
        (3, "a", 1, 2, Decimal(7), at(2), 1),            # another payload that passes: owns the key
        (4, "a", 1, 2, Decimal(7), at(3), 1),            # REPLAY
        (5, "a", 2, 1, Decimal(5), at(4), 2),            # CONFLICT
        (6, "a", 1, 2, Decimal(0), at(5), 1),            # invalid before its key counts
        (7, "b", 2, 1, Decimal(5), at(0), 2),            # nobody owns this key
        (8, "a", 1, 2, Decimal(7), at(3000 // 60), 1),   # long after: still known
    ]
    df = spark.createDataFrame(req, "request_id long, idempotency_key string, from_account_id long, to_account_id long, "
                                    "amount decimal(19,4), requested_at timestamp_ntz, caller_user_id long")
    got = {r["request_id"]: (r["decision"], r["reason"]) for r in
           ledger.transfer_eligibility(df, _accounts(spark), _users(spark)).collect()}
    assert got == {
        1: ("REJECTED", "INSUFFICIENT_FUNDS"), 2: ("REJECTED", "INSUFFICIENT_FUNDS"), 3: ("EXECUTED", None), 4: ("REPLAY", "REPLAY"),
        5: ("REJECTED", "CONFLICT"), 6: ("REJECTED", "INVALID_REQUEST"), 7: ("REJECTED", "INSUFFICIENT_FUNDS"), 8: ("REPLAY", "REPLAY")}
    checked = ledger.own_reason(df, _accounts(spark), _users(spark))
    got = {r["request_id"]: r["replay_status"] for r in ledger.replay_classification(checked, accepted=ledger.SAVED).collect()}
    assert got == {1: "REJECTED", 2: "REJECTED", 3: "EXECUTED", 4: "REPLAY", 5: "CONFLICT", 6: "CONFLICT", 7: "REJECTED", 8: "REPLAY"}


def test_running_balance_overdraft(spark):
    e = spark.createDataFrame([
        (1, 1, 1, "DEBIT", Decimal(150), dt.datetime(2024, 1, 1)),
        (2, 1, 1, "CREDIT", Decimal(100), dt.datetime(2024, 1, 3)),
        (3, 2, 1, "DEBIT", Decimal(60), dt.datetime(2024, 1, 3, 1))],
        LED + ", created_at timestamp_ntz")
    acc = spark.createDataFrame([(1, Decimal(100), "CUSTOMER")], "id long, balance decimal(19,4), account_type string")
    got = [(r["id"], r["running_balance"], r["overdraft"]) for r in
           ledger.running_balance(e, acc).orderBy("created_at", "id").collect()]
    assert got == [(1, Decimal(-50), True), (2, Decimal(50), False), (3, Decimal(-10), True)]


def _transfers(spark, rows):
    return spark.createDataFrame(rows, TRF)


NOW = dt.datetime(2024, 5, 1, 12, 0, 0)


def test_threshold_boundaries(spark):
    t = _transfers(spark, [(1, "a", 1, 2, Decimal("1000000.00"), NOW), (2, "b", 1, 2, Decimal("1000000.01"), NOW),
                           (3, "c", 1, 2, Decimal(500), NOW)])
    assert [r["id"] for r in aml.threshold_hits(t).collect()] == [2]


def test_velocity_boundaries(spark):
    five = [(i, f"k{i}", 1, 2, Decimal(1), NOW - dt.timedelta(minutes=i)) for i in range(5)]       # 0..4 min ago
    four = [(10 + i, f"m{i}", 3, 2, Decimal(1), NOW - dt.timedelta(minutes=i)) for i in range(4)]
    edge = [(20, "x", 5, 2, Decimal(1), NOW - dt.timedelta(minutes=10))] + \
           [(21 + i, f"y{i}", 5, 2, Decimal(1), NOW - dt.timedelta(minutes=i)) for i in range(4)]  # exactly 10 min old
    v = aml.velocity(_transfers(spark, five + four + edge))
    flags = {r["id"]: r["velocity_flag"] for r in v.collect()}
    assert flags[0] is True                       # 5 in the window -> VELOCITY
    assert not any(flags[10 + i] for i in range(4))  # 4 -> allow
    assert flags[21] is False                     # transfer exactly 10 min old is outside


def test_velocity_counts_across_bucket_edges(spark):
    # windows spanning a bucket boundary are counted exactly (compare with brute force)
    import random

    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i}", rnd.randint(1, 3), 9, Decimal(1), base + dt.timedelta(seconds=rnd.randint(0, 7200)))
            for i in range(300)]
    got = {r["id"]: r["velocity_count"] for r in aml.velocity(_transfers(spark, rows)).collect()}
    got3 = {r["id"]: r["velocity_count"] for r in aml.velocity(_transfers(spark, rows), slices=3).collect()}
    assert got3 == got
    for i, _, acc, _, _, t in rows:
        want = sum(1 for _, _, a2, _, _, t2 in rows if a2 == acc and t - dt.timedelta(minutes=10) < t2 <= t)
        assert got[i] == want


def test_structuring_cases(spark):
    def run(amounts):
        rows = [(i, f"k{i}", 1, 2, Decimal(a), NOW - dt.timedelta(hours=i)) for i, a in enumerate(amounts)]
        s = aml.structuring(_transfers(spark, rows))
        return s.filter("id = 0").first()["structuring_flag"]

    assert run(["900000", "950000", "999999"]) is True
    assert run(["900000", "950000"]) is False
    assert run(["899999", "900000", "950000"]) is False


def test_aml_flags_customer_only(spark):
    acc = spark.createDataFrame([(1, "CUSTOMER", 11), (9, "SYSTEM", None)], "id long, account_type string, owner_user_id long")
    t = _transfers(spark, [(1, "a", 1, 2, Decimal("1000000.01"), NOW), (2, "b", 9, 2, Decimal("2000000"), NOW)])
    flags = aml.aml_flags(t, acc).collect()
    assert [(r["user_id"], r["transfer_id"], r["reason"], r["status"]) for r in flags] == [(11, 1, "THRESHOLD", "OPEN")]
    assert flags[0]["amount"] == Decimal("1000000.01")
    upd, missing = aml.review(aml.aml_flags(t, acc), spark.createDataFrame([("1:THRESHOLD",), ("nope",)], "flag_id string"))
    assert [r["status"] for r in upd.collect()] == ["REVIEWED"]
    assert [r["flag_id"] for r in missing.collect()] == ["nope"]
