"""Property tests: the single-pass evaluator and dedup agree with a plain Python model."""
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tally.operators import rules as R
from tally.operators.dedup import latest_per_key

ROW = st.tuples(
    st.one_of(st.none(), st.integers(0, 6)),                       # id (NULLs and duplicates)
    st.one_of(st.none(), st.sampled_from(["A", "B", "C", "Z"])),    # code
    st.one_of(st.none(), st.integers(-3, 3)),                      # amount
    st.one_of(st.none(), st.sampled_from(["k1", "k2", "k3"])),      # unique key
    st.one_of(st.none(), st.integers(0, 4)),                       # fk
    st.integers(0, 5),                                             # ts for dedup
)
SCHEMA = "id int, code string, amount decimal(10,0), uk string, fk int, ts int"
REF = [1, 2, 3]


def _model(rows):
    uk_counts = {}
    for r in rows:
        if r[3] is not None:
            uk_counts[r[3]] = uk_counts.get(r[3], 0) + 1
    fails = []
    for r in rows:
        f = {
            "isin:code": r[1] is not None and r[1] not in ("A", "B", "C"),
            "positive:amount": r[2] is not None and not r[2] > 0,
            "unique:uk": r[3] is not None and uk_counts[r[3]] > 1,
            "referential_integrity:fk->ref": r[4] not in REF,
        }
        fails.append(f)
    counts = {k: sum(f[k] for f in fails) for k in fails[0]} if rows else {}
    bad_ids = {r[0] for r, f in zip(rows, fails) if any(f.values())}
    clean = [r for r in rows if r[0] not in bad_ids]
    quarantined = [r for r in rows if r[0] in bad_ids]
    return counts, clean, quarantined


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=14))
def test_evaluator_matches_model(spark, rows):
    rows = [(r[0], r[1], None if r[2] is None else Decimal(r[2]), r[3], r[4], r[5]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    ref = spark.createDataFrame([(x,) for x in REF], "ref int")
    ev = R.evaluate(df, [R.isin("code", ["A", "B", "C"]), R.positive("amount"), R.unique("uk"),
                         R.referential_integrity("fk", ref, "ref")])
    counts, clean, quarantined = _model(rows)
    got = {r["rule_name"]: r["rows_failed"] for r in ev.counts().collect()}
    assert got == counts
    assert sorted(map(repr, (tuple(r) for r in ev.clean().collect()))) == sorted(map(repr, clean))
    assert sorted(map(repr, (tuple(r)[:-1] for r in ev.quarantined().collect()))) == sorted(map(repr, quarantined))
    # newest clean row per id, in one aggregate
    latest = {r["id"]: r["ts"] for r in ev.clean_latest(["ts"]).collect()}
    want = {}
    for r in clean:
        want[r[0]] = max(want.get(r[0], -1), r[5])
    assert latest == want


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(0, 99)), min_size=1, max_size=20))
def test_latest_per_key_matches_model(spark, rows):
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {r["k"]: (r["t"], r["v"]) for r in latest_per_key(df, ["k"], ["t"]).collect()}
    want = {}
    for k, t, v in rows:
        want[k] = max(want.get(k, (-1, -1)), (t, v))
    assert got == want
