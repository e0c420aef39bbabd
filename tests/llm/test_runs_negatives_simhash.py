"""Periodic runs, hard negatives and the SimHash join against plain Python."""
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tally.llm import queries, simhash_join
from tally.llm.hard_negatives import Tree, hard_negatives
from tally.llm.periodic_runs import Extensions, lyndon_lengths, periodic_runs, runs_of
from tally.llm.simhash_join import Index, fingerprint, near_fingerprints, near_links, stretches
from tests.conftest import SF
from tests.llm import helpers as H

SCHEMA = "doc_id long, text string, start long, runs string, f string, id string, v string"
CLASH = ["clash"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, *CLASH * 4) for i, t in rows], SCHEMA)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- periodic runs

def brute_runs(w, min_length=24, min_exponent=3):
    """By comparing all words q apart, for every q."""
    found = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                if not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(r, most=90):
    n = r.randrange(most)
    w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), 1 + n // r.randrange(2, 9)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (2, 2), (5, 2), (9, 4)])
def test_runs_equal_brute_force(min_length, min_exponent):
    r = random.Random(min_length)
    for _ in range(400):
        w = periodic(r)
        assert list(map(tuple, runs_of(np.array(w, np.int64), min_length, min_exponent).tolist())) == brute_runs(w, min_length, min_exponent)


def test_extensions_and_lyndon_words():
    r = random.Random(2)
    for _ in range(150):
        w = [r.randrange(3) for _ in range(r.randrange(1, 40))]
        n, e = len(w), Extensions(np.unique(w, return_inverse=True)[1])
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j], strict=True))
        common = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), 0)
        assert e.lce(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        for rank, sign in ((e.rank, 1), (e.inverse_rank(), -1)):
            tail = lambda i: [sign * x for x in w[i:]]  # noqa: B023, E731
            assert sorted(range(n), key=tail) == np.argsort(rank).tolist()
            longest = [max(k for k in range(1, n - i + 1) if all([sign * x for x in w[i:i + k]] < [sign * x for x in w[i + d:i + k]]
                                                                   for d in range(1, k))) for i in range(n)]
            assert lyndon_lengths(rank).tolist() == longest


def test_long_periods_are_exact():
    r = random.Random(3)
    base = [r.randrange(50) for _ in range(3000)]
    w = [r.randrange(50) for _ in range(500)] + [base[i % 3000] for i in range(9500)]
    got = runs_of(np.array(w, np.int64))
    assert (got[:, 2] == 3000).sum() == 1
    start, length, _ = got[got[:, 2] == 3000][0].tolist()
    assert start <= 500 and start + length == len(w) and all(w[i] == w[i + 3000] for i in range(start, start + length - 3000))
    assert start == 0 or w[start - 1] != w[start + 2999]


def model_runs(doc_id, text):
    """The contract of op11, by brute force."""
    w = plain_words(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(kept)))


def test_op11_equals_brute_force(spark, monkeypatch):
    """Repeated words inside texts, ties, blanks, nulls, repeated ids and a long text of one word."""
    r = random.Random(7)
    rows = [(i, " ".join(f"w{x}" for x in periodic(r, 200)) + r.choice(["", "\n", " \t"])) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "ab " * 5000), (None, "x y " * 20), (904, "x y " * 20), (904, "x y " * 20),
             (905, "a b c " * 9 + "\x85 d e " * 9), (906, "a " * 24), (907, "a " * 23)]
    rows += [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    monkeypatch.setattr(queries, "table", lambda *a: frame(spark, rows))
    got = queries.op11(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((model_runs(*x) for x in rows), key=str)
    assert queries.op11.__name__ == "op11" and got.columns[:3] == ["doc_id", "n_runs", "start"]


def test_periodic_runs_interface(spark):
    text = "p q r s " * 7 + "end"
    row = periodic_runs(frame(spark, [(1, text)])).first()
    assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (29, [(0, 28, 4)], "p q r s end")
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, []), min_exponent=1)


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *CLASH * 3) for r in rows], VECTORS)


def model_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    part = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, v, label in {(i, tuple(v), label) for i, v, label in part if i in anchors}:
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), i, other) for i, u, other in part if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "scattered", "ties"])
def test_hard_negatives_equal_brute_force(spark, kind):
    r = np.random.default_rng(5)
    if kind == "clustered":
        centres = r.normal(size=(12, 8))
        x = centres[r.integers(0, 12, 1500)] + 0.05 * r.normal(size=(1500, 8))
        x[::3] *= 3  # norms differ
    elif kind == "scattered":
        x = r.normal(size=(700, 16))
    else:
        x = r.integers(-2, 3, size=(600, 4)) / 4
        x[100:400] = x[100]
    rows = [(int(i), v.tolist(), int(r.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(10_000, None, 1), (10_100, [None, 1.0], 1), (10_200, [math.nan, 1.0], 1), (10_300, [math.inf, 1.0], 2), (10_400, [1.0, 0.5], None),
             (10_500, [], 1), (10_600, [2.0], 0), (None, [1.0] * 4, 1), (10_700, [0.0] * 4, 1), (50, rows[50][1], rows[50][2])]
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    want = model_negatives(rows, {i for i, _, _ in rows if i is not None and i % 50 == 0})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_hard_negatives_edges(spark):
    none = F.col("vec_id") < 0
    assert hard_negatives(vectors(spark, []), none).count() == 0
    assert hard_negatives(vectors(spark, [(1, [1.0], 1)]), none).count() == 0
    assert hard_negatives(vectors(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]), F.col("vec_id") == 0).collect()[0].asDict() == {
        "anchor_id": 0, "positive_id": 1, "rank": 1, "negative_id": 2, "positive_score": 0, "negative_score": 0}
    with pytest.raises(ValueError):
        hard_negatives(vectors(spark, [(1, [1e9], 1)]), none)


def test_tree_covers_its_rows():
    r = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([r.normal(size=(500, 6)), np.ones((300, 6)), 0.02 * r.normal(size=(900, 6)) + 1]))
    tree = Tree(x, float(np.sqrt((x * x).sum(axis=1).max())))
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(len(x))) and len(tree.centre) > 5
    for node, rows in enumerate(tree.rows):
        while node >= 0 and len(rows):
            angle = np.arccos(np.clip(tree.points[rows] @ tree.points[tree.centre[node]], -1, 1))
            assert angle.max() <= tree.radius[node] + 1e-7
            node = tree.parent[node]


# ---------------------------------------------------------------- SimHash

def model_print(text):
    w = H.words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode("utf-8", "surrogatepass"), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def model_components(prints, distance=4):
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    every = sorted(prints)
    for i, f in enumerate(every):
        for g in every[i + 1:]:
            if (f ^ g).bit_count() <= distance:
                parent[find(g)] = find(f)
    return {f: find(f) for f in every}


def simhash_rows(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    for k in range(80):
        base[r.randrange(120)] = f"n{r.randrange(10 ** 6)}"
        rows.append((5000 + k, " ".join(base)))
    return rows + [(6000, None), (6001, ""), (6002, " \n"), (6003, "One two"), (6004, "one\ttwo"), (6005, "a b c"), (6006, "É é"), (6007, "É é"),
                   (6007, "É é"), (None, "one two"), (6008, "z " * 30_000)]


@pytest.mark.parametrize("most", [2048, 32])
def test_near_fingerprints_equal_brute_force(spark, monkeypatch, most):
    """With groups of 32 at most, large groups are dealt again."""
    monkeypatch.setattr(simhash_join, "MOST", most)
    rows = simhash_rows(spark)
    prints = [model_print(t) for _, t in rows]
    roots = model_components(set(prints))
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(((i, f"{f:016x}", least[roots[f]]) for (i, _), f in zip(rows, prints, strict=True)), key=str)
    got = near_fingerprints(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 1 < len(set(roots.values())) < len(roots)


def test_dense_fingerprints(spark):
    """A ball of fingerprints in one group, chains across it and strangers."""
    r = random.Random(9)
    flip = lambda f, k: f ^ sum(1 << b for b in r.sample(range(64), k))
    prints = {flip(0, r.randrange(4)) for _ in range(1500)} | {r.getrandbits(64) for _ in range(500)}
    at = r.getrandbits(64)
    for _ in range(200):
        at = flip(at, r.randrange(3, 6))
        prints.add(at)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "f long")).collect()
    parent = {f: f for f in signed}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in links:
        assert ((a ^ b) & simhash_join.ALL).bit_count() <= 64
        parent[find(a)] = find(b)
    roots = model_components(prints)
    sets = lambda d: sorted(sorted(k & simhash_join.ALL for k in d if d[k] == v) for v in set(d.values()))
    assert sets({f: find(f) for f in signed}) == sets(roots)


def test_index_and_stretches():
    r = random.Random(11)
    for count in (1, 5, 11):
        masks = stretches(0xFF00, count)
        assert all(m & 0xFF00 == 0xFF00 for m in masks) and sum((m & ~0xFF00).bit_count() for m in masks) == 56
    rank = lambda f: f ^ rank(f >> 1) if f else 0
    for _ in range(30):
        groups = [sorted({r.getrandbits(64) & 0xFFF0000000000FFF for _ in range(r.randrange(1, 120))}, key=rank) for _ in range(6)]
        f, group = np.array(sum(groups, []), np.uint64), np.repeat(np.arange(6), [len(g) for g in groups])
        label = Index(f, group).forest(4)
        for g in range(6):
            want = model_components(groups[g])
            mine = {int(x): int(y) for x, y in zip(f[group == g], label[group == g], strict=True)}
            assert len(set(mine.values())) == len(set(want.values()))
            assert all((mine[x] == mine[y]) == (want[x] == want[y]) for x in groups[g] for y in groups[g])


def test_near_fingerprints_edges(spark):
    assert near_fingerprints(frame(spark, [])).count() == 0
    got = near_fingerprints(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert sorted((r.fingerprint == "0" * 16, r.component_id) for r in got) == [(False, None), (True, None)]
    assert fingerprint(b"A b C") == model_print("a B c")
    with pytest.raises(ValueError):
        near_fingerprints(frame(spark, []), distance=11)
