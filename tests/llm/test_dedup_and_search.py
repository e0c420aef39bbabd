"""Exact dedup, line dedup, decontamination and the n-gram join against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from tally.llm import line_dedup, ngram_join
from tally.llm.components import components
from tally.llm.decontamination import contained_items
from tally.llm.exact_dedup import exact_groups, keep_one
from tally.llm.line_dedup import remove_repeated_lines
from tally.llm.ngram_join import near_classes
from tests.llm import helpers as H

SCHEMA = "doc_id long, text string, source string, id string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in rows], SCHEMA)


TEXTS = [(1, "a b c"), (2, "a  b\nc"), (3, "abc"), (4, None), (5, ""), (6, " \t\n"), (7, "x" * 300_000), (8, "x" * 300_000 + "\n"),
         (9, "é"), (9, "é"), (None, "abc"), (11, "a bc")]


def expected_groups(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    out = []
    for i, t in rows:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if norm(u) == norm(t)]
        out.append((i, min(group)[3], len(group)))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """With a hash of two values, every group collides and the bytes decide."""
    hasher = (lambda sha, norm: F.unhex(F.lit("00"))) if weak else None
    got = exact_groups(frame(spark, TEXTS), **({"hasher": hasher} if weak else {})).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == expected_groups(TEXTS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_keep_one_keeps_columns_and_one_of_repeated_rows(spark):
    kept = keep_one(frame(spark, TEXTS))
    assert kept.columns == ["doc_id", "text", "source", "id", "h"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 8, 9, 11]
    assert exact_groups(frame(spark, [])).count() == 0 and keep_one(frame(spark, [])).count() == 0


def near_texts(seed):
    """Copies with some words changed, a passage in many texts, short texts, repeats."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    passage = " ".join(word() for _ in range(40))
    out, n = [], 0
    for _ in range(30):
        base = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 7, 9, 12, 30, 80, 300, 900]))]
        for _ in range(r.randrange(1, 5)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 40)):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[r.randrange(1 + len(copy) // 8):]
            text = " ".join(copy)
            out.append((n, text + "\n" + passage if r.random() < 0.4 else text.upper()))
            n += 1
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One\ttwo"), (n + 5, "one two three")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes(spark, seed):
    rows = near_texts(seed)
    sets = {i: H.shingles(t) for i, t in rows}
    want = H.components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_near_classes_of_a_large_group(spark):
    """A chain of near copies and many unrelated texts with one passage: words shared by more than a tile holds."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{i}a", f"u{i}b", *passage[:56], f"v{i}", f"x{i}"])) for i in range(700)]
    base = [f"b{i}" for i in range(200)]
    for k in range(100):
        base[k] = f"n{r.randrange(10 ** 6)}"
        rows.append((1000 + k, " ".join(base)))
    sets = {i: H.shingles(t) for i, t in rows}
    got = {x.doc_id: x.component_id for x in near_classes(frame(spark, rows)).collect()}
    assert got == H.components(sets)


def test_near_classes_edges(spark):
    assert near_classes(frame(spark, [])).count() == 0
    got = near_classes(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("None", "3")]


def test_pigeonhole_words():
    """Linked sets share a block's word; the bit sketch never exceeds the symmetric difference."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in [4, 5, 8, 20, 63, 64, 100, 500, 3000]:
        for _ in range(20):
            a = np.unique(r.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            most = len(a) // 9
            b = np.unique(np.concatenate([a[r.permutation(len(a))[most:]], r.integers(0, 2 ** 63, most, dtype=np.uint64)]))
            assert ngram_join.linked(a, b)
            level = ngram_join.band(min(len(a), len(b)))
            k = ngram_join.blocks(level, {})
            if k:
                assert np.intersect1d(ngram_join.block_words(a, level, k), ngram_join.block_words(b, level, k)).size
            sa, sb = ngram_join.parity_bits(a), ngram_join.parity_bits(b)
            w = min(len(sa), len(sb)) // 8
            far = int(np.bitwise_count(ngram_join.folded(sa, w) ^ ngram_join.folded(sb, w)).sum())
            assert far <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "v long, u long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}


def test_contained_items(spark):
    r = random.Random(9)
    word = lambda: "t%d" % r.randrange(3000)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 60] * 3)]
    items += [(100, None), (101, " ")]
    docs = []
    for k in range(120):
        body = [word() for _ in range(r.choice([0, 2, 30, 400]))]
        part = r.choice(items)[1]
        part = list((part or "").upper().split())
        for _ in range(r.randrange(0, 2 + len(part) // 12)):
            if part:
                part[r.randrange(len(part))] = word()
        at = r.randrange(len(body) + 1)
        docs.append((k, "\n".join([" ".join(body[:at]), " ".join(part), " ".join(body[at:])])))
    docs += [(500, None), (501, ""), (None, items[6][1])]
    sets = [(i, H.shingles(t)) for i, t in items]
    want = sorted(((d, i, len(s & H.shingles(t)), len(s)) for d, t in docs for i, s in sets
                   if s and 100 * len(s & H.shingles(t)) >= 80 * len(s)), key=str)
    got = contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(x.doc_id, x.item_id, x.n_shared, x.n_shingles) for x in got.collect()], key=str) == want and want
    assert contained_items(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contained_items(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_line_chunks_are_shift_resistant():
    lines = [b"line %d" % i for i in range(60)]
    for ahead in (1, 2, 3, 7):
        moved = line_dedup.chunks([b"other %d" % i for i in range(ahead)] + lines)
        a = {(f, n) for f, n in line_dedup.chunks(lines)}
        b = {(f - ahead, n) for f, n in moved}
        assert len(a & b) >= len(a) - 3
    assert sum(n for _, n in line_dedup.chunks(lines)) == 60
    assert line_dedup.chunks([]) == [] and line_dedup.chunks([b"x"]) == [(0, 1)]


def test_remove_repeated_lines(spark):
    r = random.Random(4)
    passage = [f"repeated line {i}" for i in range(12)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(r.randrange(6))] + passage + [f"end {i}"])) for i in range(8)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, "\n\n\n"), (54, "single"), (55, "single"), (None, rows[0][1])]
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        lines, gone = (t or "").encode().split(b"\n"), []
        for first, n, raw in line_dedup._eligible(t or ""):
            if raw in seen:
                gone += range(first, first + n)
            seen.add(raw)
        want[i] = None if t is None else b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
    got = {x.doc_id: x.text for x in remove_repeated_lines(frame(spark, rows)).collect()}
    assert got == want
    assert got[0] == rows[0][1] and len(got[5]) < len(rows[5][1]) and remove_repeated_lines(frame(spark, [])).count() == 0


def test_every_repeated_run_of_lines_goes(spark):
    """Against all runs of two and more lines, whatever stands around them; single repeated lines stay."""
    r = random.Random(9)
    short = [[f"run {k} {i}" for i in range(n)] for k, n in enumerate([2, 2, 3, 4, 6, 9])]
    short[2].insert(1, "")
    rows = []
    for d in range(40):
        lines = []
        for _ in range(r.randrange(1, 4)):
            lines += [r.choice(["alone", f"own {d} {r.random()}", ""]) for _ in range(r.randrange(4))] + r.choice(short)
        rows.append((d, "\n".join(lines + ["echo"] * r.randrange(6))))
    rows.append((None, rows[3][1]))
    texts = [t.split("\n") for _, t in rows]
    first, want = {}, []
    for k, t in enumerate(texts):
        gone = set()
        for n in range(2, len(t) + 1):
            for at in range(len(t) - n + 1):
                run = tuple(t[at:at + n])
                if run[0].strip() and run[-1].strip():
                    at_doc, at_line = first.setdefault(run, (k, at))
                    if at_doc != k or at >= at_line + n:
                        gone |= set(range(at, at + n))
        want.append((rows[k][0], "\n".join(x for i, x in enumerate(t) if i not in gone), len(gone)))
    got = remove_repeated_lines(frame(spark, rows)).collect()
    assert sorted([(x.doc_id, x.text, x.n_removed) for x in got], key=str) == sorted(want, key=str)
    assert all(sum(s["lines"] for s in x.removed or []) == x.n_removed for x in got)
    assert any("alone" in t for _, t, _ in want[20:])
