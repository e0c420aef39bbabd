"""Tokens, packing, the token file and sharding: round trips and the laws they keep."""
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tally.llm import packing, tokens
from tally.llm.packing import configurations, cut, pack
from tally.llm.sharding import interleaved_shards
from tally.llm.token_file import EliasFano, offsets, token_file, write_token_file
from tally.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, piece string, length string, id string, u string, b string"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def ids_of(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *["clash"] * 5) for i, t, s in rows], SCHEMA)


PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "'ll", "re", "1", "é", "#", ".", " the", "\x00", "日本", "\x85", "\xa0", "²", "ª",
         "<|endoftext|>", "😀"]


def test_encoder_equals_the_library(encoder, monkeypatch):
    r = random.Random(0)
    texts = ["".join(r.choices(PARTS, k=r.randrange(14))) for _ in range(4000)] + [None, "", "word " * 5000]
    for limit in (1 << 20, 9):
        monkeypatch.setattr(tokens, "CHARS", limit)
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == ids_of(encoder, text), text


def test_encoder_forgets(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BITS", 6)
    small = Encoder(PATH)
    for k in range(6):
        text = " ".join(f"w{k}x{i}" for i in range(6))
        assert next(small.encode([text])).tolist() == ids_of(encoder, text)


ROWS = [(1, "short text", "a"), (2, None, "a"), (3, "", None), (4, "many words " * 900, "b"), (5, "short text", "a"), (5, "short text", "a"),
        (None, "no id", "c"), (7, "x" * 20_000, "b")]


def test_pack(spark, encoder):
    got = pack(frame(spark, ROWS), PATH, capacity=64).collect()
    want = Counter()
    for i, t, _ in ROWS:
        ids = [*ids_of(encoder, t), 2]
        for k, (at, n) in enumerate(cut(len(ids), 64)):
            want[i, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert pack(frame(spark, []), PATH).count() == 0


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30))
@settings(max_examples=25, deadline=None)
def test_configurations_hold_the_histogram(histogram):
    made = configurations(histogram, 50)
    held = Counter()
    for config, copies in made:
        assert copies > 0 and sum(k * n for k, n in config.items()) <= 50
        held.update({k: n * copies for k, n in config.items()})
    assert held == Counter(histogram)
    bound = -(-sum(k * n for k, n in histogram.items()) // 50)
    first_fit = len(packing.best_fit(Counter(histogram), 50))
    assert bound <= sum(c for _, c in made) <= 1.02 * first_fit + 3


def test_packing_is_near_the_bound():
    r = random.Random(2)
    histogram = Counter(min(1024, int(r.lognormvariate(6, 0.8)) + 1) for _ in range(60_000))
    made = sum(c for _, c in configurations(histogram, 1024))
    bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
    assert made <= 1.003 * bound


def test_cut_pieces():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(sizes):
    values = np.cumsum(sizes, dtype=np.int64)
    ef = EliasFano.encode(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    if len(values) > 300:
        assert 8 * (len(ef.low) + len(ef.high) + len(ef.hints)) < 64 * len(values)
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_token_file(spark, encoder, tmp_path):
    got = token_file(frame(spark, ROWS), PATH, 50257).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))
    at, want = 0, []
    for i, t, _ in rows:
        ids = [*ids_of(encoder, t), 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == want
    assert token_file(frame(spark, []), PATH, 50257).count() == 0
    path = str(tmp_path / "wide")
    write_token_file(frame(spark, ROWS), path, PATH, 1 << 20)
    seg = spark.read.parquet(path).filter("n_docs > 0").orderBy("part").first()
    assert seg.width == 4 and offsets(spark, path, seg.part, seg.nth, [seg.n_docs - 1]) == [seg.n_tokens]


@pytest.mark.parametrize("n,sources", [(0, 1), (5, 2), (2000, 40), (3000, 2)])
def test_shards(spark, n, sources):
    r = random.Random(n)
    rows = [(i, None if i % 7 == 0 else "é" * (i % 9), None if i % 11 == 0 else f"s{min(r.randrange(3 * sources), sources)}") for i in range(n)]
    rows += rows[:3]
    got = interleaved_shards(frame(spark, rows), 24).collect()
    assert len(got) == len(rows)
    counts, slots = Counter(x.shard for x in got), {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(rows) >= 24:
        assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    text = {i: t or "" for i, t, _ in rows}
    assert all((x.size, x.text_crc32) == (8 + len(text[x.doc_id].encode()), zlib.crc32(text[x.doc_id].encode())) for x in got)
    if n >= 2000:  # every shard matches the mixture
        whole = Counter(x.source for x in got)
        for shard in range(24):
            part = Counter(x.source for x in got if x.shard == shard)
            assert all(abs(part[s] - whole[s] / 24) <= 3 for s in whole)
    again = interleaved_shards(frame(spark, rows).repartition(7), 24).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_words_of_one_hash_keep_their_own_ids(encoder):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    for texts in ([a, b], [b, a, "x " + a], [a + " " + b + " end"]):
        assert [x.tolist() for x in Encoder(PATH).encode(texts)] == [ids_of(encoder, t) for t in texts]


@pytest.mark.parametrize("histogram", [{k: 200 for k in range(513, 1025)}, {k: 200 for k in range(400, 1025)}])
def test_long_pieces_are_packed_by_the_program(histogram, monkeypatch):
    """Pieces over half a sequence: the one-by-one best fit never sees more than FEW of them."""
    seen, plain = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda left, capacity: seen.append(sum(left.values())) or plain(left, capacity))
    out = configurations(histogram, 1024)
    total = Counter()
    for config, copies in out:
        assert sum(k * m for k, m in config.items()) <= 1024
        total.update({k: m * copies for k, m in config.items()})
    assert total == Counter(histogram) and max(seen) <= packing.FEW
    need = sum(n for k, n in histogram.items() if k > 512)
    assert sum(n for _, n in out) <= 1.05 * need


def test_best_fit_of_classes():
    r = random.Random(8)
    for _ in range(50):
        left = Counter({r.randrange(1, 1025): r.randrange(1, 10_000) for _ in range(r.randrange(1, 60))})
        total, out = Counter(), packing.best_fit_of_classes(left, 1024)
        for config, copies in out:
            assert copies > 0 and sum(k * m for k, m in config.items()) <= 1024
            total.update({k: m * copies for k, m in config.items()})
        assert total == left and sum(n for _, n in out) <= 1.5 * sum(k * n for k, n in left.items()) / 1024 + len(left) + sum(
            n for k, n in left.items() if k > 512)


def test_shards_equal_their_definition(spark):
    """Shard and slot of every row from the rows' hashes, by sorting in plain Python."""
    from pyspark.sql import functions as F

    from tally.llm.sharding import unit

    r = random.Random(6)
    rows = [(i, "x" * r.randrange(30), r.choice(["a", "a", "a", "b", None, f"s{i % 40}"])) for i in range(700)] + [(3, "x", "a"), (None, None, "b")]
    df = frame(spark, rows)
    hashes = df.select("doc_id", "text", "source", unit(F.col("doc_id"), seed=17).alias("u"), unit(F.col("source"), seed=18).alias("p")).collect()
    kept = [(h.source, h.u, h.doc_id, len(h.text or "") + 8, zlib.crc32((h.text or "").encode()), h.p) for h in hashes]
    none_first = lambda x: (x is not None, x)
    placed = []
    for source in {k[0] for k in kept}:
        own = sorted((k for k in kept if k[0] == source), key=lambda k: (k[1], none_first(k[2]), k[3], k[4]))
        placed += [((rank + k[5] / 2.0 ** 63) / len(own), *k) for rank, k in enumerate(own)]
    placed.sort(key=lambda k: (k[0], k[2], none_first(k[1]), none_first(k[3]), k[4], k[5]))
    n, shards, want = len(placed), 24, []
    for pos, (_, source, _, i, size, crc, _) in enumerate(placed):
        shard = pos * shards // n
        want.append((i, source, size, crc, shard, pos - (shard * n + shards - 1) // shards))
    got = [tuple(x) for x in interleaved_shards(df, shards).select("doc_id", "source", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
