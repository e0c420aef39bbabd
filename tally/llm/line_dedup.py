"""Line dedup by content-defined chunks of lines, down to every pair of lines.

A text is cut at line breaks, and lines are gathered into chunks whose ends a rolling hash
over the hashes of the last two lines decides: the same lines are cut alike wherever they
stand, however many lines come before.  The finest windows are all pairs of lines that are
not blank and follow each other, with the blank lines between them.  A window that occurs
again, anywhere in the corpus, is removed where it occurs after its first place (smallest
id, then position) and does not overlap it; hashes only find candidates, the bytes of a
window are compared before it goes.

So every repeated run that begins and ends with a line that is not blank and holds two such
lines or more goes, wherever chunks end: all its pairs are repeated.  Chunks spare the pairs
inside them the comparison.  Single repeated lines and the blank lines around a run stay,
and of every line its first occurrence stays.
A null text stays null, an empty one empty.  Of repeated rows with one id the chunks count
as often as they occur, and every row loses what any of them loses at that place.  Null ids
come last.  An empty table gives an empty result; columns but the id and text are not read.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import attach_groups, bounded_batches, salted, same, written

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ENDS_EVERY = 3  # a chunk ends at one of so many lines on average, after its second line
LEVEL = 6  # of the compression of texts on their way to the spans
MOST_LINES = 64  # a longer chunk is ended (the next line begins another)


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, lines) of the chunks of a text."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolled = h * BASE
    rolled[1:] += h[:-1]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * SPREAD
    out, first = [], 0
    for end in (np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(ENDS_EVERY) == 0) + 1).tolist() + [len(lines)]:
        while end - first > MOST_LINES:
            out.append((first, MOST_LINES))
            first += MOST_LINES
        if end - first > 1 or end == len(lines) and end > first:
            out.append((first, end - first))
            first = end
    return out


def _eligible(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the chunks, without blank lines at their ends, and of the pairs."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    filled = [k for k, x in enumerate(lines) if x.strip()]
    if len(filled) > 1:
        windows = {(a, b - a + 1) for a, b in pairwise(filled)}
        for first, n in chunks(lines):
            inside = filled[bisect_left(filled, first):bisect_left(filled, first + n)]
            if len(inside) > 1:
                windows.add((inside[0], inside[-1] - inside[0] + 1))
        for first, n in sorted(windows):
            yield first, n, b"\n".join(lines[first:first + n])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, out = [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            for first, n, raw in _eligible(text or ""):
                d = xxhash.xxh3_128_intdigest(raw)
                row.append(r)
                out.append((first, n, _signed(d >> 64), _signed(d & (1 << 64) - 1)))
        if row:
            cols, types = zip(*out, strict=True), [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=["id", "first", "lines", "hi", "lo"])


def packed(docs: DataFrame) -> DataFrame:
    """(id, text) with the texts compressed, as they are to be shuffled."""
    schema = T.StructType([docs.schema["id"], T.StructField("text", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for batch in batches:
            raw = [None if t is None else tool.compress(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "text"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, schema)


def _unpacked(column: pa.Array) -> list[str | None]:
    tool = zstandard.ZstdDecompressor()
    return [None if x is None else tool.decompress(x).decode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _chunk_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, out = [], []
        for r, (text, wanted) in enumerate(zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
            asked, reach = set(), 0
            for first, n, goes in sorted(((w["first"], w["lines"], w["goes"]) for w in wanted), key=lambda w: (w[0], -w[1])):
                if goes and first + n <= reach:
                    continue  # inside a chunk that goes
                asked.add((first, n))
                reach = max(reach, first + n) if goes else reach
            for first, n, raw in _eligible(text or ""):
                if (first, n) in asked:
                    row.append(r)
                    out.append((first, n, raw))
        if row:
            first, n, raw = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(first, pa.int32()), pa.array(n, pa.int32()),
                                              pa.array(raw, pa.binary())], names=["id", "first", "lines", "raw"])


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The window rows of groups of two and more, with the place of the group's first occurrence."""
    place = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "first"))
    out = attach_groups(salted(rows, "id", "first"), keys, {"place": place, "size": F.count("*")},
                        {"place": F.min("place"), "size": F.sum("size")}, lambda groups: groups.filter("size > 1").drop("size"))
    return out.select("*", F.col("place.id").alias("k_id"), F.col("place.first").alias("k_first")).drop("place")


def _is_first() -> Column:
    return F.col("id").eqNullSafe(F.col("k_id")) & (F.col("first") == F.col("k_first"))


def _goes() -> Column:
    """Stands after the first occurrence and does not overlap it."""
    return ~(F.col("id").eqNullSafe(F.col("k_id")) & (F.col("first") < F.col("k_first") + F.col("lines")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, first, lines) of the windows to remove, but for pairs inside others; docs are (id, text)."""
    place = [T.StructField("id", docs.schema["id"].dataType), T.StructField("first", T.IntegerType()), T.StructField("lines", T.IntegerType())]
    schema = T.StructType([*place, T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])
    keys = ["hi", "lo"]
    rows = written(docs.mapInArrow(_chunk_rows, schema), "line-chunks")
    many = written(_firsts(rows, keys), "line-repeats")
    # windows of one document; as many documents as the corpus has repeats, so always a shuffled join
    wanted = many.groupBy("id").agg(F.collect_set(F.struct("first", "lines", _goes().alias("goes"))).alias("wanted")).hint("merge")
    texts = same(packed(docs), wanted, ["id"], "inner").select("id", "text", "wanted").mapInArrow(
        _chunk_bytes, T.StructType([*place, T.StructField("raw", T.BinaryType())]))
    # of one place, rows repeated with one id may hold different texts: each is held against the first's bytes
    texts = written(same(texts, many, ["id", "first", "lines"], "inner").select(
        *texts.columns, *[c for c in many.columns if c not in texts.columns]), "line-bytes")
    reps = texts.filter(_is_first()).groupBy(*keys).agg(F.min("raw").alias("rep"))
    spread = texts.select(*keys, "_salt").distinct().join(reps, keys)
    held = texts.join(spread, [*keys, "_salt"])
    equal = held.filter((F.col("raw") == F.col("rep")) & _goes()).select("id", "first", "lines")
    # other bytes under a 128-bit hash of the group: grouped anew by the bytes themselves
    other = held.filter(F.col("raw") != F.col("rep")).select("id", "first", "lines", "raw")
    again = _firsts(other, ["raw"]).filter(_goes()).select("id", "first", "lines")
    return equal.unionByName(again).distinct()


def merged(spans: list[dict]) -> list[dict]:
    """Sorted spans, those that touch as one."""
    out: list[dict] = []
    for s in spans:
        if out and s["first"] <= out[-1]["first"] + out[-1]["lines"]:
            out[-1]["lines"] = max(out[-1]["lines"], s["first"] + s["lines"] - out[-1]["first"])
        else:
            out.append(dict(s))
    return out


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the text without repeated runs, n_lines, n_removed (lines) and the removed spans (first, lines)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_chunks(rows).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("first").cast("long").alias("first"), F.col("lines").cast("long").alias("lines")))).alias("spans"))
    full = same(packed(rows), spans.hint("merge"), ["id"], "left").select("id", "text", "spans")
    schema = T.StructType([full.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("removed", full.schema["spans"].dataType)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed, removed = [], [], [], []
            for text, spans in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                keep = np.ones(len(lines), bool)
                for s in spans or []:
                    keep[s["first"]:s["first"] + s["lines"]] = False
                texts.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k) if text else text)
                n_lines.append(len(lines))
                n_removed.append(int((~keep).sum()))
                removed.append(spans and merged(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                                              pa.array(n_removed, pa.int64()), pa.array(removed, batch.schema.field(2).type)], names=schema.names)

    return full.mapInArrow(remove, schema).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
