"""Best-fit packing of documents into sequences by a configuration linear program.

A document is its token ids and an end id.  A document longer than a sequence is cut
into whole sequences, its first piece may be shorter; nothing else is cut.  Piece
lengths form a histogram of at most ``capacity`` classes, whatever the corpus: on it
the driver solves the configuration program (as few sequences as cover all classes)
by multiplicative weights, pricing configurations by a knapsack table, rounds the
solution down, solves again for what is left, and places the last pieces best fit
first.  The plan says which ranks of a class go where, and Spark ranks the pieces.

A null or empty text is its end id alone.  Repeated rows and ids are packed each for
itself; an empty table gives an empty result; columns but the id and text are not read.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import bounded_batches, written
from tally.llm.tokens import Encoder

STEPS = 80  # most prices set in one solution
ETA = 4.0  # how fast the weight of a covered class falls
PACE = 0.05  # share of a class that one configuration may cover between two prices
NEAR = 0.02  # configurations so near the best one are used too
COVERS = (0.9, 0.5)  # share of every class that a solution covers; the rest keeps the mixture
FEW = 20_000  # pieces that best fit places one by one
RANKS = 40  # bits of a rank within its length class


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack table: the most value that fits each capacity, and the class to
    take first there (-1: leave one token free)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            total = best[c - lengths[:k]] + value[:k]
            at = int(total.argmax())
            if total[at] > best[c]:
                best[c], take[c] = total[at], at
    return best, take


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, cover: float) -> dict[tuple[int, ...], float]:
    """Configurations (classes, sorted) and how often to use each, which cover this share of
    every class.

    Multiplicative weights: a class is worth its length times a factor that falls with
    the share of it covered so far.  One knapsack table prices the best configuration
    around every class; those near the best of all are used a little, and weights move.
    """
    covered, used = np.zeros(len(lengths)), {}
    for _ in range(STEPS):
        open_ = np.flatnonzero(covered < cover)
        if not len(open_):
            break
        value = lengths[open_] * np.exp(-ETA * (covered[open_] - covered[open_].min()))
        best, take = price(value, lengths[open_], capacity)
        around = value + best[capacity - lengths[open_]]
        for i in np.flatnonzero(around >= (1 - NEAR) * best[capacity])[::-1].tolist():
            config, room = [open_[i]], capacity - int(lengths[open_[i]])
            while room > 0:
                if take[room] < 0:
                    room -= 1
                else:
                    config.append(open_[take[room]])
                    room -= int(lengths[open_[take[room]]])
            key = tuple(sorted(config))
            at, many = np.unique(key, return_counts=True)
            step = float((need[at] * np.clip(cover - covered[at], 0, PACE) / many).min())
            if step > 0:
                covered[at] += step * many / need[at]
                used[key] = used.get(key, 0.0) + step
    return used


def best_fit(left: Counter, capacity: int) -> list[Counter]:
    """The last pieces, longest first, each into the fullest sequence that takes it."""
    free: list[tuple[int, int]] = []
    out: list[Counter] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            at = bisect_left(free, (length, -1))
            if at < len(free):
                room, i = free.pop(at)
            else:
                room, i = capacity, len(out)
                out.append(Counter())
            out[i][length] += 1
            insort(free, (room - length, i))
    return out


def best_fit_of_classes(left: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, of all equal pieces at once: work goes with the classes, not the pieces."""
    by_room: dict[int, list[list]] = {}  # [configuration, copies] by the room that they have
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                for m, copies in ((capacity // length, n // (capacity // length)), (n % (capacity // length), 1)):
                    if m and copies:
                        by_room.setdefault(capacity - m * length, []).append([Counter({length: m}), copies])
                break
            config, copies = by_room[room].pop()
            if copies > n:
                by_room[room].append([config, copies - n])
            elif not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append([config + Counter({length: 1}), min(copies, n)])
            n -= min(copies, n)
    return [(config, copies) for same in by_room.values() for config, copies in same]


def rounded(left: Counter, capacity: int, cover: float) -> tuple[list[tuple[Counter, int]], Counter]:
    """A fractional solution rounded down: (configuration, copies), and the pieces it leaves."""
    lengths = np.array(sorted(left), np.int64)
    need = np.array([left[x] for x in lengths.tolist()], float)
    used, out, owed = fractional(lengths, need, capacity, cover), [], 0.0
    full = {key: x for key, x in used.items() if lengths[list(key)].sum() == capacity}
    if 2 * sum(full.values()) > sum(used.values()):
        used = full  # what the others hold is left to the next round
    for key, x in sorted(used.items(), key=lambda kx: (-kx[1], kx[0])):
        config = Counter(lengths[list(key)].tolist())
        owed += x
        copies = min(int(owed), *(left[k] // m for k, m in config.items()))
        if copies > 0:
            out.append((config, copies))
            left = left - Counter({k: m * copies for k, m in config.items()})
            owed -= copies
        owed = min(owed, 1.0)
    return out, left


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(configuration, copies) that hold exactly the pieces of the histogram.

    A solution is rounded down and solved again for what it left, which keeps the mixture
    of classes; each round leaves about a tenth (two thirds of pieces over half a sequence).
    Should a round place next to nothing, the classes are placed by best fit, many equal pieces
    at once.  Of the last few pieces, as much is left to best fit as makes the fewest sequences.
    """
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    out: list[tuple[Counter, int]] = []
    while (before := sum(left.values())) > FEW:
        more, left = rounded(left, capacity, COVERS[0])
        out += more
        if 10 * sum(left.values()) > 9 * before:
            out += best_fit_of_classes(left, capacity)
            left = Counter()
    ends = []
    for cover in COVERS:
        more, rest = rounded(left, capacity, cover) if left else ([], left)
        ends.append(more + [(c, 1) for c in best_fit(rest, capacity)])
    return out + min(ends, key=lambda end: sum(n for _, n in end))


@dataclass
class Plan:
    """Runs of ranks of a length class, sorted by ``key`` = length and first rank."""

    key: np.ndarray
    sequence: np.ndarray  # the first of the run's sequences
    many: np.ndarray  # pieces of the class in each
    offset: np.ndarray  # place of the first of them
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = (length.astype(np.int64) << RANKS) + rank
        run = np.searchsorted(self.key, code, side="right") - 1
        inside = code - self.key[run]
        return self.sequence[run] + inside // self.many[run], self.offset[run] + inside % self.many[run] * length


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    runs, next_rank, next_sequence = [], Counter(), 0
    for config, copies in configurations(histogram, capacity):
        at = 0
        for length, m in sorted(config.items(), reverse=True):
            runs.append(((length << RANKS) + next_rank[length], next_sequence, m, at))
            next_rank[length] += m * copies
            at += m * length
        next_sequence += copies
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*(table[:, i].copy() for i in range(4)), next_sequence)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, n > 0."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, crc, and the piece's place (``part``,
    ``nth``) among the pieces of its length in its task."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("part", "int"), ("nth", "long")]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, out = [], []
            for r, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for k, (at, n) in enumerate(cut(len(raw) // 4, capacity)):
                    row.append(r)
                    out.append((k, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), part, int(seen[n])))
                    seen[n] += 1
            if row:
                cols = list(zip(*out, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=schema.names)

    return rows.mapInArrow(pieces, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with the sequence that takes it and its offset there."""
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("below", below), "pack-counts")
    # at most ``capacity`` rows, whatever the corpus
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    schema = T.StructType([*(f for f in pieces.schema if f.name not in ("part", "nth")),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                sequence, offset = made.place(t["length"].to_numpy(), t["rank"].to_numpy())
                t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                yield from t.to_batches()

    ranked = pieces.join(counts.select("part", "length", "below"), ["part", "length"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("below")).alias("rank"))
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
