"""SimHash near-dedup: a Gray-order hierarchical index over 64-bit fingerprints.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's four-word shingles
(repeats included; words ``[^\\x20\\x09-\\x0D]+`` of the text lower-cased A-Z, joined by a space; a
text of fewer words is one shingle, one without words has fingerprint zero).  A hash is the
shingle's XXH64 of UTF-8 with seed 42.  Fingerprints link at ``distance`` differing bits or fewer.

Distinct fingerprints are indexed, so copies cost nothing.  Of ``distance + 1`` stretches of the
64 bits, linked fingerprints agree in one as a whole: a fingerprint goes, once for each stretch,
to the group of those with the same bits there.  A group of more than ``MOST`` is dealt in the
same way by stretches of the bits that it doesn't share yet, and so on; members differ, so
groups end small.  No group is capped.

A group is sorted by Gray rank, where neighbours differ in few bits.  Eight neighbours make a
node, eight nodes an upper node, up to one root; a node has the mask of the bits that all below
it share, and their pattern.  The index is joined with itself from the root down: a pair of
nodes adds the differences in the bits that it shares and its parents didn't, and the pair goes,
with all pairs below it, when the sum passes ``distance``.  Pairs of nodes whose fingerprints
are all in one component already go as well, as no link there changes a component.  Of the
links found in a group only those of a spanning forest leave the task.

Null and empty texts have fingerprint zero and link like any other.  A row with a null id is
linked like others, but null is not the smallest id of a component (its component is null if
no row in it has an id).  Repeated rows are rows of one fingerprint.  An empty table gives an empty
result; columns but the id and text are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import attach_groups, bounded_batches, salted, same, shuffle_partitions, written
from tally.llm.components import components

WIDTH, SEED, DISTANCE = 4, 42, 4
MOST = 2048  # fingerprints of a group that is joined in one piece
FAN = 8
BUNCH = 100_000  # fingerprints whose groups a task joins together
SLICE = 20_000  # pairs of nodes opened at once
ALL = (1 << 64) - 1


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The SimHash of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    k = max(1, len(words) - width + 1)
    ends = (start + size)[len(words) - k:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(start[:k].tolist(), ends.tolist(), strict=True)], np.uint64, k)
    ones = np.zeros(64, np.int64)
    for x in range(0, k, 4096):
        ones += np.unpackbits(h[x:x + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k, bitorder="little").tobytes(), "little")


def _fingerprints(width: int, seed: int) -> Callable:
    fields = pa.schema([("id", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], schema=fields)

    return run


def stretches(mask: int, count: int) -> list[int]:
    """The mask with each of ``count`` stretches, as even as can be, of the bits that it doesn't have."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _dealt(count: int) -> Callable:
    """Each (f, mask) once for every further stretch."""
    fields = pa.schema([("f", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, mask = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for m in np.unique(mask).tolist():
                own = f[mask == m]
                for deeper in np.array(stretches(m & ALL, count), np.uint64).view(np.int64).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), deeper))], schema=fields)

    return run


def gray_rank(f: Column) -> Column:
    """The place of a 64-bit pattern in the Gray code's order, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, shift))
    return f.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class Index:
    """The hierarchical index of some groups, each sorted by Gray rank."""

    def __init__(self, f: np.ndarray, group: np.ndarray):
        self.values, self.masks, self.starts = [f], [np.full(len(f), ALL, np.uint64)], []
        while True:
            first = np.concatenate([[True], group[1:] != group[:-1]])
            at = np.flatnonzero(first)
            place = np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))
            if not place.any():
                break
            start = np.flatnonzero(place % FAN == 0)
            value, mask = self.values[-1], self.masks[-1]
            spread = np.repeat(value[start], np.diff(np.append(start, len(value))))
            shared = np.bitwise_and.reduceat(mask, start) & ~np.bitwise_or.reduceat(value ^ spread, start)
            self.values.append(value[start] & shared)
            self.masks.append(shared)
            self.starts.append(np.append(start, len(value)))
            group = group[start]
        self.label = np.arange(len(f))

    def _uniform(self) -> list[np.ndarray]:
        """Per level, the component of a node below which all are in one, else -1 - node."""
        low = high = self.label
        out = [low]
        for start in self.starts:
            low, high = np.minimum.reduceat(low, start[:-1]), np.maximum.reduceat(high, start[:-1])
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
        return out

    def _merge(self, a: np.ndarray, b: np.ndarray) -> bool:
        merged = False
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return merged
            merged, parent = True, np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]

    def forest(self, distance: int) -> np.ndarray:
        """Links all with the first of their component; sets ``label``."""
        if not self.starts:
            return self.label
        f, top = self.values[0], len(self.starts)
        group = np.arange(len(self.values[top]))
        for start in reversed(self.starts):
            group = np.repeat(group, np.diff(start))
        near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(f[1:] ^ f[:-1]) <= distance))
        self._merge(near, near + 1)
        uniform = self._uniform()
        root = np.arange(len(self.values[top]))
        work = [(top, root, root, np.zeros(len(root), np.int64))]
        while work:
            level, u, v, far = work.pop()
            open_ = uniform[level][u] != uniform[level][v]
            open_ |= (u == v) & (uniform[level][u] < 0)
            u, v, far = u[open_], v[open_], far[open_]
            if len(u) > SLICE:
                work += [(level, u[x:x + SLICE], v[x:x + SLICE], far[x:x + SLICE]) for x in range(0, len(u), SLICE)]
                continue
            if not len(u):
                continue
            start, seen = self.starts[level - 1], self.masks[level][u] & self.masks[level][v]
            nu, nv = start[u + 1] - start[u], start[v + 1] - start[v]
            of = np.repeat(np.arange(len(u)), nu * nv)
            place = np.arange(len(of)) - np.repeat(np.cumsum(nu * nv) - nu * nv, nu * nv)
            a, b = start[u[of]] + place // nv[of], start[v[of]] + place % nv[of]
            keep = (a < b) | ((a == b) & (level > 1))
            a, b, of = a[keep], b[keep], of[keep]
            value, mask = self.values[level - 1], self.masks[level - 1]
            more = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b] & ~seen[of])
            total = far[of] + more
            near = total <= distance
            a, b, total = a[near], b[near], total[near]
            if level > 1:
                work.append((level - 1, a, b, total))
            elif self._merge(a, b):
                uniform = self._uniform()
        return self.label


def _joined(distance: int) -> Callable:
    """Spanning links of the groups of a task, whose rows come group by group in Gray order."""
    fields = pa.schema([("v", pa.int64()), ("u", pa.int64())])

    def links(f: np.ndarray, mask: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        label = Index(f.view(np.uint64), group).forest(distance)
        at = np.flatnonzero(label != np.arange(len(f)))
        return pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(f[label[at]])], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= BUNCH:
                _, mask, key = held
                last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield links(*[h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield links(*held)

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(v, u) of distinct fingerprints (column ``f``): spanning links of all pairs within the distance."""
    tasks = shuffle_partitions(prints.sparkSession)
    found, rows = [], prints.select("f", F.lit(0).cast("long").alias("mask"))
    while True:
        rows = rows.mapInArrow(_dealt(distance + 1), "f bigint, mask bigint").withColumn("key", F.col("f").bitwiseAND(F.col("mask")))
        large = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select("mask", "key")
        large = written(large, "simhash-large")
        last = large.isEmpty()
        grouped = rows if last else same(rows, large, ["mask", "key"], "left_anti")
        ordered = grouped.repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("f")))
        found.append(written(ordered.select("f", "mask", "key").mapInArrow(_joined(distance), "v bigint, u bigint"), "simhash-links"))
        if last:
            break
        rows = same(rows, large, ["mask", "key"], "left_semi").select("f", "mask")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                      width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Id, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable by links) of every row."""
    if not 0 <= distance <= 10:  # beyond, a group of more than MOST could have no stretches left
        raise ValueError("distance must be in 0..10")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = written(texts.mapInArrow(_fingerprints(width, seed), "id bigint, f bigint"), "simhash-rows")
    prints = written(rows.groupBy("f").agg(F.min("id").alias("id")), "simhash-prints")
    labels = components(near_links(prints, distance))
    named = prints.join(labels, prints.f == labels.v, "left").select("f", "id", F.coalesce("component", "f").alias("component"))
    named = attach_groups(salted(named, "f"), ["component"], {"least": F.min("id")}, {"least": F.min("least")})
    named = written(named.select("f", F.col("least").alias("component_id")), "simhash-named")
    full = attach_groups(salted(rows, "id"), ["f"], {"rows": F.count("*")}, {"rows": F.sum("rows")}, lambda keys: keys.join(named, "f"))
    return full.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
