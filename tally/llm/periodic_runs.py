"""Periodic runs of words: suffix-tree LCE over Lyndon-root candidates.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends, at least ``min_length`` words and ``min_exponent`` periods long.  Every run holds
a Lyndon word of its period's length, for the order of words or for the inverse order, and
it is the longest Lyndon word that begins where it begins.  So each word gives two candidate
roots, which are extended to the right by the longest common extension (LCE) of two suffixes
and to the left by that of two reversed prefixes.  An LCE is the string depth of the lowest
common ancestor of two leaves of a suffix tree: Ukkonen's tree of the words and one of
their reversal, each with its Euler tour (first visits in it; the minimum depth of parents
between two leaves' visits is the depth of the ancestor) under a sparse table, so that a
query is two reads.  The tours of the tree, children in both orders of words, also give the
ranks of suffixes from which the Lyndon words follow.

Trees are built where runs can be: a run of n words repeats, a period on, every stretch of
``n - q >= least`` words, so its words are covered by repeated stretches of that length.  Words
that no such stretch covers are in no run, and a run lies in one covered part as a whole.
(Stretches are compared by hash there; a collision only makes a tree of more words.)

Words are ``[^\\x20\\x09-\\x0D]+``.  Null, empty and blank texts have no words and no runs.
Every row is by itself: repeated rows and null ids give a row each, an empty table none, and
columns but the id and text are not read.  A text is held in one task, whatever its length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import bounded_batches

MIN_LENGTH, MIN_EXPONENT = 24, 3
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_tree(s: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """Ukkonen's tree of s, whose last symbol stands nowhere else: per node where its edge
    starts and ends in s, the child by ``node * symbols + first symbol``, per node the suffix
    of a leaf or -1."""
    n = len(s)
    start, end, suffix, link = [0], [0], [-1], [0]
    child: dict[int, int] = {}
    node, edge, length, left = 0, 0, 0, 0  # the active point; suffixes that are not in the tree yet
    for i in range(n):
        c = s[i]
        left += 1
        waiting = 0  # the inner node whose link is still to come
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                suffix.append(i - left + 1)
                link.append(0)
                if waiting:
                    link[waiting] = node
                waiting = 0
            else:
                at = start[to]
                size = end[to] - at
                if length >= size:
                    edge += size
                    length -= size
                    node = to
                    continue
                if s[at + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                mid = len(start)
                child[key] = mid
                start += (at, i)
                end += (at + length, n)
                suffix += (-1, i - left + 1)
                link += (0, 0)
                child[mid * symbols + c] = mid + 1
                start[to] = at + length
                child[mid * symbols + s[at + length]] = to
                if waiting:
                    link[waiting] = mid
                waiting = mid
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, child, suffix


class Extensions:
    """Constant-time longest common extensions of the suffixes of some words (ranks from 0)."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        symbols = int(words.max()) + 2
        # the end mark 0 is less than all words, in either order
        start, end, child, suffix = suffix_tree([*(words + 1).tolist(), 0], symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.kids = np.fromiter(child.values(), np.int64, len(child))
        self.parents, self.first = keys // symbols, keys % symbols
        self.suffix = np.array(suffix, np.int64)
        self.size = np.array(end, np.int64) - np.array(start, np.int64)
        self.parent = np.zeros(len(start), np.int64)
        self.parent[self.kids] = self.parents
        tour = self._tour(self.first)
        self.rank = self._ranks(tour)
        self.visit = np.empty(self.n + 1, np.int64)
        leaf = self.suffix[tour]
        self.visit[leaf[leaf >= 0]] = np.flatnonzero(leaf >= 0)
        self.levels = self._levels(tour)

    def inverse_rank(self) -> np.ndarray:
        """Ranks of the suffixes when the order of words is turned round."""
        return self._ranks(self._tour(np.where(self.first > 0, -self.first, self.first.min() - self.first.max() - 1)))

    def _tour(self, order: np.ndarray) -> np.ndarray:
        """Nodes by their first visit, the children of a node in the given order."""
        by = np.lexsort((-order, self.parents))  # the last child first, as the stack turns them
        kids = self.kids[by].tolist()
        bounds = np.searchsorted(self.parents[by], np.arange(len(self.suffix) + 1)).tolist()
        out, stack = [], [0]
        pop, push, visit = stack.pop, stack.extend, out.append
        while stack:
            v = pop()
            visit(v)
            low, high = bounds[v], bounds[v + 1]
            if low < high:
                push(kids[low:high])
        return np.array(out, np.int64)

    def _ranks(self, tour: np.ndarray) -> np.ndarray:
        leaf = self.suffix[tour]
        leaf = leaf[leaf >= 0]
        rank = np.empty(self.n + 1, np.int64)
        rank[leaf] = np.arange(self.n + 1)
        return rank[:self.n]

    def _levels(self, tour: np.ndarray) -> list[np.ndarray]:
        """Sparse table over the tour of the string depths of the nodes' parents."""
        depth = [0] * len(tour)
        for v, p, size in zip(tour[1:].tolist(), self.parent[tour[1:]].tolist(), self.size[tour[1:]].tolist(), strict=True):
            depth[v] = depth[p] + size
        levels = [np.array(depth, np.int64)[self.parent[tour]].astype(np.int32)]
        width = 1
        while 2 * width <= len(tour):
            levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
            width *= 2
        return levels

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes from a[i] and b[i] begin with in common; a[i] <> b[i], both up to n."""
        u, v = self.visit[a], self.visit[b]
        low, high = np.minimum(u, v) + 1, np.maximum(u, v)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k) + 1])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place: up to the next smaller suffix."""
    n = len(rank)
    ranks, out, stack = rank.tolist(), [0] * n, []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            j = stack.pop()
            out[j] = i - j
        stack.append(i)
    for j in stack:
        out[j] = n - j
    return np.array(out, np.int64)


def runs_of_part(words: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of the runs of one part, by start and period."""
    n = len(words)
    words = np.unique(words, return_inverse=True)[1]
    ahead = Extensions(words)
    place = np.arange(n)
    roots = np.unique(np.concatenate([place * (n + 1) + lyndon_lengths(r) for r in (ahead.rank, ahead.inverse_rank())]))
    at, period = roots // (n + 1), roots % (n + 1)
    right = ahead.lce(at, at + period)
    # the leftmost root of a run begins less than a period after it, so the rest is to the right of it
    keep = (min_exponent * period <= n) & (right + 2 * period > min_exponent * period)
    at, period, right = at[keep], period[keep], right[keep]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    back = Extensions(words[::-1])
    left = back.lce(n - at, n - at - period)
    length = left + period + right
    keep = (length >= min_length) & (length >= min_exponent * period)
    return np.unique(np.stack([at - left, length, period], 1)[keep][:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def parts_with_repeats(ids: np.ndarray, least: int, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """The parts that stretches of ``least`` words cover which stand at most a period apart twice."""
    n = len(ids)
    if n < min_length:
        return []
    h, width = ids.astype(np.uint64) * BASE, 1
    while width < least:  # a hash of so many words from hashes of half as many (overlapping where need be)
        step = min(width, least - width)
        h = h[:-step] * SPREAD + (h[step:] ^ (h[step:] >> np.uint64(29))) * BASE
        width += step
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (np.diff(order) <= n // min_exponent))
    if not len(near):
        return []
    marked = np.zeros(n + 1, np.int64)
    twice = np.unique(np.concatenate([order[near], order[near + 1]]))
    np.add.at(marked, twice, 1)
    np.add.at(marked, np.minimum(twice + least, n), -1)
    covered = np.concatenate([[0], np.cumsum(marked[:n]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= min_length]


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of every run of a sequence of word ids, by start and period."""
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    found = [runs_of_part(ids[a:b], min_length, min_exponent) + [a, 0, 0] for a, b in parts_with_repeats(ids, least, min_length, min_exponent)]
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(inside)[:n] == 0


def _found(min_length: int, min_exponent: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows, collapsed = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                known = {w: i for i, w in enumerate(dict.fromkeys(words))}
                runs = runs_of(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), min_length, min_exponent)
                counts.append(len(words))
                rows.append([{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()])
                if len(runs):
                    keep = kept_words(len(words), runs)
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, schema.field("runs").type),
                 pa.array(collapsed, pa.binary())], schema=schema)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row the id, ``n_words``, ``runs`` (start, length, period in words, by start and period)
    and ``collapsed``: the words without those that a run holds after its first period, joined by one space."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = pa.schema([pa.field(id_col, pa.int64()), pa.field("n_words", pa.int64()),
                        pa.field("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
                        pa.field("collapsed", pa.binary())])
    out = texts.mapInArrow(_found(min_length, min_exponent, schema), f"`{id_col}` bigint, n_words bigint, runs {RUN}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
