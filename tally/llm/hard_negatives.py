"""Hard-negative mining: cover trees over norm-augmented vectors, searched best-first.

A vector's components become ``floor(scale * x)``; a row's score is its integer inner product
with an anchor, higher first, ties by smaller id.  An anchor's positives are its first
``n_positives`` other rows of its label; for each, the negatives are the first ``n_negatives`` rows of
other labels with ``low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score``.

One more component, ``sqrt(M^2 - |x|^2)``, puts every candidate on the sphere of the largest norm
M (an anchor has 0 there, so products stay).  On it, products order like angles, and a node
whose points lie within an angle r of its centre holds only products between
``|a| M cos(t + r)`` and ``|a| M cos(t - r)``, t being the angle of anchor and centre.  The first
level of the tree are ``CENTRES`` centres, chosen farthest-first from a sample of ``SAMPLE`` rows;
every row is indexed below its nearest centre, in blocks of about ``BLOCK`` rows, and a block is a
cover tree of its own, whose levels' radii shrink by ``SHRINK``.  Anchors come to the blocks of
those centres whose bounds reach their windows.  In a block, each anchor opens leaves in the
order of their upper bounds, skips those whose bounds lie outside its windows or below its k-th
best score so far, and scores the rows of opened leaves exactly.  The sample's own scores are
the first bound of the k-th best.  Bounds are widened by more than rounding can move them, and
every result is an exact integer, so the search misses nothing.

Rows with a null id, label or vector, or a null or non-finite component, take no part.  An
empty vector scores 0; of vectors of unlike lengths the shorter one counts as padded with zeros.
"Other rows" are rows with another id; rows equal in id, label and vector count once.  Rows that
repeat an id with another label or vector are rows of their own; as anchors they are searched
each by itself.  Squared norms must stay below 2^53, as a long can't hold all products beyond;
larger ones end the job with an error.  An empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.common import bounded_batches, shuffle_partitions, written

SAMPLE, CENTRES = 2048, 32
BLOCK = 4096  # rows of a block, whose tree one task holds
LEAF = 64
SHRINK = 0.8
CHUNK = 256  # searches that go through a block together
EXACT = float(1 << 53)




class Tree:
    """A cover tree over the rows of one block.  A node has a centre, the largest angle between
    it and a row below, its parent (numbered before it) and rows of its own that no child covers."""

    def __init__(self, x: np.ndarray, largest: float):
        self.points = augmented(x, largest)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.parent: list[int] = []
        self.rows: list[np.ndarray] = []
        self._grow()

    def _node(self, centre: int, cosines: np.ndarray, parent: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(np.arccos(np.clip(cosines.min(), -1, 1))))
        self.parent.append(parent)
        self.rows.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _grow(self) -> None:
        """Each level covers a node's rows by balls of a smaller radius, the first around the node's centre."""
        rows, cosines = np.arange(len(self.points)), self.points @ self.points[0]
        work = [(self._node(0, cosines, -1), rows, cosines)]
        while work:
            node, rows, cosines = work.pop()
            if len(rows) <= LEAF or self.radius[node] < 1e-6:
                self.rows[node] = rows
                continue
            reach, centres, found = np.cos(self.radius[node] * SHRINK), np.array([self.centre[node]]), True
            first = True
            while found and len(rows):
                found, first, left = first, False, np.ones(len(rows), bool)
                near = self.points[rows] @ self.points[centres].T
                for i, c in enumerate(centres.tolist()):
                    ball = np.flatnonzero(left & (near[:, i] >= reach))
                    if len(ball) > LEAF // 2:
                        found = True
                        left[ball] = False
                        work.append((self._node(c, near[ball, i], node), rows[ball], near[ball, i]))
                rows = rows[left]
                centres = rows[:LEAF]
            self.rows[node] = rows  # too scattered for balls of this radius: scored whenever the node is opened


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """The vectors on the unit sphere, by one more component; ``largest`` is the norm of the longest."""
    rest = np.sqrt(np.maximum(largest * largest - (x * x).sum(axis=1), 0))
    points = np.concatenate([x, rest[:, None]], axis=1)
    points[:, -1] += largest == 0
    return points / (largest or 1.0)


def bounds(a: np.ndarray, centres: np.ndarray, radius: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest product of each vector with points within the radius of each centre."""
    size = np.sqrt((a * a).sum(axis=1))[:, None] * largest
    angle = np.arccos(np.clip(a @ centres[:, :-1].T * largest / np.maximum(size, 1e-300), -1, 1))
    slack = 1e-6 * size + 0.5
    return (size * np.cos(np.minimum(angle + radius, np.pi)) - slack, size * np.cos(np.maximum(angle - radius, 0)) + slack)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, the least of them first."""
    return np.sort(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:], axis=1)


class Searches:
    """Vectors with a label, an own id and a window [low, high]; each wants the k best rows of
    its label or of the others."""

    def __init__(self, a, label, own, low, high, floor, same_label: bool, k: int):
        self.a, self.label, self.own, self.low, self.high = a, label, own, low, high
        self.floor, self.same_label, self.k = np.maximum(floor, low), same_label, k

    def fits(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which rows (across) the searches q (down) want."""
        like = labels[None, :] == self.label[q][:, None]
        return ((like == self.same_label) & (ids[None, :] != self.own[q][:, None])
                & (scores <= self.high[q][:, None]) & (scores >= self.low[q][:, None]))

    def kth(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The k-th best score among some rows, -inf with fewer."""
        scores = self.a @ x.T
        scores = np.where(self.fits(scores, ids, labels, np.arange(len(self.a))), scores, -np.inf)
        none = np.full((len(self.a), self.k), -np.inf)
        return _top(np.concatenate([none, scores], axis=1), self.k)[:, 0]

    def best(self, tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, row, score) of the k best of each search in a block, ties by id."""
        low, high = bounds(self.a, tree.points[tree.centre], np.array(tree.radius), largest)
        for node, parent in enumerate(tree.parent[1:], 1):
            low[:, node] = np.maximum(low[:, node], low[:, parent])
            high[:, node] = np.minimum(high[:, node], high[:, parent])
        leaves = np.array([i for i, rows in enumerate(tree.rows) if len(rows)])
        low, high = low[:, leaves], high[:, leaves]
        order, every = np.argsort(-high, axis=1, kind="stable"), np.arange(len(self.a))
        best, floor = np.full((len(self.a), self.k), -np.inf), self.floor.copy()
        found: list[tuple] = []
        for turn in order.T:
            reached = high[every, turn] >= floor
            if not reached.any():
                break
            reached &= low[every, turn] <= self.high
            for leaf in np.unique(turn[reached]).tolist():
                q, rows = np.flatnonzero(reached & (turn == leaf)), tree.rows[leaves[leaf]]
                scores = self.a[q] @ x[rows].T
                fits = self.fits(scores, ids[rows], labels[rows], q) & (scores >= floor[q][:, None])
                at, row = np.nonzero(fits)
                if len(at):
                    found.append((q[at], rows[row], scores[at, row]))
                    best[q] = _top(np.concatenate([best[q], np.where(fits, scores, -np.inf)], axis=1), self.k)
                    floor[q] = np.maximum(floor[q], best[q][:, 0])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        return q[keep], row[keep], score[keep]


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for i, b in enumerate(raw):
        v = np.frombuffer(b, "<f8")
        out[i, :len(v)] = v
    return out


ROWS = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("n", pa.float64()), ("width", pa.int32())])
DEALT = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()),
                   ("v", pa.binary()), ("windows", pa.binary())])
FOUND = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _integers(scale: float) -> Callable:
    """Rows that take part, their components as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if None in v:
                    continue
                x = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(x).all():
                    out.append((i, label, x.astype("<f8").tobytes(), float(x @ x), len(x)))
                elif np.isfinite(np.array(v, np.float64)).all():
                    raise ValueError(f"a vector of id {i} is too long for exact products")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

    return run


class Space:
    """The first level of the tree: what a task must know of all rows (bounded by SAMPLE and CENTRES)."""

    def __init__(self, sample: list[tuple], largest: float, width: int):
        self.largest, self.width = largest, width
        self.ids, self.labels = (np.array([r[i] for r in sample], np.int64) for i in (0, 1))
        self.x = _matrix([r[2] for r in sample], width)
        points = augmented(self.x, largest)
        chosen, nearest = [0], points @ points[0]
        while len(chosen) < min(CENTRES, len(points)) and nearest.min() < 1 - 1e-9:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, points @ points[chosen[-1]])
        self.centres = points[chosen]
        self.radius, self.first, self.blocks = (np.zeros(len(chosen)), *np.zeros((2, len(chosen)), np.int64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = augmented(x, self.largest) @ self.centres.T
        at = cosines.argmax(axis=1)
        return at, np.arccos(np.clip(cosines[np.arange(len(x)), at], -1, 1))

    def place(self, counts: dict[int, tuple[int, float]]) -> None:
        """Takes the rows and radius of each centre."""
        for c, (n, radius) in counts.items():
            self.radius[c], self.blocks[c] = radius, -(-n // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks


def _near_centre(space: Space) -> Callable:
    fields = pa.schema([("centre", pa.int32()), ("angle", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, angle = space.nearest(_matrix(batch.column("v").to_pylist(), space.width))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(angle)], schema=fields)

    return run


def _into_blocks(space: Space) -> Callable:
    """Candidates (id, label, v, hash) to a block of their centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = space.nearest(_matrix(batch.column("v").to_pylist(), space.width))
            block = space.first[at] + batch.column("hash").to_numpy() % space.blocks[at]
            zero, none = pa.array(np.zeros(len(at), np.int32)), pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), zero, none, batch.column("id"), batch.column("label"),
                                              batch.column("v"), pa.nulls(len(at), pa.binary())], schema=DEALT)

    return run


def _searches(rows: list[tuple], width: int, same_label: bool, k: int) -> tuple[Searches, np.ndarray, np.ndarray]:
    """Searches of rows (id, label, v, windows), a search a window, with row and place in it."""
    windows = [np.frombuffer(r[3], "<f8").reshape(-1, 4) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(w) for w in windows])
    pos, low, high, floor = np.concatenate([np.zeros((0, 4)), *windows]).T
    a = _matrix([r[2] for r in rows], width)[of]
    own, label = (np.array([r[i] for r in rows], np.int64)[of] for i in (0, 1))
    return Searches(a, label, own, low, high, floor, same_label, k), of, pos


def _to_blocks(space: Space, same_label: bool, k: int) -> Callable:
    """Anchors (key, id, label, v, windows) to all blocks of the centres that their windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, CHUNK):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(x, CHUNK).columns), strict=True))
                find, of, pos = _searches([r[1:] for r in rows], space.width, same_label, k)
                floor = np.maximum(find.floor, find.kth(space.x, space.ids, space.labels))
                low, high = bounds(find.a, space.centres, space.radius, space.largest)
                reached = (high >= floor[:, None]) & (low <= find.high[:, None]) & (space.blocks > 0)
                out = []
                for i, (key, own, label, v, _) in enumerate(rows):
                    mine = np.flatnonzero(of == i)
                    for c in np.flatnonzero(reached[mine].any(axis=0)).tolist():
                        w = mine[reached[mine, c]]
                        raw = np.stack([pos[w], find.low[w], find.high[w], floor[w]], axis=1).astype("<f8").tobytes()
                        first = int(space.first[c])
                        out += [(block, 1, key, own, label, v, raw) for block in range(first, first + int(space.blocks[c]))]
                    if len(out) > 20_000:
                        yield _batch(out, DEALT)
                        out = []
                if out:
                    yield _batch(out, DEALT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _found(width: int, largest: float, same_label: bool, k: int) -> Callable:
    """The best rows of each search in each block; a block's candidates come first, then its searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tree, x, ids, labels = None, [], None, None, None, None
        for batch in batches:
            at, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if at[a] != block:
                    block, held, tree = at[a], [], None
                if not kinds[a]:
                    held += zip(*(part.column(c).to_pylist() for c in ("id", "label", "v")), strict=True)
                    continue
                if tree is None and not held:  # no row's hash chose this block of its centre
                    continue
                if tree is None:
                    ids, labels = (np.array([r[i] for r in held], np.int64) for i in (0, 1))
                    x, held = _matrix([r[2] for r in held], width), []
                    tree = Tree(x, largest)
                for y in range(0, part.num_rows, CHUNK):
                    rows = list(zip(*(part.slice(y, CHUNK).column(c).to_pylist() for c in ("id", "label", "v", "windows")), strict=True))
                    keys = part.slice(y, CHUNK).column("key").to_numpy()
                    find, of, pos = _searches(rows, width, same_label, k)
                    q, row, score = find.best(tree, x, ids, labels, largest)
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[of[q]]), pa.array(pos[q].astype(np.int32)), pa.array(ids[row]),
                             pa.array(score.astype(np.int64))], schema=FOUND)

    return run


def _search(rows: DataFrame, anchors: DataFrame, space: Space, same_label: bool, k: int) -> DataFrame:
    """(key, pos, rank, id, score): the first k rows of each window of each anchor (key, id, label, v, windows)."""
    candidates = rows.select("id", "label", "v", F.shiftrightunsigned(F.xxhash64("id", "v"), 1).alias("hash"))
    dealt = candidates.mapInArrow(_into_blocks(space), _ddl(DEALT)).unionByName(
        anchors.select("key", "id", "label", "v", "windows").mapInArrow(_to_blocks(space, same_label, k), _ddl(DEALT)))
    tasks = max(shuffle_partitions(rows.sparkSession), 1)
    dealt = dealt.repartitionById(tasks, F.pmod("block", F.lit(tasks))).sortWithinPartitions("block", "kind", "key", "id")
    found = dealt.mapInArrow(_found(space.width, space.largest, same_label, k), _ddl(FOUND))
    first = W.partitionBy("key", "pos").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _window(low: Column, high: Column, pos: Column) -> Column:
    """One window in bytes: place, low, high and the least score wanted."""
    return F.struct(pos.cast("double").alias("pos"), low.cast("double").alias("low"), high.cast("double").alias("high"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array([[w["pos"], w["low"], w["high"], -np.inf] for w in ws], "<f8").tobytes() for ws in batch.column("ws").to_pylist()]
        columns = [batch.column(c) for c in ("key", "id", "label", "v")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], names=["key", "id", "label", "v", "windows"])


PACKED = "key bigint, id bigint, label bigint, v binary, windows binary"


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: float = 256, n_positives: int = 5, n_negatives: int = 10,
                   low_pct: int = 30, high_pct: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the anchors that
    ``is_anchor`` (over the id column) names."""
    if min(n_positives, n_negatives) < 1:
        raise ValueError("n_positives and n_negatives must be positive")
    spark = vectors.sparkSession
    bounded_batches(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                            F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    source = source.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = written(source.select("id", "label", "v").mapInArrow(_integers(scale), _ddl(ROWS)), "hard-rows")
    most, width = rows.agg(F.max("n"), F.max("width")).first()
    if most is not None and most >= EXACT:
        raise ValueError("squared norms of 2^53 and more have no exact products")
    sample = rows.select("id", "label", "v").orderBy(F.xxhash64("id", F.lit(11)), "id", "label", "v").limit(SAMPLE).collect()
    space = Space([tuple(r) for r in sample], float(np.sqrt(most or 0.0)), width or 0) if sample else None
    if space is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    sizes = rows.select("v").mapInArrow(_near_centre(space), "centre int, angle double").groupBy("centre").agg(F.count("*"), F.max("angle"))
    space.place({r[0]: (r[1], r[2]) for r in sizes.collect()})  # CENTRES rows at most

    ids = source.filter("anchor").select("id").distinct()
    anchors = rows.join(ids, "id", "left_semi").select("id", "label", "v").distinct()
    anchors = written(anchors.withColumn("key", F.monotonically_increasing_id()), "hard-anchors")
    all_scores = F.array(_window(F.lit(float("-inf")), F.lit(float("inf")), F.lit(0)))
    first = anchors.withColumn("ws", all_scores).mapInArrow(_packed, PACKED)
    positives = _search(rows, first, space, True, n_positives)
    positives = written(positives.select("key", F.col("rank").alias("pos"), F.col("id").alias("positive_id"),
                                         F.col("score").alias("positive_score")), "hard-positives")
    wanted = positives.filter("positive_score >= 0").groupBy("key").agg(F.collect_list(_window(
        F.expr(f"({low_pct} * positive_score + 99) div 100"), F.expr(f"({high_pct} * positive_score) div 100"), F.col("pos"))).alias("ws"))
    second = anchors.join(wanted, "key").select("key", "id", "label", "v", "ws").mapInArrow(_packed, PACKED)
    negatives = _search(rows, second, space, False, n_negatives).select(
        "key", "pos", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    full = negatives.join(positives, ["key", "pos"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return full.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
