"""Exact nearest vectors by pivots: blocks that cannot reach rank k are skipped.

The angle between vectors is a metric, and cosine distance grows with it.  A few pivots are
drawn from a sample of the documents; a document belongs to its nearest pivot and, by its angle
to it, to a ring.  A document in a ring of angles [low, high] of pivot p lies at an angle of at
least ``max(t - high, low - t)`` from a query that is at angle t from p.  A query first scores the
nearest rings that hold k documents, which bounds the distance of rank k, and then every
ring that may hold one as near: no other document can be among the first k, ties included.
What is known of all documents on the driver and in closures is bounded by ``PIVOTS`` and ``BINS``;
a large ring is dealt to parts, so no key holds more than about ``ROWS`` documents.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.operators.slices import stored

PIVOTS, SAMPLE = 64, 2048
BINS = 1024  # of the half circle
RINGS = 32  # of a pivot, aimed at
ROWS = 8192  # documents of a part of a ring
SLACK = 1e-7  # more than rounding of angles and of distances to nine digits


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chosen_pivots(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors far from each other, farthest first."""
    picked, nearest = [0], x @ x[0]
    while len(picked) < most and nearest.min() < 1 - 1e-12:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


class Rings:
    """The rings of all pivots: pivot, least and greatest angle, documents, and parts they are dealt to."""

    def __init__(self, pivots: np.ndarray, bins: list[tuple]):
        self.pivots, self.of = pivots, np.zeros((len(pivots), BINS), np.int64)
        total: dict[int, int] = {}
        for p, _, n, _, _ in bins:
            total[p] = total.get(p, 0) + n
        rows: list[list] = []
        for p, b, n, low, high in sorted(bins):
            if not rows or rows[-1][0] != p or rows[-1][3] >= total[p] / RINGS:
                rows.append([p, low, high, 0])
            rows[-1][2], rows[-1][3] = high, rows[-1][3] + n
            self.of[p, b] = len(rows) - 1
        self.pivot = np.array([r[0] for r in rows], np.int64)
        self.low, self.high = (np.array([r[i] for r in rows]) for i in (1, 2))
        self.count = np.array([r[3] for r in rows], np.int64)
        self.parts = -(-self.count // ROWS)

    def place(self, pivot: pd.Series, bin_: pd.Series, code: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        ring = self.of[pivot.to_numpy(), bin_.to_numpy()]
        return ring, code.to_numpy() % self.parts[ring]

    def least(self, x: np.ndarray) -> np.ndarray:
        """The least angle between each vector and a document of each ring."""
        t = np.arccos(np.clip(x @ self.pivots.T, -1, 1))[:, self.pivot]
        return np.maximum(np.maximum(t - self.high, self.low - t), 0)


def _with_pivot(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cosine = _unit(pdf["embedding"]) @ pivots.T
                p = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(p)), p], -1, 1))
                yield pdf.assign(_pivot=p, _bin=np.minimum((angle / np.pi * BINS).astype(np.int64), BINS - 1), _angle=angle)

    return run


def _into_rings(rings: Rings, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ring, part = rings.place(pdf["_pivot"], pdf["_bin"], pdf["_code"])
            yield pdf.assign(_ring=ring, _part=part)[[*columns, "_ring", "_part"]]

    return run


def _visits(rings: Rings, k: int, columns: list[str], near: bool):
    """A row for each part of the rings that a query visits: the nearest that hold k documents, or
    with ``near`` false the others that may hold one within ``_kth``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            least = rings.least(_unit(pdf["_qv"]))
            order = np.argsort(least, axis=1, kind="stable")
            held = np.cumsum(rings.count[order], axis=1) - rings.count[order]
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, order, held < k, axis=1)
            if not near:
                reach = pdf["_kth"].fillna(np.inf).to_numpy()[:, None] + SLACK
                first = ~first & (1 - np.cos(np.maximum(least - SLACK, 0)) <= reach)
            row, ring = np.nonzero(first)
            parts = rings.parts[ring]
            out = pdf.iloc[np.repeat(row, parts)][columns].reset_index(drop=True)
            yield out.assign(_ring=np.repeat(ring, parts), _part=np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))

    return run


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def near_pairs(docs: DataFrame, queries: DataFrame, k: int, distance: Column) -> DataFrame | None:
    """All pairs (query_id, doc_id, distance) that can be among a query's first ``k``, and some more.

    ``docs`` (doc_id, embedding, ...) and ``queries`` (query_id, _qv, ...) have vectors of one length,
    none of them zero; ``distance`` is the cosine distance over the columns of both.  None without documents.
    """
    sample = docs.select("doc_id", "embedding").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return None
    pivots = chosen_pivots(_unit(sample["embedding"]))
    docs = stored(docs.mapInPandas(_with_pivot(pivots), _ddl(docs, "_pivot bigint", "_bin bigint", "_angle double")), "pivot-docs")
    bins = docs.groupBy("_pivot", "_bin").agg(F.count("*").alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high"))
    rings = Rings(pivots, [tuple(r) for r in bins.collect()])  # PIVOTS * BINS rows at most
    columns = [c for c in docs.columns if c not in ("_pivot", "_bin", "_angle")]
    coded = docs.withColumn("_code", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    dealt = coded.mapInPandas(_into_rings(rings, columns), _ddl(docs.select(*columns), "_ring bigint", "_part bigint"))

    def scored(visits: DataFrame) -> DataFrame:
        return dealt.join(visits, ["_ring", "_part"]).select("query_id", "doc_id", distance.alias("distance"))

    visit = _ddl(queries, "_ring bigint", "_part bigint")
    first = stored(scored(queries.mapInPandas(_visits(rings, k, queries.columns, True), visit)), "pivot-near")
    nearest = Window.partitionBy("query_id").orderBy("distance")
    kth = first.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k)
    kth = kth.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_kth"))
    best = F.expr(f"CASE WHEN _n >= {k} THEN _kth END").alias("_kth")
    known = queries.join(kth.select("query_id", best), "query_id", "left")
    rest = scored(known.mapInPandas(_visits(rings, k, queries.columns, False), visit))
    return first.unionByName(rest)
