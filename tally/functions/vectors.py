"""Vector expressions on array columns (JVM-side except the UTF-8 byte sum)."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); NULL when either side is NULL or a zero vector, or lengths differ."""
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b)))


def dot_fixed(a: Column, b: Column, dim: int) -> Column:
    """a.b for vectors of a known length, unrolled into plain arithmetic so it
    compiles with whole-stage codegen (same summation order as :func:`dot`)."""
    acc = F.lit(0.0)
    for i in range(dim):
        acc = acc + a[i].cast("double") * b[i].cast("double")
    return acc


def norm_fixed(a: Column, dim: int) -> Column:
    acc = F.lit(0.0)
    for i in range(dim):
        acc = acc + a[i].cast("double") * a[i].cast("double")
    return F.sqrt(acc)


def has_dimensions(a: Column, dim: int) -> Column:
    return F.size(a) == F.lit(dim)


@F.pandas_udf(T.LongType())
def _embedding_seed(texts: pd.Series) -> pd.Series:
    # NULL for blank text (Python's str.strip: Unicode whitespace, as the reference)
    return texts.map(lambda t: sum(t.encode("utf-8")) % 1000 if t.strip() else None, na_action="ignore").astype("Int64")


def fake_embedding(text: Column, dimensions: int = 8) -> Column:
    """Deterministic test embedding: v = byte sum mod 1000, e[i] = ((v + i) mod 1000) / 1000.

    Blank text yields NULL (the reference rejects it).  The blank test and the
    byte sum happen in one vectorised call, so nothing text-sized is left for
    later operators to re-evaluate.
    """
    if dimensions <= 0:
        raise ValueError("dimensions must be greater than zero")
    v = _embedding_seed(text)
    vec = F.array(*[F.pmod(v + F.lit(i), F.lit(1000)) / F.lit(1000.0) for i in range(dimensions)])
    return F.when(v.isNull(), F.lit(None)).otherwise(vec)
