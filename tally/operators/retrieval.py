"""FAQ-style retrieval: embed, upsert, exact cosine top-k with over-fetch,
numeric (yen amount) rerank, and hit-rate evaluation.

Vectors of a declared length are searched by pivots (``operators/pivots.py``): a query meets
only the blocks of the corpus that may hold one of its first k.  Vectors of no declared
length are scored against the whole corpus in blocks of at most ``BLOCK`` queries.  Both are exact,
never sampled.  Top-k per query uses ``row_number() <= k``, which Spark plans as a partial
WindowGroupLimit before the shuffle, so each task ships at most k candidates per
query.  A vector that is missing, zero or of another length than the queries' has no
distance and is no candidate.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.text import DOCUMENT_PREFIX, QUERY_PREFIX, is_blank, with_prefix, yen_amounts
from tally.functions.vectors import cosine_distance, dot_fixed, fake_embedding, has_dimensions, norm_fixed
from tally.operators.pivots import near_pairs

BLOCK = 256  # queries that a document row meets at a time
DISTANCE_DIGITS = 9


@dataclass(frozen=True)
class EmbeddingProvider:
    """Builds embedding Columns.  ``fake`` is the deterministic test provider
    (JVM expressions); a model provider would be an iterator pandas_udf that
    loads the model once per executor process."""

    dimensions: int = 8
    document_prefix: str = ""
    query_prefix: str = ""

    def embed_document(self, text: Column) -> Column:
        return fake_embedding(with_prefix(text, self.document_prefix) if self.document_prefix else text, self.dimensions)

    def embed_query(self, text: Column) -> Column:
        return fake_embedding(with_prefix(text, self.query_prefix) if self.query_prefix else text, self.dimensions)


FAKE = EmbeddingProvider(8)
E5_STYLE = EmbeddingProvider(8, DOCUMENT_PREFIX, QUERY_PREFIX)


def embed_corpus(corpus: DataFrame, provider: EmbeddingProvider = FAKE, text_col: str = "question") -> DataFrame:
    """Adds ``embedding``; blank texts get NULL (the reference rejects them)."""
    return corpus.withColumn("embedding", provider.embed_document(F.col(text_col)))


def validate_embeddings(df: DataFrame, dimensions: int, col: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has the wrong length."""
    return df.filter(F.col(col).isNull() | ~has_dimensions(F.col(col), dimensions))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "faq_id") -> DataFrame:
    """Insert new keys, overwrite question/answer/embedding of known ones."""
    keep = existing.join(incoming.select(key), key, "left_anti")
    return keep.unionByName(incoming.select(*existing.columns))


def _distance(dim: int | None) -> Column:
    if dim is None:
        return cosine_distance(F.col("embedding"), F.col("_qv"))
    # a known length: the dot product is plain arithmetic (codegen), norms are per side
    return F.lit(1.0) - F.try_divide(dot_fixed(F.col("embedding"), F.col("_qv"), dim), F.col("_dn") * F.col("_qn"))


def _scored(docs: DataFrame, queries: DataFrame, k: int, dim: int | None) -> DataFrame:
    """Pairs (query_id, doc_id, distance) among which are the first k of each query."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    q = queries.filter(F.col("query_embedding").isNotNull()).select("query_id", F.col("query_embedding").alias("_qv"))
    distance = F.round(_distance(dim), DISTANCE_DIGITS)
    if dim is not None:
        d = d.filter(has_dimensions(F.col("embedding"), dim)).withColumn("_dn", norm_fixed(F.col("embedding"), dim)).filter("_dn > 0")
        q = q.filter(has_dimensions(F.col("_qv"), dim)).withColumn("_qn", norm_fixed(F.col("_qv"), dim)).filter("_qn > 0")
        pairs = near_pairs(d, q, k, distance)
        if pairs is not None:
            return pairs
    # one row: the number of blocks
    blocks = F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("_n")))
    d = (d.crossJoin(blocks).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
         .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n"))
    q = (q.crossJoin(blocks).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_n")).cast("int")).drop("_n")
         .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))))
    return d.join(q, ["_block", "_part"]).select("query_id", "doc_id", distance.alias("distance"))


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """Nearest ``k`` documents per query (ties by doc_id), exact.

    ``docs``: (doc_id, embedding); ``queries``: (query_id, query_embedding).  ``dim`` is
    the declared length of the vectors, if they have one; others are left out.
    """
    if k <= 0:
        raise ValueError("limit must be greater than zero")
    scored = _scored(docs, queries, k, dim)
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return (scored.filter(F.col("distance").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "doc_id", "distance", "rank"))


def overfetch(limit: int) -> int:
    return max(limit * 3, 10)


def retrieve(docs: DataFrame, queries: DataFrame, limit: int = 3, provider: EmbeddingProvider = FAKE) -> DataFrame:
    """Top ``limit`` FAQs per query: over-fetch by distance, then put documents
    sharing a yen amount with the query first (distance order kept within each
    group; no-op when the query names no amount).

    ``docs``: (doc_id, question, embedding); ``queries``: (query_id, query_text).
    Blank queries are rejected.
    """
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    q = queries.filter(~is_blank(F.col("query_text"))).select(
        "query_id", provider.embed_query(F.col("query_text")).alias("query_embedding"),
        yen_amounts(F.col("query_text")).alias("_qa"))
    cand = cosine_topk(docs, q.select("query_id", "query_embedding"), overfetch(limit), provider.dimensions)
    # amounts are computed for candidate rows only
    j = (docs.select("doc_id", "question").join(cand, "doc_id")
         .withColumn("_da", yen_amounts(F.col("question"))).drop("question")
         .join(q.select("query_id", "_qa"), "query_id"))
    match = F.when(F.size("_qa") > 0, F.arrays_overlap("_qa", "_da").cast("int")).otherwise(F.lit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc("_match"), "rank")
    return (j.withColumn("_match", F.coalesce(match, F.lit(0)))
            .withColumn("final_rank", F.row_number().over(w))
            .filter(F.col("final_rank") <= limit)
            .select("query_id", "doc_id", "distance", (F.col("_match") == 1).alias("amount_match"),
                    F.col("rank").alias("distance_rank"), "final_rank"))


def hit_rate(results: DataFrame, expected: DataFrame, at: int = 1) -> DataFrame:
    """Share of queries whose expected document is within the first ``at`` results."""
    hits = results.filter(F.col("final_rank") <= at).select("query_id", F.col("doc_id").alias("_hit"))
    j = expected.join(hits, (expected.query_id == hits.query_id) & (expected.expected_doc_id == hits._hit), "left") \
        .select(expected.query_id, F.col("_hit").isNotNull().alias("_h"))
    per_q = j.groupBy("query_id").agg(F.max(F.col("_h").cast("int")).alias("hit"))
    return per_q.agg(F.count(F.lit(1)).cast("long").alias("queries"), F.sum("hit").cast("long").alias("hits")).withColumn(
        "hit_rate", F.col("hits") / F.col("queries"))


def label_centroids(vectors: DataFrame, id_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (element-wise mean via posexplode + grouped
    average; each group is one vector dimension).  Cosine distance ignores
    length, so no normalisation is needed."""
    e = vectors.select(id_col, F.posexplode(vec_col).alias("pos", "v"))
    per_dim = e.groupBy(id_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    vec = per_dim.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_p"))
    v = F.transform(F.col("_p"), lambda s: s["m"])
    return vec.select(F.col(id_col).alias("query_id"), v.alias("query_embedding"))


class ModelProvider:
    """Provider backed by a real embedding model.

    ``load`` returns a function ``texts -> vectors``; it is called once per
    Python worker (iterator pandas UDF), never per row, and every vector is
    checked for the declared length.  Model libraries are optional: nothing
    is imported here.
    """

    def __init__(self, load, dimensions: int, document_prefix: str = DOCUMENT_PREFIX, query_prefix: str = QUERY_PREFIX):
        if dimensions <= 0:
            raise ValueError("dimensions must be greater than zero")
        self.load, self.dimensions = load, dimensions
        self.document_prefix, self.query_prefix = document_prefix, query_prefix
        self._udf = self._make_udf()

    def _make_udf(self):
        load, dims = self.load, self.dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                blank = texts.isna() | (texts.fillna("").str.strip() == "")
                out = pd.Series([None] * len(texts), dtype=object)
                idx = [i for i in range(len(texts)) if not blank.iloc[i]]
                if idx:
                    vecs = model([texts.iloc[i] for i in idx])
                    for i, v in zip(idx, vecs):
                        if len(v) != dims:
                            raise ValueError(f"Expected embedding with {dims} dimensions, got {len(v)}")
                        out.iloc[i] = [float(x) for x in v]
                yield out

        return embed

    def embed_document(self, text: Column) -> Column:
        return self._udf(with_prefix(text, self.document_prefix))

    def embed_query(self, text: Column) -> Column:
        return self._udf(with_prefix(text, self.query_prefix))
