"""Queries of the operators over the test tables, with DuckDB SQL where it can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import toxicity
from tally.llm.common import table, words
from tally.llm.decontamination import contained_items
from tally.llm.exact_dedup import exact_groups
from tally.llm.hard_negatives import hard_negatives
from tally.llm.html_text import main_text
from tally.llm.licenses import license_of_files
from tally.llm.line_dedup import remove_repeated_lines
from tally.llm.ngram_join import near_classes
from tally.llm.packing import pack
from tally.llm.periodic_runs import periodic_runs
from tally.llm.sharding import interleaved_shards
from tally.llm.simhash_join import near_fingerprints
from tally.llm.token_file import token_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# The words and shingle set of a text column, as a DuckDB expression.
def sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split_regex({lower}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def sql_shingles(w: str) -> str:
    return (f"CASE WHEN len({w}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({w}) - 3, 2)), "
            f"lambda i: array_to_string({w}[i:i + 4], ' '))) END")


@query("op4_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of every document."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chars")


@query("op7_decontamination", f"""
WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
     b AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark),
     ds AS (SELECT doc_id, unnest({sql_shingles('w')}) AS s FROM d),
     bs AS (SELECT item_id, unnest({sql_shingles('w')}) AS s FROM b),
     size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards that each match the mixture of sources."""
    out = interleaved_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_token_file")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token file of all documents, written and read back."""
    return token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50257)


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal documents: set size and component of every document."""
    return near_classes(table(spark, sf_dir, "documents"))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the multi-line chunks that stand elsewhere before."""
    return remove_repeated_lines(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, as a file ``source/lang/doc_id.txt``."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_of_files(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents in which one id of ten (by crc32) has its last words replaced by a period of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n = F.col("w"), F.size("w")
    g = F.floor(F.col("h") / 10)
    a = F.pmod(F.col("g"), n)
    p = 1 + F.floor((n - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))
    chosen = (docs.withColumn("h", h).filter(F.col("h") % 10 == 0).withColumn("w", words(F.col("text"))).filter(n > 0)
              .withColumn("g", g).withColumn("a", a).withColumn("p", p))
    moved = F.transform(w, lambda x, i: F.when(i >= F.col("a"), F.get(w, (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
                        .otherwise(x))
    planted = chosen.select("doc_id", F.array_join(moved, " ").alias("text"))
    plain = docs.filter(F.coalesce(h % 10 != 0, F.lit(True)) | (F.size(words(F.col("text"))) == 0)).select("doc_id", "text")
    return plain.unionByName(planted)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document; the last words of a tenth of them are made periodic."""
    found = periodic_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda x, y: (y.length * x.period - x.length * y.period).cast("int")
    sign = lambda x, y: (F.when(longer(x, y) != 0, F.signum(longer(x, y))).when(x.start != y.start, F.signum(x.start - y.start))
                         .otherwise(F.signum(x.period - y.period)).cast("int"))
    best = F.get(F.array_sort("runs", sign), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are shifted by one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_fingerprints(table(spark, sf_dir, "documents"))
