"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item is contained in a document when at least 80 % of the item's distinct
five-word shingles occur in it (texts lower-cased A-Z; a text of fewer than five
words has its whole word sequence as one shingle).  A MinHash signature of a whole
document says little about a short item inside it: their Jaccard similarity is about
item size / document size.  So items are partitioned by the size of their shingle
set, and each partition keeps as many minima (a bottom-k MinHash sketch) as its sizes
demand: of any item held to 80 %, a document must contain one of the k = 20 % + 1
smallest hashes, whatever its own length.  The search therefore misses nothing;
candidates are then verified on the shingles themselves.

Null and blank texts have no shingles: such items match nothing, such documents hold
nothing.  Null ids are ids like others.  Repeated items or documents with one id
count as one whose shingles are all of theirs.  Empty tables give an empty result.
Extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import ascii_lower, same, words, written

WIDTH = 5
PERCENT = 80
BROADCAST_ROWS = 500_000  # item shingles up to which they are sent to every executor


def _shingle_positions(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= WIDTH, F.sequence(F.lit(1), n - (WIDTH - 1))).when(n > 0, F.array(F.lit(1))).otherwise(
        F.array().cast("array<int>"))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(F.transform(_shingle_positions(w), lambda i: F.array_join(F.slice(w, i, WIDTH), " ")))


def shingle_hashes(w: Column) -> Column:
    """One 64-bit hash per position (positions repeat hashes as shingles repeat)."""
    return F.transform(_shingle_positions(w), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))


def _size_class(n: Column) -> Column:
    """Size partition: the power of two at or below the size."""
    return F.floor(F.log2(n)).cast("int")


def sketch_length(n: Column) -> Column:
    """Minima kept in the size partition of n: 20 % of its largest size, plus one."""
    upper = F.pow(F.lit(2.0), _size_class(n) + 1) - 1
    return F.least(F.floor(upper * (100 - PERCENT) / 100).cast("int") + 1, n)


def item_shingles(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """(item, shingle, s: its hash, n: the item's set size, in_sketch)."""
    w = items.select(F.col(item_id).alias("item"), words(ascii_lower(F.col(text_col).cast("string"))).alias("w"))
    rows = w.select("item", F.explode(shingle_texts(F.col("w"))).alias("shingle")).distinct()
    per = rows.groupBy("item").agg(F.collect_list(F.struct(F.xxhash64(F.split("shingle", " ")).alias("s"), "shingle")).alias("all"))
    per = per.select("item", F.size("all").alias("n"), F.sort_array("all").alias("all"))
    return per.select("item", "n", F.posexplode("all").alias("at", "x")).select(
        "item", "n", F.col("x.s").alias("s"), F.col("x.shingle").alias("shingle"),
        (F.col("at") < sketch_length(F.col("n"))).alias("in_sketch"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (id, item id) with n_shingles of the item, n_shared and containment."""
    parts = written(item_shingles(items, item_id, item_text), "decon-items")
    small = parts.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)
    d = docs.select(F.col(id_col).alias("doc"), words(ascii_lower(F.col(text_col).cast("string"))).alias("w"))

    hashes = d.select("doc", F.explode(shingle_hashes(F.col("w"))).alias("s"))
    sketch = parts.filter("in_sketch").select("item", "n", "s")
    hits = hashes.join(sent(sketch), "s").distinct()
    # a contained item misses at most n - ceil(0.8 n) shingles, so of its minima too
    least = sketch_length(F.col("n")) - (F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).cast("int")
    pairs = written(hits.groupBy("doc", "item", "n").agg(F.count("*").alias("hits"))
                    .filter(F.col("hits") >= least).select("doc", "item"), "decon-candidates")

    found = same(d, pairs.select("doc").distinct(), ["doc"], "left_semi")
    exact = found.select("doc", F.explode(shingle_texts(F.col("w"))).alias("shingle"))
    shared = exact.join(sent(parts.select("item", "n", "shingle")), "shingle").distinct()
    shared = same(shared, pairs, ["doc", "item"], "left_semi")
    counted = shared.groupBy("doc", "item", "n").agg(F.count("*").alias("n_shared"))
    return counted.filter(F.col("n_shared") * 100 >= F.col("n") * PERCENT).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_id), F.col("n").cast("long").alias("n_shingles"),
        "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
