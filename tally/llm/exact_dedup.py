"""Exact dedup: 128-bit content hash, one row stays per group, bytes compared inside groups.

Texts are equal when they are identical after deleting ASCII white space.  A null
text counts as empty, so null, empty and blank texts form one group.  Of a group,
the row with the most code points in its original text stays, then the smallest id
(a null id comes last); of rows repeated with the same id, exactly one.  An empty
table gives an empty result; ids name documents and so spread the rows of a group; columns other than the id and the text are not read.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import BLANKS, attach_groups, salted, same, written

KEYS = ["h"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(sha256: Column, norm: Column) -> Column:
    """The first 128 bits of the SHA-256 of the normalised text."""
    return F.unhex(F.substring(sha256, 1, 32))


def _rows(docs: DataFrame, id_col: str, text_col: str, hasher: Callable) -> DataFrame:
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n"),
                    normalised(text).alias("norm"))
    d = d.withColumn("sha", F.sha2(F.col("norm"), 256))
    return d.withColumn("h", hasher(F.col("sha"), F.col("norm")))


def _choose(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the group's size and its staying row; rows have id, n, rid and ``_salt``."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid")))
    out = attach_groups(rows, keys, {"best": best, "size": F.count("*")},
                        {"best": F.min("best"), "size": F.sum("size")})
    return out.select("*", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")).drop("best")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hasher: Callable[[Column, Column], Column] = content_hash) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256, n_chars.

    Groups by the hash on narrow rows; then the texts of groups of two and more are
    compared with the text of the staying row, along (hash, salt) so that a group
    of any size is spread over the job.  Hashes under which texts differ are grouped
    anew by the normalised text itself.
    """
    rows = _rows(docs, id_col, text_col, hasher)
    narrow = written(salted(rows.drop("norm").withColumn("rid", F.monotonically_increasing_id()), "id"), "exact-rows")
    members = written(_choose(narrow, KEYS), "exact-groups")
    bad = _collisions(rows, members)
    if bad.isEmpty():
        return _result(members, id_col)
    clean = same(members, bad, KEYS, "left_anti")
    again = same(rows, bad, KEYS, "left_semi").withColumn("rid", F.monotonically_increasing_id())
    split = _choose(written(salted(again, "id"), "exact-collisions"), [*KEYS, "norm"]).drop("norm")
    return _result(clean.unionByName(split.select(*clean.columns)), id_col)


def _collisions(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Hashes under which some normalised text differs from the staying row's."""
    many = members.filter(F.col("size") > 1)
    spread = many.select("h", "_salt").distinct()
    keeper = many.filter(F.col("rid") == F.col("keep_rid")).select("h", F.col("id").alias("k_id"), F.col("n").alias("k_n"))
    texts = written(salted(rows.select("id", "n", "norm", "h"), "id").join(spread, [*KEYS, "_salt"], "left_semi"),
                    "exact-texts")
    reps = (texts.join(keeper, KEYS).filter(F.col("id").eqNullSafe(F.col("k_id")) & (F.col("n") == F.col("k_n")))
            .groupBy("h").agg(F.min("norm").alias("rep")))
    return (texts.join(spread.join(reps, KEYS), [*KEYS, "_salt"]).filter(F.col("norm") != F.col("rep"))
            .select("h").distinct())


def _result(members: DataFrame, id_col: str) -> DataFrame:
    return members.select(F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"),
                          (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"),
                          F.col("n").alias("n_chars"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    decided = exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), "kept", "text_sha256", "n_chars")
    counts = decided.groupBy("id").agg(F.count("*").alias("rows"), F.max("kept").alias("any_kept"))
    wanted = counts.filter("any_kept").select(F.col("id").alias(id_col), "rows")
    alone = same(docs, wanted.filter("rows = 1").select(id_col), [id_col], "left_semi")
    # rows that repeat an id: by text, one of each
    several = same(docs, wanted.filter("rows > 1").select(id_col), [id_col], "left_semi")
    text = F.col(text_col).cast("string")
    several = several.withColumns({"_sha": F.sha2(normalised(text), 256), "_n": F.char_length(F.coalesce(text, F.lit(""))).cast("long")})
    stay = decided.filter("kept").select(F.col("id").alias(id_col), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n"))
    several = same(several, stay, [id_col, "_sha", "_n"], "left_semi").dropDuplicates([id_col, "_sha"])
    return alone.unionByName(several.select(*docs.columns))
