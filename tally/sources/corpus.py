"""FAQ corpus source: a JSON array of ``{id, question, answer}`` objects.

Spark's JSON reader also accepts a lone object (one row) and ``[]`` (zero
rows), so the shape is checked first: the first non-blank character must be
``[`` (a few bytes read on the driver), then the rows must be non-empty, have
no NULL fields and unique ids (one aggregate).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])


class CorpusError(ValueError):
    pass


def _first_char(spark: SparkSession, path: str) -> str:
    """The first character that is no blank, however many blanks are before it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if text := line.lstrip("\ufeff \t\r\n"):
                return text[0]
        return ""
    finally:
        reader.close()


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    if _first_char(spark, path) != "[":
        raise CorpusError("FAQ corpus must be a JSON array.")
    df = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("id").isNull() | F.col("question").isNull() | F.col("answer").isNull()).alias("nulls"),
        F.countDistinct("id").alias("ids"),
    ).first()
    if stats["n"] == 0:
        raise CorpusError("FAQ corpus must not be empty.")
    if stats["nulls"]:
        raise CorpusError(f"{stats['nulls']} corpus entries miss id, question or answer")
    if stats["ids"] != stats["n"]:
        raise CorpusError("corpus ids must be unique")
    return df.withColumnRenamed("id", "faq_id")
