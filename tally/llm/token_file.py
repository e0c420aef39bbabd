"""Token-id output: one concatenated id array with Elias-Fano encoded document boundaries.

Documents are ordered by id and cut into segments of consecutive documents; a segment
is one row of the file format, a parquet table in the shared folder:

* ``ids``: the token ids of the segment's documents one after another, little-endian,
  two bytes each when the vocabulary has at most 65 536 ids, else four (``width``);
* ``low``, ``high``, ``low_bits``, ``hints``: the ends of its documents as an Elias-Fano
  sequence: the low bits of each end packed side by side, the high parts as a bit array
  in unary, and the position of every 256th set bit, from which a select starts;
* ``doc_ids``, ``n_docs``, ``n_tokens``, ``part`` and ``nth``: which documents and where.

A boundary costs about 2 + log2(mean length) bits where a table of 64-bit offsets costs
64, and a select reads one hint and at most a few bytes of the bit array.

A null or empty text is its end id alone; null ids come first; repeated rows are rows;
an empty table gives an empty file.  Columns but the id and text are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import bounded_batches, shared_path, shuffle_partitions
from tally.llm.tokens import Encoder

HINT = 256  # every so many set bits, a position is kept
SEGMENT_TOKENS = 1 << 20  # a segment ends with the document that reaches this


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers with select."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    hints: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        if bits:
            each = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()
        else:
            low = b""
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        plane = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        plane[at] = 1
        high = np.packbits(plane, bitorder="little").tobytes()
        return cls(n, bits, low, high, at[::HINT].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start // 8:(start + self.low_bits + 7) // 8], "little")
        return (raw >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value (from 0), reading from the hint before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.hints, "<u4", 1, 4 * (i // HINT))[0])
        missing, byte = i % HINT, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (count := word.bit_count()) <= missing:
            missing -= count
            byte += 1
            word = self.high[byte]
        for _ in range(missing):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, in one pass over the bits."""
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        high = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        each = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
        return high + each.reshape(self.n, self.low_bits) @ (1 << np.arange(self.low_bits, dtype=np.int64))


FIXED = [("part", "int"), ("nth", "long"), ("n_docs", "long"), ("n_tokens", "long"), ("width", "int"), ("ids", "binary"),
         ("low_bits", "int"), ("low", "binary"), ("high", "binary"), ("hints", "binary")]


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes the file at ``path`` in ascending id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in FIXED)])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, nth = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[bytes] = []
        ends, total = [], 0

        def segment() -> pa.RecordBatch:
            ef = EliasFano.encode(np.array(ends, np.int64))
            ids = pa.concat_arrays(names)
            values = [part, nth, len(ends), total, width, b"".join(held), ef.low_bits, ef.low, ef.high, ef.hints]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=schema.names)

        for batch in batches:
            first = 0
            for r, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                held.append(np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                total += len(ids) + 1
                ends.append(total)
                if total >= SEGMENT_TOKENS:
                    names.append(batch.column(0).slice(first, r + 1 - first))
                    yield segment()
                    first, nth, total = r + 1, nth + 1, 0
                    names, held, ends = [], [], []
            if first < batch.num_rows:
                names.append(batch.column(0).slice(first))
        if ends:
            yield segment()

    rows.mapInArrow(segments, schema).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the file: id, start, n_tokens and the crc of its ids."""
    bounded_batches(spark)
    file = spark.read.parquet(path)
    # a row per segment, and in the window a row per part: both without the payload
    parts = file.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inner = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    starts = (file.select("part", "nth", "n_tokens")
              .withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
              .join(parts, "part").select(F.col("part").alias("p"), F.col("nth").alias("k"), (F.col("before") + F.col("inside")).alias("base")))
    kind = file.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("p", T.IntegerType()), T.StructField("k", T.LongType()),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r] for name in batch.schema.names}
                ends = EliasFano(*(x[n].as_py() for n in ("n_docs", "low_bits", "low", "high", "hints"))).all()
                begin = np.concatenate([[0], ends[:-1]])
                raw, width = memoryview(x["ids"].as_buffer()), x["width"].as_py()
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [x["doc_ids"].values, pa.array([x["part"].as_py()] * n, pa.int32()), pa.array([x["nth"].as_py()] * n, pa.int64()),
                     pa.array(begin, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return (file.mapInArrow(documents, schema).join(starts, ["p", "k"])
            .select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def offsets(spark: SparkSession, path: str, part: int, nth: int, which: list[int]) -> list[int]:
    """Ends of some documents of one segment by select, reading only its index."""
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("nth") == nth)).select(
        "n_docs", "low_bits", "low", "high", "hints").first()
    ef = EliasFano(*row)
    return [ef.select(i) for i in which]


def token_file(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = 0, path: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the file and returns what reading it back says of every document."""
    path = path or shared_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer_path, vocabulary, end_id, id_col, text_col)
    return read_token_file(docs.sparkSession, path, id_col)
