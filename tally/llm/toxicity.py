"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Words written in leetspeak, with
letters repeated three times and more, or spaced out letter by letter become lattices of
possible readings; a Viterbi search takes the reading that the model finds likeliest.  A
word of plain letters has one reading, so only the others are searched, once per distinct
word.  The restored words and their beginnings are the evidence: log odds of words come
from labelled documents, and a logistic regression on a document's strongest words gives
the score.

The classifier is fitted on at most ``sample`` labelled documents (those with the smallest
hash of their id, each text once); the model of characters is counted over everything and
every document is scored over its whole text.  A null text is empty and gets the score of
a text without evidence.  Labels that repeat an id count as toxic if one of them does;
null labels and labels without a document are left out.  Without labels of both kinds every
score is the share of toxic labels (0 without labels).  Repeated rows are scored alike;
empty tables give an empty result; columns but the id, text and label are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import bounded_batches, written

SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
LEAST_TOXIC = 4  # toxic documents that a feature occurs in, at least
LEAST_Z = 4.0
SYMBOLS = 60  # boundary, a-z, U+00DF-U+00FF, any other letter
OTHER = SYMBOLS - 1
# Letters that a sign is written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*·"
SIGN_COST, BREAK_COST, SPACE_COST = 0.7, 6.0, 2.5  # in nats, of reading a sign as a letter, as a break, a separator as a space
SPACED = re.compile(rf"(?<!\w)\w(?:[{re.escape(SEPARATORS)}]+\w){{2,}}(?!\w)")
RUN = re.compile(r"(.)\1{2,}")
LETTERS = re.compile(r"[^\W\d_]+")
MOST_WORDS = 300_000  # words a worker remembers


def symbol_table() -> np.ndarray:
    """Symbol of every code point of lower-case text."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0xAA, 0x3000):
        if chr(i).isalpha():
            out[i] = OTHER
    out[0x3000:0xD800] = OTHER
    out[97:123] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 27 + 33)[:0x100 - 0xDF].clip(max=OTHER)
    out[0xF7] = 0
    return out


def _symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF:
        return min(27 + o - 0xDF, OTHER) if o != 0xF7 else 0
    return OTHER if c.isalpha() else 0


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all symbol trigrams of all texts; the table has ``SYMBOLS`` ** 3 cells, whatever the corpus."""
    bounded_batches(docs.sparkSession)
    cells = SYMBOLS ** 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, total = symbol_table(), np.zeros(cells, np.int64)
        for batch in batches:
            text = "  ".join(t for t in batch.column(0).to_pylist() if t).lower()
            s = symbols[np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "cell int, n long")
    out, sums = np.zeros(cells), parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape((SYMBOLS,) * 3)


def log_probability(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with shorter contexts."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    pairs = counts.sum(axis=0)
    two = (pairs + 20 * one) / (pairs.sum(axis=1, keepdims=True) + 20)
    out = np.log((counts + 20 * two) / (counts.sum(axis=2, keepdims=True) + 20))
    out[:, 0, :] = np.log(two[0])  # what came before a break says nothing
    return out


def _readings(token: str, i: int) -> list[tuple[str, int, float]]:
    """What may be read at a place of a token: (letters, next place, cost)."""
    c, run = token[i], 1
    while i + run < len(token) and token[i + run] == c:
        run += 1
    if c in SEPARATORS:
        return [("", i + 1, 0.0), (" ", i + 1, SPACE_COST)]
    if c.isalpha():
        return [(c, i + run, 0.0), (c + c, i + run, 0.0)] if run > 2 else [(c, i + 1, 0.0)]
    if c in LEET and run < 3:
        return [(x, i + 1, SIGN_COST) for x in LEET[c]] + [(" ", i + 1, BREAK_COST)]
    return [(" ", i + run, 0.0)]


def restore(token: str, logp: np.ndarray) -> str:
    """The likeliest reading of a lower-case token: Viterbi over (place, last two symbols)."""
    ahead: dict[int, dict[tuple[int, int], tuple[float, tuple]]] = {0: {(0, 0): (0.0, ())}}
    for i in range(len(token)):
        states = ahead.pop(i, None)
        if not states:
            continue
        for letters, to, cost in _readings(token, i):
            symbols = [_symbol(x) for x in letters]
            for (a, b), (score, path) in states.items():
                score -= cost
                for s in symbols:
                    if s or b:  # breaks side by side are one
                        score += logp[a, b, s]
                        a, b = b, s
                there = ahead.setdefault(to, {})
                if (a, b) not in there or there[a, b][0] < score:
                    there[a, b] = (score, (path, letters))
    ends = ahead[len(token)]
    _, path = max((score + (logp[a, b, 0] if b else 0.0), path) for (a, b), (score, path) in ends.items())
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def _written_oddly(word: str) -> bool:
    return not word.isalpha() and (any(c in LEET for c in word.rstrip("!?")) and any(map(str.isalpha, word))
                                   or bool(SPACED.search(word))) or bool(RUN.search(word))


def evidence(word: str, logp: np.ndarray) -> tuple[str, ...]:
    """Features of a lower-case word: its restored letter groups and their beginnings."""
    if _written_oddly(word):
        word = restore(word.rstrip("!?"), logp)
    out = []
    for w in LETTERS.findall(word):
        if len(w) > 2:
            out.append(w)
            out += ["^" + w[:k] for k in (4, 5, 6) if len(w) >= k]
    return tuple(out)


def spaced_out(words: list[str]) -> Iterator[str]:
    """Runs of three and more words of one letter, as one token each."""
    size = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if size.sum() < 3:
        return
    edges = np.flatnonzero(np.diff(size.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a > 2:
            yield " ".join(words[a:b])


def text_words(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    return words + list(spaced_out(words))


class _Memory(dict):
    """Word -> what a function makes of it; forgotten when it grows too large."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, word):
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = out = self.fn(word)
        return out


@dataclass
class Model:
    logp: np.ndarray
    weight: dict[str, float] = field(default_factory=dict)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))  # empty: every score is ``share``
    share: float = 0.0

    def word_scores(self) -> _Memory:
        return _Memory(lambda w: max((self.weight.get(f, 0.0) for f in evidence(w, self.logp)), default=0.0))


def document_features(text: str | None, scores: _Memory) -> list[float]:
    """What a document's words say: the strongest, the second, how many and how much, against the length."""
    words = text_words(text)
    s = np.fromiter(map(scores.__getitem__, words), float, len(words))
    s = np.sort(s[s > 0])[::-1]
    first = float(s[0]) if len(s) else 0.0
    second = float(s[1]) if len(s) > 1 else 0.0
    return [1.0, first, second, float(np.log1p(len(s))), float(np.log1p(s.sum())), float(np.log1p(len(words)))]


def _label_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
            .filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, sample: int, id_col: str, text_col: str,
                    label_col: str) -> DataFrame:
    """At most ``sample`` (text, y); ``train`` says by the id ``id`` which labels may be learnt."""
    chosen = _label_rows(labels, id_col, label_col).filter(train).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # of a fixed size
    return written(rows.groupBy("text").agg(F.max("y").alias("y")), "toxic-sample")


def _feature_counts(sample: DataFrame, logp: np.ndarray, only: set[str] | None) -> dict[str, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Memory(lambda w: evidence(w, logp)), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {f for w in set(text_words(text)) for f in words[w]}
                seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    parts = sample.select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    # of a sample of fixed size: at most its toxic documents / LEAST_TOXIC features per word
    found = parts.filter(F.col("n") >= (LEAST_TOXIC if only is None else 1)).toArrow()
    return dict(zip(found["f"].to_pylist(), found["n"].to_pylist(), strict=True))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; the constant (first column) is not held back."""
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    model = Model(log_probability(trigram_counts(docs, text_col)))
    rows = labelled_sample(docs, labels, train, sample, id_col, text_col, label_col)
    toxic, clean = rows.filter("y = 1"), rows.filter("y = 0")
    n1, n0 = toxic.count(), clean.count()
    if not n1 or not n0:
        model.share = n1 / max(1, n1 + n0)
        return model
    in_toxic = _feature_counts(toxic, model.logp, None)
    in_clean = _feature_counts(clean, model.logp, set(in_toxic))
    for f, a in in_toxic.items():
        b = in_clean.get(f, 0)
        expected = (a + b) * n1 / (n1 + n0)
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        z = (a - expected) / np.sqrt(expected)
        if odds > 1 and z > LEAST_Z:
            model.weight[f] = float(odds)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.word_scores()
        for batch in batches:
            x = [document_features(t, scores) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    found = rows.select("text", "y").mapInArrow(features, "x array<double>, y int").toArrow()  # one short row per sampled text
    model.beta = regression(np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the score to every row as column ``name`` (which it replaces); all other columns stay."""
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != name]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(name, T.DoubleType())])
    at = others.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.word_scores()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if len(model.beta):
                x = np.array([document_features(t, scores) for t in texts]).reshape(len(texts), -1)
                p = 1 / (1 + np.exp(-np.clip(x @ model.beta, -30, 30))) if len(texts) else np.zeros(0)
            else:
                p = np.full(len(texts), model.share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=schema.names)

    return docs.select(*others).mapInArrow(run, schema)
