"""N-gram Jaccard join by parity sketches: classes, links and components of near-equal texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text lower-cased A-Z; a text's set holds its
distinct five-word shingles, with fewer words the whole sequence as one.  Two texts link
when 100 * intersection >= 80 * union.  Texts of equal sets form a class first.

For linked sets of sizes a <= b the symmetric difference is at most (a + b) / 9 and b at
most 5/4 a.  Sizes fall into bands of that ratio.  Within a level (a band and the next
one) shingles are dealt by hash into k blocks, and a block's word is the XOR of its
shingles: every shingle that two sets do not share changes one block, so the number of
differing words, a Hamming distance, is at most the symmetric difference.  At most
a / 4 words of the smaller set can differ; it has more words than that (checked for
every document, k grows until it holds), so linked sets share the word of a block that
is not empty, and equal words at equal places give all candidates (pigeonhole).

Words shared by two classes give a pair; words shared by more give first the pairs with
the class that shares most words of all (the text that the others were copied from, if
there is one).  They are verified and merged into components; only members of a word that
are still in different components are then compared in pairs, inside tiles of bounded
size.  Before sets are read, pairs go through a parity sketch of two bits a shingle and
more, whose Hamming distance is at most the symmetric difference too.  Every surviving
pair is verified on the sets (64-bit shingle hashes).  No pair is dropped and no link
missed.

A class is named by the 128-bit hash of its set.  One pass over the texts gives, per
document, its class, set size and bit sketch and, per class, the words of its blocks; the
words are dealt by hash over tasks of bounded size, where equal words meet.

Null and empty texts have an empty set and link with nothing.  Ids are integers; a row
with a null id is linked like others, but null is not the smallest id of a component (its
component is null if no row in it has an id).  Repeated rows are rows of one class.  An
empty table gives an empty result; columns but the id and text are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import attach_groups, bounded_batches, salted, same, shuffle_partitions, written
from tally.llm.components import components

WIDTH = 5
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MOST_WORDS = 300_000  # hashes a worker remembers
LEAST_TASKS = 48  # in which words meet, so that rows of words do not grow faster than words from small inputs on
BYTES_PER_TASK = 20_000_000  # of text whose block words one task compares (a word for ten bytes or so)
TILE = 512
TOP = 1 << 40  # no set is larger


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * SPREAD
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: Iterable[str | None], known: _Hashes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            yield np.zeros(0, np.uint64)
            continue
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(w))
        h = np.full(len(w) - width + 1, width, np.uint64)
        for i in range(width):
            h = h * BASE + w[i:len(w) - width + 1 + i]
        yield np.unique(_mixed(h))
        if len(known) > MOST_WORDS:
            known.clear()


def _bands() -> np.ndarray:
    first = [1]
    while first[-1] < TOP:
        first.append(max(first[-1] + 1, -(-5 * first[-1] // 4)))
    return np.array(first, np.int64)


BANDS = _bands()


def band(n: int) -> int:
    return int(np.searchsorted(BANDS, n, side="right")) - 1


def blocks(level: int, grown: dict[int, int]) -> int:
    """Blocks of a level; 0 where only equal sets can link."""
    most = int(BANDS[level + 1]) - 1  # size of the smaller set of a pair
    if most // 4 == 0:
        return 0
    k = 4096 if most < 64 else int(1.03 * (most // 4 + 1) + 0.6 * most ** 0.5) + 6
    return k << grown.get(level, 0)


def block_words(shingles: np.ndarray, level: int, k: int) -> np.ndarray:
    """The words of the blocks that are not empty, each hashed with its level and place."""
    place = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    # sorted shingles come in order of their place
    starts = np.flatnonzero(np.diff(place, prepend=np.uint64(k)))
    word = np.bitwise_xor.reduceat(shingles, starts)
    return _mixed(word * BASE + place[starts] * SPREAD + np.uint64(level + 1))


def parity_bits(shingles: np.ndarray) -> bytes:
    """One bit toggled per shingle, in at least twice as many bits as shingles (a power of two, 64 or more)."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    plane = np.bincount((_mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(plane.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The parity sketch in so many 64-bit words: halves XOR, as bits are hash mod size."""
    s = np.frombuffer(sketch, "<u8")
    while len(s) > words:
        s = s[:len(s) // 2] ^ s[len(s) // 2:]
    return s


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow of a function that yields the column lists of batches."""
    fields = pa.schema([pa.field(n, TYPES[t]) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)],
                    schema=fields)

    return df.mapInArrow(run, schema)


def _levels(n: int) -> list[int]:
    """The levels in which a set of size n takes part: its own band and the one below."""
    return [at for at in (band(n), band(n) - 1) if at >= 0 and blocks(at, {})] if n else []


# kind 0: a document (id, its class a, n, bits, the level in which it has too few words or -1);
# kind 1: block words of class a; after they met, 1: classes a and b share a word, 2: class b has
# the word, as do at least two others
ROW = "part int, kind int, id long, a binary, n long, bits binary, short int, words binary"
MET = "kind int, id long, a binary, b binary, n long, bits binary, short int, word long"


def _documents_and_words(grown: dict[int, int], tasks: int) -> Callable:
    def fn(batches):
        known, count = _Hashes(), 0
        for batch in batches:
            out: list[tuple] = []
            sent: set[bytes] = set()
            for v, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), known), strict=True):
                name, levels, short, words = xxhash.xxh3_128_digest(s.tobytes()), _levels(len(s)), -1, []
                for at in levels:
                    words.append(block_words(s, at, blocks(at, grown)))
                    if at == band(len(s)) and len(words[-1]) <= len(s) // 4:
                        short = at
                out.append((count % tasks, 0, v, name, len(s), parity_bits(s), short, None))
                count += 1
                if not words or name in sent:
                    continue
                sent.add(name)
                words = np.concatenate(words)
                to = (words % np.uint64(tasks)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                words, to = words[order], to[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                raw, ends = words.tobytes(), [*(8 * cuts[1:]).tolist(), 8 * len(to)]
                out += [(p, 1, None, name, None, None, None, raw[x:y])
                        for p, x, y in zip(to[cuts].tolist(), (8 * cuts).tolist(), ends, strict=True)]
            if out:
                yield list(zip(*out, strict=True))

    return fn


def _classes_of(names: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The sorted distinct names, and the place of each given one."""
    distinct = sorted(set(names))
    place = {x: i for i, x in enumerate(distinct)}
    return distinct, np.fromiter(map(place.__getitem__, names), np.int64, len(names))


def _meet(batches):
    """Documents as they are, and the words of one task that more than one class has."""
    owner, size, held = [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        docs = batch.filter(pa.array(kind == 0))
        if docs.num_rows:
            none = [None] * docs.num_rows
            yield [docs.column("kind"), docs.column("id"), docs.column("a"), none, docs.column("n"), docs.column("bits"), docs.column("short"), none]
        rest = batch.filter(pa.array(kind == 1))
        raw = rest.column("words").to_pylist()
        owner += rest.column("a").to_pylist()
        size += [len(x) // 8 for x in raw]
        held.append(b"".join(raw))
    if not owner:
        return
    names, who = _classes_of(owner)
    who = np.repeat(who, size)
    key = np.frombuffer(b"".join(held), "<u8")
    del owner, held
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who = key[keep], who[keep]
    starts = np.flatnonzero(np.diff(key, prepend=~key[0]))
    sizes = np.diff(starts, append=len(key))
    two = starts[sizes == 2]
    pairs = np.unique(who[two] * len(names) + who[two + 1])
    yield _met(1, [names[i] for i in (pairs // len(names)).tolist()], [names[i] for i in (pairs % len(names)).tolist()], [None] * len(pairs))
    many, sizes = starts[sizes > 2], sizes[sizes > 2]
    at = np.repeat(many, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for x in range(0, len(at), 50_000):
        piece = at[x:x + 50_000]
        yield _met(2, [None] * len(piece), [names[i] for i in who[piece].tolist()], key[piece].view(np.int64))


def _met(kind: int, a: list, b: list, word) -> list:
    none = [None] * len(a)
    return [[kind] * len(a), none, a, b, none, none, none, word]


def _sets(batches):
    """Class and set of each text, once per task."""
    known, sent = _Hashes(), set()
    for batch in batches:
        names, sets = [], []
        for s in shingle_sets(batch.column(0).to_pylist(), known):
            raw = s.tobytes()
            name = xxhash.xxh3_128_digest(raw)
            if name not in sent:
                sent.add(name)
                names.append(name)
                sets.append(raw)
        yield [names, sets]


def _verify(batches):
    for batch in batches:
        a, b, sa, sb = (batch.column(i).to_pylist() for i in range(4))
        yes = [i for i in range(len(a)) if linked(np.frombuffer(sa[i], "<u8"), np.frombuffer(sb[i], "<u8"))]
        yield [[a[i] for i in yes], [b[i] for i in yes]]


def _near(n: int, m: int, far: int) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * far <= n + m


def _sketches_near(batches):
    for batch in batches:
        a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
        yes = []
        for i in range(len(a)):
            words = min(len(sa[i]), len(sb[i])) // 8
            far = int(np.bitwise_count(folded(sa[i], words) ^ folded(sb[i], words)).sum())
            if _near(na[i], nb[i], far):
                yes.append(i)
        yield [[a[i] for i in yes], [b[i] for i in yes]]


def _tile_pairs(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Pairs of one tile that sizes, components and sketches allow."""
    low, high = rows[0][1:3]
    _, label = _classes_of([r[4] for r in rows])
    n, side = (np.array([r[i] for r in rows], np.int64) for i in (5, 6))
    words = min(len(r[7]) for r in rows) // 8
    sketch = np.stack([folded(r[7], words) for r in rows])
    out = []
    for i in np.flatnonzero(side == low).tolist():
        other = np.flatnonzero((label != label[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
                               & ((side == high) if low != high else (np.arange(len(rows)) > i)))
        far = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1)
        out += [(min(rows[i][3], rows[k][3]), max(rows[i][3], rows[k][3])) for k in other[far * 9 <= n[other] + n[i]].tolist()]
    return out


def _tiles(batches):
    held: list[tuple] = []
    for batch in batches:
        found: set[tuple[bytes, bytes]] = set()
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                found.update(_tile_pairs(held))
                held = []
            held.append(row)
        if found:
            yield list(zip(*sorted(found), strict=True))
    if held and (found := set(_tile_pairs(held))):
        yield list(zip(*sorted(found), strict=True))


def _both_sides(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the facts (v, columns) of both.  A class with very many partners is spread by salt."""
    pairs = salted(pairs.select("a", "b"), "b")
    of = lambda side: facts.select(F.col("v").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    left = pairs.select("a", "_salt").distinct().join(of("a"), "a")
    full = pairs.join(of("b"), "b").join(left, ["a", "_salt"])
    return full.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, as (v, u)."""
    pairs = written(pairs, "join-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    wanted = written(wanted.join(classes.select("v", "id"), "v").select("id").distinct(), "join-wanted")
    sets = written(_mapped(same(texts, wanted, ["id"], "left_semi").select("text"), _sets, "v binary, shingles binary"), "join-sets")
    return written(_mapped(_both_sides(pairs, sets, "shingles"), _verify, "v binary, u binary"), "join-links")


def _with_most_shared(shared: DataFrame) -> DataFrame:
    """Per word, the pairs of each class with the one that shares most words."""
    rows = shared.join(shared.groupBy("v").agg(F.count("*").alias("n")), "v")
    rows = attach_groups(salted(rows, "v"), ["word"], {"most": F.max(F.struct("n", "v"))}, {"most": F.max("most")})
    return rows.select(F.least("v", "most.v").alias("a"), F.greatest("v", "most.v").alias("b")).filter("a <> b")


def _left_to_compare(shared: DataFrame, labels: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Pairs of classes that share a word with others but not yet a component."""
    rows = shared.join(labels, "v", "left").select("word", "v", F.coalesce("component", "v").alias("label"))
    rows = attach_groups(salted(rows, "v"), ["word"],
                         {"first": F.min("label"), "last": F.max("label"), "size": F.count("*")},
                         {"first": F.min("first"), "last": F.max("last"), "size": F.sum("size")})
    rows = rows.filter("first <> last").withColumn("parts", F.ceil(F.col("size") / TILE).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("v", F.lit(7)), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(classes.select("v", "n", "bits"), "v").select(
        "word", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "v", "label", "n", "side", "bits")
    rows = rows.repartition(tasks, "word", "low", "high").sortWithinPartitions("word", "low", "high")
    return _mapped(rows, _tiles, "a binary, b binary").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(LEAST_TASKS, shuffle_partitions(spark), -(-size // BYTES_PER_TASK))

    grown: dict[int, int] = {}
    while True:
        dealt = _mapped(texts, _documents_and_words(grown, tasks), ROW).repartitionById(tasks, "part")
        met = written(_mapped(dealt, _meet, MET), "join-met")
        rows = met.filter("kind = 0").select("id", F.col("a").alias("v"), "n", "bits", "short")
        short = [r[0] for r in rows.filter("short >= 0").select("short").distinct().collect()]  # at most one per band
        if not short:
            break
        grown.update({level: grown.get(level, 0) + 1 for level in short})

    classes = written(rows.filter("n > 0").groupBy("v").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")),
                      "join-classes")
    shared = met.filter("kind = 2").select("word", F.col("b").alias("v"))
    pairs = met.filter("kind = 1").select("a", "b").unionByName(_with_most_shared(shared)).distinct()
    pairs = _mapped(_both_sides(pairs, classes, "n", "bits"), _sketches_near, "a binary, b binary")

    labels = written(components(_verified(pairs, classes, texts)), "join-labels")
    rest = _verified(_left_to_compare(shared, labels, classes, tasks), classes, texts)
    if not rest.isEmpty():
        labels = components(labels.select("v", F.col("component").alias("u")).unionByName(rest))

    named = classes.select("v", "id").join(labels, "v", "left").select("v", "id", F.coalesce("component", "v").alias("component"))
    least = {"least": F.min("id")}
    named = attach_groups(salted(named, "v"), ["component"], least, {"least": F.min("least")}).select("v", F.col("least").alias("component_id"))
    full = attach_groups(salted(rows.filter("n > 0").select("id", "v", "n"), "id"), ["v"], {"rows": F.count("*")}, {"rows": F.sum("rows")},
                         lambda keys: keys.join(named, "v"))
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.select("id", "n", "component_id").unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
