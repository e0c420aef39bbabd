"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

The merges of such a tokenizer stay inside words that its pre-tokenizer cuts by the
character classes letter, number, blank and other.  Here numpy finds the same cuts for
a whole batch at once, the library encodes every distinct word once, and ids are
gathered from what it said.  Texts with characters beyond Cyrillic, whose classes may
differ between Unicode versions, are encoded whole by the library.
"""
from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

CHARS = 1 << 20  # characters handled at a time
TABLE_BITS = 21  # slots for remembered words; at half full a worker starts afresh
KNOWN = 0x530  # code points below are classed here
UNCLASSED = re.compile(f"[{chr(KNOWN)}-\U0010ffff]")
LETTER, NUMBER, BLANK, OTHER = range(4)
# Fixed values of the pre-tokenizer: endings that are words of their own.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(KNOWN)], np.uint8)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = BLANK
    return out


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: a printable
    byte for itself, the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_starts(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer begins words; ``first`` marks the first character of each text."""
    n = len(code)
    kind = classes[code]
    blank, space = kind == BLANK, code == 32
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first] = 9
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, first[1:]
    start = kind != before
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= ~first
    start &= ~(after_space & ~blank)  # the space begins that word
    ends_run = blank & ~last
    ends_run[:-1] &= ~blank[1:]
    start |= ends_run  # the last blank of a run is apart from the others
    for i in np.flatnonzero((code == 39) & start):
        tail = "".join(map(chr, code[i + 1:i + 3][np.cumsum(first[i + 1:i + 3]) == 0].tolist()))
        size = 1 if tail[:1] and tail[0] in SHORT_ENDINGS else 2 if tail in LONG_ENDINGS else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return start


class Encoder:
    """Encodes batches of texts; one per Python worker task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.classes, self.letters = _classes(), _byte_letters()
        self.power = _powers(BASE, 2 * CHARS)
        self.unpower = _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), 2 * CHARS)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.word = np.zeros(1 << TABLE_BITS, np.int32)
        self.words = self.used = 0
        self.at, self.length, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.spelt, self.letters_of, self.spelling, self.spelled = (np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64),
                                                                    np.zeros(1 << 14, np.uint32), 0)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there; else a free slot."""
        mask = (1 << TABLE_BITS) - 1
        slot = ((h * SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.key[slot[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return slot, self.key[slot] == h

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        for start in range(0, len(words), 4096):
            merge = self.library.model.tokenize
            ids = [[t.id for t in merge(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))]
                   for w in words[start:start + 4096]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
            while self.words + len(ids) > len(self.at):
                self.at, self.length, self.spelt, self.letters_of = (
                    np.concatenate([x, x]) for x in (self.at, self.length, self.spelt, self.letters_of))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            new = slice(self.words, self.words + len(ids))
            self.at[new], self.length[new] = self.used + np.cumsum(size) - size, size
            self.flat[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
            codes = np.frombuffer("".join(words[start:start + 4096]).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.fromiter(map(len, words[start:start + 4096]), np.int64, len(ids))
            while self.spelled + len(codes) > len(self.spelling):
                self.spelling = np.concatenate([self.spelling, self.spelling])
            self.spelt[new], self.letters_of[new] = self.spelled + np.cumsum(size) - size, size
            self.spelling[self.spelled:self.spelled + len(codes)] = codes
            self.spelled += len(codes)
            todo = np.arange(len(ids))
            while len(todo):  # of hashes that meet in a free slot, one stays
                slot, _ = self._slots(h[start:start + 4096][todo])
                self.key[slot] = h[start:start + 4096][todo]
                self.word[slot] = self.words + todo
                todo = todo[self.key[slot] != h[start:start + 4096][todo]]
            self.words += len(ids)

    def _gather(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts (none empty) in one array, and how many each has."""
        if self.words > 1 << (TABLE_BITS - 1):
            self._forget()
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(code), bool)
        first[begin[:-1]] = True
        s = np.flatnonzero(word_starts(code, first, self.classes))
        e = np.append(s[1:], len(code))
        if len(code) > len(self.power):
            self.power, self.unpower = _powers(BASE, len(code)), _powers(self.unpower[1], len(code))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[:len(code)], out=sums[1:])
        h = (sums[e] - sums[s]) * self.unpower[s] + (e - s).astype(np.uint64) * SPREAD
        h[h == 0] = 1
        slot, found = self._slots(h)
        if not found.all():
            fresh, at = np.unique(h[~found], return_index=True)
            at = np.flatnonzero(~found)[at]
            self._learn(fresh, [whole[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            slot, found = self._slots(h)
        w = self.word[slot]
        if not ((self.letters_of[w] == e - s).all()
                and (self.spelling[np.repeat(self.spelt[w] - s, e - s) + np.arange(len(code))] == code).all()):
            ids = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate(ids), np.array(list(map(len, ids)))  # two words have one hash
        size = self.length[w]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[w] - (ends - size), size) + np.arange(int(ends[-1]))]
        upto = np.append(ends, ends[-1])[np.searchsorted(e, begin[1:])]
        return ids, np.diff(upto, prepend=0)

    def _slices(self, text: str) -> Iterator[str]:
        """Consecutive parts of a long text, each ending before a lone space."""
        start = 0
        while len(text) - start > CHARS:
            cut = text.find(" ", start + CHARS)
            while cut > 0 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].isspace() or cut + 1 == len(text)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null and empty texts have none."""
        held: list[str] = []
        where: list[int] = []  # parts of a text that are held, 0 for an empty one
        for text in texts:
            text = text or ""
            plain = text.isascii() or not UNCLASSED.search(text)
            parts = list(self._slices(text)) if plain and text else []
            if not plain or len(parts) > 1:
                yield from self._release(held, where)
                held, where = [], []
                if plain:
                    yield np.concatenate([self._gather([p])[0] for p in parts])
                else:
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            held += parts
            where.append(len(parts))
            if sum(map(len, held[-1:])) + self._size > CHARS:
                yield from self._release(held, where)
                held, where = [], []
            else:
                self._size += len(text)
        yield from self._release(held, where)

    _size = 0

    def _release(self, held: list[str], where: list[int]) -> Iterator[np.ndarray]:
        self._size = 0
        if not held:
            yield from (np.zeros(0, np.uint32) for _ in where)
            return
        ids, counts = self._gather(held)
        ends, k = np.cumsum(counts), 0
        for parts in where:
            if parts:
                yield ids[ends[k] - counts[k]:ends[k]]
                k += 1
            else:
                yield np.zeros(0, np.uint32)
