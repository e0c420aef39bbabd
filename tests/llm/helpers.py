"""Plain-Python models of the operators' definitions."""
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def components(sets):
    """Smallest reachable id of every id, from all pairs that share a shingle."""
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in sets.items():
        for o in {o for x in s for o in at[x] if o > k}:
            if linked(s, sets[o]):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
    return {k: find(k) for k in sets}
