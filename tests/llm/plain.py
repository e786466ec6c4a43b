"""Plain Python versions of the operators, for small fixtures."""

import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def crc(value, n):
    return zlib.crc32(str(value).encode()) % n


def dropped_lines(rows, least):
    """rows: (id, text). Per row (lines, dropped, kept text)."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for name, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((name, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, size, percent):
    rows = [(i, t) for i, t in rows if i is not None]
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return components({i for i, _ in rows}, links)


def leaks(text, items, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item_text or "").translate(LOWER))
        size = min(n, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if windows and tuple(w[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def base_scores(rows, trained):
    """rows: (id, text). (tokens, known, score) of each row."""
    counts = Counter()
    for name, text in rows:
        if trained(name):
            counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        t = [*words(text), None]
        out.append((len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in t)))
    return out, total
