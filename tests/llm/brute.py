"""Brute-force versions of the operators that SQL cannot express."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fingerprint(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    """Smallest id that each id reaches, ids without a null."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x) in enumerate(items):
        for j, y in items[:n]:
            if linked(x, y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}


def overlap(text, bench, n=10):
    w = ALNUM.findall(lower(text or ""))
    hit, items = set(), set()
    for item, t in bench:
        v = ALNUM.findall(lower(t or ""))
        size = min(n, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                items.add(str(item))
    return len(w), len(hit), len(items), sha(",".join(sorted(items)).encode())


def repeats(docs, n):
    """Covered positions of each sequence: windows of n that start earlier. docs: (id, sequence), ids ascending."""
    seen, out = set(), {}
    for i, s in docs:
        cov = set()
        for a in range(len(s) - n + 1):
            key = tuple(s[a : a + n]) if not isinstance(s, bytes) else s[a : a + n]
            if key in seen:
                cov |= set(range(a, a + n))
            seen.add(key)
        out[i] = cov
    return out
