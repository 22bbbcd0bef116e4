"""Plain versions of the operators for small tables; documents are lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingle_set(text, n):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(docs, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in docs}
    ids, parent = sorted(sets), {i: i for i in sets}
    by_gram = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            by_gram[g].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        common = Counter(j for g in sets[i] for j in by_gram[g] if j < i)
        for j, c in common.items():
            if c * den >= (len(sets[i]) + len(sets[j]) - c) * num:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def contained(docs, items, n=5, share=0.8):
    out = set()
    for item_id, text in items:
        w = words(text, True)
        if not w:
            continue
        m = min(n, len(w))
        want = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for doc_id, body in docs:
            b = words(body, True)
            if len(want & {tuple(b[i : i + m]) for i in range(len(b) - m + 1)}) >= share * len(want):
                out.add((doc_id, item_id))
    return out


def substrings(docs, span=50):
    low = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if low[tuple(w[k : k + span])] < i:
                gone[k : k + span] = [True] * span
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def repeated_bytes(docs, size=400):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edits(docs):
    rows = sorted(docs, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
