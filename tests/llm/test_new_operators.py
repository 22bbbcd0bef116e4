"""Filter audit, resampling and SimHash against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import filters, resampling, simhash

from .test_operators import DOCS

SAY = random.Random(31)


def odd_rows():
    """Rows of DOCS with parts, nulls in every column, repeated doc_ids and texts, and a text of some megabytes."""
    rows = [(i, t, [None, "", "web", "wiki", "news"][i % 5]) for i, t in DOCS]
    rows += [(rows[50][0], rows[50][1], "web"), (rows[3][0], rows[7][1], "wiki"), (None, rows[50][1], None), (None, None, "web"), (2001, "A B C # d", "web"), (2002, "SHOUT " * 60, "wiki"), (2003, "SHOUT " * 60, "news")]
    rows.append((3000, " ".join(SAY.choice(["red", "Green", "blue", "é", "x%"]) + str(SAY.randrange(9000)) for _ in range(300_000)), "long"))
    return rows


ROWS = odd_rows()
LABELS = [(i, n % 3 % 2, n % 4 % 2) for n, (i, _, _) in enumerate(ROWS) if n % 2] + [(ROWS[0][0], 0, 0), (ROWS[0][0], 1, None), (None, 1, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def documents(spark):
    wide = [(*r, 5, 6, 7, 8, 9, 10, True) for r in ROWS]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, n long, row long, part int, fp long, word int, digest int, first boolean").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in LABELS], "doc_id long, quality int, toxic int, n int, part string")


def test_filter_audit(spark, documents, labels):
    least = {}
    for i, t, _ in ROWS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        held = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in t for c in "#$%&*|"), i is not None and i > least[t]]
        return {f for f, x in zip("ABCDE", held, strict=True) if x}

    good, toxic = {i for i, q, _ in LABELS if q == 1} - {None}, {i for i, _, x in LABELS if x == 1} - {None}
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filters.interactions(documents, labels).collect()}
    assert len(got) == 600 * (len({p or "" for _, _, p in ROWS}) + 1)
    for part in {p or "" for _, _, p in ROWS} | {None}:
        mine = [(i, fails(i, t)) for i, t, p in ROWS if part is None or (p or "") == part]
        shapley, want = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(out)
                all_failing = sum(f in x[1] for x in mine)
                want["".join(order), step] = (len(left), len(out), all_failing - len(out), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out))
        for (order, step), values in want.items():
            r = got[part, order, step]
            assert r["whole"] is (part is None) and r["filter"] == order[step - 1]
            assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == (*values, shapley[order[step - 1]])
    assert filters.interactions(documents.limit(0), labels).count() == 0
    none = filters.interactions(documents, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_pieces_hold_whole_words():
    raw = " \t".join(SAY.choice(["a", "bb" * 40, "ü"]) for _ in range(900)).encode()
    for size in (1, 7, 100, 1 << 20):
        got = list(filters.pieces(raw, size))
        assert b"".join(got) == raw and [w for p in got for w in p.split()] == raw.split()


def plain_resampling(rows, target, orders=2, buckets=10_000, percent=25, least=20, seed=7):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, orders + 1) for k in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, words])
    among = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for place, r in enumerate(among[: percent * len(among) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(2, 10_000, 25), (3, 64, 60), (1, 7, 100)])
def test_resampling(spark, documents, orders, buckets, percent):
    target = [DOCS[51][1], "", None, "Some Other Words é", DOCS[3][1]]
    wanted = spark.createDataFrame([(i, t, 3) for i, t in enumerate(target)], "item_id long, text string, row int")
    got = sorted((tuple(r) for r in resampling.resample(documents, wanted, orders, buckets, percent).collect()), key=repr)
    assert got == plain_resampling([(i, t) for i, t, _ in ROWS], target, orders, buckets, percent)


def test_resampling_of_empty_tables(spark, documents):
    nothing = documents.limit(0)
    assert resampling.resample(nothing, documents).count() == 0
    got = sorted((tuple(r) for r in resampling.resample(documents, nothing).collect()), key=repr)
    assert got == plain_resampling([(i, t) for i, t, _ in ROWS], [])


def plain_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_simhash(spark, documents):
    prints = [(i, plain_fingerprint(t)) for i, t, _ in ROWS]
    named = [(i, f) for i, f in prints if i is not None]
    edges = [(i, j) for (i, f), (j, g) in itertools.combinations(named, 2) if (f ^ g).bit_count() <= 2]
    low = plain_components({i for i, _ in named}, edges)
    want = sorted(((i, f"{f:016x}", low.get(i)) for i, f in prints), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(documents).collect()), key=repr) == want
    assert len({w[2] for w in want}) < len(want) and simhash.near_duplicates(documents.limit(0)).count() == 0


def test_fingerprints_of_pieces(monkeypatch):
    text = " ".join(SAY.choice(["Aa", "b", "cé" * 9, "d\x1ce"]) for _ in range(500))
    want = [plain_fingerprint(x) for x in (text, "one two", "one", " \n", None)]
    monkeypatch.setattr(simhash, "pieces", lambda raw: filters.pieces(raw, 9))
    monkeypatch.setattr(simhash, "BLOCK", 5)
    assert [simhash.fingerprint(x) for x in (text, "one two", "one", " \n", None)] == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("kind", ["random", "dense", "chain"])
def test_links_of_fingerprints(spark, kind):
    rnd = random.Random(kind)
    if kind == "random":  # clusters of up to four differing bits, all ones and all zeros
        base = [rnd.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
        prints = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(6)}
    elif kind == "dense":  # one cell holds hundreds: pairs of bits 01 and 10 have the same popcounts
        prints = {sum((1 if rnd.random() < 0.5 else 2) << 2 * k for k in range(9)) | rnd.getrandbits(1) << 63 for _ in range(700)}
    else:
        prints, at = set(), rnd.getrandbits(64)
        for _ in range(300):
            prints.add(at)
            at ^= sum(1 << k for k in rnd.sample(range(64), rnd.choice([1, 2, 2, 2, 3])))
    prints = sorted(map(signed, prints))
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert set(map(frozenset, found)) <= set(map(frozenset, near)) and len(near) > 100
    assert plain_components(prints, found) == plain_components(prints, near)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long").select("fp", simhash.embedding("fp").alias("e")).collect()
    assert all((r["e"] >> 2 * k) & 3 == (r["fp"] >> 2 * k & 3).bit_count() for r in rows for k in range(32))
