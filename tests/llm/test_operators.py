"""Each training-data operator against a plain version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontamination, fingerprints, licenses, minhash, packing, quality, sharding, shingles, substrings, suffixes, token_counts
from skein.llm.common import Recent, components, numbered

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def corpus():
    """Distinct texts, exact and near copies, shared passages, empty, short, non-Latin and long ones."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgilmnorstuáß") for _ in range(rnd.randint(1, 9))) for _ in range(700)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [say(rnd.randint(1, 160)) for _ in range(50)]
    base = say(200)
    texts += [base, base, base.upper(), base + " tail"]
    for _ in range(25):
        w = base.split()
        for _ in range(rnd.randint(1, 14)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(" ".join(w))
    passage = say(90)
    texts += [f"{say(30)} {passage} {say(20)}" for _ in range(6)] + [passage, f"{passage} {passage}", " ".join(passage.split()[:49]), " ".join(passage.split()[10:60])]
    texts += ["", None, "one", "one two", "one  two\t", "Общий текст 中文 字", "a" * 900, "ab" * 500, "License: CC BY 4.0. All rights reserved; GNU General Public License", "x\x1cy\x85z <|endoftext|> end", say(7000)]
    return [(i * 3 % 997, t) for i, t in enumerate(texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "src0", len(t or ""), 1, 2) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key long").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_near_duplicates(documents, nothing):
    for n, share in ((3, Fraction(85, 100)), (5, Fraction(4, 5))):
        got = by_id(minhash.near_duplicates(documents, n, share), "n_shingles", "component_id", "kept")
        assert got == brute.near_duplicates(DOCS, n, share.numerator, share.denominator)
    assert minhash.near_duplicates(nothing, 3).count() == 0
    kept = minhash.keep_one(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in brute.near_duplicates(DOCS, 5, 4, 5).items() if v[2]}


def test_near_duplicates_of_odd_rows(spark):
    t = "alpha beta gamma delta epsilon"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (7, "else where all new words"), (9, t), (8, "else where all new words")], "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3).collect())))
    assert got == sorted(map(str, [(None, None, True), (7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False), (8, 7, False)]))


def test_texts_of_one_doc_id_keep_their_links(spark):
    rnd = random.Random(17)
    say = lambda: [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(60)]
    one, two, three = say(), say(), say()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(3, " ".join(one)), (3, " ".join(two)), (5, near(one)), (6, near(two)), (4, " ".join(three)), (9, near(three)), (9, near(two))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3).collect()}
    assert got == {(3, 3, True), (5, 3, False), (6, 3, False), (4, 3, False), (9, 3, False)}


def test_links_missed_by_hubs_are_found(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEFT", 3)
    monkeypatch.setattr(minhash, "RIGHT", 5)
    # a chain in which only neighbours are alike: every hub misses most of it
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w[(i * 7) % 60] = f"v{rnd.randrange(10**6)}"
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows, 3, 4, 5)


def test_bit_estimate():
    rnd = np.random.default_rng(1)
    low = rnd.integers(0, 1 << 32, minhash.K, dtype=np.uint32)
    other = low.copy()
    other[: minhash.K // 4] = rnd.integers(0, 1 << 32, minhash.K // 4, dtype=np.uint32)
    planes = [np.frombuffer(minhash.pack(x), np.uint8).reshape(minhash.BITS, -1) for x in (low, other)]
    assert minhash.estimate(planes[0], planes[0][None])[0] == 1
    assert abs(minhash.estimate(planes[0], planes[1][None])[0] - 0.75) < 0.05


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {n: low[n] for a, b in edges if a != b for n in (a, b)}


def test_sharding(documents, nothing):
    rows = sharding.shard(documents, shards=7).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in DOCS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = dict(DOCS)
    assert all(r["text_crc32"] == brute.crc(texts[r["doc_id"]]) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in rows)
    again = sharding.shard(documents.repartition(5), shards=7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard(nothing).count() == 0


def test_shards_against_a_plain_network(spark):
    rnd = random.Random(13)
    rows = [(None if i % 50 == 7 else i % 97, "x" * rnd.randrange(5) if i % 9 else None) for i in range(211)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=7, seed=5).collect()
    n, whole = len(rows), 1 << 64
    left = next(k for k in range(1, n + 1) if k * k >= n)
    right = -(-n // left)

    def mix(x, key):
        x = (x + key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % whole
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    def walked(x):
        while True:
            a, b = divmod(x, right)
            for r in range(sharding.ROUNDS):
                if r % 2 == 0:
                    a = (a + mix(b, 5 * sharding.ROUNDS + r) % left) % left
                else:
                    b = (b + mix(a, 5 * sharding.ROUNDS + r) % right) % right
            x = a * right + b
            if x < n:
                return x

    keys = sorted(((i is not None, i or 0), brute.crc(t), len(t or "") + 16) for i, t in rows)
    want = Counter((i if there else None, size, crc, walked(k) % 7, walked(k) // 7) for k, ((there, i), crc, size) in enumerate(keys))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 12345])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n)) and (sharding.permute(p, n, 7, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (p != np.arange(n)).mean() > 0.9 and (p != sharding.permute(np.arange(n), n, 8)).any()


def test_row_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (5, None, 3, 3, 9)], "x long")
    got, n = numbered(df, "x", name="k")
    assert n == 5 and [(r["x"], r["k"]) for r in got.orderBy("k").collect()] == [(None, 0), (3, 1), (3, 2), (5, 3), (9, 4)]


def test_decontamination(spark, documents, nothing):
    texts = [t for _, t in DOCS if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[5 : 5 + 6 + 3 * k])) for k, t in enumerate(texts[:12])] + [(50, "nowhere to be found in any of these at all"), (51, None), (52, ""), (53, "one two"), (54, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(documents, bench).collect()}
    assert got == brute.contained(DOCS, items)
    clean = decontamination.decontaminate(documents, bench)
    assert clean.columns == documents.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in DOCS} - {d for d, _ in got}
    assert decontamination.find(nothing, bench).count() == 0 and decontamination.find(documents, bench.limit(0)).count() == 0


def test_items_in_blocks(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(DOCS[:20])], "item_id long, text string")
    whole = {tuple(r) for r in decontamination.find(documents, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 6)
    assert {tuple(r) for r in decontamination.find(documents, bench).collect()} == whole


def test_fingerprints(spark, documents, nothing):
    df = fingerprints.fingerprint(documents)
    assert by_id(df, "n_chars", "edited_sha256") == brute.edits(DOCS)
    got = by_id(df, "fingerprint", "near_edited", "near_next")
    texts, same = dict(DOCS), defaultdict(set)
    for i, (f, a, b) in got.items():
        same[texts[i] or ""].add(f)
        assert 0 <= a <= 1 and 0 <= b <= 1
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint(nothing).count() == 0
    alone = fingerprints.fingerprint(spark.createDataFrame([(1, "only one here")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0
    ties = spark.createDataFrame([(None, "b c"), (None, None), (4, "x y z"), (4, "q")], "doc_id long, text string")
    assert fingerprints.fingerprint(ties).count() == 4


def plain_fingerprint(text):
    """Values of a text by plain winnowing: windows one by one, least hash, rightmost among ties."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    spelled = lambda s, seed=42: signed(xxhash.xxh64_intdigest(s.encode(), seed))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    low = (1 << 27) - 1

    def winnowed(units, start=0, every=False):
        if len(units) < 4:
            return None
        grams = [pair(pair(*units[i : i + 2]), pair(*units[i + 2 : i + 4])) for i in range(len(units) - 3)]
        values = [g & (((1 << 63) - 1) ^ low) | (low - start) - i for i, g in enumerate(grams)]
        if every:
            return values
        out = []
        for i in range(max(1, len(values) - 15)):
            least = min(values[i : i + 16], key=lambda v: (v >> 27, v))
            if least not in out:
                out.append(least)
        return out

    words = [p for w in re.split(r"\s+", text) for p in (list(w) if len(w) > 24 else [w])]
    found = winnowed([spelled(w) for w in words])
    characters = []
    if 0 < len(text) <= 1024 and len(text) >= 4:
        units = [spelled(c, xxhash.xxh64_intdigest(struct.pack("<i", 1 << 26), 42)) for c in text]
        characters = winnowed(units, 1 << 26, len(text) < 38)
    return found and found + characters


def test_fingerprints_against_plain_winnowing(spark):
    rnd = random.Random(44)
    say = lambda n: " ".join(rnd.choice(["ab", "c", "def", "gh", "i" * 30, "é", "x1"]) for _ in range(n))
    rows = [(i, say(n)) for i, n in enumerate([4, 5, 9, 19, 20, 30, 60, 150, 400, 700, 7, 12])]
    got = by_id(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        a, e, b = map(plain_fingerprint, (t, t[: len(t) - half] + following[:half], following))
        assert got[i][0] == " ".join(f"{v:X}" for v in a)
        if e is None:
            continue
        assert got[i][1] == " ".join(f"{v:X}" for v in e)
        assert abs(got[i][2] - plain_likeness(a, e)) < 1e-12 and abs(got[i][3] - plain_likeness(a, b)) < 1e-12


def plain_likeness(a, b):
    """Of characters too if both texts have values of them, else of words alone."""
    of_words = lambda x: [v for v in x if (1 << 27) - 1 - (v & ((1 << 27) - 1)) < 1 << 26]
    if len(of_words(a)) == len(a) or len(of_words(b)) == len(b):
        a, b = of_words(a), of_words(b)
    a, b = ({v >> 27 for v in x} for x in (a, b))
    return len(a & b) / len(a | b)


def test_long_texts_with_a_short_edit_keep_their_likeness(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = []
    for k, n in enumerate([190, 200, 215, 230, 250, 260]):
        rows += [(2 * k, say(n)), (2 * k + 1, ["", "x y z", say(8)][k % 3])]
    got = by_id(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), "near_edited", "near_next")
    for k in range(0, len(rows), 2):
        text, following = rows[k][1], rows[k + 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert len(text) > fingerprints.SHORT >= len(edited)
        low = lambda t: {v >> 27 for v in plain_fingerprint(t) if (1 << 27) - 1 - (v & ((1 << 27) - 1)) < 1 << 26}
        assert got[rows[k][0]][0] >= len(low(text) & low(edited)) / len(low(text) | low(edited)) > 0.3


def test_winnowing_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(fingerprints.WINDOW + fingerprints.GRAM - 1))
    rows = [(1, " ".join(f"a{i}" for i in range(57)) + " " + shared), (2, shared + " " + " ".join(f"b{i}" for i in range(83)))]
    df = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "sel").select(F.transform("sel", lambda v: F.shiftright(v, fingerprints.POSITION_BITS)).alias("h")).collect()
    assert set(df[0]["h"]) & set(df[1]["h"])


def test_rightmost_ties(spark):
    text = " ".join(["w"] * 40)
    sel = fingerprints.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "sel").first()["sel"]
    places = [((1 << 27) - 1) - (v & ((1 << 27) - 1)) for v in sel]
    assert places == list(range(fingerprints.WINDOW - 1, 40 - fingerprints.GRAM + 1))


def test_half_of_a_short_or_unspaced_text_is_found(spark):
    rnd = random.Random(12)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    spoken = lambda n: " ".join(letters(rnd.randint(1, 9)) for _ in range(n))
    texts = [letters(n) for n in (7, 8, 12, 37, 38, 75, 76, 1023, 1024, 1025, 3000)] + ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n)) for n in (9, 40, 1500)]
    texts += [spoken(n) for n in (2, 3, 5, 9, 18, 19, 20, 37, 38, 150, 160, 170, 180, 190)] + [" ".join(letters(24) for _ in range(n)) for n in (5, 39, 41, 42)] + [" ".join(letters(25) for _ in range(60))]
    texts = [t for t in texts if len(t) >= 2 * fingerprints.GRAM - 1]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, ["", "x", spoken(400)][i % 3]) for i in range(len(texts))]  # each is edited with the one after it
    got = by_id(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), "near_edited")
    assert [t for i, t in rows[: len(texts)] if got[i][0] == 0] == []


def test_packing(documents, nothing):
    from tokenizers import Tokenizer

    coder, want = Tokenizer.from_file(WORD), {}
    for i, t in DOCS:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 512):
            want[i, k // 512] = (k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes()))
    rows = packing.pack(documents, WORD, 512).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 512 + 1
    assert packing.pack(nothing, WORD).count() == 0


def test_fullest_combination():
    rnd = random.Random(4)
    for _ in range(60):
        counts, room = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))), rnd.randint(1, 90)
        got = packing.fullest(dict(counts), room)
        assert not Counter(got) - counts
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        assert sum(got) == max(s for s in sums if s <= room)
    bins = packing.combinations({60: 5, 40: 5, 100: 2, 3: 1}, 100)
    assert sum(t for t, _ in bins) == 8


def test_suffix_dedup(documents, nothing, monkeypatch):
    for size in (400, 240):
        got = by_id(suffixes.dedup(documents, size), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.repeated_bytes(DOCS, size)
    monkeypatch.setattr(suffixes, "_STRETCH", 3000)  # long texts are hashed in several stretches
    monkeypatch.setattr(suffixes, "PART_ENTRIES", 5)
    monkeypatch.setattr(suffixes, "HOT", 3)  # frequent anchors are dealt over several partitions
    assert by_id(suffixes.dedup(documents, 240), "n_bytes", "n_removed", "n_spans", "kept_sha256") == got
    assert suffixes.dedup(nothing).count() == 0
    out = suffixes.cleaned(documents, 240)
    assert out.columns == documents.columns and out.count() == len(DOCS)
    texts = dict(DOCS)
    for r in out.collect():
        assert (r["text"] is None) == (texts[r["doc_id"]] is None)


def test_suffixes_of_repeated_rows(spark):
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcd é") for _ in range(700))
    df = spark.createDataFrame([(1, t), (1, t), (None, "zz" + t[100:600])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"] == r["n_bytes"]) for r in suffixes.dedup(df).collect()) == [(0, False), (1, True), (1, True)]


def test_loser_tree():
    rnd = random.Random(6)
    for _ in range(40):
        streams = []
        for k in range(rnd.randint(1, 7)):
            keys = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9)))
            streams.append([(suffixes.shared_prefix(p, x), x, 0, [(k, 0)]) for p, x in zip([b"", *keys], keys)])
        out = list(suffixes.merge([iter(s) for s in streams]))
        keys = [e[1] for e in out]
        assert keys == sorted(e[1] for s in streams for e in s)
        assert [e[0] for e in out[1:]] == [suffixes.shared_prefix(a, b) for a, b in zip(keys, keys[1:])]


def test_front_coding():
    entries = [(b"abc", 1, [(1, 2, 9)]), (b"abd", 2, [(3, 4, 0), (5, 6, 1)]), (b"b", 0, [(7, 8, 2)])]
    piece = dict(zip([c.split(" ")[0] for c in suffixes._RUN.split(", ")], suffixes._coded(0, 0, 0, entries), strict=True))
    assert [(k, a, p) for _, k, a, p in suffixes.decoded([piece, piece])] == entries * 2


def test_token_counts(documents, nothing):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BYTE)
    want = {i: (len((t or "").encode()), n := len(coder.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in DOCS}
    assert by_id(token_counts.count_tokens(documents, BYTE), "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(nothing, BYTE).count() == 0


def test_counts_come_from_the_maps_and_the_scan(monkeypatch):
    from tokenizers import Tokenizer

    coder, machine = Tokenizer.from_file(BYTE), token_counts.transducer(BYTE)
    texts = [t or "" for _, t in DOCS]
    want = [len(coder.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk in (1, 2, 7, 100, 4096, 1 << 20):
        assert machine.counts(texts, chunk) == want
    maps, scan = token_counts.chunk_maps, token_counts.scan
    identity = lambda a, b, c: (np.zeros(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64))
    headless = lambda a, b, c: (maps(a, b, c)[0], np.zeros(len(a), np.int64), maps(a, b, c)[2])
    for name, broken in (("chunk_maps", identity), ("chunk_maps", headless), ("scan", lambda c, o, s: (np.zeros(len(o), np.int64), np.zeros(len(o), np.int64))), ("scan", lambda c, o, s: (np.zeros(len(o), np.int64), scan(c, o, s)[1]))):
        with monkeypatch.context() as m:
            m.setattr(token_counts, name, broken)
            assert machine.counts(texts, 50) != want


def test_chunk_maps_compose():
    from tokenizers import Tokenizer

    coder, machine, rnd = Tokenizer.from_file(BYTE), token_counts.transducer(BYTE), random.Random(7)
    texts = ["".join(rnd.choice("ab 'st\n\t é中1.,! don't we'll\x1c\x85") for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    texts += ["".join(rnd.choice(["'re", "'ll", "'", " '", "\n'", "x", "S", "٣", "\u180e", "\u2003", "😀", "<|endoftext|>"]) for _ in range(30)) for _ in range(300)]
    want = [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]
    for c in (1, 2, 5, 16, 1000):
        assert machine.counts(texts, c) == want
    long = b"ab" * 700 + b"x"
    letters = machine.letters
    assert machine._merged_long(long[:390]) == machine.merged(long[:390]) and machine.merged(long) == len(coder.encode(long.decode(), add_special_tokens=False).ids) and letters


def test_transitions_carry_counts():
    machine = token_counts.transducer(BYTE)
    for word in (b" the", b"tokenization", b"zqxjzqxj", "é中".encode()):
        machine.lay(word)
        state = token_counts.ROOT
        total = 0
        for k, b in enumerate(word):
            step = int(machine.table[state << 8 | b])
            state, total = step >> 8, total + (step & 255) - token_counts.BIAS
            assert state != token_counts.DEAD and total == machine.merged(word[: k + 1]) == machine.tokens[state]


def test_texts_beyond_a_stretch_and_words_beyond_the_table(monkeypatch):
    from tokenizers import Tokenizer

    coder, machine, rnd = Tokenizer.from_file(BYTE), token_counts.Transducer(BYTE), random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcdeé'1") for _ in range(rnd.randint(1, 60))) for _ in range(900)), "x" * 9000, " " * 7000 + "y", "", "a\n" * 3000]
    want = [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_counts, "STRETCH", 2000)
    monkeypatch.setattr(token_counts, "STATES", machine.states + 300)
    assert machine.counts(texts) == want and machine.states <= token_counts.STATES


def test_substrings(documents, nothing, monkeypatch):
    want = brute.substrings(DOCS)
    assert by_id(substrings.dedup(documents), "n_words", "n_removed", "kept_sha256") == want
    monkeypatch.setattr(substrings, "BLOCK", 2)  # the contexts of an anchor are dealt over several blocks
    assert by_id(substrings.dedup(documents), "n_words", "n_removed", "kept_sha256") == want
    assert substrings.dedup(nothing).count() == 0


def test_factors_against_blocks():
    # at most one word differs from a reference, so that factors end there and windows over the boundary are asked for themselves
    rnd, span = random.Random(21), substrings.SPAN
    hashes = lambda words: substrings.run_hashes(words, span).tolist()
    base = np.array([rnd.randrange(1 << 60) for _ in range(90)], dtype=np.uint64)
    block, seen = substrings.Block(), {}
    for place in range(60):
        words = base.copy()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(90)] = rnd.randrange(6)
        words = words[rnd.randrange(8) : 90 - rnd.randrange(8)]
        windows = hashes(words)
        factors, rest = block.parse(place, place, words, windows)
        there = sorted([j for a, b in factors for j in range(a, b + 1)] + rest)
        assert there == list(range(len(windows)))
        assert [j for a, b in factors for j in range(a, b + 1)] == [j for j, w in enumerate(windows) if seen.get(w, place) < place]
        for w in windows:
            seen.setdefault(w, place)


def test_substrings_of_odd_rows(spark):
    rnd = random.Random(22)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(n))
    a, b = say(60), say(70)
    rows = [(5, f"{a} {b}"), (5, f"{a} {b}"), (5, b), (None, f"x {b}"), (None, b), (7, f"{say(9)} {b} {say(3)} {b}"), (8, f"{a[2:]} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low, out = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            low[key] = min(low.get(key, 1 << 62), 1 << 62 if i is None else i)
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if low[tuple(w[k : k + 50])] < (1 << 62 if i is None else i):
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone)))
    assert sorted(map(str, out)) == sorted(str((r["doc_id"], r["n_words"], r["n_removed"])) for r in substrings.dedup(df).collect())


def test_run_hashes():
    h = np.random.default_rng(3).integers(0, 5, 300, dtype=np.uint64)
    for n in (1, 2, 16, 50):
        got = substrings.run_hashes(h, n)
        same = defaultdict(set)
        for i in range(len(h) - n + 1):
            same[tuple(h[i : i + n].tolist())].add(int(got[i]))
        assert all(len(v) == 1 for v in same.values()) and len(set.union(*same.values())) == len(same)


def test_word_hashes():
    for t in ("", " a  b\tc\n", "one two one", "é ß\x0b中\x0cx\r"):
        words, h = t.encode().split(), shingles.word_hashes(t.encode())
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


def test_licenses(documents, nothing):
    got = by_id(licenses.scan(documents), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: brute.base_licenses(t) for i, t in DOCS}
    assert licenses.scan(nothing).count() == 0


def test_license_spans(spark):
    texts = [
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the apache (tm) license version 2.0", "CC BY CC BY", "cc  by; K cc bY All Rights reserved",
        "general public. license General-Public-License", "all rights", "of the of the of the subject to the", "AKİ cc by",
    ]
    rows = list(enumerate(texts))
    df = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(df, "n_words", "n_base", "first_word", "last_word", "base_labels") == {i: brute.base_licenses(t) for i, t in rows}
    labels = by_id(df, "labels", "score")
    assert labels[0][0] == "mit" and labels[1][0] == "cc-by,cc-by-nc" and labels[2][0] == "apache-2.0" and labels[7] == ("", 0.0) and labels[3] == ("cc-by", 1.0)


def test_quality(spark, documents, nothing):
    rnd = random.Random(9)
    nice = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, bad = [rnd.choice(nice) for _ in range(60)], i % 5 == 0
        if bad:
            words[rnd.randrange(60)] = rnd.choice(["moronic", "moronish", "moronly"])
        rows.append((i, " ".join(words), "en", "s", 400))
        if i < 700:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, table).collect()}
    held = [i for i in range(700, 900)]
    assert len(got) == 901 and sum(got[i] == (i % 5 != 0) for i in held) >= 195
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.classify(nothing, table).count() == 0
    assert all(r["keep"] and r["score"] is None for r in quality.classify(documents, table.limit(0)).collect())


def test_split_holds_out_a_fifth_of_each_class():
    for n0, n1 in ((1, 1), (1, 30), (2, 400), (7, 3), (250, 1000)):
        good = np.array(([0] * n0 + [1] * n1)[::-1])
        seen, held = quality.split(good)
        for label, n in ((0, n0), (1, n1)):
            assert held[good == label].sum() == max(1, round(n / 5))
            assert seen[good == label].sum() == (1 if n == 1 else n - max(1, round(n / 5)))
        assert (seen | held).all() and (seen & held).sum() == (n0 == 1) + (n1 == 1)


@pytest.mark.parametrize("bad", [1, 2, 3])
def test_quality_with_few_poor_labels(spark, bad):
    # however few, labels of both classes give a model; a doc_id of two texts is fitted on by the same one in any order
    rows = [(i, f"plain words about number {i}" if i >= bad else "vile " * 9, "en", "s", 40) for i in range(120)] + [(50, "another text", "en", "s", 12)]
    labels = spark.createDataFrame([(i, int(i >= bad), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got, turned = (quality.classify(spark.createDataFrame(r, schema), labels).collect() for r in (rows, rows[::-1]))
    assert len(got) == 121 and all(r["score"] is not None for r in got) and sorted(got) == sorted(turned)
    assert all(r["keep"] for r in got if r["doc_id"] >= bad)


def test_co_training_against_a_plain_version(spark):
    # metadata tells as much as words do, so that each view hands the other something; a third word is known from pseudo-labels only
    rnd = random.Random(31)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20)]
        if rnd.random() < 0.9:
            words.append("vile" if bad else "kind")
        if i >= 600 and rnd.random() < 0.9:
            words.append("grim" if bad else "fair")
        rows.append((i, " ".join(words), "en", "shady" if bad and rnd.random() < 0.95 else "plain", 300))
        if i < 600:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(None, "grim grim", None, None, None), (2000, None, "en", "plain", None), (2001, "", "fr", "shady", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()

    content, sigma = quality.Content(), lambda z: 1 / (1 + math.exp(-min(30, max(-30, z))))
    known, good = {i for i, _, _ in labels}, {i: q for i, q, _ in labels}
    every = [(r[0], (content.features(r[1]).tolist(), quality.metadata_features(*r[2:]).tolist())) for r in rows]
    order = sorted(known)
    held = dict(zip(order, quality.split(np.array([good[i] for i in order]))[1]))
    view = {i: f for i, f in every if i in known}
    fitted = [dict(enumerate(quality.fit([np.array(view[i][v]) for i in order if not held[i]], np.array([good[i] for i in order if not held[i]], dtype=float)))) for v in range(2)]
    test = [i for i in order if held[i]]
    truth = np.array([good[i] for i in test], dtype=float)
    summed = lambda weights, features: sum(float(weights.get(f, 0)) for f in features)

    def linear(v, parts):
        *k, shift = quality._scale(np.array([[summed(w, view[i][v]) for w in parts] for i in test]), truth)
        return lambda features: sum(a * summed(w, features) for a, w in zip(k, parts)) + shift

    models = [linear(v, [fitted[v]]) for v in range(2)]
    for _ in range(quality.ROUNDS):
        new = []
        for v in range(2):
            counts, n = (Counter(), Counter()), [0, 0]
            for i, f in every:
                p = sigma(models[1 - v](f[1 - v]))
                if i not in known and (p >= quality.SURE or p <= 1 - quality.SURE):
                    n[p >= quality.SURE] += 1
                    counts[p >= quality.SURE].update(f[v])
            odds = {}
            for f in counts[0].keys() | counts[1].keys() if all(n) else ():
                b, g = counts[0][f], counts[1][f]
                share = (b + g) / sum(n)
                z = (g / n[1] - b / n[0]) / max(1e-12, share * (1 - share)) ** 0.5 / (1 / n[0] + 1 / n[1]) ** 0.5
                if b + g >= quality.SEEN and abs(z) >= quality.APART:
                    odds[f] = np.log((g + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
            assert all(n) and odds
            new.append(linear(v, [fitted[v], odds]))
        models = new
    combine = quality._scale(np.array([[models[v](view[i][v]) for v in range(2)] for i in test]), truth)
    want = {i: sigma(combine[0] * models[0](f[0]) + combine[1] * models[1](f[1]) + combine[2]) for i, f in every}
    assert len(got) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-3 for r in got)
    assert sum((want[i] >= 0.5) == (i % 3 != 0) for i in range(600, 1500)) >= 880 and want[None] < 0.5  # `grim` stands in no labelled row


def test_views_are_sure_at_the_threshold(spark):
    linear = [quality.Linear(np.zeros(quality.WIDTH, dtype=np.float32), 1.0, float(np.log(0.95 / 0.05)) + 1e-12), quality.Linear(np.zeros(quality.WIDTH, dtype=np.float32), 1.0, 0.0)]
    features = spark.createDataFrame([(k, None, quality.packed(np.array([3, 70_000, 200_000])), quality.packed(np.array([5]))) for k in range(4)], "doc_id long, good int, a binary, b binary")
    (content, n_content), (metadata, n_metadata) = quality.exchanged(features, linear)
    assert n_content.tolist() == [0, 0] and not content.any() and n_metadata.tolist() == [0, 4] and metadata[1, 5] == 4 and metadata.sum() == 4


def test_packed_features():
    for f in ([], [0], [65535, 65536], [9, 131072, 262143, 70000]):
        assert quality.unpacked(quality.packed(np.array(f, dtype=np.int32))).tolist() == sorted(f)


def test_digit_share_of_whole_texts():
    def bucket(text):
        return [int(f) - 160 for f in quality.Content().features(text) if 160 <= f < 192]

    odd, even = "a1" * 4000, "1a" * 4000  # every second character is a digit
    assert bucket(odd) == bucket(even) == [int(32 * 0.5**0.5)]
    for n in (10, 100, 1000, 1999, 2500, 3999, 4000, 40_000):  # a tenth is digits, at whatever length
        assert bucket("abcdefghi7" * (n // 10)) == bucket("abcdefghi7")
    assert bucket("x" * 9000) == [0] and bucket("5" * 300) == [31] and bucket("") == bucket(None) == [0]


def test_recent():
    asked = []
    m = Recent(lambda k: asked.append(k) or k * 2, 3)
    assert [m[k] for k in "abcdab"] == ["aa", "bb", "cc", "dd", "aa", "bb"] and asked == list("abcd") and len(m) <= 3
