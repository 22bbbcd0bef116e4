"""Operators that no SQL tells, against plain versions on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import crm, graph, happenings, identity
from skein.sources import tables

HOUR = 3_600_000


def test_greedy_resolution(spark):
    rnd = random.Random(3)
    names = [f"n{k}" for k in range(25)]
    threads = [(n, [rnd.choice(names) for _ in range(rnd.randint(1, 3))], rnd.choice(["whatsapp", "messenger"])) for n in range(60)]
    owner, want = {}, {}
    for n, aliases, _ in threads:
        want[n] = next((owner[a] for a in aliases if a in owner), n)
        for a in aliases:
            owner.setdefault(a, want[n])
    df = spark.createDataFrame(threads, "n long, aliases array<string>, source string").repartition(4)
    assert {r["n"]: r["person"] for r in identity.resolve_greedy(df).collect()} == want


def test_photo_clusters(spark):
    rnd = random.Random(5)
    photos = []
    for owner in ("a", "b"):
        ts, lat, lng = 0, -37.8, 144.9
        for k in range(150):
            ts += int(rnd.choice([0.02, 0.5, 1.5, 3, 7]) * HOUR)
            if rnd.random() < 0.2:
                lat, lng = -37.8 + rnd.choice([0, 0.001, 0.05, 0.3]), 144.9 + rnd.choice([0, 0.002, 0.2])
            photos.append((owner, f"{owner}{k:03}", ts, *((None, None) if rnd.random() < 0.3 else (lat, lng))))
    want = set()
    for owner in ("a", "b"):
        cluster, places, last = [], [], None
        done = []
        for _, i, ts, lat, lng in (p for p in photos if p[0] == owner):
            away = False
            if last is not None and lat is not None and places and ts - last > HOUR:
                away = happenings._km(sum(p[0] for p in places) / len(places), sum(p[1] for p in places) / len(places), lat, lng) > 1.0
            if last is not None and (ts - last > 6 * HOUR or away):
                done.append(cluster)
                cluster, places = [], []
            cluster.append(i)
            if lat is not None:
                places.append((lat, lng))
            last = ts
        want |= {tuple(c) for c in [*done, cluster] if len(c) >= 3}
    got = happenings.cluster(spark.createDataFrame(photos, "owner string, id string, ts long, lat double, lng double").repartition(5))
    groups = got.groupBy("owner", "session", "part").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()
    assert {tuple(r["ids"]) for r in groups} == want


def test_label_propagation(spark):
    rnd = random.Random(8)
    edges = {}
    for _ in range(120):
        a, b = sorted(rnd.sample(range(40), 2))
        edges[a, b] = rnd.randint(1, 9)
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    labels = {n: n for n in near}
    for _ in range(25):
        new = {}
        for n in near:
            votes = {labels[n]: 0.5}
            for b, w in near[n]:
                votes[labels[b]] = votes.get(labels[b], 0) + w
            new[n] = min(votes, key=lambda x: (-votes[x], x))
        if new == labels:
            break
        labels = new
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, weight long")
    assert {r["node"]: r["label"] for r in graph.label_propagation(df).collect()} == labels


def test_mojibake(spark):
    said = ["Café", "naïve ☕", "日本", "plain", ""]
    broken = [s.encode().decode("latin-1") for s in said] + ["\xff\xfe", "Ā"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*broken, None])], "i int, t string")
    assert [r["x"] for r in df.select("i", T.repair(F.col("t")).alias("x")).orderBy("i").collect()] == [*said, "\ufffd\ufffd", "\0", None]


def test_iso_bounds(spark):
    at = lambda t: spark.createDataFrame([(t,)], "t string").select(T.iso_ms(F.col("t")).alias("x")).first()["x"]
    assert at("2024-01-05") == 1_704_412_800_000 and at("2024-01-05T10:00:00+10:00") == 1_704_412_800_000 and at("12") == 12 and at(None) is None
    with pytest.raises(Exception, match="bad date"):
        at("soon")


def test_overlap_fetch(spark):
    s, day = "source string, ts long, body string", 86_400_000
    base = spark.createDataFrame([("a", 10 * day, "x"), ("a", 10 * day, "x"), ("a", day, "old")], s)
    new = spark.createDataFrame([("a", 10 * day, "x"), ("a", 9 * day, "late"), ("a", 7 * day, "before the margin"), ("b", 1, "whole")], s)
    got = sorted((r["source"], r["ts"], r["body"]) for r in tables.overlap_fetch(base, new, ["ts", "body"]).collect())
    assert got == [("a", day, "old"), ("a", 9 * day, "late"), ("a", 10 * day, "x"), ("a", 10 * day, "x"), ("b", 1, "whole")]


def test_follow_up(spark):
    people = spark.createDataFrame([("p1", "Ann", None, None, None, 1, 1), ("p2", "Bob", None, "x", 5, 1, 1)], "id string, name string, anchor string, follow_up string, deleted_at long, created_at long, updated_at long")
    known = spark.createDataFrame([("p2", "Bob Birch", ["+1"]), ("p3", "Cy", [])], "canonical_id string, display_name string, aliases array<string>")
    rows = lambda df: sorted((r["id"], r["name"], r["follow_up"], r["updated_at"]) for r in df.collect())
    assert rows(crm.set_follow_up(people, known, "p1", "call", 9)) == [("p1", "Ann", "call", 9), ("p2", "Bob", "x", 1)]
    assert rows(crm.set_follow_up(people, known, "p2", "call", 9)) == [("p1", "Ann", None, 1), ("p2", "Bob", "x", 1), ("p2", "Bob Birch", "call", 9)]
    with pytest.raises(ValueError):
        crm.set_follow_up(people, known, "nobody", "call", 9)


def test_forms_found_at_once_are_those_of_the_trie():
    import random
    import re

    import pyarrow as pa

    from skein.operators.writing import Forms, Trie

    rng = random.Random(11)
    names = ["Ann", "ANN", "Bo", "bO", "Ann Bo", "Élan", "Zoë", "O'Neil", "Mary-Lou", "Ann  Bo", "Ann-", "K\u212aa", "\u212aab", "Éé", "A'", "É ", "Ann Bo Cy", "İda", "Cy", "Éa'", "Bo Ann", "Neil", "K'k", "É É", "Aß", "Straße"]
    forms = [(f"p{rng.randrange(9)}", f) for f in names for _ in range(2)]
    bits = [*names, *map(str.lower, names), *map(str.upper, names), " ", " ", " ", "\n", "\r\n", "\r", "_", "-", "'", "x", "é", "\u212a", "9", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None, "", "\n", "Ann", "Bo", "Ann", " Bo"]
    for k in range(0, len(texts), 500):
        part, trie, want = texts[k : k + 500], Trie(forms), {}
        for at, text in enumerate(part):
            for number, line in enumerate(re.split(r"\r?\n", text or ""), 1):
                first = {}
                for person, a, b in trie.met(line):
                    first[person] = min(first.get(person, (b - a == 2, a, -b)), (b - a == 2, a, -b))
                want |= {(person, at, number): line[a:-b] for person, (_, a, b) in first.items()}
        person, text, line, form = Forms(forms).met(pa.array([*["left out"] * 3, *part], pa.large_string())[3:])
        got = list(zip(person.to_pylist(), text.tolist(), line.tolist(), form.to_pylist(), strict=True))
        assert {g[:3]: g[3] for g in got} == want and len(got) == len(want) > 300 * (k < 2500)
    assert all(len(x) == 0 for x in Forms([]).met(pa.array(["Ann", None], pa.large_string())))
