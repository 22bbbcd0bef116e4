"""The pipeline's stages on a small table, and against plain versions where there are any."""

import os
import random

import pytest

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "minhash_dedup":
            assert set(after) == {i for i, v in brute.near_duplicates(before, 5, 4, 5).items() if v[2]}
        if name == "suffix_dedup":
            want = brute.repeated_bytes(before, corpus_pipeline.REPEATED_BYTES)
            assert {i for i, v in want.items() if v[1] == 0} == {i for i, t in before if after[i]["text"] == t} - {i for i, v in want.items() if v[1]}
            assert all(0 <= len(after[i]["text"].encode()) - (v[0] - v[1]) <= 6 * v[2] for i, v in want.items())
        if name == "decontamination":
            assert set(after) == {i for i, _ in before} - {d for d, _ in brute.contained(before, items)}
        if name == "packing":
            assert set(after) == {i for i, _ in before}


def test_passages_of_short_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(4)
    say = lambda n, most=9: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, most))) for _ in range(n))
    single, short, near = say(51, 1), say(60, 3), say(50, 2)
    assert len(single) == 101 and len(short) < corpus_pipeline.REPEATED_BYTES
    texts = [f"{say(30)} {single} {say(20)}", f"{say(10)} ({single}). {say(40)}", f"{say(30)} {short} {say(9)}", f"é {short}", f"{say(20)} {near} {say(20)}", f"{say(9)} {near} {say(30)}", say(80, 2), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect()}
    gone = {0: single, 1: single, 2: short, 3: short}
    assert got == {i: t.replace(gone[i], "") if i in gone else t for i, t in enumerate(texts)}
    twice = spark.createDataFrame([(1, f"{single} {say(20)} {single}")], "doc_id long, text string")
    assert single not in corpus_pipeline.drop_repeated_passages(spark, twice, SF).first()["text"]


@pytest.mark.parametrize("block", [2_000, 2])
def test_short_word_runs_against_a_plain_version(spark, monkeypatch, block):
    # texts made of a common run of short words between their own ones, cut, repeated and marked in many ways
    from skein.llm import suffixes

    monkeypatch.setattr(suffixes, "WORD_BLOCK", block)
    rnd, n, size = random.Random(15), 12, 60
    say = lambda k, most=3: [rnd.choice("abcdefg") * rnd.randint(1, most) for _ in range(k)]
    common, texts = say(30, 2), []
    for k in range(40):
        a, b = sorted(rnd.sample(range(31), 2))
        own = say(rnd.randint(0, 9), 4) + common[a:b] + say(rnd.randint(0, 9), 4)
        if k % 5 == 0:
            own += say(rnd.randint(0, 3)) + common[5:22]
        if k % 7 == 0:
            own[len(own) // 2 : len(own) // 2 + 1] = ["(x)."]
        texts.append(" ".join(own))
    texts += [texts[3], " ".join(["one"] * 40), " ".join(common[:11]), "", "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    places = {}
    for i, t in rows:
        for _, a, b in suffixes.short_passages(t.encode(), n, size):
            places.setdefault(t.encode()[a:b], []).append((i, a))
    want = {}
    for passage, at in places.items():
        if len({i for i, _ in at}) > 1 or max(a for _, a in at) - min(a for _, a in at) >= len(passage):
            for i, a in at:
                want.setdefault(i, set()).update(range(a, a + len(passage)))
    df = spark.createDataFrame([(i, hash(t), t) for i, t in rows], "place long, row long, text string").repartition(3)
    got = {}
    for r in suffixes.word_spans_of(df, n, size).collect():
        for s in r["spans"]:
            got.setdefault(r["place"], set()).update(range(s["first"], s["last"] + size))
    assert got == want and len(want) > 15


def test_run(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0
