"""Plans: what reaches the scan, and what doesn't grow out of hand."""

import os

import pytest
from pyspark.sql import functions as F

from skein.operators import aggregates, graph, happenings, identity, joins, reports

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from skein.plans.catalog import QUERIES

    text = plan(QUERIES["q_q11_q12_top_k"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text and "TakeOrderedAndProject" in text


def test_joins_are_equi_joins(spark):
    from skein.plans.catalog import QUERIES

    for name in ("q_g01_j09_mentions", "q_j08_name_or_alias", "q_j10_interval_overlap", "q_j11_point_in_interval", "q_j15_spatial", "q_g04_co_mentioned", "q_e03_event_messages"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([(1, 0, 100)], "id long, lo long, hi long")
    b = spark.createDataFrame([(9, 50, 500), (8, 111, 120), (7, 121, 130)], "rid long, rlo long, rhi long")
    got = joins.overlapping(a, b, 20, 10).select("id", "rid").collect()
    assert sorted(r["rid"] for r in got) == [8, 9]


def test_co_mentions_join_counts_not_rows(spark):
    m = spark.range(2000).select(F.lit("t").alias("thread_id"), F.lit(True).alias("from_me"), F.lit(0).cast("long").alias("ts"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("mentioned_canonical_id"))
    assert [tuple(r) for r in graph.co_mentioned(m).select("a", "b", "weight").collect()] == [("p0", "p1", 1_000_000)]


def test_merge_pairs_are_told_where_they_are_made(spark):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["robin", "zoe", "kit", "ode"])
    people = [(f"p{i}", f"{word()} {word()}" if i % 3 else word(), [word() for _ in range(rng.randrange(3))], [rng.choice("abc")], rng.randrange(12)) for i in range(80)]
    df = spark.createDataFrame(people, "canonical_id string, display_name string, aliases array<string>, sources array<string>, msgs long")
    got = identity.merge_pairs(df)
    rows = sorted(map(tuple, got.collect()))
    assert len({(a, b) for a, b, *_ in rows} | {(b, a) for a, b, *_ in rows}) == 2 * len(rows) > 400  # people of two shared first names are one pair
    assert rows == sorted(map(tuple, identity.merge_pairs(df, block=7).collect()))
    above = plan(got).split("_k#")[0]
    assert "Join" in above and "Aggregate" not in above and "Exchange" not in above and "Sort " not in above  # nothing is done with pairs once they are made


def test_samples_of_small_groups_are_whole(spark):
    df = spark.range(5).select(F.lit("g").alias("g"), "id")
    assert aggregates.systematic(df, ["g"], ["id"], 12).count() == 5 and aggregates.stride(df, ["g"], ["id"], 12).count() == 5


def test_covered_events_are_found_without_pairs(spark):
    import random

    rng = random.Random(3)
    events = lambda n, k: [(f"{k}{i}", t := rng.randrange(200) * 3_600_000 * 5, t + rng.randrange(30) * 3_600_000, [rng.choice("abcdefghij") for _ in range(rng.randrange(3))]) for i in range(n)]
    schema = "event_id string, start_ts long, end_ts long, participants array<string>"
    c, g = events(150, "c"), [r for r in events(25, "g") if r[3]] + [("x", 0, 3_600_000, []), ("y", 0, 9**12, None)]
    pad = 6 * 3_600_000
    want = sorted(i for i, lo, hi, p in c if not any(b - pad <= hi and e + pad >= lo and q is not None and (not q or set(p) & set(q)) for _, b, e, q in g))
    got = happenings.uncovered(spark.createDataFrame(c, schema), spark.createDataFrame(g, schema), pad)
    assert 0 < len(want) < 150 and sorted(r["event_id"] for r in got.collect()) == want
    assert "arrays_overlap" not in plan(got)


def test_overlaps_of_shared_people_meet_by_person(spark):
    a = spark.createDataFrame([(1, 0, 5, ["x", "y", "z"]), (2, 0, 5, ["w", None]), (3, 90, 95, ["x"])], "id long, lo long, hi long, p array<string>")
    b = spark.createDataFrame([(9, 3, 40, ["z", "y", "y"]), (8, 3, 40, ["x", "w"]), (7, 3, 40, [None, "q"]), (6, 3, 40, None)], "rid long, rlo long, rhi long, rp array<string>")
    got = joins.overlapping(a, b, 20, 10, ("p", "rp")).select("id", "rid")
    assert sorted(map(tuple, got.collect())) == [(1, 8), (1, 9), (2, 8)]
    assert "_e" in plan(got)


def test_outside_events_of_one_moment_meet_spans_once(spark):
    c = spark.createDataFrame([("e2", 0, 9, 0.0, 0.0), ("e1", 0, 9, 0.0, 0.0), ("e3", 5, 9, 0.0, 0.0)], "event_id string, start_ts long, end_ts long, lat double, lng double")
    o = spark.createDataFrame([(f"k{i}", "n", 2, 0.0, 0.0, "joined") for i in range(4)] + [("l", "n", 5, 0.0, 0.0, "joined"), ("m", "n", 5, 0.0, 0.0, "interested")], "key string, name string, ts long, lat double, lng double, response string")
    got = happenings.named(c, o)
    assert sorted(map(tuple, got.select("event_id", "key", "match", "gap").collect())) == [("e1", "k0", "geo", 2), ("e3", "l", "geo", 0)]
    assert "keys=[ts" in plan(got)


def test_rows_of_one_place_are_several_tasks(spark):
    d = spark.range(600).selectExpr("id", "1.0D AS lat", "CASE WHEN id < 590 THEN 2.0D ELSE 2.0005D END AS lng")
    got = joins.spatial(d, d.toDF("rid", "rlat", "rlng"), block=50).withColumn("task", F.spark_partition_id())
    assert got.where("id < rid").count() == 600 * 599 // 2 and got.select("task").distinct().count() > 3


def test_rows_of_places_are_dealt_once(spark):
    # rows of a place and its blocks were dealt to tasks, and then all dealt again by the join
    d = spark.createDataFrame([(1, 0.0, 0.1 + 0.2), (2, -0.0, 0.3), (3, 0.0, 0.3), (4, 0.5, float("nan")), (5, -0.0009, 0.3)], "id long, lat double, lng double")
    got = joins.spatial(d, d.toDF("rid", "rlat", "rlng"), block=2)
    assert sorted(map(tuple, got.where("id < rid").select("id", "rid").collect())) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)]
    assert sorted(got.columns) == ["id", "lat", "lng", "rid", "rlat", "rlng"]
    dealt = [x for x in plan(got).splitlines() if "Exchange" in x and "_k#" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt)


def test_mentions_move_no_rows_where_names_are_few(spark):
    i = spark.createDataFrame([("id-1", "Ann Abel", ["ann@x.example"]), ("id-2", "Ann Birch", []), ("id-3", "Bo (x) Dunn", [])], "canonical_id string, display_name string, aliases array<string>")
    ti = spark.createDataFrame([("t1", "id-1"), ("t1", "id-9")], "thread_id string, canonical_id string")
    m = spark.createDataFrame([("m1", "t1", 1, True, "ANN abel, ann birch", True), ("m2", "g", 2, False, "annabel or bo dunn", True), ("m3", None, 3, False, "ann birches", True), ("m4", "g", 4, True, "ann", False)], "id string, thread_id string, ts long, from_me boolean, body string, meaningful boolean")
    got = graph.mentions(m, i, ti)
    assert sorted((r["message_id"], r["mentioned_canonical_id"], r["mentioned_form"]) for r in got.collect()) == [("m1", "id-2", "ann"), ("m1", "id-2", "ann birch"), ("m3", "id-1", "ann"), ("m3", "id-2", "ann")]
    text = plan(got)
    assert "hashpartitioning(id" not in text and "hashpartitioning(mentioned_canonical_id" not in text and "hashpartitioning(thread_id" not in text


def _told(spark):
    i = spark.createDataFrame([("a", "Ann", []), ("b", "Bo", []), ("c", "Cy", [])], "canonical_id string, display_name string, aliases array<string>")
    ti = spark.createDataFrame([("ta", "a"), ("tb", "b")], "thread_id string, canonical_id string")
    threads = spark.createDataFrame([("ta", "x", False), ("tb", "x", False), ("g", "y", True)], "thread_id string, source string, is_group boolean")
    m = spark.createDataFrame([(f"m{t}{k}", t, k, True, "hi", True) for t in ("ta", "tb", "g") for k in range(3)], "id string, thread_id string, ts long, from_me boolean, body string, meaningful boolean")
    said = spark.createDataFrame([("b", "bo", "ta", "mta0", 0, True), ("b", "bo", "ta", "mta1", 1, True), ("a", "ann", "tb", "mtb0", 0, True), ("c", "cy", "ta", "mta1", 1, True), ("a", "ann", "g", "mg0", 0, False), ("b", "bo", "g", "mg0", 0, False)], "mentioned_canonical_id string, mentioned_form string, thread_id string, message_id string, ts long, from_me boolean")
    return i, ti, threads, m, said


def test_storylines_count_mentions_once(spark):
    i, ti, threads, m, said = _told(spark)
    people, edges = graph.storyline(m, threads, ti, said, over=2)
    assert sorted((r["canonical_id"], r["month"], r["msgs"], r["mentions"]) for r in people.collect()) == [("a", "1970-01", 3, 2), ("b", "1970-01", 3, 3)]
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "1970-01", 3)]
    assert "mentioned_canonical_id" not in plan(people) + plan(edges)


def test_packets_pair_one_persons_days_only(spark):
    import re

    i, ti, threads, m, said = _told(spark)
    members = spark.createDataFrame([("g", "Ann", "a"), ("g", "Bo", "b")], "thread_id string, participant_name string, canonical_id string")
    got = graph.context_packet("b", m, threads, ti, members, said, i)
    assert sorted((r["item"], r["n"], r["text"]) for r in got.where("section = 'alongside'").collect()) == [("a", 1, "Ann"), ("c", 2, "Cy")]
    assert not re.search(r"\ba#\d+", plan(got))


def test_a_year_is_counted_once(spark):
    from skein.plans.catalog import QUERIES

    text = plan(QUERIES["q_a12_year"](spark, SF))
    assert "o_orderkey" not in text and "l_orderkey" not in text


def test_the_biggest_event_of_a_year_brings_its_people(spark):
    g = spark.createDataFrame([("e2", 9, "photos", None, 5, ["b", "me", None]), ("e1", 8, "photos", "x", 5, ["a", "me"]), ("e0", 7, "photos", "x", None, None)], "event_id string, start_ts long, source string, place_name string, n_photos int, participants array<string>")
    m = spark.createDataFrame([], "ts long, thread_id string, meaningful boolean")
    i = spark.createDataFrame([("a", "Ann")], "canonical_id string, display_name string")
    got = {y: sorted(map(tuple, reports.almanac(g, m, m, m.selectExpr("thread_id", "thread_id AS canonical_id"), i, y, "me").where("section LIKE 'biggest%'").select("section", "place", "item", "name", "n").collect())) for y in (1970, 1971)}
    assert got == {1970: [("biggest_event", 1, "e1", None, 5), ("biggest_event_people", None, "a", "Ann", 8)], 1971: []}


def test_an_events_messages_keep_their_moments(spark):
    from skein.plans.catalog import QUERIES

    text = plan(QUERIES["q_a44_event_stream"](spark, SF))
    assert "message_id" not in "".join(x for x in text.splitlines() if "Join" in x or "Exchange" in x)
    assert "lineitem" not in text and "l_orderkey" not in text


def test_a_thread_of_two_of_an_events_people_counts_once(spark):
    g = spark.createDataFrame([("e", 0, 9, ["a", "b"])], "event_id string, start_ts long, end_ts long, participants array<string>")
    ti = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "thread_id string, canonical_id string")
    m = spark.createDataFrame([("m1", 1, "t", True), ("m2", 1, "t", True), ("m3", 2, "u", True), ("m4", 3, "t", True), ("m5", 4, "t", False)], "id string, ts long, thread_id string, meaningful boolean")
    got = happenings.event_messages(g, m, ti, most=3)
    assert sorted(map(tuple, got.collect())) == [("e", "m1", 1), ("e", "m2", 1), ("e", "m3", 2)]
    assert "keys=[event_id" not in plan(got)


def test_flags_of_photos_need_no_older_faces(spark):
    dets = spark.createDataFrame([("p1", 1), ("p1", 1), ("p2", 2), ("p3", 1)], "photo_id string, cluster_id int")
    clusters, labels = spark.createDataFrame([(1, 3), (2, 1)], "cluster_id int, n_faces int"), spark.createDataFrame([(1, "ann"), (2, "skip")], "cluster_id int, label string")
    people = spark.createDataFrame([("a", "Ann")], "canonical_id string, display_name string")
    photos = spark.createDataFrame([("p1", "s", False), ("p2", "s", True), ("p3", "o", False), ("p4", "o", True)], "id string, source string, has_named_face boolean")
    old = spark.createDataFrame([("p2", "z", "old"), ("p4", "z", "old"), ("p3", "a", "old")], "photo_id string, canonical_id string, face_cluster string")
    got = happenings.face_tables(dets, clusters, labels, people, photos, old, "s")
    assert sorted(map(tuple, got["photos"].select("id", "has_named_face").collect())) == [("p1", True), ("p2", False), ("p3", False), ("p4", True)]
    assert sorted(map(tuple, got["photo_faces"].collect())) == [("p1", "a", "s:cluster:1"), ("p3", "a", "old"), ("p4", "z", "old")]
    assert "Union" not in plan(got["photos"]) and "Union" in plan(got["photo_faces"])


def test_everyone_is_audited(spark):
    # people past the sixtieth by texts were left out
    i = spark.createDataFrame([(f"id-{k}", ["instagram", "imessage", "gmail"][k % 3 :][:1]) for k in range(200)], "canonical_id string, sources array<string>")
    m = spark.range(200 * 4).selectExpr("concat('id-', id % 200) AS canonical_id", "IF(id = 7, '', 'hi') AS body", "id AS ts")
    got = {r["canonical_id"]: (r["side"], r["first_ts"], r["last_ts"]) for r in identity.audited(m, i, over=3).collect()}
    assert got == {f"id-{k}": (["instagram", "imessage"][k % 3], k, 600 + k) for k in range(200) if k % 3 < 2 and k != 7}


def test_overlaps_of_signatures_in_blocks(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    rng = random.Random(11)
    for name, value in {"HELD": 5, "MET": 9, "AT_ONCE": 3, "COLUMNS": 7, "LEVELS": 3}.items():
        monkeypatch.setattr(identity, name, value)
    people = [(f"p{k}", ["instagram", "imessage"][k % 2], k * 86_400_000, (k + rng.randrange(40)) * 86_400_000) for k in range(40)]
    m = {(p[0], f"t{t}"): rng.choice([1, 1, 2, 3, 9]) for p in people for t in rng.sample(range(30), rng.randrange(3, 14))}
    m |= {("p3", "p3"): 5, ("elsewhere", "t1"): 2}
    mine = {k: n for k, n in m.items() if k[0] != k[1] and k[0] != "elsewhere"}
    df, size = Counter(t for _, t in mine), Counter(c for c, _ in mine)
    w = {c: {t: n for (x, t), n in mine.items() if x == c and df[t] < max(3, math.ceil(40 / 2))} for c in size if size[c] >= 5}
    idf = {t: math.log(41 / n) for t, n in df.items()}
    want = {}
    for a, s, lo, hi in people:
        for b, z, lo2, hi2 in people:
            if (s, z) == ("instagram", "imessage") and a in w and b in w and (both := w[a].keys() & w[b].keys()):
                low = {t: min(w[a][t], w[b][t]) * idf[t] for t in both}
                whole = sum(n * idf[t] for x in (a, b) for t, n in w[x].items())
                jaccard = round(sum(low.values()) / (whole - sum(low.values())), 6)
                if jaccard >= 0.1:
                    want[a, b] = (len(both), jaccard, max(0, (min(hi, hi2) - max(lo, lo2)) // 86_400_000), ",".join(sorted(both, key=lambda t: (-low[t], t))[:6]))
    frame = spark.createDataFrame([(*k, n) for k, n in m.items()], "canonical_id string, third string, n long")
    got = identity.third_party_overlap(frame, spark.createDataFrame(people, "canonical_id string, side string, first_ts long, last_ts long"))
    assert {(r["a"], r["b"]): tuple(r)[2:] for r in got.collect()} == want and len(want) > 50
    assert "Join" not in plan(got)
