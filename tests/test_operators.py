"""Small golden cases of archive operators."""

import time

import pytest
from pyspark.sql import functions as F

from skein.operators import aggregates, crm, gates, graph, happenings, identity, iterative, joins, people, quotes, retrieval

HOUR, DAY = 3_600_000, 86_400_000
T0 = 1_700_000_000_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cluster_rules(spark):
    p = [("o", "a1", T0, -37.8, 144.96), ("o", "a2", T0 + 600_000, -37.8, 144.96), ("o", "a3", T0 + 1_200_000, None, None), ("o", "b1", T0 + 50 * HOUR, None, None), ("o", "b2", T0 + 51 * HOUR, None, None), ("o", "b3", T0 + 52 * HOUR, None, None), ("o", "c1", T0 + 200 * HOUR, None, None)]
    df = spark.createDataFrame(p, "owner string, id string, ts long, lat double, lng double")
    got = happenings.cluster(df).groupBy("session", "part").agg(F.sort_array(F.collect_list("id")).alias("i"))
    assert sorted(r["i"] for r in got.collect()) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]


def test_cluster_moves(spark):
    ny, ldn = (40.7, -74.0), (51.5, -0.1)
    p = [("o", f"n{i}", T0 + i * 60_000, *ny) for i in range(3)] + [("o", f"l{i}", T0 + 90 * 60_000 + i * 60_000, *ldn) for i in range(3)]
    got = happenings.cluster(spark.createDataFrame(p, "owner string, id string, ts long, lat double, lng double"))
    assert got.select("part").distinct().count() == 2
    near = [("o", f"x{i}", T0 + i * 6 * HOUR, None, None) for i in range(3)]  # exactly six hours stay together
    assert happenings.cluster(spark.createDataFrame(near, "owner string, id string, ts long, lat double, lng double")).count() == 3


def test_components_and_chain(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "a string, b string")
    assert rows(iterative.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    m = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "x", 0), ("p", "q", 3), ("q", "p", 4)], "loser string, winner string, ordinal int")
    assert rows(iterative.resolve_chain(m)) == [("a", "c"), ("b", "c"), ("q", "p")]


def test_label_propagation_separates_cliques(spark):
    e = [(a, b, 5) for g in (["a", "b", "c"], ["x", "y", "z"]) for a in g for b in g if a < b] + [("c", "x", 1)]
    got = dict(graph.label_propagation(spark.createDataFrame(e, "a string, b string, weight int")).collect())
    assert len({got[k] for k in "abc"}) == 1 and len({got[k] for k in "xyz"}) == 1 and got["a"] != got["x"]


def test_greedy_keeps_two_where_components_join(spark):
    t = [(0, ["A"], "instagram"), (1, ["B"], "instagram"), (2, ["A", "B"], "instagram"), (3, ["B"], "instagram")]
    df = spark.createDataFrame(t, "n long, aliases array<string>, source string")
    assert rows(identity.resolve_greedy(df)) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert rows(identity.resolve_components(df)) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_fold(spark):
    ids = spark.createDataFrame([("id-1", "Bo", ["Bo"], ["a"]), ("id-2", "bo b", ["bo b"], ["b"]), ("id-9", "Z", ["Z"], ["a"])], "canonical_id string, display_name string, aliases array<string>, sources array<string>")
    links = spark.createDataFrame([("id-1", "id-2"), ("id-2", "id-9"), ("id-1", "id-9")], "canonical_id string, related_canonical_id string")
    out = identity.fold(ids, {"links": (links, ["canonical_id", "related_canonical_id"])}, spark.createDataFrame([("id-2", "id-1")], "loser string, winner string"))
    assert rows(out["links"].select("canonical_id", "related_canonical_id")) == [("id-1", "id-9")]
    bo = out["identities"].where("canonical_id = 'id-1'").first()
    assert bo["display_name"] == "Bo" and bo["aliases"] == ["Bo", "bo b"] and out["identities"].count() == 2


def test_mentions_whole_words(spark):
    m = spark.createDataFrame([("m1", "t1", 1, True, "saw ann abel today", True), ("m2", "t2", 2, True, "annual plan", True), ("m3", "t9", 3, False, "ann!", True)], "id string, thread_id string, ts long, from_me boolean, body string, meaningful boolean")
    i = spark.createDataFrame([("id-1", "Ann❤Abel", ["ann@x.y"])], "canonical_id string, display_name string, aliases array<string>")
    ti = spark.createDataFrame([("t9", "id-1")], "thread_id string, canonical_id string")
    assert rows(graph.mentions(m, i, ti).select("mentioned_form", "message_id")) == [("ann", "m1"), ("ann abel", "m1")]


def test_merge_pairs(spark):
    rows_ = [
        ("a", "Robin", ["Robin"], ["instagram"], 40), ("b", "Robin Vasquez", ["+1555", "Robin Vasquez"], ["imessage"], 90),  # one opens the other
        ("c", "Robin Lee", ["Robin Lee"], ["gmail"], 9), ("d", "Mom", ["Mom"], ["gmail"], 50), ("e", "mom", [], ["imessage"], 50),
        ("f", "kit", ["Kit Ode ✨"], ["whatsapp"], 3), ("g", "Kit Ode", [], ["gmail"], 30), ("h", "+1777", ["Zoe Fox", "zed"], ["gmail"], 20), ("i", "zed", [], ["imessage"], 21), ("j", "Zoe-Fox", [], ["imessage"], 22),
    ]
    people = spark.createDataFrame(rows_, "canonical_id string, display_name string, aliases array<string>, sources array<string>, msgs long")
    assert rows(identity.merge_pairs(people).select("winner", "loser", "score", "ambiguous")) == [("a", "c", 1.0, True), ("b", "a", 1.0, True), ("i", "h", 1.0, False)]


def test_full_names_come_first(spark):
    tried = {1: ["Robin", "robin vasquez"], 2: ["robin vasquez", "Robin Vasquez"], 3: ["+1 Ann", "zoe", "Bea"], 4: ["x@y.z", "+1555"], 5: ["Élan Vital", "Jo"]}
    df = spark.createDataFrame([(p, a, k) for p, names in tried.items() for k, a in enumerate(names)], "person int, alias string, ordinal int")
    assert rows(identity.display_name(df)) == [(1, "robin vasquez"), (2, "Robin Vasquez"), (3, "Bea"), (4, "x@y.z"), (5, "Jo")]


def test_nearest_is_one_to_one(spark):
    p = spark.createDataFrame([("p1", 10), ("p2", 12), ("p3", 500)], "k string, ts long")
    s = spark.createDataFrame([("s1", 11, 11), ("s2", 400, 450)], "s string, lo long, hi long")
    assert rows(joins.nearest(p, "k", "ts", s, "s", "lo", "hi", 60).select("k", "s", "gap")) == [("p1", "s1", 1), ("p3", "s2", 50)]


def test_samples(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), "id")
    assert [r["id"] for r in aggregates.systematic(df, ["g"], ["id"], 7).orderBy("id").collect()] == [i * 100 // 7 for i in range(7)]
    assert aggregates.head_middle_tail(df, ["g"], ["id"], 40).count() == 40
    assert [r["id"] for r in aggregates.stride(df, ["g"], ["id"], 8).orderBy("id").collect()] == [12 * i for i in range(8)]


def test_chunks_split_and_merge(spark):
    ts = [0, 1, 2, 3, 4] + [DAY * 91 + i for i in range(12)] + [DAY * 200]
    df = spark.createDataFrame([("g", str(i), t) for i, t in enumerate(ts)], "g string, id string, ts long")
    assert rows(people.chunks(df, "g", most=6, least=5).select("chunk", "n")) == [(1, 5), (2, 6), (3, 7)]


def test_person_series_gap(spark):
    ms = lambda y: int((y - 1970) * 365.25 * DAY)
    g = spark.createDataFrame([(ms(2012) + 40 * DAY, ["id-7"]), (ms(2016) + 40 * DAY, ["id-7", "id-8"])], "start_ts long, participants array<string>")
    m = spark.createDataFrame([("t", ms(2014) + 40 * DAY)], "thread_id string, ts long")
    ti = spark.createDataFrame([("t", "id-8")], "thread_id string, canonical_id string")
    got = people.person_series(g, m, ti).where("canonical_id = 'id-7'")
    assert rows(got.select("year", "events", "messages", "gap_from", "gap_to")) == [(y, int(y in (2012, 2016)), 0, 2013, 2015) for y in range(2012, 2017)]


def test_guard():
    for good in ("SELECT 1", "with a as (select 1) select * from a", "select ';' as x;", "-- note\nselect 1"):
        assert retrieval.guard(good)
    for bad in ("", "drop table x", "select 1; select 2", "/* select */ delete from x", "insert into x values (1)", "pragma x"):
        with pytest.raises(ValueError):
            retrieval.guard(bad)


def test_safe_select_denies_files(spark):
    spark.range(3).createOrReplaceTempView("seen_v")
    where = "`/root/testdata/sf0.001/region.parquet`"
    for bad in (
        f"select * from parquet.{where}", f"select * from `parquet`.{where}", f"select id from seen_v where id in (select r_regionkey from `parquet`.{where})", f"select (select max(r_regionkey) from parquet . {where}) from seen_v",
        f"with c as (select * from `parquet`.{where}) select * from c", "select java_method('java.lang.System', 'getProperty', 'user.home')", "select `reflect`('java.lang.System', 'getProperty', 'user.home') from seen_v", "select try_reflect('java.lang.System', 'getenv', 'PATH')",
    ):
        for run in (retrieval.safe_select, retrieval.query):
            with pytest.raises(ValueError):
                run(spark, bad)
    for good in ("with c as (select id from seen_v) select * from c where id in (select id from seen_v)", "select (select max(id) from seen_v) as m", "select * from values (1), (2) t(a)", "select id, row_number() over (order by id) as r from seen_v"):
        assert retrieval.safe_select(spark, good).count() and retrieval.query(spark, good)[0].count()
    assert retrieval.safe_select(spark, "```sql\nselect 1 as x\n```").first()["x"] == 1
    df, more = retrieval.query(spark, "select id from range(5)", limit=3)
    assert df.count() == 3 and more


def test_search_redacts_before_limit(spark):
    m = spark.createDataFrame([(f"m{i}", i, "t", "Bo", f"imax {'secret' if i == 5 else i}") for i in range(6)], "id string, ts long, thread_id string, sender_name string, body string")
    got = retrieval.search_messages(m, "imax", limit=2, redactions=("secret",))
    assert [r["id"] for r in got.collect()] == ["m4", "m3"]


def test_op_log(spark):
    o = spark.createDataFrame([(1, "a", "view", 1.0, 10), (2, "a", "click", 2.0, 10), (3, "b", "odd", 1.0, 99)], "op long, key string, kind string, amount double, updated_at long")
    assert rows(crm.replay(o).select("key", "op")) == [("a", 2)]
    assert crm.replay(o, since=10).count() == 0
    assert rows(crm.log_interaction(o, "z", "view", 100).where("key = 'z'").select("op")) == [(4,)]


def test_gates(spark):
    s = "source string, messages long, newest long"
    b = spark.createDataFrame([("a", 5, 9), ("b", 5, 9), ("c", 5, 9), ("d", 5, 9)], s)
    a = spark.createDataFrame([("a", 5, 9), ("b", 4, 9), ("c", 5, 8)], s)
    assert rows(gates.regressions(b, a).select("source", "problem")) == [("b", "count down"), ("c", "newest backwards"), ("d", "missing")]
    seen = []
    boom = lambda: 1 / 0
    report = gates.run_steps([("x", boom, False), ("y", lambda: seen.append(1), False), ("z", boom, True), ("w", lambda: seen.append(2), False)])
    assert [r[1][:2] for r in report] == ["fa", "ok", "fa"] and seen == [1]


def test_headings_and_quotes(spark):
    d = spark.createDataFrame([("d", "# One\n\nfirst\n## One\nsecond\n### Deep\nx")], "doc string, text string")
    assert rows(quotes.headings(d).select("slug", "excerpt")) == [("one", "first"), ("one-2", "second")]
    q = spark.createDataFrame([(1, "quick  brown FOX jumps over"), (2, "lazy"), (3, "not there at all ok")], "item_id long, text string")
    s = spark.createDataFrame([(7, "The quick brown fox\njumps over the lazy dog"), (8, None)], "doc_id long, text string")
    assert rows(quotes.verify(q, s)) == [(1, 7), (2, 7)]


def test_clusters_walk_many_sessions_in_a_task(spark):
    # every session was a Python group of its own; batches of two rows cut each of them
    at = lambda k, lat: (T0 + k * 70 * 60_000, lat, 0.0)
    photos = [(owner, f"p{day}{k}", ts + day * DAY, lat, lng) for owner in ("a", "b", "c") for day in (0, 2) for k, (ts, lat, lng) in enumerate([at(0, 0.0), at(1, 0.0), at(2, 0.0), at(3, 1.0), at(4, 1.0), at(5, 1.0), at(6, 9.0)])]
    df = spark.createDataFrame(photos, "owner string, id string, ts long, lat double, lng double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = happenings.cluster(df)
        got = rows(found.select("owner", "id", "session", "part"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == [(o, f"p{day}{k}", day // 2, k // 3) for o in ("a", "b", "c") for day in (0, 2) for k in range(6)]
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_co_present_without_pairs_by_event(spark):
    g = spark.createDataFrame([("e", ["x", "y", None]), ("e", ["y", "z"]), ("f", ["x", "x", "y"]), ("g", None), (None, ["x", "y"])], "event_id string, participants array<string>")
    found = happenings.co_present_events(g)
    assert rows(found) == [("x", "y", 2), ("x", "z", 1), ("y", "x", 2), ("y", "z", 1), ("z", "x", 1), ("z", "y", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # rows of (a, b, event) were all held to be counted


def test_quotes_in_a_long_text(spark):
    # 40,000 words: taken apart anew for each of its runs, such a text was minutes' work
    text = " ".join(f"w{k}" for k in range(40_000))
    q = spark.createDataFrame([(1, "w39994 w39995  w39996 W39997 w39998"), (2, "w7 w9 w8 w10 w11"), (3, "9998 w9999 w10"), (4, "w3"), (5, "w39999")], "item_id long, text string")
    s = spark.createDataFrame([(7, text), (8, "w1 w3"), (9, "w")], "doc_id long, text string")
    begin = time.monotonic()
    assert rows(quotes.verify(q, s)) == [(1, 7), (3, 7), (4, 7), (4, 8), (5, 7)]
    assert time.monotonic() - begin < 30


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "a string, b string")
    assert iterative.components(e).count() == 0
    g = spark.createDataFrame([], "event_id string, start_ts long, participants array<string>, source string, lat double, lng double")
    assert people.atlas(g).count() == 0 and people.weeks(g).count() == 0 and happenings.co_present_events(g).count() == 0
