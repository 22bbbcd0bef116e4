"""Portraits' moments, timeline, check-ins, the engagement collector and nested dumps against plain versions."""

import json
import math
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import crm, relations, writing

DAY = 86_400_000


def ms(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1000)


MD = """# Maya

*first to call*

**2019-12-31 — Before the section.**

## Anchor moments

**2024-03-02 — Lake weekend.** and more prose
**2024-01-09** — no closing, not a moment
**2023-05-06** – Moved house.** tail
### Big trip (Feb 3 2022 → Feb 9 2022)
### Odd month (Foo 3 2022)
**2024-03-02 — lake WEEKEND**
**2024-03-02 — Second of that day.**

## Later
**2030-01-01 — After.**
"""


def moments(spark, text):
    df = relations.anchors(spark.createDataFrame([("p", text)], "name string, text string"))
    return [(r["date"], r["summary"]) for r in df.orderBy("date", "place").collect()]


def test_anchors(spark):
    # `2024-01-09` closes at the next bold mark of its own line only, and it has none
    assert moments(spark, MD) == [("2022-02-03", "Big trip"), ("2023-05-06", "Moved house"), ("2024-03-02", "Lake weekend"), ("2024-03-02", "Second of that day")]
    assert moments(spark, "no section **2020-02-02 - Here.**") == [("2020-02-02", "Here")]
    assert moments(spark, "## Anchor moments\nnothing\n## More\n**2020-02-02 - Here.**") == []
    assert moments(spark, "") == [] and moments(spark, None) == []
    long = "## anchor moment\n" + "x" * 2_000_000 + "\n**2021-01-01 — End.**"
    assert moments(spark, long) == [("2021-01-01", "End")]


def test_stems(spark):
    got = spark.createDataFrame([("✨Ann B.✨",), ("Bo",), ("!!",)], "n string").select(relations.stems(F.col("n"))).collect()
    assert [r[0] for r in got] == [["_Ann_B_", "Ann_B_", "_Ann_B", "Ann_B"], ["Bo"] * 4, ["_"]]


@pytest.mark.parametrize("today,month,day,want", [((2024, 3, 1, 12), 3, 1, 365), ((2024, 3, 1, 12), 3, 2, 1), ((2024, 3, 1), 3, 1, 0), ((2023, 1, 1), 2, 29, 59), ((2024, 12, 31, 23), 1, 1, 0), ((2024, 1, 1), None, 3, None)])
def test_until_birthday(spark, today, month, day, want):
    df = spark.createDataFrame([(month, day)], "m int, d int")
    assert df.select(relations.until_birthday(F.col("m"), F.col("d"), ms(*today))).first()[0] == want


def plain_scores(n, first, last, today, mine, pictured, soon):
    d = (today - last).days
    years = max(0.1, (last - first).days / 365)
    heard = d or 999
    fresh = 1.0 if heard <= 60 else 0.7 if heard <= 365 else 0.4 if heard <= 1095 else 0.15
    wait = 0 if d <= 7 else (d - 7) * 1.5 if d <= 30 else 30 + (d - 30) * 0.7 if d <= 180 else 100 - (d - 180) * 0.05 if d <= 730 else 70 - min(d - 730, 1000) * 0.05
    wait += 0 if mine else 25
    wait += 0 if soon is None else 60 if soon <= 14 else 30 if soon <= 30 else 0
    half = lambda x: math.floor(x + 0.5)
    return half(math.log10(n) * 20 * math.sqrt(years) * fresh * (1.15 if pictured else 1.0) * 10) / 10, half(years * 10) / 10, half(wait)


def test_check_ins_and_timeline(spark):
    today = date(2024, 7, 1)
    gaps = [0, 3, 7, 8, 30, 31, 60, 61, 180, 181, 365, 366, 730, 731, 1095, 1096, 1800, 4000]
    rows, want, born = [], {}, [("p1", 7, 10, 1990, "a"), ("p1", 1, 1, None, "b"), ("p3", 7, 20, None, "a"), ("gone", 1, 1, None, "a")]
    for k, d in enumerate(gaps):
        last, first = today - timedelta(days=d), today - timedelta(days=d + k * 40)
        rows.append((f"p{k}", f"Name {k}", 10 + k, ms(first.year, first.month, first.day, 5), ms(last.year, last.month, last.day, 23), "me" if k % 2 else "them", "hi"))
        want[f"p{k}"] = plain_scores(10 + k, first, last, today, k % 2, k in (2, 4), {1: 9, 3: 19}.get(k))
    people = spark.createDataFrame(rows, "canonical_id string, display_name string, msg_count long, first_ts long, last_ts long, last_from string, excerpt string")
    birthdays = spark.createDataFrame(born, "canonical_id string, month int, day int, year int, source string")
    portraits = spark.createDataFrame([("Name_2", MD), ("Name_4", "# N\n\n*the essence *\n\ntext"), ("Nobody", MD), (None, None)], "name string, text string")
    got = relations.check_ins(people, portraits, birthdays, ms(2024, 7, 1, 9)).orderBy("place").collect()
    assert {r["canonical_id"]: (r["intimacy"], r["years_active"], r["attention"]) for r in got} == want
    assert [r["canonical_id"] for r in got] == sorted(want, key=lambda p: (p not in ("p2", "p4"), -want[p][2], -int(p[1:])))
    assert {r["canonical_id"]: r["about_what"] for r in got if r["has_portrait"]} == {"p2": "2024-03-02: Second of that day", "p4": "the essence"}
    assert {r["canonical_id"]: r["days_until_birthday"] for r in got if r["days_until_birthday"] is not None} == {"p1": 9, "p3": 19}

    lines = relations.timeline(people, portraits, birthdays, ms(2024, 7, 1, 9)).collect()
    assert [(r["date"], r["person"]) for r in lines] == sorted((r["date"], r["person"]) for r in lines)
    kinds = {k: sorted((r["canonical_id"], r["date"], r["summary"]) for r in lines if r["kind"] == k) for k in ("anchor", "birthday", "last_contact")}
    assert [x[:2] for x in kinds["anchor"]] == [("p2", d) for d in ("2022-02-03", "2023-05-06", "2024-03-02", "2024-03-02")]
    assert kinds["birthday"] == [("p1", "2024-01-01", "Name 1's birthday"), ("p1", "2024-07-10", "Name 1's birthday (turns 34)"), ("p3", "2024-07-20", "Name 3's birthday")]
    assert len(kinds["last_contact"]) == len(gaps) - 1  # p0 was met on one day only
    assert relations.timeline(people.limit(0), portraits, birthdays, 0).count() == 0 == relations.check_ins(people.limit(0), portraits, birthdays, 0).count()


def test_closest(spark):
    m = [(f"a{i}", i, "t1", i == 3, "x" * 300 if i == 3 else "hi") for i in range(4)] + [("b1", 1, "t2", True, "one"), ("b2", 1, "t2", False, " two\n three "), ("b3", 9, "t2", True, ""), ("c", 1, "g", True, "group"), ("d", 1, None, None, None)]
    messages = spark.createDataFrame(m, "id string, ts long, thread_id string, from_me boolean, body string")
    threads = spark.createDataFrame([("t1", False), ("t2", False), ("g", True)], "thread_id string, is_group boolean")
    ti = spark.createDataFrame([("t1", "A"), ("t2", "B"), ("g", "C")], "thread_id string, canonical_id string")
    names = spark.createDataFrame([("A", "Ann"), ("B", "Bob"), ("C", "Cy")], "canonical_id string, display_name string")
    got = relations.closest(messages, ti, threads, names, least=1).collect()
    assert [tuple(r) for r in got] == [("A", "Ann", 4, 0, 3, "me", "x" * 200), ("B", "Bob", 2, 1, 1, "them", "two three")]
    assert relations.closest(messages, ti, threads, names, least=2).count() == 1


@pytest.mark.parametrize("n", [0, 1, 19, 30, 39, 40, 41, 79, 80, 81, 150, 301])
def test_thread_sample(spark, n):
    every, mid = list(range(n)), n // 2
    want = every[:40] + every[mid - 20 : mid + 20] + every[-40:]
    messages = spark.createDataFrame([(f"{i:04}", i // 3) for i in every], "id string, ts long")
    got = sorted((r["place"], int(r["id"])) for r in writing.thread_sample(messages).collect())
    assert got == list(enumerate(want))


def test_engagement_of_nothing(spark):
    messages = spark.createDataFrame([], "id string, ts long, sender string, content string, reactions array<struct<actor: string, reaction: string>>")
    other = spark.createDataFrame([], "ts long, name string")
    got = {(r["section"], r["item"]): r["n"] for r in writing.engagement("Bob", messages, other, other, other, likes=other).collect()}
    assert got == {("totals", "messages"): 0, ("totals", "text"): 0, ("totals", "first"): None, ("totals", "last"): None, ("social", "i_follow_them"): 0, ("social", "they_follow_me"): 0, ("engagement", "likes"): 0}


def test_dump(spark, tmp_path):
    first = {"people": [
        {"id": "a", "name": "Ann", "followUp": "call", "tags": ["x", "x", None], "interactions": [{"id": "i1", "type": "call", "notes": "hey", "date": "2024-01-02"}, {"date": "soon"}, {"notes": ""}]},
        {"name": "", "tags": ["y"], "extra": 1}, {"id": "a", "name": "Other", "tags": ["z"], "interactions": [{"id": "i1", "type": "late"}]}, {"id": "", "name": "No id"}],
        "connections": [{"source": "a", "target": "b", "strength": 4}, {"source": "a", "target": "b"}]}
    (tmp_path / "1.json").write_text(json.dumps(first, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"people": [{"id": "b", "name": "Bo"}, {"id": "a", "name": "Third"}], "connections": [{"source": "a", "target": "b", "strength": 7}]}))
    (tmp_path / "3.json").write_text("{}")
    dumps = crm.read_dump(spark, str(tmp_path))
    people, tags, interactions, links = (df.collect() for df in crm.from_dump(dumps, 99))
    ids = {r["name"]: r["id"] for r in people}
    assert set(ids) == {"Ann", "(unnamed)", "No id", "Bo"} and ids["Ann"] == "a" and len(set(ids.values())) == 4 and len(ids["No id"]) == 64
    assert [(r["follow_up"], r["email"], r["created_at"]) for r in people if r["id"] == "a"] == [("call", None, 99)]
    assert {tuple(r) for r in tags} == {("a", "x"), ("a", "z"), (ids["(unnamed)"], "y")}
    assert sorted((r["person_id"], r["kind"], r["body"], r["occurred_at"]) for r in interactions if r["id"] == "i1") == [("a", "call", "hey", ms(2024, 1, 2))]
    assert [(r["kind"], r["body"], r["occurred_at"]) for r in interactions if r["id"] != "i1"] == [("note", None, 99)]
    assert [tuple(r) for r in links] == [("a", "b", 7, 99)]
    assert people == crm.from_dump(dumps, 99)[0].collect() or {tuple(r) for r in people} == {tuple(r) for r in crm.from_dump(dumps, 99)[0].collect()}
    bad = spark.createDataFrame([("s", json.dumps({"people": [], "connections": [{"source": "a", "target": "q"}]})), ("t", "not json"), ("u", None)], "seq string, text string")
    with pytest.raises(Exception, match="connection to nobody"):
        crm.from_dump(bad, 1)[3].collect()
    assert crm.from_dump(bad, 1)[0].count() == 0
