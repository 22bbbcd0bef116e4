"""Local time by rules: overlapping windows, gaps, open bounds, and the text of both sides."""

import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions import local_time as L

RULES = [(0, "a", "2021-11-15", "2022-02-15", "Asia/Taipei", "TPE"), (1, "a", "2022-02-01", "2022-07-01", "America/Chicago", "CHI"), (2, "a", None, "2021-01-01", "Australia/Melbourne", "MEL"), (3, "a", "2022-06-20", None, "Pacific/Auckland", None), (4, "me", None, None, "America/Chicago", "CHI")]


def rules(spark):
    return spark.createDataFrame(RULES, "rule int, canonical_id string, a string, b string, zone string, label string").selectExpr("rule", "canonical_id", "date(a) AS from_day", "date(b) AS to_day", "zone", "label")


def plain(person, day):
    for _, who, a, b, zone, label in RULES:
        if who == person and (a is None or day >= a) and (b is None or day < b):
            return zone, label or zone
    return "UTC", "UTC?"


@pytest.mark.parametrize("small", [True, False])
def test_zones(spark, monkeypatch, small):
    monkeypatch.setattr(L, "INDEXED_PEOPLE", 10 if small else 0)
    days = [datetime.date(2020, 12, 20) + datetime.timedelta(k * 9) for k in range(80)]
    df = spark.createDataFrame([(str(d), p) for d in days for p in ("a", "me", "b", None)], "day string, who string").withColumn("ts", F.unix_millis(F.concat("day", F.lit(" 13:00:00")).cast("timestamp")))
    out = L.local_time(df, "ts", "who", rules(spark))
    got = {(r["day"], r["who"]): (r["zone"], r["zone_label"]) for r in out.collect()}
    assert got == {(str(d), p): plain(p, str(d)) for d in days for p in ("a", "me", "b", None)}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and ("BroadcastHashJoin" in text or not small)


def test_both_sides(spark):
    at = lambda s: int(datetime.datetime.fromisoformat(s + "+00:00").timestamp() * 1000)
    rows = [(1, at("2022-01-10T18:30"), "me", "a"), (2, at("2022-05-10T18:30"), "me", "a"), (3, at("2022-07-10T18:30"), "a", "b"), (4, at("2020-07-10T18:30"), "b", "a"), (5, at("2022-07-10T18:30"), "b", None)]
    got = {r["id"]: r["shown"] for r in L.two_sided(spark.createDataFrame(rows, "id int, ts long, s string, r string"), "ts", "s", "r", rules(spark)).collect()}
    assert got == {1: "2022-01-10 12:30 CST / 02:30 TPE", 2: "2022-05-10 13:30 CDT", 3: "2022-07-11 06:30 GMT+12 / 18:30 UTC", 4: "2020-07-10 18:30 UTC / 04:30 MEL", 5: "2022-07-10 18:30 UTC"}
