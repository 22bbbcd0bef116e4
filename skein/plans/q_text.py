"""Queries of scalar functions and joins (F and J rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import local_time as L
from ..functions import text as T
from ..operators import joins as J
from .catalog import query
from .fragments import DAY, MEANINGFUL, zone_of


@query("q_f01_meaningful", f"SELECT id, {MEANINGFUL} AS meaningful FROM messages", "messages")
def _(a):
    return a.msgs.select("id", "meaningful")


@query("q_f02_mojibake")
def _(a):
    return a.table("documents").select("doc_id", T.repair(F.col("text")).alias("repaired"))


@query("q_f03_f12_f13_time_parts", """SELECT id, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts % 1000 AS STRING), 3, '0') || 'Z' AS iso, year(make_timestamp(ts * 1000)) AS y, month(make_timestamp(ts * 1000)) AS m,
    day(make_timestamp(ts * 1000)) AS d, strftime(make_timestamp(ts * 1000), '%Y-%m') AS ym, strftime(make_timestamp(ts * 1000), '%m-%d') AS md FROM messages""", "messages", ints="y m d")  # fmt: skip
def _(a):
    t = T.at(F.col("ts"))
    return a.messages.select("id", T.iso(F.col("ts")).alias("iso"), F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.date_format(t, "yyyy-MM").alias("ym"), F.date_format(t, "MM-dd").alias("md"))


@query("q_f04_f20_f22_f24_body", r"""SELECT id, lower(body) AS body_lower, substr(body, 1, 12) AS preview, len(body) > 12 AS truncated,
    regexp_matches(lower(body), 'i feel like|i don''t know|i don''t think|i''m not sure|maybe i') AS hedge, regexp_matches(lower(body), 'do u |r u |are u |where r u|what r u|do you |where are you') AS asking,
    regexp_matches(lower(body), '\bomw\b|\botw\b|\bon my way\b|\bi''?m here\b|\bwe''?re here\b|\bhere now\b|\bi''?m outside\b|\boutside now\b|\bout front\b|\bsee (?:you|u) (?:there|soon|at|in)\b|\bbe there (?:in|by|at)\b|\bleaving now\b|\bjust left\b|\balmost there\b|\bmins? away\b|\bminutes away\b|\bwhat''?s the address\b|\bsend (?:me )?the address\b|\brunning late\b') AS marker FROM messages""", "messages")  # fmt: skip
def _(a):
    b = F.col("body")
    short, cut = T.preview(b, 12)
    return a.messages.select("id", F.lower(b).alias("body_lower"), short.alias("preview"), cut.alias("truncated"), T.any_of(b, T.HEDGE).alias("hedge"), T.any_of(b, T.ASKING).alias("asking"), T.marker(b).alias("marker"))


@query("q_f05_f06_word_search", r"SELECT id FROM messages WHERE body ILIKE '%see%' AND regexp_matches(regexp_replace(lower(body), 'https?://\S+', ' ', 'g'), '(^|[^a-z0-9])see([^a-z0-9]|$)')", "messages")
def _(a):
    return a.messages.where(T.contains_like(F.col("body"), "see") & T.word_match(F.col("body"), "see")).select("id")


@query("q_f08_s27_mined_links", r"SELECT DISTINCT regexp_extract(body, 'partiful\.example/e/([A-Za-z0-9]+)', 1) AS event_id FROM messages WHERE body LIKE '%partiful%'", "messages")
def _(a):
    return a.messages.where(F.col("body").contains("partiful")).select(F.regexp_extract("body", r"partiful\.example/e/([A-Za-z0-9]+)", 1).alias("event_id")).distinct()


@query("q_f09_f10_alias_match", "SELECT canonical_id, list_contains(aliases, 'Ann Abel') AS exact, len(list_filter(aliases, lambda x: x ILIKE '%ann%')) > 0 AS any_like FROM identities", "identities")
def _(a):
    return a.identities.select("canonical_id", F.array_contains("aliases", "Ann Abel").alias("exact"), F.exists("aliases", lambda x: x.ilike("%ann%")).alias("any_like"))


@query("q_f11_unnest_participants", "SELECT event_id, unnest(participants) AS canonical_id FROM gatherings", "gatherings")
def _(a):
    return a.gatherings.select("event_id", F.explode("participants").alias("canonical_id"))


_MONDAY = "date_trunc('week', make_timestamp(ts * 1000))"


@query("q_f14_week_index", f"SELECT id, year({_MONDAY}) AS y, CAST(date_diff('day', date_trunc('week', make_date(year({_MONDAY}), 1, 1)::TIMESTAMP)::DATE, {_MONDAY}::DATE) // 7 AS INT) AS w FROM photos", "photos", ints="y")
def _(a):
    y, w = T.week_index(T.at(F.col("ts")))
    return a.photos.select("id", y.alias("y"), w.alias("w"))


_LOCAL = "make_timestamp(ts * 1000) + to_minutes(CAST(coalesce({z}.off, 0) AS BIGINT))"


@query("q_f15_j13_local_time", f"""SELECT id, coalesce(z.label, 'UTC?') AS zone_label, strftime({_LOCAL.format(z='z')}, '%Y-%m-%d %H:%M') || ' ' || coalesce(z.tag, 'UTC') AS local FROM (SELECT *, {zone_of('canonical_id', 'ts')} AS z FROM pm)""", "pm rules")
def _(a):
    return L.local_time(a.pm.select("id", "ts", "canonical_id"), "ts", "canonical_id", a.rules).select("id", "zone_label", L.formatted("ts").alias("local"))


@query("q_f16_two_sided", f"""WITH s AS (SELECT id, ts, CASE WHEN from_me THEN 'me' ELSE canonical_id END AS s, CASE WHEN from_me THEN canonical_id ELSE 'me' END AS r FROM pm), z AS (SELECT *, {zone_of('s', 'ts')} AS a, {zone_of('r', 'ts')} AS b FROM s),
    t AS (SELECT id, {_LOCAL.format(z='a')} AS ta, {_LOCAL.format(z='b')} AS tb, coalesce(a.tag, 'UTC') AS ga, coalesce(b.tag, 'UTC') AS gb, coalesce(a.label, 'UTC?') AS la, coalesce(b.label, 'UTC?') AS lb FROM z)
    SELECT id, strftime(ta, '%Y-%m-%d %H:%M') || ' ' || ga || CASE WHEN strftime(ta, '%H:%M') || ga = strftime(tb, '%H:%M') || gb AND la = lb THEN '' ELSE ' / ' || strftime(tb, '%H:%M') || ' ' || gb END AS shown FROM t""", "pm rules")  # fmt: skip
def _(a):
    sides = a.pm.select("id", "ts", F.when(F.col("from_me"), "me").otherwise(F.col("canonical_id")).alias("s"), F.when(F.col("from_me"), F.col("canonical_id")).otherwise("me").alias("r"))
    return L.two_sided(sides, "ts", "s", "r", a.rules).select("id", "shown")


@query("q_f18_redaction", "SELECT id FROM messages WHERE NOT (regexp_matches(body, '(?i)lunch|\\bann\\b') OR regexp_matches(sender_name, '(?i)lunch|\\bann\\b'))", "messages")
def _(a):
    return a.messages.where(~T.redacted([F.col("body"), F.col("sender_name")], [r"(?i)lunch", r"(?i)\bann\b"])).select("id")


@query("q_f19_row_redaction", "SELECT id FROM messages WHERE NOT (contains(body, 'lunch') OR contains(sender_name, 'lunch'))", "messages")
def _(a):
    return a.messages.select("id", "sender_name", "body").where(~T.row_redacted(["lunch"])).select("id")


@query("q_f21_f31_quotes", r"""SELECT doc_id, trim(lower(regexp_replace(translate(trim(coalesce(text, ''), ' '), '‘’“”–— ', '''''""-- '), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS quote FROM documents""")
def _(a):
    return a.table("documents").select("doc_id", T.normal_quote(F.col("text")).alias("quote"))


@query("q_f23_keyword_categories", r"""SELECT c, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(b, '\b(i miss you|lonely|ashamed)\b') THEN 'vulnerability' END, CASE WHEN regexp_matches(b, '\b(we need to talk|fight)\b') THEN 'conflict' END,
    CASE WHEN regexp_matches(b, '\b(been thinking about|on my mind)\b') THEN 'reflection' END, CASE WHEN regexp_matches(b, '\b(hope you|i''?m here|are you ok)\b') THEN 'care' END], lambda x: x IS NOT NULL)) AS c FROM (SELECT lower(body) AS b FROM messages WHERE len(body) BETWEEN 10 AND 400)) GROUP BY c""", "messages")  # fmt: skip
def _(a):
    return a.messages.select(F.explode(T.categories(F.col("body"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("q_f25_haversine", "SELECT photo_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(-33.87 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-33.87)) * pow(sin(radians(151.21 - lng) / 2), 2)))), 6) AS km FROM places", "places")
def _(a):
    return a.places.select("photo_id", F.round(T.haversine(F.col("lat"), F.col("lng"), F.lit(-33.87), F.lit(151.21)), 6).alias("km"))


@query("q_f26_rolling_hash", "SELECT id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS BIGINT) AS h FROM photos", "photos")
def _(a):
    return a.photos.select("id", T.rolling_hash(F.col("id")).alias("h"))


@query("q_f27_round_key", "SELECT photo_id, floor(lat * 1000 + 0.5) / 1000 AS la, floor(lng * 1000 + 0.5) / 1000 AS ln FROM places", "places")
def _(a):
    return a.places.select("photo_id", T.round_half_up(F.col("lat"), 1000).alias("la"), T.round_half_up(F.col("lng"), 1000).alias("ln"))


@query("q_f28_f29_name_forms", "SELECT canonical_id, f AS form FROM forms", "forms")
def _(a):
    return a.identities.select("canonical_id", F.explode(F.array_union("aliases", F.array("display_name"))).alias("x")).select("canonical_id", F.explode(T.name_forms(F.col("x"))).alias("form")).distinct()


@query("q_f17_iso_bounds", "SELECT id, CASE WHEN n % 3 = 0 THEN epoch_ms(make_timestamp(ts * 1000)::DATE::TIMESTAMP) WHEN n % 3 = 1 THEN ts ELSE ts // 1000 * 1000 - 36000000 END AS bound FROM photos", "photos")
def _(a):
    at = F.timestamp_millis("ts")
    text = F.when(F.col("n") % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(F.col("n") % 3 == 1, F.col("ts").cast("string")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+10:00'"))
    return a.photos.select("id", T.iso_ms(text).alias("bound"))


@query("q_f30_alphabetic_forms", r"SELECT DISTINCT canonical_id, unnest(list_distinct([display_name, split_part(display_name, ' ', 1)])) AS form FROM identities WHERE regexp_matches(display_name, '^\p{L}[\p{L}'' -]+$') AND display_name <> lower(display_name)", "identities")
def _(a):
    return a.identities.select("canonical_id", F.explode(T.alphabetic_forms(F.col("display_name"))).alias("form")).distinct()


@query("q_f32_f33_log_blend", "SELECT canonical_id, n, round(log10(n + 1) * 10 + ln(1 + n) + sqrt(n), 6) AS blend, CASE WHEN n BETWEEN 10 AND 20 THEN 'mid' WHEN n IN (1, 2) THEN 'low' ELSE 'other' END AS band FROM cnt", "cnt")
def _(a):
    n = a.messages.join(a.thread_identity, "thread_id").groupBy("canonical_id").agg(F.count("*").alias("n"))
    band = F.when(F.col("n").between(10, 20), "mid").when(F.col("n").isin(1, 2), "low").otherwise("other")
    return n.select("canonical_id", "n", F.round(F.log10(F.col("n") + 1) * 10 + F.log1p("n") + F.sqrt("n"), 6).alias("blend"), band.alias("band"))


@query("q_f34_f36_keys", r"SELECT page_id, regexp_replace(url, '[^\w-]+', '_', 'g') AS slug, sha1(url) AS path_key, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS url_key FROM pages")
def _(a):
    return a.table("pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.sha1("url").alias("path_key"), T.url_key(F.col("url")).alias("url_key"))


@query("q_f35_label_category", "SELECT addr, category AS c FROM emails", "emails")
def _(a):
    labels = F.when(F.col("category").isNull(), F.array(F.lit("Inbox"))).otherwise(F.array(F.lit("Inbox"), F.concat(F.lit("Category "), F.initcap("category")), F.lit("Category Other")))
    return a.emails.select("addr", T.label_category(labels).alias("c"))


@query("q_j01_star", "SELECT i.canonical_id, i.display_name, t.is_group, count(*) AS n FROM messages m JOIN thread_identity ti USING (thread_id) JOIN threads t USING (thread_id) JOIN identities i ON i.canonical_id = ti.canonical_id GROUP BY ALL", "messages thread_identity threads identities")
def _(a):
    return J.star(a.messages, a.thread_identity, a.threads, a.identities).groupBy("canonical_id", "display_name", "is_group").agg(F.count("*").alias("n"))


@query("q_j02_j03_left_counts", """SELECT i.canonical_id, coalesce(c.n, 0) AS messages, coalesce(f.n, 0) AS photos FROM identities i LEFT JOIN cnt c USING (canonical_id)
    LEFT JOIN (SELECT canonical_id, count(*) AS n FROM photo_faces GROUP BY 1) f USING (canonical_id)""", "identities cnt photo_faces")  # fmt: skip
def _(a):
    return J.left_counts(a.identities.select("canonical_id"), messages=a.pm, photos=a.photo_faces)


@query("q_j04_semi", "SELECT id FROM messages WHERE thread_id IN (SELECT thread_id FROM messages GROUP BY 1 HAVING count(*) > 80)", "messages")
def _(a):
    busy = a.messages.groupBy("thread_id").agg(F.count("*").alias("n")).where("n > 80")
    return a.messages.join(busy, "thread_id", "left_semi").select("id")


@query("q_j05_anti", "SELECT id FROM photos p WHERE NOT EXISTS (SELECT 1 FROM places l WHERE l.photo_id = p.id)", "photos places")
def _(a):
    return a.photos.join(a.places.withColumnRenamed("photo_id", "id"), "id", "left_anti").select("id")


@query("q_j06_pairs", "SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS n FROM photo_faces a JOIN photo_faces b ON a.photo_id = b.photo_id AND a.canonical_id < b.canonical_id GROUP BY ALL", "photo_faces")
def _(a):
    return J.pairs(a.photo_faces, "photo_id", "canonical_id").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("q_j07_both_ways", "SELECT a.canonical_id AS a, count(*) AS n FROM photo_faces a JOIN photo_faces b ON a.photo_id = b.photo_id AND a.canonical_id <> b.canonical_id GROUP BY ALL", "photo_faces")
def _(a):
    return J.pairs(a.photo_faces, "photo_id", "canonical_id", both=True).groupBy("a").agg(F.count("*").alias("n"))


@query("q_j08_name_or_alias", "SELECT DISTINCT m.sender_name, i.canonical_id FROM (SELECT DISTINCT sender_name FROM messages) m LEFT JOIN identities i ON i.display_name = m.sender_name OR list_contains(i.aliases, m.sender_name)", "messages identities")
def _(a):
    return J.by_any_alias(a.identities, a.messages.select("sender_name").distinct(), "sender_name").select("sender_name", "canonical_id")


_A, _B = "SELECT * FROM gatherings WHERE source = 'messages'", "SELECT * FROM gatherings WHERE source = 'photos'"


@query("q_j10_interval_overlap", f"SELECT a.event_id AS id, b.event_id AS rid FROM ({_A}) a JOIN ({_B}) b ON b.start_ts <= a.end_ts + {DAY} AND b.end_ts >= a.start_ts - {DAY} AND list_has_any(a.participants, b.participants)", "gatherings")
def _(a):
    g = a.gatherings
    left = g.where("source = 'messages'").selectExpr("event_id AS id", "start_ts AS lo", "end_ts AS hi", "participants AS p")
    right = g.where("source = 'photos'").selectExpr("event_id AS rid", "start_ts AS rlo", "end_ts AS rhi", "participants AS rp")
    return J.overlapping(left, right, DAY, DAY, ("p", "rp")).select("id", "rid")


@query("q_j11_point_in_interval", f"SELECT p.id, g.event_id FROM photos p JOIN gatherings g ON p.ts BETWEEN g.start_ts - {DAY} AND g.start_ts + {2 * DAY}", "photos gatherings")
def _(a):
    g = a.gatherings.select("event_id", "start_ts", (F.col("start_ts") + DAY).alias("stop_ts"))
    return J.within(a.photos, "ts", g, "start_ts", "stop_ts", DAY).select("id", "event_id")


@query("q_j12_e06_nearest", f"""WITH n AS (SELECT c.call_id AS k, s.h, greatest(0, s.lo - c.ts, c.ts - s.hi) AS gap FROM calls c JOIN (SELECT ts // {DAY} AS h, min(ts) AS lo, min(ts) + 3600000 AS hi FROM messages GROUP BY 1) s ON c.ts BETWEEN s.lo - 7200000 AND s.hi + 7200000),
    one AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, h) AS r FROM n), two AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY gap, k) AS q FROM one WHERE r = 1) SELECT k AS call_id, h, CAST(gap AS BIGINT) AS gap FROM two WHERE q = 1""", "calls messages")  # fmt: skip
def _(a):
    s = a.messages.groupBy(F.floor(F.col("ts") / DAY).alias("h")).agg(F.min("ts").alias("lo")).withColumn("hi", F.col("lo") + 3_600_000)
    return J.nearest(a.calls.select("call_id", "ts"), "call_id", "ts", s, "h", "lo", "hi", 7_200_000).select("call_id", "h", "gap")


@query("q_j14_scalar_subquery", "SELECT e.event_id, (SELECT arg_min(p.asset_path, p.ts) FROM photos p JOIN ep ON ep.photo_id = p.id WHERE ep.event_id = e.event_id) AS thumb, (SELECT count(*) FROM ep JOIN photo_faces f USING (photo_id) WHERE ep.event_id = e.event_id) AS faces FROM gatherings e", "gatherings ep photos photo_faces")
def _(a):
    t = a.ep.join(a.photos.withColumnRenamed("id", "photo_id"), "photo_id").groupBy("event_id").agg(F.min_by("asset_path", F.struct("ts", "photo_id")).alias("thumb"))
    n = a.ep.join(a.photo_faces, "photo_id").groupBy("event_id").agg(F.count("*").alias("faces"))
    return a.gatherings.select("event_id").join(t, "event_id", "left").join(n, "event_id", "left").na.fill(0, ["faces"])


@query("q_j15_spatial", "SELECT a.photo_id AS id, b.photo_id AS rid FROM places a JOIN places b ON a.photo_id < b.photo_id AND abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001", "places")
def _(a):
    left, right = a.places.selectExpr("photo_id AS id", "lat", "lng"), a.places.selectExpr("photo_id AS rid", "lat AS rlat", "lng AS rlng")
    return J.spatial(left, right).select("id", "rid").where("id < rid")


@query("q_j16_name_lookup", "SELECT m.sender_name, arg_max(i.canonical_id, i.n) AS canonical_id FROM (SELECT DISTINCT sender_name FROM messages) m LEFT JOIN identities i ON lower(i.display_name) = lower(m.sender_name) GROUP BY 1", "messages identities")
def _(a):
    return J.by_name(a.messages.select("sender_name").distinct(), "sender_name", a.identities, "n").select("sender_name", "canonical_id")


@query("q_j17_s18_calls", r"""SELECT c.call_id, c.direction, (NOT c.answered AND c.duration_s = 0) AS missed, CASE WHEN regexp_matches(c.provider, '(?i)facetime') THEN 'facetime' ELSE 'phone' END AS service, k.canonical_id
    FROM calls c LEFT JOIN (SELECT '+' || regexp_replace(x, '\D', '', 'g') AS k, arg_min(canonical_id, n) AS canonical_id FROM (SELECT canonical_id, n, unnest(aliases) AS x FROM identities) WHERE NOT regexp_matches(x, '[A-Za-z]') GROUP BY 1) k ON k.k = '+' || regexp_replace(c.address, '\D', '', 'g')""", "calls identities")  # fmt: skip
def _(a):
    from ..sources.tables import calls

    return J.by_address(calls(a.calls), "address", a.identities, "n").select("call_id", "direction", "missed", "service", "canonical_id")
