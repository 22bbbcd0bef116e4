"""Queries of per-person and per-period analytics (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.local_time import local_time
from ..functions.text import CATEGORIES, categories
from ..operators import people as P
from ..operators import relations
from ..operators import reports as R
from ..operators.aggregates import head_middle_tail, systematic
from ..operators.joins import by_address
from ..session import Scratch
from .catalog import query
from .fragments import DAY, LATER, NOW

_TS = "make_timestamp(ts * 1000)"
_W0 = "make_timestamp(start_ts * 1000)"
_ROUND = "floor(({}) * {} + 0.5) / {}"


@query("q_a01_a02_profile", f"""WITH w AS (SELECT *, ts - lag(ts) OVER o AS g, lag(from_me) OVER o AS lf FROM pm WINDOW o AS (PARTITION BY canonical_id ORDER BY ts, id)), a AS (SELECT canonical_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE from_me) AS mine,
    count(*) FILTER (WHERE hour({_TS}) IN (23, 0, 1, 2, 3, 4)) AS late, count(DISTINCT ts // {DAY}) AS active_days, coalesce(median(CASE WHEN lf <> from_me AND g > 0 AND g < {DAY} THEN g END), 0.0) AS median_ms FROM w GROUP BY 1),
    b AS (SELECT *, CAST(greatest(1, floor((last_ts - first_ts) / {DAY} + 0.5)) AS BIGINT) AS span_days, late / n AS late_ratio, 1 - abs(2 * mine - n) / n AS reciprocity FROM a)
    SELECT canonical_id, n, first_ts, last_ts, active_days, median_ms, span_days, late_ratio, reciprocity, floor((10 * log10(n + 1) + 5 * log10(span_days + 1) + 0.5 * n / active_days + 20 * late_ratio + 15 * reciprocity + 10 * CASE WHEN ({LATER} - last_ts) / {DAY} < 30 THEN 1.0 WHEN ({LATER} - last_ts) / {DAY} < 180 THEN 0.5 ELSE 0.1 END
    - CASE WHEN median_ms > 0 THEN log10(median_ms / 1000 + 1) ELSE 0 END) * 10 + 0.5) / 10 AS score FROM b ORDER BY score DESC, canonical_id LIMIT 100""", "pm")  # fmt: skip
def _(a):
    return P.profile(a.pm, "canonical_id", LATER).orderBy(F.col("score").desc(), "canonical_id").limit(100)


_LOADED = " UNION ALL ".join(f"SELECT '{name}' AS c, id, ts FROM messages WHERE len(body) BETWEEN 10 AND 400 AND regexp_matches(lower(body), '{pattern.replace(chr(39), chr(39) * 2)}')" for name, pattern in CATEGORIES.items())


@query("q_a03_loaded_sample", f"""WITH i AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY c) AS n FROM ({_LOADED})) SELECT c, id FROM i WHERE n <= 12 OR list_contains(list_transform(range(12), lambda k: k * n // 12), i)""", "messages")
def _(a):
    return systematic(a.messages.select("id", "ts", F.explode(categories(F.col("body"))).alias("c")), ["c"], ["ts", "id"], 12).select("c", "id")


@query("q_a04_late_sample", f"""WITH c AS (SELECT id, ts FROM messages WHERE len(body) BETWEEN 10 AND 279 AND hour({_TS}) IN (23, 0, 1, 2, 3, 4)), i AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS i, count(*) OVER () AS n FROM c) SELECT id FROM i WHERE n <= 20 OR i IN (SELECT unnest(list_transform(range(20), lambda k: k * n // 20)))""", "messages")
def _(a):
    m = a.messages.where(F.length("body").between(10, 279) & F.hour(F.timestamp_millis("ts")).isin(23, 0, 1, 2, 3, 4)).withColumn("_g", F.lit(1))
    return systematic(m, ["_g"], ["ts", "id"], 20).select("id")


@query("q_a06_trajectory", f"""SELECT canonical_id, strftime({_TS}, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE from_me) AS from_me, {_ROUND.format("count(*) FILTER (WHERE regexp_matches(lower(body), 'i feel like|i don''t know|i don''t think|i''m not sure|maybe i')) * 1000 / count(*)", 100, 100)} AS hedge_per_1k,
    {_ROUND.format("count(*) FILTER (WHERE regexp_matches(lower(body), 'do u |r u |are u |where r u|what r u|do you |where are you')) * 1000 / count(*)", 100, 100)} AS asking_per_1k, median(len(body)) AS median_length FROM pm GROUP BY ALL""", "pm")  # fmt: skip
def _(a):
    return P.trajectory(a.pm, "canonical_id")


@query("q_a07_key_moments", f"""WITH w AS (SELECT *, ts - lag(ts) OVER (PARTITION BY canonical_id ORDER BY ts, id) AS gap FROM pm), g AS (SELECT canonical_id, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(max(gap), 0) AS longest_gap FROM w GROUP BY 1),
    e AS (SELECT canonical_id, ts AS gap_end FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY coalesce(gap, 0) DESC, ts) AS r FROM w) WHERE r = 1), m AS (SELECT canonical_id, v AS peak_month FROM (SELECT canonical_id, strftime({_TS}, '%Y-%m') AS v, row_number() OVER (PARTITION BY canonical_id ORDER BY count(*) DESC, strftime({_TS}, '%Y-%m')) AS r FROM pm GROUP BY 1, 2) WHERE r = 1),
    d AS (SELECT canonical_id, v AS biggest_day FROM (SELECT canonical_id, strftime({_TS}, '%Y-%m-%d') AS v, row_number() OVER (PARTITION BY canonical_id ORDER BY count(*) DESC, strftime({_TS}, '%Y-%m-%d')) AS r FROM pm GROUP BY 1, 2) WHERE r = 1) SELECT * FROM g JOIN e USING (canonical_id) JOIN m USING (canonical_id) JOIN d USING (canonical_id)""", "pm")  # fmt: skip
def _(a):
    return P.key_moments(a.pm, "canonical_id")


@query("q_a08_t06_baseline_30d", f"""WITH f AS (SELECT canonical_id, min(ts) AS t0 FROM pm GROUP BY 1), s AS (SELECT canonical_id, t0 + i * {7 * DAY} AS a FROM f, unnest(range(0, 60)) u(i) WHERE t0 + i * {7 * DAY} + {30 * DAY} <= {LATER - 30 * DAY})
    SELECT canonical_id, median(n) AS baseline FROM (SELECT s.canonical_id, s.a, count(m.ts) AS n FROM s LEFT JOIN pm m ON m.canonical_id = s.canonical_id AND m.ts >= s.a AND m.ts < s.a + {30 * DAY} GROUP BY ALL) GROUP BY 1""", "pm")  # fmt: skip
def _(a):
    return P.baseline(a.pm, "canonical_id", LATER)


@query("q_a09_current_state", f"SELECT canonical_id, ({NOW} - max(ts)) // {DAY} AS days_since, arg_max(from_me, {{'t': ts, 'i': id}}) AS last_from_me, count(*) FILTER (WHERE ts > {NOW - 30 * DAY} AND ts <= {NOW}) AS recent_30d FROM pm GROUP BY 1", "pm")
def _(a):
    return P.current_state(a.pm, "canonical_id", NOW)


@query("q_a10_t07_rhythm", f"""SELECT year(date_trunc('week', {_TS})) AS year, CAST(date_diff('day', date_trunc('week', make_date(year(date_trunc('week', {_TS})), 1, 1)::TIMESTAMP)::DATE, date_trunc('week', {_TS})::DATE) // 7 AS INT) AS week, hour(local) AS hour, count(*) AS n, count(*) FILTER (WHERE from_me) AS n_from_me FROM mine WHERE meaningful GROUP BY 1, 2, 3""", "mine", ints="year hour")
def _(a):
    return P.rhythm(local_time(a.msgs.withColumn("me", F.lit("me")), "ts", "me", a.rules))


@query("q_a12_almanac", "WITH s AS (SELECT * FROM seen WHERE canonical_id <> 'id-0'), n AS (SELECT canonical_id, count(*) AS n FROM s WHERE y = 1998 GROUP BY 1) SELECT canonical_id, n, n / (SELECT sum(n) FROM n) AS share, (SELECT min(y) FROM s WHERE s.canonical_id = n.canonical_id) = 1998 AS new_face FROM n", "seen")
def _(a):
    return P.almanac(a.gatherings, 1998, "id-0")


_BACK = 820_454_400_000  # messages of January 2024 as of January 1998, a year that has events


@query("q_a12_year", f"""WITH g AS (SELECT *, year({_W0}) AS y FROM gatherings), s AS (SELECT y, unnest(participants) AS p FROM g), n AS (SELECT p, count(*) FILTER (WHERE y = 1998) AS now, count(*) FILTER (WHERE y = 1997) AS before, min(y) AS first FROM s WHERE p <> 'id-0' GROUP BY 1),
    m AS (SELECT canonical_id AS c FROM msgs LEFT JOIN thread_identity USING (thread_id) WHERE meaningful AND year(make_timestamp((ts - {_BACK}) * 1000)) = 1998), d AS (SELECT c, count(*) AS n FROM m WHERE c IS NOT NULL AND c <> 'id-0' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c) AS r, sum(n) OVER () AS t FROM d),
    b AS (SELECT * FROM g WHERE y = 1998 ORDER BY n_photos DESC, event_id LIMIT 1), o AS (SELECT 'counts' AS section, NULL::INT AS place, 'events' AS item, count(*) AS n, NULL::DOUBLE AS share FROM g WHERE y = 1998 UNION ALL SELECT 'counts', NULL, 'inferred', count(*), NULL FROM g WHERE y = 1998 AND source = 'messages'
    UNION ALL SELECT 'counts', NULL, 'messages', count(*), NULL FROM m UNION ALL SELECT 'counts', NULL, 'photos', count(*), NULL FROM photos WHERE year({_TS}) = 1998 UNION ALL SELECT 'counts', NULL, 'people', count(*), NULL FROM n WHERE now > 0
    UNION ALL SELECT 'months', NULL, CAST(k AS STRING), count(g.event_id), NULL FROM (SELECT unnest(range(1, 13)) AS k) LEFT JOIN g ON y = 1998 AND month({_W0}) = k GROUP BY k UNION ALL SELECT 'most_seen', NULL, p, now, NULL FROM n WHERE now > 0 UNION ALL SELECT 'new_faces', NULL, p, now, NULL FROM n WHERE first = 1998
    UNION ALL SELECT 'lapsed', NULL, p, before, NULL FROM n WHERE before > 0 AND now = 0 UNION ALL (SELECT 'top_places', row_number() OVER (ORDER BY count(*) DESC, place_name), place_name, count(*), NULL FROM g WHERE y = 1998 AND place_name IS NOT NULL GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 8) UNION ALL SELECT 'biggest_event', 1, event_id, n_photos, NULL FROM b
    UNION ALL SELECT 'biggest_event_people', NULL, p, start_ts, NULL FROM (SELECT unnest(participants) AS p, start_ts FROM b) WHERE p <> 'id-0' UNION ALL SELECT 'concentration', NULL, 'people', count(*), NULL FROM d
    UNION ALL SELECT 'concentration', NULL, 'top1', coalesce(max(n), 0), coalesce(max(n) / max(t), 0) FROM r WHERE r = 1 UNION ALL SELECT 'concentration', NULL, 'top5', coalesce(sum(n), 0), coalesce(sum(n) / max(t), 0) FROM r WHERE r <= 5)
    SELECT section, CAST(place AS INT) AS place, item, display_name AS name, CAST(o.n AS BIGINT) AS n, share FROM o LEFT JOIN identities ON canonical_id = item""", "gatherings msgs thread_identity photos identities")  # fmt: skip
def _(a):
    return R.almanac(a.gatherings, a.msgs.withColumn("ts", F.col("ts") - _BACK), a.photos, a.thread_identity, a.identities, 1998, "id-0")


@query("q_a12_lapsed", "SELECT DISTINCT canonical_id FROM seen WHERE y = 1997 AND canonical_id NOT IN (SELECT canonical_id FROM seen WHERE y = 1998)", "seen")
def _(a):
    return P.lapsed(a.gatherings, 1998)


@query("q_a13_event_years", "SELECT DISTINCT y AS year FROM seen", "seen", ints="year")
def _(a):
    return P.event_years(a.gatherings)


_W = "make_timestamp(start_ts * 1000)"
_WEEK = f"year(date_trunc('week', {_W})) AS year, CAST(date_diff('day', date_trunc('week', make_date(year(date_trunc('week', {_W})), 1, 1)::TIMESTAMP)::DATE, date_trunc('week', {_W})::DATE) // 7 AS INT) AS week"


@query("q_a14_weeks", f"""WITH e AS (SELECT {_WEEK}, count(*) AS events FROM gatherings GROUP BY 1, 2), p AS (SELECT year, week, canonical_id, row_number() OVER (PARTITION BY year, week ORDER BY count(*) DESC, min(start_ts), canonical_id) AS r FROM (SELECT {_WEEK}, start_ts, canonical_id FROM seen) GROUP BY 1, 2, 3) SELECT e.*, p.canonical_id AS companion FROM e LEFT JOIN p ON p.year = e.year AND p.week = e.week AND r = 1""", "seen", ints="year")
def _(a):
    return P.weeks(a.gatherings)


@query("q_a15_braid", f"""WITH e AS (SELECT canonical_id, y AS year, count(*) FILTER (WHERE source = 'photos') AS events, count(*) FILTER (WHERE source = 'messages') AS inferred, 0 AS messages FROM seen GROUP BY 1, 2 UNION ALL SELECT canonical_id, year({_TS}), 0, 0, count(*) FROM pm WHERE canonical_id IN (SELECT canonical_id FROM seen) GROUP BY 1, 2),
    y AS (SELECT canonical_id, year, CAST(sum(events) AS BIGINT) AS events, CAST(sum(inferred) AS BIGINT) AS inferred, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(messages + 5 * events + 3 * inferred) AS BIGINT) AS strength FROM e GROUP BY 1, 2)
    SELECT * FROM y WHERE canonical_id IN (SELECT canonical_id FROM y GROUP BY 1 ORDER BY sum(strength) DESC, 1 LIMIT 10)""", "seen pm", ints="year")  # fmt: skip
def _(a):
    return P.braid(a.gatherings, a.messages, a.thread_identity)


@query("q_a16_atlas", f"""WITH g AS (SELECT year({_W}) AS year, start_ts, lat, lng, CASE WHEN lat BETWEEN -38.25 AND -37.45 AND lng BETWEEN 144.35 AND 145.45 THEN 'MEL' WHEN lat BETWEEN -34.25 AND -33.55 AND lng BETWEEN 150.75 AND 151.55 THEN 'SYD' WHEN lat BETWEEN 41.55 AND 42.25 AND lng BETWEEN -88.05 AND -87.35 THEN 'CHI' END AS frame FROM gatherings),
    t AS (SELECT year, frame, n FROM (SELECT year, frame, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, min(start_ts), frame) AS r FROM g WHERE frame IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
    SELECT g.year, coalesce(any_value(t.frame), 'MEL') AS frame, coalesce(any_value(t.n), 0) AS points, count(*) FILTER (WHERE lat IS NOT NULL AND g.frame IS NULL) AS beyond, count(*) FILTER (WHERE lat IS NULL) AS coordless FROM g LEFT JOIN t ON t.year = g.year GROUP BY g.year""", "gatherings", ints="year")  # fmt: skip
def _(a):
    return P.atlas(a.gatherings)


_H = "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295))"
_KM = "(2 * 6371 * asin(least(1.0, sqrt(power(sin(radians({0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * power(sin(radians({1} - lng) / 2), 2)))))"


@query("q_a17_field_layout", f"""WITH n AS (SELECT event_id, canonical_id, count(*) AS c FROM ep JOIN photo_faces USING (photo_id) WHERE canonical_id <> 'id-3' GROUP BY 1, 2), f AS (SELECT event_id, arg_min(canonical_id, {{'n': -c, 'i': canonical_id}}) AS face FROM n GROUP BY 1),
    g AS (SELECT g.event_id, lat, lng, coalesce(face, list_filter(participants, lambda p: p <> 'id-3')[1]) AS companion FROM gatherings g LEFT JOIN f USING (event_id)),
    r AS (SELECT event_id, companion, {_H.format("coalesce(companion, event_id)")} % 3600 / 3600 * 6.283185307179586::DOUBLE + ({_H.format("event_id || 'a'")} % 1000 / 1000 - 0.5) * 0.45::DOUBLE AS angle,
        CASE WHEN lat IS NULL THEN 0.45::DOUBLE + ({_H.format("event_id || 'r'")} % 1000 / 1000 - 0.5) * 0.18::DOUBLE ELSE least(1.0, 0.18::DOUBLE + ln(1 + least({_KM.format(-37.81, 144.96)}, {_KM.format(-33.87, 151.21)}, {_KM.format(41.88, -87.63)})) / 9.5::DOUBLE) END + ({_H.format("event_id || 'j'")} % 1000 / 1000 - 0.5) * 0.1::DOUBLE AS base FROM g)
    SELECT event_id, companion, floor(least(1.0, greatest(0.06, base)) * cos(angle) * 10000 + 0.5) / 10000 AS x, floor(least(1.0, greatest(0.06, base)) * sin(angle) * 10000 + 0.5) / 10000 AS y FROM r""", "gatherings ep photo_faces")  # fmt: skip
def _(a):
    people = a.identities.select("canonical_id", F.when(F.col("canonical_id") == "id-3", "Demo User").otherwise(F.col("display_name")).alias("display_name"))
    return P.field_layout(P.companions(a.gatherings, a.ep, a.photo_faces, people))


@query("q_a18_person_series", f"""WITH y AS (SELECT canonical_id, year, sum(e) AS events, sum(m) AS messages FROM (SELECT canonical_id, y AS year, 1 AS e, 0 AS m FROM seen UNION ALL SELECT canonical_id, year({_TS}), 0, 1 FROM pm) GROUP BY 1, 2), b AS (SELECT min(year) AS a, max(year) AS z FROM y),
    f AS (SELECT p.canonical_id, s.year, CAST(coalesce(y.events, 0) AS BIGINT) AS events, CAST(coalesce(y.messages, 0) AS BIGINT) AS messages FROM (SELECT DISTINCT canonical_id FROM y) p CROSS JOIN (SELECT unnest(range(a, z + 1)) AS year FROM b) s LEFT JOIN y ON y.canonical_id = p.canonical_id AND y.year = s.year),
    r AS (SELECT canonical_id, min(year) AS a, max(year) AS z, row_number() OVER (PARTITION BY canonical_id ORDER BY count(*) DESC, min(year)) AS k FROM (SELECT canonical_id, year, year - row_number() OVER (PARTITION BY canonical_id ORDER BY year) AS run FROM f WHERE events + messages = 0) GROUP BY canonical_id, run)
    SELECT f.canonical_id, CAST(f.year AS INT) AS year, f.events, f.messages, CAST(r.a AS INT) AS gap_from, CAST(r.z AS INT) AS gap_to FROM f LEFT JOIN r ON r.canonical_id = f.canonical_id AND r.k = 1""", "seen pm")  # fmt: skip
def _(a):
    return P.person_series(a.gatherings, a.messages, a.thread_identity)


@query("q_a19_chunks", """WITH b AS (SELECT source, ts, id, (ts - min(ts) OVER (PARTITION BY source)) // 7776000000 AS bucket FROM photos), c AS (SELECT *, count(*) OVER (PARTITION BY source, bucket) AS n, row_number() OVER (PARTITION BY source, bucket ORDER BY ts, id) - 1 AS i FROM b),
    s AS (SELECT source, bucket, i // CAST(ceil(n / ceil(n / 60)) AS BIGINT) AS part, count(*) AS k, min(ts) AS a, max(ts) AS z FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, part) AS q FROM s), t AS (SELECT *, sum(CASE WHEN k >= 5 OR q = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY bucket, part) AS chunk FROM r)
    SELECT source, CAST(chunk AS BIGINT) AS chunk, CAST(sum(k) AS BIGINT) AS n, min(a) AS first_ts, max(z) AS last_ts FROM t GROUP BY ALL""", "photos")  # fmt: skip
def _(a):
    return P.chunks(a.photos, "source", most=60)


@query("q_a20_quotes_in_documents", r"SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '[ \t\n\x0B\f\r]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[ \t\n\x0B\f\r]+', ' ', 'g')))")
def _(a):
    from ..operators.quotes import verify

    return verify(a.table("benchmark"), a.table("documents"))


_NORMAL = r"trim(lower(regexp_replace(translate(trim(coalesce({}, ''), ' '), '‘’“”–— ', '''''""-- '), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')"
#: Portraits of each turn: a block quote of its first line by a guessed speaker, a cut one, and a prose quote of the last line.
_PORTRAIT = "'# Turn ' || {turn} || chr(10) || '> ' || {who} || ': ' || {first} || chr(10) || '> Them: ' || substr({first}, 2) || chr(10) || 'They said \"' || {last} || '\" that day'"
_PARTS = {"who": "CASE WHEN {turn} % 3 = 0 THEN 'Me' ELSE 'they' END", "first": "split_part(body, chr(10), 1)", "last": "substr({first}, 1, 60)"}


def _portrait(turn: str) -> str:
    first = _PARTS["first"]
    return _PORTRAIT.format(turn=f"CAST({turn} AS STRING)", who=_PARTS["who"].format(turn=turn), first=first, last=_PARTS["last"].format(first=first))


@query("q_a20_portrait_quotes", rf"""WITH p AS (SELECT thread_id || '/' || CAST(turn AS STRING) AS doc, {_portrait('turn')} AS text FROM chat), l AS (SELECT doc, CAST(generate_subscripts(x, 1) - 1 AS INT) AS line, unnest(x) AS t FROM (SELECT doc, string_split(text, chr(10)) AS x FROM p)), b AS (SELECT doc, line, t, lower(regexp_extract(t, '^>\s*([Tt]hem|[Yy]ou|[Tt]hey|[Mm]e)\s*:\s*(.*)$', 1)) AS w FROM l),
    q AS (SELECT doc, line, 'blockquote' AS kind, CASE WHEN w IN ('me', 'you') THEN 'You' ELSE 'Them' END AS speaker, trim(regexp_extract(t, '^>\s*([Tt]hem|[Yy]ou|[Tt]hey|[Mm]e)\s*:\s*(.*)$', 2)) AS body FROM b WHERE w <> '' UNION ALL SELECT doc, line, 'prose', NULL, trim(unnest(regexp_extract_all(t, '["“”]([^"“”]{{8,300}})["“”]', 1))) FROM b WHERE w = ''),
    m AS (SELECT DISTINCT from_me, {_NORMAL.format('body')} AS k FROM chat) SELECT doc, line, kind, speaker, body FROM q WHERE {_NORMAL.format('body')} <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.k = {_NORMAL.format('q.body')} AND (speaker IS NULL OR from_me = (speaker = 'You')))""", "chat")  # fmt: skip
def _(a):
    from ..operators.quotes import unverified

    return unverified(a.chat.selectExpr("thread_id || '/' || CAST(turn AS STRING) AS doc", f"{_portrait('turn')} AS text"), a.chat)


#: Portraits by file name: of each who wrote of a birthday, with moments in a section, elsewhere or nowhere. {iso} and {said} are formats of a moment.
_CARDS = """SELECT regexp_replace(sender_name, '[^A-Za-z0-9_-]+', '_'{all}) AS name, '# ' || sender_name || chr(10) || chr(10) || '*kept ' || CAST(count(*) AS STRING) || ' cards *' || chr(10) || CASE count(*) % 3
    WHEN 0 THEN '**2020-01-01 — Elsewhere.** more' WHEN 1 THEN 'nothing is dated' ELSE chr(10) || '## Anchor Moments' || chr(10) || chr(10) || '**' || {iso_a} || ' — First card.** and **' || {iso_b} || '** – Last card.** so' || chr(10)
    || '### The trip (' || {said_a} || ' → later)' || chr(10) || '### the Trip (' || {said_a} || ')' || chr(10) || '**' || {iso_a} || ' - FIRST card**' || chr(10) || '## Later' || chr(10) || '**2020-01-01 — Elsewhere.**' END AS text
    FROM {messages} WHERE contains(body, 'birthday') GROUP BY sender_name"""


def _cards(messages: str, every: str, iso: str, said: str) -> str:
    return _CARDS.format(all=every, messages=messages, **{f"{kind}_{k}": f.format(t) for kind, f in (("iso", iso), ("said", said)) for k, t in (("a", "min(ts)"), ("b", "max(ts)"))})


_BIRTHDAYS = "SELECT canonical_id, CAST(n % 12 AS INT) + 1 AS month, CAST(n % 28 AS INT) + 1 AS day, CASE WHEN n % 2 = 0 THEN CAST(1980 + n % 30 AS INT) END AS year, 'vcard' AS source FROM {0} UNION ALL SELECT canonical_id, 2, CAST(n % 28 AS INT) + 1, NULL, 'ics' FROM {0} WHERE n % 5 = 0"
_TODAY = 1_706_950_000_000  # 2024-02-03, 8:46
_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%d')"
#: The people of most messages, with portraits' moments (kept once), as SQL twins of both queries have them.
_CLOSEST = rf"""cards AS ({_cards('messages', ", 'g'", _ISO, "strftime(make_timestamp({} * 1000), '%b %-d %Y')")}), born AS ({_BIRTHDAYS.format('identities')}),
    c AS (SELECT * FROM (SELECT canonical_id, count(*) AS msg_count, min(ts) AS a, max(ts) AS b, arg_max(from_me, {{'t': ts, 'i': id}}) AS mine, arg_max(body, {{'t': ts, 'i': id}}) AS body FROM messages JOIN thread_identity USING (thread_id) JOIN threads t USING (thread_id) WHERE NOT is_group AND body <> '' GROUP BY 1 HAVING count(*) > 20)
        JOIN (SELECT canonical_id, display_name FROM identities) USING (canonical_id) ORDER BY msg_count DESC, canonical_id LIMIT 30),
    pic AS (SELECT canonical_id, text, CASE WHEN regexp_matches(text, '(?i)##\s+Anchor moments?\s*\n') THEN regexp_split_to_array(regexp_extract(text, '(?is)##\s+Anchor moments?\s*\n(.*)', 1), '\n##\s+')[1] ELSE text END AS body FROM c JOIN cards ON name = regexp_replace(display_name, '[^A-Za-z0-9_-]+', '_', 'g')),
    found AS (SELECT canonical_id, 0 AS k, generate_subscripts(regexp_extract_all(body, '{relations.BOLD}', 1), 1) AS i, unnest(regexp_extract_all(body, '{relations.BOLD}', 1)) AS date, trim(unnest(regexp_extract_all(body, '{relations.BOLD}', 2))) AS summary FROM pic
        UNION ALL SELECT canonical_id, 1, generate_subscripts(regexp_extract_all(body, '{relations.TITLED}', 1), 1), strftime(strptime(unnest(regexp_extract_all(body, '{relations.TITLED}', 2)) || ' ' || unnest(regexp_extract_all(body, '{relations.TITLED}', 3)) || ' ' || unnest(regexp_extract_all(body, '{relations.TITLED}', 4)), '%b %d %Y'), '%Y-%m-%d'), trim(unnest(regexp_extract_all(body, '{relations.TITLED}', 1))) FROM pic),
    moment AS (SELECT canonical_id, date, arg_min(summary, k * 1000 + i) AS summary, min(k * 1000 + i) AS place FROM found GROUP BY canonical_id, date, lower(summary))"""


def _closest(a):
    cards = a.spark.sql(_cards("{messages}", "", "date_format(timestamp_millis({}), 'yyyy-MM-dd')", "date_format(timestamp_millis({}), 'MMM d yyyy')"), messages=a.messages)
    return relations.closest(a.messages, a.thread_identity, a.threads, a.identities, least=20), cards, a.spark.sql(_BIRTHDAYS.format("{identities}"), identities=a.identities), _TODAY


@query("q_a21_timeline", f"""WITH {_CLOSEST} SELECT {_ISO.format('a')} AS date, canonical_id, display_name AS person, 'first_contact' AS kind, 'first message — ' || display_name AS summary, 'messages' AS source FROM c
    UNION ALL SELECT {_ISO.format('b')}, canonical_id, display_name, 'last_contact', 'last message (so far) — ' || display_name, 'messages' FROM c WHERE a // {DAY} <> b // {DAY}
    UNION ALL SELECT date, canonical_id, display_name, 'anchor', summary, 'portrait' FROM moment JOIN c USING (canonical_id)
    UNION ALL SELECT '2024-' || lpad(CAST(month AS STRING), 2, '0') || '-' || lpad(CAST(day AS STRING), 2, '0'), canonical_id, display_name, 'birthday', display_name || chr(39) || 's birthday' || coalesce(' (turns ' || CAST(2024 - year AS STRING) || ')', ''), 'birthday:' || source FROM born JOIN c USING (canonical_id)""", "messages thread_identity threads identities")  # fmt: skip
def _(a):
    return relations.timeline(*_closest(a))


@query("q_a22_check_ins", f"""WITH {_CLOSEST}, d AS (SELECT c.*, {_TODAY} // {DAY} - b // {DAY} AS ds, greatest(0.1e0, (b // {DAY} - a // {DAY}) / 365e0) AS years, pic.text IS NOT NULL AS pictured, coalesce(m.about, trim(regexp_extract(pic.text, '(?m)^# [^\\n]+\\n\\n\\*([^*\\n]+)\\*', 1))) AS about, x.month, x.day
        FROM c LEFT JOIN pic USING (canonical_id) LEFT JOIN (SELECT canonical_id, arg_max(date || ': ' || summary, {{'d': date, 'p': place}}) AS about FROM moment GROUP BY 1) m USING (canonical_id) LEFT JOIN (SELECT canonical_id, arg_min(month, {{'s': source, 'm': month}}) AS month, arg_min(day, {{'s': source, 'm': month}}) AS day FROM born GROUP BY 1) x USING (canonical_id)),
    n AS (SELECT *, CAST(floor((epoch_ms(CASE WHEN epoch_ms(make_timestamp(2024, month, day, 0, 0, 0)) < {_TODAY} THEN make_timestamp(2025, month, 1, 0, 0, 0) + to_days(day - 1) ELSE make_timestamp(2024, month, day, 0, 0, 0) END) - {_TODAY}) / {DAY} + 0.5) AS BIGINT) AS soon FROM d),
    s AS (SELECT *, CAST(floor(CASE WHEN ds <= 7 THEN 0 WHEN ds <= 30 THEN (ds - 7) * 1.5e0 WHEN ds <= 180 THEN 30 + (ds - 30) * 0.7e0 WHEN ds <= 730 THEN 100 - (ds - 180) * 0.05e0 ELSE 70 - least(ds - 730, 1000) * 0.05e0 END + CASE WHEN mine THEN 0 ELSE 25 END + CASE WHEN soon <= 14 THEN 60 WHEN soon <= 30 THEN 30 ELSE 0 END + 0.5) AS BIGINT) AS attention FROM n)
    SELECT CAST(row_number() OVER (ORDER BY pictured DESC, attention DESC, msg_count DESC, canonical_id) AS INT) AS place, canonical_id, display_name, msg_count, CAST(ds AS INT) AS days_since, CASE WHEN mine THEN 'me' ELSE 'them' END AS last_from, trim(regexp_replace(substr(body, 1, 200), '\\s+', ' ', 'g')) AS excerpt, soon AS days_until_birthday, pictured AS has_portrait, about AS about_what,
    {_ROUND.format('log10(msg_count) * 20 * sqrt(years) * CASE WHEN ds = 0 THEN 0.4e0 WHEN ds <= 60 THEN 1e0 WHEN ds <= 365 THEN 0.7e0 WHEN ds <= 1095 THEN 0.4e0 ELSE 0.15e0 END * CASE WHEN pictured THEN 1.15e0 ELSE 1e0 END', 10, '10e0')} AS intimacy, {_ROUND.format('years', 10, '10e0')} AS years_active, attention FROM s""", "messages thread_identity threads identities")  # fmt: skip
def _(a):
    return relations.check_ins(*_closest(a))


@query("q_a23_birthday_inference", r"""WITH g AS (SELECT canonical_id, month(make_timestamp(ts * 1000)) AS month, day(make_timestamp(ts * 1000)) AS day, year(make_timestamp(ts * 1000)) AS y FROM pm WHERE from_me AND regexp_matches(lower(body), 'happy birthday|(^|[^a-z0-9_])hbd([^a-z0-9_]|$)|happy b''?day')),
    n AS (SELECT canonical_id, month, day, count(DISTINCT y) AS years, count(*) AS greetings FROM g GROUP BY 1, 2, 3), r AS (SELECT *, count(*) OVER (PARTITION BY canonical_id) AS days, row_number() OVER (PARTITION BY canonical_id ORDER BY years DESC, greetings DESC, month, day) AS k FROM n)
    SELECT canonical_id, CAST(month AS INT) AS month, CAST(day AS INT) AS day, years, greetings, CASE WHEN years >= 2 THEN 'HIGH' WHEN days = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r WHERE k = 1 AND canonical_id <> 'id-1'""", "pm")  # fmt: skip
def _(a):
    return P.birthday_inference(a.pm, a.spark.createDataFrame([("id-1",)], "canonical_id string"))


@query("q_a24_email_summary", """WITH o AS (SELECT 'totals' AS section, NULL::INT AS place, 'correspondents' AS item, count(*) AS n FROM emails UNION ALL SELECT 'totals', NULL, 'messages', sum(n_messages) FROM emails UNION ALL SELECT 'by_category', NULL, coalesce(category, 'uncategorized'), sum(n_messages) FROM emails GROUP BY 3
    UNION ALL (SELECT 'top_domains', row_number() OVER (ORDER BY sum(n_messages) DESC, domain), domain, sum(n_messages) FROM emails WHERE domain IS NOT NULL GROUP BY domain ORDER BY 2 LIMIT 50) UNION ALL (SELECT 'top_correspondents', row_number() OVER (ORDER BY n_messages DESC, addr), addr, n_messages FROM emails ORDER BY 2 LIMIT 50))
    SELECT section, CAST(place AS INT) AS place, item, CAST(o.n AS BIGINT) AS n, e.display_name, e.list_unsubscribe FROM o LEFT JOIN emails e ON section = 'top_correspondents' AND addr = item""", "emails")  # fmt: skip
def _(a):
    return R.email_summary(a.emails)


_STOPS = ", ".join(f"'{w}'" for w in P.STOP)


@query("q_a25_topics", f"""WITH w AS (SELECT p_partkey, p_name, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z][a-z''-]{{2,}}'))) AS topic FROM part WHERE p_size % 4 NOT IN (1, 2)), n AS (SELECT topic, count(*) AS n FROM w WHERE topic NOT IN ({_STOPS}) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 50),
    s AS (SELECT topic, p_name, row_number() OVER (PARTITION BY topic ORDER BY min(p_partkey)) AS r FROM w GROUP BY 1, 2) SELECT n.topic, n.n, string_agg(p_name, '|' ORDER BY r) AS samples FROM n JOIN s USING (topic) WHERE r <= 3 GROUP BY 1, 2""")  # fmt: skip
def _(a):
    answer = F.element_at(F.array(F.lit("joined"), F.lit("declined"), F.lit("invited"), F.lit(None)), F.col("p_size") % 4 + 1)
    return P.topics(a.table("part").withColumn("response", answer), "p_name", "p_partkey", "p_type", "response")


@query("q_a26_a27_facet_topics", """WITH f AS (SELECT * FROM (SELECT 'brand' AS facet, p_brand AS topic, count(*) AS n FROM part GROUP BY 2 HAVING count(*) >= 5 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'type' AS facet, p_type AS topic, count(*) AS n FROM part GROUP BY 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 2 LIMIT 5))
    SELECT *, n / sum(n) OVER (PARTITION BY facet) AS weight FROM f""")  # fmt: skip
def _(a):
    p = a.table("part")
    return P.facet_topics([("brand", p, "p_brand", 5, 10), ("type", p, "p_type", 3, 5)])


@query("q_a27_video_summary", """WITH t AS (SELECT unnest(['topic', 'artist', 'channel']) AS kind, unnest([p_type, p_brand, 'size ' || p_size]) AS topic FROM part), n AS (SELECT CASE kind WHEN 'topic' THEN 'top_topics' WHEN 'channel' THEN 'top_channels' ELSE 'top_artists' END AS section, topic AS item, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, item) AS place FROM n)
    SELECT section, CAST(place AS INT) AS place, item, n FROM r WHERE place <= CASE section WHEN 'top_topics' THEN 25 ELSE 15 END UNION ALL SELECT 'counts', NULL, 'videos', count(*) FROM part UNION ALL SELECT 'counts', NULL, 'songs_among_videos', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
    UNION ALL SELECT 'counts', NULL, 'songs', count(*) FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'counts', NULL, 'watch_entries', count(*) FROM lineitem UNION ALL SELECT 'counts', NULL, 'playlists', count(*) FROM orders""")  # fmt: skip
def _(a):
    kinds = F.explode(F.create_map(F.lit("topic"), F.col("p_type"), F.lit("artist"), F.col("p_brand"), F.lit("channel"), F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("kind", "topic")
    part, lines = a.table("part"), a.table("lineitem")
    topics = part.select(kinds).groupBy("kind", "topic").agg(F.count("*").alias("n"))
    return P.video_summary(part.selectExpr("p_partkey AS video_id"), lines.where("l_quantity > 45").selectExpr("l_partkey AS video_id"), topics, watch_entries=lines, playlists=a.table("orders"))


@query("q_a28_milestones", f"""WITH alone AS (SELECT thread_id, canonical_id FROM threads JOIN thread_identity USING (thread_id) WHERE NOT is_group AND canonical_id <> 'id-0'), m AS (SELECT year({_TS}) AS year, canonical_id AS c FROM msgs LEFT JOIN alone USING (thread_id) WHERE meaningful), p AS (SELECT year({_TS}) AS year, id, source FROM photos),
    f AS (SELECT year, canonical_id AS c, count(*) AS n FROM p JOIN photo_faces ON photo_id = id WHERE canonical_id <> 'id-0' GROUP BY 1, 2), w AS (SELECT year, c, count(*) AS n FROM m WHERE c IS NOT NULL GROUP BY 1, 2), e AS (SELECT *, year({_W0}) AS year FROM gatherings), y AS (SELECT year FROM m UNION SELECT year FROM p UNION SELECT year FROM e),
    l AS (SELECT year, string_agg(place_name, '; ' ORDER BY r) AS latest FROM (SELECT year, place_name, row_number() OVER (PARTITION BY year ORDER BY start_ts DESC, event_id) AS r FROM e) WHERE r <= 10 GROUP BY 1),
    tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, c) AS r FROM w) WHERE r = 1), tf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, c) AS r FROM f) WHERE r = 1)
    SELECT CAST(y.year AS INT) AS year, (SELECT count(*) FROM m WHERE m.year = y.year) AS messages, tw.c AS top_person, tw.n AS top_n, (SELECT count(*) FROM p WHERE p.year = y.year AND p.source = '1-urgent') AS photos, tf.c AS most_photographed, tf.n AS photographed_n, (SELECT count(*) FROM e WHERE e.year = y.year) AS events, coalesce(latest, '') AS latest
    FROM y LEFT JOIN tw ON tw.year = y.year LEFT JOIN tf ON tf.year = y.year LEFT JOIN l ON l.year = y.year WHERE y.year BETWEEN 1990 AND 2035""", "threads msgs thread_identity photos photo_faces gatherings")  # fmt: skip
def _(a):
    return R.milestones(a.msgs, a.threads, a.thread_identity, a.photos, a.photo_faces, a.gatherings, "id-0", "1-urgent", years=(1990, 2035))


_BORN = "SELECT canonical_id, CAST(n % 12 + 1 AS INT) AS month, CAST(n % 28 + 1 AS INT) AS day FROM {identities}"


@query("q_a29_person_360", f"""WITH mp AS (SELECT * FROM pm WHERE canonical_id = 'id-4' AND meaningful), c AS (SELECT * FROM calls WHERE '+' || regexp_replace(address, '[^0-9]', '', 'g') IN (SELECT unnest(aliases) FROM identities WHERE canonical_id = 'id-4')), f AS (SELECT photo_id FROM photo_faces WHERE canonical_id = 'id-4'), g AS (SELECT *, list_contains(participants, 'id-4') AS there FROM gatherings),
    o AS (SELECT 'stat' AS facet, NULL::INT AS place, 'messages' AS item, count(*) AS n FROM mp HAVING count(*) > 0 UNION ALL SELECT 'stat', NULL, 'first_ts', min(ts) FROM mp HAVING count(*) > 0 UNION ALL SELECT 'stat', NULL, 'last_ts', max(ts) FROM mp HAVING count(*) > 0 UNION ALL SELECT 'by_source', NULL, source, count(*) FROM mp GROUP BY 3
    UNION ALL SELECT x, NULL, CAST(year({_TS}) AS STRING), count(*) FROM mp, (SELECT unnest(['by_year', 'series_messages']) AS x) GROUP BY 1, 3 UNION ALL SELECT 'birthday', NULL, printf('%02d-%02d', month, day), 1 FROM ({_BORN.format(identities='identities')}) WHERE canonical_id = 'id-4' UNION ALL SELECT 'mentions', NULL, 'messages', count(*) FROM mention WHERE mentioned_canonical_id = 'id-4' HAVING count(*) > 0
    UNION ALL SELECT 'calls', NULL, 'calls', count(*) FROM c HAVING count(*) > 0 UNION ALL SELECT 'calls', NULL, 'seconds', sum(trunc(duration_s)) FROM c HAVING count(*) > 0 UNION ALL SELECT 'calls', NULL, 'missed', count(*) FROM c WHERE NOT answered HAVING count(*) > 0 UNION ALL SELECT 'calls', NULL, 'last_ts', max(ts) FROM c HAVING count(*) > 0
    UNION ALL (SELECT 'photos', row_number() OVER (ORDER BY ts DESC, asset_path), asset_path, ts FROM photos JOIN f ON photo_id = id ORDER BY 2 LIMIT 24) UNION ALL (SELECT 'co_present', row_number() OVER (ORDER BY count(*) DESC, canonical_id), canonical_id, count(*) FROM photo_faces JOIN f USING (photo_id) WHERE canonical_id NOT IN ('id-4', 'id-0') GROUP BY canonical_id ORDER BY 2 LIMIT 12)
    UNION ALL (SELECT 'events', row_number() OVER (ORDER BY start_ts DESC, event_id), event_id, start_ts FROM g WHERE event_id IN (SELECT event_id FROM ep JOIN f USING (photo_id)) ORDER BY 2 LIMIT 40) UNION ALL (SELECT 'meetups', row_number() OVER (ORDER BY start_ts DESC, event_id), event_id, start_ts FROM g WHERE there AND source = 'messages' ORDER BY 2 LIMIT 40)
    UNION ALL SELECT 'series_events', NULL, CAST(year({_W0}) AS STRING), count(*) FROM g WHERE there GROUP BY 3 UNION ALL (SELECT 'partners', row_number() OVER (ORDER BY count(*) DESC, p), p, count(*) FROM (SELECT unnest(participants) AS p FROM g WHERE there) WHERE p NOT IN ('id-4', 'id-0') GROUP BY p ORDER BY 2 LIMIT 12))
    SELECT facet, CAST(place AS INT) AS place, item, CAST(n AS BIGINT) AS n FROM o""", "pm calls identities photo_faces gatherings mention photos ep")  # fmt: skip
def _(a):
    tables = {n: getattr(a, n) for n in ("pm", "photos", "photo_faces", "gatherings")} | {"mentions": a.mention, "event_photos": a.ep, "birthdays": a.spark.sql(_BORN, identities=a.identities)}
    tables["calls"] = by_address(a.calls.withColumn("duration_s", F.floor("duration_s")), "address", a.identities, "n")
    return R.person_360("id-4", tables, "id-0")


@query("q_a30_on_this_day", f"""WITH alone AS (SELECT thread_id, canonical_id FROM threads JOIN thread_identity USING (thread_id) WHERE NOT is_group), m AS (SELECT year({_TS}) AS year, canonical_id AS c FROM msgs LEFT JOIN alone USING (thread_id) WHERE meaningful AND month({_TS}) = 1 AND day({_TS}) = 12), w AS (SELECT year, c, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, c) AS r FROM m WHERE c IS NOT NULL GROUP BY 1, 2)
    SELECT 'photos' AS section, CAST(year({_TS}) AS INT) AS year, asset_path AS item, NULL::BIGINT AS n FROM (SELECT * FROM photos WHERE source = '1-urgent' AND month({_TS}) = 1 AND day({_TS}) = 12 ORDER BY ts DESC, id LIMIT 60) UNION ALL SELECT 'events', CAST(year({_W0}) AS INT), place_name, n_photos FROM gatherings WHERE month({_W0}) = 1 AND day({_W0}) = 12
    UNION ALL SELECT 'people', CAST(year AS INT), c, (SELECT count(*) FROM m WHERE m.year = w.year) FROM w WHERE r = 1""", "threads msgs thread_identity photos gatherings")  # fmt: skip
def _(a):
    return R.on_this_day(a.msgs, a.threads, a.thread_identity, a.photos, a.gatherings, 1, 12, "1-urgent")


_KIND = "CASE WHEN list_unsubscribe THEN 'bulk' WHEN n % 4 = 0 THEN 'automated' ELSE 'person' END"


@query("q_a32_interests", f"""WITH v AS (SELECT unnest(['topic', 'artist', 'channel']) AS kind, unnest([p_type, p_brand, 'size ' || p_size]) AS topic FROM part), o AS (SELECT 'video_' || kind AS section, topic AS item, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT 'events', place_name, count(*) FROM gatherings GROUP BY 2
    UNION ALL SELECT 'mailing_lists', display_name, sum(n_messages) FROM emails WHERE {_KIND} <> 'person' AND display_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'mail_categories', category, count(*) FROM emails WHERE category IS NOT NULL GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, item) AS place FROM o)
    SELECT section, CASE WHEN section <> 'mail_categories' THEN CAST(place AS INT) END AS place, item, CAST(n AS BIGINT) AS n FROM r WHERE place <= CASE section WHEN 'video_artist' THEN 20 WHEN 'video_channel' THEN 20 WHEN 'mail_categories' THEN 1000000000 ELSE 30 END""", "gatherings emails")  # fmt: skip
def _(a):
    kinds = F.explode(F.create_map(F.lit("topic"), F.col("p_type"), F.lit("artist"), F.col("p_brand"), F.lit("channel"), F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("kind", "topic")
    videos = a.table("part").select(kinds).groupBy("kind", "topic").agg(F.count("*").alias("n"))
    events = a.gatherings.groupBy(F.col("place_name").alias("topic")).agg(F.count("*").alias("n"))
    return R.interests(videos, events, a.emails.withColumn("kind", F.expr(_KIND)))


@query("q_a33_life_map", "SELECT city, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS photos FROM places WHERE city IS NOT NULL GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 400", "places")
def _(a):
    return P.life_map(a.places).select("city", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "photos")


@query("q_a34_reconnect", f"SELECT canonical_id, count(*) AS n, max(ts) AS last_ts, count(*) FILTER (WHERE ts > {LATER - 365 * DAY}) AS last_year FROM pm WHERE meaningful GROUP BY 1 HAVING count(*) >= 20 AND max(ts) <= {LATER - 60 * DAY} ORDER BY 2 DESC, 1 LIMIT 80", "pm")
def _(a):
    return P.reconnect(a.pm, LATER, least=20)


@query("q_a35_closeness", """SELECT i.canonical_id, round(ln(1 + coalesce(m.n, 0)) + 2.5 * ln(1 + coalesce(c.n, 0)) + 2 * ln(1 + coalesce(f.n, 0)) + 2.5 * ln(1 + coalesce(e.n, 0)) + 1.5 * ln(1 + coalesce(u.n, 0)), 6) AS closeness FROM identities i LEFT JOIN (SELECT canonical_id, count(*) AS n FROM pm WHERE meaningful GROUP BY 1) m USING (canonical_id)
    LEFT JOIN (SELECT 'id-' || CAST(o.x AS STRING) AS canonical_id, sum(duration_s) / 60 AS n FROM (SELECT CAST(substr(call_id, 2) AS BIGINT) % 40 AS x, duration_s FROM calls) o GROUP BY 1) c USING (canonical_id) LEFT JOIN (SELECT canonical_id, count(*) AS n FROM photo_faces GROUP BY 1) f USING (canonical_id)
    LEFT JOIN (SELECT canonical_id, count(DISTINCT event_id) AS n FROM ep JOIN photo_faces USING (photo_id) GROUP BY 1) e USING (canonical_id) LEFT JOIN (SELECT canonical_id, count(DISTINCT event_id) AS n FROM seen WHERE source = 'messages' GROUP BY 1) u USING (canonical_id) WHERE i.canonical_id <> 'id-3' ORDER BY 2 DESC, 1 LIMIT 80""", "identities pm calls photo_faces seen ep")  # fmt: skip
def _(a):
    calls = a.calls.selectExpr("'id-' || (CAST(substr(call_id, 2) AS BIGINT) % 40) AS canonical_id", "duration_s")
    people = a.identities.withColumn("display_name", F.when(F.col("canonical_id") == "id-3", "Demo User").otherwise(F.col("display_name")))
    return P.closeness(people, a.pm, calls, a.photo_faces, a.ep, a.gatherings)


@query("q_a36_freshness", f"""SELECT source, max(ts) AS newest, CASE source WHEN 'imessage' THEN 7 WHEN 'whatsapp' THEN 14 WHEN 'gmail' THEN 60 WHEN 'instagram' THEN 60 WHEN 'messenger' THEN 90 ELSE 30 END AS threshold, ({NOW} - max(ts)) / {DAY} > CASE source WHEN 'imessage' THEN 7 WHEN 'whatsapp' THEN 14 WHEN 'gmail' THEN 60 WHEN 'instagram' THEN 60 WHEN 'messenger' THEN 90 ELSE 30 END AS stale FROM messages GROUP BY 1""", "messages")
def _(a):
    return P.freshness(a.messages, NOW)


@query("q_a37_cutoff", f"WITH c AS (SELECT source, max(ts) - {2 * DAY} AS cutoff FROM messages GROUP BY 1) SELECT source, cutoff, CASE WHEN ceil(({NOW} - cutoff) / {DAY}) <= 7 THEN '7d' WHEN ceil(({NOW} - cutoff) / {DAY}) <= 28 THEN '28d' WHEN ceil(({NOW} - cutoff) / {DAY}) <= 88 THEN '88d' WHEN ceil(({NOW} - cutoff) / {DAY}) <= 180 THEN '180d' WHEN ceil(({NOW} - cutoff) / {DAY}) <= 364 THEN '364d' WHEN ceil(({NOW} - cutoff) / {DAY}) <= 1094 THEN '1094d' ELSE 'all' END AS preset FROM c", "messages")
def _(a):
    return P.cutoff(a.messages, NOW)


@query("q_a38_self_bundle", "WITH n AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CAST(p_partkey % 4 + 1 AS INT) AS lens FROM part), w AS (SELECT *, CAST(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * lens AS INT) AS weight FROM n) SELECT id, confidence, lens, weight FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, id) AS r, count(*) OVER () AS n FROM w) WHERE r - 1 = 17 % n OR r <= 3")
def _(a):
    from ..operators.quotes import self_bundle

    return self_bundle(a.table("part").selectExpr("p_partkey AS id", "CASE p_size % 3 WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence", "CAST(p_partkey % 4 + 1 AS INT) AS lens"), 17)


@query("q_a40_name_dictionary", "SELECT display_name AS name, canonical_id FROM identities UNION ALL SELECT split_part(display_name, ' ', 1), min(canonical_id) FROM identities WHERE len(split_part(display_name, ' ', 1)) >= 4 GROUP BY 1", "identities")
def _(a):
    first = F.substring_index("display_name", " ", 1)
    short = a.identities.where(F.length(first) >= 4).groupBy(first.alias("name")).agg(F.min("canonical_id").alias("canonical_id"))
    return a.identities.select(F.col("display_name").alias("name"), "canonical_id").unionByName(short)


@query("q_a41_by_response", "SELECT o_orderstatus AS response, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2", ints="year")
def _(a):
    return a.table("orders").groupBy(F.col("o_orderstatus").alias("response"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("q_a42_row_order", "WITH m AS (SELECT canonical_id, strftime(make_timestamp(ts * 1000), '%Y-%m') AS mo, count(*) AS n FROM pm GROUP BY 1, 2), t AS (SELECT canonical_id, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY 1), h AS (SELECT t.*, display_name IN (SELECT name FROM portraits) AS has_portrait FROM t JOIN (SELECT canonical_id, display_name FROM identities) USING (canonical_id)) SELECT h.canonical_id, h.total, has_portrait, round(sqrt(h.total), 6) AS thickness, (SELECT mo FROM m WHERE m.canonical_id = h.canonical_id ORDER BY n DESC, mo LIMIT 1) AS peak FROM h ORDER BY has_portrait DESC, total DESC, 1 LIMIT 30", "pm portraits identities")
def _(a):
    m = a.pm.groupBy("canonical_id", F.date_format(F.timestamp_millis("ts"), "yyyy-MM").alias("mo")).agg(F.count("*").alias("n"))
    t = m.groupBy("canonical_id").agg(F.sum("n").alias("total"), F.min_by("mo", F.struct(-F.col("n"), "mo")).alias("peak"))
    pictured = a.identities.join(a.portraits.withColumnRenamed("name", "display_name"), "display_name", "left_semi").select("canonical_id", F.lit(True).alias("_p"))
    t = t.join(a.identities.select("canonical_id"), "canonical_id").join(pictured, "canonical_id", "left").withColumn("has_portrait", F.coalesce("_p", F.lit(False)))
    return t.orderBy(F.col("has_portrait").desc(), F.col("total").desc(), "canonical_id").limit(30).select("canonical_id", "total", "has_portrait", F.round(F.sqrt("total"), 6).alias("thickness"), "peak")


@query("q_a44_event_stream", f"""WITH t AS (SELECT DISTINCT event_id, start_ts, end_ts, thread_id FROM (SELECT event_id, start_ts, end_ts, unnest(participants) AS canonical_id FROM gatherings) JOIN thread_identity USING (canonical_id)), x AS (SELECT id, ts - {_BACK} AS ts, thread_id FROM msgs WHERE meaningful),
    m AS (SELECT * FROM (SELECT event_id, x.id, x.ts, row_number() OVER (PARTITION BY event_id ORDER BY x.ts, x.id) AS r FROM t JOIN x ON x.thread_id = t.thread_id AND x.ts BETWEEN start_ts - 43200000 AND end_ts + 43200000) WHERE r <= 200), n AS (SELECT event_id, string_agg(coalesce(display_name, p), ', ' ORDER BY coalesce(display_name, p)) AS people FROM (SELECT event_id, unnest(participants) AS p FROM gatherings) LEFT JOIN identities ON canonical_id = p GROUP BY 1),
    s AS (SELECT event_id, 'photo' AS kind, p.id, p.ts FROM photos p JOIN ep ON ep.photo_id = p.id UNION ALL SELECT event_id, 'message', id, ts FROM m) SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY ts, kind, id) AS INT) AS place, kind, id, ts, people FROM s LEFT JOIN n USING (event_id)""", "photos ep msgs gatherings thread_identity identities")  # fmt: skip
def _(a):
    from ..operators.happenings import event_messages, event_stream

    messages = a.msgs.withColumn("ts", F.col("ts") - _BACK)
    # events are made of orders and lineitems once, not for their photos, messages and names each
    g = Scratch(a.spark).cut(a.gatherings.select("event_id", "start_ts", "end_ts", "participants"))
    photos = g.selectExpr("event_id", "'p' || substr(event_id, 2) AS photo_id")
    return event_stream(photos, a.photos, event_messages(g, messages, a.thread_identity), g, a.identities)


@query("q_a45_headings", rf"""WITH r AS (SELECT doc_id AS doc, CAST(generate_subscripts(x, 1) - 1 AS INT) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)), m AS (SELECT doc, line, CASE WHEN line % 3 = 0 THEN substr('###', 1, line % 9 // 3 + 1) || ' ' || substr(t, 1, 12) ELSE t END AS t FROM r),
    l AS (SELECT *, len(regexp_extract(t, '^(#+)\s', 1)) AS level FROM m), s AS (SELECT *, sum(CASE WHEN level IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS section FROM l), g AS (SELECT doc, section, max(CASE WHEN level IN (1, 2) THEN regexp_extract(t, '^#+\s+(.*)$', 1) END) AS heading, arg_min(trim(t, ' '), line) FILTER (WHERE level = 0 AND trim(t, ' ') <> '') AS excerpt FROM s WHERE section > 0 GROUP BY 1, 2),
    k AS (SELECT *, regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g') AS slug FROM g) SELECT doc, CAST(section AS BIGINT) AS section, heading, CASE WHEN row_number() OVER w > 1 THEN slug || '-' || CAST(row_number() OVER w AS STRING) ELSE slug END AS slug, excerpt FROM k WINDOW w AS (PARTITION BY doc, slug ORDER BY section)""")  # fmt: skip
def _(a):
    from ..operators.quotes import headings

    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.when(i % 3 == 0, F.concat(F.substring(F.lit("###"), F.lit(1), (i % 9 / 3).cast("int") + 1), F.lit(" "), F.substring(t, 1, 12))).otherwise(t))
    return headings(a.table("documents").select(F.col("doc_id").alias("doc"), F.array_join(marked, "\n").alias("text")))


@query("q_a45_document_lines", r"WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(min(CASE WHEN trim(t) <> '' THEN line END) AS INT) AS first_line FROM l GROUP BY 1")
def _(a):
    lines = a.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min(F.when(F.trim("t") != "", F.col("line"))).alias("first_line"))


_MS = "strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query("q_a39_engagement", f"""WITH m AS (SELECT id, ts, sender_name, CASE WHEN attachment_type IS NULL THEN body END AS content, value FROM messages), t AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS i, count(*) OVER () AS n FROM m WHERE content <> ''),
    s AS (SELECT i AS place, * FROM t WHERE i < 40 UNION ALL SELECT 40 + i - (n // 2 - 20), * FROM t WHERE i BETWEEN n // 2 - 20 AND n // 2 + 19 UNION ALL SELECT 80 + i - (n - 40), * FROM t WHERE i >= n - 40)
    SELECT 'totals' AS section, CAST(NULL AS BIGINT) AS place, unnest(['messages', 'text', 'first', 'last']) AS item, unnest([count(*), count(content), min(ts), max(ts)]) AS n FROM m
    UNION ALL SELECT 'sample', place, '{{"sender":"' || sender_name || '","time":"' || {_MS} || '","text":"' || content || '","reactions":[' || CASE WHEN value > 20 THEN '"Bo: ' || sender_name || '"' ELSE '' END || ']}}', ts FROM s
    UNION ALL SELECT 'social', NULL, 'i_follow_them', max(CAST(contains(display_name, 'Bob') AS INT)) FROM identities UNION ALL SELECT 'social', NULL, 'they_follow_me', max(CAST(contains(array_to_string(participants, ','), 'Nobody') AS INT)) FROM threads
    UNION ALL SELECT 'engagement', NULL, 'stories_liked', count(*) FILTER (WHERE contains(sender_name, 'Bob') OR contains(body, 'Bob')) FROM messages UNION ALL SELECT 'engagement', NULL, 'stories_viewed', count(*) FILTER (WHERE contains(array_to_string(participants, ','), 'Bob')) FROM threads
    UNION ALL SELECT 'searches', row_number() OVER (ORDER BY ts, id) - 1, {_MS}, ts FROM messages WHERE contains(body, 'Bob') AND contains(body, 'lunch')""", "messages identities threads")  # fmt: skip
def _(a):
    from ..operators.writing import engagement

    reactions = F.when(F.col("value") > 20, F.array(F.struct(F.lit("Bo").alias("actor"), F.col("sender_name").alias("reaction"))))
    messages = a.messages.select("id", "ts", F.col("sender_name").alias("sender"), F.when(F.col("attachment_type").isNull(), F.col("body")).alias("content"), reactions.alias("reactions"))
    searches = a.messages.where("contains(body, 'lunch')").select("ts", "body")
    nobody = a.threads.where("not array_contains(participants, 'Nobody')")
    return engagement("Bob", messages, a.identities.select("display_name"), nobody.select("thread_id"), searches, stories_liked=a.messages.select("id", "sender_name", "body"), stories_viewed=a.threads)


@query("q_a43_writing_index", "SELECT 'd' || CAST(doc_id AS STRING) AS title, make_date(CAST(2000 + doc_id % 20 AS INT), CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END, 1) AS date FROM documents")
def _(a):
    from ..operators.writing import writing_index

    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(Mar "), (2000 + F.col("doc_id") % 20).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), (2000 + F.col("doc_id") % 20).cast("string"), F.lit(")")))
    files = a.table("documents").select(F.concat(F.lit("/w/d"), F.col("doc_id").cast("string"), F.lit(" "), name, F.lit(".md")).alias("path"), "text", F.lit(None).cast("timestamp").alias("mtime"))
    return writing_index(files).select("title", "date")
