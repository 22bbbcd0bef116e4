"""Queries of retrieval tools, the people store, quality gates and sources (M, C, D, S rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crm as C
from ..operators import gates as D
from ..operators import retrieval as M
from ..sources import tables as S
from .catalog import query
from .fragments import LATER, NOW, zone_of


@query("q_m02_search", r"""SELECT id, ts, thread_id, sender_name, substr(body, 1, 500) AS body, len(body) > 500 AS body_truncated FROM messages WHERE body ILIKE '%late%' AND source = 'gmail' AND ts >= 1704500000000 AND ts < 1706000000000 AND NOT (regexp_matches(body, '(?i)ann') OR regexp_matches(sender_name, '(?i)ann'))
    AND regexp_matches(regexp_replace(lower(body), 'https?://\S+', ' ', 'g'), '(^|[^a-z0-9])late([^a-z0-9]|$)') ORDER BY ts DESC, id LIMIT 50""", "messages")  # fmt: skip
def _(a):
    return M.search_messages(a.messages, "late", source="gmail", after=1_704_500_000_000, before=1_706_000_000_000, redactions=("(?i)ann",))


_LOCAL = "strftime(make_timestamp({t} * 1000) + to_minutes(CAST(coalesce({z}.off, 0) AS BIGINT)), '%Y-%m-%d %H:%M') || ' ' || coalesce({z}.tag, 'UTC')"


@query("q_m04_person_summary", f"""WITH s AS (SELECT canonical_id, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT source) AS sources, count(DISTINCT thread_id) AS threads FROM pm GROUP BY 1), z AS (SELECT *, {zone_of('canonical_id', 'first_ts')} AS a, {zone_of('canonical_id', 'last_ts')} AS b FROM s)
    SELECT canonical_id, messages, first_ts, last_ts, sources, threads, {_LOCAL.format(t='first_ts', z='a')} AS first_local, {_LOCAL.format(t='last_ts', z='b')} AS last_local, display_name, coalesce(same_as, '') AS same_as, display_name IN (SELECT name FROM portraits) AS has_portrait FROM z JOIN (SELECT canonical_id, display_name FROM identities) USING (canonical_id) LEFT JOIN same USING (canonical_id)""", "pm identities rules same portraits")  # fmt: skip
def _(a):
    return M.person_summary(a.messages, a.thread_identity, a.identities, a.rules, a.merges, a.portraits)


@query("q_m05_a31_on_this_day", """WITH t AS (SELECT thread_id, bool_or(from_me) AS two_way FROM messages GROUP BY 1), m AS (SELECT m.*, year(local) AS year, strftime(local, '%Y-%m-%d %H:%M') || ' ' || tag AS local_time, ti.canonical_id, i.display_name, two_way FROM mine m JOIN t USING (thread_id) LEFT JOIN thread_identity ti USING (thread_id) LEFT JOIN identities i USING (canonical_id)
    WHERE meaningful AND strftime(local, '%m-%d') = '01-16' AND year(local) <> 2025 AND NOT contains(body, 'lunch')), w AS (SELECT year, coalesce(canonical_id, thread_id) AS who, count(*) AS n, min(coalesce(display_name, thread_id)) AS name FROM m GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, who) AS r, sum(n) OVER (PARTITION BY year) AS every FROM w), p AS (SELECT year, CAST(max(every) AS BIGINT) AS message_count, string_agg(name || ' ' || n, '; ' ORDER BY r) AS top_people FROM f WHERE r <= 5 GROUP BY 1),
    c AS (SELECT *, CASE WHEN two_way AND canonical_id IS NOT NULL AND NOT (contains(display_name, '@') OR (len(regexp_replace(display_name, '[^0-9]', '', 'g')) >= 7 AND NOT regexp_matches(display_name, '[A-Za-z]'))) THEN 0 WHEN two_way AND canonical_id IS NOT NULL THEN 1 WHEN canonical_id IS NOT NULL THEN 2 ELSE 3 END AS tier FROM m),
    i AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY year) AS n FROM (SELECT *, min(tier) OVER (PARTITION BY year) AS lo FROM c) WHERE tier = lo)
    SELECT CAST(year AS INT) AS year, message_count, top_people, tier, id, local_time, CASE WHEN from_me THEN 'ME' ELSE 'THEM' END AS speaker, thread_id, substr(body, 1, 300) AS body FROM i JOIN p USING (year) WHERE i % greatest(1, n // 8) = 0 AND i // greatest(1, n // 8) < 8""", "mine thread_identity identities")  # fmt: skip
def _(a):
    t = a.messages.groupBy("thread_id").agg(F.max("from_me").alias("two_way"))
    named = a.thread_identity.join(a.identities.select("canonical_id", "display_name"), "canonical_id", "left")
    return M.on_this_day(a.msgs.where("meaningful").join(t, "thread_id").join(named, "thread_id", "left"), a.rules, 1, 16, 1_736_985_600_000, redactions=("lunch",))


@query("q_m06_m10_m11_guarded_sql", "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) > 100 AS dear FROM orders GROUP BY 1")
def _(a):
    a.table("orders").createOrReplaceTempView("guarded_orders")
    return M.safe_select(a.spark, "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) > 100 AS dear FROM guarded_orders GROUP BY 1 -- fine")


@query("q_m12_thread_window", "SELECT id FROM messages WHERE (thread_id IN ('t1', 't2') OR thread_id LIKE 'g1%') AND ts >= 1704500000000 AND ts < 1705500000000", "messages")
def _(a):
    return M.thread_window(a.messages, ["t1", "t2"], ["g1%"], 1_704_500_000_000, 1_705_500_000_000).select("id")


_LATEST = "SELECT key, kind, amount, updated_at, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, op DESC) AS r FROM ops WHERE kind IN ('view', 'click', 'signup', 'purchase')) WHERE r = 1"


@query("q_c02_c04_c05_t10_replay", f"SELECT key, kind, amount, updated_at FROM ({_LATEST}) WHERE updated_at > 1706000000000", "ops")
def _(a):
    return C.replay(a.ops, since=1_706_000_000_000).select("key", "kind", "amount", "updated_at")


@query("q_c01_people", f"SELECT l.key, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS interactions FROM ({_LATEST}) l LEFT JOIN (SELECT key, array_to_string(list_sort(list(DISTINCT kind)), ',') AS tags, count(*) AS n FROM ops GROUP BY 1) t USING (key) WHERE l.kind <> 'purchase'", "ops")
def _(a):
    rows = C.replay(a.ops).withColumn("deleted_at", F.when(F.col("kind") == "purchase", F.col("updated_at")))
    return C.people(rows, a.ops.select("key", F.col("kind").alias("tag")), a.ops)


@query("q_c03_m08_log", "SELECT key, count(*) AS n FROM (SELECT key FROM ops UNION ALL SELECT 'k1') GROUP BY 1", "ops")
def _(a):
    return C.log_interaction(a.ops, "k1", "click", LATER).groupBy("key").agg(F.count("*").alias("n"))


#: Dumps of one person and up to 200 of their ops each: some without id or name, interactions that share an id, and dates that are missing or unreadable.
_DUMP = """SELECT key || '/' || lpad(CAST(part AS STRING), 6, '0') AS seq, to_json(struct(array(struct(CASE WHEN key LIKE '%7' THEN '' ELSE key END AS id, CASE WHEN key LIKE '%3' THEN '' ELSE 'Name ' || key || ' ' || part END AS name, 'call ' || part AS followUp,
    tags, transform(ops, o -> named_struct('id', CASE WHEN o.op % 13 <> 0 THEN 'o' || CAST(o.op div 2 AS STRING) END, 'type', CASE WHEN o.kind <> 'view' THEN o.kind END, 'notes', CASE WHEN o.op % 5 <> 0 THEN 'n' || CAST(o.op AS STRING) ELSE '' END,
    'date', CASE o.op % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE date_format(timestamp_millis(o.updated_at), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") END)) AS interactions)) AS people, CASE WHEN key NOT LIKE '%7' THEN array(struct(key AS source, key AS target, CASE WHEN part % 3 <> 0 THEN CAST(part AS INT) END AS strength)) END AS connections)) AS text
    FROM (SELECT key, op div 200 AS part, array_sort(collect_set(kind)) AS tags, array_sort(collect_list(struct(op, kind, updated_at))) AS ops FROM {ops} GROUP BY key, op div 200)"""


@query("q_c06_dump", f"""WITH p AS (SELECT *, op // 200 AS part, key || '/' || lpad(CAST(op // 200 AS STRING), 6, '0') AS seq, CASE WHEN key LIKE '%7' THEN sha256('person/' || key || '/' || lpad(CAST(op // 200 AS STRING), 6, '0') || '/0') ELSE key END AS id FROM ops),
    i AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY op) - 1 AS nth FROM p), k AS (SELECT *, CASE WHEN op % 13 <> 0 THEN 'o' || CAST(op // 2 AS STRING) ELSE sha256('interaction/' || seq || '/0/' || CAST(nth AS STRING)) END AS iid FROM i WHERE op % 7 <> 1)
    SELECT 'people' AS tab, id, arg_min(CASE WHEN key LIKE '%3' THEN '(unnamed)' ELSE 'Name ' || key || ' ' || part END, seq) AS name, arg_min('call ' || part, seq) AS body, CAST({NOW} AS BIGINT) AS n FROM p GROUP BY id
    UNION ALL SELECT DISTINCT 'tags', id, kind, NULL, NULL FROM p
    UNION ALL SELECT 'interactions', iid, CASE WHEN kind <> 'view' THEN kind ELSE 'note' END, CASE WHEN op % 5 <> 0 THEN 'n' || CAST(op AS STRING) END || ' of ' || id, CASE WHEN op % 7 = 0 THEN {NOW} ELSE updated_at END FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY seq, nth) AS r FROM k) WHERE r = 1
    UNION ALL SELECT 'connections', key, key, NULL, arg_max(CASE WHEN part % 3 <> 0 THEN part ELSE 1 END, seq) FROM p WHERE key NOT LIKE '%7' GROUP BY key""", "ops")  # fmt: skip
def _(a):
    people, tags, interactions, links = C.from_dump(a.spark.sql(_DUMP, ops=a.ops), NOW)
    nothing = F.lit(None).cast("string")
    row = lambda df, tab, id_, name, body, n: df.select(F.lit(tab).alias("tab"), F.col(id_).alias("id"), F.col(name).alias("name"), body.alias("body"), n.cast("long").alias("n"))
    parts = (
        row(people, "people", "id", "name", F.col("follow_up"), F.col("created_at")), row(tags, "tags", "person_id", "tag", nothing, F.lit(None)),
        row(interactions, "interactions", "id", "kind", F.concat("body", F.lit(" of "), "person_id"), F.col("occurred_at")), row(links, "connections", "source_id", "target_id", nothing, F.col("strength")),
    )
    return reduce(DataFrame.unionByName, parts)


@query("q_c07_history", "SELECT op, row_number() OVER w AS version, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, op DESC) = 1 AS current FROM ops WINDOW w AS (PARTITION BY key ORDER BY updated_at, op)", "ops")
def _(a):
    return C.history(a.ops).select("op", F.col("version").cast("long").alias("version"), "current")


@query("q_d01_manifest", "SELECT source, count(*) AS messages, max(ts) AS newest FROM messages GROUP BY 1", "messages")
def _(a):
    return D.manifest(a.messages).drop("checksum")


@query("q_d02_regressions", "WITH b AS (SELECT source, count(*) AS m0, max(ts) AS t0 FROM messages GROUP BY 1), c AS (SELECT source, count(*) AS m1, max(ts) AS t1 FROM messages WHERE source <> 'gmail' AND (source <> 'imessage' OR from_me) GROUP BY 1) SELECT b.source, m0, m1, CASE WHEN m1 IS NULL THEN 'missing' WHEN m1 < m0 THEN 'count down' WHEN t1 < t0 THEN 'newest backwards' END AS problem FROM b LEFT JOIN c USING (source) WHERE m1 IS NULL OR m1 < m0 OR t1 < t0", "messages")
def _(a):
    now = a.messages.where("source <> 'gmail' AND (source <> 'imessage' OR from_me)")
    return D.regressions(D.manifest(a.messages), D.manifest(now))


@query("q_d03_health", "SELECT 'messages' AS check, count(*) AS v, count(*) >= 100 AS ok FROM messages UNION ALL SELECT 'case_twins', count(*), count(*) = 0 FROM (SELECT lower(display_name) FROM identities GROUP BY 1 HAVING count(DISTINCT display_name) > 1) UNION ALL SELECT 'orphans', count(*), count(*) = 0 FROM thread_identity WHERE canonical_id NOT IN (SELECT canonical_id FROM identities)".replace("AS check", 'AS "check"'), "messages identities thread_identity")
def _(a):
    return D.health(a.messages, a.identities, a.thread_identity, 100)


@query("q_s03_tail_merge", "WITH a AS (SELECT * FROM messages WHERE source IN ('gmail', 'imessage', 'instagram')), b AS (SELECT * FROM messages WHERE source IN ('whatsapp', 'messenger')) SELECT id FROM a UNION ALL SELECT b.id FROM b LEFT JOIN (SELECT thread_id, max(ts) AS c FROM a GROUP BY 1) x USING (thread_id) WHERE x.c IS NULL OR b.ts > x.c", "messages")
def _(a):
    return S.tail_merge(a.messages.where("source IN ('gmail', 'imessage', 'instagram')"), a.messages.where("source IN ('whatsapp', 'messenger')")).select("id")


@query("q_s05_multiset_union", "SELECT thread_id, body, max(c) AS copies FROM (SELECT source, thread_id, body, count(*) AS c FROM messages GROUP BY ALL) GROUP BY 1, 2", "messages")
def _(a):
    u = S.multiset_union(a.messages.select(F.col("source").alias("export"), "thread_id", "body"), ["thread_id", "body"])
    return u.groupBy("thread_id", "body").agg(F.count("*").alias("copies"))


@query("q_s14_correspondents", "SELECT domain, CAST(sum(n_messages) AS BIGINT) AS n, bool_or(list_unsubscribe) AS bulk, arg_min(display_name, n) AS display_name FROM emails GROUP BY 1", "emails")
def _(a):
    return S.correspondents(a.emails)


@query("q_s17_birthday_precedence", "SELECT name, month, day, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), month, day ORDER BY CASE source WHEN 'vcard' THEN 0 ELSE 1 END, k) AS r FROM (SELECT lower(split_part(display_name, ' ', 1)) AS name, CAST(n % 12 AS INT) + 1 AS month, CAST(n % 28 AS INT) + 1 AS day, CASE WHEN n % 2 = 0 THEN 'ics' ELSE 'vcard' END AS source, n AS k FROM identities)) WHERE r = 1", "identities")
def _(a):
    b = a.identities.selectExpr("lower(substring_index(display_name, ' ', 1)) AS name", "CAST(n % 12 AS INT) + 1 AS month", "CAST(n % 28 AS INT) + 1 AS day", "CASE WHEN n % 2 = 0 THEN 'ics' ELSE 'vcard' END AS source", "n AS k")
    return S.birthday_precedence(b).select("name", "month", "day", "source")


@query("q_s22_event_union", "SELECT name, start_ts, response FROM (SELECT 'n' || CAST(user_id AS STRING) AS name, 0 AS start_ts, event_type AS response, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(a):
    e = a.table("events").selectExpr("'n' || user_id AS name", "0 AS start_ts", "event_type AS response", "event_id AS ordinal")
    return S.strongest_response(e, ("error", "view", "click", "signup", "purchase")).select("name", "start_ts", "response")


@query("q_s28_k03_append_new", "SELECT id FROM photos", "photos")
def _(a):
    return S.append_new(a.photos.where("n % 3 = 0"), a.photos.where("n % 3 > 0 OR n % 2 = 0"), ["id"]).select("id")


@query("q_s29_numbered_lines", "SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")
def _(a):
    d = a.table("documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "t")


@query("q_s02_s24_html_titles", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def _(a):
    return a.table("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"))


@query("q_t09_overlap_fetch", f"""WITH b AS (SELECT source, thread_id, ts, body FROM messages WHERE ts < 1706000000000 AND source <> 'gmail'), s AS (SELECT source, max(ts) - {2 * 86_400_000} AS since FROM b GROUP BY 1), f AS (SELECT m.source, thread_id, ts, body FROM messages m LEFT JOIN s USING (source) WHERE since IS NULL OR ts >= since)
    SELECT source, thread_id, ts, body, max(c) AS copies FROM (SELECT *, count(*) AS c FROM b GROUP BY ALL UNION ALL SELECT *, count(*) FROM f GROUP BY ALL) GROUP BY 1, 2, 3, 4""", "messages")  # fmt: skip
def _(a):
    base = a.messages.where("ts < 1706000000000 AND source <> 'gmail'")
    out = S.overlap_fetch(base, a.messages, ["thread_id", "ts", "body"])
    return out.groupBy("source", "thread_id", "ts", "body").agg(F.count("*").alias("copies"))


@query("q_m09_set_follow_up", f"""SELECT canonical_id AS id, display_name AS name, CASE canonical_id WHEN 'id-4' THEN 'call back' WHEN 'id-5' THEN 'write' END AS follow_up, CASE WHEN canonical_id IN ('id-4', 'id-5') THEN {LATER} ELSE n END AS updated_at FROM identities""", "identities")
def _(a):
    nothing = F.lit(None).cast("string")
    people = a.identities.where("canonical_id <> 'id-5'").select(F.col("canonical_id").alias("id"), F.col("display_name").alias("name"), nothing.alias("anchor"), nothing.alias("follow_up"), F.lit(None).cast("long").alias("deleted_at"), F.col("n").alias("created_at"), F.col("n").alias("updated_at"))
    people = C.set_follow_up(people, a.identities, "id-4", "call back", LATER)
    return C.set_follow_up(people, a.identities, "id-5", "write", LATER).select("id", "name", "follow_up", "updated_at")
