"""Queries of events and meet-ups (E rows) and of streaming-like behaviour in batch (T rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.local_time import local_time
from ..operators import density
from ..operators import happenings as H
from ..session import shared_folder
from ..sources import sinks
from .catalog import query
from .fragments import DAY

_HOUR = 3_600_000


@query("q_e01_t05_time_sessions", f"SELECT id, thread_id, CAST(sum(CASE WHEN gap > {6 * _HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts, id) AS BIGINT) AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY thread_id ORDER BY ts, id) AS gap FROM messages)", "messages")
def _(a):
    return H.sessions(a.messages, ["thread_id"]).select("id", "thread_id", F.col("session").cast("long").alias("session"))


@query("q_e01_photo_clusters")
def _(a):
    p = a.messages.selectExpr("thread_id AS owner", "id", "ts", "CASE WHEN value > 5 THEN -37.8e0 + (value % 3) / 10 END AS lat", "CASE WHEN value > 5 THEN 144.9e0 END AS lng")
    return H.cluster(p)


@query("q_e02_participants", "SELECT DISTINCT event_id, canonical_id FROM ep JOIN photo_faces USING (photo_id)", "ep photo_faces")
def _(a):
    return H.participants(a.ep, a.photo_faces)


_NEAR = "SELECT 'd' || CAST(ts // 86400000 AS STRING) AS event_id, min(ts) AS start_ts, max(ts) AS end_ts, list_sort(list(DISTINCT canonical_id)) AS participants FROM pm GROUP BY 1"


def _near(a):
    return a.pm.groupBy(F.concat(F.lit("d"), F.floor(F.col("ts") / DAY).cast("string")).alias("event_id")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.array_sort(F.collect_set("canonical_id")).alias("participants"))


@query("q_e03_event_messages", f"""WITH g AS ({_NEAR}), p AS (SELECT DISTINCT event_id, start_ts, end_ts, thread_id FROM (SELECT event_id, start_ts, end_ts, unnest(participants) AS canonical_id FROM g) JOIN thread_identity USING (canonical_id))
    SELECT event_id, message_id FROM (SELECT p.event_id, m.id AS message_id, row_number() OVER (PARTITION BY p.event_id ORDER BY m.ts, m.id) AS r FROM p JOIN msgs m ON m.thread_id = p.thread_id AND m.meaningful AND m.ts BETWEEN p.start_ts - {12 * _HOUR} AND p.end_ts + {12 * _HOUR}) WHERE r <= 200""", "pm")  # fmt: skip
def _(a):
    return H.event_messages(_near(a), a.msgs, a.thread_identity).select("event_id", "message_id")


@query("q_e04_e05_majority_place", """WITH p AS (SELECT event_id, place_name, city, lat, lng FROM ep JOIN places USING (photo_id)), n AS (SELECT event_id, place_name, city, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, place_name, city NULLS LAST) AS r FROM p GROUP BY 1, 2, 3)
    SELECT n.event_id, coalesce(city, place_name) AS place, lat, lng FROM n JOIN (SELECT event_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM p GROUP BY 1) c USING (event_id) WHERE r = 1""", "ep places")  # fmt: skip
def _(a):
    return H.majority_place(a.ep, a.places)


@query("q_e08_person_events", "SELECT event_id, canonical_id, count(*) AS weight FROM ep JOIN photo_faces USING (photo_id) GROUP BY 1, 2", "ep photo_faces")
def _(a):
    return H.person_events(a.ep, a.photo_faces)


@query("q_e09_e10_co_present", "SELECT a.canonical_id AS a, b.canonical_id AS b, count(DISTINCT a.event_id) AS weight FROM seen a JOIN seen b ON a.event_id = b.event_id AND a.canonical_id <> b.canonical_id GROUP BY 1, 2", "seen")
def _(a):
    return H.co_present_events(a.gatherings)


_MARK = r"regexp_matches(lower(body), '\bomw\b|\bi''?m here\b|\bout front\b|\bsee (?:you|u) (?:there|soon|at|in)\b|\bjust left\b|\brunning late\b')"


def _mine(a):
    """Meaningful messages with the rememberer's local time."""
    return local_time(a.msgs.where("meaningful").withColumn("me", F.lit("me")), "ts", "me", a.rules)


@query("q_e11_meetup_candidates", f"""SELECT thread_id, strftime(local, '%Y-%m-%d') AS day, count(*) FILTER (WHERE {_MARK}) AS markers, min(CASE WHEN {_MARK} THEN ts END) AS start_ts, max(ts) AS end_ts FROM mine WHERE meaningful GROUP BY 1, 2
    HAVING count(*) FILTER (WHERE {_MARK}) > 0 AND count(*) FILTER (WHERE from_me) > 0 AND count(*) FILTER (WHERE NOT from_me) > 0""", "mine")  # fmt: skip
def _(a):
    return H.meetup_candidates(_mine(a), F.date_format("local", "yyyy-MM-dd"))


@query("q_e12_confirm_window", f"""WITH i AS (SELECT thread_id, id, strftime(local, '%Y-%m-%d') AS day, {_MARK} AS m, ts FROM mine WHERE meaningful), j AS (SELECT *, row_number() OVER (PARTITION BY thread_id, day ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY thread_id, day) AS n FROM i),
    k AS (SELECT *, min(CASE WHEN m THEN i END) OVER (PARTITION BY thread_id, day) AS f FROM j) SELECT thread_id, day, id FROM k WHERE f IS NOT NULL AND i >= greatest(0, least(f - 2, n - 6)) AND i < greatest(0, least(f - 2, n - 6)) + 6""", "mine")  # fmt: skip
def _(a):
    return H.confirm_window(_mine(a), F.date_format("local", "yyyy-MM-dd"), 6, 2)


@query("q_e13_uncovered", f"SELECT a.event_id FROM gatherings a WHERE a.source = 'messages' AND NOT EXISTS (SELECT 1 FROM gatherings b WHERE b.source = 'photos' AND b.start_ts <= a.end_ts + {6 * _HOUR} AND b.end_ts >= a.start_ts - {6 * _HOUR} AND (list_has_any(a.participants, b.participants) OR len(b.participants) = 0))", "gatherings")
def _(a):
    g = a.gatherings
    return H.uncovered(g.where("source = 'messages'"), g.where("source = 'photos'")).select("event_id")


@query("q_e14_verdict_cache", """WITH b AS (SELECT 0 AS p, event_id AS line, 'k' || CAST(user_id AS STRING) AS key, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS verdict FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, event_id, 'k' || CAST(user_id AS STRING), event_type FROM events WHERE event_id % 2 = 1)
    SELECT key, verdict FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, line) AS r FROM b WHERE verdict IS NOT NULL) WHERE r = 1""")  # fmt: skip
def _(a):
    e = a.table("events").selectExpr("event_id AS line", "'k' || user_id AS key", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS verdict")
    return H.merge_verdicts(e.where("line % 2 = 0"), e.where("line % 2 = 1"))


@query("q_e15_unique_ids", "SELECT call_id, CASE WHEN r = 1 THEN w ELSE w || '-' || CAST(r AS STRING) END AS event_id FROM (SELECT call_id, w, row_number() OVER (PARTITION BY w ORDER BY ts, call_id) AS r FROM (SELECT *, 'evt-' || CAST(ts // 86400000 AS STRING) AS w FROM calls))", "calls")
def _(a):
    c = a.calls.withColumn("w", F.concat(F.lit("evt-"), F.floor(F.col("ts") / DAY).cast("string")))
    return H.unique_ids(c, "w", ["ts", "call_id"]).select("call_id", "event_id")


_ROWS = """SELECT 'e' || CAST(user_id AS STRING) AS event_id, event_id AS row, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'invite' ELSE 'other' END AS kind, {ms} AS email_ts, CASE WHEN event_type <> 'error' THEN 't' || CAST(event_id AS STRING) END AS name,
    CASE WHEN event_type = 'view' AND value > 50 THEN {ms} + 86400000 END AS start_ts, CASE WHEN event_type = 'view' AND value > 90 THEN {ms} + 90000000 END AS end_ts, CASE WHEN event_type = 'click' THEN display_name END AS host FROM {events} e JOIN {identities} i ON i.n = (user_id + 3) % 150"""
_PAGES = "SELECT 'e' || CAST(n AS STRING) AS event_id, CASE WHEN n % 3 = 0 THEN {hosts} END AS hosts, CASE WHEN n % 5 = 0 THEN 'Private Location' ELSE 'hall ' || CAST(n AS STRING) END AS venue FROM {identities}"


@query("q_e16_best_invite", """WITH r AS (SELECT 'e' || CAST(user_id AS STRING) AS event_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'invite' ELSE 'other' END AS kind, 't' || CAST(event_id AS STRING) AS title, (epoch_us(ts) // 1000) AS email_ts, event_id AS row FROM events)
    SELECT event_id, kind, title, email_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE kind WHEN 'page' THEN 2 WHEN 'invite' THEN 1 ELSE 0 END DESC, email_ts DESC, row DESC) AS k FROM r) WHERE k = 1""")  # fmt: skip
def _(a):
    r = a.table("events").selectExpr("'e' || user_id AS event_id", "event_id AS row", "CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'invite' ELSE 'other' END AS kind", "'t' || event_id AS title", "unix_millis(CAST(ts AS TIMESTAMP)) AS email_ts")
    return H.best_invite(r, ["kind", "title", "email_ts"])


@query("q_e16_invitations", f"""WITH r AS ({_ROWS.format(ms='(epoch_us(ts) // 1000)', events='events', identities='identities')}), k AS (SELECT *, {{'k': CASE kind WHEN 'page' THEN 2 WHEN 'invite' THEN 1 ELSE 0 END, 't': email_ts, 'r': row}} AS o FROM r), d AS ({_PAGES.format(hosts="[upper(display_name), 'Nobody']", identities='identities')}),
    b AS (SELECT event_id, max(email_ts) FILTER (WHERE o = m) AS email_ts, arg_max(name, o) FILTER (WHERE name IS NOT NULL) AS name, arg_max(start_ts, o) FILTER (WHERE start_ts IS NOT NULL) AS start_ts, arg_max(end_ts, o) FILTER (WHERE end_ts IS NOT NULL) AS end_ts, arg_max(host, o) FILTER (WHERE host IS NOT NULL) AS host FROM (SELECT *, max(o) OVER (PARTITION BY event_id) AS m FROM k) GROUP BY 1),
    e AS (SELECT b.event_id, name, coalesce(start_ts, email_ts) AS start_ts, coalesce(end_ts, coalesce(start_ts, email_ts) + 10800000) AS end_ts, CASE WHEN venue <> 'Private Location' THEN venue END AS venue, unnest(CASE WHEN hosts IS NULL THEN [host] ELSE hosts[1:1] END) AS h FROM b LEFT JOIN d USING (event_id)),
    x AS (SELECT DISTINCT id AS mid, thread_id, regexp_extract(link, '/e/(e[0-9]+)', 1) AS event_id FROM (SELECT id, thread_id, from_me, 'https://partiful.example/e/e' || CAST(CAST(substr(id, 2) AS BIGINT) % 97 AS STRING) AS link FROM messages) WHERE NOT from_me), w AS (SELECT event_id, canonical_id, count(*) AS n FROM x JOIN thread_identity USING (thread_id) GROUP BY 1, 2),
    v AS (SELECT event_id, canonical_id AS inviter FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, canonical_id) AS r FROM w) WHERE r = 1), i AS (SELECT lower(display_name) AS k, min(canonical_id) AS host FROM identities GROUP BY 1)
    SELECT e.event_id, e.name, e.start_ts, e.end_ts, e.venue, coalesce(i.host, '') AS host_ids, v.inviter, concat_ws(',', i.host, CASE WHEN v.inviter IS DISTINCT FROM i.host THEN v.inviter END) AS participants FROM e LEFT JOIN i ON i.k = lower(e.h) LEFT JOIN v ON v.event_id = e.event_id""", "identities messages thread_identity")  # fmt: skip
def _(a):
    rows = a.spark.sql(_ROWS.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", events="{events}", identities="{identities}"), events=a.table("events"), identities=a.identities)
    pages = a.spark.sql(_PAGES.format(hosts="array(upper(display_name), 'Nobody')", identities="{identities}"), identities=a.identities)
    linked = a.messages.withColumn("body", F.expr("'see https://partiful.example/e/e' || CAST(CAST(substr(id, 2) AS BIGINT) % 97 AS STRING) || ' join us'"))
    out = H.invitations(rows, pages, linked, a.thread_identity, a.identities, r"partiful\.example/e/(\w+)")
    return out.withColumns({c: F.array_join(c, ",") for c in ("host_ids", "participants")})


@query("q_e17_event_index", "SELECT g.event_id, g.start_ts, CAST(len(g.participants) AS INT) AS people, (SELECT arg_min(p.asset_path, p.ts) FROM ep JOIN photos p ON p.id = ep.photo_id WHERE ep.event_id = g.event_id) AS thumb FROM gatherings g", "gatherings ep photos")
def _(a):
    return H.event_index(a.gatherings, a.ep, a.photos)


@query("q_e18_photo_dedupe", """WITH g AS (SELECT hash_sha256, arg_min(id, (CASE WHEN source = '5-low' THEN 0 ELSE 1 END) * 10000000000 + n) AS id, list_sort(list(id)) AS a FROM photos GROUP BY 1) SELECT id, array_to_string(list_filter(a, lambda x: x <> id), ',') AS alt_refs FROM g""", "photos")
def _(a):
    return H.dedupe_photos(a.photos, "5-low")


@query("q_e19_geocode_misses", "SELECT DISTINCT floor(lat * 1000 + 0.5) / 1000 AS lat_round, floor(lng * 1000 + 0.5) / 1000 AS lng_round FROM places p WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.city = 'city 2' AND floor(q.lat * 1000 + 0.5) = floor(p.lat * 1000 + 0.5) AND floor(q.lng * 1000 + 0.5) = floor(p.lng * 1000 + 0.5))", "places")
def _(a):
    from ..functions.text import round_half_up

    cache = a.places.where("city = 'city 2'").select(round_half_up(F.col("lat"), 1000).alias("lat_round"), round_half_up(F.col("lng"), 1000).alias("lng_round")).distinct()
    return H.geocode_misses(a.places, cache)


@query("q_e20_merge_clusters", """WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    d AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS s FROM c a JOIN c b USING (i) GROUP BY 1, 2), e AS (SELECT d.a, d.b FROM d JOIN d x ON x.a = d.a AND x.b = d.a JOIN d y ON y.a = d.b AND y.b = d.b WHERE d.a <> d.b AND d.s >= 0.5 * sqrt(x.s) * sqrt(y.s)),
    r AS (SELECT label AS node, label AS o FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.o), m AS (SELECT node, min(o) AS cluster FROM r GROUP BY 1)
    SELECT m.cluster, CAST(sum(n.n) AS BIGINT) AS n_faces, array_to_string(list_sort(list(CAST(n.label AS STRING))), ',') AS labels FROM m JOIN n ON n.label = m.node GROUP BY 1""")  # fmt: skip
def _(a):
    return H.merge_clusters(a.table("embeddings"), 0.5)


@query("q_e20_face_clusters")
def _(a):
    dets = a.table("embeddings").selectExpr("vec_id AS det_id", "concat('p', vec_id div 3) AS photo_id", "embedding", "CASE WHEN vec_id % 23 = 0 THEN 0.4D ELSE 0.5D + (vec_id * 37 % 50) / 100D END AS det_score")
    return density.cluster_report(dets, density.face_clusters(dets))


_OUTSIDE = """SELECT 'f' || CAST(o_orderkey AS STRING) AS key, 'party ' || CAST(o_custkey AS STRING) AS name, {ms} + (o_custkey % 11 - 5) * 3600000 AS ts, CASE WHEN o_custkey % 3 > 0 THEN -38.3e0 + (o_custkey % 500) / 1e2 END AS lat,
    CASE WHEN o_custkey % 3 > 0 THEN 144.4e0 + (o_custkey % 60) / 1e1 END AS lng, CASE o_orderstatus WHEN 'F' THEN 'joined' WHEN 'P' THEN 'hosted' ELSE 'interested' END AS response FROM {orders}"""


@query("q_e06_named", f"""WITH o AS ({_OUTSIDE.format(ms='(epoch_us(o_orderdate) // 1000)', orders='orders')}), n AS (SELECT key, name, event_id, abs(ts - start_ts) AS gap, o.lat AS a, o.lng AS b, g.lat AS c, g.lng AS d FROM o JOIN gatherings g ON ts BETWEEN start_ts - {6 * _HOUR} AND end_ts + {6 * _HOUR} WHERE response IN ('joined', 'hosted', 'ticket', 'created')),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, event_id) AS r FROM n) WHERE r = 1), m AS (SELECT *, 2 * 6371.0 * asin(least(1, sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2))) AS km FROM k), z AS (SELECT *, CASE WHEN km <= 5 THEN 'geo' WHEN km IS NULL AND gap <= {3 * _HOUR} THEN 'time' END AS match FROM m)
    SELECT event_id, key, name, match, gap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY match <> 'geo', gap, key) AS q FROM z WHERE match IS NOT NULL) WHERE q = 1""", "gatherings")  # fmt: skip
def _(a):
    outside = a.spark.sql(_OUTSIDE.format(ms="unix_millis(CAST(o_orderdate AS TIMESTAMP))", orders="{orders}"), orders=a.table("orders"))
    return H.named(a.gatherings, outside)


_LABELS = "SELECT DISTINCT label AS cluster_id, CASE WHEN label % 4 = 0 THEN 'skip' WHEN label % 4 = 1 THEN '' ELSE i.display_name END AS label FROM {embeddings} e JOIN {identities} i ON i.n = e.label"


@query("q_e21_face_ingest", f"""WITH d AS (SELECT 'p' || CAST(o_orderkey AS STRING) AS photo_id, CAST(l_partkey % 20 AS INT) AS cluster_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), l AS ({_LABELS.format(embeddings='embeddings', identities='identities')}), n AS (SELECT cluster_id, min(canonical_id) AS c FROM l JOIN identities ON lower(display_name) = lower(label) WHERE label NOT IN ('', 'skip') GROUP BY 1),
    s AS (SELECT id FROM photos WHERE source = '1-urgent'), f AS (SELECT photo_id, canonical_id, 'old' AS face_cluster FROM photo_faces WHERE photo_id NOT IN (SELECT id FROM s) UNION ALL SELECT photo_id, c, '1-urgent:cluster:' || CAST(min(cluster_id) AS STRING) FROM d JOIN n USING (cluster_id) WHERE (photo_id, c) NOT IN (SELECT photo_id, canonical_id FROM photo_faces WHERE photo_id NOT IN (SELECT id FROM s)) GROUP BY 1, 2)
    SELECT p.id, CASE WHEN p.source = '1-urgent' THEN count(f.photo_id) > 0 ELSE p.n % 2 = 0 END AS has_named_face, count(f.photo_id) AS faces, coalesce(string_agg(f.canonical_id || ' ' || f.face_cluster, ',' ORDER BY f.canonical_id), '') AS named FROM photos p LEFT JOIN f ON f.photo_id = p.id GROUP BY p.id, p.source, p.n""", "photos photo_faces identities")  # fmt: skip
def _(a):
    dets = a.spark.sql("SELECT 'p' || CAST(o_orderkey AS STRING) AS photo_id, CAST(l_partkey % 20 AS INT) AS cluster_id FROM {o} JOIN {l} ON l_orderkey = o_orderkey", o=a.table("orders"), l=a.table("lineitem"))
    labels = a.spark.sql(_LABELS, embeddings=a.table("embeddings"), identities=a.identities)
    clusters = dets.groupBy("cluster_id").agg(F.count("*").alias("n_faces"))
    photos = a.photos.withColumn("has_named_face", F.col("n") % 2 == 0)
    root = f"{shared_folder(a.spark)}/faces-{uuid.uuid4().hex}"
    sinks.publish_together(a.spark, H.face_tables(dets, clusters, labels, a.identities, photos, a.photo_faces.withColumn("face_cluster", F.lit("old")), "1-urgent"), root, "v1")
    new = sinks.together(a.spark, root)
    each = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "canonical_id", "face_cluster"))), ",")
    faces = new["photo_faces"].groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("faces"), each.alias("named"))
    return new["photos"].join(faces, "id", "left").select("id", "has_named_face", F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("named", F.lit("")).alias("named"))


@query("q_e22_cluster_sheet", """WITH d AS (SELECT CAST(l_partkey % 20 AS INT) AS cluster_id, p.ts, l_tax + 0.65 AS det_score, city FROM lineitem JOIN photos p ON p.id = 'p' || CAST(l_orderkey AS STRING) LEFT JOIN places ON photo_id = p.id), c AS (SELECT cluster_id, string_agg(city, ', ' ORDER BY r) AS cities FROM (SELECT cluster_id, city, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, city) AS r FROM d WHERE city IS NOT NULL GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
    SELECT d.cluster_id, count(*) AS n_faces, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(det_score), 6) AS mean_score, coalesce(any_value(cities), '') AS cities, round(avg(det_score), 6) < 0.69 AS low_quality FROM d LEFT JOIN c USING (cluster_id) GROUP BY 1""", "photos places")  # fmt: skip
def _(a):
    faces = a.table("lineitem").selectExpr("CAST(l_partkey % 20 AS INT) AS cluster_id", "'p' || l_orderkey AS id", "l_tax + 0.65D AS det_score")
    d = faces.join(a.photos.select("id", "ts"), "id").join(a.places.select(F.col("photo_id").alias("id"), "city"), "id", "left")
    return H.cluster_sheet(d, 0.69)


@query("q_t02_t03_floor_dedupe", "WITH f AS (SELECT thread_id, max(ts) AS floor FROM messages WHERE source = 'gmail' GROUP BY 1) SELECT DISTINCT m.id FROM messages m LEFT JOIN f USING (thread_id) WHERE m.source <> 'gmail' AND m.ts > coalesce(f.floor, -1)", "messages")
def _(a):
    from ..streaming.spool import above_floor

    base = a.messages.where("source = 'gmail'").groupBy("thread_id").agg(F.max("ts").alias("floor"))
    return above_floor(a.messages.where("source <> 'gmail'"), base).dropDuplicates(["id"]).select("id")


@query("q_t04_contact_names", "SELECT thread_id, arg_max(sender_name, {'t': ts, 'i': id}) AS name FROM messages GROUP BY 1", "messages")
def _(a):
    return a.messages.groupBy("thread_id").agg(F.max_by("sender_name", F.struct("ts", "id")).alias("name"))
