"""Queries of the connection graph (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.aggregates import months
from ..operators.iterative import components
from ..operators.joins import pairs
from ..operators.writing import writing_mentions
from .catalog import query
from .fragments import LATER


@query("q_g00_membership", "SELECT * FROM membership", "membership")
def _(a):
    return a.membership


@query("q_g01_j09_mentions", "SELECT * FROM mention", "mention")
def _(a):
    return a.mention


@query("q_g02_shared_group", "SELECT a.canonical_id, b.canonical_id AS related_canonical_id, a.thread_id AS evidence, 1 AS weight FROM (SELECT DISTINCT thread_id, canonical_id FROM membership WHERE canonical_id IS NOT NULL) a JOIN (SELECT DISTINCT thread_id, canonical_id FROM membership WHERE canonical_id IS NOT NULL) b ON a.thread_id = b.thread_id AND a.canonical_id <> b.canonical_id", "membership")
def _(a):
    return G.shared_groups(a.membership)


@query("q_g03_mentioned_in", "SELECT mentioned_canonical_id AS canonical_id, thread_id AS evidence, count(*) AS weight FROM mention GROUP BY ALL", "mention")
def _(a):
    return G.mentioned_in(a.mention)


@query("q_g04_co_mentioned", "SELECT a, b, thread_id, day, CAST(sum(weight) AS BIGINT) AS weight FROM co GROUP BY ALL", "co")
def _(a):
    return G.co_mentioned(a.mention)


@query("q_g05_ego_nodes", "SELECT * FROM nodes", "nodes")
def _(a):
    return a.nodes


_PAIRS = "SELECT a.canonical_id AS a, b.canonical_id AS b, count(DISTINCT a.thread_id) AS groups FROM membership a JOIN membership b ON a.thread_id = b.thread_id AND a.canonical_id < b.canonical_id GROUP BY ALL"
_WORDS = ", ".join(f"'{w}'" for w in G.AMBIGUOUS)


@query("q_g05b_edge_weights", f"""WITH g AS (SELECT * FROM ({_PAIRS}) WHERE a IN (SELECT canonical_id FROM nodes) AND b IN (SELECT canonical_id FROM nodes)), c AS (SELECT least(owner, mentioned_canonical_id) AS a, greatest(owner, mentioned_canonical_id) AS b, count(*) AS m FROM told
    WHERE lower(mentioned_form) NOT IN ({_WORDS}) AND owner IN (SELECT canonical_id FROM nodes) AND mentioned_canonical_id IN (SELECT canonical_id FROM nodes) GROUP BY 1, 2) SELECT a, b, coalesce(g.groups, 0) AS groups, coalesce(c.m, 0) AS mentions, coalesce(g.groups, 0) + coalesce(c.m, 0) AS weight FROM g FULL JOIN c USING (a, b) WHERE coalesce(g.groups, 0) + coalesce(c.m, 0) >= 2""", "membership nodes told")  # fmt: skip
def _(a):
    return G.edge_weights(a.nodes, a.membership, a.mention, a.threads, a.thread_identity, least=2)


@query("q_g05c_co_present", """WITH s AS (SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS photos FROM photo_faces a JOIN photo_faces b ON a.photo_id = b.photo_id AND a.canonical_id < b.canonical_id GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT DISTINCT unnest([a, b]) AS c FROM s)
    SELECT 'edge' AS kind, a, b, photos FROM s UNION ALL SELECT 'node', c, display_name, NULL FROM p JOIN identities ON canonical_id = c WHERE c <> 'id-0' AND c NOT IN (SELECT canonical_id FROM nodes)""", "photo_faces nodes")  # fmt: skip
def _(a):
    edges, only = G.co_present(a.photo_faces, a.nodes, a.identities, "id-0")
    return edges.select(F.lit("edge").alias("kind"), "a", "b", "photos").union(only.select(F.lit("node"), "canonical_id", "display_name", F.lit(None).cast("long")))


@query("q_g05d_label_propagation")
def _(a):
    e = pairs(a.membership.where("canonical_id is not null"), "thread_id", "canonical_id").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return G.label_propagation(e)


@query("q_g06_components", f"""WITH e AS (SELECT a, b FROM ({_PAIRS})), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS x FROM both_ways UNION SELECT r.node, b.b FROM r JOIN both_ways b ON r.x = b.a)
    SELECT node, min(x) AS component FROM r GROUP BY node""", "membership")  # fmt: skip
def _(a):
    return components(pairs(a.membership.where("canonical_id is not null"), "thread_id", "canonical_id").select("a", "b").distinct())


_COHORT = """SELECT g.thread_id, g.msgs, g.senders, m.c AS member_count, m.members FROM (SELECT thread_id, count(*) AS msgs, count(DISTINCT sender_name) AS senders FROM messages WHERE body <> '' GROUP BY 1) g
    JOIN (SELECT thread_id, count(DISTINCT canonical_id) AS c, array_to_string(list_sort(list(DISTINCT canonical_id)), ',') AS members FROM membership WHERE canonical_id IS NOT NULL GROUP BY 1) m USING (thread_id) WHERE g.msgs >= 50 AND g.senders BETWEEN 3 AND 16 AND m.c >= 3"""


@query("q_g07_cohorts", _COHORT, "membership")
def _(a):
    return G.cohorts(a.messages, a.membership, senders=(3, 16)).withColumn("member_count", F.col("member_count").cast("long"))


@query("q_g08_bridges", f"SELECT canonical_id, count(*) AS n_groups, array_to_string(list_sort(list(DISTINCT thread_id))[1:10], ',') AS groups FROM (SELECT thread_id, unnest(string_split(members, ',')) AS canonical_id FROM ({_COHORT})) GROUP BY 1 HAVING count(*) >= 1", "membership")
def _(a):
    return G.bridges(G.cohorts(a.messages, a.membership, senders=(3, 16)), least=1)


@query("q_g09_graduation", """SELECT canonical_id, first_group, first_1on1, CAST(floor((first_1on1 - first_group) / 86400000.0 + 0.5) AS BIGINT) AS lag_days, CASE WHEN floor((first_1on1 - first_group) / 86400000.0 + 0.5) > 7 THEN 'group_first' WHEN floor((first_1on1 - first_group) / 86400000.0 + 0.5) < -7 THEN '1on1_first' ELSE 'concurrent' END AS kind FROM
    (SELECT i.canonical_id, min(m.ts) AS first_group FROM messages m JOIN threads t USING (thread_id) JOIN identities i ON i.display_name = m.sender_name WHERE t.is_group GROUP BY 1) JOIN (SELECT ti.canonical_id, min(m.ts) AS first_1on1 FROM messages m JOIN thread_identity ti USING (thread_id) GROUP BY 1) USING (canonical_id)""", "messages threads identities thread_identity")  # fmt: skip
def _(a):
    return G.graduation(a.messages, a.thread_identity, a.identities, a.threads)


@query("q_g10_group_profile", f"""WITH g AS (SELECT m.* FROM messages m JOIN threads t USING (thread_id) WHERE t.is_group AND m.body <> ''), s AS (SELECT thread_id, count(*) AS msgs, max(ts) AS l FROM g GROUP BY 1 HAVING count(*) > 50 ORDER BY 2 DESC, 1 LIMIT 80),
    p AS (SELECT thread_id, mo FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY k DESC, mo) AS r FROM (SELECT thread_id, strftime(make_timestamp(ts * 1000), '%Y-%m') AS mo, count(*) AS k FROM g GROUP BY 1, 2)) WHERE r = 1)
    SELECT x.thread_id, x.sender_name, x.n, s.msgs, CASE WHEN x.n / s.msgs >= 0.30 THEN 'dominant' WHEN x.n / s.msgs >= 0.15 THEN 'core' WHEN x.n / s.msgs >= 0.05 THEN 'regular' WHEN x.n / s.msgs >= 0.01 THEN 'occasional' ELSE 'lurker' END AS role, p.mo AS peak_month,
    CASE WHEN ({LATER} - s.l) / 86400000 <= 60 THEN 'active' WHEN ({LATER} - s.l) / 86400000 <= 365 THEN 'quiet' WHEN ({LATER} - s.l) / 86400000 <= 1095 THEN 'dormant' ELSE 'dead' END AS life
    FROM (SELECT thread_id, sender_name, count(*) AS n FROM g GROUP BY ALL) x JOIN s USING (thread_id) JOIN p USING (thread_id)""", "messages threads")  # fmt: skip
def _(a):
    return G.group_profile(a.messages, a.threads, LATER)


@query("q_g11_storyline", """WITH m AS (SELECT canonical_id, ts, strftime(make_timestamp(ts * 1000), '%Y-%m') AS mo FROM pm JOIN (SELECT thread_id, is_group FROM threads) USING (thread_id) WHERE NOT is_group AND body <> ''), p AS (SELECT canonical_id, min(ts) AS lo, max(ts) AS hi FROM m GROUP BY 1 HAVING count(*) > 20 ORDER BY count(*) DESC, 1 LIMIT 30),
    s AS (SELECT strftime(unnest(generate_series(date_trunc('month', make_timestamp(min(lo) * 1000)), date_trunc('month', make_timestamp(max(hi) * 1000)), INTERVAL 1 MONTH)), '%Y-%m') AS mo FROM p), n AS (SELECT mentioned_canonical_id AS c, strftime(make_timestamp(ts * 1000), '%Y-%m') AS mo, count(*) AS n FROM mention GROUP BY 1, 2), k AS (SELECT canonical_id, mo, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT 'person' AS kind, p.canonical_id AS a, NULL AS b, s.mo AS month, coalesce(k.n, 0) AS n, coalesce(n.n, 0) AS mentions FROM p CROSS JOIN s LEFT JOIN k ON k.canonical_id = p.canonical_id AND k.mo = s.mo LEFT JOIN n ON n.c = p.canonical_id AND n.mo = s.mo
    UNION ALL SELECT 'edge', least(owner, mentioned_canonical_id), greatest(owner, mentioned_canonical_id), strftime(make_timestamp(ts * 1000), '%Y-%m'), count(*), NULL FROM told WHERE owner IN (SELECT canonical_id FROM p) AND mentioned_canonical_id IN (SELECT canonical_id FROM p) GROUP BY 2, 3, 4""", "pm told")  # fmt: skip
def _(a):
    people, edges = G.storyline(a.messages, a.threads, a.thread_identity, a.mention, over=20)
    none = F.lit(None)
    return people.select(F.lit("person").alias("kind"), F.col("canonical_id").alias("a"), none.cast("string").alias("b"), "month", F.col("msgs").alias("n"), "mentions").union(edges.select(F.lit("edge"), "a", "b", "month", "n", none.cast("long")))


@query("q_g12_mention_quotes", f"""WITH t AS (SELECT canonical_id FROM pm WHERE coalesce(body, '') <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30), q AS (SELECT n.mentioned_canonical_id, ti.canonical_id AS owner, n.message_id, strftime(make_timestamp(n.ts * 1000), '%Y-%m-%d') AS day, m.from_me, trim(regexp_replace(m.body, '\n+', ' / ', 'g')) AS quote
        FROM mention n JOIN messages m ON m.id = n.message_id JOIN thread_identity ti ON ti.thread_id = n.thread_id JOIN t ON t.canonical_id = n.mentioned_canonical_id WHERE len(m.body) BETWEEN 5 AND 500)
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mentioned_canonical_id) AS mentions, count(*) OVER (PARTITION BY mentioned_canonical_id, owner) AS in_thread FROM q) WHERE mentions >= 3""", "mention pm")
def _(a):
    return G.mention_quotes(a.mention, a.pm, top=30)


_PEOPLE = "SELECT item_id, 'b' || CAST(item_id AS STRING) AS canonical_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS display_name, upper(substr(split_part(text, ' ', 3), 1, 1)) || substr(split_part(text, ' ', 3), 2) AS third, upper(substr(split_part(text, ' ', 4), 1, 1)) || lower(substr(split_part(text, ' ', 4), 2, 1)) AS short FROM {benchmark}"


@query("q_g13_writing_mentions", rf"""WITH p AS ({_PEOPLE.format(benchmark='benchmark')}), f AS (SELECT DISTINCT canonical_id, f FROM (SELECT canonical_id, unnest([display_name, third, short]) AS f FROM p) WHERE regexp_matches(f, '^[\p{{L}}][\p{{L}}'' -]+$') AND f <> lower(f) AND length(f) >= 2),
    l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS line, unnest(x) AS t FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS x FROM documents))
    SELECT DISTINCT canonical_id, CAST(doc_id AS STRING) AS file, line FROM l JOIN f ON contains(lower(t), lower(f)) AND regexp_matches(t, CASE WHEN length(f) = 2 THEN '' ELSE '(?i)' END || '\b' || regexp_escape(f) || '\b')""")  # fmt: skip
def _(a):
    people = a.spark.sql(_PEOPLE, benchmark=a.table("benchmark")).select("canonical_id", "display_name", F.array("third", "short").alias("aliases"))
    return writing_mentions(a.table("documents").select(F.col("doc_id").alias("file"), "text"), people).select("canonical_id", "file", "line")


@query("q_g14_context_packet", """WITH t AS (SELECT thread_id, source AS of, is_group FROM threads), d AS (SELECT thread_id, of, count(*) AS n, min(ts) AS lo, max(ts) AS hi, count(*) FILTER (WHERE from_me) AS f FROM pm JOIN t USING (thread_id) WHERE canonical_id = 'id-1' AND meaningful GROUP BY 1, 2), g AS (SELECT DISTINCT thread_id FROM membership WHERE canonical_id = 'id-1'), z AS (SELECT thread_id, count(*) AS n FROM msgs WHERE meaningful GROUP BY 1),
    o AS (SELECT thread_id, list_sort(list(DISTINCT participant_name)) AS w FROM membership JOIN g USING (thread_id) WHERE participant_name <> (SELECT display_name FROM identities WHERE canonical_id = 'id-1') GROUP BY 1), a AS (SELECT x, CAST(sum(weight) AS BIGINT) AS n FROM (SELECT b AS x, weight FROM co WHERE a = 'id-1' UNION ALL SELECT a, weight FROM co WHERE b = 'id-1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
    p AS (SELECT thread_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM mention WHERE mentioned_canonical_id = 'id-1' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15), w AS (SELECT thread_id, list_sort(list(DISTINCT participant_name)) AS w FROM membership GROUP BY 1), r AS (SELECT DISTINCT message_id, ts FROM mention WHERE mentioned_canonical_id = 'id-1' ORDER BY ts DESC, message_id LIMIT 8)
    SELECT 'direct' AS section, thread_id AS item, n, lo AS first_ts, hi AS last_ts, of || ' ' || CAST(f AS STRING) AS text FROM d UNION ALL SELECT 'groups', g.thread_id, coalesce(z.n, 0), NULL, NULL, coalesce(array_to_string(o.w[1:8], ', ') || CASE WHEN len(o.w) > 8 THEN ', +' || CAST(len(o.w) - 8 AS STRING) || ' more' ELSE '' END, '') FROM g LEFT JOIN z USING (thread_id) LEFT JOIN o USING (thread_id)
    UNION ALL SELECT 'alongside', x, a.n, NULL, NULL, coalesce(display_name, '(unknown)') FROM a LEFT JOIN identities ON canonical_id = x UNION ALL SELECT 'talked_about', p.thread_id, p.n, lo, hi, CASE WHEN is_group THEN 'group: ' || array_to_string(w.w[1:3], ', ') || CASE WHEN len(w.w) > 3 THEN '...' ELSE '' END ELSE coalesce('1-on-1 with ' || (SELECT min(display_name) FROM thread_identity ti JOIN identities USING (canonical_id) WHERE ti.thread_id = p.thread_id), p.thread_id) END FROM p JOIN t USING (thread_id) LEFT JOIN w USING (thread_id)
    UNION ALL SELECT 'recent', message_id, 1, r.ts, r.ts, substr(body, 1, 200) FROM r JOIN messages m ON m.id = message_id""", "pm membership co threads")  # fmt: skip
def _(a):
    return G.context_packet("id-1", a.msgs, a.threads, a.thread_identity, a.membership, a.mention, a.identities)


@query("q_g15_edge_detail", """WITH g AS (SELECT 'shared_groups' AS section, a.thread_id AS item, NULL::BIGINT AS ts, NULL AS text FROM membership a JOIN membership b USING (thread_id) WHERE a.canonical_id = 'id-3' AND b.canonical_id = 'id-15' GROUP BY 2 ORDER BY 2 LIMIT 30), s AS (SELECT DISTINCT CASE WHEN mentioned_canonical_id = 'id-3' THEN 'a_in_b' ELSE 'b_in_a' END AS section, message_id AS item, ts FROM told WHERE owner IN ('id-3', 'id-15') AND mentioned_canonical_id IN ('id-3', 'id-15')),
    k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ts DESC, item) AS r FROM s), p AS (SELECT 'photos' AS section, p.id AS item, ts, asset_path AS text FROM photos p WHERE id IN (SELECT photo_id FROM photo_faces WHERE canonical_id = 'id-3') AND id IN (SELECT photo_id FROM photo_faces WHERE canonical_id = 'id-15') ORDER BY ts DESC, item LIMIT 200)
    SELECT * FROM g UNION ALL SELECT section, item, k.ts, substr(coalesce(body, ''), 1, 240) FROM k JOIN messages m ON m.id = item WHERE r <= 12 UNION ALL SELECT * FROM p""", "membership told photos photo_faces")  # fmt: skip
def _(a):
    return G.edge_detail("id-3", "id-15", a.membership, a.messages, a.threads, a.thread_identity, a.mention, a.photo_faces, a.photos)


@query("q_g15_co_photos", "SELECT a.photo_id FROM photo_faces a JOIN photo_faces b USING (photo_id) JOIN photos p ON p.id = a.photo_id WHERE a.canonical_id = 'id-3' AND b.canonical_id = 'id-5' ORDER BY p.ts DESC, a.photo_id LIMIT 200", "photo_faces photos")
def _(a):
    both = a.photo_faces.where("canonical_id = 'id-3'").select("photo_id").join(a.photo_faces.where("canonical_id = 'id-5'").select("photo_id"), "photo_id", "left_semi")
    return both.join(a.photos.select(F.col("id").alias("photo_id"), "ts"), "photo_id").orderBy(F.col("ts").desc(), "photo_id").limit(200).select("photo_id")
