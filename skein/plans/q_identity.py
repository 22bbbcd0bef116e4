"""Queries of identity resolution and record linkage (I rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators.iterative import resolve_chain
from ..session import shared_folder
from ..sources import sinks
from .catalog import query

_KEY = r"""CASE WHEN s IN ('imessage', 'gmail') AND contains(x, '@') THEN 'email:' || lower(trim(x)) WHEN s IN ('imessage', 'gmail') AND len(regexp_replace(x, '\D', '', 'g')) >= 7 AND NOT regexp_matches(x, '[A-Za-z]') THEN 'phone:+' || regexp_replace(x, '\D', '', 'g') ELSE 'name:' || lower(trim(x)) END"""
_ALIASES = f"SELECT canonical_id, n, x, {_KEY} AS key FROM (SELECT canonical_id, n, unnest(aliases) AS x, sources[1] AS s FROM identities)"


@query("q_i01_alias_keys", f"SELECT canonical_id, x AS alias, key FROM ({_ALIASES})", "identities")
def _(a):
    e = a.identities.select("canonical_id", F.explode("aliases").alias("alias"), F.get("sources", F.lit(0)).alias("s"))
    return e.select("canonical_id", "alias", I.alias_key(F.col("alias"), F.col("s")).alias("key"))


def _threads(a):
    return a.identities.select("n", "aliases", F.get("sources", F.lit(0)).alias("source"))


@query("q_i02_resolve_components", f"""WITH k AS (SELECT DISTINCT n, key FROM ({_ALIASES})), e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (key)), r AS (SELECT a AS node, b AS x FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a) SELECT node AS n, min(x) AS person FROM r GROUP BY 1""", "identities")
def _(a):
    return I.resolve_components(_threads(a))


@query("q_i02_resolve_greedy")
def _(a):
    return I.resolve_greedy(_threads(a))


@query("q_i03_display_name", "SELECT n AS person, CASE WHEN n % 3 = 0 THEN lower(display_name) WHEN n % 3 = 1 THEN display_name ELSE '+1555' || CAST(n AS STRING) END AS display_name FROM identities", "identities")
def _(a):
    # a lower-case full name before a capitalised single one; a capitalised full name before both; a number where there is nothing else
    first, phone, n = F.substring_index("display_name", " ", 1), F.concat(F.lit("+1555"), F.col("n").cast("string")), F.col("n") % 3
    tried = F.when(n == 0, F.array(phone, first, F.lower("display_name"))).when(n == 1, F.array(F.get("aliases", F.lit(1)), first, F.lower("display_name"), "display_name")).otherwise(F.array(phone, F.get("aliases", F.lit(1))))
    return I.display_name(a.identities.select(F.col("n").alias("person"), F.posexplode(tried).alias("ordinal", "alias")))


@query("q_i04_attach", f"SELECT 't' || n AS thread_id, (SELECT min(k.n) FROM ({_ALIASES}) k WHERE k.key = m.key) AS person FROM ({_ALIASES}) m WHERE x LIKE '+%'", "identities")
def _(a):
    e = a.identities.select("n", F.get("sources", F.lit(0)).alias("source"), F.explode("aliases").alias("participant"))
    keys = e.select(I.alias_key(F.col("participant"), F.col("source")).alias("key"), "n").groupBy("key").agg(F.min("n").alias("person"))
    return I.attach(e.where("participant LIKE '+%'").select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("thread_id"), "participant", "source"), keys)


@query("q_i05_person_view", "SELECT id, ts FROM pm WHERE canonical_id = 'id-7'", "pm")
def _(a):
    return I.person_messages(a.messages, a.thread_identity, "id-7").select("id", "ts")


_PEOPLE = """SELECT i.canonical_id, CASE WHEN i.n % 3 = 0 THEN lower(split_part(display_name, ' ', 1)) ELSE lower(display_name) END AS name, i.sources[1] AS s, coalesce(c.n, 0) AS msgs, aliases, sources, i.n FROM identities i LEFT JOIN cnt c USING (canonical_id)"""


def _people(a):
    n = a.pm.groupBy("canonical_id").agg(F.count("*").alias("msgs"))
    name = F.when(F.col("n") % 3 == 0, F.lower(F.substring_index("display_name", " ", 1))).otherwise(F.lower("display_name"))
    return a.identities.join(n, "canonical_id", "left").select("canonical_id", name.alias("name"), "sources", F.coalesce("msgs", F.lit(0)).alias("msgs"), "aliases", "n")


_STOP_FIRST = "'a', 'an', 'the', 'me', 'you', 'us', 'them', 'i', 'mom', 'dad', 'mum', 'son', 'wife', 'mr', 'mrs', 'dr', 'guy'"


@query("q_i06_i07_merge_pairs", rf"""WITH p AS (SELECT canonical_id, msgs, sources, name AS display_name, CASE WHEN n % 7 = 0 THEN [aliases[2], aliases[3], split_part(name, ' ', 1) || ' ☆ Zane'] ELSE aliases[2:3] END AS al FROM ({_PEOPLE})),
    w AS (SELECT canonical_id, o, nm, list_filter(string_split(nm, ' '), lambda t: len(t) >= 2) AS tk FROM (SELECT canonical_id, o, trim(regexp_replace(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}\s''-]', ' ', 'g'), '\s+', ' ', 'g')) AS nm FROM (SELECT canonical_id, unnest(al) AS raw, generate_subscripts(al, 1) AS o FROM p) WHERE NOT regexp_matches(raw, '^[+\d]') AND NOT contains(raw, '@') AND regexp_matches(raw, '\p{{L}}')
        UNION ALL SELECT canonical_id, 100, display_name FROM p)),
    best AS (SELECT canonical_id, arg_min(nm, {{'a': -len(tk), 'b': o}}) AS bn, max(len(tk)) AS bt FROM w GROUP BY 1), k AS (SELECT canonical_id, tk[1] AS first, min(o) AS o FROM w WHERE len(tk[1]) >= 3 AND tk[1] NOT IN ({_STOP_FIRST}) GROUP BY 1, 2),
    g AS (SELECT first, min({{'m': -msgs, 'c': canonical_id, 'o': o}}) AS rank, count(DISTINCT CASE WHEN bt >= 2 AND split_part(bn, ' ', 1) = first THEN bn END) > 1 AS several FROM k JOIN best USING (canonical_id) JOIN p USING (canonical_id) GROUP BY 1),
    pr AS (SELECT a.canonical_id AS a, b.canonical_id AS b, arg_min(several, rank) AS several FROM k a JOIN k b USING (first) JOIN g USING (first) WHERE a.canonical_id < b.canonical_id GROUP BY 1, 2),
    sc AS (SELECT a, b, max(CASE WHEN x.nm = y.nm OR (x.tk[1:least(len(x.tk), len(y.tk))] = y.tk[1:least(len(x.tk), len(y.tk))] AND (len(x.tk) <> len(y.tk) OR len(x.tk) >= 2)) THEN 1.0::DOUBLE WHEN x.tk[1] = y.tk[1] AND len(x.tk[1]) >= 3 AND x.tk[1] NOT IN ({_STOP_FIRST}) AND (len(x.tk) = 1 OR len(y.tk) = 1 OR x.tk[2:] = y.tk[2:]) THEN 0.7::DOUBLE END) AS score
        FROM pr JOIN w x ON x.canonical_id = a JOIN w y ON y.canonical_id = b WHERE len(x.tk) > 0 AND len(y.tk) > 0 GROUP BY 1, 2)
    SELECT CASE WHEN p.msgs >= q.msgs THEN a ELSE b END AS winner, CASE WHEN p.msgs >= q.msgs THEN b ELSE a END AS loser, score, several AND (m.bt < 2 OR n.bt < 2) AS ambiguous FROM pr JOIN sc USING (a, b) JOIN p ON p.canonical_id = a JOIN p q ON q.canonical_id = b JOIN best m ON m.canonical_id = a JOIN best n ON n.canonical_id = b
    WHERE score IS NOT NULL AND p.msgs >= 5 AND q.msgs >= 5 AND NOT list_has_any(p.sources, q.sources) AND NOT (m.bt >= 2 AND n.bt >= 2 AND string_split(m.bn, ' ')[2:] <> string_split(n.bn, ' ')[2:])""", "identities cnt")  # fmt: skip
def _(a):
    p, starred = _people(a), F.concat(F.substring_index("name", " ", 1), F.lit(" ☆ Zane"))
    own = F.slice("aliases", 2, 2)
    return I.merge_pairs(p.select("canonical_id", F.col("name").alias("display_name"), F.when(F.col("n") % 7 == 0, F.concat(own, F.array(starred))).otherwise(own).alias("aliases"), "sources", "msgs"))


@query("q_i08_manual_merges", "SELECT w.c AS winner, l.c AS loser, 999 AS score FROM (VALUES ('ann abel', 'bob abel'), ('nobody', 'eve abel')) r(w, l) JOIN (SELECT lower(k) AS k, arg_min(canonical_id, n) AS c FROM akeys JOIN identities USING (canonical_id) GROUP BY 1) w ON w.k = r.w JOIN (SELECT lower(k) AS k, arg_min(canonical_id, n) AS c FROM akeys JOIN identities USING (canonical_id) GROUP BY 1) l ON l.k = r.l", "identities akeys")
def _(a):
    rules = a.spark.createDataFrame([("ann abel", "bob abel"), ("nobody", "eve abel")], "winner_name string, loser_name string")
    return I.manual_merges(rules, a.identities)


@query("q_i09_better_name", "SELECT canonical_id, CASE WHEN n % 2 = 0 THEN display_name ELSE display_name END AS name FROM identities", "identities")
def _(a):
    return a.identities.select("canonical_id", I.better_name(F.get("aliases", F.lit(1)), F.col("display_name")).alias("name"))


_MAP = "SELECT 'id-' || CAST(n AS STRING) AS loser, 'id-' || CAST(n // 2 AS STRING) AS winner, n AS ordinal FROM identities WHERE n > 0 AND n % 5 <> 0"


def _mapping(a):
    return a.identities.where("n > 0 AND n % 5 <> 0").selectExpr("'id-' || n AS loser", "'id-' || (n div 2) AS winner", "n AS ordinal")


@query("q_i10_resolve_chain", f"WITH m AS ({_MAP}), r AS (SELECT loser, winner FROM m UNION ALL SELECT r.loser, m.winner FROM r JOIN m ON m.loser = r.winner) SELECT loser, winner FROM r WHERE winner NOT IN (SELECT loser FROM m)", "identities")
def _(a):
    return resolve_chain(_mapping(a))


@query("q_i11_fold", f"WITH m AS ({_MAP}), f AS (SELECT loser, winner FROM m WHERE winner NOT IN (SELECT loser FROM m)) SELECT DISTINCT photo_id, coalesce(f.winner, p.canonical_id) AS canonical_id FROM photo_faces p LEFT JOIN f ON f.loser = p.canonical_id", "identities photo_faces")
def _(a):
    m = _mapping(a)
    m = m.join(m.select(F.col("loser").alias("winner")), "winner", "left_anti")
    return I.fold(a.identities, {"faces": (a.photo_faces, ["canonical_id"])}, m)["faces"].select("photo_id", "canonical_id")


@query("q_i12_case_variants", f"SELECT lower(trim(name)) AS k, count(*) AS n, arg_max(canonical_id, {{'m': msgs, 'c': canonical_id}}) AS winner, max(name) AS best_name FROM ({_PEOPLE}) GROUP BY 1 HAVING count(*) > 1", "identities cnt")
def _(a):
    return I.case_variants(_people(a).drop("aliases", "n"))


@query("q_i13_duplicates", """WITH p AS (SELECT DISTINCT canonical_id, kind, key FROM (SELECT canonical_id, 'phone' AS kind, aliases[3] AS key FROM identities UNION ALL SELECT canonical_id, 'email', aliases[2] FROM identities UNION ALL SELECT canonical_id, 'token', unnest([split_part(display_name, ' ', 2), regexp_extract(aliases[2], '^[a-z]+')]) FROM identities) WHERE canonical_id <> 'id-0'), n AS (SELECT canonical_id, string_split(lower(display_name), ' ') AS t FROM identities),
    s AS (SELECT kind, key FROM p GROUP BY ALL HAVING count(*) > 1 AND count(*) <= CASE kind WHEN 'token' THEN 12 ELSE 6 END) SELECT a.canonical_id AS a, b.canonical_id AS b, CAST(sum(CASE a.kind WHEN 'token' THEN 1 ELSE 3 END) AS INT) AS score, array_to_string(list_sort(list(DISTINCT a.kind)), ',') AS reasons
    FROM p a JOIN p b ON a.kind = b.kind AND a.key = b.key AND a.canonical_id < b.canonical_id JOIN s ON s.kind = a.kind AND s.key = a.key JOIN n x ON x.canonical_id = a.canonical_id JOIN n y ON y.canonical_id = b.canonical_id WHERE a.kind <> 'token' OR (list_has_any(x.t, y.t) AND least(len(x.t), len(y.t)) <= 3) GROUP BY a.canonical_id, b.canonical_id HAVING sum(CASE a.kind WHEN 'token' THEN 1 ELSE 3 END) >= 2""", "identities")  # fmt: skip
def _(a):
    i = a.identities
    k = lambda kind, key: i.select("canonical_id", F.lit(kind).alias("kind"), key.alias("key"))
    p = k("phone", F.get("aliases", F.lit(2))).union(k("email", F.get("aliases", F.lit(1)))).union(k("token", F.substring_index("display_name", " ", -1))).union(k("token", F.regexp_extract(F.get("aliases", F.lit(1)), "^[a-z]+", 0)))
    p = p.union(i.select("canonical_id", F.lit("display").alias("kind"), F.explode(F.split(F.lower("display_name"), " ")).alias("key")))
    return I.duplicates(p, "id-0").withColumn("score", F.col("score").cast("int"))


@query("q_i14_saved_merges", "SELECT r.rule, CASE WHEN k.n = 1 THEN k.c END AS canonical_id, CASE WHEN k.n IS NULL THEN 'not-found' WHEN k.n > 1 THEN 'ambiguous' ELSE 'ok' END AS state FROM (VALUES (1, 'Ann Abel'), (2, '+15551000'), (3, 'nobody')) r(rule, alias) LEFT JOIN (SELECT k AS alias, count(*) AS n, min(canonical_id) AS c FROM akeys GROUP BY 1) k USING (alias)", "identities akeys")
def _(a):
    return I.saved_merges(a.spark.createDataFrame([(1, "Ann Abel"), (2, "+15551000"), (3, "nobody")], "rule int, alias string"), a.identities)


_THIRD = "SELECT ti.canonical_id, n.mentioned_canonical_id AS third, count(*) AS n FROM mention n JOIN thread_identity ti USING (thread_id) GROUP BY ALL"


@query("q_i15_third_party_overlap", f"""WITH c AS (SELECT canonical_id, count(*) AS n, min(ts) AS f, max(ts) AS l FROM pm WHERE coalesce(body, '') <> '' GROUP BY 1 HAVING count(*) > 20), p AS (SELECT c.canonical_id, sources[1] AS side, f, l FROM c JOIN identities USING (canonical_id) WHERE len(sources) = 1 AND sources[1] IN ('instagram', 'imessage')),
    m AS (SELECT t.* FROM ({_THIRD}) t JOIN p USING (canonical_id) WHERE t.canonical_id <> third), k AS (SELECT count(DISTINCT canonical_id) AS k FROM m), d AS (SELECT third, count(DISTINCT canonical_id) AS df FROM m GROUP BY 1), z AS (SELECT canonical_id FROM m GROUP BY 1 HAVING count(*) >= 5),
    w AS (SELECT m.*, p.side, p.f, p.l, ln((k.k + 1) / df) AS idf FROM m JOIN z USING (canonical_id) JOIN p USING (canonical_id) JOIN d USING (third), k WHERE df < greatest(3, ceil(k.k / 2))), s AS (SELECT canonical_id, sum(n * idf) AS t FROM w GROUP BY 1),
    j AS (SELECT a.canonical_id AS a, b.canonical_id AS b, third, least(a.n, b.n) * a.idf AS low, greatest(0, least(a.l, b.l) - greatest(a.f, b.f)) AS ms FROM w a JOIN w b USING (third) WHERE a.side = 'instagram' AND b.side = 'imessage')
    SELECT a, b, shared, round(low / (x.t + y.t - low), 6) AS jaccard, CAST(floor(ms / 86400000 + 0.5) AS BIGINT) AS overlap_days, top_shared FROM (SELECT a, b, count(*) AS shared, sum(low) AS low, any_value(ms) AS ms, array_to_string(list(third ORDER BY low DESC, third)[1:6], ',') AS top_shared FROM j GROUP BY 1, 2) JOIN s x ON x.canonical_id = a JOIN s y ON y.canonical_id = b WHERE round(low / (x.t + y.t - low), 6) >= 0.1""", "mention thread_identity identities pm")  # fmt: skip
def _(a):
    m = a.mention.join(a.thread_identity, "thread_id").groupBy("canonical_id", F.col("mentioned_canonical_id").alias("third")).agg(F.count("*").alias("n"))
    return I.third_party_overlap(m, I.audited(a.pm, a.identities, over=20))


_MIXED = "CASE WHEN ts % 7 < 3 AND thread_id LIKE 'g%' THEN 't' || substr(thread_id, 2) ELSE thread_id END"


@query("q_i17_misclassified_groups", f"""WITH w AS (SELECT thread_id, list_sort(list(DISTINCT sender_name)) AS s FROM (SELECT {_MIXED} AS thread_id, sender_name FROM messages) GROUP BY 1 HAVING count(DISTINCT sender_name) >= 3)
    SELECT t.thread_id, t.source, t.is_group OR w.s IS NOT NULL AS is_group, array_to_string(CASE WHEN NOT t.is_group AND w.s IS NOT NULL THEN w.s ELSE t.participants END, ',') AS participants, CASE WHEN t.is_group OR w.s IS NULL THEN ti.canonical_id END AS canonical_id FROM threads t LEFT JOIN w USING (thread_id) LEFT JOIN thread_identity ti USING (thread_id)""", "messages threads thread_identity")  # fmt: skip
def _(a):
    root = f"{shared_folder(a.spark)}/groups-{uuid.uuid4().hex}"
    sinks.publish_together(a.spark, {"threads": a.threads, "thread_identity": a.thread_identity}, root, "v1")
    old = sinks.together(a.spark, root)
    sinks.publish_together(a.spark, I.reclassified(a.messages.withColumn("thread_id", F.expr(_MIXED)), old["threads"], old["thread_identity"]), root, "v2")
    new = sinks.together(a.spark, root)
    return new["threads"].withColumn("participants", F.array_join("participants", ",")).join(new["thread_identity"], "thread_id", "left")


@query("q_i19_anchors", """WITH d AS (SELECT lower(display_name) AS k, count(*) AS c, min(canonical_id) AS v FROM identities GROUP BY 1), h AS (SELECT lower(k) AS k, count(DISTINCT canonical_id) AS c, min(canonical_id) AS v FROM akeys WHERE contains(k, '@') GROUP BY 1)
    SELECT i.n AS key, CASE WHEN d.c = 1 THEN d.v WHEN d.c > 1 THEN NULL WHEN h.c = 1 THEN h.v END AS canonical_id FROM identities i LEFT JOIN d ON d.k = lower(CASE WHEN i.n % 2 = 0 THEN i.display_name ELSE 'x' END) LEFT JOIN h ON h.k = lower(i.aliases[2])""", "identities akeys")  # fmt: skip
def _(a):
    w = a.identities.select(F.col("n").alias("key"), F.when(F.col("n") % 2 == 0, F.col("display_name")).otherwise("x").alias("name"), F.get("aliases", F.lit(1)).alias("handle"))
    return I.anchors(a.identities, w)


@query("q_i20_relink", """WITH s AS (SELECT n AS key, 'id-' || CAST((CASE WHEN n % 4 = 0 THEN n + 1 ELSE n END) AS STRING) AS cid, CASE WHEN n % 7 = 0 THEN 'gone' ELSE display_name END AS name FROM identities), b AS (SELECT lower(display_name) AS k, count(*) AS c, min(canonical_id) AS v FROM identities GROUP BY 1)
    SELECT s.key, CASE WHEN lower(i.display_name) = lower(s.name) THEN s.cid WHEN b.c = 1 THEN b.v END AS canonical_id, CASE WHEN lower(i.display_name) = lower(s.name) THEN 'kept' WHEN b.c = 1 THEN 'moved' WHEN b.c > 1 THEN 'ambiguous' ELSE 'lost' END AS state FROM s LEFT JOIN identities i ON i.canonical_id = s.cid LEFT JOIN b ON b.k = lower(s.name)""", "identities")  # fmt: skip
def _(a):
    s = a.identities.selectExpr("n AS key", "'id-' || (CASE WHEN n % 4 = 0 THEN n + 1 ELSE n END) AS canonical_id", "CASE WHEN n % 7 = 0 THEN 'gone' ELSE display_name END AS name")
    return I.relink(s, a.identities)


@query("q_i21_rule_drift", "SELECT column0 AS canonical_id FROM (VALUES ('id-1'), ('id-2'), ('id-999999')) v WHERE column0 NOT IN (SELECT canonical_id FROM identities)".replace("column0", "c").replace(") v WHERE", ") v(c) WHERE"), "identities")
def _(a):
    return a.spark.createDataFrame([("id-1",), ("id-2",), ("id-999999",)], "canonical_id string").join(a.identities, "canonical_id", "left_anti")


@query("q_i18_i22_m01_search", "SELECT i.canonical_id, i.display_name, array_to_string(i.aliases, ',') AS aliases, array_to_string(i.sources, ',') AS sources, coalesce(c.n, 0) AS message_count, coalesce(same_as, '') AS same_as, i.display_name IN (SELECT name FROM portraits) AS has_portrait FROM identities i LEFT JOIN cnt c USING (canonical_id) LEFT JOIN same USING (canonical_id) WHERE i.display_name ILIKE '%ann%' OR len(list_filter(i.aliases, lambda x: x ILIKE '%ann%')) > 0 ORDER BY coalesce(c.n, 0) DESC, 1 LIMIT 20", "identities cnt same portraits")
def _(a):
    return I.search(a.identities, a.messages, a.thread_identity, "ann", a.merges, a.portraits).withColumns({c: F.array_join(c, ",") for c in ("aliases", "sources")})


@query("q_i16_alias_config", """WITH s(thread_id, name) AS (VALUES ('t1', 'Zed Two'), ('t2', 'Zed Two'), ('t3', 'Amy Three')), n AS (SELECT name, 'id-' || CAST((SELECT max(n) FROM identities) + row_number() OVER (ORDER BY name) AS STRING) AS id FROM (SELECT DISTINCT name FROM s))
    SELECT canonical_id, CASE WHEN canonical_id = 'id-5' THEN 'Renamed' ELSE display_name END AS display_name, array_to_string(sources, ',') AS sources FROM identities UNION ALL
    SELECT n.id, n.name, coalesce(array_to_string(list_sort(list(DISTINCT m.source)), ','), '') FROM n JOIN s USING (name) LEFT JOIN messages m USING (thread_id) GROUP BY 1, 2""", "identities messages")  # fmt: skip
def _(a):
    renames = a.spark.createDataFrame([("id-5", "Renamed")], "canonical_id string, name string")
    splits = a.spark.createDataFrame([("t1", "Zed Two"), ("t2", "Zed Two"), ("t3", "Amy Three")], "thread_id string, name string")
    people, _ = I.apply_config(a.identities.drop("n"), a.thread_identity, a.messages, renames, splits)
    return people.select("canonical_id", "display_name", F.array_join("sources", ",").alias("sources"))
