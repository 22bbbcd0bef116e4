"""Shared pieces of the SQL twins: common table expressions over archive tables, by name."""

from __future__ import annotations

MEANINGFUL = r"(coalesce(body, '') <> '' AND attachment_type IS NULL AND NOT regexp_matches(body, '^Reacted |^Liked |sent an attachment\.?$|^Tapback') AND NOT (starts_with(body, 'http') AND len(regexp_split_to_array(body, '\s+')) < 3))"
DAY = 86_400_000
NOW = 1_709_251_200_000  # 2024-03-01, after the last event
LATER = 1_719_792_000_000  # 2024-07-01

#: Zone rules: order, person, first and last day, zone, label; and for the SQL twins its short name and offset in minutes, in January.
ZONE_RULES = (
    (0, "me", None, "2024-01-16", "Australia/Melbourne", "MEL", "MEL", 660), (1, "me", "2024-01-16", None, "America/Chicago", "CHI", "CST", -360),
    (2, "id-1", "2024-01-01", "2024-01-15", "Asia/Tokyo", "TYO", "TYO", 540), (3, "id-1", "2024-01-10", "2024-12-31", "America/New_York", "NYC", "EST", -300),
    (4, "id-2", "2024-01-05", "2024-01-25", "Asia/Kolkata", None, "GMT+5:30", 330), (5, "id-3", None, None, "Pacific/Auckland", "AKL", "AKL", 780), (6, "id-4", None, None, "America/Chicago", "CHI", "CST", -360),
)


def _rules() -> str:
    day = lambda d: f"DATE '{d}'" if d else "NULL::DATE"
    rows = ", ".join(f"({n}, '{who}', {day(a)}, {day(b)}, '{label or zone}', '{tag}', {off})" for n, who, a, b, zone, label, tag, off in ZONE_RULES)
    return f"SELECT * FROM (VALUES {rows}) v(n, cid, a, b, label, tag, off)"


def zone_of(person: str, ts: str) -> str:
    """SQL for the first rule of a person that holds a moment's UTC day, as a struct."""
    day = f"make_timestamp({ts} * 1000)::DATE"
    return f"(SELECT arg_min(struct_pack(label := label, tag := tag, off := off), n) FROM rules WHERE cid = {person} AND (a IS NULL OR {day} >= a) AND (b IS NULL OR {day} < b))"


FRAGMENTS = {
    "rules": _rules(),
    "nodes": "SELECT canonical_id, display_name, count(*) AS msg_count FROM pm JOIN (SELECT thread_id, is_group FROM threads) USING (thread_id) JOIN (SELECT canonical_id, display_name FROM identities) USING (canonical_id) WHERE meaningful AND NOT is_group AND canonical_id <> 'id-0' AND NOT regexp_matches(lower(display_name), 'facebook user|instagram user') GROUP BY 1, 2 HAVING count(*) >= 30 ORDER BY 3 DESC, 1 LIMIT 80",
    "told": "SELECT ti.canonical_id AS owner, n.* FROM mention n JOIN threads t ON t.thread_id = n.thread_id AND NOT t.is_group JOIN thread_identity ti ON ti.thread_id = n.thread_id WHERE ti.canonical_id <> n.mentioned_canonical_id",
    "merges": "SELECT a.display_name AS winner_name, b.display_name AS loser_name FROM identities a JOIN identities b ON b.n = a.n + 7",
    "portraits": "SELECT DISTINCT sender_name AS name FROM messages WHERE contains(body, 'birthday')",
    "same": "SELECT a AS canonical_id, string_agg(DISTINCT b, ',' ORDER BY b) AS same_as FROM (SELECT x.id AS a, y.id AS b FROM one x JOIN merges ON x.name = winner_name JOIN one y ON y.name = loser_name UNION SELECT y.id, x.id FROM one x JOIN merges ON x.name = winner_name JOIN one y ON y.name = loser_name) WHERE a <> b GROUP BY 1",
    "one": "SELECT display_name AS name, min(canonical_id) AS id FROM identities GROUP BY 1 HAVING count(*) = 1",
    "mine": f"SELECT *, make_timestamp(ts * 1000) + to_minutes(CAST(coalesce(z.off, 0) AS BIGINT)) AS local, coalesce(z.tag, 'UTC') AS tag FROM (SELECT *, {zone_of("'me'", 'ts')} AS z FROM msgs)",
    "msgs": f"SELECT *, {MEANINGFUL} AS meaningful FROM messages",
    "pm": "SELECT m.*, ti.canonical_id FROM msgs m JOIN thread_identity ti USING (thread_id)",
    "akeys": "SELECT DISTINCT canonical_id, k FROM (SELECT canonical_id, unnest(list_append(aliases, display_name)) AS k FROM identities)",
    "cnt": "SELECT canonical_id, count(*) AS n FROM messages JOIN thread_identity USING (thread_id) GROUP BY 1",
    "membership": """SELECT thread_id, participant_name, canonical_id FROM (
        SELECT n.thread_id, n.participant_name, a.canonical_id, row_number() OVER (PARTITION BY n.thread_id, n.participant_name ORDER BY coalesce(c.n, 0) DESC, a.canonical_id ASC NULLS LAST) AS r
        FROM (SELECT DISTINCT thread_id, unnest(participants) AS participant_name FROM threads WHERE is_group) n LEFT JOIN akeys a ON a.k = n.participant_name LEFT JOIN cnt c USING (canonical_id)) WHERE r = 1""",
    "forms": r"""SELECT DISTINCT canonical_id, f FROM (SELECT canonical_id, unnest([CASE WHEN len(split_part(cl, ' ', 1)) >= 3 AND regexp_matches(split_part(cl, ' ', 1), '\p{L}') THEN lower(split_part(cl, ' ', 1)) END, CASE WHEN len(cl) <= 40 THEN lower(cl) END]) AS f FROM (
        SELECT canonical_id, trim(regexp_replace(trim(alias), '[^\p{L}\p{N}\s''.-]', ' ', 'g')) AS cl FROM (SELECT canonical_id, unnest(list_append(aliases, display_name)) AS alias FROM identities)
        WHERE NOT contains(alias, '@') AND NOT regexp_matches(trim(alias), '^[+\d]') AND len(trim(alias)) >= 3) WHERE len(cl) >= 3) WHERE f IS NOT NULL""",
    "tokens": r"SELECT DISTINCT id, unnest(regexp_split_to_array(lower(body), '[^a-z0-9_]+')) AS w FROM msgs WHERE meaningful",
    "mention": """SELECT f.canonical_id AS mentioned_canonical_id, f.f AS mentioned_form, m.thread_id, m.id AS message_id, m.ts, m.from_me FROM forms f JOIN tokens t ON t.w = regexp_extract(f.f, '[a-z0-9_]+') JOIN msgs m ON m.id = t.id
        WHERE (f.f = t.w OR (contains(lower(m.body), f.f) AND regexp_matches(lower(m.body), '(^|[^a-z0-9_])' || regexp_escape(f.f) || '([^a-z0-9_]|$)'))) AND NOT EXISTS (SELECT 1 FROM thread_identity ti WHERE ti.thread_id = m.thread_id AND ti.canonical_id = f.canonical_id)""",
    "perday": f"SELECT thread_id, from_me, ts // {DAY} AS day, mentioned_canonical_id AS p, count(*) AS n FROM mention GROUP BY ALL",
    "co": "SELECT a.p AS a, b.p AS b, a.thread_id, a.day, CAST(sum(a.n * b.n) AS BIGINT) AS weight FROM perday a JOIN perday b ON a.thread_id = b.thread_id AND a.from_me = b.from_me AND a.day = b.day AND a.p < b.p GROUP BY ALL",
    "seen": "SELECT event_id, start_ts, source, year(make_timestamp(start_ts * 1000)) AS y, unnest(participants) AS canonical_id FROM gatherings",
    "ep": "SELECT event_id, 'p' || substr(event_id, 2) AS photo_id FROM gatherings",
}
#: What each fragment needs ahead of it: archive tables and fragments.
NEEDS = {
    "mine": ("messages", "msgs", "rules"), "merges": ("identities",), "portraits": ("messages",), "same": ("identities", "merges", "one"),
    "msgs": ("messages",), "pm": ("messages", "thread_identity", "msgs"), "akeys": ("identities",), "cnt": ("messages", "thread_identity"),
    "membership": ("messages", "thread_identity", "identities", "threads", "akeys", "cnt"), "forms": ("identities",),
    "mention": ("messages", "thread_identity", "identities", "msgs", "forms", "tokens"), "seen": ("gatherings",), "ep": ("gatherings",),
}
NEEDS["nodes"] = (*NEEDS["pm"], "pm", "threads", "identities")
NEEDS["told"] = (*NEEDS["mention"], "mention", "threads")
NEEDS["perday"] = (*NEEDS["mention"], "mention")
NEEDS["co"] = (*NEEDS["perday"], "perday")
