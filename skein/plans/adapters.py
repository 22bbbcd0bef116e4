"""The driver's tables seen as a message archive.

Each archive table is one SELECT over driver tables, rendered for Spark or for DuckDB, so that an
operator and its SQL twin start from the same rows. Only functions that both dialects share are used,
but for the few in `Dialect`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FIRST = "Ann,Bob,Cleo,Dev,Eve,Finn,Gus,Hana,Ivo,June,Kai,Lena,Milo,Nora,Otto,Pia,Quin,Rosa,Sven,Tess"
LAST = "Abel,Birch,Cole,Dunn,Ellis,Frost,Grant,Hale,Irwin,Jarvis,Knox,Lowe,Marsh,Nash,Orr"
#: Endings of first names, so that fifteen people share one however many there are.
ENDINGS = "a,e,i,o,u,ya,ye,yo,na,ne,ni,no,la,le,li,lo,ra,re,ri,ro"
SOURCES = "imessage,instagram,whatsapp,messenger,gmail"
PHRASES = (
    "ok cool|omw see you there|happy birthday!|http://x.example/a|Liked a photo|i feel like maybe i should go|where are you|running late sorry|"
    "i miss you|hope you are ok|we need to talk|been thinking about it|i'm here out front|Reacted to your message|see you soon|do you want lunch|"
    "https://partiful.example/e/abc123 join us|long day at work|call me later|just left"
)
SELF = "Demo User"
DAY, HOUR = 86_400_000, 3_600_000


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def ms(self, x: str) -> str:
        return f"(epoch_us({x}) // 1000)" if self.duck else f"unix_millis(CAST({x} AS TIMESTAMP))"

    def div(self, a: str, b: object) -> str:
        return f"(({a}) // {b})" if self.duck else f"(({a}) div {b})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]" if self.duck else f"array({', '.join(xs)})"

    def collected(self, x: str) -> str:
        return f"list_sort(list(DISTINCT {x}))" if self.duck else f"array_sort(collect_set({x}))"

    def pick(self, text: str, sep: str, k: str) -> str:
        text = text.replace("'", "''")
        return f"split_part('{text}', '{sep}', CAST({k} AS INT) + 1)"

    def name(self, k: str) -> str:
        more = f"CASE WHEN ({k}) >= 300 THEN {self.pick(ENDINGS, ',', self.div(k, 300) + ' % 20')} ELSE '' END"
        return f"({self.pick(FIRST, ',', f'({k}) % 20')} || {more} || ' ' || {self.pick(LAST, ',', self.div(k, 20) + ' % 15')})"


SPARK, DUCK = Dialect(False), Dialect(True)


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def select(table: str, d: Dialect) -> str:
    """The SELECT for an archive table."""
    e = "event_id"
    body = f"({d.pick(PHRASES, '|', f'({e} * 7 + user_id) % 20')} || CASE WHEN {e} % 4 = 1 THEN ' with ' || {d.name('(user_id + event_id) % 150')} WHEN {e} % 4 = 2 THEN ' and ' || lower({d.pick(FIRST, ',', '(user_id + 3 * event_id) % 20')}) ELSE '' END)"
    text = {
        "messages": f"""SELECT 'm' || {_s(e)} AS id, {d.ms('ts')} AS ts, {d.pick(SOURCES, ',', f'{e} % 5')} AS source,
            CASE WHEN {e} % 3 = 0 THEN 'g' || {_s('user_id % 12')} ELSE 't' || {_s('user_id')} END AS thread_id,
            event_type IN ('click', 'view') AS from_me, CASE WHEN event_type IN ('click', 'view') THEN '{SELF}' ELSE {d.name('user_id')} END AS sender_name,
            {body} AS body, CASE WHEN {e} % 17 = 0 THEN 'image' END AS attachment_type, CAST(value AS DOUBLE) AS value FROM events""",
        "identities": f"""SELECT 'id-' || {_s('u')} AS canonical_id, {d.name('u')} AS display_name, {d.array(d.name('u'), f"lower({d.pick(FIRST, ',', 'u % 20')}) || {_s('u % 100')} || '@mail.example'", f"'+1555' || {_s('u % 90 + 1000')}")} AS aliases,
            {d.array(d.pick(SOURCES, ',', f"(u + {d.div('u', 20)}) % 5"))} AS sources, u AS n FROM (SELECT DISTINCT user_id AS u FROM events) x""",
        "thread_identity": f"SELECT DISTINCT 't' || {_s('user_id')} AS thread_id, 'id-' || {_s('user_id')} AS canonical_id FROM events",
        "threads": f"""SELECT thread_id, min(source) AS source, CAST(max(CASE WHEN substr(thread_id, 1, 1) = 'g' THEN 1 ELSE 0 END) AS INT) = 1 AS is_group, {d.collected('name')} AS participants
            FROM (SELECT CASE WHEN {e} % 3 = 0 THEN 'g' || {_s('user_id % 12')} ELSE 't' || {_s('user_id')} END AS thread_id, {d.pick(SOURCES, ',', f'{e} % 5')} AS source, {d.name('user_id')} AS name FROM events) x GROUP BY thread_id""",
        "photos": f"""SELECT 'p' || {_s('o_orderkey')} AS id, {d.ms('o_orderdate')} AS ts, lower(o_orderpriority) AS source, 'a/' || {_s('o_orderkey')} || '.jpg' AS asset_path,
            'h' || {_s('o_custkey % 700')} AS hash_sha256, o_orderkey AS n FROM orders""",
        "places": f"""SELECT 'p' || {_s('o_orderkey')} AS photo_id, -38.2e0 + (o_custkey % 80) / 1e2 AS lat, 144.4e0 + (o_custkey % 100) / 1e2 AS lng,
            'place ' || {_s('o_custkey % 40')} AS place_name, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'city ' || {_s('o_custkey % 12')} END AS city FROM orders WHERE o_orderkey % 3 <> 0""",
        "photo_faces": f"SELECT DISTINCT 'p' || {_s('l_orderkey')} AS photo_id, 'id-' || {_s('l_suppkey % 150')} AS canonical_id FROM lineitem",
        "gatherings": f"""SELECT 'e' || {_s('o_orderkey')} AS event_id, {d.ms('min(o_orderdate)')} AS start_ts, {d.ms('min(o_orderdate)')} + count(*) * {3 * HOUR} AS end_ts, min(lower(o_orderpriority)) AS place_name,
            {d.collected(f"'id-' || {_s('l_suppkey % 150')}")} AS participants, CAST(count(*) AS INT) AS n_photos, CAST(min(o_custkey) % 7 AS INT) AS n_messages,
            CASE WHEN min(o_orderstatus) = 'P' THEN 'messages' ELSE 'photos' END AS source, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE -38.3e0 + min(o_custkey % 500) / 1e2 END AS lat, 144.4e0 + min(o_custkey % 60) / 1e1 AS lng
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
        "calls": f"""SELECT 'c' || {_s(e)} AS call_id, {d.ms('ts')} AS ts, CAST(value AS DOUBLE) AS duration_s, CASE WHEN user_id % 2 = 0 THEN 'out' ELSE 'in' END AS direction, {e} % 5 <> 0 AS answered,
            CASE WHEN {e} % 3 = 0 THEN 'com.apple.FaceTime' ELSE 'phone' END AS provider, '+1 (555) ' || {_s('user_id % 90 + 1000')} AS address FROM events WHERE event_type = 'purchase'""",
        "chat": "SELECT 'c' || CAST(conv_id AS STRING) AS thread_id, turn, role = 'user' AS from_me, text AS body FROM conversations",
        "emails": f"""SELECT 's' || {_s('c_custkey')} || '@' || lower(c_mktsegment) || '.example' AS addr, lower(c_mktsegment) || '.example' AS domain, c_name AS display_name,
            CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) END AS category, CAST(c_custkey % 50 AS INT) AS n_messages, c_acctbal > 5000 AS list_unsubscribe, c_custkey AS n FROM customer""",
        "ops": f"""SELECT {e} AS op, 'k' || {_s('user_id')} AS key, event_type AS kind, CAST(value AS DOUBLE) AS amount, {d.ms('ts')} AS updated_at FROM events""",
    }
    return text[table]


def archive(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    """The named archive tables over sf_dir."""
    needed = ("events", "orders", "lineitem", "customer", "conversations")
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needed}
    out = []
    for table in tables:
        sql = select(table, SPARK)
        for name in needed:
            for before in ("FROM ", "JOIN "):
                sql = sql.replace(f"{before}{name}", f"{before}{{{name}}}")
        used = {name: df for name, df in views.items() if f"{{{name}}}" in sql}
        out.append(spark.sql(sql, **used))
    return out
