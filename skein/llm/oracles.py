"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .licenses import BASE, COVERAGE, NEIGHBOURS, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, n: int) -> str:
    return f"""SELECT DISTINCT {key} AS id, array_to_string(w[i : i + least({n}, len(w)) - 1], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM (SELECT {key}, {_words('text', True)} AS w FROM {table}) WHERE len(w) > 0)"""


NEAR_DUPLICATES = f"""WITH RECURSIVE s AS MATERIALIZED ({_shingles('documents', 'doc_id', 3)}), n AS (SELECT id, count(*) AS k FROM s GROUP BY 1),
    c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE 100 * c.k >= 85 * (x.k + y.k - c.k)), l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a), m AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, d.doc_id = coalesce(m.component, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""

DECONTAMINATION = f"""WITH d AS MATERIALIZED ({_shingles('documents', 'doc_id', 5)}), b AS MATERIALIZED ({_shingles('benchmark', 'item_id', 5)}), n AS (SELECT id, count(*) AS k FROM b GROUP BY 1), c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM d JOIN b USING (s) GROUP BY 1, 2)
    SELECT doc_id, item_id, CAST(n.k AS INT) AS n_item_shingles, CAST(c.k AS INT) AS n_common, c.k / n.k AS containment FROM c JOIN n ON n.id = c.item_id WHERE c.k >= 0.8 * n.k"""

SUBSTRINGS = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', False)} AS w FROM documents), s AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY 1), g AS (SELECT s.doc_id, s.i FROM s JOIN f USING (h) WHERE f.first < s.doc_id), x AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range(0, 50)) AS j)),
    p AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)), k AS (SELECT p.doc_id, string_agg(p.t, ' ' ORDER BY p.i) AS t FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i WHERE x.i IS NULL GROUP BY 1), q AS (SELECT doc_id, count(*) AS gone FROM x GROUP BY 1)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(q.gone, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)"""


def _pairs() -> str:
    rows = []
    for number, (phrase, label) in enumerate((*BASE, *TEMPLATES)):
        words = phrase.split(" ")
        rows += [f"({number}, '{label}', {str(number < len(BASE)).lower()}, {len(words) - 1}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(template, label, base, pairs, tpos, t1, t2)"


LICENSES = rf"""WITH t AS ({_pairs()}), d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, i - 1 AS p, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)), h AS (SELECT DISTINCT doc_id, template, label, base, pairs, p - tpos AS diagonal, tpos FROM p JOIN t ON w1 = t1 AND w2 = t2),
    o AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {NEIGHBOURS} OR lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) IS NULL THEN 1 ELSE 0 END AS opens FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM h)),
    s AS (SELECT doc_id, template, diagonal, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM o), g AS (SELECT h.doc_id, h.label, h.base, h.pairs, min(h.diagonal) AS spot, count(DISTINCT h.tpos) AS met FROM h JOIN s ON s.doc_id = h.doc_id AND s.template = h.template AND s.diagonal = h.diagonal GROUP BY h.doc_id, h.template, h.label, h.base, h.pairs, s.span),
    b AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM g WHERE base AND met = pairs GROUP BY 1),
    m AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(met / pairs) AS score FROM g WHERE CASE WHEN base THEN met = pairs ELSE met / pairs >= {COVERAGE}::DOUBLE END GROUP BY 1)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""

REPEATED_BYTES = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), s AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS a, md5_number_lower(substr(x, 2 * i + 1, 800)) AS b FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)),
    m AS MATERIALIZED (SELECT doc_id, i FROM s SEMI JOIN (SELECT a, b FROM s GROUP BY 1, 2 HAVING count(*) > 1) USING (a, b)), o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS opens FROM m),
    r AS MATERIALIZED (SELECT doc_id, min(i) AS first, max(i) + 400 AS stop FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY doc_id, k),
    e AS (SELECT doc_id, first, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS since FROM r), k AS (SELECT e.doc_id, string_agg(substr(x, 2 * since + 1, 2 * (first - since)), '' ORDER BY first) || substr(any_value(x), 2 * max(stop) + 1) AS h, sum(stop - first) AS gone, count(*) AS spans FROM e JOIN d USING (doc_id) GROUP BY 1)
    SELECT d.doc_id, len(d.x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(h, d.x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1), c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, '[' || substr(filter_order, 1, step) || ']' AS upto, CASE WHEN step = 1 THEN '[^A-E]' ELSE '[' || substr(filter_order, 1, step - 1) || ']' END AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, filter, n, good, toxic, regexp_matches(fails, upto) AS gone, regexp_matches(fails, earlier) AS before, contains(fails, filter) AS fails_it, fails = filter AS alone FROM c, s),
    g AS (SELECT part, filter_order, CAST(step AS INT) AS step, filter, sum(CASE WHEN gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN fails_it AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails_it AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails_it AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails_it AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""


def _runs(table: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT {key} AS id, {words} AS w FROM {table})"""


RESAMPLING = rf"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
    df AS MATERIALIZED ({_runs('documents', 'doc_id')}), tf AS MATERIALIZED ({_runs('benchmark', 'item_id')}), v AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM tf)),
    b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1)), lambda c, y: xor(c // 256, tab[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS b FROM v, tab),
    s AS (SELECT b, count(*) AS n FROM df JOIN b USING (f) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM tf JOIN b USING (f) GROUP BY 1), e AS (SELECT (SELECT count(*) FROM df) AS s, (SELECT count(*) FROM tf) AS t),
    g AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (e.s + 10000) / ((s.n + 1)::DOUBLE * (e.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), e),
    m AS (SELECT id, count(*) AS n, sum(gain) AS gain FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY 1), p AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || doc_id), i, 1)) - 1)), lambda a, c: 16 * a + c) AS h FROM documents LEFT JOIN m ON id = doc_id),
    q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM p), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= 39)
    SELECT q.*, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM q LEFT JOIN r USING (doc_id)"""

ORACLE_SQL = {
    "op1_minhash_dedup": NEAR_DUPLICATES, "op3_decontamination": DECONTAMINATION, "op6_suffix_dedup": REPEATED_BYTES, "op8_substring_dedup": SUBSTRINGS, "op9_license_scan": LICENSES, "op11_filter_audit": FILTER_AUDIT, "op12_resampling": RESAMPLING,
}
