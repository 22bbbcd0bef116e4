"""Queries of aggregation, windows, sampling and sets (Q rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .catalog import query

_M, _N = 50, 12


@query("q_q01_q02_q03_group", "SELECT source, count(*) AS n, CAST(sum(ts) AS DOUBLE) AS s, min(ts) AS lo, max(ts) AS hi, round(avg(value), 6) AS mean, count(DISTINCT thread_id) AS threads, count(*) FILTER (WHERE from_me) AS mine FROM messages GROUP BY source", "messages")
def _(a):
    return a.messages.groupBy("source").agg(F.count("*").alias("n"), F.sum("ts").cast("double").alias("s"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("thread_id").alias("threads"), F.count_if("from_me").alias("mine"))


@query("q_q04_list_distinct", "SELECT thread_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM messages GROUP BY 1", "messages")
def _(a):
    return a.messages.groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("q_q05_arg_max", "SELECT thread_id, arg_max(attachment_type || '@' || id, ts) AS last_attachment FROM messages WHERE attachment_type IS NOT NULL GROUP BY 1", "messages")
def _(a):
    m = a.messages.withColumn("last_attachment", F.concat("attachment_type", F.lit("@"), "id"))
    return A.arg_max(m, ["thread_id"], "last_attachment", ["ts", "id"])


@query("q_q06_any_value", "SELECT thread_id, any_value(thread_id || '!') AS some FROM messages GROUP BY 1", "messages")
def _(a):
    return a.messages.groupBy("thread_id").agg(F.any_value(F.concat("thread_id", F.lit("!"))).alias("some"))


@query("q_q07_median", "SELECT source, median(value) AS mid, coalesce(median(CASE WHEN value > 1e9 THEN value END), 0.0) AS none FROM messages GROUP BY 1", "messages")
def _(a):
    return a.messages.groupBy("source").agg(F.median("value").alias("mid"), F.coalesce(F.median(F.when(F.col("value") > 1e9, F.col("value"))), F.lit(0.0)).alias("none"))


@query("q_q08_q09_two_level", "SELECT is_group, count(*) AS threads, CAST(sum(n) AS BIGINT) AS n FROM (SELECT thread_id, starts_with(thread_id, 'g') AS is_group, count(*) AS n FROM messages GROUP BY 1 HAVING count(*) > 10) GROUP BY 1", "messages")
def _(a):
    n = a.messages.groupBy("thread_id").agg(F.count("*").alias("n")).where("n > 10").withColumn("is_group", F.col("thread_id").startswith("g"))
    return n.groupBy("is_group").agg(F.count("*").alias("threads"), F.sum("n").alias("n"))


@query("q_q10_top_per_group", "SELECT thread_id, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts DESC, id) AS r FROM messages) WHERE r <= 3", "messages")
def _(a):
    return A.top_per_group(a.messages, ["thread_id"], [F.col("ts").desc(), F.col("id")], 3).select("thread_id", "id", "ts")


@query("q_q11_q12_top_k", "SELECT photo_id, city, lat FROM places ORDER BY city DESC NULLS LAST, lat, photo_id LIMIT 25", "places")
def _(a):
    return a.places.orderBy(F.desc_nulls_last("city"), "lat", "photo_id").limit(25).select("photo_id", "city", "lat")


_ANCHOR = 1_705_000_000_000


@query("q_q13_m03_window", f"SELECT id, ts FROM (SELECT * FROM messages WHERE thread_id = 'g3' AND ts <= {_ANCHOR} ORDER BY ts DESC, id DESC LIMIT 11) UNION ALL SELECT id, ts FROM (SELECT * FROM messages WHERE thread_id = 'g3' AND ts > {_ANCHOR} ORDER BY ts, id LIMIT 10)", "messages")
def _(a):
    from ..operators.retrieval import conversation

    return conversation(a.messages, "g3", _ANCHOR, 10, 10).select("id", "ts")


@query("q_q14_q16_union_distinct", "SELECT canonical_id FROM photo_faces UNION SELECT canonical_id FROM thread_identity", "photo_faces thread_identity")
def _(a):
    return a.photo_faces.select("canonical_id").union(a.thread_identity.select("canonical_id")).distinct()


@query("q_q15_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'message' AS kind FROM messages UNION ALL SELECT 'call' FROM calls UNION ALL SELECT 'photo' FROM photos) GROUP BY 1", "messages calls photos")
def _(a):
    k = lambda df, name: df.select(F.lit(name).alias("kind"))
    return k(a.messages, "message").unionByName(k(a.calls, "call")).unionByName(k(a.photos, "photo")).groupBy("kind").agg(F.count("*").alias("n"))


@query("q_q17_group_by_array", "SELECT array_to_string(sources, ',') AS s, count(*) AS n FROM (SELECT sources, count(*) AS n FROM identities GROUP BY sources, canonical_id) GROUP BY 1", "identities")
def _(a):
    return a.identities.groupBy("sources").agg(F.count("*").alias("n")).select(F.array_join("sources", ",").alias("s"), "n")


@query("q_q18_systematic_sample", f"""SELECT thread_id, id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM messages)
    WHERE n <= {_N} OR i IN (SELECT unnest(list_transform(range({_N}), lambda k: k * n // {_N})))""", "messages")  # fmt: skip
def _(a):
    return A.systematic(a.messages, ["thread_id"], ["ts", "id"], _N).select("thread_id", "id")


@query("q_q19_stride_sample", "SELECT thread_id, id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM messages) WHERE i % greatest(1, n // 8) = 0 AND i // greatest(1, n // 8) < 8", "messages")
def _(a):
    return A.stride(a.messages, ["thread_id"], ["ts", "id"], 8).select("thread_id", "id")


@query("q_q20_a05_head_middle_tail", f"""SELECT thread_id, id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM messages)
    WHERE n <= 40 OR i < 10 OR i >= n - 10 OR (i >= (n - 20) // 2 AND i < (n - 20) // 2 + 20)""", "messages")  # fmt: skip
def _(a):
    return A.head_middle_tail(a.messages, ["thread_id"], ["ts", "id"], 40).select("thread_id", "id")


@query("q_q21_shares", "WITH n AS (SELECT canonical_id, count(*) AS c FROM photo_faces GROUP BY 1), t AS (SELECT c FROM n ORDER BY c DESC, canonical_id LIMIT 5) SELECT max(t.c) / (SELECT sum(c) FROM n) AS top1_share, sum(t.c) / (SELECT sum(c) FROM n) AS topk_share FROM t", "photo_faces")
def _(a):
    return A.shares(a.photo_faces.groupBy("canonical_id").agg(F.count("*").alias("c")), "c", "canonical_id", 5)


@query("q_q22_month_spine", """WITH m AS (SELECT source, date_trunc('month', make_timestamp(ts * 1000))::DATE AS mo, count(*) AS n FROM photos GROUP BY ALL), s AS (SELECT source, unnest(generate_series(min(mo), max(mo), INTERVAL 1 MONTH))::DATE AS mo FROM m GROUP BY source)
    SELECT s.source, strftime(s.mo, '%Y-%m') AS month, coalesce(m.n, 0) AS n FROM s LEFT JOIN m USING (source, mo)""", "photos")  # fmt: skip
def _(a):
    return A.months(a.photos, ["source"], "ts", F.count("*"))


@query("q_x_lag_running", "SELECT id, ts - lag(ts) OVER w AS gap, count(*) OVER (PARTITION BY thread_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS nth FROM messages WINDOW w AS (PARTITION BY thread_id ORDER BY ts, id)", "messages")
def _(a):
    w = Window.partitionBy("thread_id").orderBy("ts", "id")
    return a.messages.select("id", (F.col("ts") - F.lag("ts").over(w)).alias("gap"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))
