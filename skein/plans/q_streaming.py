"""Queries that run as streams over the events table until it is drained (T rows)."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, shared_folder
from ..streaming import spool
from .adapters import DAY, HOUR
from .catalog import Archive, query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def messages(a: Archive) -> DataFrame:
    """The events table as a stream of messages, a thread for each user."""
    raw = a.spark.readStream.schema(EVENTS).parquet(f"{a.sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    return raw.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_type")


def drained(a: Archive, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream, written micro-batch by micro-batch to the shared folder; a complete result replaces the one before."""
    home = f"{shared_folder(a.spark)}/stream-{uuid.uuid4().hex}"
    kind = "append" if mode == "append" else "overwrite"
    put = lambda df, _: df.write.mode(kind).parquet(f"{home}/rows")
    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    remove(a.spark, f"{home}/progress")
    return a.spark.read.schema(stream.schema).parquet(f"{home}/rows")


def _photos(a: Archive, rows: DataFrame) -> DataFrame:
    """Events as photos of their user, two of three with a position that changes every two hours or so."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    spot = (F.floor(at / (2 * HOUR)) % 5).cast("double")
    placed = F.col("event_id") % 3 > 0
    return rows.select(F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("owner"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"), at.alias("ts"), F.when(placed, spot / 50).alias("lat"), F.when(placed, spot / 60).alias("lng"))


@query("q_t11_stream_outings")
def _(a):
    # one photo of nobody's, far in the future, lets the watermark pass all others
    home = f"{shared_folder(a.spark)}/photos-{uuid.uuid4().hex}"
    rows = _photos(a, a.table("events"))
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit("nobody").alias("owner"), F.lit("end").alias("id"), (F.col("ts") + 90 * DAY).alias("ts"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    rows.unionByName(end).write.parquet(home)
    out = drained(a, spool.outings(a.spark.readStream.schema("owner string, id string, ts long, lat double, lng double").parquet(home)))
    remove(a.spark, home)
    return out


@query("q_t08_resumed_extract", "SELECT 'm' || CAST(event_id AS STRING) AS id, upper(event_type) AS found FROM events")
def _(a):
    # four files, one a batch; the first run dies between the second batch's results and its entry, and its checkpoint is lost
    home = f"{shared_folder(a.spark)}/extract-{uuid.uuid4().hex}"
    a.table("events").selectExpr("'m' || event_id AS id", "event_type").repartition(4).write.parquet(f"{home}/in")
    stream = lambda: a.spark.readStream.schema("id string, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    work = lambda items: items.selectExpr("id", "upper(event_type) AS found")
    left = [1]

    def dies() -> None:
        if not left:
            raise InterruptedError("killed")
        left.pop()

    try:
        spool.resumable(stream(), "id", work, f"{home}/out", f"{home}/progress-1", dies).awaitTermination()
    except StreamingQueryException:
        pass
    spool.resumable(stream(), "id", work, f"{home}/out", f"{home}/progress-2").awaitTermination()
    return spool.Ledger(a.spark, f"{home}/out").results("id string, found string")


_MS = "(epoch_us(ts) // 1000)"


@query("q_t07_stream_daily_counts", f"SELECT 't' || CAST(user_id AS STRING) AS thread_id, {_MS} // {DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(a):
    c = drained(a, spool.counts(messages(a), "1 day", delay="90 days"), "complete")
    return c.select("thread_id", F.floor(F.unix_millis("start") / DAY).alias("day"), "n")


@query("q_t05_stream_sessions", f"""WITH g AS (SELECT user_id, {_MS} AS ts, CASE WHEN {_MS} - lag({_MS}) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS o, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT 't' || CAST(user_id AS STRING) AS thread_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, k""")  # fmt: skip
def _(a):
    return drained(a, spool.sessions(messages(a), "6 hours", "90 days"), "complete")


@query("q_t01_t02_t03_stream_ingest", f"SELECT DISTINCT 'm' || CAST(e.event_id AS STRING) AS id FROM events e LEFT JOIN (SELECT user_id, max({_MS}) AS f FROM events WHERE event_type = 'signup' GROUP BY 1) x USING (user_id) WHERE x.f IS NULL OR (epoch_us(e.ts) // 1000) > x.f")
def _(a):
    base = a.table("events").where("event_type = 'signup'")
    floors = base.groupBy(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("floor"))
    return drained(a, spool.deduped(spool.above_floor(messages(a), floors), "90 days")).select("id")


@query("q_t06_stream_sliding_counts", f"SELECT 't' || CAST(user_id AS STRING) AS thread_id, k * {7 * DAY} AS start_ms, count(*) AS n FROM (SELECT user_id, unnest(range(CAST(floor(({_MS} - {30 * DAY}) / {7 * DAY}.0) AS BIGINT) + 1, {_MS} // {7 * DAY} + 1)) AS k FROM events) GROUP BY 1, 2")
def _(a):
    c = drained(a, spool.counts(messages(a), "30 days", "7 days", delay="90 days"), "complete")
    return c.select("thread_id", F.unix_millis("start").alias("start_ms"), "n")
