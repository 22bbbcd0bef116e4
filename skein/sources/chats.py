"""Chat exports as message rows: JSON, HTML, text and spool formats (S-01, S-02, S-04, S-06 to S-11)."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import repair, strip
from .markup import MESSAGES, Layout, records
from .tables import reindexed

SELF = "Me"
#: Fields of a chat export's JSON files; what is missing in a file is null.
EXPORT = """participants array<struct<name: string>>, messages array<struct<sender_name: string, timestamp_ms: bigint, content: string,
    photos: array<struct<uri: string>>, videos: array<struct<uri: string>>, audio_files: array<struct<uri: string>>>>"""


def export_roots(paths: list[str], deeper: bool = True) -> list[str]:
    """S-06: existing folders once each by real path, with one level of parts below them."""
    found, seen = [], set()
    for p in paths:
        for q in [p, *(sorted(e.path for e in os.scandir(p) if e.is_dir()) if deeper and os.path.isdir(p) else [])]:
            real = os.path.realpath(q)
            if os.path.isdir(real) and real not in seen:
                seen.add(real)
                found.append(q)
    return found


def _attachment() -> Column:
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(has("m.photos"), "image").when(has("m.videos"), "video").when(has("m.audio_files"), "audio")


def chat_json(spark: SparkSession, glob: str, prefix: str, self_name: str) -> DataFrame:
    """S-01/S-04: message_*.json files, one folder a thread: rows with ids by (ts, place) within the thread."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(glob).withColumn("_path", F.input_file_name())
    folder = F.element_at(F.split(F.regexp_replace("_path", r"/[^/]*$", ""), "/"), -1)
    rows = raw.select(folder.alias("thread_id"), "_path", "participants", F.posexplode("messages").alias("_pos", "m"))
    others = F.size(F.filter(F.transform("participants", lambda p: p["name"]), lambda n: n != self_name))
    rows = rows.select(
        "thread_id", F.col("m.timestamp_ms").alias("ts"), repair(F.col("m.sender_name")).alias("sender_name"), F.coalesce(repair(F.col("m.content")), F.lit("")).alias("body"),
        _attachment().alias("attachment_type"), (others > 1).alias("is_group"), (F.col("m.sender_name") == self_name).alias("from_me"), "_path", "_pos",
    )
    return reindexed(rows, prefix, ["ts", "_path", "_pos"]).drop("_path", "_pos")


def merge_exports(rows: DataFrame, prefix: str, self_name: str) -> DataFrame:
    """S-05 over message rows (export, thread_id, ts, sender_name, body, attachment_type): copies as often as in the export that has most, ids anew."""
    from .tables import multiset_union

    key = ["thread_id", "ts", "sender_name", "body", "attachment_type"]
    merged = multiset_union(rows, key)
    named = F.filter(F.array_sort(F.collect_set("sender_name").over(Window.partitionBy("thread_id"))), lambda n: n != self_name)
    merged = merged.withColumn("participants", named).withColumn("is_group", F.size("participants") > 1)
    return reindexed(merged, prefix, ["ts", "sender_name", "body", "copy"])


def text_blocks(spark: SparkSession, glob: str) -> DataFrame:
    """S-07: text exports of blank-line blocks: a date line, a sender line, then the body; ids by place in the file, before any sort."""
    raw = spark.read.text(glob, wholetext=True).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    thread = F.regexp_replace("_file", r"\.txt$", "")
    b = raw.select(thread.alias("thread_id"), F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n\n+")).alias("_pos", "block"))
    lines = F.split(strip(F.col("block")), "\n")
    b = b.withColumn("_l", lines).withColumn("_d", F.regexp_extract(F.get("_l", F.lit(0)), r"^([A-Z][a-z]{2} \d{1,2}, \d{4}\s+\d{1,2}:\d{2}:\d{2}\s*[AP]M)", 1)).where("_d <> ''")
    body = strip(F.array_join(F.slice("_l", 3, 100_000), "\n"))
    path = F.regexp_extract(body, r"\.(\w{3,4})$", 1)
    kind = F.when(body.rlike(r"^(/|~|Attachments/)\S+\.\w+$"), F.when(F.lower(path).isin("jpg", "jpeg", "png", "gif", "heic"), "image").when(F.lower(path).isin("mov", "mp4"), "video").otherwise("other"))
    sender = F.get("_l", F.lit(1))
    out = b.select(
        "thread_id", F.concat(F.lit("imsg:"), "thread_id", F.lit("#"), "_pos").alias("id"), F.unix_millis(F.try_to_timestamp(F.regexp_replace("_d", r"\s+", " "), F.lit("MMM d, yyyy h:mm:ss a"))).alias("ts"),
        F.when(sender == SELF, "self").otherwise(sender).alias("sender_name"), (sender == SELF).alias("from_me"), body.alias("body"), kind.alias("attachment_type"), F.col("thread_id").rlike(",| - ").alias("is_group"),
    )
    return out.where((F.col("body") != "") & ~F.col("body").startswith("Tapback"))


def chat_lines(spark: SparkSession, glob: str, read_am_pm: bool = False) -> DataFrame:
    """S-08: line exports, "[d/m/y, time] name: text" or "d/m/y, time - name: text"; other lines continue the message before.

    AM/PM marks were never read by the tool that set this format; `read_am_pm` reads them.
    """
    raw = spark.read.text(glob, wholetext=True).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    l = raw.select(F.regexp_replace("_file", r"\.txt$", "").alias("thread_id"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("_n", "line"))
    head = r"^‎?\[?(\d{1,2})/(\d{1,2})/(\d{2,4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?\s?([AaPp][Mm])?\]?(?: -)? ([^:]+): (.*)$"
    part = lambda i: F.regexp_extract("line", head, i)
    l = l.withColumn("_start", F.col("line").rlike(head).cast("int"))
    l = l.withColumn("_k", F.sum("_start").over(Window.partitionBy("thread_id").orderBy("_n"))).where("_k > 0")
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3)).cast("int")
    hour = part(4).cast("int")
    if read_am_pm:
        hour = F.when(part(7) == "", hour).otherwise(hour % 12 + F.when(F.lower(part(7)) == "pm", 12).otherwise(0))
    when = F.make_timestamp(year, part(2).cast("int"), part(1).cast("int"), hour, part(5).cast("int"), F.coalesce(F.nullif(part(6), F.lit("")).cast("int"), F.lit(0)))
    first = l.where("_start = 1").select("thread_id", "_k", F.unix_millis(when).alias("ts"), part(8).alias("sender_name"))
    body = F.when(F.col("_start") == 1, part(9)).otherwise(F.col("line"))
    text = l.groupBy("thread_id", "_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", body.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    out = first.join(text, ["thread_id", "_k"]).withColumn("attachment_type", F.when(F.col("body").rlike(r"(image|video|audio|sticker|GIF|Media) omitted|<attached"), "media"))
    return out.withColumn("id", F.concat(F.lit("wa:"), "thread_id", F.lit("#"), (F.col("_k") - 1).cast("string"))).drop("_k")


SPOOL = """kind string, message struct<key: struct<remoteJid: string, id: string, fromMe: boolean, participant: string>, messageTimestamp: string, pushName: string,
    message: struct<conversation: string, extendedTextMessage: struct<text: string>, imageMessage: struct<caption: string>, videoMessage: struct<caption: string>, reactionMessage: struct<text: string>, protocolMessage: struct<type: string>,
    ephemeralMessage: struct<message: struct<conversation: string, extendedTextMessage: struct<text: string>>>, viewOnceMessage: struct<message: struct<imageMessage: struct<caption: string>>>>>"""


def spool(spark: SparkSession, path: str, floors: DataFrame | None = None, strict: bool = True, prefix: str = "wai:") -> DataFrame:
    """S-10 (strict) and S-11 (malformed lines dropped): a folder of JSON lines: new messages above their thread's floor, each id once."""
    raw = spark.read.schema(SPOOL).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    m = raw.where("kind = 'upsert' and message.key.remoteJid <> 'status@broadcast' and message.message.protocolMessage is null and message.message.reactionMessage is null")
    t = "message.message."
    body = F.coalesce(*[F.col(t + c) for c in ("conversation", "extendedTextMessage.text", "imageMessage.caption", "videoMessage.caption", "ephemeralMessage.message.conversation", "ephemeralMessage.message.extendedTextMessage.text", "viewOnceMessage.message.imageMessage.caption")])
    kind = F.when(F.col(t + "imageMessage").isNotNull() | F.col(t + "viewOnceMessage").isNotNull(), "image").when(F.col(t + "videoMessage").isNotNull(), "video")
    stamp = F.coalesce(F.col("message.messageTimestamp").try_cast("long"), F.get_json_object("message.messageTimestamp", "$.low").try_cast("long"))
    thread = F.concat(F.lit(prefix), F.col("message.key.remoteJid"))
    rows = m.select(
        F.concat(thread, F.lit("#"), F.col("message.key.id")).alias("id"), thread.alias("thread_id"), (stamp * 1000).alias("ts"), F.col("message.key.fromMe").alias("from_me"), F.col("message.pushName").alias("sender_name"), body.alias("body"), kind.alias("attachment_type")
    ).where("body is not null or attachment_type is not null")
    if floors is not None:
        rows = rows.join(floors, "thread_id", "left").where(F.col("floor").isNull() | (F.col("ts") > F.col("floor"))).drop("floor")
    return rows.dropDuplicates(["id"])


def wall_clock(text: Column) -> Column:
    """Milliseconds of a written time such as "May 31, 2026 7:57 am" or "May 31, 2026 at 8:36 PM", as if it were UTC."""
    m = r"([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})(?:\s+at)?\s+(\d{1,2}):(\d{2})\s*([AaPp][Mm])?"
    part = lambda k: F.regexp_extract(text, m, k)
    hour = part(4).try_cast("int")
    hour = F.when(F.lower(part(6)) == "pm", hour % 12 + 12).when(F.lower(part(6)) == "am", hour % 12).otherwise(hour)
    day = F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.substring(part(1), 1, 3)), part(2), part(3)), F.lit("MMM d yyyy"))
    return F.unix_millis(day) + (hour * 60 + part(5).try_cast("int")) * 60_000


def chat_html(spark: SparkSession, glob: str, prefix: str = "ig:", layout: Layout = MESSAGES) -> DataFrame:
    """S-02: HTML threads, a folder each: message blocks with sender, text, attachment and wall clock; the page's own time, written both
    as a wall clock and in UTC, gives the offset. Blocks without a time are dropped."""
    raw = spark.read.text(glob, wholetext=True).withColumn("source", F.input_file_name())
    thread = F.element_at(F.split(F.regexp_replace("source", r"/[^/]*$", ""), "/"), -1)
    r = records(raw, layout)
    shift = F.coalesce(wall_clock(F.col("page")["exported"]) - F.unix_millis(F.try_to_timestamp(F.col("page")["exported_datetime"])), F.lit(0))
    of = lambda name: F.coalesce(F.col("fields")[name], F.lit(""))
    markup = F.lower(F.coalesce(F.col("markup")["body"], F.lit("")))
    kind = F.when(markup.rlike(r"<video|\.mp4|sent a video"), "video").when(markup.rlike(r"<img|\.jpe?g|\.png|\.webp|\.heic|\.gif|sent an attachment|sent a photo|photos/"), "image")
    rows = r.select(thread.alias("thread_id"), F.col("source").alias("_file"), F.col("pos").alias("_pos"), of("sender").alias("sender_name"), of("body").alias("body"), (wall_clock(of("time")) - shift).alias("ts"), kind.alias("attachment_type"))
    return reindexed(rows.where("ts is not null"), prefix, ["ts", "_file", "_pos"]).drop("_file", "_pos")


def sqlite_rows(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """S-09/S-18: rows of a statement over one SQLite file, read where the file is; a file is one task's work."""

    def run(batches):
        import sqlite3

        for frame in batches:
            for p in frame["path"]:
                with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as con:
                    yield from pd.read_sql_query(sql, con, chunksize=50_000)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, schema)


#: Seconds from the Unix epoch to 2001-01-01.
APPLE_EPOCH = 978_307_200


def apple_messages(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """S-09: rows(pk, jid, member_jid, push_name, from_me, date, type, text) with names by contact, push name, member, then sender."""
    r = rows.where(~F.col("type").isin(6, 10)).where((F.col("type") != 11) | (F.coalesce("text", F.lit("")) != ""))
    key = F.coalesce("member_jid", "jid")
    named = r.withColumn("_jid", key).join(contacts.select(F.col("jid").alias("_jid"), F.col("name").alias("_name")), "_jid", "left")
    holder = F.when(F.col("type") == 1, "[image]").when(F.col("type") == 2, "[video]").when(F.col("type") == 3, "[audio]").otherwise("")
    return named.select(
        F.concat(F.lit("wai:"), "jid", F.lit("#"), F.col("pk").cast("string")).alias("id"), F.concat(F.lit("wai:"), "jid").alias("thread_id"), F.floor((F.col("date") + APPLE_EPOCH) * 1000).alias("ts"),
        (F.col("from_me") == 1).alias("from_me"), F.coalesce("_name", "push_name", "member_jid", "jid").alias("sender_name"), F.coalesce("text", holder).alias("body"),
    )
