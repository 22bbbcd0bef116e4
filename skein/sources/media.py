"""Photos, calendars of events, video history and invitations (S-19 to S-28)."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BATCH_BYTES, repair
from ..session import ship
from .markup import ACTIVITY, streamed

APPLE = "uuid string, date string, original_filename string, width int, height int, latitude double, longitude double, albums array<string>, persons array<string>"


def apple_photos(spark: SparkSession, glob: str, left_out: str = "Screenshots") -> tuple[DataFrame, DataFrame]:
    """S-19: photos and places of a library dump (JSON array); one album is left out, and a place needs both axes other than zero."""
    p = spark.read.schema(APPLE).option("multiLine", True).json(glob).where(~F.coalesce(F.array_contains("albums", left_out), F.lit(False)))
    ident = F.concat(F.lit("apple:"), "uuid").alias("id")
    photos = p.select(ident, F.unix_millis(F.to_timestamp("date")).alias("ts"), F.lit("apple").alias("source"), F.col("original_filename").alias("source_ref"), "width", "height")
    placed = p.where("latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0")
    return photos, placed.select(F.concat(F.lit("apple:"), "uuid").alias("photo_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


SIDECAR = "title string, url string, photoTakenTime struct<timestamp: string>, geoData struct<latitude: double, longitude: double>"


def sidecars(spark: SparkSession, glob: str, media: DataFrame | None = None) -> DataFrame:
    """S-20: photo sidecars: id by name and time; (0, 0) is no place, a single zero axis is kept. media(name, path) gives the first path of a name."""
    s = spark.read.schema(SIDECAR).option("multiLine", True).json(glob)
    base = F.element_at(F.split("title", "/"), -1)
    none = (F.col("geoData.latitude") == 0) & (F.col("geoData.longitude") == 0)
    s = s.select(F.concat(F.lit("gphotos:"), base, F.lit("@"), F.col("photoTakenTime.timestamp")).alias("id"), (F.col("photoTakenTime.timestamp").cast("long") * 1000).alias("ts"), base.alias("name"), F.when(~none, F.col("geoData.latitude")).alias("lat"), F.when(~none, F.col("geoData.longitude")).alias("lng"))
    s = s.dropDuplicates(["id"])
    if media is None:
        return s
    first = media.groupBy(F.lower("name").alias("_k")).agg(F.min("path").alias("asset_path"))
    return s.join(first, F.lower("name") == F.col("_k"), "left").drop("_k")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Files within the tar archives below a folder, as `binaryFile` has those of folders: path, length and content. An archive is one task's work."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p.as_py(), c) for b in batches for p, c in zip(b.column("path"), b.column("content"), strict=True)):
            rows, held = [], 0
            with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:", ignore_zeros=True) as tar:
                for m in tar:
                    if m.isfile():
                        rows.append((f"{path}/{m.name}", m.size, tar.extractfile(m).read()))
                        held += m.size
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return archives.select("path", "content").mapInArrow(run, "path string, length long, content binary")


def attachments(spark: SparkSession, folder: str, kinds: str = r"\.(jpe?g|png|gif|heic|webp)$", archives: bool = False) -> DataFrame:
    """S-21: images below a folder, or files of other kinds, named by the checksum of their content; with `archives`, those within its tar files."""
    f = members(spark, folder) if archives else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = f.where(F.lower("path").rlike(kinds))
    return f.select(F.sha2("content", 256).alias("hash_sha256"), "path", "length").groupBy("hash_sha256").agg(F.min("path").alias("path"), F.min("length").alias("length"))


#: Strength of responses to an event.
RANKS = {"invited": 0, "declined": 1, "maybe": 2, "joined": 3, "hosted": 4}


def facebook_events(rows: DataFrame) -> DataFrame:
    """S-22: rows(fbid, name, start_timestamp, end_timestamp, place_name, lat, lng, response, ordinal): the strongest response of an event, its gaps filled from the others."""
    rank = F.lit(0)
    for k, v in RANKS.items():
        rank = F.when(F.col("response") == k, v).otherwise(rank)
    ms = lambda c: F.when(F.col(c) > 0, F.col(c) * 1000)
    e = rows.withColumns({"start_ts": ms("start_timestamp"), "end_ts": ms("end_timestamp"), "name": repair(F.col("name"))}).withColumn("event_key", F.coalesce(F.concat(F.lit("fb-"), "fbid"), F.concat_ws("|", F.lower("name"), F.col("start_ts").cast("string"))))
    order = F.struct(rank.alias("r"), F.col("ordinal"))
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return e.groupBy("event_key").agg(*[best(c) for c in ("name", "start_ts", "end_ts", "place_name", "lat", "lng")], F.max_by("response", order).alias("response"))


def takeout_csv(spark: SparkSession, glob: str, names: dict[str, str], ints: tuple[str, ...] = (), lists: dict[str, list[str]] | None = None) -> DataFrame:
    """S-23: CSV with quoted newlines; columns by header name, numbers that aren't are null, rows without any value are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(glob)
    columns = []
    for name, header in names.items():
        c = F.nullif(F.trim(F.col(f"`{header}`")), F.lit("")) if header in raw.columns else F.lit(None).cast("string")
        columns.append((c.try_cast("long") if name in ints else c).alias(name))
    for name, headers in (lists or {}).items():
        columns.append(F.array_compact(F.array(*[F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")) for h in headers if h in raw.columns])).alias(name))
    return raw.na.drop("all").select(*columns)


def watch_history(spark: SparkSession, glob: str) -> DataFrame:
    """S-24: watched videos of a history page: video, title (null where it's only the address), channel, and time with its offset.

    The time is the first in the cell's text, day or month first, with an offset from GMT or UTC; other zones' are null.
    """
    r = streamed(spark, glob, ACTIVITY)
    first = lambda pattern: F.get(F.filter("links", lambda x: x["href"].rlike(pattern)), F.lit(0))
    video, channel = first(r"watch\?v=[\w-]+"), first(r"/channel/[\w-]+")
    stamp = F.regexp_extract("text", r"(\d{1,2} [A-Za-z]{3,9} \d{4}, \d{1,2}:\d{2}:\d{2}|[A-Za-z]{3,9} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2} [AP]M) ?(?:GMT[+-]\d{2}:?\d{2}|UTC)", 1)
    zone = F.regexp_extract("text", r"\d{1,2}:\d{2}:\d{2}(?: [AP]M)? ?(?:GMT)?([+-]\d{2}:?\d{2})", 1)
    short = F.regexp_replace(stamp, r"([A-Z][a-z]{2})[a-z]*", "$1")
    naive = F.unix_millis(F.coalesce(F.try_to_timestamp(short, F.lit("d MMM yyyy, H:mm:ss")), F.try_to_timestamp(F.regexp_replace(stamp, r"([A-Z][a-z]{2})[a-z]+", "$1"), F.lit("MMM d, yyyy, h:mm:ss a"))))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")
    shift = F.when(zone == "", 0).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    title = F.nullif(video["text"], F.lit(""))
    return r.where(video.isNotNull()).select(
        F.regexp_extract(video["href"], r"watch\?v=([\w-]+)", 1).alias("video_id"), F.when(~title.rlike("(?i)^https?://"), title).alias("title"),
        F.nullif(F.regexp_extract(channel["href"], r"/channel/([\w-]+)", 1), F.lit("")).alias("channel_id"), F.nullif(channel["text"], F.lit("")).alias("channel"), (naive - shift * 60_000).alias("ts"),
    )


def invite_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """S-25: events of invitation pages from their embedded data."""
    blob = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    e = "$.props.pageProps.event."
    get = lambda k: F.get_json_object(blob, e + k)
    return pages.where(blob != "").select(get("id").alias("event_id"), get("title").alias("title"), F.unix_millis(F.to_timestamp(get("startDate"))).alias("start_ts"), get("locationInfo.name").alias("place_name"), F.lit("page").alias("kind"))


def invite_mails(mails: DataFrame) -> DataFrame:
    """S-25: what an e-mail about an event is, by its subject."""
    s = F.lower("subject")
    kind = F.when(s.rlike(r"invited you|you're invited"), "invite").when(s.rlike(r"reminder|is (today|tomorrow)"), "reminder").when(s.rlike(r"rsvp|going to"), "rsvp").when(s.rlike(r"cancel"), "cancelled").otherwise("other")
    return mails.withColumn("kind", kind)


def guest_list(pages: DataFrame, text: str = "text") -> DataFrame:
    """S-26: hosts, counts and guests of an event page's text; masked names are dropped."""
    stop = re.compile(r"^(when|where|rsvp|guest list|\d+ (going|maybe))", re.I)

    @F.pandas_udf("hosts array<string>, going int, maybe int, guests array<string>")
    def scan(s: pd.Series) -> pd.DataFrame:
        out = []
        for body in s:
            lines = [x.strip() for x in (body or "").splitlines() if x.strip()]
            at = next((i for i, x in enumerate(lines) if re.match(r"hosted by", x, re.I)), None)
            hosts = []
            if at is not None:
                rest = re.sub(r"(?i)^hosted by:?\s*", "", lines[at])
                for x in ([rest] if rest else []) + lines[at + 1 :]:
                    if stop.match(x):
                        break
                    hosts += [h.strip() for h in re.split(r",|&| and ", x) if h.strip()]
            number = lambda word: next((int(m[1]) for x in lines if (m := re.match(rf"(\d+) {word}", x, re.I))), 0)  # noqa: E731, B023
            start = next((i for i, x in enumerate(lines) if x.lower() == "guest list"), None)
            guests = [x for x in lines[start + 1 :] if not re.search(r"[*•█]|^\d+ ", x)] if start is not None else []
            out.append((hosts, number("going"), number("maybe"), guests))
        return pd.DataFrame(out, columns=["hosts", "going", "maybe", "guests"])

    return pages.withColumn("_g", scan(F.col(text))).select("*", "_g.*").drop("_g")
