"""Events and meet-ups (E rows)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import haversine, marker, round_half_up
from ..session import ship
from .density import merge_near
from .joins import within

HOUR = 3_600_000


def sessions(photos: DataFrame, group: list[str], gap: int = 6 * HOUR) -> DataFrame:
    """E-01's time rule and T-05: a new session after more than `gap`; session is its ordinal within the group."""
    w = Window.partitionBy(*group).orderBy("ts", "id")
    opens = F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap).cast("int"), F.lit(0))
    return photos.withColumn("_o", opens).withColumn("session", F.sum("_o").over(w)).drop("_o")


def _km(a: float, b: float, c: float, d: float) -> float:
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def cluster(photos: DataFrame, gap_hours: int = 6, far_km: float = 1.0, move_hours: int = 1, least: int = 3) -> DataFrame:
    """E-01: photos(id, ts, lat, lng, owner) in clusters of one outing.

    A cluster ends after a gap of more than 6 hours, or where a photo is over 1 km from the mean of the
    cluster's positions so far and more than 1 hour after the photo before. The first rule is a window;
    the second keeps state, and walks through the sessions of the first, many of them in a task, unless a session
    is so short or lies so close together that it can't be divided. Clusters of fewer than three photos
    are dropped.
    """
    ship(photos.sparkSession)
    timed = sessions(photos, ["owner"], gap_hours * HOUR)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, k, lat, lng, n, last = None, 0, 0.0, 0.0, 0, None  # a session goes on from batch to batch
        for rows in batches:
            out = []
            for owner, session, ts, a, b in zip(rows.owner, rows.session, rows.ts, rows.lat, rows.lng, strict=True):
                if (owner, session) != now:
                    now, k, lat, lng, n, last = (owner, session), 0, 0.0, 0.0, 0, None
                placed = not (pd.isna(a) or pd.isna(b))
                if last is not None and placed and n and ts - last > move_hours * HOUR and _km(lat / n, lng / n, a, b) > far_km:
                    k, lat, lng, n = k + 1, 0.0, 0.0, 0
                if placed:
                    lat, lng, n = lat + a, lng + b, n + 1
                out.append(k)
                last = ts
            yield rows.assign(part=out)[["owner", "session", "part", "id", "ts", "lat", "lng"]]

    whole = Window.partitionBy("owner", "session")
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    edge = lambda f, c: f(F.when(placed, F.col(c))).over(whole)
    across = haversine(edge(F.min, "lat"), edge(F.min, "lng"), edge(F.max, "lat"), edge(F.max, "lng"))
    short = F.max("ts").over(whole) - F.min("ts").over(whole) <= move_hours * HOUR
    timed = timed.withColumn("calm", short | F.coalesce(across <= 0.9 * far_km, F.lit(True))).select("owner", "session", "id", "ts", "lat", "lng", "calm")
    restless = timed.where("not calm").drop("calm").repartition("owner", "session").sortWithinPartitions("owner", "session", "ts", "id")
    walked = restless.mapInPandas(walk, "owner string, session long, part long, id string, ts long, lat double, lng double")
    calm = timed.where("calm").select("owner", "session", F.lit(0).cast("long").alias("part"), "id", "ts", "lat", "lng")
    walked = walked.union(calm)
    return walked.withColumn("_n", F.count("*").over(Window.partitionBy("owner", "session", "part"))).where(F.col("_n") >= least).drop("_n")


def participants(event_photos: DataFrame, faces: DataFrame) -> DataFrame:
    """E-02: distinct faces of each event's photos."""
    return event_photos.join(faces, "photo_id").select("event_id", "canonical_id").distinct()


def event_messages(gatherings: DataFrame, messages: DataFrame, thread_identity: DataFrame, pad: int = 12 * HOUR, most: int = 200) -> DataFrame:
    """E-03: event_id, message_id and ts of meaningful messages with an event's people within twelve hours, the first 200 by time."""
    people = gatherings.select("event_id", "start_ts", "end_ts", F.explode("participants").alias("canonical_id")).join(thread_identity, "canonical_id").select("event_id", "start_ts", "end_ts", "thread_id")
    bucket = 86_400_000
    spans = people.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start_ts") - pad) / bucket), F.floor((F.col("end_ts") + pad) / bucket))))
    m = messages.where("meaningful").select("id", "ts", "thread_id").withColumn("_b", F.floor(F.col("ts") / bucket))
    hits = m.join(spans, ["thread_id", "_b"]).where((F.col("ts") >= F.col("start_ts") - pad) & (F.col("ts") <= F.col("end_ts") + pad))
    # a thread of several of an event's people brings its messages for each: told apart here, where there are fewer rows than people
    order = Window.partitionBy("event_id").orderBy("ts", "id")
    ranked = hits.withColumns({"_r": F.dense_rank().over(order), "_before": F.lag("id").over(order)})
    return ranked.where((F.col("_r") <= most) & (F.col("_before").isNull() | (F.col("_before") != F.col("id")))).select("event_id", F.col("id").alias("message_id"), "ts")


def majority_place(event_photos: DataFrame, places: DataFrame) -> DataFrame:
    """E-04/E-05: the most frequent place and city of an event's photos, and their mean position."""
    p = event_photos.join(places, "photo_id")
    n = p.groupBy("event_id", "place_name", "city").agg(F.count("*").alias("n"))
    top = n.withColumn("_r", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("n").desc(), F.col("place_name"), F.col("city").asc_nulls_last()))).where("_r = 1")
    c = p.groupBy("event_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))
    return top.join(c, "event_id").select("event_id", F.coalesce("city", "place_name").alias("place"), "lat", "lng")


#: Responses of those who came.
ATTENDED = ("hosted", "created", "ticket", "joined")


def named(clusters: DataFrame, outside: DataFrame, reach: int = 6 * HOUR, near_km: float = 5.0, alone: int = 3 * HOUR) -> DataFrame:
    """E-06: clusters(event_id, start_ts, end_ts, lat, lng) named by attended outside events (key, name, ts, lat, lng, response).

    An outside event goes to the one cluster within reach whose start is nearest. There it counts as `geo` if it's within 5 km of the
    cluster, as `time` if either has no position and it begins within 3 hours; one that is known to be far away doesn't count.
    A cluster takes the nearest `geo` event, else the nearest `time` one. Of equal gaps the least id is taken.
    """
    came = outside.where(F.col("response").isin(*ATTENDED)).select("key", "name", "ts", F.col("lat").alias("olat"), F.col("lng").alias("olng"))
    gap = F.abs(F.col("ts") - F.col("start_ts")).alias("gap")
    spans = clusters.groupBy("start_ts", "end_ts").agg(F.min("event_id").alias("event_id"))  # different moments meet different spans, not rows rows
    near = within(came.select("ts").distinct(), "ts", spans, "start_ts", "end_ts", reach).groupBy("ts").agg(F.min(F.struct(gap, "event_id")).alias("c")).select("ts", "c.*")
    one = came.join(near, "ts").join(clusters.select("event_id", "lat", "lng"), "event_id")
    km = haversine(F.col("olat"), F.col("olng"), F.col("lat"), F.col("lng"))
    match = F.when(km <= near_km, "geo").when(km.isNull() & (F.col("gap") <= alone), "time")
    best = F.struct((F.col("match") != "geo").alias("far"), "gap", "key")
    return one.withColumn("match", match).where("match is not null").groupBy("event_id").agg(F.min_by(F.struct("key", "name", "match", "gap"), best).alias("b")).select("event_id", "b.*")


def person_events(event_photos: DataFrame, faces: DataFrame) -> DataFrame:
    """E-08: photos with a person's face by event."""
    return event_photos.join(faces, "photo_id").groupBy("event_id", "canonical_id").agg(F.count("*").alias("weight"))


def co_present_events(gatherings: DataFrame) -> DataFrame:
    """E-09/E-10: pairs of an event's people, both directions, with the events they share."""
    # an event's people are together in one row before they become pairs, so a pair needs no event to be counted by
    people = gatherings.where("event_id is not null").groupBy("event_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact("participants")))).alias("people"))
    p = people.select("people", F.explode("people").alias("a"))
    return p.select("a", F.explode("people").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def meetup_candidates(messages: DataFrame, day: Column) -> DataFrame:
    """E-11: days of a thread, as `day` keys them, with a meet-up marker and both sides active."""
    hit = marker(F.col("body"))
    g = messages.withColumns({"day": day, "_m": hit}).groupBy("thread_id", "day").agg(
        F.count_if("_m").alias("markers"), F.count_if("from_me").alias("mine"), F.count_if(~F.col("from_me")).alias("theirs"), F.min(F.when(F.col("_m"), F.col("ts"))).alias("start_ts"), F.max("ts").alias("end_ts")
    )
    return g.where("markers > 0 and mine > 0 and theirs > 0").select("thread_id", "day", "markers", "start_ts", "end_ts")


def confirm_window(messages: DataFrame, day: Column, size: int = 60, before: int = 20) -> DataFrame:
    """E-12: up to 60 messages of a candidate day that start 20 before its first marker, moved back at the end."""
    w = Window.partitionBy("thread_id", "day")
    m = messages.withColumn("day", day)
    m = m.withColumns({"_i": F.row_number().over(w.orderBy("ts", "id")) - 1, "_n": F.count("*").over(w)}).withColumn("_m", marker(F.col("body")))
    m = m.withColumn("_first", F.min(F.when(F.col("_m"), F.col("_i"))).over(w)).where("_first is not null")
    start = F.greatest(F.lit(0), F.least(F.col("_first") - before, F.col("_n") - size))
    return m.where((F.col("_i") >= start) & (F.col("_i") < start + size)).select("thread_id", "day", "id")


def uncovered(candidates: DataFrame, gatherings: DataFrame, pad: int = 6 * HOUR) -> DataFrame:
    """E-13: candidates (event_id, start_ts, end_ts, participants) that overlap no photo event of shared or unknown people."""
    # of a person's photo events that begin in time, the one that ends last decides: a running maximum by week, with what the weeks before hand on
    bucket = 7 * 24 * HOUR
    nobody = F.array(F.lit(None).cast("string"))  # stands for photo events of unknown people, who may be anybody
    part = F.floor(F.col("t") / bucket).alias("_b")
    who = F.array_distinct(F.array_compact("participants"))
    photos = gatherings.select(F.explode(F.when(F.size("participants") == 0, nobody).otherwise(who)).alias("_p"), F.col("start_ts").alias("t"), "end_ts")
    photos = photos.groupBy("_p", "t").agg(F.max("end_ts").alias("until")).select("_p", part, "t", F.lit(1).alias("_k"), "until", F.lit(None).cast("long").alias("since"), F.lit(None).cast(candidates.schema["event_id"].dataType).alias("event_id"))
    asked = candidates.select("event_id", F.explode(F.concat(F.coalesce(who, F.array().cast("array<string>")), nobody)).alias("_p"), (F.col("end_ts") + pad).alias("t"), (F.col("start_ts") - pad).alias("since"))
    asked = asked.select("_p", part, "t", F.lit(2).alias("_k"), F.lit(None).cast("long").alias("until"), "since", "event_id")
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    handed = photos.select("_p", "_b", "until").union(asked.select("_p", "_b", "until").distinct()).groupBy("_p", "_b").agg(F.max("until").alias("until")).withColumn("until", F.max("until").over(before))
    handed = handed.where("until is not null").select("_p", "_b", (F.col("_b") * bucket).alias("t"), F.lit(0).alias("_k"), "until", F.lit(None).cast("long").alias("since"), F.lit(None).cast(candidates.schema["event_id"].dataType).alias("event_id"))
    sofar = F.max("until").over(Window.partitionBy("_p", "_b").orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0))
    hit = handed.union(photos).union(asked).withColumn("until", sofar).where("_k = 2 and until >= since").select("event_id").distinct()
    return candidates.join(hit, "event_id", "left_anti")


def merge_verdicts(main: DataFrame, sibling: DataFrame) -> DataFrame:
    """E-14: verdicts (key, line, verdict) of two caches; main before sibling, then the first line; unread ones don't count."""
    both = main.withColumn("_p", F.lit(0)).unionByName(sibling.withColumn("_p", F.lit(1))).where("verdict is not null")
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("_p", "line"))).where("_r = 1").select("key", "verdict")


def unique_ids(events: DataFrame, wanted: str, order: list[str]) -> DataFrame:
    """E-15: ids that several rows want get -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(wanted).orderBy(*order))
    return events.withColumn("event_id", F.when(n == 1, F.col(wanted)).otherwise(F.concat_ws("-", F.col(wanted), n)))


def best_invite(rows: DataFrame, fields: list[str]) -> DataFrame:
    """E-16: of each invited event every field from the best source that has it (page, invite, other; the newest of a kind)."""
    rank = F.when(F.col("kind") == "page", 2).when(F.col("kind") == "invite", 1).otherwise(0)
    order = F.struct(rank, "email_ts", "row")
    return rows.groupBy("event_id").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))


def invitations(rows: DataFrame, details: DataFrame, messages: DataFrame, thread_identity: DataFrame, identities: DataFrame, link: str) -> DataFrame:
    """E-16: events of invitation rows(event_id, row, kind, email_ts, name, start_ts, end_ts, host) and pages' details(event_id, hosts, venue).

    Begin and end default to the mail's time and three hours later. Hosts are the page's, else the mail's, resolved by name (of a name that
    several have the least id). The inviter is the person in whose thread the event's link was sent most often, not by oneself; links are
    mined from bodies by the pattern `link`, whose first group is the event. Both are participants.
    """
    best = best_invite(rows, ["email_ts", "name", "start_ts", "end_ts", "host"])
    e = best.join(details, "event_id", "left").withColumn("start_ts", F.coalesce("start_ts", "email_ts"))
    e = e.withColumn("end_ts", F.coalesce(F.col("end_ts"), F.col("start_ts") + 3 * HOUR))
    hosted = e.select("event_id", F.posexplode(F.when(F.size(F.coalesce("hosts", F.array().cast("array<string>"))) > 0, F.col("hosts")).otherwise(F.array_compact(F.array("host")))).alias("k", "who"))
    by_name = identities.groupBy(F.lower("display_name").alias("_k")).agg(F.min("canonical_id").alias("id"))
    known = hosted.join(by_name, F.lower("who") == F.col("_k")).groupBy("event_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"])).alias("host_ids"))
    sent = messages.where("not from_me").select("thread_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(link)))).alias("event_id"))
    who = sent.join(thread_identity, "thread_id").join(identities.select("canonical_id"), "canonical_id").groupBy("event_id", "canonical_id").agg(F.count("*").alias("n"))
    inviter = who.groupBy("event_id").agg(F.min_by("canonical_id", F.struct(-F.col("n"), "canonical_id")).alias("inviter"))
    out = e.join(known, "event_id", "left").join(inviter, "event_id", "left").withColumn("host_ids", F.coalesce("host_ids", F.array().cast("array<string>")))
    venue = F.when(~F.lower("venue").isin("private location"), F.col("venue"))
    return out.select("event_id", "name", "start_ts", "end_ts", venue.alias("venue"), "host_ids", "inviter", F.array_union("host_ids", F.array_compact(F.array("inviter"))).alias("participants"))


def event_index(gatherings: DataFrame, event_photos: DataFrame, photos: DataFrame) -> DataFrame:
    """E-17: events with the earliest photo as thumbnail."""
    t = event_photos.join(photos.select(F.col("id").alias("photo_id"), "ts", "asset_path"), "photo_id").groupBy("event_id").agg(F.min_by("asset_path", F.struct("ts", "photo_id")).alias("thumb"))
    return gatherings.join(t, "event_id", "left").select("event_id", "start_ts", F.size("participants").alias("people"), "thumb")


def event_stream(event_photos: DataFrame, photos: DataFrame, event_messages: DataFrame, gatherings: DataFrame, identities: DataFrame) -> DataFrame:
    """A-44: an event's photos and messages (event_id, message_id, ts) in order of time, with its people's names (an id stands for whom nobody knows)."""
    p = event_photos.join(photos.select(F.col("id").alias("photo_id"), "ts"), "photo_id").select("event_id", F.lit("photo").alias("kind"), F.col("photo_id").alias("id"), "ts")
    m = event_messages.select("event_id", F.lit("message"), "message_id", "ts")
    who = gatherings.select("event_id", F.explode("participants").alias("canonical_id")).join(identities.select("canonical_id", "display_name"), "canonical_id", "left")
    names = who.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("display_name", "canonical_id"))), ", ").alias("people"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("ts", "kind", "id"))
    return p.union(m).join(names, "event_id", "left").withColumn("place", place).select("event_id", "place", "kind", "id", "ts", "people")


def dedupe_photos(photos: DataFrame, preferred: str) -> DataFrame:
    """E-18: one photo of each hash, the preferred source first, with the others' ids; without hash all stay."""
    key = F.coalesce(F.col("hash_sha256"), F.concat(F.lit("id:"), F.col("id")))
    order = F.struct((F.col("source") != preferred).cast("int").alias("p"), F.col("n"))
    g = photos.groupBy(key.alias("k")).agg(F.min_by("id", order).alias("id"), F.array_sort(F.collect_set("id")).alias("all"))
    return g.select("id", F.array_join(F.array_except("all", F.array("id")), ",").alias("alt_refs"))


def geocode_misses(places: DataFrame, cache: DataFrame) -> DataFrame:
    """E-19: distinct rounded positions that the cache doesn't hold."""
    r = places.select(round_half_up(F.col("lat"), 1000).alias("lat_round"), round_half_up(F.col("lng"), 1000).alias("lng_round")).distinct()
    return r.join(cache, ["lat_round", "lng_round"], "left_anti")


def merge_clusters(vectors: DataFrame, cosine: float = 0.5) -> DataFrame:
    """E-20: clusters (label, embedding) whose centroids' cosine reaches the threshold become one; centroids are searched in cells."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = each.groupBy(F.col("label").cast("long").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("x"))
    merged = merge_near(mean, cosine).select(F.col("cluster").alias("label"), "merged")
    sizes = vectors.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n")).join(merged, "label")
    return sizes.groupBy(F.col("merged").cast("int").alias("cluster")).agg(F.sum("n").alias("n_faces"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"))


def cluster_sheet(dets: DataFrame, low: float = 0.70) -> DataFrame:
    """E-22: span, mean score, quality and first three cities of each face cluster; dets(cluster_id, ts, det_score, city)."""
    g = dets.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("det_score"), 6).alias("mean_score"))
    n = dets.where("city is not null").groupBy("cluster_id", "city").agg(F.count("*").alias("n"))
    three = n.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "city"))).where("_r <= 3")
    cities = three.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "city"))), lambda x: x["city"]), ", ").alias("cities"))
    return g.join(cities, "cluster_id", "left").withColumn("cities", F.coalesce("cities", F.lit(""))).withColumn("low_quality", F.col("mean_score") < low)


def face_tables(dets: DataFrame, clusters: DataFrame, labels: DataFrame, identities: DataFrame, photos: DataFrame, photo_faces: DataFrame, source: str) -> dict[str, DataFrame]:
    """E-21: face_clusters, photo_faces and photos after labelled clusters of one source were taken in; other sources' rows stay.

    dets(photo_id, cluster_id), clusters(cluster_id, n_faces), labels(cluster_id, label). A label "skip" or an empty one names nobody;
    names are told apart by case no more than people's are, and of a name that several have the least id is taken.
    """
    said = labels.select("cluster_id", F.trim("label").alias("label")).where("label <> '' and lower(label) <> 'skip'").groupBy("cluster_id").agg(F.max("label").alias("label"))
    by_name = identities.where("display_name is not null").groupBy(F.lower("display_name").alias("_k")).agg(F.min("canonical_id").alias("canonical_id"))
    named_ = clusters.join(said, "cluster_id", "left").join(by_name, F.lower("label") == F.col("_k"), "left").drop("_k")
    of_source = photos.where(F.col("source") == source).select(F.col("id").alias("photo_id"))
    kept = photo_faces.join(of_source, "photo_id", "left_anti").select("photo_id", "canonical_id", "face_cluster")
    who = named_.where("canonical_id is not null").select("cluster_id", "canonical_id")
    found = dets.join(who, "cluster_id").groupBy("photo_id", "canonical_id").agg(F.min("cluster_id").alias("c")).select("photo_id", "canonical_id", F.concat(F.lit(f"{source}:cluster:"), F.col("c").cast("string")).alias("face_cluster"))
    faces = kept.union(found.join(kept.select("photo_id", "canonical_id"), ["photo_id", "canonical_id"], "left_anti"))
    # of this source's photos no older faces stay, so those found now are all that they show
    shown = dets.join(who, "cluster_id").select(F.col("photo_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    flagged = photos.join(shown, "id", "left").withColumn("has_named_face", F.when(F.col("source") == source, F.coalesce("_f", F.lit(False))).otherwise(F.col("has_named_face"))).drop("_f")
    return {"face_clusters": named_, "photo_faces": faces, "photos": flagged}
