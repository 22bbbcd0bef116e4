"""Per-person and per-period analytics (A rows). `now` is always a parameter, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ASKING, HEDGE, any_of, at, rolling_hash, round_half_up, week_index

DAY = 86_400_000


def _rounded(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def profile(messages: DataFrame, person: str, now: int) -> DataFrame:
    """A-01: volume, span, balance, late hours (UTC), median answer time over changes of direction, and a score."""
    w = Window.partitionBy(person).orderBy("ts", "id")
    gap = F.col("ts") - F.lag("ts").over(w)
    flip = (F.lag("from_me").over(w) != F.col("from_me")) & (gap > 0) & (gap < DAY)
    m = messages.withColumn("_wait", F.when(flip, gap)).withColumn("_late", F.hour(at(F.col("ts"))).isin(23, 0, 1, 2, 3, 4))
    a = m.groupBy(person).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if("from_me").alias("mine"), F.count_if("_late").alias("late"),
        F.count_distinct(F.floor(F.col("ts") / DAY)).alias("active_days"), F.coalesce(F.median("_wait"), F.lit(0.0)).alias("median_ms"),
    )
    a = a.withColumns({"span_days": F.greatest(F.lit(1), F.floor((F.col("last_ts") - F.col("first_ts")) / DAY + 0.5)), "late_ratio": F.col("late") / F.col("n"), "reciprocity": 1 - F.abs(2 * F.col("mine") - F.col("n")) / F.col("n")})
    days = (F.lit(now) - F.col("last_ts")) / DAY
    recency = F.when(days < 30, 1.0).when(days < 180, 0.5).otherwise(0.1)
    slow = F.when(F.col("median_ms") > 0, F.log10(F.col("median_ms") / 1000 + 1)).otherwise(0.0)
    score = 10 * F.log10(F.col("n") + 1) + 5 * F.log10(F.col("span_days") + 1) + 0.5 * F.col("n") / F.col("active_days") + 20 * F.col("late_ratio") + 15 * F.col("reciprocity") + 10 * recency - slow
    return a.withColumn("score", _rounded(score, 1)).drop("late", "mine")


def trajectory(messages: DataFrame, group: str) -> DataFrame:
    """A-06: monthly volume, hedging and asking per thousand, and median length."""
    body = F.coalesce("body", F.lit(""))
    m = messages.withColumns({"month": F.date_format(at(F.col("ts")), "yyyy-MM"), "_h": any_of(body, HEDGE), "_a": any_of(body, ASKING), "_l": F.length(body)})
    a = m.groupBy(group, "month").agg(F.count("*").alias("total"), F.count_if("from_me").alias("from_me"), F.count_if("_h").alias("h"), F.count_if("_a").alias("a"), F.median("_l").alias("median_length"))
    return a.select(group, "month", "total", "from_me", _rounded(F.col("h") * 1000 / F.col("total"), 2).alias("hedge_per_1k"), _rounded(F.col("a") * 1000 / F.col("total"), 2).alias("asking_per_1k"), "median_length")


def key_moments(messages: DataFrame, group: str) -> DataFrame:
    """A-07: first and last message, longest gap, peak month and biggest day; the earliest wins a tie."""
    w = Window.partitionBy(group).orderBy("ts", "id")
    g = messages.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).groupBy(group).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.min_by("ts", F.struct(-F.coalesce("gap", F.lit(0)), "ts")).alias("gap_end")
    )
    for name, form in (("peak_month", "yyyy-MM"), ("biggest_day", "yyyy-MM-dd")):
        n = messages.groupBy(group, F.date_format(at(F.col("ts")), form).alias(name)).agg(F.count("*").alias("n"))
        g = g.join(n.groupBy(group).agg(F.min_by(name, F.struct(-F.col("n"), name)).alias(name)), group)
    return g


def baseline(messages: DataFrame, group: str, now: int, window: int = 30, step: int = 7) -> DataFrame:
    """A-08: median count over windows of 30 days, stepped by 7 from the first message and ended 30 days ago; empty windows count."""
    first = messages.groupBy(group).agg(F.min("ts").alias("t0")).withColumn("k", F.floor((F.lit(now - window * DAY) - F.col("t0") - window * DAY) / (step * DAY)))
    spans = first.where("k >= 0").select(group, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("i"))
    hits = messages.select(group, "ts").join(first.select(group, "t0", "k"), group)
    last = F.floor((F.col("ts") - F.col("t0")) / (step * DAY))
    early = F.greatest(F.lit(0), F.floor((F.col("ts") - F.col("t0") - window * DAY) / (step * DAY)) + 1)
    hits = hits.withColumns({"lo": early, "hi": F.least(last, F.col("k"))}).where("hi >= lo")
    n = hits.select(group, F.explode(F.sequence("lo", "hi")).alias("i")).groupBy(group, "i").agg(F.count("*").alias("n"))
    return spans.join(n, [group, "i"], "left").groupBy(group).agg(F.median(F.coalesce("n", F.lit(0))).alias("baseline"))


def current_state(messages: DataFrame, group: str, now: int) -> DataFrame:
    """A-09: days since the last message, who sent it, and the last 30 days' count."""
    recent = F.count_if((F.col("ts") > now - 30 * DAY) & (F.col("ts") <= now)).alias("recent_30d")
    return messages.groupBy(group).agg(F.floor((F.lit(now) - F.max("ts")) / DAY).alias("days_since"), F.max_by("from_me", F.struct("ts", "id")).alias("last_from_me"), recent)


def rhythm(messages: DataFrame, local: str = "local") -> DataFrame:
    """A-10: messages by week of the year and hour of the day, in the local time that column `local` has; weeks go by UTC."""
    year, week = week_index(at(F.col("ts")))
    return messages.where("meaningful").groupBy(year.alias("year"), week.alias("week"), F.hour(local).alias("hour")).agg(F.count("*").alias("n"), F.count_if("from_me").alias("n_from_me"))


def almanac(gatherings: DataFrame, year: int, self_id: str) -> DataFrame:
    """A-12: most seen people of a year with their share, whether they're new, and the year's events."""
    seen = gatherings.withColumn("y", F.year(at(F.col("start_ts")))).select("y", "event_id", F.explode("participants").alias("canonical_id")).where(F.col("canonical_id") != self_id)
    first = seen.groupBy("canonical_id").agg(F.min("y").alias("first_year"))
    n = seen.where(F.col("y") == year).groupBy("canonical_id").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.join(first, "canonical_id").select("canonical_id", "n", (F.col("n") / total.scalar()).alias("share"), (F.col("first_year") == year).alias("new_face"))


def lapsed(gatherings: DataFrame, year: int) -> DataFrame:
    """A-12: people seen the year before and not in this one."""
    seen = gatherings.select(F.year(at(F.col("start_ts"))).alias("y"), F.explode("participants").alias("canonical_id")).distinct()
    return seen.where(F.col("y") == year - 1).join(seen.where(F.col("y") == year).select("canonical_id"), "canonical_id", "left_anti").select("canonical_id")


def event_years(gatherings: DataFrame) -> DataFrame:
    """A-13."""
    return gatherings.select(F.year(at(F.col("start_ts"))).alias("year")).distinct()


def weeks(gatherings: DataFrame) -> DataFrame:
    """A-14: events of each week and the week's most frequent companion; of a tie the one met first."""
    year, week = week_index(at(F.col("start_ts")))
    g = gatherings.withColumns({"year": year, "week": week})
    n = g.groupBy("year", "week").agg(F.count("*").alias("events"))
    p = g.select("year", "week", "start_ts", F.explode("participants").alias("canonical_id")).groupBy("year", "week", "canonical_id").agg(F.count("*").alias("n"), F.min("start_ts").alias("t"))
    top = p.groupBy("year", "week").agg(F.min_by("canonical_id", F.struct(-F.col("n"), "t", "canonical_id")).alias("companion"))
    return n.join(top, ["year", "week"], "left")


def braid(gatherings: DataFrame, messages: DataFrame, thread_identity: DataFrame, top: int = 10) -> DataFrame:
    """A-15: the strongest people by year: messages + 5 events + 3 inferred events; only people with an event."""
    e = gatherings.select(F.year(at(F.col("start_ts"))).alias("year"), "source", F.explode("participants").alias("canonical_id"))
    e = e.groupBy("canonical_id", "year").agg(F.count_if(F.col("source") == "photos").alias("events"), F.count_if(F.col("source") == "messages").alias("inferred"), F.lit(0).cast("long").alias("messages"))
    m = messages.join(thread_identity, "thread_id").groupBy("canonical_id", F.year(at(F.col("ts"))).alias("year")).agg(F.count("*").alias("messages"))
    m = m.join(e.select("canonical_id").distinct(), "canonical_id", "left_semi").select("canonical_id", "year", F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("inferred"), "messages")
    y = e.unionByName(m).groupBy("canonical_id", "year").agg(*[F.sum(c).alias(c) for c in ("events", "inferred", "messages")])
    y = y.withColumn("strength", F.col("messages") + 5 * F.col("events") + 3 * F.col("inferred"))
    best = y.groupBy("canonical_id").agg(F.sum("strength").alias("s")).orderBy(F.col("s").desc(), "canonical_id").limit(top)
    return y.join(F.broadcast(best.select("canonical_id")), "canonical_id")


#: Frames of the atlas as (name, least and greatest latitude, least and greatest longitude).
FRAMES = (("MEL", -38.25, -37.45, 144.35, 145.45), ("SYD", -34.25, -33.55, 150.75, 151.55), ("CHI", 41.55, 42.25, -88.05, -87.35))


def atlas(gatherings: DataFrame) -> DataFrame:
    """A-16: each year's dominant frame, points in it, beyond all frames, and without coordinates."""
    frame = F.lit(None).cast("string")
    for name, a, b, c, d in reversed(FRAMES):
        frame = F.when(F.col("lat").between(a, b) & F.col("lng").between(c, d), name).otherwise(frame)
    g = gatherings.withColumns({"year": F.year(at(F.col("start_ts"))), "frame": frame, "placed": F.col("lat").isNotNull() & F.col("lng").isNotNull()})
    n = g.where("frame is not null").groupBy("year", "frame").agg(F.count("*").alias("n"), F.min("start_ts").alias("t"))
    top = n.groupBy("year").agg(F.min_by(F.struct("frame", "n"), F.struct(-F.col("n"), "t", "frame")).alias("b"))
    out = g.groupBy("year").agg(F.count_if(F.col("placed") & F.col("frame").isNull()).alias("beyond"), F.count_if(~F.col("placed")).alias("coordless"))
    return out.join(top, "year", "left").select("year", F.coalesce("b.frame", F.lit("MEL")).alias("frame"), F.coalesce("b.n", F.lit(0)).alias("points"), "beyond", "coordless")


def person_series(gatherings: DataFrame, messages: DataFrame, thread_identity: DataFrame) -> DataFrame:
    """A-18: events and messages by year over the archive's years, with the longest silent run (the earliest of a tie)."""
    e = gatherings.select(F.explode("participants").alias("canonical_id"), F.year(at(F.col("start_ts"))).alias("year"), F.lit(1).alias("e"), F.lit(0).alias("m"))
    m = messages.join(thread_identity, "thread_id").select("canonical_id", F.year(at(F.col("ts"))).alias("year"), F.lit(0).alias("e"), F.lit(1).alias("m"))
    y = e.union(m).groupBy("canonical_id", "year").agg(F.sum("e").alias("events"), F.sum("m").alias("messages"))
    years = F.sequence(y.agg(F.min("year")).scalar(), y.agg(F.max("year")).scalar())
    spine = y.select("canonical_id").distinct().select("canonical_id", F.explode(years).alias("year"))
    full = spine.join(y, ["canonical_id", "year"], "left").na.fill(0, ["events", "messages"])
    silent = full.where("events + messages = 0").withColumn("run", F.col("year") - F.row_number().over(Window.partitionBy("canonical_id").orderBy("year")))
    runs = silent.groupBy("canonical_id", "run").agg(F.min("year").alias("a"), F.max("year").alias("b"), F.count("*").alias("n"))
    gap = runs.groupBy("canonical_id").agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("n"), "a")).alias("g"))
    return full.join(gap, "canonical_id", "left").select("canonical_id", "year", "events", "messages", F.col("g.a").alias("gap_from"), F.col("g.b").alias("gap_to"))


def chunks(messages: DataFrame, group: str, days: int = 90, most: int = 600, least: int = 5) -> DataFrame:
    """A-19: chunks of 90 days from the first message; crowded ones are split evenly, sparse ones join the chunk before (never the first)."""
    w = Window.partitionBy(group)
    b = messages.withColumn("bucket", F.floor((F.col("ts") - F.min("ts").over(w)) / (days * DAY)))
    inside = Window.partitionBy(group, "bucket")
    b = b.withColumns({"_n": F.count("*").over(inside), "_i": F.row_number().over(inside.orderBy("ts", "id")) - 1})
    parts = F.ceil(F.col("_n") / most)
    b = b.withColumn("part", F.floor(F.col("_i") / F.ceil(F.col("_n") / parts)))
    s = b.groupBy(group, "bucket", "part").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    order = Window.partitionBy(group).orderBy("bucket", "part")
    s = s.withColumn("_r", F.row_number().over(order)).withColumn("chunk", F.sum(((F.col("n") >= least) | (F.col("_r") == 1)).cast("int")).over(order))
    return s.groupBy(group, "chunk").agg(F.sum("n").alias("n"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def birthday_inference(messages: DataFrame, known: DataFrame) -> DataFrame:
    """A-23: birthdays from greetings sent: HIGH with two different years, MEDIUM if the only day, else LOW; known people are left out."""
    from ..functions.text import GREETING

    d = at(F.col("ts"))
    g = messages.where(F.col("from_me") & F.lower("body").rlike(GREETING)).select("canonical_id", F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.year(d).alias("y"))
    n = g.groupBy("canonical_id", "month", "day").agg(F.count_distinct("y").alias("years"), F.count("*").alias("greetings"))
    c = n.withColumn("_days", F.count("*").over(Window.partitionBy("canonical_id")))
    best = Window.partitionBy("canonical_id").orderBy(F.col("years").desc(), F.col("greetings").desc(), "month", "day")
    c = c.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(known.select("canonical_id"), "canonical_id", "left_anti")
    return c.select("canonical_id", "month", "day", "years", "greetings", F.when(F.col("years") >= 2, "HIGH").when(F.col("_days") == 1, "MEDIUM").otherwise("LOW").alias("confidence"))


#: Words that name no topic.
STOP = "the a an and or of to in on at for with party night live show event you your we our me my is are be a &".split()


def topics(events: DataFrame, name: str, key: str, description: str | None = None, response: str | None = None, least: int = 3, top: int = 50) -> DataFrame:
    """A-25: words of event names and descriptions, once for each event that wasn't declined or only invited to, with the first three names by key."""
    if response:
        events = events.where(F.col(response).isNull() | ~F.col(response).isin("declined", "invited"))
    text = F.concat_ws(" ", name, F.coalesce(F.col(description), F.lit(""))) if description else F.col(name)
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0)))
    w = events.select(key, F.col(name).alias("_name"), F.explode(words).alias("topic")).where(~F.col("topic").isin(STOP))
    n = w.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "topic").limit(top)
    names = w.join(F.broadcast(n.select("topic")), "topic").groupBy("topic", "_name").agg(F.min(key).alias("_k"))  # at most `top` topics
    first = names.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy("_k", "_name"))).where("_r <= 3")
    samples = first.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_name"))), lambda x: x["_name"]), "|").alias("samples"))
    return n.join(samples, "topic")


def facet_topics(facets: list[tuple[str, DataFrame, str, int, int]]) -> DataFrame:
    """A-26: the most frequent values of several facets (name, rows, column, least, top), weighted by their share among those kept."""
    out = None
    for name, rows, column, least, top in facets:
        k = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("topic")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "topic").limit(top)
        k = k.select(F.lit(name).alias("facet"), "topic", "n")
        out = k if out is None else out.unionByName(k)
    return out.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("facet")))


def life_map(places: DataFrame, top: int = 400) -> DataFrame:
    """A-33: mean position and photos of each city."""
    c = places.where("city is not null").groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("photos"))
    return c.orderBy(F.col("photos").desc(), "city").limit(top)


def reconnect(messages: DataFrame, now: int, least: int = 100, silent: int = 60, top: int = 80) -> DataFrame:
    """A-34: people of many messages who have been silent."""
    m = messages.where("meaningful").groupBy("canonical_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.count_if(F.col("ts") > now - 365 * DAY).alias("last_year"))
    return m.where((F.col("n") >= least) & (F.col("last_ts") <= now - silent * DAY)).orderBy(F.col("n").desc(), "canonical_id").limit(top)


def closeness(identities: DataFrame, messages: DataFrame, calls: DataFrame, faces: DataFrame, event_photos: DataFrame, gatherings: DataFrame, self_name: str = "Demo User", top: int = 80) -> DataFrame:
    """A-35: a blend of meaningful one-to-one messages, call minutes, photos, photo events by face, and inferred meet-ups; the owner is left out."""
    met = gatherings.where("source = 'messages'").select("event_id", F.explode("participants").alias("canonical_id")).distinct()
    there = event_photos.join(faces, "photo_id").select("event_id", "canonical_id").distinct()
    parts = (
        messages.where("meaningful").groupBy("canonical_id").agg(F.count("*").alias("msgs")), calls.groupBy("canonical_id").agg((F.sum("duration_s") / 60).alias("mins")), faces.groupBy("canonical_id").agg(F.count("*").alias("photos")),
        there.groupBy("canonical_id").agg(F.count("*").alias("events")), met.groupBy("canonical_id").agg(F.count("*").alias("metups")),
    )
    out = identities.where(F.col("display_name") != self_name).select("canonical_id")
    for p in parts:
        out = out.join(p, "canonical_id", "left")
    l = lambda c: F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    score = l("msgs") + 2.5 * l("mins") + 2 * l("photos") + 2.5 * l("events") + 1.5 * l("metups")
    return out.withColumn("closeness", F.round(score, 6)).where("closeness > 0").orderBy(F.col("closeness").desc(), "canonical_id").limit(top).select("canonical_id", "closeness")


#: Days after which a source is stale.
STALE = {"imessage": 7, "whatsapp": 14, "gmail": 60, "instagram": 60, "messenger": 90}


def freshness(messages: DataFrame, now: int, default: int = 30) -> DataFrame:
    """A-36: each source's newest message against its threshold."""
    limit = F.lit(default)
    for source, days in STALE.items():
        limit = F.when(F.col("source") == source, days).otherwise(limit)
    m = messages.groupBy("source").agg(F.max("ts").alias("newest")).withColumn("threshold", limit)
    return m.withColumn("stale", (F.lit(now) - F.col("newest")) / DAY > F.col("threshold"))


def cutoff(messages: DataFrame, now: int, margin: int = 2) -> DataFrame:
    """A-37: where an incremental export of each source starts, and the smallest preset that covers it."""
    m = messages.groupBy("source").agg((F.max("ts") - margin * DAY).alias("cutoff"))
    days = F.ceil((F.lit(now) - F.col("cutoff")) / DAY)
    preset = F.when(days <= 7, "7d").when(days <= 28, "28d").when(days <= 88, "88d").when(days <= 180, "180d").when(days <= 364, "364d").when(days <= 1094, "1094d").otherwise("all")
    return m.withColumn("preset", preset)


def companions(gatherings: DataFrame, event_photos: DataFrame, faces: DataFrame, identities: DataFrame, self_name: str = "demo user") -> DataFrame:
    """gatherings with `companion`: who has most faces in the event's photos (of a tie the least id), else the first participant; never the owner."""
    owner = identities.where(F.lower("display_name") == self_name).select("canonical_id")
    n = event_photos.join(faces.join(owner, "canonical_id", "left_anti"), "photo_id").groupBy("event_id", "canonical_id").agg(F.count("*").alias("n"))
    face = n.groupBy("event_id").agg(F.min_by("canonical_id", F.struct(-F.col("n"), "canonical_id")).alias("face"))
    listed = gatherings.select("event_id", F.posexplode("participants").alias("at", "canonical_id")).join(owner, "canonical_id", "left_anti")
    first = listed.groupBy("event_id").agg(F.min_by("canonical_id", "at").alias("first"))
    return gatherings.join(face, "event_id", "left").join(first, "event_id", "left").withColumn("companion", F.coalesce("face", "first")).drop("face", "first")


def field_layout(gatherings: DataFrame) -> DataFrame:
    """A-17: bearing and radius of each event, from hashes of its companion and the distance from the nearest home."""
    from ..functions.text import haversine

    #: Homes.
    homes = ((-37.81, 144.96), (-33.87, 151.21), (41.88, -87.63))
    h = lambda c, k: F.pmod(rolling_hash(c), F.lit(1 << 32)) % k
    far = F.least(*[haversine(F.col("lat"), F.col("lng"), F.lit(a), F.lit(b)) for a, b in homes])
    e = F.col("event_id")
    angle = h(F.coalesce("companion", e), 3600) / 3600 * 6.283185307179586 + (h(F.concat(e, F.lit("a")), 1000) / 1000 - 0.5) * 0.45
    nowhere = F.col("lat").isNull() | F.col("lng").isNull()
    base = F.when(nowhere, 0.45 + (h(F.concat(e, F.lit("r")), 1000) / 1000 - 0.5) * 0.18).otherwise(F.least(F.lit(1.0), 0.18 + F.log1p(far) / 9.5))
    radius = F.least(F.lit(1.0), F.greatest(F.lit(0.06), base + (h(F.concat(e, F.lit("j")), 1000) / 1000 - 0.5) * 0.1))
    return gatherings.select("event_id", "companion", round_half_up(radius * F.cos(angle), 10_000).alias("x"), round_half_up(radius * F.sin(angle), 10_000).alias("y"))


def video_summary(videos: DataFrame, library: DataFrame, topics: DataFrame, **collections: DataFrame) -> DataFrame:
    """A-27: how much of everything there is, how many videos are songs of the library, and the first topics (25), channels (15) and artists (15): section, place, item, n."""
    from .reports import counted, fact, facts, tops

    flagged = is_song(videos, library)
    parts = [facts(flagged, fact("counts", "videos"), fact("counts", "songs_among_videos", when=F.col("is_song"))), facts(library, fact("counts", "songs"))]
    parts += [facts(rows, fact("counts", name)) for name, rows in collections.items()]
    kind = F.when(F.col("kind").isin("topic", "category"), "top_topics").when(F.col("kind") == "channel", "top_channels").when(F.col("kind") == "artist", "top_artists")
    parts.append(topics.select(kind.alias("section"), F.col("topic").alias("item"), F.col("n").cast("long").alias("n")).where("section is not null"))
    return tops(counted(*parts), {"top_topics": 25, "top_channels": 15, "top_artists": 15})


def is_song(videos: DataFrame, library: DataFrame) -> DataFrame:
    """A-27: videos(video_id, ...) with whether the music library has them."""
    songs = library.select("video_id").distinct().withColumn("_s", F.lit(True))
    return videos.join(songs, "video_id", "left").withColumn("is_song", F.coalesce("_s", F.lit(False))).drop("_s")
