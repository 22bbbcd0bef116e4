"""Reports of many sections (A rows): stacked facts, counted once, and a bounded top of each section.

Every table that a report reads is scanned once: a row becomes the facts that it counts for, (section, item, n), in one
array that is exploded; one aggregation by section and item counts them all. Lists with a limit are ranked within their
section, where Spark keeps each task's first rows only; lists without one come unranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at
from ..session import cut

FACT = "struct<section:string,item:string,n:bigint>"


def fact(section: str, item: Column | str | None = None, n: Column | int = 1, when: Column | None = None) -> Column:
    """A fact that a row counts for, where `when` holds."""
    item = F.lit("") if item is None else (F.lit(item) if isinstance(item, str) else item.cast("string"))
    n = F.lit(n) if isinstance(n, int) else n
    s = F.struct(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n")).cast(FACT)
    return s if when is None else F.when(when, s)


def facts(rows: DataFrame, *each: Column, carry: list[Column] | None = None) -> DataFrame:
    return rows.select(*(carry or []), F.explode(F.array_compact(F.array(*each))).alias("_f")).select("*", "_f.*").drop("_f")


def counted(*parts: DataFrame, by: tuple[str, ...] = ("section", "item")) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("n").alias("n"))


def zeros(like: DataFrame, *items: tuple[str, str]) -> DataFrame:
    """Facts of nothing, for items that are listed whether or not there are any."""
    return like.sparkSession.createDataFrame([(s, i, 0) for s, i in items], "section string, item string, n long")


def tops(sections: DataFrame, limits: dict[str, int]) -> DataFrame:
    """section, place, item, n: the first `limits[section]` by n, then item; sections without a limit whole and without place."""
    limited = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.col("n").desc(), "item"))
    ranked = sections.where(F.col("section").isin(*limits)).withColumn("place", place).where(F.col("place") <= max(limits.values())).where(F.col("place") <= limited[F.col("section")])
    rest = sections.where(~F.col("section").isin(*limits)).withColumn("place", F.lit(None).cast("int"))
    return ranked.unionByName(rest).select("section", "place", "item", "n")


def almanac(gatherings: DataFrame, messages: DataFrame, photos: DataFrame, thread_identity: DataFrame, identities: DataFrame, year: int, self_id: str) -> DataFrame:
    """A-12: a year's counts, most seen people, new faces, lapsed ones, first eight places, concentration of direct messages, months and biggest event.

    section, place, item, name (of a person), n and share (of all direct messages, for the concentration's rows). The biggest event
    has its photos as n, its people their event's beginning.
    """
    y = F.year(at(F.col("start_ts")))
    now = y == year
    who = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("participants", F.array().cast("array<string>"))))
    seen = gatherings.select("start_ts", "source", "place_name", who.alias("person")).where(F.col("person").isNull() | (F.col("person") != self_id))
    event = F.col("person").isNull() & now  # once for the event itself, then once for each person
    of_events = facts(
        seen, fact("counts", "events", when=event), fact("counts", "inferred", when=event & (F.col("source") == "messages")), fact("months", F.month(at(F.col("start_ts"))), when=event),
        fact("top_places", F.col("place_name"), when=event & F.col("place_name").isNotNull()),
        fact("_now", F.col("person"), when=F.col("person").isNotNull() & now), fact("_before", F.col("person"), when=F.col("person").isNotNull() & (y == year - 1)), fact("_ever", F.col("person"), when=F.col("person").isNotNull() & (y < year)),
    )
    of_messages = facts(messages.where("meaningful").where(F.year(at(F.col("ts"))) == year).join(thread_identity, "thread_id", "left"), fact("counts", "messages"), fact("_direct", F.col("canonical_id"), when=F.col("canonical_id").isNotNull() & (F.col("canonical_id") != self_id)))
    of_photos = facts(photos.where(F.year(at(F.col("ts"))) == year), fact("counts", "photos"))
    listed = zeros(gatherings, *(("counts", c) for c in ("events", "inferred", "messages", "photos", "people")), *(("months", str(m)) for m in range(1, 13)), *(("concentration", c) for c in ("people", "all", "top1", "top5")))
    # the biggest event is one row, and its people come with it
    largest = gatherings.where(now).agg(F.min(F.struct((-F.coalesce("n_photos", F.lit(0)).cast("long")).alias("n"), "event_id", "start_ts", "participants")).alias("b")).where("b is not null").select("b.*")
    there = F.transform(F.filter("participants", lambda p: p != self_id), lambda p: fact("biggest_event_people", p, F.col("start_ts")))
    biggest = facts(largest, fact("biggest_event", F.col("event_id"), -F.col("n"))).unionByName(largest.select(F.explode(there).alias("_f")).select("_f.*"))
    # counted once and kept: all that follows reads these few rows, not the tables again
    once = cut(counted(of_events, of_messages, of_photos, listed).unionByName(biggest))
    # people: what they were in this year, the one before and ever, side by side
    person = F.col("section").isin("_now", "_before", "_ever")
    have = lambda s: F.max(F.when(F.col("section") == s, F.col("n")))
    people = once.where(person).groupBy("item").agg(have("_now").alias("now"), have("_before").alias("before"), have("_ever").alias("ever"))
    of_people = facts(
        people, fact("most_seen", F.col("item"), F.col("now"), F.col("now").isNotNull()), fact("new_faces", F.col("item"), F.col("now"), F.col("now").isNotNull() & F.col("ever").isNull()),
        fact("lapsed", F.col("item"), F.col("before"), F.col("now").isNull() & F.col("before").isNotNull()), fact("counts", "people", when=F.col("now").isNotNull()),
    )
    direct = once.where("section = '_direct'")
    five = F.row_number().over(Window.partitionBy("section").orderBy(F.col("n").desc(), "item"))
    first = direct.withColumn("r", five).where("r <= 5")
    shares = facts(direct, fact("concentration", "people"), fact("concentration", "all", F.col("n"))).unionByName(facts(first, fact("concentration", "top5", F.col("n")), fact("concentration", "top1", F.col("n"), F.col("r") == 1)))
    own = F.col("section") == "biggest_event_people"
    whole = counted(once.where(~F.col("section").startswith("_") & ~own), of_people, shares)
    out = tops(whole, {"top_places": 8, "biggest_event": 1}).unionByName(once.where(own).select("section", F.lit(None).cast("int").alias("place"), "item", "n"))
    every = whole.where("section = 'concentration' and item = 'all'").agg(F.max("n").alias("n"))
    names = identities.select(F.col("canonical_id").alias("item"), F.col("display_name").alias("name"))
    shared = F.when(F.col("section") == "concentration", F.when(F.lit(every.scalar()) > 0, F.col("n") / every.scalar()).otherwise(0.0))
    return out.join(names, "item", "left").select("section", "place", "item", "name", "n", shared.alias("share")).where("not (section = 'concentration' and item = 'all')").withColumn("share", F.when(F.col("item").isin("top1", "top5") & (F.col("section") == "concentration"), F.col("share")))


def email_summary(emails: DataFrame, top: int = 50) -> DataFrame:
    """A-24: totals, messages by category (null: uncategorized), and the first domains and correspondents by messages."""
    n = F.col("n_messages")
    each = facts(
        emails, fact("totals", "correspondents"), fact("totals", "messages", n), fact("by_category", F.coalesce("category", F.lit("uncategorized")), n), fact("top_domains", F.col("domain"), n, F.col("domain").isNotNull()), fact("top_correspondents", F.col("addr"), n)
    )
    out = tops(counted(each), {"top_domains": top, "top_correspondents": top})
    return out.join(emails.select(F.col("addr").alias("item"), "display_name", "list_unsubscribe").withColumn("section", F.lit("top_correspondents")), ["section", "item"], "left").select("section", "place", "item", "n", "display_name", "list_unsubscribe")


def milestones(messages: DataFrame, threads: DataFrame, thread_identity: DataFrame, photos: DataFrame, photo_faces: DataFrame, gatherings: DataFrame, self_id: str, photo_source: str, years: tuple[int, int] = (2005, 2035), most: int = 10) -> DataFrame:
    """A-28: of each year messages, the person written with most, photos, the one photographed most, and the latest events' names."""
    year = lambda c: F.year(at(F.col(c))).alias("year")
    in_years = lambda d: d.where(F.col("year").between(*years))
    alone = threads.where("not is_group").select("thread_id").join(thread_identity, "thread_id").where(F.col("canonical_id") != self_id)
    m = in_years(messages.where("meaningful").select(year("ts"), "thread_id")).join(alone, "thread_id", "left")
    p = in_years(photos.select(year("ts"), F.col("id").alias("photo_id"), "source"))
    faces = p.join(photo_faces.where(F.col("canonical_id") != self_id), "photo_id")
    e = in_years(gatherings.select(year("start_ts"), "start_ts", "event_id", "place_name"))
    carry = [F.col("year")]
    once = counted(
        facts(m, fact("messages"), fact("_with", F.col("canonical_id"), when=F.col("canonical_id").isNotNull()), carry=carry), facts(p, fact("photos", when=F.col("source") == photo_source), carry=carry),
        facts(faces, fact("_seen", F.col("canonical_id")), carry=carry), facts(e, fact("events"), carry=carry), by=("year", "section", "item"),
    )
    total = lambda s: F.coalesce(F.max(F.when(F.col("section") == s, F.col("n"))), F.lit(0)).alias(s)
    best = lambda s: F.min(F.when(F.col("section") == s, F.struct((-F.col("n")).alias("n"), "item")))
    out = once.groupBy("year").agg(total("messages"), total("photos"), total("events"), best("_with").alias("w"), best("_seen").alias("s"))
    latest = F.row_number().over(Window.partitionBy("year").orderBy(F.col("start_ts").desc(), "event_id"))
    names = e.withColumn("r", latest).where(F.col("r") <= most).groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "place_name"))), lambda x: x["place_name"]), "; ").alias("latest"))
    return out.join(names, "year", "left").select("year", "messages", F.col("w.item").alias("top_person"), (-F.col("w.n")).alias("top_n"), "photos", F.col("s.item").alias("most_photographed"), (-F.col("s.n")).alias("photographed_n"), "events", F.coalesce("latest", F.lit("")).alias("latest"))


def on_this_day(messages: DataFrame, threads: DataFrame, thread_identity: DataFrame, photos: DataFrame, gatherings: DataFrame, month: int, day: int, photo_source: str, most: int = 60) -> DataFrame:
    """A-30: the newest photos of this date in all years, its events, and of each year the messages and the person they were with most."""
    on = lambda c: (F.month(at(F.col(c))) == month) & (F.dayofmonth(at(F.col(c))) == day)
    year = lambda c: F.year(at(F.col(c))).alias("year")
    p = photos.where(on("ts") & (F.col("source") == photo_source) & F.col("asset_path").isNotNull()).orderBy(F.col("ts").desc(), "id").limit(most).select(F.lit("photos").alias("section"), year("ts"), F.col("asset_path").alias("item"), F.lit(None).cast("long").alias("n"))
    e = gatherings.where(on("start_ts")).select(F.lit("events"), year("start_ts"), "place_name", F.col("n_photos").cast("long"))
    alone = threads.where("not is_group").select("thread_id").join(thread_identity, "thread_id")
    m = messages.where("meaningful").where(on("ts")).select(year("ts"), "thread_id").join(alone, "thread_id", "left")
    once = counted(facts(m, fact("messages"), fact("with", F.col("canonical_id"), when=F.col("canonical_id").isNotNull()), carry=[F.col("year")]), by=("year", "section", "item"))
    best = once.groupBy("year").agg(F.min(F.when(F.col("section") == "with", F.struct((-F.col("n")).alias("n"), "item"))).alias("b"), F.max(F.when(F.col("section") == "messages", F.col("n"))).alias("n"))
    return p.union(e).union(best.select(F.lit("people"), "year", "b.item", "n").where("item is not null"))


def interests(topics: DataFrame, event_topics: DataFrame, emails: DataFrame) -> DataFrame:
    """A-32: six lists: video topics, artists and channels (topics: kind, topic, n), event topics (topic, n), mailing lists, and mail categories."""
    videos = topics.select(F.concat(F.lit("video_"), "kind").alias("section"), F.col("topic").alias("item"), F.col("n").cast("long").alias("n"))
    meets = event_topics.select(F.lit("events").alias("section"), F.col("topic").alias("item"), F.col("n").cast("long").alias("n"))
    mail = facts(emails, fact("mailing_lists", F.col("display_name"), F.col("n_messages"), (F.col("kind") != "person") & F.col("display_name").isNotNull()), fact("mail_categories", F.col("category"), when=F.col("category").isNotNull()))
    return tops(counted(videos, meets, mail), {"video_topic": 30, "video_artist": 20, "video_channel": 20, "events": 30, "mailing_lists": 30})


def person_360(person: str, a: dict[str, DataFrame], self_id: str) -> DataFrame:
    """A-29: all facets of one person: stat, by_source, by_year, birthday, mentions, calls, photos (24), co_present (12), events (40), partners (12), meetups (40) and series.

    `a` has messages of the person's threads (pm, meaningful ones count), birthdays, mentions, calls, photos, photo_faces, event_photos and
    gatherings. Rows are filtered to the person before anything else; only co-presence meets other people's faces, by photo.
    facet, item, n; dates are milliseconds.
    """
    mine = F.col("canonical_id") == person
    pm = a["pm"].where(mine & F.col("meaningful"))
    of_messages = facts(pm, fact("stat", "messages"), fact("by_source", F.col("source")), fact("by_year", F.year(at(F.col("ts")))), fact("series_messages", F.year(at(F.col("ts")))))
    ends = pm.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    stat = ends.select(F.explode(F.array(fact("stat", "first_ts", F.col("first")), fact("stat", "last_ts", F.col("last")))).alias("f")).select("f.*").where("n is not null")
    born = a["birthdays"].where(mine).select(F.lit("birthday").alias("section"), F.concat_ws("-", F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("item"), F.lit(1).cast("long").alias("n")).limit(1)
    named = facts(a["mentions"].where(F.col("mentioned_canonical_id") == person), fact("mentions", "messages"))
    calls = a["calls"].where(mine)
    of_calls = facts(calls, fact("calls", "calls"), fact("calls", "seconds", F.col("duration_s")), fact("calls", "missed", when=~F.col("answered")))
    last = calls.agg(F.max("ts").alias("n")).where("n is not null").select(F.lit("calls").alias("section"), F.lit("last_ts").alias("item"), "n")
    faces = a["photo_faces"].where(mine).select("photo_id").distinct()
    mine_photos = a["photos"].select(F.col("id").alias("photo_id"), "ts", "asset_path").join(faces, "photo_id").where("asset_path is not null")
    pictures = mine_photos.select(F.lit("photos").alias("section"), F.col("asset_path").alias("item"), F.col("ts").alias("n"))
    others = facts(a["photo_faces"].where(~mine & (F.col("canonical_id") != self_id)).dropDuplicates(["photo_id", "canonical_id"]).join(faces, "photo_id", "left_semi"), fact("co_present", F.col("canonical_id")))
    shown = a["event_photos"].join(faces, "photo_id", "left_semi").select("event_id").distinct()
    there = F.array_contains("participants", person)
    g = a["gatherings"].join(shown.withColumn("shown", F.lit(True)), "event_id", "left").where(there | F.col("shown"))
    y = F.year(at(F.col("start_ts")))
    of_events = facts(g, fact("events", F.col("event_id"), F.col("start_ts"), F.col("shown")), fact("meetups", F.col("event_id"), F.col("start_ts"), there & (F.col("source") == "messages")), fact("series_events", y, when=there))
    partners = facts(g.where(there).select(F.explode(F.array_except("participants", F.array(F.lit(person), F.lit(self_id)))).alias("other")), fact("partners", F.col("other")))
    whole = counted(of_messages, named, of_calls, others, of_events, partners).unionByName(stat).unionByName(born).unionByName(last).unionByName(pictures)
    return tops(whole, {"photos": 24, "co_present": 12, "events": 40, "partners": 12, "meetups": 40}).withColumnRenamed("section", "facet")
