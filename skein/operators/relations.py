"""Dated moments with the people written with most, and whom to check in with (A-21, A-22). `today` is a parameter, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at, round_half_up, strip

#: Formats of portraits. A section of moments up to the next heading of its level; moments as bold dates, and as titles with a date; the line under the title.
SECTION = r"(?i)##\s+Anchor moments?\s*\n([\s\S]*?)(?=\n##\s+|\z)"
BOLD = r"\*\*(\d{4}-\d{2}-\d{2})(?:\*\*)?\s*[—\-–]\s*([^*\n]+?)\.?\*\*"
TITLED = r"###\s+([^\n(]+?)\s+\(([A-Za-z]{3})\s+(\d{1,2})\s+(\d{4})"
ESSENCE = r"(?m)^#\s+[^\n]+\n\n\*([^*\n]+)\*"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def anchors(portraits: DataFrame) -> DataFrame:
    """name, date, summary and place of the moments that Markdown portraits(name, text) list.

    A date and summary (whatever its case) that come again count once, where they come first. Moments of bold
    dates are before those of titles; places order those of one date. Without a section the whole text is searched.
    """
    body = F.when(F.col("text").rlike(SECTION), F.regexp_extract("text", SECTION, 1)).otherwise(F.col("text"))
    every = lambda pattern, group: F.regexp_extract_all("_body", F.lit(pattern), F.lit(group))
    bold = F.transform(F.arrays_zip(every(BOLD, 1).alias("d"), every(BOLD, 2).alias("s")), lambda m: F.struct(m["d"].alias("date"), strip(F.regexp_replace(strip(m["s"]), r"\.\z", "")).alias("summary")))
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m))
    parts = F.arrays_zip(every(TITLED, 1).alias("s"), every(TITLED, 2).alias("m"), every(TITLED, 3).alias("d"), every(TITLED, 4).alias("y"))
    dated = F.filter(parts, lambda m: month(m["m"]) > 0)
    titled = F.transform(dated, lambda m: F.struct(F.concat_ws("-", m["y"], F.lpad(month(m["m"]).cast("string"), 2, "0"), F.lpad(m["d"], 2, "0")).alias("date"), strip(m["s"]).alias("summary")))
    m = portraits.select("name", body.alias("_body")).select("name", F.posexplode(F.concat(bold, titled)).alias("place", "m")).select("name", "place", "m.*").where("summary <> ''")
    return m.groupBy("name", "date", F.lower("summary").alias("_s")).agg(F.min_by("summary", "place").alias("summary"), F.min("place").alias("place")).drop("_s")


def stems(name: Column) -> Column:
    """The file names that a person's portrait may have, best first: all but word characters and hyphens as _, then without the outer ones."""
    a = F.regexp_replace(name, r"[^\w\-]+", "_")
    return F.filter(F.array(a, F.regexp_replace(a, "^_+", ""), F.regexp_replace(a, "_+$", ""), F.regexp_replace(a, "^_+|_+$", "")), lambda s: s != "")


def closest(messages: DataFrame, thread_identity: DataFrame, threads: DataFrame, identities: DataFrame, least: int = 50, top: int = 30) -> DataFrame:
    """The `top` people of over `least` messages with text in threads of two: counts, first, last, and the last message (ties by id)."""
    alone = thread_identity.join(threads.where("not is_group").select("thread_id"), "thread_id")
    m = messages.where("body is not null and body <> ''").join(alone, "thread_id").groupBy("canonical_id").agg(
        F.count("*").alias("msg_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by(F.struct("from_me", "body"), F.struct("ts", "id")).alias("_last"))
    m = m.where(F.col("msg_count") > least).join(identities.select("canonical_id", "display_name"), "canonical_id")
    excerpt = strip(F.regexp_replace(F.substring("_last.body", 1, 200), r"\s+", " "))
    m = m.select("canonical_id", "display_name", "msg_count", "first_ts", "last_ts", F.when(F.col("_last.from_me"), "me").otherwise("them").alias("last_from"), excerpt.alias("excerpt"))
    return m.orderBy(F.col("msg_count").desc(), "canonical_id").limit(top)


def pictured(people: DataFrame, portraits: DataFrame) -> DataFrame:
    """canonical_id, name and text of the portrait of those of people (few: a bounded top) who have one; names are file names without ending."""
    wanted = people.select("canonical_id", F.posexplode(stems(F.col("display_name"))).alias("_k", "name"))
    found = portraits.join(F.broadcast(wanted), "name")  # `closest` bounds it
    return found.groupBy("canonical_id").agg(F.min_by(F.struct("name", "text"), F.struct("_k", "text")).alias("p")).select("canonical_id", "p.*")


def timeline(people: DataFrame, portraits: DataFrame, birthdays: DataFrame, today: int) -> DataFrame:
    """A-21: date, canonical_id, person, kind, summary and source of first and last contacts, portraits' moments and this year's birthdays, by date and person.

    people as `closest` gives them, portraits(name, text), birthdays(canonical_id, month, day, year, source). A last contact on the day of the first isn't listed.
    """
    day = lambda c: F.date_format(at(F.col(c)), "yyyy-MM-dd")
    who = people.select("canonical_id", F.col("display_name").alias("person"), day("first_ts").alias("_a"), day("last_ts").alias("_b"))
    row = lambda df, date, kind, summary, source: df.select(date.alias("date"), "canonical_id", "person", F.lit(kind).alias("kind"), summary.alias("summary"), source.alias("source"))
    own = F.lit("messages")
    first = row(who, F.col("_a"), "first_contact", F.concat(F.lit("first message — "), "person"), own)
    last = row(who.where("_a <> _b"), F.col("_b"), "last_contact", F.concat(F.lit("last message (so far) — "), "person"), own)
    texts = pictured(people, portraits)
    moments = texts.select("canonical_id", "name").join(anchors(texts.select("name", "text").distinct()), "name").join(who.select("canonical_id", "person"), "canonical_id")
    this = F.year(at(F.lit(today)))
    born = birthdays.join(F.broadcast(who), "canonical_id")
    turns = F.when(F.coalesce("year", F.lit(0)) != 0, F.concat(F.lit(" (turns "), (this - F.col("year")).cast("string"), F.lit(")"))).otherwise("")
    date = F.concat_ws("-", this.cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    parts = row(born, date, "birthday", F.concat(F.col("person"), F.lit("'s birthday"), turns), F.concat(F.lit("birthday:"), "source"))
    return first.unionByName(last).unionByName(row(moments, F.col("date"), "anchor", F.col("summary"), F.lit("portrait"))).unionByName(parts).orderBy("date", "person", "canonical_id", "kind", "summary")


def until_birthday(month: Column, day: Column, today: int) -> Column:
    """Days, rounded, to the next midnight (UTC) of a birthday that isn't past; the 29th of February falls on the 1st of March in other years."""
    that = lambda year: F.unix_millis(F.date_add(F.make_date(year, month, F.lit(1)), day - 1).cast("timestamp"))
    this = F.year(at(F.lit(today)))
    following = F.when(that(this) < today, that(this + 1)).otherwise(that(this))
    return F.when((month > 0) & (day > 0), F.floor((following - today) / 86_400_000 + 0.5))


def check_ins(people: DataFrame, portraits: DataFrame, birthdays: DataFrame, today: int) -> DataFrame:
    """A-22: those of `closest` with days since the last word, days until the birthday (of several the first by source and day), what the portrait
    says last, intimacy and attention; `place` counts those with a portrait first, then by attention and messages.

    Somebody last heard of today counts as long unheard of for intimacy, as in the rows to match.
    """
    texts = pictured(people, portraits)
    latest = anchors(texts.select("name", "text").distinct()).groupBy("name").agg(F.max_by(F.concat("date", F.lit(": "), "summary"), F.struct("date", "place")).alias("_latest"))
    essence = F.when(F.col("text").rlike(ESSENCE), strip(F.regexp_extract("text", ESSENCE, 1)))
    texts = texts.join(latest, "name", "left").select("canonical_id", F.lit(True).alias("_p"), F.coalesce("_latest", essence).alias("about_what"))
    born = birthdays.join(F.broadcast(people.select("canonical_id")), "canonical_id").groupBy("canonical_id").agg(F.min(F.struct("source", "month", "day")).alias("b"))
    born = born.select("canonical_id", until_birthday(F.col("b.month"), F.col("b.day"), today).alias("days_until_birthday"))
    p = people.join(texts, "canonical_id", "left").join(born, "canonical_id", "left")
    first, last = (F.to_date(at(F.col(c))) for c in ("first_ts", "last_ts"))
    p = p.withColumns({"has_portrait": F.coalesce("_p", F.lit(False)), "days_since": F.date_diff(F.to_date(at(F.lit(today))), last), "_years": F.greatest(F.lit(0.1), F.date_diff(last, first) / 365)})
    d = F.col("days_since")
    unheard = F.when(d == 0, 999).otherwise(d)
    fresh = F.when(unheard <= 60, 1.0).when(unheard <= 365, 0.7).when(unheard <= 1095, 0.4).otherwise(0.15)
    intimacy = F.log10("msg_count") * 20 * F.sqrt("_years") * fresh * F.when(F.col("has_portrait"), 1.15).otherwise(1.0)
    wait = F.when(d <= 7, 0.0).when(d <= 30, (d - 7) * 1.5).when(d <= 180, 30 + (d - 30) * 0.7).when(d <= 730, 100 - (d - 180) * 0.05).otherwise(70 - F.least(d - 730, F.lit(1000)) * 0.05)
    soon = F.when(F.col("days_until_birthday") <= 14, 60).when(F.col("days_until_birthday") <= 30, 30).otherwise(0)
    attention = F.floor(wait + F.when(F.col("last_from") == "them", 25).otherwise(0) + soon + 0.5)
    p = p.withColumns({"intimacy": round_half_up(intimacy, 10), "years_active": round_half_up(F.col("_years"), 10), "attention": attention})
    order = Window.orderBy(F.col("has_portrait").desc(), F.col("attention").desc(), F.col("msg_count").desc(), "canonical_id")  # `closest` bounds the rows
    return p.withColumn("place", F.row_number().over(order)).select(
        "place", "canonical_id", "display_name", "msg_count", "days_since", "last_from", "excerpt", "days_until_birthday", "has_portrait", "about_what", "intimacy", "years_active", "attention")
