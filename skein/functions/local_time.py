"""Local time by a table of rules (F-15, F-16): the zone that a person was in on a day, looked up in an index of spans.

Rules are (rule, canonical_id, from_day, to_day, zone, label): half-open windows of UTC days, of which the first that
holds a day wins; null bounds are open. A person's rules are cut once into disjoint spans in order, so that a lookup is
the last span that begins by the day, and no row is joined with several rules. Messages stay where they are while the
index is small enough to go to them; that's checked, and beyond it the index is joined by person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import at

INDEXED_PEOPLE = 100_000  # people whose spans may go to every task
FALLBACK = "UTC?"
#: Zones whose short names are shown as such: standard offset in minutes, standard and daylight name.
SHORT = {
    "America/New_York": (-300, "EST", "EDT"), "America/Chicago": (-360, "CST", "CDT"), "America/Denver": (-420, "MST", "MDT"), "America/Phoenix": (-420, "MST", "MDT"),
    "America/Los_Angeles": (-480, "PST", "PDT"), "America/Anchorage": (-540, "AKST", "AKDT"), "Pacific/Honolulu": (-600, "HST", "HDT"), "UTC": (0, "UTC", "UTC"),
}


def zone_spans(rules: DataFrame) -> DataFrame:
    """canonical_id and its spans (from_day, zone, label), disjoint and in order; a span ends where the next begins, and one without zone is a gap."""
    rule = F.struct("rule", F.coalesce("from_day", F.lit("0001-01-01").cast("date")).alias("a"), F.coalesce("to_day", F.lit("9999-12-31").cast("date")).alias("b"), "zone", F.coalesce("label", "zone").alias("label"))
    of_person = rules.groupBy("canonical_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("rules", lambda r: F.array(r["a"], r["b"])))))

    def span(day: Column) -> Column:
        first = F.get(F.filter("rules", lambda r: (r["a"] <= day) & (day < r["b"])), F.lit(0))
        return F.struct(day.alias("from_day"), first["zone"].alias("zone"), first["label"].alias("label"))

    return of_person.select("canonical_id", F.transform(edges, span).alias("spans"))


def local_time(df: DataFrame, ts: str, person: str, rules: DataFrame) -> DataFrame:
    """F-15: df with `zone`, `zone_label` and `local` (a zone-less timestamp), where `person` was at `ts`; UTC where no rule says."""
    index = zone_spans(rules).withColumnRenamed("canonical_id", "_person")
    index = F.broadcast(index) if index.count() <= INDEXED_PEOPLE else index
    found = df.join(index, F.col(person) == F.col("_person"), "left")
    day = F.to_date(at(F.col(ts)))
    span = F.try_element_at(F.filter("spans", lambda s: s["from_day"] <= day), F.lit(-1))
    zone = F.coalesce(span["zone"], F.lit("UTC"))
    return found.withColumns({"zone": zone, "zone_label": F.coalesce(span["label"], F.lit(FALLBACK)), "local": F.from_utc_timestamp(at(F.col(ts)), zone)}).drop("_person", "spans")


def zone_tag(ts: str, zone: str = "zone", label: str = "zone_label", local: str = "local") -> Column:
    """The zone's short name where it has one, the rule's label, or the offset."""
    minutes = ((F.unix_seconds(F.col(local)) - F.unix_seconds(at(F.col(ts)))) / 60).cast("int")
    far, rest = F.abs(minutes), F.abs(minutes) % 60
    offset = F.concat(F.lit("GMT"), F.when(minutes < 0, "-").otherwise("+"), F.floor(far / 60).cast("string"), F.when(rest > 0, F.concat(F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))).otherwise(""))
    tag = F.when(F.col(label) != F.col(zone), F.col(label)).otherwise(offset)
    for name, (standard, winter, summer) in SHORT.items():
        tag = F.when(F.col(zone) == name, F.when(minutes == standard, winter).otherwise(summer)).otherwise(tag)
    return tag


def formatted(ts: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """F-15's text of a row of local_time: local time and zone."""
    return F.concat_ws(" ", F.date_format("local", pattern), zone_tag(ts))


def two_sided(df: DataFrame, ts: str, sender: str, receiver: str, rules: DataFrame) -> DataFrame:
    """F-16: df with `shown`: the sender's local date and time, and the receiver's time beside it unless it's the same."""
    mine = local_time(df, ts, sender, rules).withColumns({"_mine": formatted(ts), "_label": F.col("zone_label"), "_clock": formatted(ts, "HH:mm")}).drop("zone", "zone_label", "local")
    both = local_time(mine, ts, receiver, rules).withColumn("_theirs", formatted(ts, "HH:mm"))
    same = (F.col("_clock") == F.col("_theirs")) & (F.col("_label") == F.col("zone_label"))
    return both.withColumn("shown", F.when(same, F.col("_mine")).otherwise(F.concat_ws(" / ", "_mine", "_theirs"))).drop("_mine", "_theirs", "_clock", "_label", "zone", "zone_label", "local")
