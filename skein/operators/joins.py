"""Logical join kinds (J rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def star(messages: DataFrame, thread_identity: DataFrame, threads: DataFrame, identities: DataFrame) -> DataFrame:
    """J-01: messages of one-to-one threads with their thread and person."""
    return messages.join(thread_identity, "thread_id").join(threads.select("thread_id", "is_group"), "thread_id").join(identities.select("canonical_id", "display_name"), "canonical_id")


def left_counts(identities: DataFrame, **facts: DataFrame) -> DataFrame:
    """J-02: identities with a count from each fact table (by canonical_id), 0 where there is none."""
    out = identities
    for name, fact in facts.items():
        out = out.join(fact.groupBy("canonical_id").agg(F.count("*").alias(name)), "canonical_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def pairs(df: DataFrame, group: str | list[str], item: str, both: bool = False) -> DataFrame:
    """J-06/J-07: distinct items of a group paired, a < b or a <> b."""
    keys = [group] if isinstance(group, str) else group
    d = df.select(*keys, F.col(item).alias("a")).distinct()
    e = d.withColumnRenamed("a", "b")
    joined = d.join(e, keys)
    return joined.where("a <> b" if both else "a < b")


def by_any_alias(people: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """J-08: names(name, ...) joined to identities by display name or alias, as an equi-join over exploded aliases."""
    keys = people.select("canonical_id", F.explode(F.array_distinct(F.array_union(F.array("display_name"), "aliases"))).alias(name)).distinct()
    return names.join(keys, name, "left")


def overlapping(left: DataFrame, right: DataFrame, pad: int, bucket: int, shared: tuple[str, str] | None = None) -> DataFrame:
    """J-10: rows of left (id, lo, hi) and right (rid, rlo, rhi) whose spans overlap when left is padded.

    Both sides go to the time buckets that they cover; a pair is kept in the first bucket they share only. With `shared`, arrays of
    left and right must have an element in common: rows then meet by bucket and element, and a pair is kept at its least element.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket)))
    lo, hi = F.col("lo") - pad, F.col("hi") + pad
    a = left.withColumns({"_lo": lo, "_hi": hi}).withColumn("_b", span(F.col("_lo"), F.col("_hi")))
    b = right.withColumn("_b", span(F.col("rlo"), F.col("rhi")))
    on = ["_b"]
    if shared:
        each = lambda df, c, less: df.withColumn("_s", F.array_sort(F.array_distinct(F.array_compact(c)))).select("*", F.posexplode("_s").alias("_k", "_e")).withColumn(less, F.slice("_s", F.lit(1), F.col("_k"))).drop("_s", "_k")
        a, b, on = each(a, shared[0], "_l"), each(b, shared[1], "_r"), ["_b", "_e"]
    both = a.join(b, on).where((F.col("rlo") <= F.col("_hi")) & (F.col("rhi") >= F.col("_lo")))
    both = both.where(F.col("_b") == F.floor(F.greatest("_lo", "rlo") / bucket))
    return (both.where(~F.arrays_overlap("_l", "_r")) if shared else both).drop("_b", "_lo", "_hi", "_e", "_l", "_r")


def within(points: DataFrame, ts: str, spans: DataFrame, lo: str, hi: str, pad: int, bucket: int = DAY) -> DataFrame:
    """J-11: points in padded spans, by day bucket and range."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor((F.col(lo) - pad) / bucket), F.floor((F.col(hi) + pad) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(ts) / bucket))
    return p.join(s, "_b").where((F.col(ts) >= F.col(lo) - pad) & (F.col(ts) <= F.col(hi) + pad)).drop("_b")


def nearest(points: DataFrame, pid: str, ts: str, spans: DataFrame, sid: str, lo: str, hi: str, reach: int) -> DataFrame:
    """J-12: each point with its nearest span within reach, and each span with its nearest point of those."""
    gap = F.greatest(F.lit(0), F.col(lo) - F.col(ts), F.col(ts) - F.col(hi)).alias("gap")
    near = within(points, ts, spans, lo, hi, reach).select("*", gap)
    one = near.withColumn("_r", F.row_number().over(Window.partitionBy(pid).orderBy("gap", sid))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(sid).orderBy("gap", pid))).where("_r = 1").drop("_r")


def spatial(left: DataFrame, right: DataFrame, tolerance: float = 0.001, block: int = 1000) -> DataFrame:
    """J-15: left(id, lat, lng) with right(rid, rlat, rlng) closer than the tolerance on both axes.

    Different positions meet by cells, and rows by positions, those of one position on the left in blocks of some `block` rows: many
    rows of one place are then many tasks' work. The result is far larger than what it's made from, so tasks aren't counted by that.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    tasks = 4 * max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = left.groupBy("lat", "lng").agg(F.ceil(F.count("*") / block).alias("_n"))
    r = right.select("rlat", "rlng").distinct().withColumn("_x", F.explode(F.transform(around, lambda k: cell("rlat") + k))).withColumn("_y", F.explode(F.transform(around, lambda k: cell("rlng") + k)))
    near = at.withColumns({"_x": cell("lat"), "_y": cell("lng")}).join(r, ["_x", "_y"]).where((F.abs(F.col("lat") - F.col("rlat")) < tolerance) & (F.abs(F.col("lng") - F.col("rlng")) < tolerance))
    r = right.join(near.drop("_x", "_y"), ["rlat", "rlng"]).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    l = left.join(at, ["lat", "lng"]).withColumn("_k", F.pmod(F.xxhash64("id"), "_n")).drop("_n")
    at, on = F.concat_ws(" ", F.col("lat") + 0.0, F.col("lng") + 0.0), ["_at", "_k"]  # a join deals doubles anew, as it makes one zero of two
    l, r = l.withColumn("_at", at), r.withColumn("_at", at).drop("lat", "lng", "_n")
    return l.repartition(tasks, *on).join(r.repartition(tasks, *on), on).drop(*on)


def by_name(facts: DataFrame, name: str, people: DataFrame, order: str, last: bool = True) -> DataFrame:
    """J-16: a case-insensitive name lookup where the last (or first) person of a name wins."""
    rank = F.col(order).desc() if last else F.col(order).asc()
    keys = people.withColumn("_k", F.lower("display_name")).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(rank))).where("_r = 1")
    return facts.withColumn("_k", F.lower(name)).join(keys.select("_k", "canonical_id"), "_k", "left").drop("_k")


def by_address(facts: DataFrame, address: str, people: DataFrame, order: str) -> DataFrame:
    """J-17: phone or e-mail lookup on normalised keys; the first person of an address wins."""
    norm = lambda c: F.when(c.contains("@"), F.lower(c)).otherwise(F.concat(F.lit("+"), F.regexp_replace(c, r"\D", "")))
    keys = people.select(F.explode("aliases").alias("_alias"), "canonical_id", order).where(F.col("_alias").contains("@") | ~F.col("_alias").rlike("[A-Za-z]"))
    keys = keys.groupBy(norm(F.col("_alias")).alias("_k")).agg(F.min_by("canonical_id", order).alias("canonical_id"))
    return facts.withColumn("_k", norm(F.col(address))).join(keys, "_k", "left").drop("_k")
