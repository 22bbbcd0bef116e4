"""Shaping of rows that parsers and exports deliver (S rows that are relational)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calls(rows: DataFrame) -> DataFrame:
    """S-18: direction, missed and service of call records (answered, duration_s, provider)."""
    return rows.withColumns({"missed": ~F.col("answered") & (F.col("duration_s") == 0), "service": F.when(F.col("provider").rlike("(?i)facetime"), "facetime").otherwise("phone")})


def tail_merge(base: DataFrame, newer: DataFrame) -> DataFrame:
    """S-03: all of base, and of newer what is strictly after a thread's last base row; threads without base rows come whole."""
    cut = base.groupBy("thread_id").agg(F.max("ts").alias("_cut"))
    tail = newer.join(cut, "thread_id", "left").where(F.col("_cut").isNull() | (F.col("ts") > F.col("_cut"))).drop("_cut")
    return base.unionByName(tail)


def multiset_union(rows: DataFrame, key: list[str]) -> DataFrame:
    """S-05: rows(export, key...) merged so that each key comes as often as in the export that has it most."""
    n = rows.groupBy("export", *key).agg(F.count("*").alias("c")).groupBy(*key).agg(F.max("c").alias("c"))
    return n.select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("copy"))


def reindexed(rows: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Ids '<prefix><thread>#<n>' by order within a thread, from 0."""
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy(*order)) - 1
    return rows.withColumn("id", F.concat(F.lit(prefix), F.col("thread_id"), F.lit("#"), n.cast("string")))


def correspondents(rows: DataFrame) -> DataFrame:
    """S-14: roll-up by domain: messages, whether any is bulk, and the first display name."""
    named = F.when(F.col("display_name").isNotNull(), F.col("n"))
    return rows.groupBy("domain").agg(F.sum("n_messages").cast("long").alias("_n"), F.bool_or("list_unsubscribe").alias("bulk"), F.min_by("display_name", named).alias("display_name")).withColumnRenamed("_n", "n")


def birthday_precedence(rows: DataFrame) -> DataFrame:
    """S-17: one row for each name and day; vCards before calendars, then by order k."""
    w = Window.partitionBy(F.lower("name"), "month", "day").orderBy((F.col("source") != "vcard").cast("int"), "k")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def strongest_response(rows: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """S-22: of each event (name, start) the row of the strongest response, later ones winning ties."""
    rank = F.lit(-1)
    for i, r in enumerate(ranks):
        rank = F.when(F.col("response") == r, i).otherwise(rank)
    w = Window.partitionBy("name", "start_ts").orderBy(rank.desc(), F.col("ordinal").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """S-28/K-03: old rows and those new ones whose key isn't there yet."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti").select(*old.columns))


def overlap_fetch(base: DataFrame, fetched: DataFrame, key: list[str], margin_days: int = 2) -> DataFrame:
    """T-09: base and what was fetched since its newest row of a source less a margin; of what stands in the overlap twice, by content, one copy stays.

    Contents come as often as on the side that has them most, as rows alike may be two messages; a source without base rows comes whole.
    """
    since = base.groupBy("source").agg((F.max("ts") - margin_days * 86_400_000).alias("_since"))
    late = fetched.join(since, "source", "left").where(F.col("_since").isNull() | (F.col("ts") >= F.col("_since"))).drop("_since")
    both = base.select(F.lit("base").alias("export"), "source", *key).unionByName(late.select(F.lit("fetched").alias("export"), "source", *key))
    return multiset_union(both, ["source", *key]).drop("copy")
