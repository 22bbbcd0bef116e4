"""Aggregation, windows, sampling and sets (Q rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """Q-10: the first k rows of each group; end the order with a unique key for stable results."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def arg_max(df: DataFrame, group: list[str], arg: str, by: list[str]) -> DataFrame:
    """Q-05: the argument of the greatest `by`; rows with a null argument don't count."""
    return df.where(F.col(arg).isNotNull()).groupBy(*group).agg(F.max_by(arg, F.struct(*by)).alias(arg))


def around(df: DataFrame, ts: str, anchor: int, before: int, after: int, key: str) -> DataFrame:
    """Q-13: up to before + 1 rows at or before the anchor and `after` rows past it; two top-k reads."""
    old = df.where(F.col(ts) <= anchor).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(before + 1)
    new = df.where(F.col(ts) > anchor).orderBy(ts, key).limit(after)
    return old.unionByName(new)


def systematic(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """Q-18: rows floor(i * n / k) of each group, i = 0 .. k - 1; all rows of groups up to k."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.floor(F.ceil(F.col("_i") * k / F.col("_n")) * F.col("_n") / k)  # the least pick that isn't before this row
    return d.where((F.col("_n") <= k) | ((step == F.col("_i")) & (F.ceil(F.col("_i") * k / F.col("_n")) < k))).drop("_i", "_n")


def stride(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """Q-19: every max(1, floor(n / limit))-th row of a group, at most `limit`."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / limit))
    return d.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < limit)).drop("_i", "_n")


def head_middle_tail(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """Q-20: a quarter of k from the start, half from the middle, a quarter from the end; all rows of groups up to k."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    q, h = k // 4, k - 2 * (k // 4)
    mid = F.floor((F.col("_n") - h) / 2)
    keep = (F.col("_n") <= k) | (F.col("_i") < q) | (F.col("_i") >= F.col("_n") - q) | ((F.col("_i") >= mid) & (F.col("_i") < mid + h))
    return d.where(keep).drop("_i", "_n")


def shares(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Q-21: one row: the share of the greatest value and of the k greatest in the total."""
    top = df.orderBy(F.col(value).desc(), key).limit(k)
    total = df.agg(F.sum(value)).scalar()
    return top.agg(F.max(value).alias("a"), F.sum(value).alias("b")).select((F.col("a") / total).alias("top1_share"), (F.col("b") / total).alias("topk_share"))


def months(df: DataFrame, group: list[str], ts: str, value: Column) -> DataFrame:
    """Q-22: a value for each month from a group's first to its last, 0 where there's nothing."""
    m = df.withColumn("month", F.date_trunc("month", F.timestamp_millis(ts)).cast("date")).groupBy(*group, "month").agg(value.alias("n"))
    spine = m.groupBy(*group).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    spine = spine.select(*group, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(m, [*group, "month"], "left").select(*group, F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
