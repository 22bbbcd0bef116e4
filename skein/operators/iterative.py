"""Loops of joins: components and chains of mappings. State is cut by checkpoints; only counts reach the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, rounds: int = 40, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """G-06: (node, component) with the least node reachable, by min-label propagation with pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "m").alias("label"))
        jump = step.withColumnRenamed("label", "mid").join(step.select(F.col("node").alias("mid"), "label"), "mid")
        new = cut(jump.select("node", F.least("mid", "label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def resolve_chain(mapping: DataFrame) -> DataFrame:
    """I-10: mapping(loser, winner, ordinal) with every winner followed to its end; the last row for a loser wins, and a cycle ends at its least id.

    Steps double in length, so that n mappings are followed in log2(n) rounds; what is open then leads into a cycle.
    """
    last = Window.partitionBy("loser").orderBy(F.col("ordinal").desc())
    m = mapping.where("loser <> winner").withColumn("_r", F.row_number().over(last)).where("_r = 1").select("loser", "winner")
    m = cut(m.withColumns({"seen": F.least("loser", "winner")}))
    for _ in range(m.count().bit_length() + 1):
        n = m.select(F.col("loser").alias("winner"), F.col("winner").alias("next"), F.col("seen").alias("low"))
        j = m.join(n, "winner", "left")
        new = cut(j.select("loser", F.when(F.col("next").isNull(), F.col("winner")).otherwise(F.col("next")).alias("winner"), F.least("seen", F.coalesce("low", "seen")).alias("seen")))
        open_ = new.join(new.select(F.col("loser").alias("winner")), "winner", "left_semi").where("winner <> loser").limit(1).count()
        m = new
        if not open_:
            break
    looped = F.col("_l").isNotNull()
    ends = m.join(m.select(F.col("loser").alias("winner"), F.col("loser").alias("_l")), "winner", "left")
    return ends.select("loser", F.when(looped, F.col("seen")).otherwise(F.col("winner")).alias("winner")).where("loser <> winner")
