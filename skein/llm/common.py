"""Shared helpers: reading tables, cutting lineage, numbering rows, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import cut

__all__ = ["Recent", "components", "cut", "numbered", "read", "ship", "slices"]

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these bits


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """The package on the executors, and small Arrow batches: rows here hold whole texts, some of them very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    session.ship(spark)


def slices(batches: Iterable, rows: int = 512) -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of Python lists of at most `rows` entries, so that few texts are decoded at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pydict()


def numbered(df: DataFrame, *order: Column | str, name: str = "row") -> tuple[DataFrame, int]:
    """df with a gapless 0-based `name` by `order`, and the number of rows.

    Rows are range-partitioned and sorted; only one count for each partition reaches the driver.
    Rows equal in all order columns may come in any order among themselves.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", LOCAL_BITS)
    counts = sorted((r["p"], r["n"]) for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.col("_place").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    out = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place"), total


FEW_EDGES = 500_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps, a logarithmic number of them, each an aggregation by
    node; links stay distributed, and only a count and a checksum reach the driver to see convergence.
    Up to FEW_EDGES links are a task's work and aren't shuffled from step to step.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few, seen = links.count() <= FEW_EDGES, None
    for _ in range(rounds):
        links = links.coalesce(1) if few else links
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if few else both
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node's smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
        links = cut(large.join(least, "a").select(star.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    node = F.explode(F.array("a", "b")).alias("node")
    return links.select(node, F.col("b").alias("component")).distinct()


class Recent(dict):
    """A bounded memo in two generations: when the newer one is full it becomes the older one."""

    def __init__(self, find, size: int, longest: int = 64):
        super().__init__()
        self.find, self.size, self.longest, self.older = find, size, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
