"""Data-quality gates (D rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(messages: DataFrame) -> DataFrame:
    """D-01: rows, newest time and a checksum of ids by source; the checksum doesn't depend on order."""
    return messages.groupBy("source").agg(F.count("*").alias("messages"), F.max("ts").alias("newest"), F.bit_xor(F.crc32(F.col("id").cast("binary"))).alias("checksum"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """D-02: sources missing, counted down or moved backwards between two manifests."""
    b, a = before.select("source", F.col("messages").alias("m0"), F.col("newest").alias("t0")), after.select("source", F.col("messages").alias("m1"), F.col("newest").alias("t1"))
    problem = F.when(F.col("m1").isNull(), "missing").when(F.col("m1") < F.col("m0"), "count down").when(F.col("t1") < F.col("t0"), "newest backwards")
    return b.join(a, "source", "full").where(F.col("m0").isNotNull()).withColumn("problem", problem).where("problem is not null").select("source", "m0", "m1", "problem")


def health(messages: DataFrame, identities: DataFrame, thread_identity: DataFrame, least: int) -> DataFrame:
    """D-03: one row a check: enough messages, no names that differ in case only, no threads without identity."""
    n = messages.agg(F.count("*").alias("v")).select(F.lit("messages").alias("check"), "v", (F.col("v") >= least).alias("ok"))
    twins = identities.groupBy(F.lower("display_name").alias("k")).agg(F.count_distinct("display_name").alias("c")).agg(F.count_if(F.col("c") > 1).alias("v")).select(F.lit("case_twins").alias("check"), "v", (F.col("v") == 0).alias("ok"))
    orphans = thread_identity.join(identities, "canonical_id", "left_anti").agg(F.count("*").alias("v")).select(F.lit("orphans").alias("check"), "v", (F.col("v") == 0).alias("ok"))
    return n.unionByName(twins).unionByName(orphans)


def run_steps(steps: list[tuple[str, Callable[[], object], bool]]) -> list[tuple[str, str]]:
    """D-04: steps (name, function, critical) in order; a failure is reported, and one of a critical step ends the run."""
    report = []
    for name, step, critical in steps:
        try:
            step()
            report.append((name, "ok"))
        except Exception as error:  # noqa: BLE001  each step is on its own
            report.append((name, f"failed: {error}"))
            if critical:
                break
    return report
