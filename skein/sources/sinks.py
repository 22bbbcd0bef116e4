"""Sinks (K rows) and copying between archives (S-31)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """K-01/K-02: a whole rebuild, or only of the partitions that df has rows of."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def insert_ignore(spark: SparkSession, df: DataFrame, path: str, key: list[str]) -> None:
    """K-03: append the rows whose key isn't stored yet."""
    new = df.dropDuplicates(key)
    fs, make = _files(spark, path)
    if fs.exists(make(path)):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def artifact(df: DataFrame, path: str) -> None:
    """K-04/K-05: nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def sidecar(photos: DataFrame, places: DataFrame, path: str) -> None:
    """K-06: photo rows for a side process, with city and country."""
    photos.join(places.select(F.col("photo_id").alias("id"), "city", "country"), "id", "left").write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, the path, and a way to make others; local folders and cluster stores alike."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _point(spark: SparkSession, root: str, entry: dict) -> None:
    """Let the pointer name a version: a small file, written whole and renamed over the old one in one step."""
    fs, make = _files(spark, root)
    out = fs.create(make(f"{root}/.next"), True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    gateway, hadoop = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(make(f"{root}/.next"), make(f"{root}/current.json"), options)


def publish(df: DataFrame, root: str, version: str, gate=None) -> dict:
    """K-07: write a version, gate it, then let the pointer name it; a failed gate leaves the pointer and takes the version away.

    Readers see the old version or the new one.
    """
    spark, path = df.sparkSession, f"{root}/{version}"
    fs, make = _files(spark, root)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    manifest = back.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*back.columns)).alias("checksum")).first().asDict()
    if gate and not gate(manifest):
        fs.delete(make(path), True)
        raise ValueError(f"gate refused {version}: {manifest}")
    _point(spark, root, {"version": version, **manifest})
    return manifest


def publish_together(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Rewrite several tables as one: all are written beside the old ones, then one pointer names the new set.

    A run that ends in between leaves the old set current; the same version can be written again.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    _point(spark, root, {"version": version, "tables": sorted(tables)})


def together(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current set."""
    entry = json.loads(spark.read.text(f"{root}/current.json", wholetext=True).first()[0])
    return {name: spark.read.parquet(f"{root}/{entry['version']}/{name}") for name in entry["tables"]}


def active(spark: SparkSession, root: str) -> str:
    """The version that the pointer names."""
    return json.loads(spark.read.text(f"{root}/current.json", wholetext=True).first()[0])["version"]


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{active(spark, root)}")


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """K-08: remove all but the active and the newest `keep` versions."""
    fs, make = _files(spark, root)
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(make(root)) if s.isDirectory()), reverse=True)
    now = active(spark, root)
    gone = [name for _, name in found[keep:] if name != now]
    for name in gone:
        fs.delete(make(f"{root}/{name}"), True)
    return gone


def carry_over(spark: SparkSession, old: str, new: str, key: list[str]) -> None:
    """S-31: rows of a cache table of an old archive that the new one lacks."""
    insert_ignore(spark, spark.read.parquet(old), new, key)
