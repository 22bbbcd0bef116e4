"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

A row's number is its rank by (doc_id, text checksum, size). A balanced Feistel network permutes
[0, left * right) where left * right is the least such product of near-equal factors that holds all
rows; numbers that fall outside [0, n) walk the cycle until they are inside, so the result is a
permutation of [0, n) that any worker computes without a shuffle: shard = place % shards, slot =
place // shards.  Shard sizes differ by at most one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _sides(n: int) -> tuple[int, int]:
    left = max(1, math.isqrt(max(0, n - 1)) + 1)
    return left, max(1, -(-n // left))


def _pass(x: np.ndarray, left: int, right: int, seed: int, inverse: bool) -> np.ndarray:
    a, b = x // right, x % right
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        side = left if r % 2 == 0 else right
        other = b if r % 2 == 0 else a
        shift = (_mix(other, seed * ROUNDS + r) % np.uint64(side)).astype(np.int64)
        moved = ((a if r % 2 == 0 else b) + (side - shift if inverse else shift)) % side
        a, b = (moved, b) if r % 2 == 0 else (a, moved)
    return a * right + b


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of [0, n) for `seed`, or its inverse, of each number in x."""
    out = np.asarray(x, dtype=np.int64)
    if n <= 1:
        return np.zeros_like(out)
    left, right = _sides(n)
    with np.errstate(over="ignore"):
        out = _pass(out, left, right, seed, inverse)
        while (outside := out >= n).any():
            out[outside] = _pass(out[outside], left, right, seed, inverse)
    return out


def shard(documents: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Shard and slot of every row of documents(doc_id, text, ...).

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), row_number.
    Null texts count as no bytes (size 16, checksum 0); rows with null or repeated doc_id are rows
    like any other (nulls first; wholly equal rows are interchangeable); an empty table gives no
    rows; further columns of documents are ignored.
    """
    ship(documents.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, n = numbered(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")),
        "doc_id", "text_crc32", "size", name="row_number",
    )

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    placed = rows.withColumn("place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
