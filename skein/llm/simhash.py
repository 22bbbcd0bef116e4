"""SimHash near-duplicates by segment popcounts.

1. Every bit of a fingerprint is the majority of that bit over the XXH64 hashes of the text's word shingles.
   Equal fingerprints are one class.
2. A fingerprint is embedded as the popcounts of its 32 segments of two bits, which pack into one long. A bit
   that differs moves one popcount by one, so the Manhattan distance of two embeddings is at most their Hamming
   distance: what lies within 2 bits lies within 2 in the grid.
3. Range join on the grid: a fingerprint is put into the cells within distance 1 of its embedding, 49 on average.
   Two such balls meet in a cell just where the embeddings are within 2 of each other.
4. In a cell every fingerprint is verified against the cell's least one only, so a cell of m makes m - 1
   candidates. A cell of which some aren't linked to the least one is open, and its fingerprints go on to the
   grid of 64 segments, of one bit each, where Manhattan distance is Hamming distance: all that share a cell
   there are within 2 bits, and links to the cell's least one join them all. So no link is lost, and no cell's
   pairs are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ship
from .filters import pieces

SHINGLE, SEED, BITS, DIFFERING = 3, 42, 64, 2
BLOCK = 1 << 14  # hashes counted at once


def shingle_hashes(text: str, n: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined runs of n words, repeats included, in blocks; fewer words are one run."""
    words: list[bytes] = []
    met = False
    for piece in pieces((text or "").encode().lower()):
        words += piece.split()
        if len(words) < n:
            continue
        met, line = True, b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = list(zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True))
        for at in range(0, len(spans), BLOCK):
            yield np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans[at : at + BLOCK]), np.uint64)
        words = words[len(words) - n + 1 :]
    if words and not met:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def fingerprint(text: str, n: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text; 0 without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, n, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row of documents."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: str) -> Column:
    """The popcounts of the 32 pairs of bits of column fp, two bits each: 0, 1 or 2."""
    odd = f"shiftrightunsigned({fp}, 1)"
    return F.expr(f"(({fp} ^ {odd}) & 6148914691236517205L) | shiftleft(({fp} & {odd}) & 6148914691236517205L, 1)")


def cells_of(classes: DataFrame) -> DataFrame:
    """fp and every cell within distance 1 of its embedding: itself, and one popcount up or down where that stays in 0 to 2."""
    at = classes.select("fp", embedding("fp").alias("at"), F.explode(F.sequence(F.lit(-BITS // 2), F.lit(BITS // 2))).alias("move"))
    at = at.withColumn("shift", F.expr("2 * greatest(abs(move) - 1, 0)"))
    at = at.withColumn("count", F.expr("cast(shiftrightunsigned(at, shift) & 3L as int)")).where("move = 0 or (move > 0 and count < 2) or (move < 0 and count > 0)")
    # up: 0 -> 1 changes the low bit, 1 -> 2 both; down: 1 -> 0 the low bit, 2 -> 1 both
    low = "(move > 0 and count = 0) or (move < 0 and count = 1)"
    return at.select("fp", F.expr(f"case when move = 0 then at when {low} then at ^ shiftleft(1L, shift) else at ^ shiftleft(3L, shift) end").alias("cell"))


def centres_of(classes: DataFrame) -> DataFrame:
    """fp and every cell within distance 1 in the grid of single bits."""
    return classes.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("bit")).select("fp", F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("cell"))


def beside_least(cells: DataFrame) -> DataFrame:
    """cell, least and fp of all fingerprints of cells(fp, cell) that share a cell with a smaller one, its least."""
    # cut, so that the join has exchanges of its own, which are split where one cell has many rows
    least = cut(cells.groupBy("cell").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("most > least").select("cell", "least"))
    return cells.join(least, "cell").where("fp <> least").select("cell", "least", "fp")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join just the fingerprints of classes(fp), all different, which DIFFERING or fewer differing bits connect."""
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= DIFFERING
    beside = cut(beside_least(cells_of(classes)).withColumn("near", near))
    opened = beside.where("not near").select("cell").distinct()
    members = beside.join(opened, "cell", "left_semi").select(F.explode(F.array("fp", "least")).alias("fp")).distinct()
    exact = beside_least(centres_of(cut(members))).where(near)
    ends = [F.col("fp").alias("a"), F.col("least").alias("b")]
    return beside.where("near").select(*ends).union(exact.select(*ends)).distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of documents(doc_id, text, ...).

    Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle. Texts
    that are null or without words have fingerprint zero, linked like any other. Rows of one doc_id are one node
    with all their fingerprints' links; a row without doc_id has a fingerprint, no links and a null component_id.
    Empty tables give no rows; further columns are ignored.
    """
    rows = cut(fingerprints(documents, shingle, seed))
    named = rows.where("doc_id is not null")
    classes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    several = cut(named.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("doc_id", "b"))
    owned = named.join(several, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")
    linked = components(links(classes).union(owned))
    known = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = cut(known.groupBy("component").agg(F.min("least_id").alias("component_id")))
    of_class = cut(known.join(smallest, "component").select("fp", "component_id"))
    found = rows.join(of_class, "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
