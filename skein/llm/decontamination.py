"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the number of their word shingles into classes (.., 2^c]. For each class
a document is seen as windows of two consecutive blocks of 2^c shingles, so that a window is of the size
of the items that it is compared with and the containment sought bounds the Jaccard likeness from below
(0.19 at least for an item that stands in one window: with 64 minima, bands of one, a miss has a chance
below 2 in a million; items in several pieces are met by other windows). Block minima of a class are
pairwise minima of the class below, so all classes cost one pass. Candidates are verified by the exact
containment of the item's shingles in the whole document. Documents stay in place: the index of a block
of items, of bounded size, goes to them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .shingles import Permutations, grams, lowered

SHINGLE, CONTAINED = 5, 0.8
MINIMA, SEED = 64, 1729
BLOCK_ITEMS = 20_000  # items in one broadcast index


class Index:
    """Band keys of a block of items: class by class, sorted (band, minimum) keys and the items that have them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.permutations = Permutations(MINIMA, SEED)
        self.sets: list[tuple[int, int, np.ndarray]] = []  # item_id, words in a gram, distinct gram hashes
        keys: dict[int, list] = {}
        self.short: dict[int, dict[int, list]] = {}  # words in a gram -> gram hash -> items that are just this gram
        for item_id, text in items:
            h = lowered(text)
            if not len(h):
                continue
            n = min(SHINGLE, len(h))
            distinct = np.unique(grams(h, n))
            number = len(self.sets)
            self.sets.append((item_id, n, distinct))
            if n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(int(distinct[0]), []).append(number)
                continue
            level = max(0, int(len(distinct) - 1).bit_length())
            low = self.permutations.minima(distinct)
            keys.setdefault(level, []).append((_banded(low[:, None])[:, 0], np.full(MINIMA, number)))
        self.levels = {}
        for level, parts in keys.items():
            key, number = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(key, kind="stable")
            key = key[order]
            marks = np.zeros(1 << max(16, int(16 * len(key)).bit_length()), dtype=bool)  # whether a key may be there
            marks[self._slot(key, len(marks))] = True
            self.levels[level] = (key, number[order], marks)

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        return (key ^ (key >> np.uint64(32)) * np.uint64(0x9E3779B1)) & np.uint64(size - 1)

    def candidates(self, g: np.ndarray) -> set[int]:
        found: set[int] = set()
        if not len(g) or not self.levels:
            return found
        low, top = self.permutations.minima(g, 1 << min(self.levels)), max(self.levels)
        for level in range(min(self.levels), top + 1):
            if level in self.levels:
                windows = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                key, number, marks = self.levels[level]
                asked = _banded(windows)
                asked = np.unique(asked[marks[self._slot(asked, len(marks))]])
                left, right = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
                for a, b in zip(left[left < right], right[left < right], strict=True):
                    found.update(number[a:b].tolist())
            if low.shape[1] > 1:
                odd = low[:, -1:] if low.shape[1] % 2 else low[:, :0]
                even = low[:, : low.shape[1] // 2 * 2]
                low = np.concatenate([np.minimum(even[:, ::2], even[:, 1::2]), odd], axis=1)
        return found

    def search(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, its shingles, how many the document has) for each item that the document contains."""
        g = grams(h, SHINGLE)
        out, numbers = [], self.candidates(g)
        for n, items in self.short.items():
            for value in items.keys() & set(grams(h, n).tolist()):
                numbers.update(items[value])
        if not numbers:
            return out
        have = {n: np.unique(grams(h, n)) for n in {self.sets[k][1] for k in numbers}}
        for k in sorted(numbers):
            item_id, n, distinct = self.sets[k]
            common = int(np.isin(distinct, have[n], assume_unique=True).sum())
            if common >= CONTAINED * len(distinct):
                out.append((item_id, len(distinct), common))
        return out


def _banded(low: np.ndarray) -> np.ndarray:
    """Minima (k, windows) as keys that differ between bands."""
    return low.astype(np.uint64) | (np.arange(len(low), dtype=np.uint64) << np.uint64(32))[:, None]


def _indexes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The index of each block of items, broadcast; a block has about BLOCK_ITEMS items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in mine.collect())))


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (document, item) where the document holds at least 80 % of the item's word 5-grams.

    Returns doc_id, item_id, n_item_shingles, n_common, containment. Words are split at ASCII white space
    with A-Z lower-cased; an item of fewer than five words is one shingle of all its words. Null and empty
    texts of either table match nothing; a null item_id counts as -1; rows with null or repeated ids give
    the rows of their texts; empty tables give no rows; further columns are ignored.
    """
    ship(documents.sparkSession)
    names, kinds = ["doc_id", "item_id", "n_item_shingles", "n_common", "containment"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    docs, out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for rows in slices(batches, 256):
                found = []
                for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                    found += [(doc_id, i, n, c, c / n) for i, n, c in index.value.search(lowered(text))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        part = docs.mapInArrow(run, "doc_id long, item_id long, n_item_shingles int, n_common int, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents whose text contains no benchmark item in the sense of `find`; all columns stay."""
    ship(documents.sparkSession)
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    clean = [not index.value.search(lowered(text)) for text in part.column("text").to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
