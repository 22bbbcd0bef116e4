"""Substring dedup by parsing documents against indexed reference blocks (relative Lempel-Ziv).

Contexts: in every window of SPAN words the least hash of its word grams is an anchor, so equal windows have
the same anchor at the same place. All words of the windows that chose one anchor are its context; contexts
tile a document's windows. Equal contexts are one, held by the least document that has it: in all others it
is a factor as a whole.

Parse: the different contexts of an anchor are dealt over reference blocks of at most about BLOCK contexts.
In a block every context is parsed against those of smaller documents: a window is looked up in the block's
index, which points to the reference that held it first; from there the factor is extended word by word as
far as the reference's text agrees. A factor ends at its first differing word, and a window that crosses the
boundary between two factors counts only if it's looked up and found itself. What a block doesn't have is
looked up in the indexes of the anchor's other blocks: a join with the least holder of every such window,
which is aggregated before it's shuffled, so that no task gathers all documents that share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .shingles import EMPTY, mixed, word_hashes

SPAN, GRAM = 50, 16
BLOCK = 2_000  # different contexts of an anchor that are parsed together
NO_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling."""
    if len(h) < n:
        return EMPTY
    out, power, at, size, total = None, h, 0, 1, len(h) - n + 1
    while size <= n:
        if n & size:
            part = power[at : at + total]
            out = part.copy() if out is None else mixed(out * _A + part)
            at += size
        power = mixed(power[:-size] * _B + power[size:]) if len(power) > size else EMPTY
        size *= 2
    return mixed(out + np.uint64(n))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for every window of SPAN words the position of the gram that it chose."""
    g = run_hashes(h, GRAM)
    width = SPAN - GRAM + 1
    if len(h) < SPAN:
        return g, np.zeros(0, dtype=np.int64)
    return g, np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(len(g) - width + 1)


def contexts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: the anchor, a hash of the context, its first window and the number of windows."""
    g, chosen = anchors(h)
    if not len(chosen):
        return EMPTY, EMPTY, chosen, chosen
    first = np.flatnonzero(np.r_[True, np.diff(chosen) != 0])
    last = np.r_[first[1:], len(chosen)] - 1
    windows = run_hashes(h, SPAN)  # the first and the last one hold all words of a context
    key = mixed(windows[first] * _A + windows[last] * _B + ((chosen[first] - first) * 64 + last - first).astype(np.uint64))
    return g[chosen[first]], key, first, last - first + 1


def keyed(documents: DataFrame) -> DataFrame:
    """place (doc_id; nulls last), row (a hash of the text) and text; rows are told apart by place and row together.

    All joins of texts use just these columns, so that texts are shuffled once and the exchange is reused.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("place"), F.xxhash64("text").alias("row"), "text")


def index(rows: DataFrame) -> DataFrame:
    """anchor, context, place, row, first, n: the contexts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                found = [contexts(word_hashes(text.encode())) for text in part["text"]]
                each = [len(f[0]) for f in found]
                columns = [np.concatenate([f[i] for f in found]) for i in range(4)]
                owner = [np.repeat(np.array(part[c], dtype=np.int64), each) for c in ("place", "row")]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), *map(pa.array, owner), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))], ["anchor", "context", "place", "row", "first", "n"])

    return rows.mapInArrow(run, "anchor long, context long, place long, row long, first int, n int")


def spelled(rows: DataFrame) -> DataFrame:
    """From rows(place, row, text, met: array of (anchor, context, blocks, first, n)): the word hashes of these contexts, dealt over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128).to_pydict(), []
                for place, text, met in zip(*(part[c] for c in ("place", "text", "met")), strict=True):
                    h = word_hashes(text.encode())
                    out += [(m["anchor"], m["context"] % m["blocks"], m["blocks"], m["context"], place, h[m["first"] : m["first"] + m["n"] + SPAN - 1].tobytes()) for m in met]
                for at in range(0, len(out), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 5_000], strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], ["anchor", "block", "blocks", "context", "place", "words"])

    return rows.mapInArrow(run, "anchor long, block long, blocks long, context long, place long, words binary")


class Block:
    """A reference block: texts in ascending order of document, and an index of the windows that they hold first."""

    def __init__(self):
        self.texts: list[tuple[int, np.ndarray]] = []
        self.index: dict[int, tuple[int, int]] = {}
        self.known: set[int] = set()

    def parse(self, context: int, place: int, words: np.ndarray, windows: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """Factors (first and last window) that smaller documents hold, and the windows that none of them holds."""
        if context in self.known:  # another row of the same document and text
            return [], []
        self.known.add(context)
        factors, rest, j = [], [], 0
        self.texts.append((place, words))
        while j < len(windows):
            number, q = self.index.setdefault(windows[j], (len(self.texts) - 1, j))
            owner, text = self.texts[number]
            if owner < place:
                length = agreeing(words[j:], text[q:])
                if length >= SPAN:
                    factors.append((j, j + length - SPAN))
                    j += length - SPAN + 1  # the next window crosses the factor's end
                    continue
            rest.append(j)
            j += 1
        return factors, rest


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a and b share from their beginnings on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def parsed(texts: DataFrame) -> DataFrame:
    """anchor, context, place, first, last, window: factors within a block (window null), and windows to ask other blocks about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()
        for batch in batches:
            part, out = batch.to_pydict(), []
            joined = np.frombuffer(b"".join(part["words"]), np.uint64)
            hashes, at = run_hashes(joined, SPAN).view(np.int64).tolist(), 0
            for anchor, number, blocks, context, place, raw in zip(*(part[c] for c in ("anchor", "block", "blocks", "context", "place", "words")), strict=True):
                if (anchor, number) != now:
                    now, block = (anchor, number), Block()
                n = len(raw) // 8
                factors, rest = block.parse(context, place, joined[at : at + n], hashes[at : at + n - SPAN + 1])
                out += [(anchor, context, place, a, b, None) for a, b in factors]
                if blocks > 1:
                    out += [(anchor, context, place, j, j, hashes[at + j]) for j in rest]
                at += n
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000], strict=True), (*[pa.int64()] * 3, *[pa.int32()] * 2, pa.int64()), strict=True)], ["anchor", "context", "place", "first", "last", "window"])

    dealt = texts.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "place")
    return dealt.mapInArrow(run, "anchor long, context long, place long, first int, last int, window long")


def factors(rows: DataFrame) -> DataFrame:
    """place, row, first, last: the windows of rows(place, row, text) that also stand in a document of smaller place."""
    ship(rows.sparkSession)
    indexed = cut(index(rows))
    # cut, so that joins have exchanges of their own, which are split where one key has many rows
    shared = cut(indexed.groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("anchor"))
    indexed = cut(indexed.join(shared, "anchor"))
    held = indexed.groupBy("anchor", "context").agg(F.min(F.struct("place", "row", "first", "n")).alias("who"), F.max("place").alias("high"))
    held = cut(held.select("anchor", "context", "who.*", "high"))
    met = held.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    met = cut(met.select("anchor", F.ceil(F.col("m") / BLOCK).alias("blocks")))
    asked = held.join(met, "anchor").groupBy("place", "row").agg(F.collect_list(F.struct("anchor", "context", "blocks", "first", "n")).alias("met"))  # as many as a row has windows
    texts = spelled(rows.join(asked, ["place", "row"]).select("place", "text", "met"))
    found = cut(parsed(texts))
    open_ = found.where("window is not null")
    least = cut(open_.groupBy("anchor", "window").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most"))
    elsewhere = open_.join(least, ["anchor", "window"]).where("least < place")
    own = found.where("window is null").select("anchor", "context", "first", "last").union(elsewhere.select("anchor", "context", "first", "last"))
    own = own.groupBy("anchor", "context").agg(F.collect_set(F.struct("first", "last")).alias("own"))  # as many as a context has windows
    held = held.select("anchor", "context", F.col("place").alias("low"), "high").join(own, ["anchor", "context"], "left").where("low < high or own is not null")
    every = indexed.join(cut(held), ["anchor", "context"])
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    spans = F.when(F.col("place") > F.col("low"), whole).otherwise(F.col("own"))
    return every.select("place", "row", F.col("first").alias("at"), F.explode(spans).alias("f")).select("place", "row", (F.col("at") + F.col("f.first")).alias("first"), (F.col("at") + F.col("f.last")).alias("last"))


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, text and spans (first, last window start) of every row of documents."""
    rows = keyed(documents)
    spans = factors(rows).groupBy("place", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return rows.join(spans, ["place", "row"], "left").select(F.nullif("place", F.lit(NO_ID)).alias("doc_id"), "text", "spans")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of documents(doc_id, text, ...).

    Words are split at ASCII white space, unchanged. Null and empty texts have no words; rows without
    doc_id come after all others; rows of one doc_id don't count as smaller than each other; empty tables
    give no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256).to_pydict(), []
                for doc_id, text, spans in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                    words = text.encode().split()
                    kept = words
                    if spans:
                        gone = covered(len(words), spans, SPAN)
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removals(documents).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def covered(n: int, spans: list[dict], width: int) -> np.ndarray:
    """Which of n places lie in a window of `width` that starts in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["last"] + width] -= 1
    return np.cumsum(edge[:n]) > 0
