"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Documents become token ids; documents longer than a sequence are cut into full sequences and a rest.
Pieces of one length are interchangeable, so the search sees only how many pieces each length has: at
most `capacity` numbers, whatever the size of the corpus.  For each bin it seeds the longest length
left, and a bitset subset-sum over the lengths available finds the fullest feasible combination; the
combination is then taken as often as the counts allow, which uses up at least one length, so there
are never more distinct combinations than lengths.  Pieces get their ranks within a length by salted
counts, and a bounded table of rank ranges gives every rank its sequence and offset.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, slices
from .shingles import mixed, powers

END_ID = 1
CACHE_WORDS = 500_000


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> _WordEncoder:
    return _WordEncoder(path)


class _WordEncoder:
    """Ids of texts under a lower-casing word-level BPE tokenizer, as little-endian unsigned 32-bit bytes.

    Merges never cross words, so a batch of texts is split and hashed as one array of code points, and ids
    of words are looked up by hash; new words go through the library, many at a time. Texts with code
    points outside Latin script and common marks go through the library whole.
    """

    PLAIN = re.compile("[\t\n\r -~\xa0-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u20ac]*")
    SPACE, LETTER, DIGIT, MARK = range(4)
    CHARS = 1 << 19  # characters split at once

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.bytes = np.zeros(len(self.last), dtype=np.int64)  # of a word that a token stands for: one for each of its letters
        for token, i in vocabulary.items():
            self.bytes[i] = len(token.removesuffix("</w>"))
        self.kind = np.full(0x20AD, self.MARK, dtype=np.int8)  # of each code point of a plain text
        self.kind[[9, 10, 13, 32, 160]] = self.SPACE
        for k, spans in ((self.LETTER, "azAZ\xaa\xaa\xb5\xb5\xba\xba\xc0\xd6\xd8\xf6\xf8\u017e"), (self.DIGIT, "09\xb2\xb3\xb9\xb9\xbc\xbe")):
            for low, high in zip(spans[::2], spans[1::2]):
                self.kind[ord(low) : ord(high) + 1] = k
        self.spell = np.random.default_rng(53).integers(0, 1 << 64, len(self.kind), dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}  # place of a word's ids, by the word's hash
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.first, self.count = np.zeros(CACHE_WORDS * 2, dtype=np.int64), np.zeros(CACHE_WORDS * 2, dtype=np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _put(self, hashes: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Store words whose ids stand one after another, and end where `ends` says."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        k = len(self.slot)
        while k + len(hashes) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        begins = np.append(0, ends[:-1])
        self.first[k : k + len(hashes)] = self.used + begins
        self.count[k : k + len(hashes)] = ends - begins
        self.slot.update(zip(hashes, range(k, k + len(hashes)), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[tuple[int, str]]) -> None:
        """Ids of new words. Many are coded as one text, and told apart by the ids that end a word; what doesn't spell each word's bytes is coded word by word."""
        parts = [words[i : i + 256] for i in range(0, len(words), 256)]
        for own, coded in zip(parts, self.library.encode_batch_fast([" ".join([w for _, w in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            spelt = np.diff(np.append(0, np.cumsum(self.bytes[ids]))[np.append(0, ends)])
            if spelt.tolist() == [len(w.encode()) for _, w in own] and ends[-1] == len(ids):
                self._put([h for h, _ in own], ids, ends)
                continue
            for h, word in own:
                one = np.frombuffer(self._whole(word), "<u4")
                self._put([h], one, np.array([len(one)]))

    def _split(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of lower-case code points: runs of letters, single digits, runs of marks, and contractions."""
        kind = np.zeros(len(c) + 2, dtype=np.int8)
        kind[1:-1] = self.kind[c]
        changes = kind[1:] != kind[:-1]
        start = changes[:-1] | (kind[1:-1] == self.DIGIT)
        tick = np.flatnonzero((c == 39) & start & (kind[2:] == self.LETTER))
        if len(tick):
            one = c[tick + 1]
            two = np.append(c, [0, 0])[tick + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            met = tick[short | long]
            start[met + 1] = False
            after = met + np.where(short[short | long], 2, 3)
            after = after[after < len(c)]
            start[after[self.kind[c[after]] == self.LETTER]] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(c))
        words = kind[at + 1] != self.SPACE
        return at[words], end[words]

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Ids of plain, lower-case texts."""
        joined = "\n".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        at, end = self._split(c)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not len(at):
            return [b""] * len(texts)
        up, down = powers(len(c) + 1)
        total = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(self.spell[c] * up[:-1], out=total[1:])
        h = mixed((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
        unique, sample, which = np.unique(h, return_index=True, return_inverse=True)
        hashes = unique.tolist()
        if len(self.slot) > CACHE_WORDS:
            self._forget()
        slot = self.slot
        self._learn([(x, joined[at[i] : end[i]]) for x, i in zip(hashes, sample.tolist(), strict=True) if x not in slot])
        places = np.fromiter(map(slot.__getitem__, hashes), dtype=np.int64, count=len(hashes))[which]
        count = self.count[places]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[places] - (stop - count), count) + np.arange(stop[-1])]
        cuts = np.append(0, stop)[np.searchsorted(at, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, room = [], self.CHARS
        for i, text in enumerate(texts):
            if not self.PLAIN.fullmatch(text) or any(s in text for s in self.specials):
                out[i] = self._whole(text)
                continue
            low = unicodedata.normalize("NFC", text).lower()
            plain.append((i, low))
            room -= len(low)
            if room < 0:
                for (k, _), ids in zip(plain, self._batch([t for _, t in plain]), strict=True):
                    out[k] = ids
                plain, room = [], self.CHARS
        if plain:
            for (k, _), ids in zip(plain, self._batch([t for _, t in plain]), strict=True):
                out[k] = ids
        return out


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and the end id, cut at `capacity`."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        for rows in slices(batches, 1000):
            out: list[tuple] = []
            for doc_id, ids in zip(rows["doc_id"], encoder.encode([t or "" for t in rows["text"]]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each as often as counts allow, whose sum comes nearest to `room` from below.

    A subset-sum over bitsets: bit s of the reach is set if some combination sums to s. Longer lengths
    come first, and the search ends at the first exact fill.
    """
    reach, steps, full = 1, [], 1 << room
    mask = full * 2 - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:  # binary splitting of the multiplicity
            take = min(size, left)
            left -= take
            size *= 2
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of the bins for pieces with these length counts."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        lengths = [longest, *rest]
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // k for x, k in need.items())
        out.append((times, lengths))
        for x, k in need.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def _ranges(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by ascending rank: first rank, how many of it a bin has, first bin, and offsets in the bin."""
    used: dict[int, int] = {}
    table: dict[int, list] = {}
    first_bin = 0
    for times, lengths in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            table.setdefault(x, []).append((used.get(x, 0), len(places), first_bin, places))
            used[x] = used.get(x, 0) + times * len(places)
        first_bin += times
    return table


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, salts: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the end id alone. Rows with null or repeated doc_id are packed like any
    other; an empty table gives no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).alias("_salt")
    cutup = cut(pieces(documents, tokenizer, capacity).select("*", salt))
    counts = cutup.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    starts = counts.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges = _ranges(combinations(histogram, capacity))
    ranked = (
        cutup.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_first") + F.col("_local"))
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {x: np.array([r[0] for r in rows]) for x, rows in ranges.items()}
        for batch in batches:
            seq, off = [], []
            for x, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist(), strict=True):
                first, per, bin_, places = ranges[x][int(np.searchsorted(firsts[x], rank, "right")) - 1]
                seq.append(bin_ + (rank - first) // per)
                off.append(places[(rank - first) % per])
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return out.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
