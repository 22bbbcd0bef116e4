"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

Windows of SIZE bytes are compared by the suffixes that begin at their anchors: the least hash of a
window's byte grams, leftmost among ties, is its anchor, so equal windows have their anchor at the same
place. Only suffixes whose anchor gram stands elsewhere too are sorted. Every task sorts its suffixes into
a run, merges equal ones into one entry, front-codes the run (each entry is the length that it shares with
the one before, and the rest) and sends its pieces to the partition of their anchors' hash range. There a
loser tree merges the runs; it keeps for every run the prefix known to be shared with the last suffix put
out and never compares it again. The order and shared lengths that come out are the suffix array and its
common prefixes: a suffix in two places makes all its windows repeated, and of the others only those
windows are compared that the longest common prefix with a neighbour leaves possible.  The windows of an
anchor that stands in very many places are dealt over several partitions by their own hash, as suffixes of
one window each, so that no partition gathers all that share a passage.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .shingles import EMPTY, mixed, prefix_hashes, word_hashes
from .substrings import NO_ID, covered, keyed, run_hashes

GRAM = 32
RUN_ENTRIES = 40_000  # suffixes that a task sorts at once
CHUNK_ENTRIES = 2_000
PART_ENTRIES = 40_000  # suffixes merged together, about
HOT = 400_000  # occurrences of an anchor in one partition; equal ones take little room there
WORD_GRAM, WORD_BLOCK = 8, 2_000  # words of an anchor of word runs, and contexts that are compared together
HEAD = 8  # bytes of the anchor's hash before each suffix
_POSITION_BITS = 24
_POSITIONS = np.uint64((1 << _POSITION_BITS) - 1)
_DEAL = np.uint64(0xD6E8FEB86659FD93)
_STRETCH = (1 << _POSITION_BITS) - 1  # bytes hashed at once


def window_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all n-byte windows."""
    if len(b) < n:
        return EMPTY
    total, down = prefix_hashes(b)
    return mixed((total[n:] - total[:-n]) * down[: len(b) - n + 1])


def anchors(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of a text, and for every window of `size` bytes the position of the gram that it chose."""
    b, width = np.frombuffer(raw, np.uint8), size - GRAM + 1
    if len(b) < size:
        return EMPTY, np.zeros(0, dtype=np.int64)
    g = window_hashes(b, GRAM)
    parts = []
    for at in range(0, len(g) - width + 1, _STRETCH - width + 1):
        v = g[at : at + _STRETCH]
        low = (v & ~_POSITIONS) | np.arange(len(v), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        parts.append((low & _POSITIONS).astype(np.int64) + at)
    return g, np.concatenate(parts)


def index(rows: DataFrame, size: int) -> DataFrame:
    """anchor, place, row, at: the anchors of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128).to_pydict()
                keys, owners, spots, each = [EMPTY], [], [np.zeros(0, np.int64)], []
                for text in part["text"]:
                    g, chosen = anchors(text.encode(), size)
                    at = chosen[np.r_[True, np.diff(chosen) != 0]] if len(chosen) else chosen
                    keys.append(g[at])
                    spots.append(at)
                    each.append(len(at))
                owners = [pa.array(np.repeat(np.array(part[c], dtype=np.int64), each)) for c in ("place", "row")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *owners, pa.array(np.concatenate(spots))], ["anchor", "place", "row", "at"])

    return rows.mapInArrow(run, "anchor long, place long, row long, at long")


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes aren't compared."""
    m = min(len(a), len(b))
    differ = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (differ.bit_length() + 7) // 8


_RUN = "part long, run long, seq int, shared binary, lengths binary, after binary, holders binary, starts binary, counts binary, rest binary"
Place = tuple[int, int, int]  # place and row of a text, and a window's start in it


def _coded(part: int, run: int, seq: int, entries: list[tuple[bytes, int, list]]) -> tuple:
    """A front-coded piece of a run: entries are (key, bytes after the anchor, places of its first window)."""
    previous, shared, rest = b"", [], []
    for key, _, _ in entries:
        shared.append(shared_prefix(previous, key))
        rest.append(key[shared[-1] :])
        previous = key
    places = [p for e in entries for p in e[2]]
    pack = lambda values, kind: np.array(values, dtype=kind).tobytes()
    return (
        part, run, seq, pack(shared, np.uint16), pack([len(e[0]) for e in entries], np.uint16), pack([e[1] for e in entries], np.uint16),
        pack([p[:2] for p in places], np.int64), pack([p[2] for p in places], np.int64), pack([len(e[2]) for e in entries], np.uint32), b"".join(rest),
    )


def runs(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """From rows(place, row, text, met: array of (at, blocks)): sorted, front-coded runs of the suffixes at those anchors."""

    def flush(entries: list[tuple], run_id: int) -> Iterator[pa.RecordBatch]:
        entries.sort()
        merged: list[tuple[bytes, int, list]] = []
        for key, after, *held in entries:
            if merged and merged[-1][0] == key and merged[-1][1] == after:
                merged[-1][2].append(held)
            else:
                merged.append((key, after, [held]))
        out, begin, seq = [], 0, 0
        part_of = [int.from_bytes(e[0][:HEAD], "big") * parts >> 64 for e in merged]
        for i in range(1, len(merged) + 1):
            if i == len(merged) or part_of[i] != part_of[begin] or i - begin == CHUNK_ENTRIES:
                out.append(_coded(part_of[begin], run_id, seq, merged[begin:i]))
                begin, seq = i, seq + 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7)
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), kinds, strict=True)], [c.split(" ")[0] for c in _RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id, entries = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64).to_pydict()
                for place, row, text, met in zip(piece["place"], piece["row"], piece["text"], piece["met"], strict=True):
                    raw = text.encode()
                    g, chosen = anchors(raw, size)
                    blocks = {m["at"]: m["blocks"] for m in met}
                    at = np.array(sorted(blocks))
                    own = window_hashes(np.frombuffer(raw, np.uint8), size) if max(blocks.values()) > 1 else EMPTY
                    first, last = np.searchsorted(chosen, at, "left").tolist(), (np.searchsorted(chosen, at, "right") - 1).tolist()
                    for p, f, t, head in zip(at.tolist(), first, last, g[at].astype(">u8"), strict=True):
                        if blocks[p] == 1:
                            entries.append((head.tobytes() + raw[p : t + size] + raw[f:p][::-1], t + size - p, place, row, f))
                            continue
                        block = own[f : t + 1] % np.uint64(blocks[p])
                        heads = mixed(np.uint64(int(head)) + (block + np.uint64(1)) * _DEAL).astype(">u8")
                        for s, h in zip(range(f, t + 1), heads, strict=True):
                            entries.append((h.tobytes() + raw[p : s + size] + raw[s:p][::-1], s + size - p, place, row, s))
                if len(entries) >= RUN_ENTRIES:
                    yield from flush(entries, run_id)
                    run_id, entries = run_id + 1, []
        if entries:
            yield from flush(entries, run_id)

    return rows.mapInArrow(run, _RUN)


Entry = tuple[int, bytes, int, list]  # bytes shared with the entry before, key, bytes after the anchor, places


def decoded(pieces: list[dict]) -> Iterator[Entry]:
    """The entries of one run, from its front-coded pieces in order."""
    before = b""
    for piece in pieces:
        shared, lengths, after, counts = (np.frombuffer(piece[c], t).tolist() for c, t in (("shared", np.uint16), ("lengths", np.uint16), ("after", np.uint16), ("counts", np.uint32)))
        holders = np.frombuffer(piece["holders"], np.int64)
        places = list(zip(holders[::2].tolist(), holders[1::2].tolist(), np.frombuffer(piece["starts"], np.int64).tolist(), strict=True))
        rest, at, used, key, opening = piece["rest"], 0, 0, b"", True
        for s, n, a, c in zip(shared, lengths, after, counts, strict=True):
            key = key[:s] + rest[at : at + n - s]
            at += n - s
            yield shared_prefix(before, key) if opening else s, key, a, places[used : used + c]
            used, before, opening = used + c, key, False


def merge(streams: list[Iterator[Entry]]) -> Iterator[Entry]:
    """Merge sorted runs with a loser tree; each entry comes with the length that it shares with the one before.

    Of each run's next entry the tree knows how much it shares with the last entry put out. Of two, the one
    that shares more is less; only if they share alike are they compared, from there on.
    """
    k = len(streams)
    now: list[Entry | None] = [next(s, None) for s in streams]
    known, loser = [0] * k, [-1] * k

    def beats(a: int, b: int) -> bool:
        x, y = now[a], now[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        n = shared_prefix(x[1], y[1], known[a])
        less = x[1][n : n + 1] <= y[1][n : n + 1]
        known[b if less else a] = n
        return less

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        a, b = (a, b) if beats(a, b) else (b, a)
        loser[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while now[winner] is not None:
        _, key, after, places = now[winner]
        yield known[winner], key, after, places
        now[winner] = following = next(streams[winner], None)
        known[winner] = following[0] if following else 0
        node = (winner + k) // 2
        while node:
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2


def repeated(entries: Iterator[Entry], size: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, row, first, last): runs of window starts that stand in more than one place."""
    group: list[list] = []  # key, after, places, longest common prefix with a neighbour
    for shared, key, after, places in entries:
        if group and shared < HEAD + GRAM:
            yield from _settled(group, size)
            group = []
        if group and shared == len(key) == len(group[-1][0]) and after == group[-1][1]:
            group[-1][2] += places
            continue
        if group:
            group[-1][3] = max(group[-1][3], shared)
        group.append([key, after, list(places), shared if group else 0])
    yield from _settled(group, size)


def _settled(group: list[list], size: int) -> Iterator[tuple[int, int, int, int]]:
    asked, hashes = [], []
    several = len(group) > 1
    for number, (key, after, places, shared) in enumerate(group):
        before = len(key) - HEAD - after
        windows = before + after - size + 1
        if len(places) > 1:
            for place, row, first in places:
                yield place, row, first, first + windows - 1
        if several:
            # window j has `before - j` bytes left of the anchor; what is right of it must be shared
            count = min(windows, before - (size - min(shared - HEAD, after)) + 1)
            if count > 0:
                text = key[HEAD + after :][::-1] + key[HEAD : HEAD + after]
                asked.append((number, count))
                hashes.append(window_hashes(np.frombuffer(text[: size + count - 1], np.uint8), size))
    if len(asked) < 2:
        return
    every = np.concatenate(hashes)
    _, which, often = np.unique(every, return_inverse=True, return_counts=True)
    met, at = often[which] > 1, 0
    for number, count in asked:
        own = np.flatnonzero(met[at : at + count])
        at += count
        places = group[number][2]
        if len(places) == 1 and len(own):
            place, row, first = places[0]
            cuts = np.flatnonzero(np.diff(own) != 1)
            for a, b in zip(own[np.r_[0, cuts + 1]].tolist(), own[np.r_[cuts, len(own) - 1]].tolist(), strict=True):
                yield place, row, first + a, first + b


def merged(coded: DataFrame, size: int) -> DataFrame:
    """place, row and spans (first, last) of repeated windows, from front-coded runs; a part's runs are merged when all are there.

    Spans that a part finds in one text leave it together, but for those of different batches.
    """
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            spans = repeated(merge([decoded(pieces) for pieces in part.values()]), size) if part else iter(())
            while out := list(itertools.islice(spans, 50_000)):
                texts: dict[tuple[int, int], list[dict]] = {}
                for place, row, first, last in out:
                    texts.setdefault((place, row), []).append({"first": first, "last": last})
                places, rows = zip(*texts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(rows, pa.int64()), pa.array(list(texts.values()), kind)], ["place", "row", "spans"])

        now, part = None, {}
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["part"] != now:
                    yield from found(part)
                    now, part = piece["part"], {}
                part.setdefault(piece["run"], []).append(piece)
        yield from found(part)

    return coded.repartition("part").sortWithinPartitions("part", "run", "seq").mapInArrow(run, "place long, row long, spans array<struct<first: bigint, last: bigint>>")


def spans_of(rows: DataFrame, size: int, n_words: int | None = None) -> DataFrame:
    """place, row and spans (first, last start of repeated windows) of those of rows(place, row, text) that have any.

    With n_words, also of the repeated runs of so many words that are shorter than a window; the span of
    these ends before the window's size, and may end before it begins.
    """
    ship(rows.sparkSession)
    indexed = cut(index(rows, size))
    # cut, so that the join below has exchanges of its own, which are split where one anchor has many rows
    shared = cut(indexed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / HOT).alias("blocks")))
    met = cut(indexed.join(shared, "anchor").groupBy("place", "row").agg(F.collect_set(F.struct("at", "blocks")).alias("met")))  # as many as a row has windows
    parts = 1 + (met.agg(F.sum(F.size("met"))).first()[0] or 0) // PART_ENTRIES  # so that a part is as large at any size of corpus
    spans = merged(runs(rows.join(met, ["place", "row"]).select("place", "row", "text", "met"), size, parts), size)
    if n_words is not None:
        spans = spans.unionByName(word_spans_of(rows, n_words, size))
    return spans.groupBy("place", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_EDGE = re.compile(r"[\W_]*")


def _marks(word: bytes) -> tuple[int, int]:
    """Bytes of a word before its first letter or digit, and after its last; none of a word without any."""
    text = word.decode()
    lead = _EDGE.match(text).end()
    if lead == len(text):
        return 0, 0
    return len(text[:lead].encode()), len(text[len(text) - _EDGE.match(text[::-1]).end() :].encode())


def short_passages(raw: bytes, n_words: int, size: int) -> list[tuple[int, int, int]]:
    """(number of the first word, begin, end) of all runs of n_words words that have less than `size` bytes without the marks around them."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.r_[True, (b == 32) | ((b >= 9) & (b <= 13)), True]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    begins, ends = edges[::2], edges[1::2]
    if len(begins) < n_words:
        return []
    out = []
    for i in np.flatnonzero(begins[n_words - 1 :] - ends[: len(ends) - n_words + 1] < size).tolist():
        j = i + n_words - 1
        begin, end = int(begins[i]), int(ends[j])
        begin, end = begin + _marks(raw[begin : ends[i]])[0], end - _marks(raw[begins[j] : end])[1]
        if end - begin < size:
            out.append((i, begin, end))
    return out


_WINDOW = np.dtype([("passage", "V16"), ("begin", "<i8"), ("length", "<i8")])


def word_contexts(raw: bytes, n_words: int, size: int) -> list[tuple[int, bytes, int, bytes]]:
    """(anchor, hash of the context, its begin, its windows) of the short runs of n_words words, by the least gram of their inner words.

    Neighbouring runs with one anchor are a context; equal contexts hold equal runs at equal places.
    """
    found = short_passages(raw, n_words, size)
    if not found:
        return []
    g = run_hashes(word_hashes(raw), WORD_GRAM)
    width = n_words - 1 - WORD_GRAM  # grams of the words between the first and the last
    out, now = [], []

    def close() -> None:
        windows = np.array([(hashlib.blake2b(raw[a:b], digest_size=16).digest(), a - now[0][1], b - a) for _, a, b, _ in now], dtype=_WINDOW)
        context = hashlib.blake2b(windows.tobytes() + (now[0][3] - now[0][0]).to_bytes(8, "big"), digest_size=16).digest()
        out.append((int(g[now[0][3]].view(np.int64)), context, now[0][1], windows.tobytes()))

    for i, a, b in found:
        at = i + 1 + int(np.argmin(g[i + 1 : i + 1 + width]))
        if now and (now[-1][0] + 1, now[-1][3]) != (i, at):
            close()
            now = []
        now.append((i, a, b, at))
    close()
    return out


def met_elsewhere(contexts: list[tuple]) -> tuple[list[list[bool]], dict[bytes, list]]:
    """Which windows of (place, row, several, lo, hi, windows) stand elsewhere too, as far as these contexts tell; and what they tell of each passage.

    Elsewhere is another row, or a place of the same one that the run doesn't reach into: one word said sixty times is no
    repeated passage. `several` says that a context stands in several rows, lo and hi where it first and last begins.
    """
    known: dict[bytes, list] = {}  # least and greatest row, first and last place, whether in several rows
    for place, row, several, lo, hi, windows in contexts:
        for passage, begin, _ in windows.tolist():
            k = known.get(passage)
            if k is None:
                known[passage] = [(place, row), (place, row), lo + begin, hi + begin, several]
            else:
                k[0], k[1], k[2], k[3], k[4] = min(k[0], (place, row)), max(k[1], (place, row)), min(k[2], lo + begin), max(k[3], hi + begin), k[4] or several
    met = []
    for *_, windows in contexts:
        met.append([k[4] or k[0] != k[1] or k[3] - k[2] >= length for k, length in ((known[p], n) for p, _, n in windows.tolist())])
    return met, known


_DECIDED = "anchor long, context binary, passage binary, place long, row long, first long, last long, several boolean, kind int"


def decided(contexts: DataFrame) -> DataFrame:
    """Of contexts dealt by (anchor, block): kind 0, stretches (first, length in last) of runs that stand elsewhere; where an anchor
    has several blocks also kind 1, what the block has of each passage, and kind 2, runs to ask other blocks about (begin, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[dict]) -> Iterator[tuple]:
            rows = [(c["place"], c["row"], c["several"], c["lo"], c["hi"], np.frombuffer(c["windows"], _WINDOW)) for c in group]
            met, known = met_elsewhere(rows)
            for c, m, (*_, windows) in zip(group, met, rows, strict=True):
                own = np.flatnonzero(m)
                cuts = np.flatnonzero(np.diff(own) != 1)
                for a, b in zip(own[np.r_[0, cuts + 1]].tolist(), own[np.r_[cuts, len(own) - 1]].tolist(), strict=True) if len(own) else ():
                    begin = int(windows["begin"][a])
                    yield c["anchor"], c["context"], None, None, None, begin, int(windows["begin"][b] + windows["length"][b]) - begin, None, 0
                if c["blocks"] > 1:
                    for k in np.flatnonzero(~np.array(m)).tolist():
                        yield c["anchor"], c["context"], windows["passage"][k].tobytes(), None, None, int(windows["begin"][k]), int(windows["length"][k]), None, 2
            if group and group[0]["blocks"] > 1:
                for passage, (low, high, first, last, several) in known.items():
                    yield group[0]["anchor"], None, passage, *low, first, last, several or low != high, 1

        def packed(out: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.int32())
            while part := list(itertools.islice(out, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in _DECIDED.split(", ")])

        now, group = None, []
        for batch in batches:
            for c in batch.to_pylist():
                if (c["anchor"], c["block"]) != now:
                    yield from packed(settle(group))
                    now, group = (c["anchor"], c["block"]), []
                group.append(c)
        yield from packed(settle(group))

    return contexts.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(run, _DECIDED)


def word_spans_of(rows: DataFrame, n_words: int, size: int) -> DataFrame:
    """place, row and spans (first, last), as of windows of `size` bytes, of the runs of n_words words under that size that stand elsewhere too.

    Runs are compared by 128 bits of hash; few texts have words short enough for any. Equal contexts are one, so that only
    contexts that differ, those at the edges of a common passage, are compared, in blocks of about WORD_BLOCK; what blocks
    lack is asked of an anchor's other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128).to_pydict(), []
                for place, row, text in zip(part["place"], part["row"], part["text"], strict=True):
                    places: dict[tuple, list[int]] = {}
                    for anchor, context, at, windows in word_contexts(text.encode(), n_words, size):
                        places.setdefault((anchor, context, windows), []).append(at)
                    out += [(anchor, context, place, row, at, windows) for (anchor, context, windows), at in places.items()]
                for at in range(0, len(out), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 5_000], strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["anchor", "context", "place", "row", "at", "windows"])

    key = ["anchor", "context"]
    found = rows.mapInArrow(run, "anchor long, context binary, place long, row long, at array<long>, windows binary")
    # a place that comes twice is in rows that are equal as a whole
    found = found.groupBy(*key, "place", "row").agg(F.flatten(F.collect_list("at")).alias("all"), F.any_value("windows").alias("windows"))  # as many as a text has places
    found = cut(found.withColumn("at", F.array_distinct("all")).withColumn("twice", F.size("all") > F.size("at")).drop("all"))
    one, other = F.min(F.struct("place", "row")), F.max(F.struct("place", "row"))
    held = found.groupBy(*key).agg(one.alias("one"), ((one != other) | F.bool_or("twice")).alias("several"), F.min(F.array_min("at")).alias("lo"), F.max(F.array_max("at")).alias("hi"), F.any_value("windows").alias("windows"))
    held = cut(held.select(*key, "one.place", "one.row", "several", "lo", "hi", "windows"))
    dealt = held.groupBy("anchor").agg(F.count("*").alias("m"), F.bool_or("several").alias("any"), F.max(F.col("hi") - F.col("lo")).alias("far")).where("m > 1 or any or far > 0")
    dealt = held.join(cut(dealt.select("anchor", F.ceil(F.col("m") / WORD_BLOCK).alias("blocks"))), "anchor").withColumn("block", F.pmod(F.xxhash64("context"), "blocks"))
    told = cut(decided(dealt))
    passages = told.where("kind = 1").groupBy("anchor", "passage").agg((F.bool_or("several") | (F.min(F.struct("place", "row")) != F.max(F.struct("place", "row")))).alias("several"), (F.max("last") - F.min("first")).alias("far"))
    asked = told.where("kind = 2").select(*key, "passage", "first", "last").join(cut(passages), ["anchor", "passage"]).where("several or far >= last")
    spans = told.where("kind = 0").select(*key, "first", "last").union(asked.select(*key, "first", "last"))
    spans = cut(spans.groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("spans")))  # as many as a context has windows
    at_each = lambda a: F.transform("spans", lambda s: F.struct((a + s["first"]).alias("first"), (a + s["first"] + s["last"] - size).alias("last")))
    return found.select(*key, "place", "row", "at").join(spans, key).select("place", "row", F.flatten(F.transform("at", at_each)).alias("spans"))


def dedup(documents: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents(doc_id, text, ...).

    Null and empty texts have no bytes. A string in two rows is repeated whatever their doc_ids, so rows that
    are repeated as a whole lose every window; rows without doc_id are treated alike. Empty tables give no
    rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256).to_pydict(), []
                for doc_id, text, spans in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                    raw, pieces = text.encode(), 0
                    kept = raw
                    if spans:
                        gone = covered(len(raw), spans, size)
                        pieces = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    out.append((doc_id, len(raw), len(raw) - len(kept), pieces, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(documents)
    rows = rows.join(spans_of(rows, size), ["place", "row"], "left").select(F.nullif("place", F.lit(NO_ID)).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(documents: DataFrame, size: int = 400, n_words: int | None = None) -> DataFrame:
    """documents with repeated bytes taken out of text; characters cut in two stay. All columns stay.

    With n_words, repeated runs of that many words are taken out too where they have less than `size` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(names.index("text")).to_pylist()
                for i, spans in enumerate(part.column(len(names)).to_pylist()):
                    if spans:
                        raw = np.frombuffer(texts[i].encode(), np.uint8)
                        gone = covered(len(raw), spans, size)
                        begin = np.flatnonzero((raw & 0xC0) != 0x80)
                        whole = np.minimum.reduceat(gone.astype(np.uint8), begin) == 1
                        texts[i] = raw[~np.repeat(whole, np.diff(np.r_[begin, len(raw)]))].tobytes().decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if name == "text" else part.column(i) for i, name in enumerate(names)], names)

    names = documents.columns
    spans = spans_of(keyed(documents), size, n_words).select(F.col("place").alias("_place"), F.col("row").alias("_row"), F.col("spans").alias("_spans"))
    rows = documents.select(*[documents[n].alias(f"_{i}") for i, n in enumerate(names)], F.coalesce(documents["doc_id"].cast("long"), F.lit(NO_ID)).alias("_place"), F.xxhash64(F.coalesce(documents["text"], F.lit(""))).alias("_row"))
    joined = rows.join(spans, ["_place", "_row"], "left").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)], F.col("_spans").alias("spans"))
    return joined.mapInArrow(run, documents.schema)
