"""Token counts by a compiled finite-state transducer whose chunk maps compose in a prefix scan.

The tokenizer file is compiled into two deterministic machines. The splitter sees a character's class and
its neighbours and marks where words of the file's split begin. The counter reads the bytes of a word: its
states are prefixes of words, and the transition from one prefix to the next carries the number of tokens
by which the merged prefix grows (below zero where merges join several tokens), so that the annotations on
a word's path add up to its tokens. All prefixes of the vocabulary's words are states from the beginning;
further words are determinised when first met, as far as STATES goes; the few words left over are merged.

Texts of every length are cut into chunks. A boundary is certain where white space follows another
character: no token of this family of splits can span it, and nothing to its left changes what is right of
it. So the map of a chunk, from any state that it may be entered in, is (characters of its head, tokens emitted
between its boundaries, characters that it leaves open); a chunk without certain boundary adds all its
characters to what is open. Two maps compose by closing what one leaves open with the head of the other. A
prefix scan over the maps gives what is open at each chunk's entry and exit; what the scan doesn't hand on isn't
counted. A text's tokens are those of its chunks' insides, of the closings and of what is open at its end. All
of them, each by itself, step through the transition table together, one byte of every word at a time.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, ship, slices

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER, LETTER, NUMBER, SPACE, BLANK, EDGE = range(6)
CHUNK = 1 << 12  # characters of a chunk
STRETCH = 1 << 20  # characters that step through the table together
STATES = 1 << 18
LONGEST = 48  # bytes of words that have paths
DEAD, ROOT = 0, 1
BIAS = 128
#: What follows an apostrophe in the split's own words.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The splitter's class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[ord(" ")] = SPACE
    return out


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def word_starts(codes: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where words of the split begin; edge[i] says that a text begins at i, and edge[n] is the end."""
    n = len(codes)
    before, after = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[edge[:n]] = EDGE
    after[edge[1:]] = EDGE
    white, was_white = kind >= SPACE, (before == SPACE) | (before == BLANK)
    # a run of white space gives its last character to what follows: as a word of its own, or a space as the beginning of the next word
    start = np.where(white, ~was_white | (after < SPACE), (before != kind) & (before != SPACE))
    quote = np.flatnonzero((codes == ord("'")) & start & (after == LETTER))
    if len(quote):
        one = codes[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in SHORT])]
        start[short + 1] = False
        start[(short + 2)[~edge[short + 2]]] = True
        two = quote[~edge[np.minimum(quote + 2, n)]]
        for a, b in LONG:
            at = two[(codes[two + 1] == ord(a)) & (codes[two + 2] == ord(b))]
            start[at + 1] = False
            start[(at + 3)[~edge[at + 3]]] = True
    return start


def chunk_maps(starts: np.ndarray, stops: np.ndarray, certain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk whether it has a certain boundary within, the characters before the first, and those that it leaves open."""
    chunk = np.searchsorted(starts, certain, "right") - 1
    inside = certain > starts[chunk]  # what is at a chunk's beginning can't be seen from within
    certain, chunk = certain[inside], chunk[inside]
    closes, head, open_ = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64), stops - starts
    closes[chunk] = True
    head[chunk[::-1]] = certain[::-1] - starts[chunk[::-1]]
    open_[chunk] = stops[chunk] - certain
    return closes, head, open_


def scan(closes: np.ndarray, open_: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are open when each chunk is entered and left; opens: a text's first chunk, where nothing is."""
    total = np.cumsum(open_)
    left = total - np.maximum.accumulate(np.where(closes | opens, total - open_, 0))
    return np.where(opens, 0, np.r_[0, left[:-1]]), left


class Transducer:
    CERTAIN = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["model"]["ignore_merges"]:
            raise ValueError("only plain byte-level BPE files can be compiled")
        self.letters = _byte_letters()
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.table = np.zeros(STATES << 8, dtype=np.int32)  # state and byte -> next state, and the tokens emitted (with a bias)
        self.tokens = np.zeros(STATES, dtype=np.int32)  # of the prefix that a state stands for
        self.states = ROOT + 1
        self.left_over = Recent(self.merged, 150_000)
        byte = {v: k for k, v in self.letters.items()}
        for token in spec["model"]["vocab"]:
            if all(c in byte for c in token):
                self.lay(bytes(byte[c] for c in token))

    def lay(self, word: bytes) -> int:
        """The tokens of a word, whose prefixes become states if there is room."""
        if len(word) > LONGEST or self.states + len(word) > STATES:
            return self.left_over[word]
        state, table, tokens = ROOT, self.table, self.tokens
        for k, b in enumerate(word):
            slot = state << 8 | b
            following = int(table[slot]) >> 8
            if following == DEAD:
                following, self.states = self.states, self.states + 1
                tokens[following] = self.merged(word[: k + 1])
                table[slot] = following << 8 | int(tokens[following] - tokens[state]) + BIAS
            state = following
        return int(tokens[state])

    def merged(self, word: bytes) -> int:
        """Tokens of one split word: merge the leftmost pair of least rank until none is left."""
        if len(word) > 400:
            return self._merged_long(word)
        letters, rank, never = self.letters, self.ranks.get, 1 << 60
        parts = [letters[b] for b in word]
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
        return len(parts)

    def _merged_long(self, word: bytes) -> int:
        """As merged, in n log n steps: a linked list of parts and a heap of pairs."""
        parts = [self.letters[b] for b in word]
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            alive -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return alive

    def emitted(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the words raw[begin:end], all run through the table side by side."""
        size = end - begin
        tokens = np.zeros(len(begin), dtype=np.int64)
        order = np.argsort(np.minimum(size, LONGEST + 1).astype(np.uint8), kind="stable")[::-1]
        order = order[np.searchsorted(-size[order], -LONGEST) :]
        at, state, total = begin[order], np.full(len(order), ROOT, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        alive = np.searchsorted(-size[order], -np.arange(LONGEST), "left")  # words of more than k bytes come first
        b = np.frombuffer(raw, np.uint8)
        for k in range(LONGEST):
            m = alive[k]
            if not m:
                break
            step = self.table[(state[:m] << 8) | b[at[:m] + k]]
            state[:m] = step >> 8
            total[:m] += step & 255
        tokens[order] = total - BIAS * size[order]
        rest: dict[bytes, list[int]] = {}
        for i in [*order[state == DEAD].tolist(), *np.flatnonzero(size > LONGEST).tolist()]:
            rest.setdefault(raw[begin[i] : end[i]], []).append(i)
        for word, where in rest.items():
            tokens[where] = self.lay(word)
        return tokens

    def run(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each of a few texts without special strings."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        joined, n = "".join(texts), int(ends[-1])
        if not n:
            return np.zeros(len(texts), dtype=np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kind = classes()[codes]
        edge = np.zeros(n + 1, dtype=bool)
        edge[ends - lengths] = edge[n] = True
        white = kind >= SPACE
        certain = np.flatnonzero(white[1:] & ~white[:-1] & ~edge[1:n]) + 1
        # chunks, their maps, and the scan: what is open at a chunk's entry is closed by its head
        per = -(-lengths // chunk)
        text = np.repeat(np.arange(len(texts)), per)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        starts = (ends - lengths)[text] + number * chunk
        stops = np.minimum(starts + chunk, ends[text])
        closes, head, open_ = chunk_maps(starts, stops, certain)
        entered, left = scan(closes, open_, number == 0)
        final = np.cumsum(per)[per > 0] - 1
        own = np.flatnonzero(closes)
        # what lies between a chunk's boundaries, closings, and what is open at each text's end: counted one by one
        a = np.r_[(starts + head)[own], (starts - entered)[own], (stops - left)[final]]
        b = np.r_[(stops - open_)[own], (starts + head)[own], stops[final]]
        of = np.r_[text[own], text[own], text[final]]
        some = np.flatnonzero(b > a)
        some = some[np.argsort(a[some], kind="stable")]
        tokens = self.stretches(codes, kind, a[some], b[some])
        return np.bincount(of[some], tokens, len(texts)).astype(np.int64)

    def stretches(self, codes: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of each stretch [a, b) of some characters, as if it stood alone."""
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        codes = np.concatenate([codes[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        kind = np.concatenate([kind[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        n, begin = len(codes), np.cumsum(b - a) - (b - a)
        edge = np.zeros(n + 1, dtype=bool)
        edge[begin] = edge[n] = True
        raw = codes.tobytes().decode("utf-32-le").encode()
        word = np.flatnonzero(word_starts(codes, kind, edge))
        if len(raw) == n:
            begin_b = word
        else:
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            begin_b = (np.cumsum(width, dtype=np.int64) - width)[word]
        tokens = self.emitted(raw, begin_b, np.r_[begin_b[1:], len(raw)])
        return np.add.reduceat(tokens, np.searchsorted(word, begin))

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of at most STRETCH characters between certain boundaries, or more where there is none."""
        at = 0
        while len(text) - at > STRETCH:
            cut = 0
            for m in self.CERTAIN.finditer(text, at + STRETCH - 1000, at + STRETCH):
                cut = m.start()
            if not cut:
                m = self.CERTAIN.search(text, at + STRETCH)
                if m is None:
                    break
                cut = m.start()
            yield text[at:cut]
            at = cut
        yield text[at:]

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text; special strings are a token each."""
        out, batch, owner, size = np.zeros(len(texts), dtype=np.int64), [], [], 0
        for i, text in enumerate(texts):
            spans = self.special.split(text) if self.special else [text]
            out[i] += len(spans) - 1
            for piece in (p for span in spans for p in self.pieces(span)):
                if batch and size + len(piece) > STRETCH:
                    np.add.at(out, owner, self.run(batch, chunk))
                    batch, owner, size = [], [], 0
                batch.append(piece)
                owner.append(i)
                size += len(piece)
        if batch:
            np.add.at(out, owner, self.run(batch, chunk))
        return out.tolist()


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of documents(doc_id, text, ...).

    Null and empty texts have 0 bytes and 0 tokens; rows with null or repeated doc_id are counted like
    any other; further columns are ignored.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for rows in slices(batches):
            texts = [t or "" for t in rows["text"]]
            counts = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
