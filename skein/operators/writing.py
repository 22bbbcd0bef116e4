"""Writing corpus and one-person engagement (A-39, A-43)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso, strip
from ..session import ship
from .ranking import ranked

FORMS = 200_000  # forms of one trie; more are dealt over several, each another pass over the lines
PART = 4 << 20  # bytes of texts that are looked through at once
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]")


def writing_index(files: DataFrame, excerpt: int = 200) -> DataFrame:
    """A-43: files(path, text, mtime): the date from a name like "x (Mar 2020)" or "x (2020)", else the file's own; and a cleaned excerpt."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")
    month, year = F.regexp_extract(name, r"\(([A-Z][a-z]{2})[a-z]* (\d{4})\)", 1), F.regexp_extract(name, r"\((?:[A-Za-z]+ )?(\d{4})\)", 1)
    date = F.coalesce(F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), F.nullif(month, F.lit("")), F.nullif(year, F.lit(""))), F.lit("d MMM yyyy")), F.try_to_timestamp(F.nullif(year, F.lit("")), F.lit("yyyy")), F.col("mtime"))
    plain = strip(F.regexp_replace(F.regexp_replace("text", r"(?m)^#+\s.*$|[*_`>]", ""), r"\s+", " "))
    return files.select(F.trim(F.regexp_replace(name, r"\s*\([^)]*\d{4}\)", "")).alias("title"), F.to_date(date).alias("date"), F.substring(plain, 1, excerpt).alias("excerpt"))


def holds(rows: DataFrame, target: str) -> Column:
    """Whether a record's JSON text holds the target anywhere."""
    return F.to_json(F.struct(*rows.columns)).contains(target)


def thread_sample(messages: DataFrame, k: int = 40) -> DataFrame:
    """place and the columns of messages(id, ts, ...): the first k, k around the middle, and the last k; a row can stand in several of them.

    In a thread of under k rows the middle begins as many before the end as the row it should begin with lies before the first.
    """
    m = ranked(messages, "ts", "id", name="_i")
    n = m.count()
    mid = n // 2
    start = mid - k // 2 if mid >= k // 2 else max(n + mid - k // 2, 0)
    end, last, head = min(mid + k // 2, n), max(n - k, 0), min(n, k)
    i = F.col("_i")
    places = F.array(F.when(i < k, i), F.when((i >= start) & (i < end), head + i - start), F.when(i >= last, head + max(end - start, 0) + i - last))
    return m.select(F.explode(F.array_compact(places)).alias("place"), *messages.columns)


def engagement(target: str, messages: DataFrame, following: DataFrame, followers: DataFrame, searches: DataFrame, k: int = 40, **lists: DataFrame) -> DataFrame:
    """A-39: section, place, item and n of all that a thread and an export say about one person.

    totals: messages(id, ts, sender, content, reactions array<struct<actor, reaction>>), those with text, first and last moment;
    sample: messages with text as JSON, by `thread_sample`; social: whether the two lists hold the target;
    engagement: records of each named list that hold it; searches(ts, ...): the moments of those that hold it, in order (null counts as 0).
    """
    long = lambda c: c.cast("long")
    row = lambda df, section, item, n, place=None: df.select(F.lit(section).alias("section"), long(F.lit(None) if place is None else place).alias("place"), item.alias("item"), long(n).alias("n"))
    text = messages.where("content is not null and content <> ''")
    total = messages.agg(F.count("*").alias("messages"), F.count_if(F.col("content") != "").alias("text"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    parts = [row(total.unpivot([], ["messages", "text", "first", "last"], "item", "n"), "totals", F.col("item"), F.col("n"))]
    said = F.to_json(F.struct("sender", iso(F.col("ts")).alias("time"), F.col("content").alias("text"), F.transform(F.coalesce("reactions", F.array()), lambda r: F.concat_ws(": ", r["actor"], r["reaction"])).alias("reactions")))
    parts.append(row(thread_sample(text, k), "sample", said, F.col("ts"), F.col("place")))
    for name, rows in (("i_follow_them", following), ("they_follow_me", followers)):
        parts.append(row(rows.agg(F.max(holds(rows, target)).alias("any")), "social", F.lit(name), F.coalesce(F.col("any"), F.lit(False)).cast("int")))
    for name, rows in lists.items():
        parts.append(row(rows.agg(F.count_if(holds(rows, target)).alias("n")), "engagement", F.lit(name), F.col("n")))
    asked = ranked(searches.where(holds(searches, target)).select(F.coalesce("ts", F.lit(0)).alias("ts")), "ts")
    parts.append(row(asked, "searches", iso(F.col("ts")), F.col("ts"), F.col("rank")))
    return reduce(DataFrame.unionByName, parts)


def writing_forms(identities: DataFrame) -> DataFrame:
    """G-13: canonical_id and form: display names and aliases of letters that aren't all lower case, of two characters or more."""
    names = identities.select("canonical_id", F.explode(F.array_compact(F.array_union(F.array("display_name"), "aliases"))).alias("form"))
    return names.where(F.col("form").rlike(r"^[\p{L}][\p{L}' -]+$") & (F.col("form") != F.lower("form")) & (F.length("form") >= 2)).distinct()


class Trie:
    """Forms as runs of tokens (words, and single characters between them); long forms whatever their case, those of two characters as they are."""

    def __init__(self, forms: list[tuple[str, str]]):
        self.long: dict = {}
        self.short: dict[str, list[str]] = {}
        for person, form in forms:
            if len(form) == 2:
                self.short.setdefault(form, []).append(person)
                continue
            node = self.long
            for token in _TOKEN.findall(form.lower()):
                node = node.setdefault(token, {})
            node.setdefault("", []).append(person)

    def met(self, line: str, only: int | None = None) -> Iterator[tuple[str, int, int]]:
        """(person, start, end) of all forms in a line, or of those that begin at `only`, that begin and end at a word's edge."""
        spans = [m.span() for m in _TOKEN.finditer(line)]
        word = lambda k: 0 <= k < len(line) and (line[k] == "_" or (line[k].isascii() and line[k].isalnum()))
        low = [line[a:b].lower() for a, b in spans]
        for i, (a, _) in enumerate(spans):
            if only is not None and a > only:
                return
            if word(a - 1) == word(a) or (only is not None and a < only):
                continue
            for person in self.short.get(line[a : a + 2], ()) if word(a + 1) != word(a + 2) else ():
                yield person, a, a + 2
            node = self.long.get(low[i])
            k = i
            while node is not None:
                end = spans[k][1]
                if "" in node and word(end - 1) != word(end):
                    for person in node[""]:
                        yield person, a, end
                k += 1
                node = node.get(low[k]) if k < len(low) else None


_WORD = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"]] = True


class Forms:
    """Forms by what finds them: single words and pairs of words by their numbers, for all words of many texts at once; the others by a trie, in lines that hold their longest word."""

    def __init__(self, forms: list[tuple[str, str]]):
        people: dict[str, list[int]] = {}
        self.people = pa.array(sorted({p for p, _ in forms}))
        number = {p: k for k, p in enumerate(self.people.to_pylist())}
        for person, form in forms:
            people.setdefault(form if len(form) == 2 else form.lower(), []).append(number[person])
        short, one, two, odd = {}, {}, {}, []
        for form, whose in people.items():
            words = re.findall("[a-z0-9_]+", form.lower())
            if len(form) == 2 and re.fullmatch("[A-Za-z0-9_]{2}", form):
                short[form] = whose
            elif len(form) > 2 and len(words) == 1 and words[0] == form:
                one[form] = whose
            elif len(form) > 2 and len(words) == 2 and " ".join(words) == form:
                two[tuple(words)] = whose
            else:
                odd.append((form, whose))
        self.short, self.short_people = pa.array(list(short), pa.string()), self._lists(short.values())
        self.one, self.one_people = pa.array(list(one), pa.string()), self._lists(one.values())
        parts = sorted({w for pair in two for w in pair})
        self.parts, at = pa.array(parts, pa.string()), {w: k for k, w in enumerate(parts)}
        keys = np.array([at[a] * len(parts) + at[b] for a, b in two], np.int64)
        order = np.argsort(keys)
        self.two, self.two_people = keys[order], self._lists([list(two.values())[k] for k in order])
        self._odd_starts(odd)

    def _odd_starts(self, odd: list[tuple[str, list[int]]]) -> None:
        """A trie of the other forms, and which bytes may follow each word or character that one begins with."""
        self.odd = Trie([(p, form) for form, whose in odd for p in whose]) if odd else None
        self.reach = 4 * max((len(form) for form, _ in odd), default=0) + 4
        after: dict[str, np.ndarray] = {}
        lower = {}  # characters beyond ASCII that are lower-cased to a form's first token
        firsts = {_TOKEN.match(form.lower())[0] for form, _ in odd if len(form) > 2}
        if any(len(t) == 1 for t in firsts):
            for x in (x for x in range(128, 0x110000) if not 0xD800 <= x < 0xE000 and chr(x).lower() in firsts):
                lower.setdefault(chr(x).lower(), []).append(chr(x))
        for form, _ in odd:
            first = form[0] if len(form) == 2 else _TOKEN.match(form.lower())[0]
            following = form[len(first)]
            for begin in {first.lower() if first.isascii() else first, *(lower.get(first, ()) if len(form) > 2 else ())}:
                may = after.setdefault(begin, np.zeros(256, bool))
                may[[ord(c) for c in following + following.upper() + following.lower() if c.isascii()]] = True
                may[128:] = True if not following.isascii() or following.lower() in "k" else may[128:]  # a sign of Kelvin is a k
        words, signs = [w for w in after if w.isascii()], [c for c in after if not c.isascii()]
        self.odd_words, self.odd_after = pa.array(words, pa.string()), np.array([after[w] for w in words] or np.zeros((0, 256), bool))
        codes: dict[int, np.ndarray] = {}
        for c in signs:
            code = c.encode()[0] * 256 + c.encode()[1]
            codes[code] = codes.get(code, np.zeros(256, bool)) | after[c]
        self.signs, self.sign_after = np.array(sorted(codes), np.int64), np.array([codes[c] for c in sorted(codes)] or np.zeros((0, 256), bool))

    @staticmethod
    def _lists(whose) -> tuple[np.ndarray, np.ndarray]:
        """Lists one after another, and where each begins."""
        whose = list(whose)
        return np.array([p for w in whose for p in w], np.int64), np.cumsum([0, *map(len, whose)])

    @staticmethod
    def _spread(form: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The place in `form` and the person, for every person of every form."""
        flat, begin = lists
        n = (begin[1:] - begin[:-1])[form]
        at = np.repeat(np.arange(len(form)), n)
        return at, flat[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + begin[form][at]]

    def met(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
        """person, text, line (from 1) and the first form, once for each person and line, of texts (large_string)."""
        texts = texts.fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        word = np.concatenate([[False], _WORD[data], [False]])
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        a = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        b = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        breaks = np.flatnonzero(data == 10)
        # lines are numbered through: one for each text, and one for each break
        line_of = lambda at: np.searchsorted(breaks, at) + np.searchsorted(bounds[1:-1], at, "right")
        letters = data[_WORD[data]]
        words = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)), pa.py_buffer(letters))
        low = pc.ascii_lower(words)
        number = lambda of, known: pc.fill_null(pc.index_in(of, known.cast(pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = []  # person, begin, end, whether short
        for of, known, lists, short in ((low, self.one, self.one_people, False), (words, self.short, self.short_people, True)):
            if len(known):
                form = number(of, known)
                hit = np.flatnonzero(form >= 0)
                at, person = self._spread(form[hit], lists)
                found.append((person, a[hit][at], b[hit][at], np.full(len(at), short)))
        if len(self.two) and len(a) > 1:
            part = number(low, self.parts)
            hit = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0) & (a[1:] == b[:-1] + 1) & (data[np.minimum(b[:-1], len(data) - 1)] == 32) & ~edge[b[:-1]] & ~edge[a[1:]])
            key = part[hit] * len(self.parts) + part[hit + 1]
            form = np.minimum(np.searchsorted(self.two, key), len(self.two) - 1)
            hit, form = hit[self.two[form] == key], form[self.two[form] == key]
            at, person = self._spread(form, self.two_people)
            found.append((person, a[hit][at], b[hit + 1][at], np.zeros(len(at), bool)))
        if self.odd:
            found.append(self._odd(data, word[:-1], edge, np.union1d(bounds, breaks), a, b, low, number))
        person, begin, end, short = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        line = line_of(begin)
        order = np.lexsort((-end, begin, short, person, line))
        line, person, begin, end = line[order], person[order], begin[order], end[order]
        first = np.concatenate([[True], (line[1:] != line[:-1]) | (person[1:] != person[:-1])]) if len(line) else np.zeros(0, bool)
        line, person, begin, end = line[first], person[first], begin[first], end[first]
        text = np.searchsorted(bounds[1:-1], begin, "right")
        n = end - begin
        cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        form = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(cut), pa.py_buffer(data[np.arange(cut[-1]) + np.repeat(begin - cut[:-1], n)]))
        return self.people.take(pa.array(person)), text, line - line_of(bounds[:-1])[text] + 1, form.cast(pa.string())

    def _odd(self, data, before, edge, ends, a, b, low, number):
        """Those of the trie, walked where one may begin: at a word that the right byte follows, or at a character after a word."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        at = np.zeros(0, np.int64)
        if len(self.odd_words):
            form = number(low, self.odd_words)
            at = a[(form >= 0) & self.odd_after[form, padded[b]]]
        if len(self.signs):
            sign = np.flatnonzero((data >= 0xC0) & before[: len(data)] & ~edge[: len(data)])
            code = padded[sign].astype(np.int64) * 256 + padded[sign + 1]
            k = np.minimum(np.searchsorted(self.signs, code), len(self.signs) - 1)
            size = 2 + (padded[sign] >= 0xE0).astype(np.int64) + (padded[sign] >= 0xF0)
            at = np.concatenate([at, sign[(self.signs[k] == code) & self.sign_after[k, padded[sign + size]]]])
        rows = []
        for lo, hi in zip(at.tolist(), np.minimum(ends[np.searchsorted(ends, at, "right")], at + self.reach).tolist(), strict=True):
            # what ends here is shorter than `reach`, so that no word of it is cut
            line = (" " if data[lo] < 128 else "x") + data[lo:hi].tobytes().decode(errors="ignore")
            for person, _, y in self.odd.met(line, 1):
                rows.append((person, lo, lo + len(line[1:y].encode()), y == 3))
        return tuple(np.array([r[c] for r in rows], bool if c == 3 else np.int64) for c in range(4))


def writing_mentions(files: DataFrame, identities: DataFrame) -> DataFrame:
    """G-13: canonical_id, file, line (from 1) and the first form found, of files(file, text), once for each person and line.

    Texts are looked through in place, some 4 MB at a time: the forms go to them, FORMS at a time.
    """
    ship(files.sparkSession)
    forms = writing_forms(identities)
    blocks = max(1, -(-forms.count() // FORMS))
    schema = "canonical_id string, file string, line int, form string"
    out = None
    for block in range(blocks):
        known = Forms([tuple(r) for r in forms.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block).select("canonical_id", "form").collect()])  # about FORMS of them

        def walk(batches: Iterator[pa.RecordBatch], known: Forms = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PART
                for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size)) + 1):
                    if not len(part):
                        continue
                    rows = batch.slice(int(part[0]), len(part))
                    person, text, line, form = known.met(rows.column("text").cast(pa.large_string()))
                    yield pa.RecordBatch.from_arrays([person, rows.column("file").take(pa.array(text)), pa.array(line, pa.int32()), form], ["canonical_id", "file", "line", "form"])

        found = files.select(F.col("file").cast("string").alias("file"), "text").mapInArrow(walk, schema)
        out = found if out is None else out.union(found)
    return out if blocks == 1 else out.groupBy("canonical_id", "file", "line").agg(F.min("form").alias("form"))
