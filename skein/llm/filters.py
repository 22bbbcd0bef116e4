"""Filter interaction audit: what each of five filters removes, in every order, for each part of the corpus.

1. Every document gets five failure flags. Four come from its own text; the fifth says that a smaller doc_id
   has the same text, for which only digests are grouped and joined, by digest and doc_id, so that copies of
   one text are dealt over tasks.
2. Documents are counted by part and flags, before anything else: at most 32 rows a part go on.
3. CUBE over the flags and the part. In a grouping set the row whose selected flags are all false counts the
   documents that survive this subset of the filters.
4. A step of an order takes a subset to the subset with one filter more. The 80 such pairs are joined once for
   each part; the 600 steps of all orders, a fixed table, look their pair up. Shapley sums weigh a pair by the
   number of orders that go through it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
BIT = {f: 1 << (len(FILTERS) - 1 - i) for i, f in enumerate(FILTERS)}  # as grouping_id numbers the cube's columns
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, SIGNS = 50, 65, 5, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
PIECE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end before white space, so that few words are held at once."""
    at = 0
    while at < len(raw):
        end = _WHITE.search(raw, at + size)
        stop = end.start() if end else len(raw)
        yield raw[at:stop]
        at = stop


def flags(text: str, least_words: int = LEAST_WORDS, distinct_share: int = DISTINCT_SHARE, upper_share: int = UPPER_SHARE, signs: bytes = SIGNS) -> int:
    """Failures A to D of a text, as bits: few words, few distinct words, much upper case, one of the signs."""
    raw, n, seen = text.encode(), 0, set()
    for piece in pieces(raw):
        words = piece.split()
        n += len(words)
        seen.update(words)
    found = BIT["A"] * (n < least_words) | BIT["B"] * (100 * len(seen) < distinct_share * n)
    found |= BIT["C"] * (100 * (len(raw) - len(raw.translate(None, UPPER))) > upper_share * len(text))
    return found | BIT["D"] * (len(raw.translate(None, signs)) < len(raw))


def judged(documents: DataFrame, **limits) -> DataFrame:
    """doc_id, part, digest of the text and failures A to D (bits) of every row of documents."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), digests, pa.array([flags(t, **limits) for t in texts], pa.int32())], ["doc_id", "part", "digest", "bits"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, bits int")


def cells(documents: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """part, A to E (booleans), and the n, good and toxic documents that have them."""
    rows = cut(judged(documents, **limits).groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of_label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    known = rows.join(first, ["digest", "doc_id"], "left").join(of_label.where("doc_id is not null"), "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    held = [(F.col("bits").bitwiseAND(BIT[f]) > 0).alias(f) for f in FILTERS[:-1]] + [repeats.alias("E")]
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return known.select("part", *held, "n", "good", "toxic").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """part (null: the whole table, `whole`), subset of the filters (bits), and the n, good and toxic documents that pass it.

    Subsets that no document passes have no row; the empty subset has all documents.
    """
    cube = counted.cube("part", *FILTERS).agg(F.grouping_id().alias("rolled"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passed = cube.where(" and ".join(f"not coalesce({f}, false)" for f in FILTERS))
    subset = F.lit(ALL) - F.col("rolled").bitwiseAND(ALL)
    return passed.select("part", (F.col("rolled") > ALL).alias("whole"), subset.cast("int").alias("subset"), "n", "good", "toxic")


def interactions(documents: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Counts of every step of every order of the five filters, for each part and for the whole table.

    documents(doc_id, text, source, ...) and labels(doc_id, quality, toxic, ...) give part (source; null and
    empty are one part), whole (true for the table's rows, whose part is null), filter_order, step (1 to 5),
    filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Null texts are empty: without words a text fails A only. A row without doc_id neither repeats a text nor
    makes others repeat it, and has no labels. Rows of one doc_id and text don't repeat each other. A doc_id
    that labels have several times is good or toxic if any of its rows says so. An empty table gives no rows;
    further columns are ignored.
    """
    spark = documents.sparkSession
    passed = cut(survivors(cells(documents, labels, **limits)))
    order = spark.createDataFrame([(f, b) for f, b in BIT.items()], "filter string, bit int")
    kinds = passed.where("subset = 0").select("part", "whole").withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    steps = kinds.join(F.broadcast(order), F.col("before").bitwiseAND(F.col("bit")) == 0).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    at = lambda side: passed.select(F.coalesce("part", F.lit("")).alias("_part"), F.col("whole").alias("_whole"), F.col("subset").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "good", "toxic")))
    place = [F.coalesce("part", F.lit("")).alias("_part"), F.col("whole").alias("_whole"), "part", "whole", "filter", "bit", "before", "after"]
    pairs = steps.select(*place).join(at("before"), ["_part", "_whole", "before"], "left").join(at("after"), ["_part", "_whole", "after"], "left").na.fill(0)
    lost = lambda c: (F.col(f"before_{c}") - F.col(f"after_{c}"))
    pairs = cut(pairs.select("part", "_part", "whole", "filter", "bit", "before", F.col("after_n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost")))

    through = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), F.bit_count("before") + 1)
    alone = lambda before, name: F.max(F.when(F.col("before") == before, F.col("removed"))).alias(name)
    of_filter = pairs.groupBy("_part", "whole", "filter").agg(alone(F.lit(0), "fails"), alone(F.lit(ALL) - F.col("bit"), "unique_fails"), F.sum(F.col("removed") * through).alias("shapley"))
    schedule = [("".join(o), i + 1, f, sum(BIT[x] for x in o[:i])) for o in itertools.permutations(FILTERS) for i, f in enumerate(o)]
    table = spark.createDataFrame(schedule, "filter_order string, step int, filter string, before int")
    return (
        pairs.join(of_filter, ["_part", "whole", "filter"]).join(F.broadcast(table), ["before", "filter"])
        .select("part", "whole", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
