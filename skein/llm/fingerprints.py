"""Document fingerprints by winnowing, in DataFrame functions only.

Grams are runs of GRAM words (split at white space; a word of more than LONG_WORD characters counts as that
many words of one); a text with fewer words is one gram. Gram hashes
roll by doubling: pairs of words, then pairs of pairs. Each value holds a gram's hash in its upper bits
and the complement of its position in its lower bits, so that the minimum of a window is the least hash
and, among ties, the rightmost; window minima come by doubling too. Any run of WINDOW + GRAM - 1 words
that two texts share leaves a common fingerprint in both, and positions are kept with the hashes.

Texts of up to SHORT characters have values of runs of GRAM characters besides, at positions from
CHARACTERS on: the minima of windows of WINDOW, or all of them in texts of less than 2 * (WINDOW + GRAM - 1)
characters. Like is compared with like: two such texts by all their values, and a pair of which either is longer by
the words' values alone, which every text has.
Half of a longer text holds a run of WINDOW + GRAM - 1 words, and half of a shorter one a run of characters
that leaves a common value, from 2 * GRAM - 1 characters on (white space in long runs aside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 4, 16  # powers of two: both are reached by doubling
POSITION_BITS = 27
_POSITIONS = (1 << POSITION_BITS) - 1
_HASHES = ((1 << 63) - 1) ^ _POSITIONS
_LEAST = -(1 << 63)
LONG_WORD = 24
#: Half of a text over this size holds WINDOW + GRAM - 1 words of up to LONG_WORD characters, and one cut in two.
SHORT = 1024
CHARACTERS = 1 << (POSITION_BITS - 1)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: the selected values of column `text`'s words, in order of position."""
    df = df.withColumn("_s", F.split(F.col(text), r"\s+"))
    pieces = F.flatten(F.transform("_s", lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    df = df.withColumn("_s", F.when(F.exists("_s", lambda w: F.length(w) > LONG_WORD), pieces).otherwise(F.col("_s")))
    return _winnowed(df.withColumn("_w", F.transform("_s", lambda w: F.xxhash64(w))).drop("_s"), name)


def with_characters(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: the selected values of column `text`'s characters if it is short, and none otherwise."""
    size = F.length(F.col(text))
    units = F.when((size > 0) & (size <= SHORT), F.split(F.col(text), "")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_w", F.transform(units, lambda c: F.xxhash64(F.lit(CHARACTERS), c)))
    return _winnowed(df, name, CHARACTERS, size < 2 * (WINDOW + GRAM - 1))


def with_both(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: the values of column `text`'s words, then those of its characters."""
    df = with_characters(with_fingerprint(df, text, name), text, "_c")
    return df.withColumn(name, F.concat(name, "_c")).drop("_c")


def _winnowed(df: DataFrame, name: str, start: int = 0, every: Column | None = None) -> DataFrame:
    """df with `name`: the values selected of the hashes in _w, whose positions begin at `start`; all of them where `every`."""
    df = df.withColumn("_n", F.greatest(F.size("_w") - (GRAM - 1), F.lit(1)))
    step = 1
    while step < GRAM:
        df = df.withColumn("_w", F.zip_with("_w", F.slice("_w", F.lit(step + 1), F.size("_w")), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    df = df.withColumn("_w", F.transform(F.slice("_w", F.lit(1), F.col("_n")), lambda h, i: h.bitwiseAND(F.lit(_HASHES)).bitwiseOR(F.lit(_POSITIONS - start) - i)))
    if every is not None:
        df = df.withColumn("_all", F.when(every, F.col("_w")))
    step = 1
    while step < WINDOW:
        df = df.withColumn("_w", F.zip_with("_w", F.slice("_w", F.lit(step + 1), F.size("_w")), lambda a, b: F.least(a, b)))
        step *= 2
    least = F.array_distinct(F.slice("_w", F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(1))))
    df = df.withColumn(name, least if every is None else F.coalesce("_all", least))
    return df.drop("_w", "_n", "_all")


def _hashes(name: str) -> Column:
    return F.transform(name, lambda v: F.shiftright(v, POSITION_BITS))


def shown(name: str) -> Column:
    """A fingerprint as text: each value in hexadecimal, hash before complement of position."""
    return F.array_join(F.transform(name, lambda v: F.hex(v)), " ")


def _of_words(name: str) -> Column:
    """The values of words among those of a fingerprint: their positions are below CHARACTERS."""
    return F.filter(name, lambda v: v.bitwiseAND(F.lit(_POSITIONS)) > _POSITIONS - CHARACTERS)


def likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """df with `name`: the Jaccard likeness of two fingerprints' hashes, of characters too if both have them, else of words."""
    df = df.withColumns({"_wa": _of_words(a), "_wb": _of_words(b)})
    both = (F.size("_wa") < F.size(a)) & (F.size("_wb") < F.size(b))
    side = lambda full, words: F.when(both, F.col(full)).otherwise(F.col(words))
    df = df.withColumns({"_wa": side(a, "_wa"), "_wb": side(b, "_wb")})
    df = df.withColumns({"_wa": _hashes("_wa"), "_wb": _hashes("_wb")})
    return df.withColumn(name, F.size(F.array_intersect("_wa", "_wb")) / F.size(F.array_union("_wa", "_wb"))).drop("_wa", "_wb")


def _choose(key: Column, bounds: list[int], low: int = 0) -> Column:
    """How many bounds are <= key, by bisection."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _choose(key, bounds[:mid], low)).otherwise(_choose(key, bounds[mid + 1 :], low + mid + 1))


def with_next(df: DataFrame, key: str, *carried: str, parts: int) -> DataFrame:
    """df with next_<column> of the row that follows by `key` (then by the first carried column), the first row's for the last.

    Rows go once to contiguous ranges of the key; the first row of each range also goes to the range
    before it. Only quantiles of the key and the first key of each range reach the driver.
    """
    quantiles = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, quantiles, 10 * parts).alias("q")).first()["q"] if quantiles else []
    range_of = _choose(F.col(key), sorted(set(found or [])))
    df = df.withColumn("_range", range_of)
    firsts = sorted((r["_range"], r["k"]) for r in df.groupBy("_range").agg(F.min(key).alias("k")).collect())
    if not firsts:
        firsts = [(0, 0)]
    targets = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    extra = F.broadcast(df.sparkSession.createDataFrame(targets, "_first long, _before int"))  # at most `parts` rows
    own, guest = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("g"))
    placed = df.join(extra, F.col(key) == F.col("_first"), "left")
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    placed = placed.withColumns({"_r": F.col("_at.r"), "_g": F.col("_at.g")}).drop("_at", "_range", "_first", "_before")
    order = Window.partitionBy("_r").orderBy("_g", key, carried[0])
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_g = 0").drop("_r", "_g")


def fingerprint(documents: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edit with the next document's head.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; an empty text has the fingerprint of one empty word. Null doc_ids come
    before all others, and rows of one doc_id by their text; each row gives a row. An only document is
    its own next one. Empty tables give no rows; further columns are ignored.
    """
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    df = with_next(with_both(df, "text", "sel"), "key", "text", "sel", parts=parts)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = df.select("doc_id", "n_chars", "edited", "sel", "next_sel")
    df = with_both(df, "edited", "edited_sel")
    df = likeness(likeness(df, "near_edited", "sel", "edited_sel"), "near_next", "sel", "next_sel")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("sel").alias("fingerprint"), shown("edited_sel").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
