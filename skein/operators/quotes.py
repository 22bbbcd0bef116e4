"""Quote verification, daily picks and document headings (A-20, A-38, A-45)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_quote
from .ranking import ranked

KEY_WORDS, KEY_CHARACTERS = 3, 3
BLOCK_QUOTE = r"(?i)^>\s*(Them|You|They|Me)\s*:\s*(.*)$"
PROSE_QUOTE = r'["“”]([^"“”]{8,300})["“”]'


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def _runs(parts: Column, size: int, between: str) -> Column:
    """Runs of `size` parts that follow each other; all of them where there are fewer.

    The array is shifted as a whole and zipped: taken apart by a lambda, it would be made anew for every run.
    """
    if size == 1:
        return parts
    shifted = F.arrays_zip(*(F.slice(parts, k + 1, F.greatest(F.size(parts) - size + 1, F.lit(0))).alias(str(k)) for k in range(size)))
    runs = F.transform(shifted, lambda z: F.concat_ws(between, *(z.getField(str(k)) for k in range(size))))
    return F.when(F.size(parts) < size, F.array(F.array_join(parts, between))).otherwise(runs)


def verify(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """A-20: (item_id, doc_id) where a quote's text stands in a source, white space and case aside.

    Quotes meet sources by a phrase from their inside (the first and last word may be cut inside a word of the source, inner runs
    can't be); quotes too short for one meet them by their first characters. Only ids go through these joins, and only phrases that
    some quote has; texts are fetched for the pairs that are left, and compared.
    """
    q = quotes.select("item_id", _plain(F.col("text")).alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", " "))
    phrase = F.array_join(F.slice("w", 2, KEY_WORDS), " ")
    start = F.substring("quote", 1, KEY_CHARACTERS)
    q = q.select("item_id", "quote", F.when(F.size("w") >= KEY_WORDS + 2, phrase).otherwise(start).alias("key"), F.when(F.size("w") >= KEY_WORDS + 2, 0).otherwise(F.length(start)).alias("kind"))
    s = sources.select("doc_id", _plain(F.col("text")).alias("body"))
    kinds = {r["kind"] for r in q.select("kind").distinct().collect()}  # at most four
    keyed = lambda keys, kind: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keys = [keyed(_runs(F.split("body", ""), n, "") if n else _runs(F.split("body", " "), KEY_WORDS, " "), n) for n in sorted(kinds)] or [F.array().cast("array<struct<kind:int,key:string>>")]
    spots = s.select("doc_id", F.explode(F.flatten(F.array(*keys))).alias("k")).select("doc_id", "k.kind", "k.key")
    pairs = spots.join(q.select("item_id", "kind", "key"), ["kind", "key"]).select("item_id", "doc_id").distinct()
    met = pairs.join(q.select("item_id", "quote"), "item_id").join(sources.select("doc_id", "text"), "doc_id")  # raw: only texts that are met are made plain again
    found = met.where(_plain(F.col("text")).contains(F.col("quote")))
    return found.select("item_id", "doc_id").distinct()


def quoted_lines(portraits: DataFrame) -> DataFrame:
    """Quotes of Markdown portraits(doc, text): doc, line, kind, speaker (of block quotes: You or Them) and body."""
    lines = portraits.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("line", "t"))
    who = F.lower(F.regexp_extract("t", BLOCK_QUOTE, 1))
    block = F.array(F.struct(F.lit("blockquote").alias("kind"), F.when(who.isin("me", "you"), "You").otherwise("Them").alias("speaker"), F.trim(F.regexp_extract("t", BLOCK_QUOTE, 2)).alias("body")))
    prose = F.transform(F.regexp_extract_all("t", F.lit(PROSE_QUOTE), F.lit(1)), lambda x: F.struct(F.lit("prose").alias("kind"), F.lit(None).cast("string").alias("speaker"), F.trim(x).alias("body")))
    return lines.select("doc", "line", F.explode(F.when(who != "", block).otherwise(prose)).alias("q")).select("doc", "line", "q.*")


def unverified(portraits: DataFrame, messages: DataFrame) -> DataFrame:
    """A-20: quotes of portraits(doc, text) that no message(from_me, body) is, quotes, dashes, white space and case aside.

    Block quotes must be a message of the speaker's, quotes in prose anybody's. Quotes and messages meet by a digest of the normal
    text and the turn's speaker, so that bodies aren't shuffled.
    """
    digest = lambda c: F.sha2(normal_quote(c), 256)
    asked = quoted_lines(portraits).withColumns({"said": digest(F.col("body")), "turn": F.coalesce("speaker", F.lit(""))}).where(normal_quote(F.col("body")) != "")
    turns = messages.select(digest(F.coalesce("body", F.lit(""))).alias("said"), F.explode(F.array(F.when(F.col("from_me"), "You").otherwise("Them"), F.lit(""))).alias("turn")).distinct()
    return asked.join(turns, ["said", "turn"], "left_anti").select("doc", "line", "kind", "speaker", "body")


def daily_pick(rows: DataFrame, order: list[Column], day: int, new: int) -> DataFrame:
    """A-38: the row whose turn it is by day, and the first few of the order; rows are ranked by ranges, not in one task."""
    d = ranked(rows, *order, name="_r")
    n = d.count()
    return d.where((F.col("_r") == day % max(1, n)) | (F.col("_r") < new)).drop("_r")


def self_bundle(notes: DataFrame, day: int, new: int = 3) -> DataFrame:
    """A-38: of notes(id, confidence, lens) those for a day, by confidence (high, medium, low) times the weight of the lens, then id."""
    weight = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1) * F.col("lens")
    return daily_pick(notes.withColumn("weight", weight), [F.col("weight").desc(), F.col("id")], day, new)


def headings(documents: DataFrame, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """A-45: headings of Markdown documents(doc, text) with a slug that's unique in its document and the first line of text below."""
    lines = documents.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    level = F.length(F.regexp_extract("t", r"^(#+)\s", 1))
    lines = lines.withColumn("level", level).withColumn("h", (F.col("level").isin(*levels)).cast("int"))
    lines = lines.withColumn("section", F.sum("h").over(Window.partitionBy("doc").orderBy("line"))).where("section > 0")
    text = F.when((F.col("level") == 0) & (F.trim("t") != ""), F.struct("line", F.trim("t").alias("t")))
    g = lines.groupBy("doc", "section").agg(F.max(F.when(F.col("h") == 1, F.regexp_extract("t", r"^#+\s+(.*)$", 1))).alias("heading"), F.min(text).alias("x"))
    g = g.withColumn("slug", F.regexp_replace(F.lower("heading"), r"[^a-z0-9]+", "-"))
    k = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("section"))
    return g.withColumn("slug", F.when(k > 1, F.concat_ws("-", "slug", k)).otherwise(F.col("slug"))).select("doc", "section", "heading", "slug", F.col("x.t").alias("excerpt"))
