"""Target-distribution importance resampling with hashed n-grams.

1. Words are exploded with their positions; lead() within a document puts the words that follow beside each,
   so that the runs of every order begin in one row. A row becomes the buckets of its runs, and this table
   (some bits a bucket) is written to the shared folder, as both the counts and the scores read it.
   Texts are shuffled whole, once, by row; the window then sorts words where they are.
2. Buckets of the corpus and of the target are counted; their smoothed ratio is a bucket's gain.
3. Gains, one row a bucket, are joined to the table, and a document's weight is the mean over its runs.
4. Weights get Gumbel noise from a digest of the doc_id, and the highest scores are drawn: a sample without
   replacement by weight that any later run repeats. Ranks come from a range partitioning, not from one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove, shared_folder
from .common import cut, numbered

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are lower-cased word by word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7


def lowered(word: Column) -> Column:
    """A-Z lower-cased, no other letters; lower() does that where all characters are single bytes."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def positions(texts: DataFrame) -> DataFrame:
    """row, id, pos and word of every word of texts(id, text); a text without words has one row, without word."""
    placed = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text").repartition("row")
    words = placed.select("row", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    return words.withColumn("word", lowered(F.col("word")))


def runs(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """row, id and the buckets b1 to b<orders> of the runs that begin at each word; null where no run of that order does."""
    by_place = Window.partitionBy("row").orderBy("pos")
    words = positions(texts).select("row", "id", "word", *(F.lead("word", k).over(by_place).alias(f"w{k}") for k in range(1, orders)))
    run, out = F.col("word"), []
    for k in range(orders):
        run = F.concat(run, F.lit(" "), F.col(f"w{k}")) if k else run
        out.append((F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"b{k + 1}"))
    return words.select("row", "id", *out)


def tally(table: DataFrame, orders: int, name: str) -> DataFrame:
    """bucket and how many runs fall into it."""
    each = table.select(F.explode(F.array(*(f"b{k + 1}" for k in range(orders)))).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain for all buckets, from corpus(bucket, s) and target(bucket, t)."""
    counts = cut(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0))
    every = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    double = lambda c: c.cast("double")
    ratio = double(F.col("t") + 1) * F.lit(float(every["s"] + buckets)) / (double(F.col("s") + 1) * F.lit(float(every["t"] + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of documents(doc_id, text, ...) with its weight towards target(text, ...), and the rank of those drawn.

    Returns doc_id, n_features, weight, score, rank (from 1; null where a document isn't drawn). Of the N rows
    with least_words words or more, the floor(percent * N / 100) highest scores are drawn, ties to smaller
    doc_ids.

    Null texts, empty ones and those without words have no features and a weight of 0. A row without doc_id has
    no score, isn't drawn and isn't one of the N; its words count in the corpus. Rows of one doc_id are documents
    of their own with the same noise. An empty target leaves only the smoothing; empty documents give no rows;
    further columns are ignored.
    """
    spark = documents.sparkSession
    home = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs(documents.select(F.col("doc_id").cast("long").alias("id"), "text"), orders, buckets).write.parquet(home)
    table = spark.read.parquet(home)
    wanted = runs(target.select(F.lit(None).cast("long").alias("id"), "text"), orders, buckets)
    gain = gains(tally(table, orders, "s"), tally(wanted, orders, "t"), buckets)
    total = F.lit(0).cast("long")
    for k in range(orders):
        of_run = gain.select(F.col("bucket").alias(f"b{k + 1}"), F.col("gain").alias(f"g{k + 1}"))
        table = table.join(F.broadcast(of_run), f"b{k + 1}", "left")  # one row a bucket
        total = total + F.coalesce(f"g{k + 1}", F.lit(0))
    features = sum((F.count(f"b{k + 1}") for k in range(orders)), F.lit(0).cast("long"))
    rows = table.groupBy("row", "id").agg(features.alias("n_features"), F.count("b1").alias("n_words"), F.sum(total).alias("g"))
    weight = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(0).cast("long")
    scored = rows.select(F.col("id").alias("doc_id"), "n_features", "n_words", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = cut(scored)
    remove(spark, home)  # the scores are written, and nothing reads the runs again
    among = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    ranked, n = numbered(scored.where(among), F.col("score").desc(), F.col("doc_id"), F.col("n_features"), name="place")
    drawn = ranked.withColumn("rank", F.when(F.col("place") < percent * n // 100, F.col("place") + 1))
    return drawn.drop("place").unionByName(scored.where(~among).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
