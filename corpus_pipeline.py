"""Corpus pipeline over `documents`: each stage works on all that its predecessor kept.

Stages but the last return the columns of documents; every stage's rows are written as Parquet to the
cluster's shared folder and read again as the next one's input.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontamination, minhash, packing, quality, suffixes
from skein.llm.common import read
from skein.llm.queries import tokenizer_path
from skein.session import remove, shared_folder

#: Strings of this many bytes are taken out wherever they repeat, and shorter ones if they have this many words:
#: passages of over fifty words are seldom shorter, but can have as few as 101 bytes.
REPEATED_BYTES, REPEATED_WORDS = 240, 51


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group linked by a similarity of 0.8 on five-word shingles."""
    return minhash.keep_one(docs, shingle=5, similarity=Fraction(4, 5))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere."""
    return suffixes.cleaned(docs, size=REPEATED_BYTES, n_words=REPEATED_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("quality_classifier", reject_poor),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents of sf_dir."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, done = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if done:  # what came before the last written stage isn't read again
            remove(spark, f"{home}/{done}")
        done = name
    return docs
