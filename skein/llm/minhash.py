"""Near-duplicate components by b-bit MinHash.

1. Every document's set of word shingles gives K minima. Groups of ROWS whole minima are the bands; of
   every minimum only the low BITS are kept, as bit planes, so that two signatures are compared by xor
   and bit counts, and their likeness is estimated with the chance of equal bits taken off.
2. Equal sets are one class. In each band bucket every class is paired with the bucket's least class, its
   hub, only, so a bucket of m classes gives m - 1 candidates.
3. Candidates whose estimate is high enough are confirmed on the full sets, in blocks that hold one hub
   and a bounded share of its candidates.
4. A bucket whose classes beside the hub aren't one component yet is compared again, by itself: all classes
   outside its main component against the bucket, in blocks of bounded size, first by signature and then on
   full sets; a block stops asking about a class once it's linked. Of buckets with the same classes one is
   compared. So no link is lost to the choice of hubs.
With 32 bands of 5 rows, two sets of likeness 0.85 share no band with a chance of 7e-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ship
from .shingles import Permutations, lowered, mixed, shingles

BANDS, ROWS, BITS, SEED = 32, 5, 4, 4242
K = BANDS * ROWS
LEFT, RIGHT = 512, 4096  # classes of a block held in memory, and streamed past them


def pack(minima: np.ndarray) -> bytes:
    """The low BITS of K minima as BITS planes of K bits."""
    return b"".join(np.packbits((minima >> np.uint32(i)) & np.uint32(1) == 1).tobytes() for i in range(BITS))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Likeness of signature planes (BITS, bytes) to each of (n, BITS, bytes), corrected for chance collisions."""
    differ = np.bitwise_or.reduce(many ^ one, axis=-2)
    equal = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / K
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def floor_of(similarity: Fraction) -> float:
    """Estimates of pairs with this similarity fall below it with a chance under 1e-7."""
    s = float(similarity)
    return s - 5.5 * (s * (1 - s) / K) ** 0.5 - 2.0 / K


def sketch(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), set_key, signature and bands of every row with text; n = 0 and nulls without words."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations, powers = Permutations(K, SEED), np.random.default_rng(SEED + 1).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for text in part.column("text").to_pylist():
                    distinct = np.unique(shingles(lowered(text), shingle))
                    if not len(distinct):
                        out.append((0, None, None, None))
                        continue
                    low = permutations.minima(distinct)
                    keys = mixed((low.reshape(BANDS, ROWS).astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                    out.append((len(distinct), xxhash.xxh3_128_digest(distinct.tobytes()), pack(low), keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))))], ["doc_id", "n", "set_key", "signature", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_key binary, signature binary, bands array<long>")


def full_sets(documents: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """id, signature and sorted shingle set of classes(rep, set_key, id, signature), each from a text of its least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [np.unique(shingles(lowered(t), shingle)).tobytes() for t in part.column("text").to_pylist()]
                own = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, part.column("set_key").to_pylist(), strict=True)], pa.bool_())  # a doc_id may stand on several texts
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("signature"), pa.array(sets, pa.binary())], ["id", "signature", "shingles"]).filter(own)

    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(classes, "rep")
    return texts.select("id", "set_key", "signature", "text").mapInArrow(run, "id long, signature binary, shingles binary").dropDuplicates(["id"])


def confirm(blocks: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) between the left (side 0, in memory) and right (side 1, streamed) classes of each block (b1, b2).

    blocks: b1, b2, side, id, comp, signature, shingles. Pairs of one component aren't asked about, and
    links found join components within the block.
    """
    least = floor_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left, planes, parent = None, [], None, {}

        def root(c):
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pydict()
                for b1, b2, side, id_, comp, signature, raw in zip(*(rows[c] for c in ("b1", "b2", "side", "id", "comp", "signature", "shingles")), strict=True):
                    if (b1, b2) != block:
                        block, left, planes, parent = (b1, b2), [], None, {}
                    own = np.frombuffer(signature, np.uint8).reshape(BITS, -1)
                    have = np.frombuffer(raw, np.uint64)
                    if side == 0:
                        left.append((id_, comp, own, have))
                        continue
                    if not left:
                        continue
                    if planes is None:
                        planes = np.stack([x[2] for x in left])
                    guess = estimate(own, planes)
                    for i in np.flatnonzero(guess >= least)[np.argsort(-guess[guess >= least], kind="stable")]:
                        other, other_comp, _, other_set = left[i]
                        small, large = sorted((len(have), len(other_set)))
                        if other == id_ or root(comp) == root(other_comp) or small * similarity.denominator < large * similarity.numerator:
                            continue
                        common = len(np.intersect1d(have, other_set, assume_unique=True))
                        if common * similarity.denominator >= (small + large - common) * similarity.numerator:
                            parent[root(comp)] = root(other_comp)
                            found.append((id_, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return blocks.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "side").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents(doc_id, text, ...).

    Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle.
    Null texts and texts without words have no shingles and no links. Rows of one doc_id are one node
    with all their texts' links; a row without doc_id has no links, a null component_id, and is kept.
    Empty tables give no rows; further columns are ignored.
    """
    sketched = cut(sketch(documents, shingle))
    named = sketched.where("doc_id is not null and n > 0")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    buckets = classes.select("id", F.explode("bands").alias("band"))
    # cut, as are the salts, so that the joins have exchanges of their own, which are split where one key has many rows
    hubs = cut(buckets.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("m")).where("last > hub").select("band", "hub", "m"))
    beside = cut(buckets.join(hubs, "band").where("id <> hub"))
    pairs = cut(beside.select("id", "hub").distinct())
    nodes = pairs.select("id").union(pairs.select("hub")).distinct()
    sets = cut(full_sets(documents, classes.join(nodes, "id").select("rep", "set_key", "id", "signature"), shingle))

    salts = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / RIGHT).alias("salts")))
    asked = pairs.join(salts, "hub")
    right = asked.select(F.col("hub").alias("b1"), F.pmod(F.xxhash64("id"), F.col("salts")).alias("b2"), "id").join(sets, "id")
    left = salts.select(F.col("hub").alias("b1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("b2"), F.col("hub").alias("id")).join(sets, "id")
    order = ["b1", "b2", "side", "id", "comp", "signature", "shingles"]
    both = lambda l, r: l.withColumn("side", F.lit(0)).select(order).union(r.withColumn("side", F.lit(1)).select(order))
    links = cut(confirm(both(left.withColumn("comp", F.col("id")), right.withColumn("comp", F.col("id"))), similarity))

    linked = components(links)
    bucket = beside.where("m > 2").select("band", "id").join(linked.withColumnRenamed("node", "id"), "id", "left")
    bucket = cut(bucket.select("band", "id", F.coalesce("component", "id").alias("comp")))
    same = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")]
    sizes = bucket.groupBy("band", "comp").agg(F.count("*").alias("m"), *same)
    open_ = sizes.groupBy("band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.sum("h").alias("h"), F.bit_xor("x").alias("x")).where("all > most")
    open_ = open_.groupBy("all", "h", "x").agg(F.min(F.struct("band", "main", "most")).alias("b"))
    open_ = cut(open_.select("b.band", "b.main", F.ceil((F.col("all") - F.col("b.most")) / LEFT).alias("ci"), F.ceil(F.col("all") / RIGHT).alias("cj")))
    rest = bucket.join(open_, "band")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    i, j = F.pmod(F.xxhash64("id"), F.col("ci")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("cj"))
    left = rest.where("comp <> main").withColumns({"i": i, "j": spread(F.col("cj"))})
    right = rest.withColumn("j", j).withColumn("i", spread(F.col("ci")))
    place = lambda d: d.select(F.col("band").alias("b1"), (F.col("i") * F.col("cj") + F.col("j")).alias("b2"), "id", "comp").join(sets, "id")
    more = cut(confirm(both(place(left), place(right)), similarity))

    # classes of one doc_id are linked by it
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).where("one <> other").select("doc_id")
    owned = named.join(several, "doc_id").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    owned = cut(owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b").where("a <> b"))
    if not (more.isEmpty() and owned.isEmpty()):
        linked = components(links.union(more).union(owned))
    named_by = classes.select("set_key", "id", "rep").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = cut(named_by.groupBy("component").agg(F.min("rep").alias("component_id")))
    of_class = named_by.join(least, "component").select("set_key", "component_id")
    found = sketched.join(of_class, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(documents: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of documents that stay when each component keeps its least doc_id."""
    gone = near_duplicates(documents, shingle, similarity).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long") == gone["_gone"], "left_anti")
