"""The people store as an op log (C rows): state is the latest row of each key, never updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("view", "click", "signup", "purchase")


def latest(ops: DataFrame, key: list[str]) -> DataFrame:
    """C-02/C-04: last write wins by (updated_at, op)."""
    w = Window.partitionBy(*key).orderBy(F.col("updated_at").desc(), F.col("op").desc())
    return ops.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def replay(ops: DataFrame, kinds: tuple[str, ...] = KINDS, since: int | None = None) -> DataFrame:
    """C-05/T-10: state after the known ops, in order; with `since` only rows changed after it."""
    state = latest(ops.where(F.col("kind").isin(*kinds)), ["key"])
    return state if since is None else state.where(F.col("updated_at") > since)


def people(rows: DataFrame, tags: DataFrame, interactions: DataFrame) -> DataFrame:
    """C-01: live people with their tags and number of interactions."""
    t = tags.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    i = interactions.groupBy("key").agg(F.count("*").alias("interactions"))
    return rows.where("deleted_at is null").join(t, "key", "left").join(i, "key", "left").select("key", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("interactions", F.lit(0)).alias("interactions"))


def log_interaction(ops: DataFrame, key: str, kind: str, at: int, amount: float = 0.0) -> DataFrame:
    """C-03/M-08: the log with one more op; a person comes to be with its first op."""
    last = F.coalesce(F.max("op"), F.lit(-1)) + 1
    new = ops.agg(last.alias("op")).select("op", F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.lit(amount).alias("amount"), F.lit(at).cast("long").alias("updated_at"))
    return ops.unionByName(new)


#: The nested export: people with tags and interactions, and connections between them.
DUMP = """people array<struct<id: string, name: string, relationship: string, email: string, phone: string, location: string, birthday: string, notes: string, avatar: string, followUp: string,
    tags: array<string>, interactions: array<struct<id: string, type: string, notes: string, date: string>>>>, connections array<struct<source: string, target: string, strength: int>>"""
FIELDS = ("relationship", "email", "phone", "location", "birthday", "notes", "avatar")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """seq and text of dumps, one a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("seq"), F.col("value").alias("text"))


def from_dump(dumps: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C-06: people, tags, interactions and connections of dumps(seq, text), in order of seq.

    Of people or interactions of one id the first is kept, though tags and interactions of the others still count;
    of a connection the last. Who has no id gets one from their place in the dump, so that a task that runs again
    gives the same. Interactions without a date happen now, those of an unreadable one are left out, as are null tags.
    A connection to nobody is an error.
    """
    parsed = dumps.select("seq", F.from_json("text", DUMP).alias("d"))
    given = lambda c: F.nullif(c, F.lit(""))
    made = lambda kind, *at: F.sha2(F.concat_ws("/", F.lit(kind), *[F.col(c).cast("string") for c in at]), 256)
    p = parsed.select("seq", F.posexplode("d.people").alias("_p", "p")).withColumn("id", F.coalesce(given(F.col("p.id")), made("person", "seq", "_p")))
    stamp = F.lit(now).cast("long")
    own = F.struct(F.coalesce(given(F.col("p.name")), F.lit("(unnamed)")).alias("name"), *[given(F.col(f"p.{c}")).alias(c) for c in FIELDS], given(F.col("p.followUp")).alias("follow_up"))
    people = p.groupBy("id").agg(F.min_by(own, F.struct("seq", "_p")).alias("r")).select("id", "r.*", F.lit(None).cast("long").alias("deleted_at"), stamp.alias("created_at"), stamp.alias("updated_at"))
    tags = p.select(F.col("id").alias("person_id"), F.explode("p.tags").alias("tag")).where("tag is not null").distinct()
    i = p.select("id", "seq", "_p", F.posexplode("p.interactions").alias("_i", "i"))
    when = F.when(given(F.col("i.date")).isNull(), stamp).otherwise(F.unix_millis(F.try_to_timestamp("i.date")))
    i = i.select(F.coalesce(given(F.col("i.id")), made("interaction", "seq", "_p", "_i")).alias("key"), F.struct("seq", "_p", "_i").alias("at"), F.col("id").alias("person_id"),
                 F.coalesce(given(F.col("i.type")), F.lit("note")).alias("kind"), given(F.col("i.notes")).alias("body"), when.alias("occurred_at")).where("occurred_at is not null")
    interactions = i.groupBy("key").agg(F.min_by(F.struct("person_id", "kind", "body", "occurred_at"), "at").alias("r")).select(F.col("key").alias("id"), "r.*", stamp.alias("created_at"), stamp.alias("updated_at"))
    c = parsed.select("seq", F.posexplode("d.connections").alias("_c", "c"))
    c = c.groupBy("c.source", "c.target").agg(F.max_by(F.coalesce("c.strength", F.lit(1)), F.struct("seq", "_c")).alias("strength"))
    for end in ("source", "target"):
        c = c.join(people.select(F.col("id").alias(end), F.lit(True).alias("_there")), end, "left")
        c = c.withColumn(end, F.when(F.col("_there"), F.col(end)).otherwise(F.raise_error(F.concat(F.lit("connection to nobody: "), F.coalesce(end, F.lit("null")))))).drop("_there")
    return people, tags, interactions, c.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "strength", stamp.alias("updated_at"))


def history(notes: DataFrame) -> DataFrame:
    """C-07: annotations with their version and whether they're current."""
    w = Window.partitionBy("key").orderBy("updated_at", "op")
    n = notes.withColumn("version", F.row_number().over(w))
    return n.withColumn("current", F.col("version") == F.max("version").over(Window.partitionBy("key")))


def set_follow_up(people: DataFrame, identities: DataFrame, person: str, text: str | None, now: int) -> DataFrame:
    """M-09: people(id, name, anchor, follow_up, deleted_at, created_at, updated_at) with one person's follow-up set.

    A person without a live row is made from their identity, anchored by their aliases; one that no identity has is an error.
    """
    found = people.where((F.col("id") == person) & F.col("deleted_at").isNull()).limit(1).count()
    if not found:
        new = identities.where(F.col("canonical_id") == person).limit(1)
        if not new.count():
            raise ValueError(f"unknown person: {person}")
        anchor = F.to_json(F.struct(F.col("display_name").alias("name"), F.col("aliases").alias("handles")))
        stamp = F.lit(now).cast("long")
        row = new.select(F.lit(person).alias("id"), F.col("display_name").alias("name"), anchor.alias("anchor"), F.lit(None).cast("string").alias("follow_up"), F.lit(None).cast("long").alias("deleted_at"), stamp.alias("created_at"), stamp.alias("updated_at"))
        people = people.unionByName(row)
    mine = (F.col("id") == person) & F.col("deleted_at").isNull()
    return people.withColumns({"follow_up": F.when(mine, F.lit(text)).otherwise(F.col("follow_up")), "updated_at": F.when(mine, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})
