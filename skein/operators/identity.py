"""Identity resolution and record linkage (I rows)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BATCH_BYTES
from ..session import cut, ship
from .iterative import components

#: First names that no merge may rest on.
STOP_FIRST = ("a", "an", "the", "me", "you", "us", "them", "i", "mom", "dad", "mum", "son", "wife", "mr", "mrs", "dr", "guy")


def alias_kind(alias: Column, source: Column) -> Column:
    """I-01: phone or e-mail on address-based sources, else name."""
    digits = F.regexp_replace(alias, r"\D", "")
    address = source.isin("imessage", "gmail")
    return F.when(address & alias.contains("@"), "email").when(address & (F.length(digits) >= 7) & ~alias.rlike("[A-Za-z]"), "phone").otherwise("name")


def alias_key(alias: Column, source: Column) -> Column:
    kind = alias_kind(alias, source)
    value = F.when(kind == "phone", F.concat(F.lit("+"), F.regexp_replace(alias, r"\D", ""))).otherwise(F.lower(F.trim(alias)))
    return F.concat_ws(":", kind, value)


def resolve_components(threads: DataFrame) -> DataFrame:
    """I-02, scalable form: threads(n, aliases, source) are one person when any chain of alias keys joins them; person is the least thread ordinal."""
    k = threads.select("n", F.explode("aliases").alias("alias"), "source").select("n", alias_key(F.col("alias"), F.col("source")).alias("key")).distinct()
    hub = k.groupBy("key").agg(F.min("n").alias("hub"))
    edges = k.join(hub, "key").where("n <> hub").select(F.col("n").alias("a"), F.col("hub").alias("b"))
    found = components(edges)
    return threads.select("n").join(found, threads.n == found.node, "left").select("n", F.coalesce("component", "n").alias("person"))


def resolve_greedy(threads: DataFrame) -> DataFrame:
    """I-02, exact order-dependent form: threads in order; the first alias with a known key names the person, known keys aren't re-pointed.

    The scan is sequential over a person's possible matches, so it runs within components of shared keys, which can't influence each other.
    """
    group = resolve_components(threads)
    keyed = threads.join(group, "n").select("n", "person", F.transform("aliases", lambda a: alias_key(a, F.col("source"))).alias("keys"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        owner, out = {}, []
        for n, keys in rows.sort_values("n")[["n", "keys"]].itertuples(index=False):
            who = next((owner[k] for k in keys if k in owner), n)
            for k in keys:
                owner.setdefault(k, who)
            out.append((n, who))
        return pd.DataFrame(out, columns=["n", "person"])

    return keyed.groupBy("person").applyInPandas(walk, "n long, person long")


def display_name(aliases: DataFrame) -> DataFrame:
    """I-03: of aliases(person, alias, ordinal) a Latin full name, else any name, capitalised ones first in both; else the first alias."""
    a = F.col("alias")
    name = a.rlike(r"\p{L}") & ~a.rlike(r"^\+?\d") & ~a.contains("@")
    full, capital = name & a.rlike(r"\s") & a.rlike("^[A-Za-z]"), a.rlike("^[A-Z]")
    rank = F.when(full & capital, 0).when(full, 1).when(name & capital, 2).when(name, 3).otherwise(4)
    return aliases.groupBy("person").agg(F.min_by("alias", F.struct(rank, "ordinal")).alias("display_name"))


def attach(threads: DataFrame, keys: DataFrame) -> DataFrame:
    """I-04: threads(thread_id, participant, source) with the person of the participant's key."""
    return threads.withColumn("key", alias_key(F.col("participant"), F.col("source"))).join(keys, "key", "left").select("thread_id", "person")


def person_messages(messages: DataFrame, thread_identity: DataFrame, person: str) -> DataFrame:
    """I-05: all one-to-one messages of a person by time."""
    mine = thread_identity.where(F.col("canonical_id") == person).select("thread_id")
    return messages.join(mine, "thread_id", "left_semi").orderBy("ts", "id")


def _names(people: DataFrame) -> DataFrame:
    """people with `names`, (norm, tokens) of name-like aliases and the display name, and `best`, the first of most tokens."""
    like = lambda c: ~F.trim(c).rlike(r"^[+\d]") & ~c.contains("@") & c.rlike(r"\p{L}")
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", " "), r"\s+", " "))
    every = F.concat(F.filter("aliases", like), F.filter(F.array("display_name"), lambda c: c.isNotNull()))
    norms = F.filter(F.transform(every, norm), lambda n: n != "")
    named = F.transform(norms, lambda n: F.struct(n.alias("norm"), F.filter(F.split(n, " "), lambda t: F.length(t) >= 2).alias("tokens")))
    p = people.withColumn("names", named)
    most = F.array_max(F.transform("names", lambda x: F.size(x["tokens"])))
    return p.withColumn("best", F.get(F.filter("names", lambda x: F.size(x["tokens"]) == most), F.lit(0)))


def _alike(a: Column, b: Column) -> Column:
    """Whether two names are one, or the tokens of one open the other's."""
    n = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    opens = F.slice(a["tokens"], F.lit(1), n) == F.slice(b["tokens"], F.lit(1), n)
    return (n > 0) & ((a["norm"] == b["norm"]) | (opens & ((F.size(a["tokens"]) != F.size(b["tokens"])) | (n >= 2))))


def _same_first(a: Column, b: Column) -> Column:
    """Whether two names begin alike and no last names differ."""
    first = lambda c: F.get(c["tokens"], F.lit(0))
    rest = lambda c: F.slice(c["tokens"], F.lit(2), F.greatest(F.lit(0), F.size(c["tokens"]) - 1))
    same = (first(a) == first(b)) & (F.length(first(a)) >= 3) & ~first(a).isin(*STOP_FIRST)
    return F.coalesce(same & ((F.size(rest(a)) == 0) | (F.size(rest(b)) == 0) | (rest(a) == rest(b))), F.lit(False))


def merge_pairs(people: DataFrame, least: int = 5, block: int = 1000) -> DataFrame:
    """I-06/I-07: people(canonical_id, display_name, aliases, sources, msgs) that may be one, with disjoint sources.

    Score 1.0 where any of their names are one or one opens the other, 0.7 where only first names agree. A pair is
    judged in the first bucket of a first name that both are in, buckets being in the order of who has most messages.
    There, several full names make a pair with a single-token side ambiguous. Pairs whose best names have different
    last names are left out.

    A row of a bucket carries the buckets before it, so that a pair is told from one met earlier where it is made, and
    pairs are neither shuffled nor sorted. A bucket's people are dealt over tasks in blocks of some `block` rows.
    """
    p = _names(people).withColumn("n_best", F.coalesce(F.size("best.tokens"), F.lit(0))).withColumn("opening", F.transform("names", lambda x: F.get(x["tokens"], F.lit(0))))
    p = cut(p.select("canonical_id", "sources", "msgs", "names", "best", "n_best", "opening"))
    usable = F.array_distinct(F.filter("opening", lambda f: (F.length(f) >= 3) & ~f.isin(*STOP_FIRST)))
    firsts = p.withColumn("first", F.explode(usable))
    whole = F.when((F.col("n_best") >= 2) & (F.substring_index("best.norm", " ", 1) == F.col("first")), F.col("best.norm"))
    buckets = firsts.groupBy("first").agg(
        F.min(F.struct(-F.col("msgs"), "canonical_id", F.array_position("opening", F.col("first")))).alias("rank"), F.coalesce(F.min(whole) != F.max(whole), F.lit(False)).alias("several"),
        F.ceil(F.count_if(F.col("msgs") >= least) / block).alias("blocks"),
    )
    before = F.collect_list("first").over(Window.partitionBy("canonical_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    known = firsts.drop("opening").where(F.col("msgs") >= least).join(buckets, "first").withColumn("before", before)
    tasks = max(people.sparkSession.sparkContext.defaultParallelism, int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the result is far larger than what it's made from
    side = lambda s, k: known.select("first", *[F.col(c).alias(c + s) for c in ("canonical_id", "sources", "msgs", "names", "best", "n_best", "before", "several")], k.alias("_k")).repartition(tasks, "first", "_k")
    a, b = side("_a", F.pmod(F.xxhash64("canonical_id"), "blocks")), side("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    j = a.join(b, ["first", "_k"]).where("canonical_id_a < canonical_id_b").where(~F.arrays_overlap("sources_a", "sources_b")).where(~F.arrays_overlap("before_a", "before_b"))
    last = lambda s: F.slice(F.split(F.col(f"best{s}.norm"), " "), 2, 1000)
    j = j.where(~((F.col("n_best_a") >= 2) & (F.col("n_best_b") >= 2) & (last("_a") != last("_b"))))
    any_pair = lambda test: F.exists("names_a", lambda x: F.exists("names_b", lambda y: test(x, y)))
    j = j.withColumn("score", F.when(any_pair(_alike), 1.0).when(any_pair(_same_first), 0.7)).where("score is not null")
    win = F.col("msgs_a") >= F.col("msgs_b")
    pick = lambda won, lost: F.when(win, F.col(won)).otherwise(F.col(lost))
    single = (F.col("n_best_a") < 2) | (F.col("n_best_b") < 2)
    return j.select(pick("canonical_id_a", "canonical_id_b").alias("winner"), pick("canonical_id_b", "canonical_id_a").alias("loser"), "score", (F.col("several_a") & single).alias("ambiguous"))


def manual_merges(rules: DataFrame, people: DataFrame) -> DataFrame:
    """I-08: rules(winner_name, loser_name) resolved by display name or alias to the first person (by n); score 999."""
    keys = people.select("canonical_id", "n", F.explode(F.array_union(F.array("display_name"), "aliases")).alias("k")).groupBy(F.lower("k").alias("k")).agg(F.min_by("canonical_id", "n").alias("id"))
    w, l = keys.select(F.col("k").alias("wk"), F.col("id").alias("winner")), keys.select(F.col("k").alias("lk"), F.col("id").alias("loser"))
    j = rules.join(w, F.lower("winner_name") == F.col("wk")).join(l, F.lower("loser_name") == F.col("lk")).where("winner <> loser")
    return j.select("winner", "loser", F.lit(999).alias("score"))


def better_name(a: Column, b: Column) -> Column:
    """I-09: a name before a handle, then more tokens, then more characters."""
    rank = lambda c: F.struct((~(c.contains("@") | ~c.rlike(r"\p{L}"))).cast("int"), F.size(F.split(c, r"\s+")), F.length(c))
    return F.when(rank(b) > rank(a), b).otherwise(a)


def fold(identities: DataFrame, facts: dict[str, tuple[DataFrame, list[str]]], mapping: DataFrame) -> dict[str, DataFrame]:
    """I-11: rewrite every fact table's person columns by mapping(loser, winner), and unite identities.

    facts: name -> (rows, person columns); rows that become equal are one, and self-loops of link tables go.
    """
    m = mapping.select("loser", "winner")
    ids = identities.join(m, identities.canonical_id == m.loser, "left").withColumn("_to", F.coalesce("winner", "canonical_id"))
    own = F.struct((F.col("_to") != F.col("canonical_id")).cast("int"), F.col("canonical_id"))
    united = ids.groupBy("_to").agg(
        F.min_by("display_name", own).alias("display_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")
    ).withColumnRenamed("_to", "canonical_id")
    out = {"identities": united}
    for name, (rows, columns) in facts.items():
        for c in columns:
            rows = rows.join(m.select(F.col("loser").alias(c), F.col("winner").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
        if len(columns) == 2:
            rows = rows.where(F.col(columns[0]) != F.col(columns[1]))
        out[name] = rows.dropDuplicates()
    return out


def case_variants(people: DataFrame) -> DataFrame:
    """I-12: people(canonical_id, name, msgs) whose names differ in case only; the one of most messages wins, with the best-cased name."""
    cased = F.struct((F.col("name") != F.lower("name")).cast("int"), (F.col("name") != F.upper("name")).cast("int"), F.col("name"))
    g = people.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.count("*").alias("n"), F.max_by("canonical_id", F.struct("msgs", F.col("canonical_id"))).alias("winner"), F.max_by("name", cased).alias("best_name"))
    return g.where("n > 1").select("k", "n", "winner", "best_name")


def duplicates(people: DataFrame, self_id: str, keys: tuple = (("phone", 3, 6), ("email", 3, 6), ("name", 2, 8), ("token", 1, 12)), least: int = 2) -> DataFrame:
    """I-13: pairs that share keys. people(canonical_id, kind, key); points of a kind count for each shared key, keys of too many people don't count.

    A shared token counts only where the display names (kind `display`, each of their tokens a key) share one too, and either has three at most.
    """
    display = people.where("kind = 'display' and key <> ''").groupBy("canonical_id").agg(F.collect_set("key").alias("tokens"))
    people = people.where("kind <> 'display'")
    p = people.where(F.col("canonical_id") != self_id).distinct()
    size = p.groupBy("kind", "key").agg(F.count("*").alias("_n"))
    points, most = F.lit(0), F.lit(0)
    for kind, score, limit in keys:
        points, most = F.when(F.col("kind") == kind, score).otherwise(points), F.when(F.col("kind") == kind, limit).otherwise(most)
    small = p.join(size, ["kind", "key"]).where((F.col("_n") > 1) & (F.col("_n") <= most)).drop("_n")
    j = small.withColumnRenamed("canonical_id", "a").join(small.withColumnRenamed("canonical_id", "b"), ["kind", "key"]).where("a < b")
    side = lambda c: display.select(F.col("canonical_id").alias(c), F.col("tokens").alias(f"_{c}"))
    alike = F.arrays_overlap("_a", "_b") & ((F.size("_a") <= 3) | (F.size("_b") <= 3))
    j = j.join(side("a"), "a", "left").join(side("b"), "b", "left").where((F.col("kind") != "token") | F.coalesce(alike, F.lit(False))).drop("_a", "_b")
    rules = j.withColumn("_p", points).groupBy("a", "b").agg(F.sum("_p").alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))
    return rules.where(F.col("score") >= least)


def saved_merges(rules: DataFrame, people: DataFrame) -> DataFrame:
    """I-14: rules(rule, alias) with the only person of that alias, else 'ambiguous' or 'not-found'."""
    keys = people.select("canonical_id", F.explode(F.array_union(F.array("display_name"), "aliases")).alias("alias")).distinct().groupBy("alias").agg(F.count("*").alias("n"), F.min("canonical_id").alias("canonical_id"))
    j = rules.join(keys, "alias", "left")
    return j.select("rule", F.when(F.col("n") == 1, F.col("canonical_id")).alias("canonical_id"), F.when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("state"))


def audited(messages: DataFrame, identities: DataFrame, over: int = 100) -> DataFrame:
    """I-15's candidates: people with over `over` texts and one source, one of the two compared: canonical_id, side, first_ts, last_ts.

    messages are one-to-one ones with canonical_id. The reference takes the 60 people with most texts only; here all are compared.
    """
    m = messages.where(F.coalesce("body", F.lit("")) != "").groupBy("canonical_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    one = identities.where(F.size("sources") == 1).select("canonical_id", F.get("sources", F.lit(0)).alias("side"))
    return m.where(F.col("n") > over).join(one, "canonical_id").where(F.col("side").isin("instagram", "imessage")).select("canonical_id", "side", "first_ts", "last_ts")


#: People of the right side that a block holds, of the left that meet a block in one task, and of these at once; thirds and distinct counts in one matrix product.
HELD, MET, AT_ONCE, COLUMNS, LEVELS = 1024, 8192, 256, 4096, 16


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each entry of some lists, and the entries."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


class Signatures:
    """Signatures of a block, rows by thirds in the order of their names, against which others are held."""

    def __init__(self, lists: pa.ListArray):
        row, e = _entries(lists)
        names = pc.unique(e.field("third"))
        self.names = names.take(pc.sort_indices(names))
        col = pc.index_in(e.field("third"), value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        self.idf = np.zeros(len(self.names))
        self.idf[col] = e.field("idf").to_numpy()
        order = np.lexsort((row, col))
        self.rows, self.row, self.col, self.n = len(lists), row[order], col[order], e.field("n").to_numpy()[order]

    def of(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and count of the entries of other signatures whose third the block has, by column."""
        row, e = _entries(lists)
        col = pc.fill_null(pc.index_in(e.field("third"), value_set=self.names), -1).to_numpy().astype(np.int64)
        order = np.lexsort((row, col))[np.count_nonzero(col < 0) :]
        return row[order], col[order], e.field("n").to_numpy()[order]

    def low(self, rows: int, row: np.ndarray, col: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the lesser weights, and numbers of shared thirds, of all pairs. A lesser count is a sum of steps between the counts that
        occur, each taken where both counts reach it: a matrix product a step, or a row at a time where the steps are many."""
        low, shared = np.zeros((rows, self.rows)), np.zeros((rows, self.rows))
        for start in range(0, len(self.names), COLUMNS):
            width = min(COLUMNS, len(self.names) - start)
            a, b, counts = np.zeros((rows, width)), np.zeros((self.rows, width)), []
            for m, r, c, x in ((a, row, col, n), (b, self.row, self.col, self.n)):
                i, j = np.searchsorted(c, (start, start + width))
                m[r[i:j], c[i:j] - start] = x[i:j]
                counts.append(np.unique(x[i:j]))
            idf = self.idf[start : start + width]
            steps = np.union1d(*counts)
            steps = steps[steps <= min(c.max(initial=0) for c in counts)]
            shared += (a > 0).astype(np.float64) @ (b > 0).T.astype(np.float64)
            if len(steps) <= LEVELS:
                for before, step in zip([0, *steps], steps):
                    low += (a >= step).astype(np.float64) @ ((b >= step) * (idf * (step - before))).T
            else:
                for k in range(rows):
                    low[k] += np.minimum(b, a[k]) @ idf
        return low, shared

    def strongest(self, col: np.ndarray, n: np.ndarray, others: np.ndarray, shown: int) -> pa.ListArray:
        """The names of the `shown` strongest thirds that one signature shares with each of some rows of the block."""
        at, place = np.full(len(self.names), -1), np.full(self.rows, -1)
        at[col], place[others] = np.arange(len(col)), np.arange(len(others))
        kept = (at[self.col] >= 0) & (place[self.row] >= 0)
        b = np.zeros((len(others), len(col)))
        b[place[self.row[kept]], at[self.col[kept]]] = self.n[kept]
        weight = np.minimum(b, n) * self.idf[col]
        least = -np.partition(-weight, min(shown, len(col)) - 1, axis=1)[:, min(shown, len(col)) - 1, None]
        i, j = np.nonzero((b > 0) & (weight >= least))
        order = np.lexsort((j, -weight[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < shown
        i, j = i[first], j[first]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(others) + 1)), pa.int32()), self.names.take(pa.array(col[j])))


def _pairs_of(left: pa.RecordBatch, right: pa.Table, held: Signatures, least: float, shown: int) -> Iterator[pa.RecordBatch]:
    """Rows of the pairs of left and right whose weighted Jaccard may come to `least` when rounded."""
    row, col, n = held.of(left.column("signature"))
    low, shared = held.low(left.num_rows, row, col, n)
    total = left.column("total").to_numpy()[:, None] + right.column("total").to_numpy()
    order = np.argsort(row, kind="stable")
    row, col, n = row[order], col[order], n[order]
    for k in range(left.num_rows):
        others = np.flatnonzero((shared[k] > 0) & (low[k] >= (least - 1e-6) * (total[k] - low[k])))
        if len(others):
            i, j = np.searchsorted(row, (k, k + 1))
            ends = np.minimum(left.column("last_ts")[k].as_py(), right.column("last_ts").to_numpy()[others]) - np.maximum(left.column("first_ts")[k].as_py(), right.column("first_ts").to_numpy()[others])
            columns = [pa.repeat(left.column("canonical_id")[k], len(others)), right.column("canonical_id").combine_chunks().take(pa.array(others)), shared[k, others].astype(np.int64), low[k, others], total[k, others], ends, held.strongest(col[i:j], n[i:j], others, shown)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["a", "b", "shared", "low", "total", "ms", "top"])


def third_party_overlap(mention: DataFrame, people: DataFrame, least_signature: int = 5, least: float = 0.10, shown: int = 6) -> DataFrame:
    """I-15: pairs of the two sides of people(canonical_id, side, first_ts, last_ts) alike in whom else their threads mention.

    mention(canonical_id, third, n); the weighted Jaccard takes counts times ln((N+1)/df) of N people with mentions, without thirds
    known to max(3, half) of them or more. Signatures have five thirds at least; days of overlap and the strongest thirds come along.
    Every pair is compared, in blocks of signatures: no row is made for what a pair shares.
    """
    spark = mention.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    m = cut(mention.where(F.col("canonical_id") != F.col("third")).join(people, "canonical_id"))
    everyone = m.agg(F.count_distinct("canonical_id")).scalar()
    size = m.groupBy("canonical_id").agg(F.count("*").alias("k")).where(F.col("k") >= least_signature).select("canonical_id")
    df = m.groupBy("third").agg(F.count_distinct("canonical_id").alias("df")).withColumn("everyone", everyone).where(F.col("df") < F.greatest(F.lit(3), F.ceil(F.col("everyone") / 2)))
    w = m.join(size, "canonical_id").join(df, "third").withColumn("idf", F.log((F.col("everyone") + 1) / F.col("df")))
    w = cut(w.groupBy("canonical_id", "side", "first_ts", "last_ts").agg(F.sum(F.col("n") * F.col("idf")).alias("total"), F.collect_list(F.struct("third", "n", "idf")).alias("signature")))
    count = {r["side"]: r["n"] for r in w.groupBy("side").agg(F.count("*").alias("n")).collect()}
    blocks, parts = -(-count.get("imessage", 0) // HELD) or 1, -(-count.get("instagram", 0) // MET) or 1
    own = lambda k: F.pmod(F.xxhash64("canonical_id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    right = w.where("side = 'imessage'").select(own(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("_side"), "*")
    left = w.where("side = 'instagram'").select(every(blocks).alias("block"), own(parts).alias("part"), F.lit(1).alias("_side"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, table = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "_side")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if tuple(keys[i, :2]) != key:
                    key, held, block = tuple(keys[i, :2]), [], None
                if keys[i, 2] == 0:
                    held.append(batch.slice(i, j - i))
                elif held:
                    if block is None:
                        table = pa.Table.from_batches(held)
                        block = Signatures(table.column("signature").combine_chunks())
                    for k in range(i, j, AT_ONCE):
                        yield from _pairs_of(batch.slice(k, min(AT_ONCE, j - k)), table, block, least, shown)

    met = right.unionByName(left).repartition("block", "part").sortWithinPartitions("block", "part", "_side")
    j = met.mapInArrow(run, "a string, b string, shared long, low double, total double, ms long, top array<string>")
    j = j.withColumn("jaccard", F.round(F.col("low") / (F.col("total") - F.col("low")), 6)).where(F.col("jaccard") >= least)
    days = F.floor(F.greatest(F.lit(0), "ms") / 86_400_000 + 0.5).cast("long")
    return j.select("a", "b", "shared", "jaccard", days.alias("overlap_days"), F.array_join("top", ",").alias("top_shared"))


def misclassified_groups(messages: DataFrame, threads: DataFrame, least: int = 3) -> DataFrame:
    """I-17: one-to-one threads in whose messages several names write, with these names."""
    s = messages.where("sender_name is not null").groupBy("thread_id").agg(F.array_sort(F.collect_set("sender_name")).alias("senders")).where(F.size("senders") >= least)
    return threads.where("not is_group").join(s, "thread_id").select("thread_id", "senders")


def reclassified(messages: DataFrame, threads: DataFrame, thread_identity: DataFrame, least: int = 3) -> dict[str, DataFrame]:
    """I-17: threads and thread_identity with such threads as groups of their senders that belong to nobody; to be published together."""
    wrong = misclassified_groups(messages, threads, least)
    fixed = threads.join(wrong, "thread_id", "left")
    fixed = fixed.withColumn("participants", F.when(F.col("senders").isNotNull(), F.filter("senders", lambda x: F.trim(x) != "")).otherwise(F.col("participants")))
    fixed = fixed.withColumn("is_group", F.col("is_group") | F.col("senders").isNotNull()).select(threads.columns)
    return {"threads": fixed, "thread_identity": thread_identity.join(wrong.select("thread_id"), "thread_id", "left_anti")}


def anchors(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """I-19: wanted(key, name, handle) resolved by unique display name, then unique alias, then unique handle; an ambiguous tier ends it."""
    alias = people.select("canonical_id", F.explode("aliases").alias("k")).distinct()
    unique = lambda d, k, out: d.groupBy(F.lower(k).alias("_k" + out)).agg(F.count_distinct("canonical_id").alias("n_" + out), F.min("canonical_id").alias(out))
    d, a, h = unique(people, "display_name", "d"), unique(alias.where(~F.col("k").contains("@")), "k", "a"), unique(alias.where(F.col("k").contains("@")), "k", "h")
    j = wanted.join(d, F.lower("name") == F.col("_kd"), "left").join(a, F.lower("name") == F.col("_ka"), "left").join(h, F.lower("handle") == F.col("_kh"), "left")
    tier = lambda n, v, rest: F.when(F.col(n) == 1, F.col(v)).when(F.col(n) > 1, F.lit(None)).otherwise(rest)
    return j.select("key", tier("n_d", "d", tier("n_a", "a", tier("n_h", "h", F.lit(None).cast("string")))).alias("canonical_id"))


def relink(stored: DataFrame, people: DataFrame) -> DataFrame:
    """I-20: stored(key, canonical_id, name): an id is trusted only while its name matches, else the unique person of that name is taken."""
    by_id = people.select("canonical_id", F.col("display_name").alias("_now"))
    by_name = people.groupBy(F.lower("display_name").alias("_k")).agg(F.count("*").alias("_n"), F.min("canonical_id").alias("_to"))
    j = stored.join(by_id, "canonical_id", "left").join(by_name, F.lower("name") == F.col("_k"), "left")
    same = F.lower("_now") == F.lower("name")
    state = F.when(same, "kept").when(F.col("_n") == 1, "moved").when(F.col("_n") > 1, "ambiguous").otherwise("lost")
    return j.select("key", F.when(same, F.col("canonical_id")).when(F.col("_n") == 1, F.col("_to")).alias("canonical_id"), state.alias("state"))


def same_as(identities: DataFrame, merges: DataFrame) -> DataFrame:
    """canonical_id and `same_as`, the sorted ids that proposed merges(winner_name, loser_name) pair it with.

    Pairs are told by name, as ids are renumbered; a name that no person has, or several, pairs nobody.
    """
    one = identities.groupBy("display_name").agg(F.min("canonical_id").alias("id"), F.count("*").alias("n")).where("n = 1")
    name = lambda c, out: one.select(F.col("display_name").alias(c), F.col("id").alias(out))
    pairs = merges.join(name("winner_name", "a"), "winner_name").join(name("loser_name", "b"), "loser_name").where("a <> b").select("a", "b")
    both = pairs.union(pairs.select("b", "a"))
    return both.groupBy(F.col("a").alias("canonical_id")).agg(F.array_sort(F.collect_set("b")).alias("same_as"))


def with_links(people: DataFrame, identities: DataFrame, merges: DataFrame, portraits: DataFrame) -> DataFrame:
    """people(canonical_id, display_name, ...) with same_as (comma-joined) and has_portrait."""
    linked = people.join(same_as(identities, merges), "canonical_id", "left").withColumn("same_as", F.coalesce(F.array_join("same_as", ","), F.lit("")))
    pictured = portraits.select(F.col("name").alias("display_name")).distinct().withColumn("_p", F.lit(True))
    return linked.join(pictured, "display_name", "left").withColumn("has_portrait", F.coalesce("_p", F.lit(False))).drop("_p")


def search(identities: DataFrame, messages: DataFrame, thread_identity: DataFrame, query: str, merges: DataFrame, portraits: DataFrame, top: int = 20) -> DataFrame:
    """I-18/I-22/M-01: people whose name or any alias holds the query, by messages, with aliases, sources, same_as and has_portrait."""
    like = f"%{query}%"
    hit = identities.where(F.col("display_name").ilike(like) | F.exists("aliases", lambda a: a.ilike(like)))
    n = messages.join(thread_identity, "thread_id").groupBy("canonical_id").agg(F.count("*").alias("message_count"))
    found = hit.join(n, "canonical_id", "left").select("canonical_id", "display_name", "aliases", "sources", F.coalesce("message_count", F.lit(0)).alias("message_count"))
    return with_links(found.orderBy(F.col("message_count").desc(), "canonical_id").limit(top), identities, merges, portraits)


def apply_config(identities: DataFrame, thread_identity: DataFrame, messages: DataFrame, renames: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I-16: renames(canonical_id, name), and splits(thread_id, name): the threads of a name leave for a person of their own.

    New ids go on from the greatest number; a new person's sources are those of its threads' messages.
    """
    number = F.regexp_extract("canonical_id", r"(\d+)$", 1).cast("long")
    names = splits.select("name").distinct()
    last = identities.agg(F.coalesce(F.max(number), F.lit(-1))).scalar()
    ids = names.select("name", F.concat(F.lit("id-"), (last + F.row_number().over(Window.orderBy("name"))).cast("string")).alias("canonical_id"))  # as many as the configuration has
    moved = splits.join(ids, "name").select("thread_id", F.col("canonical_id").alias("_to"))
    threads = thread_identity.join(moved, "thread_id", "left").select("thread_id", F.coalesce("_to", "canonical_id").alias("canonical_id"))
    found = moved.join(messages.select("thread_id", "source"), "thread_id").groupBy(F.col("_to").alias("canonical_id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    new = ids.join(found, "canonical_id", "left").select("canonical_id", F.col("name").alias("display_name"), F.array("name").alias("aliases"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    old = identities.join(renames.withColumnRenamed("name", "_name"), "canonical_id", "left").select("canonical_id", F.coalesce("_name", "display_name").alias("display_name"), "aliases", "sources")
    return old.unionByName(new), threads
