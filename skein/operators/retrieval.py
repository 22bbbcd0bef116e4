"""Retrieval tools (M rows) and guarded read-only SQL."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.local_time import formatted, local_time
from ..functions.text import contains_like, is_handle, preview, redacted, row_redacted, word_match
from .aggregates import stride
from .identity import with_links


def search_messages(messages: DataFrame, query: str, *, source: str | None = None, after: int | None = None, before: int | None = None, threads: list[str] | None = None, limit: int = 50, match: str = "word", redactions: tuple[str, ...] = (), over_fetch: bool = False) -> DataFrame:
    """M-02: newest messages that match; redaction, then the word filter, then the limit.

    With over_fetch the word filter sees only the newest min(5 * limit, 500) candidates, as the tool it
    stands for does, so that it may return fewer than `limit` although there are more.
    """
    m = messages.where(contains_like(F.col("body"), query))
    if source:
        m = m.where(F.col("source") == source)
    if after is not None:
        m = m.where(F.col("ts") >= after)
    if before is not None:
        m = m.where(F.col("ts") < before)
    if threads:
        m = m.where(F.col("thread_id").isin(threads))
    order = (F.col("ts").desc(), F.col("id"))
    if over_fetch:
        m = m.orderBy(*order).limit(min(5 * limit, 500))
    m = m.where(~redacted([F.col("body"), F.col("sender_name")], redactions))
    if match == "word":
        m = m.where(word_match(F.col("body"), query))
    text, cut = preview(F.col("body"))
    return m.orderBy(*order).limit(limit).select("id", "ts", "thread_id", "sender_name", text.alias("body"), cut.alias("body_truncated"))


def conversation(messages: DataFrame, thread: str, around: int, before: int = 20, after: int = 20) -> DataFrame:
    """M-03."""
    from .aggregates import around as window

    return window(messages.where(F.col("thread_id") == thread), "ts", around, before, after, "id")


def person_summary(messages: DataFrame, thread_identity: DataFrame, identities: DataFrame, rules: DataFrame, merges: DataFrame, portraits: DataFrame) -> DataFrame:
    """M-04 for every person: messages, first and last (in their local time too), sources and threads, same_as ids, and whether there's a portrait.

    merges(winner_name, loser_name) are proposed pairs, portraits(name) the names that have one.
    """
    s = messages.join(thread_identity, "thread_id").groupBy("canonical_id").agg(
        F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("source").alias("sources"), F.count_distinct("thread_id").alias("threads")
    )
    for end in ("first", "last"):
        s = local_time(s, f"{end}_ts", "canonical_id", rules).withColumn(f"{end}_local", formatted(f"{end}_ts")).drop("zone", "zone_label", "local")
    named = s.join(identities.select("canonical_id", "display_name"), "canonical_id")
    return with_links(named, identities, merges, portraits)


def strip_sql(sql: str) -> str:
    """SQL without comments; quoted text stays."""
    token = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/"
    return re.sub(token, lambda m: " " if m[0].startswith(("--", "/*")) else m[0], sql, flags=re.S)


def statements(sql: str) -> list[str]:
    """Statements of a script, split at semicolons outside quotes."""
    parts = re.findall(r"(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[^;'\"`])+", strip_sql(sql))
    return [p.strip() for p in parts if p.strip()]


#: Leaves of an analysed plan that read nothing, besides registered views.
_EMPTY = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
#: Expressions that call any class by name.
_REFLECTING = {"CallMethodViaReflection", "TryReflect"}


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def refuse_others(plan) -> None:
    """ValueError unless an analysed plan, its subqueries included, reads registered views only and calls no class by name."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        if plan.isTempView():
            return
        raise ValueError("only registered views may be read")
    if "Command" in kind:
        raise ValueError("commands are not allowed")
    parts = [*_each(plan.children())]
    if not parts and kind not in _EMPTY:
        raise ValueError(f"only registered views may be read, not {kind}")
    found = [*_each(plan.expressions())]
    while found:
        x = found.pop()
        if x.getClass().getSimpleName() in _REFLECTING:
            raise ValueError("classes may not be called")
        found += _each(x.children())
    for p in [*parts, *_each(plan.subqueries())]:
        refuse_others(p)


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of one guarded statement over registered views."""
    df = spark.sql(guard(sql))
    refuse_others(df._jdf.queryExecution().analyzed())
    return df


def guard(sql: str) -> str:
    """M-10: the one read-only statement of `sql`, or ValueError."""
    found = statements(sql)
    if len(found) != 1:
        raise ValueError("exactly one statement is allowed")
    first = re.match(r"[(\s]*([A-Za-z]+)", found[0])
    if not first or first[1].upper() not in ("SELECT", "WITH"):
        raise ValueError("only SELECT or WITH is allowed")
    return found[0]


def query(spark: SparkSession, sql: str, limit: int = 200, redactions: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """M-06: rows of a guarded statement, redacted, and whether more than `limit` were left out."""
    df = read_only(spark, sql)
    if redactions:
        df = df.where(~row_redacted(redactions))
    more = df.limit(min(limit, 1000) + 1).count() > min(limit, 1000)
    return df.limit(min(limit, 1000)), more


def safe_select(spark: SparkSession, sql: str, limit: int = 200) -> DataFrame:
    """M-11: a statement written by others: fences off, registered views only, wrapped in a limit."""
    text = guard(re.sub(r"^\s*```(?:sql)?|```\s*$", "", sql.strip(), flags=re.I))
    return read_only(spark, f"SELECT * FROM ({text}) LIMIT {int(limit)}")


def schema(spark: SparkSession) -> DataFrame:
    """M-07: columns of the registered views."""
    rows = [(t.name, ", ".join(f"{c.name}:{c.dataType}" for c in spark.catalog.listColumns(t.name))) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table string, columns string")


def thread_window(messages: DataFrame, ids: list[str], patterns: list[str], start: int, end: int) -> DataFrame:
    """M-12: messages of the named or LIKE-matched threads in [start, end)."""
    hit = F.col("thread_id").isin(ids)
    for p in patterns:
        hit = hit | F.col("thread_id").like(p)
    return messages.where(hit & (F.col("ts") >= start) & (F.col("ts") < end)).orderBy("ts", "id")


def on_this_day(messages: DataFrame, rules: DataFrame, month: int, day: int, now: int, per_year: int = 8, me: str = "me", redactions: tuple[str, ...] = ()) -> DataFrame:
    """M-05/A-31: of each former year's month and day, in the rememberer's local time: how many messages, with whom most, and samples.

    messages(id, ts, from_me, sender_name, body, thread_id, canonical_id, display_name, two_way) are meaningful ones; canonical_id
    is null where a thread has no person, two_way says that the rememberer ever wrote there. Samples come from the best tier that
    has any: two-way with a named person, two-way with a person, with a person, all; every n-th by time. A band of a day on
    either side in UTC is filtered before local time is looked up. Redacted messages don't count.
    """
    at = F.timestamp_millis("ts")
    days = [(datetime.date(2020, month, day) + datetime.timedelta(k)).strftime("%m-%d") for k in (-1, 0, 1)]  # a leap year
    near = messages.where(F.date_format(at, "MM-dd").isin(days) & ~redacted([F.col("body"), F.col("sender_name")], redactions))
    here = local_time(near.withColumn("_me", F.lit(me)), "ts", "_me", rules).withColumn("_now", F.lit(now))
    here = local_time(here.withColumnsRenamed({"local": "then", "zone": "_z", "zone_label": "_l"}), "_now", "_me", rules)
    m = here.where((F.month("then") == month) & (F.dayofmonth("then") == day) & (F.year("then") != F.year("local"))).withColumn("year", F.year("then"))
    m = m.drop("zone", "zone_label", "local").withColumnsRenamed({"then": "local", "_z": "zone", "_l": "zone_label"}).withColumn("local_time", formatted("ts")).drop("zone", "zone_label", "local", "_now", "_me")
    person = F.coalesce("canonical_id", "thread_id")
    with_whom = m.groupBy("year", person.alias("who")).agg(F.count("*").alias("n"), F.min(F.coalesce("display_name", "thread_id")).alias("name"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.col("n").desc(), "who"))
    five = with_whom.withColumn("_r", place).withColumn("all", F.sum("n").over(Window.partitionBy("year"))).where("_r <= 5")
    entry = F.struct("_r", F.concat(F.col("name"), F.lit(" "), F.col("n").cast("string")).alias("text"))
    top = five.groupBy("year").agg(F.max("all").alias("message_count"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "; ").alias("top_people"))
    known = F.col("canonical_id").isNotNull()
    tier = F.when(F.col("two_way") & known & ~is_handle(F.coalesce("display_name", F.lit(""))), 0).when(F.col("two_way") & known, 1).when(known, 2).otherwise(3)
    best = m.withColumn("tier", tier).withColumn("_t", F.min("tier").over(Window.partitionBy("year"))).where("tier = _t")
    shown = stride(best, ["year"], ["ts", "id"], per_year)
    return shown.join(top, "year").select("year", "message_count", "top_people", "tier", "id", "local_time", F.when(F.col("from_me"), "ME").otherwise("THEM").alias("speaker"), "thread_id", F.substring(F.coalesce("body", F.lit("")), 1, 300).alias("body"))
