"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import meaningful
from ..operators import graph
from . import adapters
from .fragments import FRAGMENTS, NEEDS, ZONE_RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Archive(SimpleNamespace):
    """Tables by name: archive tables and derived ones, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark=spark, sf_dir=sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        derived = {
            "msgs": lambda: self.messages.withColumn("meaningful", meaningful(self.messages.body, self.messages.attachment_type)),
            "pm": lambda: self.msgs.join(self.thread_identity, "thread_id"),
            "membership": lambda: graph.group_membership(self.threads, self.identities, self.messages, self.thread_identity),
            "mention": lambda: graph.mentions(self.msgs, self.identities, self.thread_identity),
            "nodes": lambda: graph.ego_nodes(self.msgs, self.threads, self.thread_identity, self.identities, "id-0", least=30),
            "rules": lambda: self.spark.createDataFrame([r[:6] for r in ZONE_RULES], "rule int, canonical_id string, from_day string, to_day string, zone string, label string").selectExpr("rule", "canonical_id", "CAST(from_day AS DATE) AS from_day", "CAST(to_day AS DATE) AS to_day", "zone", "label"),
            "merges": lambda: self.identities.alias("a").join(self.identities.alias("b"), F.expr("b.n = a.n + 7")).selectExpr("a.display_name AS winner_name", "b.display_name AS loser_name"),
            "portraits": lambda: self.messages.where("contains(body, 'birthday')").selectExpr("sender_name AS name").distinct(),
            "ep": lambda: self.gatherings.selectExpr("event_id", "'p' || substr(event_id, 2) AS photo_id"),
        }
        value = derived[name]() if name in derived else adapters.archive(self.spark, self.sf_dir, name)[0]
        setattr(self, name, value)
        return value


def twin(sql: str, uses: tuple[str, ...], ints: tuple[str, ...] = ()) -> str:
    """SQL with the common table expressions that `uses` names, and what they need, ahead of it; `ints` become INT."""
    order: list[str] = []
    for name in uses:
        for n in (*NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    heads = [f"{n} AS ({FRAGMENTS[n] if n in FRAGMENTS else adapters.select(n, adapters.DUCK)})" for n in order]
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        sql = "WITH RECURSIVE " + ", ".join([*heads, sql[5:]])
    elif heads:
        sql = f"WITH RECURSIVE {', '.join(heads)} {sql}"
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in ints)}) FROM ({sql})" if ints else sql


def query(name: str, sql: str | None = None, uses: str = "", ints: str = ""):
    """Register f(archive) under `name`, with its SQL twin over the named tables."""

    def put(f: Callable[[Archive], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = twin(sql, tuple(uses.split()), tuple(ints.split()))
        return f

    return put


from . import q_aggregates, q_events, q_graph, q_identity, q_people, q_retrieval, q_sources, q_streaming, q_text  # noqa: E402,F401
