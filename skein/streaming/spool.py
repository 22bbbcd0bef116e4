"""Incremental ingestion of message spools with Structured Streaming (T rows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "id string, thread_id string, ts long, from_me boolean, sender_name string, body string"


def above_floor(messages: DataFrame, floors: DataFrame) -> DataFrame:
    """T-03: rows newer than their thread's floor(thread_id, floor); threads without one pass. Works on streams with static floors."""
    joined = messages.join(floors, "thread_id", "left")
    return joined.where(F.col("floor").isNull() | (F.col("ts") > F.col("floor"))).drop("floor")


def read_spool(spark: SparkSession, path: str, schema: str = MESSAGE, files: int | None = None, strict: bool = True) -> DataFrame:
    """T-01: a folder of JSON lines as a stream; malformed lines end the query when strict, else they're dropped."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path)


def deduped(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """T-02: each id once; state of ids older than the delay is given up."""
    return stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def counts(stream: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """T-06/T-07: messages by window and thread; late rows within the delay are counted."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return timed.groupBy(w.alias("w"), "thread_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "thread_id", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """T-05: sessions of a thread by inactivity; rows exactly one gap apart are one session."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "thread_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("thread_id", "n", "first_ts", "last_ts")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Outings(StatefulProcessor):
    """The photos of a bucket of owners in the order of their time, and the outings that are open.

    Photos wait until the watermark has passed them, so that late ones find their place; a timer at the first that waits takes them on.
    An outing is given up by a timer too, when nothing can join it any more: an owner without photos leaves no state.
    The state store is asked once for many owners: photos that came together wait as one value, and so do a bucket's open outings.
    """

    PHOTO = pa.schema([("owner", pa.string()), ("id", pa.string()), ("ts", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())])
    OPEN = pa.schema([("owner", pa.string()), ("start", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("n", pa.int64()), ("last", pa.int64())])

    def __init__(self, far_km: float, gap_ms: int, move_ms: int):
        self.far_km, self.gap_ms, self.move_ms = far_km, gap_ms, move_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "photos binary")
        self.open = handle.getValueState("open", "outings binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), []
        for new in rows:
            new = new[new.ts >= now]  # those before it are too late, and their neighbours gone
            if len(new):
                first.append(int(new.ts.min()) + 1)
                self.waiting.appendValue((_packed(pa.Table.from_pandas(new[self.PHOTO.names], self.PHOTO, preserve_index=False)),))
        timers = list(self.handle.listTimers())
        if first and not any(t <= min(first) for t in timers):
            self._wake(min(first), timers)
        return iter(())

    def _wake(self, at: int, instead: list[int]) -> None:
        for old in instead:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        from ..operators.happenings import _km

        now = timerValues.getCurrentWatermarkInMs()
        held = pa.concat_tables([self.PHOTO.empty_table(), *(_unpacked(r[0]) for r in self.waiting.get())])
        due, left = held.filter(pc.less(held["ts"], now)), held.filter(pc.greater_equal(held["ts"], now))
        open_ = {r[0]: r[1:] for r in zip(*_unpacked(self.open.get()[0]).to_pydict().values(), strict=True)} if self.open.exists() else {}
        photos: dict[str | None, list] = {}
        for owner, *photo in zip(*(due[c].to_pylist() for c in ("owner", "ts", "id", "lat", "lng")), strict=True):
            photos.setdefault(owner, []).append(photo)
        out: tuple[list, ...] = ([], [], [], [])
        for owner, mine in photos.items():
            start, lat, lng, n, last = open_.get(owner, (None, 0.0, 0.0, 0, None))
            mine.sort(key=lambda r: r[:2])
            for ts, _, a, b in mine:
                placed = a is not None and b is not None
                moved = placed and n and ts - last > self.move_ms and _km(lat / n, lng / n, a, b) > self.far_km
                if start is None or ts - last > self.gap_ms or moved:
                    start, lat, lng, n = ts, 0.0, 0.0, 0
                if placed:
                    lat, lng, n = lat + a, lng + b, n + 1
                last = ts
                out[3].append(start)
            open_[owner] = (start, lat, lng, n, last)
            out[0].extend([owner] * len(mine))
            out[1].extend(r[1] for r in mine)
            out[2].extend(r[0] for r in mine)
        self.waiting.put([(_packed(left),)]) if left.num_rows else self.waiting.clear()
        wait = set(left["owner"].to_pylist())
        kept = {owner: o for owner, o in open_.items() if owner in wait or now <= o[4] + self.gap_ms}
        wake = [o[4] + self.gap_ms + 1 for o in kept.values() if now <= o[4] + self.gap_ms] + ([pc.min(left["ts"]).as_py() + 1] if wait else [])
        if kept:
            self.open.update((_packed(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*((w, *o) for w, o in kept.items()), strict=True), self.OPEN.types, strict=True)], schema=self.OPEN)),))
        else:
            self.open.clear()
        if wake:
            self._wake(min(wake), list(self.handle.listTimers()))
        yield pd.DataFrame(dict(zip(("owner", "id", "ts", "outing"), out, strict=True)))

    def close(self) -> None:
        pass


def outings(stream: DataFrame, far_km: float = 1.0, gap_ms: int = 6 * 3_600_000, move_ms: int = 3_600_000, delay: str = "1 day", buckets: int = 1024) -> DataFrame:
    """T-11: photos(owner, id, ts, lat, lng) with the beginning of their outing, as E-01 tells outings apart, the mean position as state.

    A photo comes out when the watermark has passed it; what is later than the delay is dropped. Owners share the state of one of
    some `buckets` keys, as calls to the state store cost far more than the photos of one owner; more of them make smaller states.
    """
    from ..session import ship

    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what timers and lists need
    timed = stream.select("owner", "id", "ts", "lat", "lng", F.timestamp_millis("ts").alias("at")).withWatermark("at", delay)
    keyed = timed.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(buckets)))
    return keyed.groupBy("bucket").transformWithStateInPandas(Outings(far_km, gap_ms, move_ms), "owner string, id string, ts long, outing long", "Append", "EventTime")


class Ledger:
    """Results of a resumable extract, and which items they are of (T-08).

    A batch's results go to a folder of their own first; then its ledger entry, which names the folder and the items, is written. Only
    folders that a finished entry names count: what a run that died left behind is never read, and its items are still to do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _finished(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path(f"{self.root}/done/*/_SUCCESS"))
        return [f.getPath().getParent().getName() for f in found] if found else []

    def done(self) -> DataFrame:
        """key of every item that is done."""
        names = self._finished()
        return self.spark.read.parquet(*(f"{self.root}/done/{n}" for n in names)) if names else self.spark.createDataFrame([], "key string")

    def results(self, schema: str) -> DataFrame:
        names = self._finished()
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def commit(self, items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], before_marking: Callable[[], None] = lambda: None) -> None:
        """`work` on the items that aren't done yet, results before entry."""
        name = uuid.uuid4().hex
        todo = items.withColumn("_key", F.col(key).cast("string")).dropDuplicates(["_key"]).join(self.done().withColumnRenamed("key", "_key"), "_key", "left_anti").persist()
        try:
            work(todo.drop("_key")).write.parquet(f"{self.root}/data/{name}")
            before_marking()
            todo.select(F.col("_key").alias("key")).write.parquet(f"{self.root}/done/{name}")
        finally:
            todo.unpersist()


def resumable(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, before_marking: Callable[[], None] = lambda: None):
    """T-08: every item of a stream is worked on once, whatever run dies when, and whether or not the checkpoint is kept."""
    ledger = Ledger(stream.sparkSession, root)
    put = lambda items, _: ledger.commit(items, key, work, before_marking)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """T-10: each micro-batch of ops goes to `apply` once; progress is kept in the checkpoint folder."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
