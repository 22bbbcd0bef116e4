import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.streaming import spool

HOUR, DAY = 3_600_000, 86_400_000
T0 = 1_704_067_200_000
ROWS = [(f"m{i}", f"t{i % 2}", T0 + i * 5 * HOUR, True, "Bo", "x") for i in range(20)] + [("m3", "t1", T0 + 15 * HOUR, True, "Bo", "x")]


@pytest.fixture
def folder(tmp_path):
    names = [c.split(" ")[0] for c in spool.MESSAGE.split(", ")]
    for k in range(3):
        (tmp_path / f"d{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in ROWS[k::3]))
    return str(tmp_path)


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_dedupe_and_floor(spark, folder):
    s = spool.read_spool(spark, folder, files=1)
    floors = spark.createDataFrame([("t1", T0 + 50 * HOUR)], "thread_id string, floor long")
    got = drained(spark, spool.deduped(spool.above_floor(s, floors), "30 days"), "deduped")
    want = {r[0] for r in ROWS if r[1] == "t0" or r[2] > T0 + 50 * HOUR}
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_windows_agree_with_batch(spark, folder):
    got = drained(spark, spool.counts(spool.read_spool(spark, folder), delay="30 days"), "counted", "complete")
    batch = spark.createDataFrame(ROWS, spool.MESSAGE).groupBy(F.window(F.timestamp_millis("ts"), "1 day"), "thread_id").count()
    assert sorted(r["n"] for r in got.collect()) == sorted(r["count"] for r in batch.collect())


def test_sessions(spark, folder):
    got = drained(spark, spool.sessions(spool.read_spool(spark, folder), "10 hours", "30 days"), "sessioned", "complete")
    assert sorted((r["thread_id"], r["n"]) for r in got.collect()) == [("t0", 10), ("t1", 11)]


def test_outings_wait_for_late_photos(spark, tmp_path):
    batches = [[(T0, 1.0), (T0 + 2 * HOUR, 2.0)], [(T0 + 1000, 1.0)], [(T0 + 20 * HOUR, 2.0), (T0 + 20 * HOUR + 5, None)], [(T0 + 90 * DAY, 5.0)], [(T0 + 3 * HOUR, 1.0)]]  # the last is too late
    n = 0
    for k, rows in enumerate(batches):
        (tmp_path / f"p{k}.json").write_text("\n".join(json.dumps({"owner": "o", "id": f"p{n + j}", "ts": ts, "lat": lat, "lng": None if lat is None else 0.0}) for j, (ts, lat) in enumerate(rows)))
        os.utime(tmp_path / f"p{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        n += len(rows)
    s = spool.read_spool(spark, str(tmp_path), "owner string, id string, ts long, lat double, lng double", files=1)
    got = {r["id"]: r["outing"] - T0 for r in drained(spark, spool.outings(s), "outings").collect()}
    assert got == {"p0": 0, "p2": 0, "p1": 2 * HOUR, "p3": 20 * HOUR, "p4": 20 * HOUR}


def test_outings_ask_the_store_once_for_many_owners():
    from types import SimpleNamespace

    import pandas as pd

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendValue(self, v):
            self.calls += 1
            self.rows.append(v)

        def put(self, vs):
            self.calls += 1
            self.rows = list(vs)

        def update(self, v):
            self.put([v])

        def clear(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return self.rows if isinstance(self, Many) else self.rows[0]

    class Many(State):
        pass

    waiting, open_, timers = Many(), State(), set()
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: open_, listTimers=lambda: iter(sorted(timers)), deleteTimer=timers.discard, registerTimer=timers.add)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    o = spool.Outings(1.0, 6 * HOUR, HOUR)
    o.init(handle)
    rows = [(None if k == 7 else f"o{k}", f"p{k}-{j}", T0 + j * 4 * HOUR + (k % 3) * j * 2 * HOUR, 1.0 if j % 2 else None, 0.0) for j in range(9, -1, -1) for k in range(50)]
    list(o.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["owner", "id", "ts", "lat", "lng"])]), at(T0)))
    assert waiting.calls == 1 and timers == {T0 + 1}  # one call for 500 photos of 50 owners
    mid = T0 + 20 * HOUR
    got = pd.concat(o.handleExpiredTimer((0,), at(mid), None))
    assert open_.calls == 1 and len(got) == sum(r[2] < mid for r in rows) and min(timers) > mid
    got = pd.concat([got, *o.handleExpiredTimer((0,), at(T0 + 90 * DAY), None)])
    want = {}
    for k in range(50):
        start = last = None
        for _, id_, ts, *_ in sorted((r for r in rows if r[1].startswith(f"p{k}-")), key=lambda r: r[2]):
            start = ts if last is None or ts - last > 6 * HOUR else start
            want[id_], last = start, ts
    assert dict(zip(got["id"], got["outing"], strict=True)) == want and len(got) == 500
    assert not waiting.exists() and not open_.exists()  # owners without photos leave no state


def test_outings_agree_with_batch(spark):
    from skein.operators.happenings import cluster
    from skein.plans.catalog import QUERIES, Archive
    from skein.plans.q_streaming import _photos

    sf = "/root/testdata/sf0.001"
    a = Archive(spark, sf)
    batch = cluster(_photos(a, a.table("events")), least=1)
    want = {(r["owner"], r["id"]): r["outing"] for r in batch.withColumn("outing", F.min("ts").over(Window.partitionBy("owner", "session", "part"))).collect()}
    got = {(r["owner"], r["id"]): r["outing"] for r in QUERIES["q_t11_stream_outings"](spark, sf).collect()}
    assert got == want and len(set(want.values())) > 20


def test_ledger_survives_deaths(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ledger"))
    work = lambda d: d.select("id", F.length("body").alias("n"))
    rows = spark.createDataFrame(ROWS, spool.MESSAGE)
    ledger = spool.Ledger(spark, root)

    def dies():
        raise InterruptedError

    ledger.commit(rows.where("thread_id = 't0'"), "id", work)
    with pytest.raises(InterruptedError):
        ledger.commit(rows, "id", work, dies)
    assert ledger.results("id string, n int").count() == 10 and len(list(os.scandir(f"{root}/data"))) == 2
    for k in range(2):  # another checkpoint each time: nothing is done twice
        spool.resumable(spool.read_spool(spark, folder, files=1), "id", work, root, f"{root}/c{k}").awaitTermination()
        assert sorted(r["id"] for r in ledger.results("id string, n int").collect()) == sorted({r[0] for r in ROWS})


def test_sync_applies_each_batch_once(spark, folder, tmp_path_factory):
    seen, check = [], str(tmp_path_factory.mktemp("sync"))
    for _ in range(2):
        spool.sync(spool.read_spool(spark, folder), lambda df, n: seen.append(df.count()), check).awaitTermination()
    assert sum(seen) == len(ROWS)
