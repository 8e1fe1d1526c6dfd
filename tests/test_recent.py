"""Conditions on a stream's recent events, holds, rule changes and snapshots, against the batch forms; how often state is read."""

import json
import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from helpers import events
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.operators import conditions as C
from eventweir.operators import contexts as X
from eventweir.streaming import streams

COLUMNS = ["id", "name", "host", "creation", "arrival"]
LATE = 4000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def batch(spark):
    rng = random.Random(21)
    rows = [{"id": f"{k:03}", "name": rng.choice("ABC"), "host": rng.choice("xyz"), "arrival": t, "creation": t - rng.randrange(-3, 40)} for k, t in enumerate(sorted(rng.randrange(1, 2000) for _ in range(150)))]
    rows.append({"id": "end", "name": "END", "host": "end", "arrival": 10**6, "creation": 10**6})
    return events(spark, rows).select(*COLUMNS).persist()


@pytest.fixture(scope="module")
def stream(spark, batch, tmp_path_factory):
    """Three files with rows from the whole log each, then one that moves the watermark."""
    path = str(tmp_path_factory.mktemp("recent") / "events")
    for k in range(3):
        batch.where((F.crc32(F.col("id")) % 3 == k) & (F.col("name") != "END")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    batch.where("name = 'END'").coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(spark, df, tmp_path):
    streams.run_available(df, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def told(df, *columns):
    return sorted(tuple(r) for r in df.where("id <> 'end'").select("id", *columns).collect())


def queries():
    return [P.event_name(n) for n in "ABC"]


@pytest.mark.parametrize(("match", "source"), [("any", "arrival"), ("all", "creation")])
def test_sequences_and_closeness(spark, stream, batch, tmp_path, match, source):
    got = ran(spark, streams.sequences(stream(), queries(), "host", 200, LATE, match, source=source, skew=3), tmp_path / "s")
    assert told(got, "hit") == told(C.sequence_two_axes(batch, queries(), ["host"], 200, match, source=source, skew=3), "hit")
    got = ran(spark, streams.closeness(stream(), queries(), "host", 200, 190, LATE, match, source=source, skew=3), tmp_path / "w")
    want = told(C.within_two_axes(batch, queries(), ["host"], 200, 190, match, source=source, skew=3), "hit")
    assert told(got, "hit") == want and any(hit for _, hit in want)


def test_patterns(spark, stream, batch, tmp_path):
    alphabet = [("a", P.event_name("A")), ("b", P.event_name("B"))]
    got = ran(spark, streams.patterns(stream(), alphabet, "ab+a", "host", 300, LATE), tmp_path)
    want = told(C.pattern_dfa(batch, alphabet, "ab+a", ["host"], 300), "matched")
    assert told(got, "matched") == want and any(hit for _, hit in want)


def test_whole_events(spark, stream, batch, tmp_path):
    got = ran(spark, streams.seen_events(stream(), P.event_name("A"), "host", 150, LATE, ["id", "creation"], P.event_name("B")), tmp_path)
    rows = batch.collect()
    want = {t.id: sorted((r.id, r.creation) for r in rows if r.name == "A" and r.host == t.host and t.arrival - 150 <= r.arrival <= t.arrival) for t in rows if t.name == "B"}
    assert {r["id"]: sorted((e["id"], e["creation"]) for e in r["events"]) for r in got.collect()} == want


def test_holds(spark, stream, batch, tmp_path):
    """Events that contexts hold leave when the last of them has ended, by timeout or deletion, or when the delay has passed."""
    name = F.col("name")
    ended = ran(spark, streams.contexts(stream(), "host", 90, LATE, opening=name == "A", joins=name != "C", deletes=(name == "C") & (F.crc32(F.col("id")) % 2 == 0), joined=True), tmp_path / "contexts")
    changes = streams.hold_changes(ended).persist()
    # the same intervals, and some made ones that overlap and touch
    rng = random.Random(2)
    more = [(r.id, r.arrival + b, r.arrival + b + n, f"m{k}") for k, r in enumerate(batch.where("id <> 'end'").collect()) for b, n in [(rng.choice([0, 5, 10, 30]), rng.choice([5, 20, 200])) for _ in range(rng.randrange(3))]]
    more = spark.createDataFrame(more, "id string, begin long, end long, context string").withColumn("context", F.concat("context", F.lit("/"), "begin", F.lit("/"), "end")).distinct()
    moves = more.select("id", F.col("begin").alias("arrival"), F.lit("begin").alias("kind"), "context").union(more.select("id", "end", F.lit("end"), "context"))
    every = changes.unionByName(moves)
    path = str(tmp_path / "changes")
    every.coalesce(1).write.parquet(path)
    delayed = stream().withColumn("delay_time", F.col("arrival") + F.crc32("id") % 60)
    got = ran(spark, streams.forwarded_by_holds(delayed, spark.readStream.schema(every.schema).parquet(path), LATE), tmp_path / "out")
    begins = every.where("kind = 'begin'").select("id", "context", F.col("arrival").alias("begin"))
    holds = begins.join(every.where("kind = 'end'").select("id", "context", F.col("arrival").alias("end")), ["id", "context"])
    want = streams.released_at(batch.withColumn("delay_time", F.col("arrival") + F.crc32("id") % 60), holds)
    assert told(got, "released") == told(want, "released")
    later = want.join(batch, "id").where(F.col("released") > F.col("arrival") + 60)
    assert later.count() > 10


def test_rules_change_while_the_stream_runs(spark, tmp_path):
    """A change for one group ends its contexts at its next event; the other group's go on. It is added while the stream runs."""
    path, control = tmp_path / "in", tmp_path / "control"
    control.mkdir()
    (control / "0.json").write_text(json.dumps({"group": "x", "version": "v1", "since": 0}) + "\n")
    parts = [[("1", "x", 100), ("2", "y", 100)], [("3", "x", 300), ("4", "y", 300)], [("5", "x", 500), ("6", "y", 500)], [("e", "end", 10**6)], [("f", "end", 2 * 10**6)]]
    for rows in parts:
        events(spark, [{"id": i, "host": h, "arrival": t, "creation": t} for i, h, t in rows]).select(*COLUMNS).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    source = spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    rows = streams.with_rules(source, f"file://{control}", F.col("host"))
    ended = []

    def sink(df, number):
        ended.extend(df.collect())
        if number == 1:  # before the third file is read
            (control / "1.json").write_text(json.dumps({"group": "x", "version": "v2", "since": 400}) + "\n")

    streams.run_available(streams.contexts(rows, "host", 1000, 10, rules=F.col("rules")), sink, checkpoint=str(tmp_path / "check"))
    got = sorted((r["host"], r["start"], r["fires"], r["counter"], r["event_ids"], r["ended"], r["rules"]) for r in ended if r["host"] != "end")
    assert got == [("x", 100, 500, 2, ["1", "3"], "rules", "v1"), ("x", 500, 1501, 1, ["5"], "timeout", "v2"), ("y", 100, 1101, 3, ["2", "4", "6"], "timeout", "")]


def test_snapshot(spark, batch, stream, tmp_path):
    """Contexts that are open at the watermark and rows that wait for it, read from the checkpoint."""
    path, rows = str(tmp_path / "in"), batch.where("arrival < 1500")
    rows.coalesce(1).write.parquet(path)
    time.sleep(1.1)
    rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("now", "N", "now", 1500, 1500)], batch.schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(batch.schema).parquet(path)
    streams.run_available(streams.contexts(source, "host", 400, 0), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    watermark = 1500
    got = streams.snapshot(spark, str(tmp_path / "check"), watermark).where("key <> 'now'")
    done = spark.read.parquet(str(tmp_path / "out"))
    every = X.contexts(X.anchored(rows, ["host"], 400), ["host"], 400)
    want = every.join(done.select("host", "start"), ["host", "start"], "left_anti")
    assert sorted((r["key"], r["start"], r["counter"], r["event_ids"], r["stale"]) for r in got.collect()) == sorted((r["host"], r["start"], r["counter"], r["event_ids"], r["end"] + 1 <= watermark) for r in want.collect())
    assert want.count() == 3
    assert {r["second"] for r in streams.waiting(spark, str(tmp_path / "check")).collect()} <= {1500}


class Store:
    """State that counts how many rows are read from it."""

    def __init__(self):
        self.read, self.states, self.timers = 0, {}, set()

    def _of(self, name):
        return self.states.setdefault(name, {})

    def getMapState(self, name, *_):
        own = self._of(name)

        def value(k):
            self.read += len(own[k][0])
            return own[k]

        return SimpleNamespace(containsKey=lambda k: k in own, getValue=value, updateValue=own.__setitem__, removeKey=own.pop, keys=lambda: list(own))

    def getValueState(self, name, *_):
        own = self._of(name)
        return SimpleNamespace(exists=lambda: "v" in own, get=lambda: own["v"], update=lambda v: own.update(v=v), clear=own.clear)

    def getListState(self, name, *_):
        own = self._of(name)

        def get():
            self.read += len(own.get("l", []))
            return own["l"]

        return SimpleNamespace(exists=lambda: "l" in own, get=get, appendList=lambda x: own.setdefault("l", []).extend(x), put=lambda x: own.update(l=list(x)), clear=own.clear)

    def registerTimer(self, ms):
        self.timers.add(ms)


def state_rows_read(processor, row, n):
    """n rows of one key, a hundred a batch, the watermark following."""
    store = Store()
    processor.init(store)
    names = [f.name for f in processor.fields]
    for at in range(0, n, 100):
        frame = pd.DataFrame([row(k) for k in range(at, at + 100)], columns=names)
        list(processor.handleInputRows(("x",), iter([frame]), None))
        watermark = (at + 50) * 1000
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)  # noqa: B023
        for ms in sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(ms)
            list(processor.handleExpiredTimer(("x",), values, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))  # noqa: B023
    return store.read


@pytest.mark.parametrize("kind", ["recent", "contexts"])
def test_state_reads_are_linear(kind):
    from eventweir.operators import sweeps

    def counted(n):
        if kind == "recent":
            return state_rows_read(streams.Recent(60, 60, ["id", "host", "arrival", "n"], sweeps.Counted, [streams.StructField("_time", streams.LongType())]), lambda k: (k, str(k), k, True), n)
        made = streams.Contexts(10**9, ["version", "host", "start", "fires", "counter", "event_ids", "ended", "rules"], False, 0, False)
        return state_rows_read(made, lambda k: (k, str(k), True, True, False, False, False, "inc", 1, ""), n)

    few, many = counted(2000), counted(8000)
    assert many <= 4.2 * few and many <= 3 * 8000
