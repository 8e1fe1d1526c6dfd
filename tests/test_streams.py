"""Streams run to the end of what is there, against the batch forms."""

import random
import time

import pytest
from helpers import events
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.operators import conditions
from eventweir.operators import contexts as X
from eventweir.sources import writers
from eventweir.streaming import streams

COLUMNS = ["id", "name", "host", "status", "creation", "arrival"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [{"id": f"{k:03}", "name": rng.choice("ABC"), "host": rng.choice("xyz"), "creation": 0, "arrival": t} for k, t in enumerate(sorted(rng.randrange(1, 3000) for _ in range(120)))]
    rows.append({"id": "end", "name": "END", "host": "end", "arrival": 10**6})  # moves the watermark past all others
    df = events(spark, rows).select(*COLUMNS)
    path = str(tmp_path_factory.mktemp("stream") / "events")
    df.where("arrival < 1500").coalesce(1).write.parquet(path)
    df.where("arrival >= 1500 and name <> 'END'").coalesce(1).write.mode("append").parquet(path)
    df.where("name = 'END'").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def stream(spark, table):
    schema = spark.read.parquet(table).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(table)


@pytest.fixture()
def batch(spark, table):
    return spark.read.parquet(table)


def ran(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    streams.run_available(df, path=out, checkpoint=str(tmp_path / "check"), mode=mode)
    return spark.read.schema(df.schema).parquet(out)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).where("host <> 'end'").collect())


def test_tumbling_counts(spark, stream, batch, tmp_path):
    got = ran(spark, streams.tumbling(stream, P.event_name("A"), ["host"], 300, 3600), tmp_path)
    wanted = batch.groupBy("host", (F.floor(F.col("arrival") / 300) * 300).alias("start")).agg(F.count_if(F.col("name") == "A").alias("n"))
    assert rows(got, "host", "start", "n") == rows(wanted, "host", "start", "n")


def test_sessions(spark, stream, batch, tmp_path):
    got = ran(spark, streams.session_counts(stream, ["host"], 60, 3600), tmp_path)
    wanted = X.sessions(batch, ["host"], 60).groupBy("host", F.col("win_start").alias("start")).agg(F.count("*").alias("n"))
    assert rows(got, "host", "start", "n") == rows(wanted, "host", "start", "n")


def test_dedupe(spark, stream, batch, tmp_path):
    got = ran(spark, streams.deduped(stream.union(stream), 3600).select("id", "host"), tmp_path)
    assert rows(got, "id") == rows(batch.select("id", "host"), "id")


@pytest.fixture()
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def shuffled(spark, table, tmp_path_factory):
    """The same rows in files that each hold times from the whole log: a row may come after any other, up to 3000 seconds late."""
    df = spark.read.parquet(table)
    path = str(tmp_path_factory.mktemp("shuffled") / "events")
    for k in range(3):
        df.where((F.crc32(F.col("id")) % 3 == k) & (F.col("name") != "END")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    df.where("name = 'END'").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(params=["in order", "shuffled"])
def either(request, spark, table, shuffled):
    path = table if request.param == "in order" else shuffled
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_contexts(spark, either, batch, tmp_path, rocksdb):
    got = ran(spark, streams.contexts(either, "host", 100, 3600), tmp_path)
    wanted = X.contexts(X.anchored(batch, ["host"], 100), ["host"], 100).select("host", "start", (F.col("end") + 1).alias("fires"), "counter", F.array_join("event_ids", ",").alias("ids"))
    assert rows(got.withColumn("ids", F.array_join("event_ids", ",")), "host", "start", "fires", "counter", "ids") == rows(wanted, "host", "start", "fires", "counter", "ids")


def test_contexts_in_full(spark, either, batch, tmp_path, rocksdb):
    """Opening, counter operations, association with resets, restarts of the timer, deletion: against a plain loop over the sorted rows."""
    name = F.col("name")
    third = F.crc32(F.col("id")) % 3
    got = ran(spark, streams.contexts(either, "host", 90, 3600, opening=name == "A", op=F.when(name == "B", "set").when(name == "C", "dec").otherwise("inc"), value=F.when(name == "B", 10).otherwise(2), joins=name != "C", forgets=(name == "C") & (third == 0), restarts=(name == "B") & (third == 0), deletes=(name == "C") & (third == 1), initial=5), tmp_path)
    wanted = []
    by_host = {}
    for r in batch.withColumn("third", third).orderBy("arrival", "id").collect():
        by_host.setdefault(r["host"], []).append(r)
    for host, events_ in by_host.items():
        now = None
        for r in [*events_, None]:
            t = r["arrival"] if r else 10**9
            if now and t > now["timer"] + 90:
                wanted.append((host, now["start"], now["timer"] + 91, now["n"], ",".join(sorted(now["ids"])), "timeout"))
                now = None
            if r is None:
                break
            if now is None and r["name"] == "A":
                now = {"start": t, "timer": t, "n": 5, "ids": []}
            if now is None:
                continue
            if r["name"] == "C" and r["third"] == 1:
                wanted.append((host, now["start"], t, now["n"], ",".join(sorted(now["ids"])), "deleted"))
                now = None
                continue
            if r["name"] == "B" and r["third"] == 0:
                now["timer"] = t
            if r["name"] == "C" and r["third"] == 0:
                now["ids"] = []
            now["n"] = 10 if r["name"] == "B" else now["n"] - 2 if r["name"] == "C" else now["n"] + 2
            if r["name"] != "C":
                now["ids"].append(r["id"])
    found = got.withColumn("ids", F.array_join("event_ids", ","))
    assert rows(found, "host", "start", "fires", "counter", "ids", "ended") == sorted(w for w in wanted if w[0] != "end")
    deleted = got.where("ended = 'deleted'")
    assert deleted.count() > 0
    freed = streams.released(deleted, batch)
    assert sorted(r["id"] for r in freed.collect()) == sorted({i for w in wanted if w[5] == "deleted" and w[4] for i in w[4].split(",")})


def test_repeating_contexts(spark, either, batch, tmp_path, rocksdb):
    got = ran(spark, streams.contexts(either, "host", 100, 3600, repeat=True), tmp_path)
    wanted = X.repeating(batch, ["host"], 100).groupBy("host", F.col("win_start").alias("start")).agg(F.count("*").alias("counter"))
    assert rows(got, "host", "start", "counter") == rows(wanted, "host", "start", "counter")


def test_rule_change(spark, stream, batch, tmp_path, rocksdb):
    """A stream restarted from its checkpoint keeps open contexts if its version stayed, and begins without any if it changed."""
    path, one = str(tmp_path / "in"), str(tmp_path / "check")
    write = lambda rows_: events(spark, rows_).select(*COLUMNS).coalesce(1).write.mode("append").parquet(path)
    schema = batch.schema
    run = lambda version, out: streams.run_available(streams.contexts(spark.readStream.schema(schema).parquet(path), "host", 1000, 10, version=version), path=str(tmp_path / out), checkpoint=one)
    write([{"id": "1", "name": "A", "host": "x", "arrival": 100}, {"id": "2", "name": "A", "host": "y", "arrival": 200}])
    run("v1", "first")
    write([{"id": "3", "name": "A", "host": "x", "arrival": 300}])
    run("v1", "second")
    write([{"id": "4", "name": "A", "host": "x", "arrival": 400}, {"id": "e", "name": "END", "host": "end", "arrival": 10**6}])
    run("v2", "third")
    write([{"id": "f", "name": "END", "host": "end", "arrival": 2 * 10**6}])
    run("v2", "fourth")
    ended = spark.read.parquet(str(tmp_path / "third"), str(tmp_path / "fourth")).where("host <> 'end'").collect()
    assert [(r["host"], r["start"], r["event_ids"]) for r in ended] == [("x", 400, ["4"])]


def test_sliding_counts(spark, either, batch, tmp_path, rocksdb):
    got = ran(spark, streams.sliding_counts(either, P.event_name("A"), "host", 200, 3600), tmp_path)
    wanted = conditions.count_sliding(batch, P.event_name("A"), ["host"], 200)
    assert rows(got, "id", "n") == rows(wanted.select("id", "n", "host"), "id", "n")


def test_drain(spark, batch, tmp_path):
    """Rows that the watermark has not passed at the end are flushed from the batch form."""
    done = batch.where("arrival < 1500").select("id")
    assert streams.drained(batch, done, ["id"]).count() == batch.where("arrival >= 1500").count() > 0


def test_forwarding(spark, stream, batch, tmp_path):
    got = ran(spark, streams.forwarded(stream.withColumn("delay_time", F.col("arrival") + 50), 10), tmp_path)
    assert rows(got, "id", "delay_time") == rows(batch.withColumn("delay_time", F.col("arrival") + 50), "id", "delay_time")


def test_followed(spark, stream, batch, tmp_path):
    opening, closing = stream.where(P.event_name("A") | P.event_name("END")), stream.where(P.event_name("B") | P.event_name("END"))
    got = ran(spark, streams.followed(opening, closing, ["host"], 100, 10), tmp_path)
    wanted = X.missing_followup(batch, P.event_name("A"), P.event_name("B"), ["host"], 100)
    assert rows(got.where("closing_id is null").select("id", "host"), "id") == rows(wanted, "id")


def test_several_sinks_and_late_rows(spark, stream, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "late")

    def late(df, number):
        streams.split_late(df, 1000)[1].write.mode("append").parquet(second)

    streams.run_available(stream, writers.fan_out([lambda df, k: df.write.mode("append").parquet(first), late]), checkpoint=str(tmp_path / "check"))
    assert spark.read.parquet(first).count() == 121
    assert spark.read.parquet(second).where("arrival >= 1000").count() == 0 < spark.read.parquet(second).count()


def test_late_rows_by_the_streams_own_mark(spark, shuffled, tmp_path):
    """The mark follows the batches; a batch that is run again is split alike, and every row is in one of the parts."""
    rows, parts, seen = spark.read.parquet(shuffled), [], []

    def sink(in_time, late, number):
        parts.append((number, [r["arrival"] for r in in_time.select("arrival").collect()], [r["arrival"] for r in late.select("arrival").collect()]))

    splitter = streams.LateRows(str(tmp_path / "marks"), 500, sink)

    def both(df, number):
        splitter(df, number)
        if number == 1:
            splitter(df, number)
            assert [sorted(x) for x in parts.pop()[1:]] == [sorted(x) for x in parts[-1][1:]]

    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(shuffled)
    streams.run_available(source, both, checkpoint=str(tmp_path / "check"))
    for number, in_time, late in sorted(parts):
        mark = max(seen, default=None)
        assert all(mark is not None and t < mark - 500 for t in late) and all(mark is None or t >= mark - 500 for t in in_time)
        seen += in_time + late
    assert len(seen) == rows.count() and any(late for _, _, late in parts)
    streams.LateRows(str(tmp_path / "none"), 1, lambda a, b, n: parts.append((a.count(), b.count())))(rows.limit(0), 0)
    assert parts[-1] == (0, 0)
