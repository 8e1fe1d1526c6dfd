import itertools
import random

import pytest
from helpers import events
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.operators import actions, conditions, horizons, joins
from eventweir.operators import contexts as X


def host(h):
    return P.event_host(h)


def test_count(spark):
    df = events(spark, [{"id": str(k), "host": "test" if k < 10 else "other"} for k in range(20)]).withColumn("key", F.lit(0))
    holds = lambda n, op: conditions.count_by(df, host("test"), ["key"], n, op).first()["hit"]
    assert [holds(*x) for x in ((10, "eq"), (11, "eq"), (9, "ge"), (10, "ge"), (11, "ge"), (9, "le"), (10, "le"), (11, "le"))] == [True, False, True, True, False, False, True, True]
    with pytest.raises(ValueError):
        holds(1, "gt")


def test_sequences(spark):
    df = events(spark, [{"id": str(k), "host": h, "creation": c, "arrival": a} for k, (h, c, a) in enumerate([("A", 1, 1), ("B", 2, 1), ("B", 3, 1), ("C", 2, 2), ("C", 3, 2)])]).withColumn("key", F.lit(0))

    def any_(hosts, time):
        rows = conditions.sequence_any_sliding(df, [host(h) for h in hosts], ["key"], 100, time)
        return rows.agg(F.max_by("hit", time)).first()[0]

    every = lambda hosts, time: conditions.sequence_all_by(df, [host(h) for h in hosts], ["key"], time).first()["hit"]
    assert [any_(h, "creation") for h in ("AB", "ABC", "BC")] == [True, True, True]
    assert [every(h, "creation") for h in ("AB", "ABC", "BC")] == [True, False, False]
    assert [any_(h, "arrival") for h in ("AB", "BC")] == [False, True]
    assert [every(h, "arrival") for h in ("AB", "BC")] == [False, True]
    assert any_("", "creation") and every("", "creation") and not every("AX", "creation")


def test_alphabet(spark):
    rows = [("A", "A", 1, 6), ("B", "A", 2, 5), ("B", "A", 3, 4), ("B", "C", 4, 3), ("C", "C", 5, 2), ("C", "E", 5, 2)]
    df = events(spark, [{"id": str(k), "name": n, "host": h, "creation": c, "arrival": a} for k, (n, h, c, a) in enumerate(rows)]).withColumn("key", F.lit(0))
    name = P.event_name
    alphabet = [("f", name("A")), ("o", name("B") & host("A")), ("b", name("B")), ("a", name("C") & host("C")), ("r", name("C"))]
    got = lambda time: conditions.pattern_by(df, alphabet, "foo", ["key"], time).first()
    assert (got("creation")["symbols"], got("creation")["matched"]) == ("foobar", True)
    assert (got("arrival")["symbols"], got("arrival")["matched"]) == ("arboof", False)


@pytest.mark.parametrize(
    "lists, timeframe, expected_all, expected_any",
    [([[], [0, 1, 10]], 100, False, False), ([[0, 1, 10], [1, 10, 20], [15]], 20, True, True), ([[0, 1, 10], [1, 10, 20], [15]], 19, False, True), ([[0, 1, 10], [1, 10, 20], [15]], 5, False, True), ([[50]], 0, True, True), ([[50], [51]], 0, False, False), ([[50], [51]], 1, True, True),
     ([[1], [1, 2]], 0, False, True), ([[4], [10], [5], [-10, -20]], 20, False, True), ([[4], [10], [5], [-10, -20]], 19, False, False)],
)
def test_within(spark, lists, timeframe, expected_all, expected_any):
    rows = [{"id": f"{k}-{t}", "host": f"q{k}", "creation": t} for k, times in enumerate(lists) for t in times]
    df = events(spark, rows).withColumn("key", F.lit(0))
    queries = [host(f"q{k}") for k in range(len(lists))]
    assert conditions.within_all_by(df, queries, ["key"], timeframe).first()["hit"] == expected_all
    assert conditions.within_any_by(df, queries, ["key"], timeframe).first()["hit"] == expected_any


def random_events(spark, seed, n=60, span=90):
    rng = random.Random(seed)
    return [{"id": f"{k:03}", "name": rng.choice("ABC"), "host": rng.choice("xy"), "creation": (t := rng.randrange(span)), "arrival": t} for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_sliding_forms_equal_brute_force(spark, seed):
    age = 7
    rows = random_events(spark, seed)
    df = events(spark, rows)
    frame = lambda r: [x for x in rows if x["host"] == r["host"] and r["arrival"] - age <= x["arrival"] <= r["arrival"]]
    name = P.event_name
    out = conditions.count_sliding(df, name("A"), ["host"], age)
    out = conditions.sequence_any_sliding(out, [name("A"), name("B"), name("C")], ["host"], age, name="seq")
    out = conditions.within_any_sliding(out, [name("A"), name("B"), name("C")], ["host"], age, "arrival", "near")
    out = conditions.pattern_sliding(out, [("a", name("A")), ("b", name("B"))], "ab", ["host"], age)
    got = {r["id"]: (r["n"], r["seq"], r["near"], r["symbols"]) for r in out.collect()}
    for r in rows:
        seen = frame(r)
        of = lambda n: [x["arrival"] for x in seen if x["name"] == n]
        seq = any(a < b < c for a, b, c in itertools.product(of("A"), of("B"), of("C")))
        near = any(max(x) - min(x) <= age for x in itertools.product(of("A"), of("B"), of("C")))
        symbols = "".join(x["name"].lower() for x in sorted(seen, key=lambda x: (x["arrival"], "AB".find(x["name"]), x["id"])) if x["name"] in "AB")
        assert got[r["id"]] == (len(of("A")), seq, near, symbols), r


def windows(df):
    return [(r["arrival"], r["win_seq"]) for r in df.orderBy("arrival").collect()]


def at(spark, times):
    return events(spark, [{"id": str(k), "arrival": t, "creation": t} for k, t in enumerate(times)])


def test_window_edges(spark):
    assert windows(X.anchored(at(spark, [0, 10, 11, 21, 22]), ["host"], 10)) == [(0, 0), (10, 0), (11, 1), (21, 1), (22, 2)]
    assert windows(X.repeating(at(spark, [0, 10, 11, 22]), ["host"], 10)) == [(0, 0), (10, 0), (11, 1), (22, 2)]
    assert windows(X.sessions(at(spark, [0, 10, 21]), ["host"], 10)) == [(0, 0), (10, 0), (21, 1)]
    assert X.anchored(at(spark, [0]).limit(0), ["host"], 10).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_anchored_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    timeout = rng.choice([0, 3, 10])
    rows = [{"id": str(k), "host": rng.choice("xyz"), "arrival": rng.randrange(400)} for k in range(300)]
    got = {r["id"]: (r["win_seq"], r["win_start"]) for r in X.anchored(events(spark, rows), ["host"], timeout).collect()}
    for h in "xyz":
        start, seq = None, -1
        for r in sorted((r for r in rows if r["host"] == h), key=lambda r: r["arrival"]):
            if start is None or r["arrival"] > start + timeout:
                start, seq = r["arrival"], seq + 1
            assert got[r["id"]] == (seq, start)


def test_timeout_event(spark):
    opened = X.contexts(X.anchored(at(spark, [0, 3, 7]), ["host"], 10), ["host"], 10)
    row = X.timeouts(opened.withColumnRenamed("host", "key"), ["key"], "CE:TIMEOUT").first()
    assert (row["type"], row["creation"], row["references"]["child"], row["attributes"]["context_counter"]) == ("timeout", 11, ["0", "1", "2"], "3")


@pytest.mark.parametrize("closed, expected", [(10, 0), (11, 1)])
def test_closed_in_time(spark, closed, expected):
    df = events(spark, [{"id": "up", "name": "DOWN", "arrival": 0}, {"id": "x", "name": "UP", "arrival": closed}])
    assert X.missing_followup(df, P.event_name("DOWN"), P.event_name("UP"), ["host"], 10).count() == expected


def test_counter(spark):
    rows = at(spark, [1, 2, 3, 4, 5]).withColumn("op", F.element_at(F.array(*map(F.lit, ["inc", "inc", "set", "dec", "none"])), F.col("arrival").cast("int")))
    out = X.counter(rows, ["host"], F.col("op"), F.when(F.col("op") == "set", 10).otherwise(1), initial=5)
    assert [r["counter"] for r in out.orderBy("arrival").collect()] == [6, 7, 10, 9, 9]


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_counter_in_blocks(spark, width):
    """The blocks that a key is counted in do not show, nor do null keys, null operations, ties and rows without a time."""
    rng = random.Random(width)
    rows = [(f"{k:03}", rng.choice(["x", "x", None]), rng.randrange(300), rng.choice(["inc", "inc", "dec", "set", None]), rng.choice([1, 2, 9])) for k in range(250)]
    df = spark.createDataFrame(rows, "id string, host string, arrival long, op string, v long")
    got = {r["id"]: r["counter"] for r in X.counter(df, ["host"], F.col("op"), F.col("v"), initial=3, width=width).collect()}
    want, now = {}, {}
    for i, host, _, op, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before = now.get(host, 3)
        now[host] = want[i] = v if op == "set" else before + v if op == "inc" else before - v if op == "dec" else before
    assert got == want


@pytest.mark.parametrize("source", ["arrival", "creation"])
def test_interval_join_equals_all_pairs(spark, source):
    rng = random.Random(5)
    rows = [{"id": str(k), "host": rng.choice("xy"), "arrival": (t := rng.randrange(200)), "creation": t - rng.randrange(10)} for k in range(80)]
    df = events(spark, rows)
    for age in (0, 5, 30):
        got = {(r["trigger_id"], r["id"]) for r in joins.select_events(df, df, ["host"], age, source).collect()}
        assert got == {(a["id"], b["id"]) for a in rows for b in rows if a["host"] == b["host"] and b["arrival"] <= a["arrival"] <= b[source] + age}


def test_horizon(spark):
    df = events(spark, [{"id": "e", "creation": 90, "arrival": 100}])
    row = horizons.delay_and_cache_time(df, [horizons.Horizon("r", "d", F.lit(True), 5, delay=True), horizons.Horizon("r", "c", F.lit(True), 3)]).first()
    assert (row["delay_time"], row["cache_time"]) == (105, 105)


def test_occupancy(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (7200, 7300)], "arrival long, cache_time long")
    assert [tuple(r) for r in horizons.occupancy(df).orderBy("at").collect()] == [(0, 1), (5, 2), (11, 0), (7200, 1), (7301, 0)]


def test_compress(spark):
    rows = [
        {"id": "1", "host": "x", "status": "active", "creation": 5, "arrival": 9, "attributes": {"same": "s", "differs": "1", "once": "o"}},
        {"id": "2", "host": "y", "status": "inactive", "type": "compressed", "count": 4, "creation": 3, "arrival": 10, "attributes": {"same": "s", "differs": "2"}},
        {"id": "3", "name": "B", "host": "z"},
    ]
    out = {r["name"]: r for r in actions.compress(events(spark, rows), ["name"], ["same", "differs", "once"]).collect()}
    a = out["A"]
    assert (a["host"], a["status"], a["type"], a["count"], a["creation"], a["arrival"]) == ("engine", "active", "compressed", 5, 3, 9)
    assert a["attributes"] == {"same": "s", "differs": "[multiple values]", "once": "o"}
    assert (out["B"]["id"], out["B"]["type"], out["B"]["count"], out["B"]["host"]) == ("3", "raw", None, "z")


def test_tree(spark):
    edges = spark.createDataFrame([(str(k), str(k - 1)) for k in range(1, 40)], "id string, ref_id string")
    got = {r["id"]: (r["depth"], r["root"]) for r in joins.depths(edges).collect()}
    assert got == {str(k): (k, "0") for k in range(40)}
