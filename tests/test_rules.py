"""Rules that act on other events, against plain simulations, and the size of their plans."""

import random

import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.functions.schema import event_view
from eventweir.operators import contexts
from eventweir.plans import rules as R
from eventweir.queries.joins import ten

ANY = ("any",)


def simulated(rows, trigger, wanted, age):
    """The reference's way, event by event: a firing merges what it sees of a name; the result is seen in place of what it holds."""
    cache = [dict(r, parts=[r["id"]]) for r in rows if r["name"] in wanted]
    for t in sorted({(r["host"], r["arrival"]) for r in rows if r["name"] == trigger}, key=lambda x: x[1]):
        for name in wanted:
            seen = [e for e in cache if e["name"] == name and e["host"] == t[0] and e["arrival"] <= t[1] <= e["arrival"] + age and not e.get("forwarded")]
            if len(seen) > 1:
                for e in seen:
                    cache.remove(e)
                cache.append({"name": name, "host": t[0], "arrival": min(e["arrival"] for e in seen), "creation": min(e["creation"] for e in seen), "parts": [p for e in seen for p in e["parts"]]})
    return sorted((e["name"], e["host"], e["arrival"], e["creation"], len(e["parts"])) for e in cache)


@pytest.mark.parametrize("age", [0, 3, 25, 10_000])
def test_compression_follows_each_firing(spark, age):
    rng = random.Random(age)
    rows = [{"id": str(k), "name": rng.choice("ABT"), "host": rng.choice(["x", "x", "y"]), "arrival": t, "creation": t - rng.randrange(9), "forwarded": rng.random() < 0.1} for k, t in enumerate(sorted(rng.randrange(600) for _ in range(250)))]
    rule = R.Rule("g", "r", [R.Trigger("event", "T", ANY)], None, [R.compress_selected(P.event_name("A") | P.event_name("B"), ["host"], age)])
    out = R.Plan([rule]).remaining(events(spark, rows)).where("name <> 'T'")
    got = sorted((r["name"], r["host"], r["arrival"], r["creation"], r["count"] or 1) for r in out.collect())
    assert got == simulated(rows, "T", "AB", age)


def test_events_of_separate_times_stay_apart(spark):
    """The rule's own events trigger it, as in the sample of repeated errors."""
    df = events(spark, [{"id": str(k), "name": "E", "arrival": t, "creation": t} for k, t in enumerate((0, 10, 1_000_000, 1_000_010))])
    rule = R.Rule("g", "r", [R.Trigger("event", "E")], None, [R.compress_selected(P.event_name("E"), ["host"], 100)])
    out = R.Plan([rule]).remaining(df).collect()
    assert sorted((r["count"], r["arrival"], r["type"]) for r in out) == [(2, 0, "compressed"), (2, 1_000_000, "compressed")]


def test_compressed_events_trigger_nothing_but_are_seen(spark):
    df = events(spark, [{"id": str(k), "name": n, "arrival": k, "creation": k} for k, n in enumerate("AATB")])
    q = P.event_name("A")
    plan = R.Plan(
        [
            R.Rule("g", "compress", [R.Trigger("event", "T")], None, [R.compress_selected(q, ["host"], 9)], order=0),
            R.Rule("g", "mark own", [R.Trigger("event", "A")], None, [R.set_attribute("own", "yes")], order=1),
            R.Rule("g", "mark seen", [R.Trigger("event", "B")], None, [R.on_selected(q, ["host"], 9, [R.set_attribute("seen", "yes")])], order=2),
        ]
    )
    (made,) = plan.remaining(df).where(q).collect()
    assert made["count"] == 2 and made["attributes"] == {"seen": "yes"}
    assert {(r["rule"], r["condition"]) for r in plan.firings(df).collect()} == {("compress", True), ("mark seen", True)}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("kind", ["compress", "suppress", "create", "aggregate"])
def test_plans_read_as_many_tables_however_many_rules(spark, kind):
    q = P.event_name("A")
    act = {"compress": R.compress_selected(q, ["host"], 9), "suppress": R.suppress_selected(q, ["host"], 9), "create": R.create_event("N"), "aggregate": R.aggregate_selected("G", q, ["host"], 9)}[kind]
    df = events(spark, [{"id": str(k), "name": "AT"[k % 2], "arrival": k, "creation": k} for k in range(20)])
    rule = lambda n: R.Rule("g", f"r{n}", [R.Trigger("event", "T")], None, [act], order=n)
    few, many = (scans(R.Plan([rule(k) for k in range(n)]).run(df)) for n in (1, 4))
    assert few == many <= 4


def test_ten_rules_read_few_tables(spark):
    assert scans(ten().run(event_view(spark, "/root/testdata/sf0.001"))) <= 4


def test_rows_that_no_rule_touches_stay_as_they_are(spark):
    rows = [{"id": str(k), "name": "ABT"[k % 3], "host": "xy"[k % 2], "arrival": k, "creation": k, "description": f"d{k}", "attributes": {"k": str(k)}, "references": {"child": ["c"]}} for k in range(30)]
    df = events(spark, rows).withColumn("extra", F.col("arrival") * 2)
    plan = R.Plan([R.Rule("g", "t", [R.Trigger("event", "T")], F.col("host") == "x", [R.suppress_selected(P.event_name("A"), ["host"], 4), R.on_selected(P.event_name("B"), ["host"], 1, [R.drop])], [R.when(F.col("id") == "5", [R.create_event("N")])])])
    out = plan.remaining(df)
    assert out.columns == df.columns
    before, after = ({r["id"]: r for r in x.collect()} for x in (df, out))
    fired = [r for r in rows if r["name"] == "T" and r["host"] == "x"]
    gone = {r["id"] for r in rows if r["name"] == "B" and any(f["host"] == r["host"] and 0 <= f["arrival"] - r["arrival"] <= 1 for f in fired)}
    quiet = {r["id"] for r in rows if r["name"] == "A" and any(f["host"] == r["host"] and 0 <= f["arrival"] - r["arrival"] <= 4 for f in fired)}
    assert gone is not None and quiet and set(before) - set(after) == gone
    assert {k for k in after if len(k) < 4 and after[k] != before[k]} == quiet and all(after[k]["status"] == "inactive" for k in quiet)
    (made,) = [r for k, r in after.items() if len(k) > 4]
    assert made["name"] == "N" and made["arrival"] == 5 and made["extra"] is None


def test_aggregated_events_become_parents(spark):
    rows = [{"id": "1", "name": "A", "arrival": 1, "references": {"parent": ["p"], "cross": ["c"]}}, {"id": "2", "name": "A", "arrival": 5}, {"id": "3", "name": "T", "arrival": 6}, {"id": "4", "name": "T", "arrival": 12}]
    out = {r["id"]: r for r in R.Plan([R.Rule("g", "r", [R.Trigger("event", "T")], None, [R.aggregate_selected("G", P.event_name("A"), ["host"], 8)])]).remaining(events(spark, rows)).collect()}
    made = {r["arrival"]: r for k, r in out.items() if len(k) > 1}
    assert {t: r["references"]["child"] for t, r in made.items()} == {6: ["1", "2"], 12: ["2"]}
    assert out["1"]["references"] == {"cross": ["c"], "parent": ["p", made[6]["id"]]}
    assert sorted(out["2"]["references"]["parent"]) == sorted(r["id"] for r in made.values()) and out["3"]["references"] == {}


def test_windows_of_rows_that_are_due_later(spark):
    """A window takes rows that are due by its first row's time and the timeout; a row's due time is one per second."""
    rng = random.Random(5)
    times = sorted(rng.sample(range(400), 120))
    firings = sorted(rng.sample(range(450), 60))
    rows = [("x", t, next((f for f in firings if f >= t), 10**6)) for t in times]
    df = spark.createDataFrame(rows, "host string, arrival long, due long")
    got = {r["arrival"]: r["win_start"] for r in contexts.anchored(df, ["host"], 40, due="due").collect()}
    want, anchor = {}, None
    for _, t, due in rows:
        anchor = t if anchor is None or due > anchor + 40 else anchor
        want[t] = anchor
    assert got == want


@pytest.mark.parametrize("block", [1, 30, 1000])
def test_windows_in_blocks(spark, block):
    """Blocks of time that gaps are looked for in do not show: with short and long segments, null keys, rows without a time, none at all."""
    rng = random.Random(block)
    rows = [(str(k), rng.choice(["x", "y", None]), rng.choice([rng.randrange(120), rng.randrange(3000), None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, host string, arrival long")
    told = lambda x: sorted(map(tuple, x.select("id", "host", "arrival", "win_seq", "win_start").collect()), key=str)
    assert told(contexts.anchored(df, ["host"], 40, block=block)) == told(contexts.anchored(df, ["host"], 40))
    assert contexts.anchored(df.limit(0), ["host"], 40, block=block).count() == 0


def test_null_keys_meet(spark):
    from eventweir.operators import joins

    df = spark.createDataFrame([("1", None, 1), ("2", None, 3), ("3", "x", 3)], "id string, host string, arrival long")
    got = {(r["trigger_id"], r["id"]) for r in joins.select_events(df, df, ["host"], 5).collect()}
    assert got == {("1", "1"), ("2", "1"), ("2", "2"), ("3", "3")}
    assert ids(df) == ["1", "2", "3"]
