import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.functions.schema import with_defaults
from eventweir.operators import contexts as X
from eventweir.operators import joins
from eventweir.plans import rules as R


def event(name):
    return [R.Trigger("event", name)]


def test_filter_sample(spark):
    names = ("A", "MAIL:FRESHCLAM:ERROR", "B")
    plan = R.Plan([R.Rule("drop", n, event(n), None, [R.set_status("inactive")]) for n in names[:2]])
    out = plan.remaining(events(spark, [{"id": n, "name": n} for n in names]))
    assert ids(out.where("status = 'inactive'")) == sorted(names[:2])


def test_cascade(spark):
    """The first rule makes A inactive, so the second is not triggered by it; an inactive row triggers none."""
    plan = R.Plan([R.Rule("g", "count", event("A"), order=1), R.Rule("g", "quiet", event("A"), F.col("host") == "x", [R.set_status("inactive")], order=0)])
    df = events(spark, [{"id": "1", "name": "A", "host": "x"}, {"id": "2", "name": "A", "host": "y"}, {"id": "3", "name": "A", "host": "y", "status": "inactive"}])
    got = {(r["id"], r["rule"], r["condition"]) for r in plan.firings(df).collect()}
    assert got == {("1", "quiet", True), ("2", "quiet", False), ("2", "count", True)}


def test_alternative_actions(spark):
    act = R.when(F.col("id") % 2 == 0, [R.set_attribute("even", "yes"), R.when(F.col("id") == 0, [R.drop])], [R.set_attribute("even", "no")])
    rows = act(events(spark, [{"id": "0"}, {"id": "1"}, {"id": "2"}]).withColumn("dropped", F.lit(False)), F.lit(True))
    got = {r["id"]: (r["attributes"]["even"], r["dropped"]) for r in rows.collect()}
    assert got == {"0": ("yes", True), "1": ("no", False), "2": ("yes", False)}


def test_bad_rules():
    for wrong in (lambda: R.Trigger("name", "A"), lambda: R.Trigger("event"), lambda: R.Trigger("any", "A"), lambda: R.Trigger("event", "A", ("foo",)), lambda: R.Rule("g", "r", event("A"), creates=["A"]), lambda: R.set_status("foo")):
        with pytest.raises(ValueError):
            wrong()


def test_plugins(spark):
    found = R.default_plugins()
    for wrong in (lambda: found.condition("none"), lambda: found.action("none")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        found.condition("weekday", days=["foo"])
    df = events(spark, [{"id": "1", "attributes": {"log": "from 10.0.0.1"}, "arrival": 1704067200}, {"id": "2", "attributes": {"log": "none"}, "arrival": 1704153600}])
    plan = R.Plan(
        [
            R.Rule("g", "mondays", [R.Trigger("any")], found.condition("weekday", days=["mon"]), [R.set_attribute("monday", "yes")]),
            R.Rule("g", "hosts", [R.Trigger("any")], found.condition("opaque", test=lambda s: s.str.len() > 0, columns=["id"]), [found.action("enrich_regexp", source="log", pattern=r"from (\S+)", target="src")], order=1),
        ]
    )
    got = {r["id"]: (r["attributes"].get("monday"), r["attributes"].get("src")) for r in plan.remaining(df).collect()}
    assert got == {"1": ("yes", "10.0.0.1"), "2": (None, None)}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_one_shuffle_for_a_window_stage(spark):
    from eventweir.operators import conditions

    df = events(spark, [{"id": "1"}])
    out = conditions.sequence_any_sliding(df, [P.event_name(n) for n in "ABC"], ["host"], 10)
    assert exchanges(out)[0] == 1


def test_routing_is_broadcast(spark):
    plan = R.Plan([R.Rule("g", "r", event("A")), R.Rule("g", "all", [R.Trigger("any")])])
    df = events(spark, [{"id": "1"}, {"id": "2", "name": "B"}])
    out = joins.route(df, plan.triggers(spark), plan.class_table(spark) if plan.classes else spark.createDataFrame([], "class string, name string"))
    assert "SortMergeJoin" not in exchanges(out.where("rule = 'r'"))[1].split("HashAggregate")[0]
    assert {(r["id"], r["rule"]) for r in out.collect()} == {("1", "r"), ("1", "all"), ("2", "all")}


def test_many_changes_are_not_broadcast(spark):
    """What a rule has changed is a small file, but of more rows than a driver should hold."""
    df = with_defaults(spark.range(20_001).select(F.col("id").cast("string"), F.lit("A").alias("name"), F.lit("x").alias("host"), F.col("id").alias("arrival")), F.lit(0))
    out = R.Plan([R.Rule("g", "all", event("A"), None, [R.suppress_selected(P.event_name("A"), ["host"], 10)])]).remaining(df)
    assert "Broadcast" not in exchanges(out)[1]
    assert out.where("status = 'inactive'").count() == 20_001


def test_context_sample(spark):
    df = events(spark, [{"id": "a", "name": "OPEN", "arrival": 0}, {"id": "b", "arrival": 10}, {"id": "c", "arrival": 11}])
    got = {r["id"]: r["context_start"] for r in X.open_at(df, P.event_name("OPEN"), ["host"], 10).collect()}
    assert got == {"a": 0, "b": 0, "c": None}
