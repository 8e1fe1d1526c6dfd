"""Conditions in both forms and on two axes, compression, rules on selected events: against plain loops over small random tables."""

import random
from itertools import product

import pandas as pd
import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.operators import actions
from eventweir.operators import conditions as C
from eventweir.operators import contexts as X
from eventweir.plans import rules as R
from eventweir.sources import readers, scratch



class Named(list):
    """The queries A, B, C, made when they are first asked for: columns need a session."""

    def __getitem__(self, k):
        found = [P.event_name(x) for x in "ABC"]
        return found[k]

    def __iter__(self):
        return iter(self[:])

    def __len__(self):
        return 3


ABC = Named()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for k in range(160):
        t = rng.randrange(0, 900)
        out.append({"id": f"{k:03}", "name": rng.choice("ABCD"), "host": rng.choice("xyz"), "arrival": t, "creation": t - rng.randrange(0, 40)})
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return events(spark, rows).select("id", "name", "host", "creation", "arrival").withColumn("host", F.nullif(F.col("host"), F.lit("z"))).persist()


def seen(rows, t, age, source):
    return [r for r in rows if r["host"] == t["host"] and r["arrival"] <= t["arrival"] and r[source] + age >= t["arrival"]]


def in_order(found, match, sort, names="ABC"):
    times = [[r[sort] for r in found if r["name"] == n] for n in names]
    if match == "any":
        return any(a < b < c for a, b, c in product(*times))
    return all(times) and all(max(a) < min(b) for a, b in zip(times, times[1:], strict=False))


def close(found, match, sort, timeframe, names="ABC"):
    times = [[r[sort] for r in found if r["name"] == n] for n in names]
    if match == "any":
        return any(max(c) - min(c) <= timeframe for c in product(*times))
    return all(times) and max(map(max, times)) - min(map(min, times)) <= timeframe


def hits(df):
    return {r["id"]: r["hit"] for r in df.collect()}


@pytest.mark.parametrize(("match", "source"), list(product(("any", "all"), ("arrival", "creation"))))
def test_two_axes(table, rows, match, source):
    got = hits(C.sequence_two_axes(table, ABC, ["host"], 150, match, source=source))
    assert got == {t["id"]: in_order(seen(rows, t, 150, source), match, "creation") for t in rows}
    got = hits(C.within_two_axes(table, ABC, ["host"], 150, 60, match, source=source))
    assert got == {t["id"]: close(seen(rows, t, 150, source), match, "creation", 60) for t in rows}
    got = {r["id"]: r["symbols"] for r in C.pattern_two_axes(table, [("a", ABC[0]), ("b", ABC[1])], "ab", ["host"], 150, source=source).collect()}
    for t in rows:
        found = sorted((r["creation"], "AB".index(r["name"]), r["id"]) for r in seen(rows, t, 150, source) if r["name"] in "AB")
        assert got[t["id"]] == "".join("ab"[k] for _, k, _ in found)


def test_long_strings_of_few_rows(spark):
    """The rows that are asked for get their strings, the others none: 30,000 rows see each other, 30 strings of 30,000 letters are made. More
    letters than leave a sweep at once are dealt over several batches."""
    n = F.col("id")
    table = spark.range(30_000).select(n.cast("string").alias("id"), F.when(n % 1000 == 0, "A").otherwise("B").alias("name"), F.lit("x").alias("host"), (n % 5).alias("creation"), F.lit(10).cast("long").alias("arrival"))
    for more, last in ((10, 30_000), (0, 10_000)):
        few = table.where(n < last)
        asked = P.event_name("A") if more else n.cast("long") % 10 == 0
        got = C.pattern_two_axes(few, [("a", P.event_name("A")), ("b", P.event_name("B"))], "^a+b", ["host"], 10, source="creation", asked=asked)
        wanted = "".join("a" * (last // 1000) + "b" * (last // 5 - last // 1000) if k == 0 else "b" * (last // 5) for k in range(5))
        told = got.select("id", (F.col("symbols") == wanted).alias("right"), "matched").collect()
        assert len(told) == len({r["id"] for r in told}) == (30 if more else 1000) and all(r["right"] and r["matched"] for r in told)


def test_sliding_forms(table, rows):
    for sort in ("arrival", "creation"):
        got = hits(C.sequence_all_sliding(table, ABC[:2], ["host"], 40, sort=sort))
        assert got == {t["id"]: in_order(seen(rows, t, 40, "arrival"), "all", sort, "AB") for t in rows} and any(got.values())
        got = hits(C.within_all_sliding(table, ABC[:2], ["host"], 60, 40, sort=sort))
        assert got == {t["id"]: close(seen(rows, t, 60, "arrival"), "all", sort, 40, "AB") for t in rows} and any(got.values())


def test_sequence_any_by_key(table, rows):
    few = table.where("arrival < 120")
    got = {r["host"]: r["hit"] for r in C.sequence_any_by(few, ABC, ["host"]).collect()}
    assert got == {(None if h == "z" else h): in_order([r for r in rows if r["host"] == h and r["arrival"] < 120], "any", "creation") for h in "xyz"}
    assert C.sequence_any_by(few, ABC[:1], ["host"]).where("hit").count() == 3
    assert C.sequence_any_by(few.limit(0), ABC, ["host"]).count() == 0


def test_forms_without_queries(table):
    for made in (C.sequence_two_axes(table, ABC[:1], ["host"], 9), C.sequence_all_sliding(table, [], ["host"], 9), C.within_two_axes(table, [], ["host"], 9, 9), C.within_all_sliding(table, [], ["host"], 9, 9)):
        assert made.where("not hit").count() == 0
    for wrong in (lambda: C.sequence_two_axes(table, ABC, ["host"], 9, "some"), lambda: C.within_two_axes(table, ABC, ["host"], 9, 9, "some"), lambda: C.Seen(table, ["host"], 9, source="time")):
        with pytest.raises(ValueError):
            wrong()


def test_windows_keep_null_keys(table, rows):
    assert X.repeating(table, ["host"], 50).count() == len(rows)
    opened = X.counter_at(table, ABC[0], ABC[1], ["host"], 30, 1, "ge")
    assert opened.count() == len(rows) and opened.where("context_start is null and counter is not null").count() == 0


def test_associations_are_reset(table, rows):
    windows = X.anchored(table, ["host"], 100)
    got = {(r["host"], r["win_seq"]): r["event_ids"] for r in X.associated(windows, ["host", "win_seq"], F.col("name") != "C", F.col("name") == "B").collect()}
    held = {}
    for r in windows.orderBy("arrival", "id").collect():
        own = held.setdefault((r["host"], r["win_seq"]), [])
        if r["name"] == "B":
            own.clear()
        if r["name"] != "C":
            own.append(r["id"])
    assert got == {k: sorted(v) for k, v in held.items()}


def test_compression_in_full(spark):
    refs = lambda **kw: kw
    df = events(
        spark,
        [
            {"id": "1", "name": "A", "host": "x", "description": "d", "attributes": {"same": "s", "differs": "1"}, "references": refs(child=["a", "b"]), "arrival": 5, "creation": 4, "local": True},
            {"id": "2", "name": "A", "host": "y", "description": "d", "attributes": {"same": "s", "differs": "2", "once": "o"}, "references": refs(child=["b", "c"], cross=["z"]), "type": "compressed", "count": 4, "arrival": 3, "creation": 6, "local": True},
            {"id": "3", "name": "B", "host": "x", "attributes": {"k": "v"}, "references": refs(parent=["p"]), "arrival": 1, "creation": 1},
            {"id": "4", "name": "A", "host": "x", "forwarded": True, "arrival": 1, "creation": 1},
            {"id": "5", "name": "A", "host": "x", "type": "synthetic", "arrival": 1, "creation": 1},
            {"id": "6", "name": "C", "host": "x", "arrival": 1, "creation": 1},
            {"id": "7", "name": "C", "host": "x", "arrival": 2, "creation": 1},
        ],
    )
    out = actions.compress_events(df, ["name"], actions.compressible() & (F.col("id") != "7"))
    assert out.columns == df.columns
    got = {r["id"]: r for r in out.collect()}
    alone = {r["id"]: r for r in df.collect()}
    assert {k: v for k, v in got.items() if len(k) == 1} == {k: alone[k] for k in "34567"}
    (made,) = [r for k, r in got.items() if len(k) > 1]
    assert (made["type"], made["count"], made["host"], made["description"], made["local"], made["creation"], made["arrival"], made["history"]) == ("compressed", 5, "engine", "d", True, 4, 3, [])
    assert made["attributes"] == {"same": "s", "differs": "[multiple values]", "once": "o"}
    assert made["references"] == {"child": ["a", "b", "c"], "cross": ["z"]}
    assert actions.compress_events(df.limit(0), ["name", "host"]).count() == 0


def test_rules_on_selected_events(spark):
    df = events(spark, [{"id": str(k), "name": n, "host": h, "arrival": t, "creation": t} for k, (n, h, t) in enumerate([("E", "x", 1), ("E", "x", 5), ("E", "y", 5), ("T", "x", 10), ("T", "y", 900), ("S", "x", 20)])])
    on = lambda name, *acts, **kw: R.Rule("g", kw.pop("rule", name), [R.Trigger("event", name, ("any",))], None, acts, **kw)
    query = P.event_name("E")
    out = R.Plan([on("T", R.suppress_selected(query, ["host"], 9))]).remaining(df)
    assert ids(out.where("status = 'inactive'")) == ["0", "1"]
    out = R.Plan([on("T", R.compress_selected(query, ["host"], 9))]).remaining(df)
    assert [(r["host"], r["count"]) for r in out.where("type = 'compressed'").collect()] == [("x", 2)] and out.count() == 5
    out = R.Plan([on("T", R.aggregate_selected("G", query, ["host"], 9)), on("G", R.set_attribute("seen", "yes"), order=1)]).remaining(df)
    (made,) = out.where("name = 'G'").collect()
    assert made["references"] == {"child": ["0", "1"]} and made["attributes"]["seen"] == "yes" and made["type"] == "aggregated"
    # as output an event leaves without triggering a rule; the one made as input does
    for inject, marked in (("input", 1), ("output", 0)):
        out = R.Plan([on("S", R.create_event("N", {"a": F.col("host")}, inject=inject)), on("N", R.set_status("inactive"), order=1)]).remaining(df)
        assert out.where("name = 'N'").count() == 1 and out.where("name = 'N' and status = 'inactive'").count() == marked
    with pytest.raises(ValueError):
        R.Plan([on("S", R.create_event("N", inject="back"))]).run(df)


def test_plugin_over_the_events_of_queries(table, rows):
    """A Python condition that gets the triggering rows and, per query, the lists of events that each sees."""

    def judge(trigger: pd.DataFrame, first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([len(a) > len(b) and all(e["arrival"] <= t for e in a) for t, a, b in zip(trigger["arrival"], first, second, strict=True)])

    condition = R.default_plugins().condition("over_queries", test=judge, queries=ABC[:2], keys=["host"], age=100)
    plan = R.Plan([R.Rule("g", "more A than B", [R.Trigger("event", "C", ("any",))], condition, [R.set_status("inactive")])])
    df = table.withColumns({"status": F.lit("active"), "type": F.lit("raw")})
    got = set(ids(plan.remaining(df).where("status = 'inactive'")))
    count = lambda t, n: sum(r["name"] == n for r in seen(rows, t, 100, "arrival"))
    assert got == {t["id"] for t in rows if t["name"] == "C" and count(t, "A") > count(t, "B")} and got


def test_repeated_xml_attributes(spark, tmp_path):
    """Of attributes with one key the last counts."""
    (tmp_path / "e.xml").write_text("<events><event><name>A</name><host>x</host><creation>5</creation><attributes><attribute key='a'>1</attribute><attribute key='b'>2</attribute><attribute key='a'>3</attribute></attributes></event></events>")
    assert readers.xml(spark, str(tmp_path / "e.xml")).first()["attributes"] == {"a": "3", "b": "2"}


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",".join(readers.CSV_REQUIRED) + "\n" + ",".join('"1\n2"' if k == 0 else "3" for k in range(len(readers.CSV_REQUIRED))) + "\n")
    assert readers.csv_dump(spark, str(tmp_path / "d.csv"), multi_line=True).count() == 1


def test_scratch_tables_are_cleared(spark):
    kept = list(scratch._made)
    table = scratch.written(spark.range(5), "clear")
    where = scratch._made[-1]
    assert table.count() == 5
    scratch._made[:] = [where]
    assert scratch.clear(spark) == 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    scratch._made[:] = kept
