import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.functions import scalar, schema
from eventweir.operators import actions


@pytest.fixture(scope="module")
def hundred(spark):
    """100 events: 0 to 14 on host FOO, 5 to 19 named BAR."""
    return events(spark, [{"id": str(k), "host": "FOO" if k < 15 else "x", "name": "BAR" if 5 <= k < 20 else "A"} for k in range(100)]).persist()


def test_set_operations(hundred):
    foo, bar = P.event_host("FOO"), P.event_name("BAR")
    assert hundred.where(P.all_of([foo, bar])).count() == 10
    assert hundred.where(P.any_of([foo, bar])).count() == 20
    assert hundred.where(~foo).count() == 85
    assert hundred.where(P.all_of([])).count() == hundred.where(P.any_of([])).count() == 100


def test_boolean_conditions(spark):
    numbers = spark.range(1, 13).withColumnRenamed("id", "n")
    two, big, small = F.col("n") % 2 == 0, F.col("n") > 5, F.col("n") < 9
    values = lambda c: [r["n"] for r in numbers.where(c).orderBy("n").collect()]
    assert values(P.all_of([two, big, small])) == [6, 8]
    assert values(P.any_of([two, F.col("n") < 4])) == [1, 2, 3, 4, 6, 8, 10, 12]
    assert values(~P.all_of([two])) == [1, 3, 5, 7, 9, 11]


def test_validation(spark):
    rows = spark.createDataFrame([(None, "h", "raw", "active", None), ("n", "", "raw", "active", None), ("n", "h", "foo", "active", None), ("n", "h", "raw", "foo", None), ("n", "h", "compressed", "active", None), ("n", "h", "raw", "active", 3), ("n", "h", "compressed", "active", 2)], "name string, host string, type string, status string, count long")
    valid, rejected = schema.validated(rows)
    assert valid.count() == 1
    assert sorted(r["reasons"][0] for r in rejected.collect()) == ["count missing", "count unexpected", "host missing", "name missing", "unknown status", "unknown type"]
    with pytest.raises(ValueError):
        schema.with_defaults(spark.range(1))
    with pytest.raises(ValueError):
        schema.with_defaults(spark.createDataFrame([("n", "h", 1)], "name string, host string, odd int"))


def test_attributes(spark):
    rows = [{"id": str(k), "attributes": {"foo": "bar"} if k < 10 else {"foo": str(k)} if k < 20 else {}} for k in range(30)]
    df = events(spark, rows)
    assert df.where(P.event_attribute("foo", "bar")).count() == 10
    assert df.where(P.event_attribute("foo", "15", "ge")).count() == 5
    assert ids(df.where(P.event_attribute("foo", "10", "le"))) == ["10"]
    assert df.where(P.event_attribute("foo", "x", "ge")).count() == df.where(P.event_attribute("foo", "-1", "ge")).count() == 0
    words = events(spark, [{"id": w, "attributes": {"foo": w}} for w in ("bar", "baar", "bahr")])
    assert ids(words.where(P.event_attribute("foo", "^baa?r$", "re"))) == ["baar", "bar"]
    with pytest.raises(ValueError):
        P.event_attribute("foo", "1", "lt")


def test_age(spark):
    df = events(spark, [{"id": "old", "creation": 0, "arrival": 200}, {"id": "new", "creation": 150, "arrival": 200}])
    assert ids(df.where(P.event_min_age(100))) == ["old"]
    at = events(spark, [{"id": "e", "creation": 0, "arrival": 0}])
    assert at.where(P.event_max_age(10, F.lit(10))).count() == 1
    assert at.where(P.event_max_age(10, F.lit(11))).count() == 0
    assert at.where(P.event_max_age(None, F.lit(10**6))).count() == 1
    assert at.where(P.event_max_age(None, F.lit(-1))).count() == 0


def test_fields_and_templates(spark):
    df = events(spark, [{"name": "FOO", "host": "BAR", "attributes": {"A": "3"}}])
    row = df.select(P.field("name").alias("a"), P.field("host").alias("b"), P.field("attributes.A").alias("c"), P.field("attributes.B").alias("d"), P.template("foo", "bar", "baz").alias("e")).first()
    assert tuple(row) == ("FOO", "BAR", "3", "", "foobarbaz")


def test_classes(spark):
    df = events(spark, [{"id": "1", "name": "FOO"}, {"id": "2", "name": "BAR"}])
    table = spark.createDataFrame([("bar", "FOO"), ("baz", "FOO"), ("bar", "BAR")], "class string, name string")
    assert ids(P.in_class(df, table, "baz")) == ["1"]
    assert ids(P.in_class(df, table, "bar")) == ["1", "2"]


def test_named_queries():
    named = P.NamedQueries()
    named.define("g", "a", lambda q: q("g", "b"))
    named.define("g", "b", lambda q: q("g", "a"))
    with pytest.raises(ValueError):
        named("g", "a")
    with pytest.raises(KeyError):
        named("g", "c")


def test_attribute_counters(spark):
    df = spark.createDataFrame([("a", {"n": "5"}), ("b", {}), ("c", {"n": "x"}), ("d", {"n": "-2"})], "id string, attributes map<string,string>")
    got = {r["id"]: r["v"] for r in df.select("id", scalar.counted_attribute("n", 2).alias("v")).collect()}
    assert got == {"a": "7", "b": "2", "c": "2", "d": "2"}


def test_durations(spark):
    for text, n in (("90", 90), ("10m", 600), ("2h", 7200), ("1d", 86400), ("5s", 5)):
        assert scalar.seconds(text) == n
    for text in ("10mx", "", "-1", "m"):
        with pytest.raises(ValueError):
            scalar.seconds(text)
    df = spark.createDataFrame([("10m",), ("10mx",), (None,), ("7",)], "t string")
    assert [r[0] for r in df.select(scalar.parse_duration(F.col("t"))).collect()] == [600, None, None, 7]


def test_weekdays(spark):
    monday = spark.createDataFrame([(1704067200,)], "t long")
    holds = lambda days: monday.where(scalar.weekday_in(F.col("t"), days)).count() == 1
    assert holds(["0"]) and holds(list("0123456")) and holds(["mon", "tue"]) and not holds(["tue", 6])
    for bad in ([], ["foo"], ["7"]):
        with pytest.raises(ValueError):
            holds(bad)


def test_aliases(spark):
    df = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 53, 702, 703, 18278, 18279)], "n long")
    assert [r[0] for r in df.select(scalar.alias(F.col("n"))).collect()] == ["a", "z", "aa", "az", "ba", "zz", "aaa", "zzz", "aaaa"]


def test_unique_by(spark):
    rows = [{"id": str(k), "host": "TEST" if k < 96 else "FOO", "creation": 100 + k} for k in range(100)]
    df = events(spark, rows)
    assert ids(actions.unique_by(df, F.col("host"))) == ["0", "96"]
    assert ids(actions.unique_by(df, F.col("host"), keep="last")) == ["95", "99"]
    assert actions.unique_by(df.limit(0), F.col("host")).count() == 0
    with_foo = events(spark, [{"id": str(k), "attributes": {"foo": "bar"} if k < 3 else {"foo": "baz"} if k == 3 else {}} for k in range(100)])
    assert actions.unique_by(with_foo, P.attribute("foo")).count() == 3


def test_first_and_last(spark):
    df = events(spark, [{"id": "a", "creation": 90, "arrival": 300}, {"id": "b", "creation": 100, "arrival": 100}, {"id": "c", "creation": 200, "arrival": 200}])
    assert ids(actions.first_of(df)) == ["a"] and ids(actions.last_of(df)) == ["c"]
    assert ids(actions.first_of(df, "arrival")) == ["b"] and ids(actions.last_of(df, "arrival")) == ["a"]
    assert actions.first_of(df.limit(0)).count() == 0


def test_drop_and_forward(spark):
    df = events(spark, [{"id": str(k), "forwarded": k == 3} for k in range(20)])
    assert actions.drop(df, F.col("id").isin("0", "1")).count() == 18
    kept, out = actions.forward(df, F.col("id").cast("int") < 10)
    assert out.count() == 9 and kept.where("forwarded").count() == 10
    again, more = actions.forward(kept, F.lit(True))
    assert more.count() == 10 and again.where("not forwarded").count() == 0


def test_unique_ids(spark):
    df = spark.range(1000).select(schema.event_id(F.lit("h"), F.col("id").cast("string")).alias("id"))
    assert df.distinct().count() == 1000
