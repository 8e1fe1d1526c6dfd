"""Exact duplicates against brute force: nulls, empties, ties, repeated rows, very large groups, empty tables, clashing columns."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventweir.llm import exact_dedup


def groups(corpus, normalise=lambda x: x):
    found = defaultdict(list)
    for r in corpus:
        found[normalise(r[1] or "")].append(r[0])
    return found


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_classes(spark, docs, corpus, keep):
    rows = exact_dedup.classes(docs, keep=keep).collect()
    pick, seen = min if keep == "smallest" else max, defaultdict(list)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups(corpus).items()}
    assert len(rows) == len(corpus)
    for r in rows:
        ids = by_text[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (pick(known) if known else None) and r.group_size == len(ids)
        seen[r.text_sha256].append((r.doc_id, r.kept))
    for sha, members in seen.items():
        assert sorted(str(i) for i, _ in members) == sorted(map(str, by_text[sha]))
        assert [i for i, kept in members if kept] == [pick([i for i, _ in members if i is not None], default=None)]


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_every_fan_gives_the_same(spark, docs, fan):
    many = docs.repartition(23)
    rows = exact_dedup.classes(many, keep="largest", fan=fan).select("doc_id", "keep_id", "group_size", "text_sha256")
    other = exact_dedup.classes(docs.coalesce(1), keep="largest").select("doc_id", "keep_id", "group_size", "text_sha256")
    assert sorted(map(str, rows.collect())) == sorted(map(str, other.collect()))


def test_a_third_of_all_rows_is_one_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = exact_dedup.classes(rows.repartition(17), keep="largest")
    assert out.where("kept").count() == 2001 and out.where("keep_id = 2997 and group_size = 1000").count() == 1000


def test_normalised(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")
    out = exact_dedup.classes(rows, normalise=lambda t: F.nullif(F.lower(F.regexp_replace(t, " +", " ")), F.lit("")))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)]


def test_rows_that_stay(spark, docs, corpus):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("digest", "bytes", "check", "id", "n", "row", "doc", "keep_id", "keep_row", "run", "best")})
    out = exact_dedup.drop_duplicates(clashing, keep="largest")
    assert out.columns == clashing.columns
    want = sorted(str(max([i for i in ids if i is not None], default=None)) for ids in groups(corpus).values())
    assert sorted(str(r.doc_id) for r in out.collect()) == want
    assert {tuple(r[:5]) for r in out.collect()} <= set(corpus)
    kept = exact_dedup.classes(clashing.withColumnRenamed("doc_id", "key"), id_col="key").where("kept")
    assert kept.columns == ["key", "keep_id", "group_size", "kept", "text_sha256"] and kept.count() == len(want)


def test_empty_and_refused(spark, empty):
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
    for bad in ({"keep": "first"}, {"fan": 1}):
        with pytest.raises(ValueError):
            exact_dedup.classes(empty, **bad)


def test_native_plan(spark, docs):
    plan = exact_dedup.classes(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
