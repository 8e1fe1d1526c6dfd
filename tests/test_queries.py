"""Registered queries against their SQL on tables that sf0.01 has nothing like."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from eventweir.queries import load

BEGIN = datetime(2024, 1, 1)


def same_as_sql(spark, folder, name, rows, order=None):
    """The query's rows, which are those of its SQL. rows: (event_id, second, user_id, event_type, k). order: what an ORDER BY of the SQL
    that leaves ties open is, and by what it is told here."""
    n, at, user, kind, k = zip(*rows, strict=True)
    times = pa.array([BEGIN + timedelta(seconds=s) for s in at], pa.timestamp("us"))
    events = pa.table({"event_id": n, "ts": times, "user_id": user, "event_type": kind, "value": [0.0] * len(n), "props": [f'{{"k": {x}}}' for x in k]})
    pq.write_table(events, f"{folder}/events.parquet")
    queries, sql = load()
    assert not order or order[0] in sql[name]
    wanted = duckdb.sql(sql[name].replace(*order) if order else sql[name])
    got = queries[name](spark, str(folder)).select(*wanted.columns).collect()
    assert sorted(map(tuple, got)) == sorted(wanted.fetchall())
    return got


def test_aliases_past_three_letters(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "anonymize_hosts", [(i, i, 4 * i, "view", i % 100) for i in range(18_300)])
    assert len({r["host"] for r in got}) == 18_300 and "{aa-1" in {r["host"] for r in got}


#: Of one host: three events of a second, which are also the last of a bucket of time, one just within and one just out of half a day.
TIED = [(i, at, 0, "view", 1) for i, at in [(9, 100), (10, 200), (8, 345_599), (11, 345_599), (100, 345_599), (12, 388_798), (13, 431_998), (14, 431_998)]]
BY_NUMBER = ("PARTITION BY host ORDER BY arrival)", "PARTITION BY host ORDER BY arrival, n)")


def test_edges_of_tied_events(spark, tmp_path):
    got = {(r["id"], r["ref_id"]) for r in same_as_sql(spark, tmp_path, "event_edges", TIED, BY_NUMBER) if r["reftype"] == "parent"}
    assert got == {("10", "9"), ("11", "8"), ("100", "11"), ("12", "100"), ("14", "13")}


def test_depths_of_tied_events(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "event_tree_depth", TIED, BY_NUMBER)
    assert {(r["id"], r["depth"], r["root"]) for r in got} == {("9", 0, "9"), ("10", 1, "9"), ("8", 0, "8"), ("11", 1, "8"), ("100", 2, "8"), ("12", 3, "8"), ("13", 0, "13"), ("14", 1, "13")}
