import pytest
from helpers import events
from pyspark.sql import functions as F

from eventweir.operators import actions
from eventweir.sources import readers, writers

LINES = [
    "Feb  8 06:52:12 server-002 sshd[1234]: Failed password for root from 10.0.2.68 port 4 ssh2",
    "Feb  8 06:52:13 server-002 sshd[1234]: Accepted password for alice from 10.0.2.69 port 4 ssh2",
    "Feb  8 06:52:14 server-003 kernel: something odd",
    "Feb  8 06:52:15 server-003 CRON[7]: session opened",
]
TREE = [
    readers.Match(r"CRON", drop=True),
    readers.Match(
        r"^(\w+ +\d+ [\d:]+) (?P<host>\S+) (.*)$",
        {"host": r"\g<host>"},
        ("creation", 1, "MMM d HH:mm:ss", 2010),
        then=[
            readers.Match(r"(Failed|Accepted) password for (?P<user>\w+) from (\S+)", {"attributes.username": r"\g<user>", "attributes.srchost": r"\3"}, then=[readers.Match("Failed", {"name": "SSH:LOGIN:FAILED"}), readers.Match("Accepted", {"name": "SSH:LOGIN:SUCCESS"})]),
            readers.Match(r".*", {"name": "SYSLOG:UNKNOWN", "attributes.logline": r"\g<0>".replace("g<0>", "0")}),
        ],
    ),
]


def test_syslog(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, "nothing"]], "value string")
    got = {r["name"]: r for r in readers.parse_lines(df, TREE, "here", F.lit(7).cast("long")).collect()}
    assert set(got) == {"SSH:LOGIN:FAILED", "SSH:LOGIN:SUCCESS", "SYSLOG:UNKNOWN"}
    failed = got["SSH:LOGIN:FAILED"]
    assert (failed["host"], failed["attributes"], failed["creation"]) == ("server-002", {"username": "root", "srchost": "10.0.2.68"}, 1265611932)
    assert got["SYSLOG:UNKNOWN"]["attributes"] == {"logline": LINES[2]}


def test_default_host(spark):
    df = spark.createDataFrame([("x",)], "value string")
    row = readers.parse_lines(df, [readers.Match("x", {"name": "X"})], "here", F.lit(7).cast("long")).first()
    assert (row["host"], row["creation"], row["attributes"]) == ("here", 7, {})


def test_round_trips(spark, tmp_path):
    rows = [{"id": str(k), "name": f"N{k}", "host": "h", "type": "compressed" if k % 2 else "raw", "count": k if k % 2 else None, "creation": k, "arrival": k, "attributes": {"a": f"<&\"'> {k}", "b": ""}} for k in range(20)]
    df = events(spark, rows).withColumn("references", F.create_map(F.lit("child"), F.array(F.lit("1"), F.lit("2")))).withColumn("history", F.array(actions.entry("g", "r", F.col("arrival"), ["status"], "why")))
    keep = ["id", "name", "host", "description", "type", "status", "count", "creation", "attributes", "references", "history"]
    for write, read in ((writers.write_xml, readers.xml), (writers.write_json, readers.json)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        assert sorted(map(str, read(spark, path).select(*keep).collect())) == sorted(map(str, df.select(*keep).collect()))


def test_csv(spark, tmp_path):
    (tmp_path / "dump.csv").write_text('MESSAGE,SHORT_NAME,NAME,LOG_DATE,DB_DATE\n"a, ""b""",h,N,1970-01-01 00:00:05,1970-01-01 00:01:00\n')
    row = readers.csv_dump(spark, str(tmp_path / "dump.csv")).first()
    assert (row["host"], row["name"], row["creation"], row["arrival"], row["attributes"]) == ("h", "N", 5, 60, {"log": 'a, "b"'})
    assert readers.csv_dump(spark, str(tmp_path / "dump.csv"), 9).first()["arrival"] == 9
    (tmp_path / "bad.csv").write_text("NAME\nx\n")
    with pytest.raises(ValueError):
        readers.csv_dump(spark, str(tmp_path / "bad.csv"))


def test_lines_and_letters(spark, tmp_path):
    df = events(spark, [{"id": "1", "creation": 4}])
    writers.write_lines(df, str(tmp_path / "out"))
    assert [r["value"] for r in readers.lines(spark, str(tmp_path / "out")).collect()] == ["A (type: raw, status: active, host: x, creation: 4)"]
    got = readers.letters(spark.createDataFrame([("aé1 b",)], "t string"), F.col("t")).collect()
    assert [(r["position"], r["letter"]) for r in got] == [(0, "a"), (1, "é"), (4, "b")]


def test_fan_out(spark, tmp_path):
    got = []
    writers.fan_out([lambda df, k: got.append((k, df.count())), lambda df, k: writers.write_json(df, str(tmp_path / "j"))])(events(spark, [{"id": "1"}]), 3)
    assert got == [(3, 1)] and readers.json(spark, str(tmp_path / "j")).count() == 1
