"""Readers: lines, nested regular expressions, CSV dumps, XML, JSON, letters, heartbeats; and streams of lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.functions.schema import EVENT_SCHEMA, with_defaults
from eventweir.functions.scalar import to_epoch

# Columns that a dump must have.
CSV_REQUIRED = ("SHORT_NAME", "NAME", "LOG_DATE", "DB_DATE", "MESSAGE")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (value, file, line): text files line by line; line ascends in a file, with gaps between its splits."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines over TCP. For development: it does not survive a restart; sources.sockets has offsets."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


@dataclass
class Match:
    """A node of a tree of patterns. A line goes down the first branches that match it (searched anywhere in the line).

    set: fields by name ("host", "attributes.user", ...): a text in which \\1 or \\g<name> stand for groups of this node's pattern.
    time: (field, group, format, year): a date without a year gets that one. A node with then is a branch; otherwise it ends the
    search: create makes an event, drop discards the line.
    """

    pattern: str
    set: dict[str, str] = field(default_factory=dict)
    time: tuple[str, int, str, int | None] | None = None
    then: Sequence[Match] = ()
    drop: bool = False


def java_pattern(pattern: str) -> str:
    """Named groups as Java writes them."""
    return pattern.replace("(?P<", "(?<")


def group_number(pattern: str, name: str) -> int:
    return int(name) if name.isdigit() else re.compile(pattern).groupindex[name]


def filled(text: str, pattern: str, line: Column) -> Column:
    """The text with its references to groups replaced; a group that did not take part is empty."""
    parts, at = [], 0
    for m in re.finditer(r"\\(?:g<(\w+)>|(\d))", text):
        parts += [F.lit(text[at : m.start()]), F.regexp_extract(line, java_pattern(pattern), group_number(pattern, m[1] or m[2]))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def leaves(tree: Sequence[Match], above: Sequence[Match] = ()) -> list[list[Match]]:
    """The paths from the root to all leaves, in the order in which they are tried."""
    return [path for node in tree for path in (leaves(node.then, [*above, node]) if node.then else [[*above, node]])]


def _first_path(tree: Sequence[Match], text: Column, numbers) -> Column:
    """The number of the first path through the tree that the text takes, -1 if it ends in drop, null if there is none. A pattern is
    tried once, and only where those above it are found."""
    tried = []
    for node in tree:
        end = _first_path(node.then, text, numbers) if node.then else F.lit(-1 if (next(numbers), node.drop)[1] else numbers.last)
        tried.append(F.when(text.rlike(java_pattern(node.pattern)), end))
    return F.coalesce(*tried)


class count:
    """0, 1, 2, ..; last is the number that came last."""

    def __init__(self):
        self.last = -1

    def __next__(self) -> int:
        self.last += 1
        return self.last


def parse_lines(df: DataFrame, tree: Sequence[Match], default_host: str, now: Column, line: str = "value") -> DataFrame:
    """Columns of df and name, host, description, creation, attributes for each line that a path of the tree turns into an event.

    The tree becomes one chain of conditions, evaluated in the JVM: the first path all of whose patterns are found decides. A line
    without a path, or whose path ends in drop, gives no row.
    """
    text = F.col(line)
    paths = leaves(tree)
    # explode evaluates the choice once a row; a filter on it would be pushed down and repeat it
    rows = df.select("*", F.explode(F.filter(F.array(_first_path(tree, text, count())), lambda k: k >= 0)).alias("_path"))
    fields: dict[str, Column] = {}
    times: dict[str, Column] = {}
    names = sorted({f for p in paths for n in p for f in n.set} | {n.time[0] for p in paths for n in p if n.time})
    for name in names:
        value: Column = F.lit(None)
        for k, path in enumerate(paths):
            own: Column | None = None
            for node in path:
                if name in node.set:
                    own = filled(node.set[name], node.pattern, text)
                if node.time and node.time[0] == name:
                    _, group, pattern, year = node.time
                    raw = F.regexp_extract(text, java_pattern(node.pattern), group)
                    own = to_epoch(raw, pattern) if year is None else to_epoch(F.concat(F.lit(f"{year} "), F.regexp_replace(raw, r"\s+", " ")), f"yyyy {pattern}")
            if own is not None and not path[-1].drop:
                value = F.when(F.col("_path") == k, own.cast("long") if name in ("creation", "arrival") else own).otherwise(value)
        (times if name in ("creation", "arrival") else fields)[name] = value
    keys = [n for n in names if n.startswith("attributes.")]
    entries = F.array(*[F.struct(F.lit(n.removeprefix("attributes.")).alias("key"), fields[n].cast("string").alias("value")) for n in keys]) if keys else F.array().cast("array<struct<key:string,value:string>>")
    return rows.select(
        *df.columns,
        F.coalesce(fields.get("name", F.lit(None)).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.nullif(fields.get("host", F.lit(None)).cast("string"), F.lit("")), F.lit(default_host)).alias("host"),
        F.coalesce(fields.get("description", F.lit(None)).cast("string"), F.lit("-")).alias("description"),
        F.coalesce(times.get("creation", F.lit(None)).cast("long"), now).alias("creation"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("attributes"),
    )


def csv_dump(spark: SparkSession, path: str, load_time: int | None = None, multi_line: bool = False) -> DataFrame:
    """Events from CSV files with a header. load_time: overwrite the arrival with it. multi_line: fields may hold line breaks; then a
    file is read by one task, else it is split."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if missing := set(CSV_REQUIRED) - set(raw.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return from_csv_rows(raw, load_time)


def from_csv_rows(raw: DataFrame, load_time: int | None = None) -> DataFrame:
    pairs = [F.lit("log"), F.coalesce("MESSAGE", F.lit(""))]
    attributes = F.create_map(*pairs)
    if "INTERNAL_CODE" in raw.columns:
        attributes = F.when(F.col("INTERNAL_CODE").isNull(), attributes).otherwise(F.create_map(*pairs, F.lit("service"), F.col("INTERNAL_CODE")))
    arrival = F.lit(load_time).cast("long") if load_time is not None else to_epoch(F.col("DB_DATE"))
    return raw.select(F.col("SHORT_NAME").alias("host"), F.col("NAME").alias("name"), to_epoch(F.col("LOG_DATE")).alias("creation"), arrival.alias("arrival"), attributes.alias("attributes"))


def unsorted_arrivals(df: DataFrame, order: Sequence[str], per: Sequence[str], time: str = "arrival") -> DataFrame:
    """Rows that arrived before an earlier row of the same `per` (a file, a day of a source), with the running maximum as latest."""
    before = W.partitionBy(*per).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("latest", F.max(time).over(before)).where(F.col(time) < F.col("latest"))


XML_SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("name", "description", "id", "type", "status")],
        T.StructField("count", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("creation", T.LongType()),
        T.StructField("attributes", T.StructType([T.StructField("attribute", T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())])))])),
        T.StructField("references", T.StructType([T.StructField("reference", T.ArrayType(T.StructType([T.StructField("_type", T.StringType()), T.StructField("_VALUE", T.StringType())])))])),
        T.StructField(
            "history",
            T.StructType(
                [
                    T.StructField(
                        "entry",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("_groupname", T.StringType()),
                                    T.StructField("_rulename", T.StringType()),
                                    T.StructField("_host", T.StringType()),
                                    T.StructField("_timestamp", T.LongType()),
                                    T.StructField("field", T.ArrayType(T.StringType())),
                                    T.StructField("reason", T.StringType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)


def from_xml_rows(x: DataFrame) -> DataFrame:
    """Events from rows in XML_SCHEMA. A row whose creation or count is not a number has null there; validation rejects it."""
    # of attributes with one key the last counts
    entries = F.filter(F.coalesce(F.col("attributes.attribute"), F.array()), lambda a: a["_key"].isNotNull())
    keys = F.array_distinct(F.transform(entries, lambda a: a["_key"]))
    attributes = F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(F.filter(entries, lambda a: a["_key"] == k), -1)["_VALUE"], F.lit(""))))
    refs = F.coalesce(F.col("references.reference"), F.array())
    kinds = F.array_sort(F.array_distinct(F.transform(refs, lambda r: r["_type"])))
    references = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(F.filter(refs, lambda r: r["_type"] == k), lambda r: r["_VALUE"])))
    history = F.transform(
        F.coalesce(F.col("history.entry"), F.array()),
        lambda h: F.struct(F.struct(h["_groupname"].alias("groupname"), h["_rulename"].alias("rulename")).alias("rule"), h["_host"].alias("host"), h["_timestamp"].alias("timestamp"), F.coalesce(h["field"], F.array().cast("array<string>")).alias("fields"), h["reason"].alias("reason")),
    )
    rows = x.select("name", "host", "description", "id", "type", "status", F.when(F.col("type") == "compressed", F.col("count")).alias("count"), "creation", attributes.alias("attributes"), references.alias("references"), history.alias("history"))
    return with_defaults(rows, F.col("creation"))


def xml(spark: SparkSession, path: str) -> DataFrame:
    return from_xml_rows(spark.read.format("xml").option("rowTag", "event").schema(XML_SCHEMA).load(path))


def json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def letters(df: DataFrame, text: Column) -> DataFrame:
    """Columns of df, position (from 0) and letter: each letter of the text is an event, anything else is passed over."""
    return df.select("*", F.posexplode(F.split(text, "")).alias("position", "letter")).where(F.col("letter").rlike(r"^\p{L}$"))


def heartbeats(spans: DataFrame, interval: int, name: str = "HEARTBEAT") -> DataFrame:
    """From rows (begin, end, ..): an event every `interval` seconds of each span, its other columns carried."""
    at = F.explode(F.sequence("begin", "end", F.lit(interval).cast("long")))
    return spans.select(*[c for c in spans.columns if c not in ("begin", "end")], F.lit(name).alias("name"), at.alias("arrival"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows, with source_num: which source, from 0."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_num", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out
