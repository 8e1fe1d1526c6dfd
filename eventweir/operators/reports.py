"""Counters and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.schema import effective_count


def counters(df: DataFrame, *by: str) -> DataFrame:
    """total, active, and weighted: a compressed event weighs as many as it holds."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.sum(effective_count()).cast("long").alias("weighted"))


def rule_statistics(firings: DataFrame) -> DataFrame:
    """From rows (group, rule, condition): executions, and how often the condition held or not, per rule, per group and in total."""
    return firings.rollup("group", "rule").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("executed"), F.count_if(F.col("condition")).alias("held"), F.count_if(~F.col("condition")).alias("failed"))


def balance(df: DataFrame) -> DataFrame:
    """One row: events by disposition, and difference, which is 0 if none is lost. disposition: input or new, and fate: waiting,
    delayed, dropped, compressed or output."""
    fate = lambda f: F.count_if(F.col("fate") == f)
    rows = df.agg(F.count_if(F.col("disposition") == "input").alias("input"), F.count_if(F.col("disposition") == "new").alias("new"), *[fate(f).alias(f) for f in ("waiting", "delayed", "dropped", "compressed", "output")])
    lost = F.col("input") + F.col("new") - F.col("waiting") - F.col("delayed") - F.col("dropped") - F.col("compressed") - F.col("output")
    return rows.withColumn("difference", lost)


def rate(df: DataFrame, *by: str, time: str = "arrival") -> DataFrame:
    """Events per minute between the first and the last; null for a single time."""
    minutes = (F.max(time) - F.min(time)) / 60
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") / F.nullif(minutes, F.lit(0.0))).alias("per_minute"))


def per_minute(df: DataFrame, *by: str, time: str = "arrival") -> DataFrame:
    return df.groupBy(*by, (F.floor(F.col(time) / 60) * 60).alias("minute")).agg(F.count("*").alias("n"))


def trail(df: DataFrame) -> DataFrame:
    """The history of all events, one row per entry: id, position, groupname, rulename, host, timestamp, fields, reason."""
    rows = df.select("id", F.posexplode("history").alias("position", "h"))
    return rows.select("id", "position", "h.rule.groupname", "h.rule.rulename", "h.host", "h.timestamp", F.array_join("h.fields", ",").alias("fields"), "h.reason")


def digest(df: DataFrame, keys: Sequence[str], line: Column, heading: Column | str) -> DataFrame:
    """One message per key: a heading and the lines of its events by creation, then id. keys bound their rows (an alert and a day)."""
    own = F.array_sort(F.collect_list(F.struct("creation", "id", line.alias("line"))))
    head = heading if isinstance(heading, Column) else F.lit(heading)
    lines = F.array_join(F.transform("_own", lambda x: x["line"]), "\n")
    return df.groupBy(*keys).agg(own.alias("_own")).select(*keys, F.size("_own").cast("long").alias("events"), F.concat(head, F.lit("\n"), lines).alias("body"))
