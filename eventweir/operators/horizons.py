"""How long events are delayed and kept: horizons, occupancy of the cache, and the order in which events leave."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Horizon:
    """What a query may still want of an event: rows that it selects, for max_age seconds after their time_source."""

    rule: str
    query: str
    where: Column
    max_age: int
    time_source: str = "arrival"
    delay: bool = False


def delay_and_cache_time(df: DataFrame, horizons: Sequence[Horizon]) -> DataFrame:
    """Adds delay_time and cache_time: the latest horizon of the delaying and of all queries; neither before creation or arrival, and
    an event is kept at least as long as it is delayed."""
    ends = lambda which: [F.when(F.coalesce(h.where, F.lit(True)), F.col(h.time_source) + h.max_age) for h in which]
    base = F.greatest("creation", "arrival")
    delay = F.greatest(base, base, *ends(h for h in horizons if h.delay))
    return df.withColumn("delay_time", delay).withColumn("cache_time", F.greatest(F.col("delay_time"), base, *ends(h for h in horizons if not h.delay)))


def occupancy(df: DataFrame, begin: str = "arrival", end: str = "cache_time", bucket: int = 3600) -> DataFrame:
    """Rows (at, held): the number of events held from each time at which it changes.

    A running sum in two levels: totals of buckets of `bucket` seconds (few rows), and inside each bucket.
    """
    steps = df.select(F.col(begin).alias("at"), F.lit(1).alias("d")).unionAll(df.select((F.col(end) + 1).alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy("at").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("bucket", F.floor(F.col("at") / bucket))
    totals = steps.groupBy("bucket").agg(F.sum("d").alias("d"))
    totals = totals.select("bucket", (F.sum("d").over(W.orderBy("bucket")) - F.col("d")).alias("before"))
    inside = F.sum("d").over(W.partitionBy("bucket").orderBy("at"))
    return steps.withColumn("inside", inside).join(totals, "bucket").select("at", (F.col("before") + F.col("inside")).alias("held"))


def forward_order(df: DataFrame, columns: Sequence[str] = ("delay_time", "creation", "id")) -> DataFrame:
    """Rows in the order in which they leave: range-partitioned, then sorted."""
    return df.orderBy(*columns)


def unaccounted(df: DataFrame, at: int) -> DataFrame:
    """Rows that at that time are still held though no horizon and no context asks for it. df has delay_time and delay_contexts."""
    return df.where((F.col("delay_time") < at) & (F.size("delay_contexts") == 0) & ~F.col("forwarded"))


def longest(horizons: Sequence[Horizon], names: DataFrame) -> DataFrame:
    """Rows (name, time_source, delay, rule, query, max_age): for each event name that occurs, the longest horizon per time source and
    kind that may select it."""
    rows = None
    for h in horizons:
        one = names.where(F.coalesce(h.where, F.lit(True))).select("name", F.lit(h.time_source).alias("time_source"), F.lit(h.delay).alias("delay"), F.lit(h.rule).alias("rule"), F.lit(h.query).alias("query"), F.lit(h.max_age).cast("long").alias("max_age")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    best = F.max_by(F.struct("rule", "query", "max_age"), F.struct("max_age", "rule", "query")).alias("best")
    return rows.groupBy("name", "time_source", "delay").agg(best).select("name", "time_source", "delay", "best.*")
