"""Turns of conversations in order, however long a conversation is.

Rows are sorted by a range partitioning on conversation and turn, so a long conversation is cut into fragments (the rows of one
conversation in one partition) and no task gets more than its share of rows. A conversation that lies in several partitions is one of at
most two per partition, so whatever is told about such fragments is a table of as many rows as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweir.llm.common import written

#: Positions of one block of suffix_sums().
BLOCK = 4096


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: of its role's length in bytes, role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows sorted by order over all partitions, with uid (long, ascending in that order) and part (long, the partition). Not a
    written table: a second look may number other rows."""
    at = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(at, *order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id())
    return out.withColumn("part", F.shiftright("uid", 33))


def suffix_sums(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """rows with each of the values replaced by its sum over the rows of the key whose position is not below the row's. Positions are
    unique in a key; sums are taken in blocks of positions first, so a long key is not one task's work."""
    rows = written(rows.withColumn("_block", F.floor(F.col(at) / BLOCK)), "suffix-rows")
    later = W.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), *[F.sum(f"_t_{v}").over(later.partitionBy(key)).alias(f"_l_{v}") for v in values])
    totals = totals.where(F.col(f"_l_{values[0]}").isNotNull())
    inside = W.partitionBy(key, "_block").orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(*[F.sum(c).over(inside).alias(c) if c in values else F.col(c) for c in rows.columns])
    rows = rows.join(totals, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")), "left")
    rows = rows.withColumns({v: F.col(v) + F.coalesce(F.col(f"_l_{v}"), F.lit(0)) for v in values})
    return rows.drop("_block", "_b", "_key", *[f"_l_{v}" for v in values])
