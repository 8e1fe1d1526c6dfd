"""Time frames that do not put a whole key into one task.

A sliding frame [t - age, t] needs rows of the last `age` seconds only. So time is cut into buckets of WIDTH times the age, rows of a
bucket's last `age` seconds are copied into the next bucket, and windows are partitioned by key and bucket: a key that has a third of
all rows is spread over as many tasks as it has buckets, for 1/WIDTH more rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 8


class Frames:
    """df dealt out by (keys, bucket) for frames of `age` seconds up to a row's time; close() leaves the rows of df."""

    def __init__(self, df: DataFrame, keys: Sequence[str], time: str, age: int):
        if age < 0:
            raise ValueError("age: not negative")
        self.age, self.time = age, time
        width = max(age, 1) * WIDTH
        at = F.floor(F.col(time) / width)
        late = F.col(time) >= (at + 1) * width - age
        buckets = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
        self.rows = df.withColumn("_buckets", buckets).select("*", F.explode("_buckets").alias("_bucket")).drop("_buckets")
        self.own = F.floor(F.col(time) / width).eqNullSafe(F.col("_bucket"))  # rows without a time stay
        self.by = [*keys, "_bucket"]

    def frame(self) -> WindowSpec:
        """[t - age, t], equal times included."""
        return W.partitionBy(*self.by).orderBy(F.col(self.time)).rangeBetween(-self.age, 0)

    def before(self, last: int = -1) -> WindowSpec:
        """All earlier rows of the bucket, up to `last` seconds from the row."""
        return W.partitionBy(*self.by).orderBy(F.col(self.time)).rangeBetween(W.unboundedPreceding, last)

    def close(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.own).drop("_bucket")


def compared(count: Column, threshold: int, op: str) -> Column:
    if op not in ("eq", "ge", "le"):
        raise ValueError(f"op: eq, ge or le, not {op}")
    return {"eq": count == threshold, "ge": count >= threshold, "le": count <= threshold}[op]
