"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and the master is this machine (tests), a temporary folder, which is then set."""
    if not (where := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster scratch tables need a folder that all share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/eventweir-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the scratch tables that this process has made, and says how many. Call it when results that read them are written."""
    paths, _made[:] = list(_made), []
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def sized(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table with a broadcast hint if a count shows that it has at most so many rows; else with one for a merge join, as Spark would
    broadcast millions of narrow rows whose compressed file is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
