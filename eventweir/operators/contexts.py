"""Contexts: named timers with a counter, as windows over the events of a key.

A context opened at t0 with timeout T lives for t0 <= t <= t0 + T and fires at t0 + T + 1. Three kinds of windows: anchored (the first
event opens one, events inside do not prolong it), repeating (it starts again as soon as it has fired), session (each event restarts the
timer).

Windows depend on a key's distinct seconds only, so these are taken first (a partial aggregation); what one task sees of a key is bounded
by the length of the log, however many rows the key has. Rows get their window back by a join on (key, second).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.functions.schema import ENGINE_HOST, event_id
from eventweir.operators.frames import Frames, compared
from eventweir.sources.scratch import written


def anchors(times: np.ndarray, timeout: int) -> np.ndarray:
    """Index of the window that each of the ascending times falls into."""
    starts, at = [], 0
    while at < len(times):
        starts.append(at)
        at = int(np.searchsorted(times, times[at] + timeout, "right"))
    out = np.zeros(len(times), np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def _seconds(df: DataFrame, keys: Sequence[str], time: str, *more: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in (time, *more)]).where(F.col(time).isNotNull()).distinct()


def _back(df: DataFrame, windows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    windows = windows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_time"), "win_seq", "win_start")
    same = F.col(time) == F.col("_time")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(windows, same).drop("_time", *[f"_{k}" for k in keys])


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def _joined(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the other columns of the table, a row per key; null is a key."""
    named = table.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(named, _same(keys, "_j_")).drop(*[f"_j_{k}" for k in keys])


def _segments(seconds: DataFrame, keys: Sequence[str], time: str, due: str, timeout: int, block: int) -> DataFrame:
    """seconds with _segment, its first time, and _first and _last of it, worked out in blocks of time: what lies before a block is told by a
    row per block, so no task has all seconds of a key."""
    by = [*keys, "_block"]
    rows = written(seconds.withColumn("_block", F.floor(F.col(time) / block)), "seconds")
    ends = rows.groupBy(*by).agg(F.max(time).alias("_end"))
    ends = ends.withColumn("_prev", F.lag("_end").over(W.partitionBy(*keys).orderBy("_block"))).drop("_end")
    before = F.coalesce(F.lag(time).over(W.partitionBy(*by).orderBy(time)), F.col("_prev"))
    rows = _joined(rows, ends, by).withColumn("_start", F.when(F.coalesce(F.col(due) - before > timeout, F.lit(True)), F.col(time)))
    rows = written(rows.drop("_prev"), "seconds-starts")
    carry = F.max("_latest").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carry")
    latest = rows.groupBy(*by).agg(F.max("_start").alias("_latest")).select(*by, carry)
    inside = F.max("_start").over(W.partitionBy(*by).orderBy(time).rowsBetween(W.unboundedPreceding, 0))
    rows = _joined(rows, latest, by).withColumn("_segment", F.coalesce(inside, F.col("_carry"))).drop("_block", "_start", "_carry")
    limits = rows.groupBy(*keys, "_segment").agg(F.min(time).alias("_first"), F.max(due).alias("_last"))
    return _joined(rows, limits, [*keys, "_segment"])


def anchored(df: DataFrame, keys: Sequence[str], timeout: int, time: str = "arrival", due: str | None = None, block: int | None = None) -> DataFrame:
    """Rows with win_seq (from 0, per key) and win_start. Rows without a time are left out.

    due: a column that says when a row asks to be let in, if not at its time (it may not fall as time goes on in a key, and is one per key
    and second): a window takes rows that are due by win_start + timeout; win_start is the time of its first row.

    A gap above the timeout always begins a window, so gaps cut a key's seconds into independent segments. Segments shorter than the
    timeout are one window; the others are scanned in Arrow batches that carry the open window over, jumping from anchor to anchor.

    block: with very few keys, or one that has most of the log, look for gaps and number windows in blocks of so many seconds, so that a
    task has a block's seconds or a segment's; else a task has a key's.
    """
    by = W.partitionBy(*keys).orderBy(time)
    seconds = _seconds(df, keys, time, *([due] if due else []))
    due = due or time
    if block:
        return _windows(df, _segments(seconds, keys, time, due, timeout, block), keys, timeout, time, due, True)
    seconds = seconds.withColumn("_new", F.coalesce((F.col(due) - F.lag(time).over(by) > timeout).cast("long"), F.lit(0)))
    seconds = seconds.withColumn("_segment", F.sum("_new").over(by)).drop("_new")
    inside = W.partitionBy(*keys, "_segment")
    seconds = seconds.withColumn("_first", F.min(time).over(inside)).withColumn("_last", F.max(due).over(inside))
    return _windows(df, seconds, keys, timeout, time, due, False)


def _windows(df: DataFrame, seconds: DataFrame, keys: Sequence[str], timeout: int, time: str, due: str, apart: bool) -> DataFrame:
    """df with its windows, from its seconds cut into segments. apart: windows are numbered by themselves, not with all their seconds."""
    short = F.col("_last") - F.col("_first") <= timeout
    one = seconds.where(short).withColumn("win_start", F.col("_first"))
    long = seconds.where(~short)
    at = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(at, *keys, "_segment").sortWithinPartitions(*keys, "_segment", time)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times, dues = batch.column(time).to_numpy(), batch.column(due).to_numpy()
            parts = [batch.column(k).to_pylist() for k in (*keys, "_segment")]
            rows = list(zip(*parts, strict=True))
            starts = np.zeros(len(rows), np.int64)
            cuts = [0, *[k for k in range(1, len(rows)) if rows[k] != rows[k - 1]], len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if rows[a] != key:
                    key, anchor = rows[a], int(times[a])
                k = a
                while k < b:
                    if dues[k] > anchor + timeout:
                        anchor = int(times[k])
                    stop = max(a + int(np.searchsorted(dues[a:b], anchor + timeout, "right")), k + 1)
                    starts[k:stop] = anchor
                    k = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts)], schema=batch.schema.append(pa.field("win_start", pa.int64())))

    schema = T.StructType([*long.schema.fields, T.StructField("win_start", T.LongType())])
    windows = one.unionByName(long.mapInArrow(scan, schema))
    rank = (F.dense_rank().over(W.partitionBy(*keys).orderBy("win_start")) - 1).alias("win_seq")
    if apart:
        windows = written(windows, "windows")
        windows = _joined(windows, windows.select(*keys, "win_start").distinct().select(*keys, "win_start", rank), [*keys, "win_start"])
    else:
        windows = windows.select("*", rank)
    return _back(df, windows, keys, time)


def repeating(df: DataFrame, keys: Sequence[str], timeout: int, time: str = "arrival") -> DataFrame:
    """Rows with win_seq and win_start: windows follow each other without a break from the key's first time on."""
    first = df.groupBy(*keys).agg(F.min(time).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = df.join(first, same).drop(*[f"_{k}" for k in keys])
    seq = F.floor((F.col(time) - F.col("_first")) / (timeout + 1))
    return out.withColumn("win_seq", seq.cast("long")).withColumn("win_start", F.col("_first") + F.col("win_seq") * (timeout + 1)).drop("_first")


def sessions(df: DataFrame, keys: Sequence[str], timeout: int, time: str = "arrival") -> DataFrame:
    """Rows with win_seq and win_start: a gap above the timeout begins a window."""
    by = W.partitionBy(*keys).orderBy(time)
    seconds = _seconds(df, keys, time).withColumn("_new", F.coalesce((F.col(time) - F.lag(time).over(by) > timeout).cast("long"), F.lit(0)))
    seconds = seconds.withColumn("win_seq", F.sum("_new").over(by))
    return _back(df, seconds.withColumn("win_start", F.min(time).over(W.partitionBy(*keys, "win_seq"))), keys, time)


def associated(df: DataFrame, keys: Sequence[str], joins: Column, forgets: Column, time: str = "arrival", id_col: str = "id") -> DataFrame:
    """One row per window (keys include it) with event_ids, sorted: the events that `joins` selects after the last one that `forgets`
    does (which empties the list, then may join it itself). Aggregates only."""
    at = F.struct(time, id_col)
    last = df.groupBy(*keys).agg(F.max(F.when(forgets, at)).alias("_reset"))
    last = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_reset")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = df.join(last, same).withColumn("_kept", F.coalesce(joins, F.lit(False)) & (F.col("_reset").isNull() | (at >= F.col("_reset"))))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("_kept"), F.col(id_col)))).alias("event_ids"))


def counter(df: DataFrame, keys: Sequence[str], op: Column, value: Column, time: str = "arrival", id_col: str = "id", initial: int = 0, width: int = 3600) -> DataFrame:
    """Rows with counter: the running value after each row. keys include the window; op is set, inc, dec or null (no change).

    A set begins a new run; within a run the changes are summed. A key's rows are counted in blocks of `width` seconds, and what a block begins
    with follows from the ends of the blocks before it, so a long window is not one task's work.
    """
    step = F.coalesce(F.when(op.isin("set", "inc"), value).when(op == "dec", -value), F.lit(0)).cast("long")
    rows = df.withColumns({"_block": F.floor(F.col(time) / width), "_set": F.coalesce((op == "set").cast("int"), F.lit(0)), "_step": step})
    by, upto = [*keys, "_block"], (W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_set").over(W.partitionBy(*by).orderBy(time, id_col).rowsBetween(*upto)))
    rows = rows.withColumn("_own", F.sum("_step").over(W.partitionBy(*by, "_run").orderBy(time, id_col).rowsBetween(*upto)))
    blocks = rows.groupBy(*by).agg(F.max("_set").alias("_had"), F.max_by("_own", F.struct(time, id_col)).alias("_end"))
    blocks = blocks.withColumn("_since", F.sum("_had").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(*upto)))
    after = F.sum("_end").over(W.partitionBy(*keys, "_since").orderBy("_block").rowsBetween(*upto)) + F.when(F.col("_since") == 0, F.lit(initial)).otherwise(0)
    blocks = blocks.withColumn("_after", after).withColumn("_before", F.coalesce(F.lag("_after").over(W.partitionBy(*keys).orderBy("_block")), F.lit(initial)))
    blocks = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_before")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(blocks, same).withColumn("counter", (F.col("_own") + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0)).cast("long"))
    return out.drop("_block", "_set", "_step", "_run", "_own", "_before", *[f"_k_{k}" for k in by])


def contexts(df: DataFrame, keys: Sequence[str], timeout: int, time: str = "arrival", id_col: str = "id") -> DataFrame:
    """One row per window of df (with win_seq, win_start): start, end, counter (events), event_ids (sorted)."""
    # as many ids as the timeout lets in
    return df.groupBy(*keys, "win_seq", F.col("win_start").alias("start")).agg((F.first("win_start") + timeout).alias("end"), F.count("*").alias("counter"), F.array_sort(F.collect_set(id_col)).alias("event_ids"))


def timeouts(opened: DataFrame, keys: Sequence[str], name: str, until: int | None = None) -> DataFrame:
    """The timeout event of each context: at end + 1, with its events as children and its counter as an attribute."""
    at = F.col("end") + 1
    fired = opened if until is None else opened.where(at <= until)
    return fired.select(
        event_id(F.lit(name), *[F.col(k).cast("string") for k in keys], F.col("start").cast("string")).alias("id"),
        F.lit(name).alias("name"),
        F.lit(ENGINE_HOST).alias("host"),
        F.lit("timeout").alias("type"),
        F.lit("active").alias("status"),
        at.alias("creation"),
        at.alias("arrival"),
        *keys,
        F.create_map(F.lit("context_counter"), F.col("counter").cast("string")).alias("attributes"),
        F.create_map(F.lit("child"), F.col("event_ids")).alias("references"),
    )


def open_at(df: DataFrame, opening: Column, keys: Sequence[str], timeout: int, time: str = "arrival", id_col: str = "id", name: str = "context_start") -> DataFrame:
    """Rows of df with the start of their key's context that is open at their time, null if none is.

    Rows where `opening` holds open a context unless one is open. Only the openings are scanned for windows; each row then looks up
    the last start in the frame [t - timeout, t].
    """
    starts = anchored(df.where(opening), keys, timeout, time).select(*keys, "win_start").distinct()
    marks = starts.select(*keys, F.col("win_start").alias(time), F.col("win_start").alias("_start"), F.lit(False).alias("_row"))
    f = Frames(df.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True), keys, time, timeout)
    rows = f.rows.withColumn(name, F.max("_start").over(f.frame()))
    return f.close(rows).where("_row").drop("_row", "_start")


def counter_at(df: DataFrame, opening: Column, counted: Column, keys: Sequence[str], timeout: int, threshold: int, op: str, time: str = "arrival") -> DataFrame:
    """Rows with counter (rows where `counted` holds since the context's start, the row included; null without a context) and hit."""
    rows = open_at(df, opening, keys, timeout, time)
    within = W.partitionBy(*keys, "context_start").orderBy(time).rangeBetween(W.unboundedPreceding, 0)
    # rows without a context are left where they are
    inside = rows.where("context_start is not null").withColumn("counter", F.count(F.when(counted, 1)).over(within))
    rows = inside.unionByName(rows.where("context_start is null").withColumn("counter", F.lit(None).cast("long")))
    return rows.withColumn("hit", F.coalesce(compared(F.col("counter"), threshold, op), F.lit(False)))


def missing_followup(df: DataFrame, opening: Column, closing: Column, keys: Sequence[str], timeout: int, time: str = "arrival") -> DataFrame:
    """Openings that no closing row of the key follows (later, within the timeout)."""
    # the frame looks back, so time is turned round
    turned = df.where(opening | closing).withColumn("_turned", -F.col(time)).withColumn("_closes", F.when(closing, F.col(time)))
    f = Frames(turned, keys, "_turned", timeout)
    later = W.partitionBy(*f.by).orderBy("_turned").rangeBetween(-timeout, -1)
    rows = f.rows.withColumn("_next", F.min("_closes").over(later))
    return f.close(rows).where(opening & F.col("_next").isNull()).drop("_turned", "_closes", "_next")
