"""Shared parts of the operators: scratch tables, batches of texts, connected components, verification inside buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.sources.scratch import scratch_path, shared_dir, sized, written  # noqa: F401

#: Members of a bucket that meet in one task are at most twice this many; larger buckets are dealt out as pairs of blocks. In a task
#: they are compared in tiles.
BLOCK, TILE = 2048, 128
#: Keys that hold more than this part of all rows are joined by broadcast; there are at most so many of them.
HUBS = 10_000
#: Groups up to this size are first searched for any link at all, many groups at once.
SMALL = 16
#: Texts that are turned into Python strings at once.
CHUNK = 256


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table dealt out anew if it lies in fewer files than there are cores (the listing of files tells): a small table in one file may
    be one task's work else. A table of many files is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


_held: dict = {}


def held(key, make: Callable):
    """What a worker process remembers between batches and tasks: one object. What an earlier stage of another kind left is dropped."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def with_columns(df: DataFrame, inputs: list[str], added: str, make: Callable) -> DataFrame:
    """df and the columns of the schema `added`. make gets a list per input column, for a chunk of rows at a time, and returns an
    array or list per added column. Rows pass through as Arrow data; only the inputs of a chunk become Python objects."""
    more = T.StructType.fromDDL(added)
    names = [f.name for f in more]
    kept = df.select(*[c for c in df.columns if c not in names])
    types = [ARROW[f.dataType.simpleString()] for f in more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = make(*[batch.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, t) for x, t in zip(made, types, strict=True)]], [*batch.schema.names, *names])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, *more.fields]))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs that begin at starts and have the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def joined_by_hubs(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows joined with table, a row per key with n, how many of rows have it; total: how many rows there are, at least.

    A key with more than total / HUBS rows would gather them in one task of a shuffle. There are fewer than HUBS such keys, so they are
    broadcast and their rows stay where they are; only the other rows are shuffled. The table should be a written one."""
    limit = max(total // HUBS, 1)
    hubs = table.where(F.col("n") > limit)
    if not hubs.limit(1).count():
        return rows.join(table, key)
    few = rows.join(F.broadcast(hubs), key)
    many = rows.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(table.where(F.col("n") <= limit), key)
    return few.unionByName(many)


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """Components of a graph given as rows (a, b) of long ids: rows (id, component), the component being its smallest id.

    Large-star and small-star steps (joins with a minimum per node) until every edge points at a root. Each step is a written
    table; nothing but two sums per step comes to the driver. Nulls and loops are left out; no edges give no rows. A node with very
    many edges does not gather them in one task.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    lowest = lambda e: written(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{name}-least")
    edges, before = written(ordered(edges), name), None
    while (now := state(edges)) != before:
        before = now
        around = both(edges)
        least = lowest(around).select("a", F.least("a", "m").alias("m"), "n")
        large = ordered(joined_by_hubs(around.where("b > a"), least, ["a"], 2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large, name)
        least = lowest(large)
        small = joined_by_hubs(large, least, ["a"], now[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(ordered(small), name)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def within_buckets(rows: DataFrame, payload: DataFrame, test, name: str) -> tuple[DataFrame, DataFrame]:
    """Verifies candidate pairs that share a bucket.

    rows: (bucket long, id long, maybe further columns that the test reads), an id once per bucket. payload: (id, weight, then columns
    that the test reads), one row per id. test.prepare(rows) gets a dict of arrays and returns it as the test wants it.
    test.matrix(left, right) gets two such dicts and returns two boolean matrices: which pairs link, and which of those this bucket is to
    count (each link is counted by one of its buckets). test.pairs(rows, i, j) tells which of the pairs of rows link.
    Returns (edges, counts): edges (a, b) that connect what links connect, at most one per member of a block, and counts (id, n) where n
    sums the other side's column weight over the counted links. No pair becomes a row.

    A bucket of more than BLOCK members is dealt out as pairs of blocks, so that no task gets more than two blocks at once and every
    pair of its members still meets once.
    """
    spark = rows.sparkSession
    full = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-sizes")
    total = full.agg(F.sum("n")).first()[0] or 0
    rows = joined_by_hubs(rows, full, ["bucket"], total)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).drop("n")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("parts", "other")
    key = ["bucket", "low", "high"]
    rows = rows.join(payload, "id")
    if hasattr(test, "reduce"):
        rows = test.reduce(rows)
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(at, *key).sortWithinPartitions(*key, "id")
    found = rows.mapInArrow(lambda batches: verify(batches, test), "a long, b long, n long")
    found = written(found, f"{name}-found")
    return found.where("b is not null").select("a", "b").distinct(), found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with one key, and where each group begins, from batches sorted by key. Holds a batch and the
    group that is open at its end."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        starts = group_starts(rest, key)
        if len(starts) > 1:
            yield rest.slice(0, starts[-1]), starts[:-1]
            rest = rest.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, group_starts(rest, key)


def group_starts(table: pa.Table, key: list[str]) -> np.ndarray:
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in key:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def columns(table: pa.Table) -> dict:
    """A column of numbers as an array, one of binaries as an array of bytes objects, one of lists as an array of arrays."""
    out = {}
    for name in table.column_names:
        c = table.column(name).combine_chunks()
        if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            out[name] = np.empty(len(c), object)
            out[name][:] = c.to_pylist()
        elif pa.types.is_list(c.type):
            out[name] = np.empty(len(c), object)
            values, ends = c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy()).tolist()
            out[name][:] = [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def with_links(x: dict, starts: np.ndarray, sizes: np.ndarray, pairs: Callable) -> np.ndarray:
    """Which groups to look at: those of more than SMALL members, and those where any two members link."""
    look = sizes > SMALL
    group = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((group[:-step] == group[step:]) & ~look[group[step:]])
        if i.size:
            look[group[i[pairs(x, i, i + step)]]] = True
    return np.flatnonzero(look)


def verify(batches: Iterator[pa.RecordBatch], test) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(k, pa.int64()) for k in "abn"])
    for table, starts in whole_groups(batches, ["bucket", "low", "high"]):
        x = test.prepare(columns(table))
        sizes = np.diff(np.append(starts, table.num_rows))
        made = [verified({k: v[starts[g] : starts[g] + sizes[g]] for k, v in x.items()}, test) for g in with_links(x, starts, sizes, test.pairs).tolist()]
        made = [m for m in made if m is not None]
        if made:
            a, b, n = (np.concatenate(c) for c in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=a == b), pa.array(n)], schema=schema)


def verified(x: dict, test) -> tuple | None:
    """Of one group: the ids that link, the smallest id that links reach from each inside the group, and its counted weight."""
    ids = x["id"]
    within = x["low"][0] == x["high"][0]
    left = np.arange(len(ids)) if within else np.flatnonzero(x["own"] == x["low"])
    right = left if within else np.flatnonzero(x["own"] != x["low"])
    n, u, v = np.zeros(len(ids), np.int64), [], []
    top = np.iinfo(np.int64).max
    for a in range(0, len(left), TILE):
        some = left[a : a + TILE]
        l = {k: c[some] for k, c in x.items()}  # noqa: E741
        for b in range(a if within else 0, len(right), TILE):
            same, others = within and a == b, right[b : b + TILE]
            r = l if same else {k: c[others] for k, c in x.items()}
            links, counted = test.matrix(l, r)
            if same:
                np.fill_diagonal(links, False)
            if not links.any():
                continue
            counted &= links
            n[some] += counted @ r["weight"]
            if not same:
                n[others] += l["weight"] @ counted
            # places of the smallest that links reach inside the tile
            of_some, of_others = some.copy(), others.copy()
            while True:
                new_some = np.minimum(of_some, np.where(links, of_others[None, :], top).min(1))
                new_others = new_some if same else np.minimum(of_others, np.where(links, new_some[:, None], top).min(0))
                if (new_some == of_some).all() and (new_others == of_others).all():
                    break
                of_some, of_others = new_some, new_others
            u += [some, others]
            v += [of_some, of_others]
    if not u:
        return None
    u, v = np.concatenate(u), np.concatenate(v)
    u, v = u[u != v], v[u != v]
    of = np.arange(len(ids))  # members are sorted by id
    while True:
        old = of.copy()
        np.minimum.at(of, u, of[v])
        np.minimum.at(of, v, of[u])
        if (of == old).all():
            break
    linked = np.unique(np.concatenate([u, v]))
    return ids[linked], ids[of[linked]], n[linked]
