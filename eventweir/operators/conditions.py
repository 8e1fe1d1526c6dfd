"""Conditions on the events that a query sees: counts, sequences, closeness in time, symbol patterns.

Each has a sliding form, one answer per row over the frame [t - age, t] of its key, and most a form per key. Queries are boolean
Columns. The sliding forms add a column and keep every row; several of them on one key share a shuffle if they share a Frames.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.operators import sweeps
from eventweir.operators.automata import Automaton
from eventweir.operators.frames import Frames, compared


def count_sliding(df: DataFrame, query: Column, keys: Sequence[str], age: int, time: str = "arrival", name: str = "n") -> DataFrame:
    """How many rows the query selects in the frame of each row."""
    f = Frames(df, keys, time, age)
    return f.close(f.rows.withColumn(name, F.count(F.when(query, 1)).over(f.frame())))


def count_by(df: DataFrame, query: Column, keys: Sequence[str], threshold: int, op: str = "ge") -> DataFrame:
    """Per key: n and hit."""
    n = F.count_if(query)
    return df.groupBy(*keys).agg(n.alias("n")).withColumn("hit", compared(F.col("n"), threshold, op))


def sequence_any_sliding(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, time: str = "arrival", name: str = "hit") -> DataFrame:
    """Whether the frame of each row has times t1 < t2 < .. < tn, one of each query in order. Up to one query: true.

    Of each query's rows the latest possible start of a chain that ends there is carried on, so one sort serves the whole chain.
    """
    if len(queries) <= 1:
        return df.withColumn(name, F.lit(True))
    f = Frames(df, keys, time, age)
    rows = f.rows.withColumn("_start0", F.when(queries[0], F.col(time)))
    for k, query in enumerate(queries[1:], 1):
        rows = rows.withColumn(f"_start{k}", F.when(query, F.max(f"_start{k - 1}").over(f.before())))
    begun = F.max(f"_start{len(queries) - 1}").over(f.frame())
    rows = rows.withColumn(name, F.coalesce(begun >= F.col(time) - age, F.lit(False)))
    return f.close(rows).drop(*[f"_start{k}" for k in range(len(queries))])


def sequence_all_by(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], time: str = "creation", name: str = "hit") -> DataFrame:
    """Per key: whether each query's rows all come before the next one's. A query without rows: false. Up to one query: true."""
    ends = [x for k, q in enumerate(queries) for x in (F.min(F.when(q, F.col(time))).alias(f"_low{k}"), F.max(F.when(q, F.col(time))).alias(f"_high{k}"))]
    hit = F.lit(True)
    for k in range(len(queries) - 1):
        hit = hit & (F.col(f"_high{k}") < F.col(f"_low{k + 1}"))
    grouped = df.groupBy(*keys).agg(*ends) if ends else df.select(*keys).distinct()
    return grouped.select(*keys, F.coalesce(hit, F.lit(False)).alias(name))


def sequence_all_sliding(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, time: str = "arrival", sort: str | None = None, name: str = "hit") -> DataFrame:
    """Whether in the frame of each row each query's rows all come before the next one's, by the axis `sort` (default: the frame's)."""
    if len(queries) <= 1:
        return df.withColumn(name, F.lit(True))
    f, at = Frames(df, keys, time, age), F.col(sort or time)
    rows, hit = f.rows, F.lit(True)
    for k, q in enumerate(queries):
        rows = rows.withColumn(f"_low{k}", F.min(F.when(q, at)).over(f.frame())).withColumn(f"_high{k}", F.max(F.when(q, at)).over(f.frame()))
        if k:
            hit = hit & (F.col(f"_high{k - 1}") < F.col(f"_low{k}"))
    return f.close(rows.withColumn(name, F.coalesce(hit, F.lit(False)))).drop(*[f"_{x}{k}" for x in ("low", "high") for k in range(len(queries))])


def sequence_any_by(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], time: str = "creation", name: str = "hit") -> DataFrame:
    """Per key: whether there are times t1 < t2 < .. < tn, one of each query in order. Up to one query: true. An aggregation per query,
    of the earliest time after the one before; a null key is a key."""
    reached = df.select(*keys).distinct()
    if len(queries) <= 1:
        return reached.withColumn(name, F.lit(True))
    kind = [F.coalesce(q, F.lit(False)).alias(f"_q{k}") for k, q in enumerate(queries)]
    rows = df.select(*keys, F.col(time).alias("_t"), *kind).where(F.greatest(*[F.col(f"_q{k}") for k in range(len(queries))]))
    own = [F.col(k).alias(f"_k_{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = rows.groupBy(*keys).agg(F.min(F.when(F.col("_q0"), F.col("_t"))).alias("_at"))
    for k in range(1, len(queries)):
        before = found.where("_at is not null").select(*own, "_at")
        found = rows.where(f"_q{k}").join(before, same).where("_t > _at").groupBy(*keys).agg(F.min("_t").alias("_at"))
    found = found.where("_at is not null").select(*own, F.lit(True).alias("_hit"))
    return reached.join(found, same, "left").select(*keys, F.coalesce("_hit", F.lit(False)).alias(name))


def within_all_by(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], timeframe: int, time: str = "creation", name: str = "hit") -> DataFrame:
    """Per key: whether every query has rows and all of them lie within the timeframe. No query: true."""
    if not queries:
        return df.select(*keys).distinct().withColumn(name, F.lit(True))
    any_of = queries[0]
    for q in queries[1:]:
        any_of = any_of | q
    span = F.max(F.when(any_of, F.col(time))) - F.min(F.when(any_of, F.col(time)))
    every = F.lit(True)
    for q in queries:
        every = every & (F.count_if(q) > 0)
    return df.groupBy(*keys).agg(F.coalesce(every & (span <= timeframe), F.lit(False)).alias(name))


def within_all_sliding(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, timeframe: int, time: str = "arrival", sort: str | None = None, name: str = "hit") -> DataFrame:
    """Whether in the frame of each row every query has rows and all of them lie within the timeframe, by the axis `sort` (default: the
    frame's). No query: true."""
    if not queries:
        return df.withColumn(name, F.lit(True))
    f, at = Frames(df, keys, time, age), F.col(sort or time)
    selected = reduce(lambda a, b: a | b, queries)
    rows = f.rows.withColumn("_span", F.max(F.when(selected, at)).over(f.frame()) - F.min(F.when(selected, at)).over(f.frame()))
    every = F.lit(True)
    for k, q in enumerate(queries):
        rows = rows.withColumn(f"_n{k}", F.count(F.when(q, 1)).over(f.frame()))
        every = every & (F.col(f"_n{k}") > 0)
    return f.close(rows.withColumn(name, F.coalesce(every & (F.col("_span") <= timeframe), F.lit(False)))).drop("_span", *[f"_n{k}" for k in range(len(queries))])


def within_any_sliding(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], timeframe: int, time: str = "creation", name: str = "hit") -> DataFrame:
    """Whether rows, one of each query, lie within the timeframe, the last of them at the row's time.

    For each row only the latest of each query counts: linear in the rows, whatever the number of choices.
    """
    f = Frames(df, keys, time, timeframe)
    upto = f.before(0)
    latest = [F.max(F.when(q, F.col(time))).over(upto) for q in queries]
    if not latest:
        return df.withColumn(name, F.lit(True))
    rows = f.rows
    for k, x in enumerate(latest):
        rows = rows.withColumn(f"_latest{k}", x)
    hit = F.lit(True)
    for k in range(len(latest)):
        hit = hit & (F.col(time) - F.col(f"_latest{k}") <= timeframe)
    return f.close(rows.withColumn(name, F.coalesce(hit, F.lit(False)))).drop(*[f"_latest{k}" for k in range(len(latest))])


def within_any_by(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], timeframe: int, time: str = "creation", name: str = "hit") -> DataFrame:
    """Per key: whether rows, one of each query, lie within the timeframe."""
    return within_any_sliding(df, queries, keys, timeframe, time, "_hit").groupBy(*keys).agg(F.bool_or("_hit").alias(name))


def symbol(alphabet: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The symbol of a row (of the first query that selects it) and the query's number; null if none does."""
    sym, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (letter, query) in reversed(list(enumerate(alphabet))):
        sym, number = F.when(query, F.lit(letter)).otherwise(sym), F.when(query, F.lit(k)).otherwise(number)
    return sym, number


def joined_symbols(collected: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(collected), lambda x: x["sym"]), "")


class Seen:
    """What each row's query sees on two time axes: rows of its key that arrived by its time, and whose `source` time (arrival or
    creation) lies at most `age` before it. The axis `sort`, which a condition goes by, may be another one.

    No single frame has these rows, so a frame on arrival that holds them all is collected, and the source checked after. skew: with
    source creation, by how much creation may lie after arrival.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], age: int, sort: str = "creation", source: str = "arrival", skew: int = 0):
        if source not in ("arrival", "creation"):
            raise ValueError("source: arrival or creation")
        self.age, self.sort, self.source = age, sort, source
        self.frames = Frames(df, keys, "arrival", age + (skew if source == "creation" else 0))
        self.rows, self.helpers = self.frames.rows, []

    def collect(self, value: Column, name: str) -> None:
        """A column with the array of the value (null: none) of the rows seen."""
        own = F.when(value.isNotNull(), F.struct(F.col(self.source).alias("at"), value.alias("v")))
        # a window function is not an argument of a higher-order one, so the collected column comes first
        self.rows = self.rows.withColumn(f"{name}_all", F.collect_list(own).over(self.frames.frame()))
        kept = F.filter(f"{name}_all", lambda x: x["at"] >= F.col("arrival") - self.age)
        self.rows = self.rows.withColumn(name, F.transform(kept, lambda x: x["v"])).drop(f"{name}_all")
        self.helpers.append(name)

    def close(self, **columns: Column) -> DataFrame:
        rows = self.rows
        for name, made in columns.items():
            rows = rows.withColumn(name, made)
        return self.frames.close(rows).drop(*self.helpers)


def sequence_two_axes(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, match: str = "any", sort: str = "creation", source: str = "arrival", skew: int = 0, name: str = "hit") -> DataFrame:
    """sequence any or all (match) over what each row sees on two axes (see Seen), by a sweep that holds the times of one frame. Up to one
    query: true; a query without rows: false."""
    if match not in ("any", "all"):
        raise ValueError("match: any or all")
    if len(queries) <= 1:
        return df.withColumn(name, F.lit(True))
    kind, n = sweeps.SequenceAny if match == "any" else sweeps.SequenceAll, len(queries)
    return sweeps.times(df, queries, keys, age, lambda: kind(n), name, sort, source, skew)


def within_two_axes(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, timeframe: int, match: str = "any", sort: str = "creation", source: str = "arrival", skew: int = 0, name: str = "hit") -> DataFrame:
    """within any or all (match) over what each row sees on two axes (see Seen), by a sweep that holds the times of one frame. No query:
    true; a query without rows: false."""
    if match not in ("any", "all"):
        raise ValueError("match: any or all")
    if not queries:
        return df.withColumn(name, F.lit(True))
    kind, n = sweeps.WithinAny if match == "any" else sweeps.WithinAll, len(queries)
    return sweeps.times(df, queries, keys, age, lambda: kind(n, timeframe), name, sort, source, skew)


def pattern_dfa(df: DataFrame, alphabet: Sequence[tuple[str, Column]], pattern: str, keys: Sequence[str], age: int, sort: str = "arrival", source: str = "arrival", skew: int = 0, id_col: str = "id", name: str = "matched") -> DataFrame:
    """Adds matched as pattern_sliding (or, with another axis, pattern_two_axes) does, without a row's string: the pattern is an automaton,
    a symbol one of its steps, and a frame the composition of its rows' steps. Patterns are regular: letters, classes, groups, choices,
    repetitions and anchors."""
    sym, number = symbol(alphabet)
    made = Automaton(pattern, [letter for letter, _ in alphabet])  # bad patterns fail here
    if sort == source == "arrival":
        rows = df.withColumns({"_number": number, "_id": F.col(id_col)})
        out = sweeps.swept(rows, keys, age, [F.col("arrival").cast("long"), sym], lambda: sweeps.Symbols(made), name, order=["_number", "_id"])
        return out.drop("_number", "_id")
    columns = [F.col(source).cast("long"), F.col(sort).cast("long"), number, F.col(id_col).cast("string"), sym]
    return sweeps.swept(df, keys, age, columns, lambda: sweeps.SortedSymbols(made), name, source, skew)


def count_unique_sliding(df: DataFrame, query: Column, value: Column, keys: Sequence[str], age: int, time: str = "arrival", name: str = "n") -> DataFrame:
    """How many distinct values the selected rows in the frame of each row have (absent: the empty text).

    A row stands for its value from its time until the value comes again or the frame has left it behind; it adds one at the former and takes
    one away at the latter, so the count is a running sum, and no set of values is held.
    """
    f = Frames(df, keys, time, age)
    at = F.col(time)
    rows = f.rows.withColumns({"_chosen": F.coalesce(query, F.lit(False)), "_value": F.coalesce(value.cast("string"), F.lit(""))}).repartition(*f.by)
    again = F.lead(time).over(W.partitionBy(*f.by, "_chosen", "_value").orderBy(time))
    rows = rows.withColumn("_end", F.when(F.col("_chosen"), F.least(at + age + 1, F.coalesce(again, at + age + 1))))
    marks = F.array(F.struct(at.cast("long").alias("t"), F.when(F.col("_chosen"), 1).otherwise(0).alias("d"), F.lit(True).alias("row")), F.struct(F.col("_end").cast("long").alias("t"), F.lit(-1).alias("d"), F.lit(False).alias("row")))
    rows = rows.withColumn("_mark", F.explode(F.filter(marks, lambda m: m["row"] | m["t"].isNotNull())))
    upto = W.partitionBy(*f.by).orderBy("_mark.t").rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum("_mark.d").over(upto).cast("long")).where("_mark.row")
    return f.close(rows.drop("_chosen", "_value", "_end", "_mark"))


def pattern_two_axes(df: DataFrame, alphabet: Sequence[tuple[str, Column]], pattern: str, keys: Sequence[str], age: int, sort: str = "creation", source: str = "arrival", skew: int = 0, id_col: str = "id", asked: Column | None = None) -> DataFrame:
    """Adds symbols and matched as pattern_sliding does, over what each row sees on two axes (see Seen), by a sweep that holds the symbols of
    one frame in order. asked: the rows that get theirs and stay (default: all), as a frame's string is as long as the frame."""
    sym, number = symbol(alphabet)
    columns = [F.col(source).cast("long"), F.col(sort).cast("long"), number, F.col(id_col), sym]
    rows = sweeps.swept(df, keys, age, columns, sweeps.Text, "symbols", source, skew, asked=asked, kind=T.StringType())
    return rows.withColumn("matched", F.col("symbols").rlike(pattern))


def pattern_sliding(df: DataFrame, alphabet: Sequence[tuple[str, Column]], pattern: str, keys: Sequence[str], age: int, time: str = "arrival", id_col: str = "id") -> DataFrame:
    """Adds symbols, the frame's symbol string in time order (equal times: by query, then id), and matched (pattern found in it)."""
    f = Frames(df, keys, time, age)
    sym, number = symbol(alphabet)
    own = F.when(sym.isNotNull(), F.struct(F.col(time).alias("t"), number.alias("k"), F.col(id_col).alias("id"), sym.alias("sym")))
    rows = f.rows.withColumn("_own", own).withColumn("symbols", joined_symbols(F.collect_list("_own").over(f.frame())))
    return f.close(rows.withColumn("matched", F.col("symbols").rlike(pattern)).drop("_own"))


def pattern_by(df: DataFrame, alphabet: Sequence[tuple[str, Column]], pattern: str, keys: Sequence[str], time: str = "creation", id_col: str = "id") -> DataFrame:
    """Per key: symbols and matched. For keys that bound their rows, such as (host, day): a key's string is held by one task."""
    sym, number = symbol(alphabet)
    own = F.struct(F.col(time).alias("t"), number.alias("k"), F.col(id_col).alias("id"), sym.alias("sym"))
    grouped = df.withColumn("_sym", sym).where("_sym is not null").groupBy(*keys).agg(joined_symbols(F.collect_list(own)).alias("symbols"))
    return grouped.withColumn("matched", F.col("symbols").rlike(pattern))
