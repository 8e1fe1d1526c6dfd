"""Streams of events: dedupe, windows, contexts with timers, recent events of a key, delayed forwarding, follow-ups.

Streams carry `arrival` (epoch seconds) and `at` (the same as a timestamp, which the watermark is on). Each has a batch form among the
operators that gives the same rows for complete input; the tests compare the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, LongType, StringType, StructField, StructType

from eventweir.operators import sweeps
from eventweir.operators.automata import Automaton
from eventweir.operators.conditions import symbol
from eventweir.operators.sweeps import State

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(stream: DataFrame, late: int) -> DataFrame:
    """The stream with `at` and a watermark: rows may be late by so many seconds."""
    return stream.withColumn("at", F.timestamp_seconds("arrival")).withWatermark("at", f"{late} seconds")


def deduped(stream: DataFrame, late: int, id_col: str = "id") -> DataFrame:
    return watermarked(stream, late).dropDuplicatesWithinWatermark([id_col])


def tumbling(stream: DataFrame, query: Column, keys: Sequence[str], length: int, late: int) -> DataFrame:
    """Rows (keys, start, n): how many rows of each window the query selects."""
    grouped = watermarked(stream, late).groupBy(*keys, F.window("at", f"{length} seconds").alias("w"))
    return grouped.agg(F.count_if(query).alias("n")).select(*keys, F.unix_seconds("w.start").alias("start"), "n")


def hopping(stream: DataFrame, query: Column, keys: Sequence[str], age: int, slide: int, late: int) -> DataFrame:
    """The same for windows of `age` seconds that begin every `slide`: an approximation of the sliding count."""
    grouped = watermarked(stream, late).groupBy(*keys, F.window("at", f"{age} seconds", f"{slide} seconds").alias("w"))
    return grouped.agg(F.count_if(query).alias("n")).select(*keys, F.unix_seconds("w.end").alias("end"), "n")


def session_counts(stream: DataFrame, keys: Sequence[str], timeout: int, late: int) -> DataFrame:
    """Rows (keys, start, n): a gap above the timeout ends a session."""
    grouped = watermarked(stream, late).groupBy(*keys, F.session_window("at", f"{timeout} seconds").alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.unix_seconds("w.start").alias("start"), "n")


def seconds(fields: Sequence[StructField]) -> tuple[StructType, StructType]:
    """Key and value of a map state of rows by second."""
    return StructType([StructField("second", LongType())]), StructType([StructField("rows", ArrayType(StructType(list(fields))))])


class Ordered(StatefulProcessor):
    """Rows of one key in the order of (arrival, id), in whatever order they come: a row waits in state until the watermark has passed
    its second, so the result is that of the complete, sorted input as long as no row is later than the watermark allows.

    Waiting rows are a map by second. When the watermark moves on, the first timer of a key that goes off works all due seconds off, and the
    others find nothing; so a row is written once, read once, and rows that are not due are not read.
    """

    def __init__(self, fields: Sequence[StructField]):
        self.fields = list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", *seconds(self.fields))
        self.done: dict = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new: dict[int, list] = {}
            # pandas turns whole numbers into floats where some are null, which state would take for nulls
            whole = [isinstance(f.dataType, IntegralType) for f in self.fields]
            for row in frame[[f.name for f in self.fields]].astype(object).itertuples(index=False):
                new.setdefault(int(row[0]), []).append(tuple(None if pd.isna(x) else int(x) if n else x for x, n in zip(row, whole, strict=True)))
            for second, some in new.items():
                old = self.waiting.getValue((second,)) if self.waiting.containsKey((second,)) else None
                self.waiting.updateValue((second,), ([*(tuple(r) for r in old[0]), *some] if old else some,))
                if not old:
                    self.handle.registerTimer(second * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all rows up to the watermark are here, and a timer set now would wait for the next batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        if self.done.get(key) == now:
            return
        self.done[key] = now
        ready = []
        for second in sorted(k[0] for k in self.waiting.keys() if k[0] <= now):
            ready += sorted((tuple(r) for r in self.waiting.getValue((second,))[0]), key=lambda r: str(r[1]))
            self.waiting.removeKey((second,))
        yield from self.advance(key, ready, now)

    def advance(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """What the rows (arrival, id, ..) up to this second make of the key."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Ids:
    """The ids of a context's events: a list in state that is appended to, and read when the context ends."""

    def __init__(self, state):
        self.state, self.fresh, self.stored = state, [], True

    def add(self, event: str) -> None:
        self.fresh.append((event,))

    def forget(self) -> None:
        self.fresh, self.stored = [], False

    def take(self) -> list[str]:
        old = [tuple(x) for x in self.state.get()] if self.stored and self.state.exists() else []
        found = sorted(x[0] for x in [*old, *self.fresh])
        self.forget()
        return found

    def write(self) -> None:
        if not self.stored:
            self.state.clear()
        if self.fresh:
            self.state.appendList(self.fresh)


class Contexts(Ordered):
    """The context of one key: a row opens one unless one is open; rows inside count and are associated; a timer or a row ends it."""

    FIELDS = (*[StructField(n, LongType()) for n in ("arrival",)], StructField("id", StringType()), *[StructField(n, BooleanType()) for n in ("opens", "joins", "forgets", "restarts", "deletes")], StructField("op", StringType()), StructField("value", LongType()), StructField("rules", StringType()))
    OPEN = StructType([StructField(n, LongType()) for n in ("start", "since", "counter", "events", "fires")] + [StructField("rules", StringType())])

    def __init__(self, timeout: int, names: list[str], repeat: bool, initial: int, joined: bool):
        super().__init__(self.FIELDS)
        self.timeout, self.names, self.repeat, self.initial, self.joined = timeout, names, repeat, initial, joined

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", self.OPEN)
        self.ids = handle.getListState("ids", StructType([StructField("id", StringType())]))

    def advance(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        current = list(self.open.get())[:4] + [self.open.get()[5]] if self.open.exists() else None  # start, since when the timer runs, counter, events, rules
        ids = Ids(self.ids)

        def end(second: int, how: str) -> None:
            out.append((*key, current[0], second, current[2], ids.take(), how, current[4]))

        def expire(second: int) -> None:
            nonlocal current
            if current is not None and second > current[1] + self.timeout:
                if current[3] or not self.repeat:
                    end(current[1] + self.timeout + 1, "timeout")
                # a repeating context starts again at once; periods without an event give no row
                periods = (second - current[1]) // (self.timeout + 1)
                again = current[1] + periods * (self.timeout + 1)
                ids.forget()
                current = [again, again, self.initial, 0, current[4]] if self.repeat else None

        for arrival, event, opens, joins, forgets, restarts, deletes, op, value, rules in rows:
            expire(arrival)
            if current is not None and rules != current[4]:  # the rules have changed since it was opened
                end(arrival, "rules")
                current = None
            if current is None and opens:
                current = [arrival, arrival, self.initial, 0, rules]
            if current is None:
                continue
            current[3] += 1
            if deletes:
                end(arrival, "deleted")
                current = None
                continue
            if restarts:
                current[1] = arrival
            if forgets:
                if self.joined:
                    out.append((*key, current[0], arrival, current[2], ids.take(), "forgotten", current[4]))
                ids.forget()
            current[2] = value if op == "set" else current[2] + (value if op == "inc" else -value if op == "dec" else 0)
            if joins:
                ids.add(event)
                if self.joined:
                    out.append((*key, current[0], arrival, current[2], [event], "joined", current[4]))
        expire(now)
        ids.write()
        if current is None:
            self.open.clear()
        else:
            fires = current[1] + self.timeout + 1
            self.open.update((*current[:4], fires, current[4]))
            self.handle.registerTimer(fires * 1000)
        if out:
            yield pd.DataFrame(out, columns=self.names)


def contexts(stream: DataFrame, key: str, timeout: int, late: int, opening: Column | None = None, op: Column | None = None, value: Column | None = None, joins: Column | None = None, forgets: Column | None = None, restarts: Column | None = None, deletes: Column | None = None, repeat: bool = False, initial: int = 0, version: str = "", rules: Column | None = None, joined: bool = False) -> DataFrame:
    """Rows (key, start, fires, counter, event_ids, ended, rules) of contexts, when they end: by timeout, deleted, or because of rules.

    opening: rows that open a context (default: all); op and value: set, inc or dec of the counter (default: inc by 1); joins: rows
    that are associated (default: all), their ids are what a deleted context releases; forgets: rows that empty the association first;
    restarts: rows that restart the timer; deletes: rows that end the context; repeat: it starts again when it has timed out.

    rules: a text per row that names the rules it came under (see under_rules()); a row under others than those that opened its key's
    context ends it, so rules change while the stream runs. version does the same for a stream that is restarted from its checkpoint with
    another text: it begins with no contexts. joined: a row as well whenever an event is associated or the association is emptied (ended
    is joined or forgotten), for holds(). Needs the RocksDB state store.
    """
    names = ["version", key, "start", "fires", "counter", "event_ids", "ended", "rules"]
    types = [StringType(), StringType(), LongType(), LongType(), LongType(), ArrayType(StringType()), StringType(), StringType()]
    given = {"opens": opening, "joins": joins, "forgets": forgets, "restarts": restarts, "deletes": deletes}
    flags = {k: F.lit(k in ("opens", "joins")) if v is None else F.coalesce(v, F.lit(False)) for k, v in given.items()}
    more = {"version": F.lit(version), "op": F.lit("inc") if op is None else op, "value": (F.lit(1) if value is None else value).cast("long"), "rules": F.lit("") if rules is None else F.coalesce(rules.cast("string"), F.lit(""))}
    rows = watermarked(stream, late).withColumns(flags | more).withColumn(key, F.col(key).cast("string"))
    made = rows.groupBy("version", key).transformWithStateInPandas(Contexts(timeout, names, repeat, initial, joined), outputStructType=StructType([StructField(n, t) for n, t in zip(names, types, strict=True)]), outputMode="append", timeMode="eventTime")
    return made.where(F.col("version") == version).drop("version")


def under_rules(changes: DataFrame, group: Column, at: Column) -> Column:
    """The version of a group's rules at a time, from a small table (group, version, since) of changes: the last one since then, empty
    before the first. An expression over literals, so it is exact by event time, whenever the rows come."""
    found = F.lit("")
    for r in sorted(changes.select("group", "version", "since").collect(), key=lambda r: r["since"]):
        found = F.when((group == r["group"]) & (at >= r["since"]), F.lit(r["version"])).otherwise(found)
    return found


class RuleChanges(DataSource):
    """The table (group, version, since) of a folder of JSON lines, read anew whenever it is asked for: joined with a stream, each batch
    sees the changes that were added before it. Option path: a URI that pyarrow knows, for a folder that all machines reach."""

    @classmethod
    def name(cls) -> str:
        return "eventweir_rule_changes"

    def schema(self) -> str:
        return "group string, version string, since long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RuleChangesReader(self.options["path"])


class RuleChangesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        import json

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path)
        for info in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".json"):
                with where.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        if line.strip():
                            r = json.loads(line)
                            yield r["group"], r["version"], int(r["since"])


def with_rules(stream: DataFrame, path: str, group: Column, at: str = "arrival", name: str = "rules") -> DataFrame:
    """The stream with the version of the group's rules at each row's time: the last change up to it in a folder of changes (see
    RuleChanges), the empty text before the first. A change that is added while the stream runs counts from the next batch on, for rows
    from its time on."""
    spark = stream.sparkSession
    spark.dataSource.register(RuleChanges)
    changes = spark.read.format("eventweir_rule_changes").option("path", path).load()
    listed = changes.groupBy(F.col("group").alias("_group")).agg(F.array_sort(F.collect_list(F.struct("since", "version"))).alias("_changes"))
    # as many rows as there are groups of rules
    rows = stream.withColumn("_of", group.cast("string")).join(F.broadcast(listed), F.col("_of") == F.col("_group"), "left")
    valid = F.filter("_changes", lambda c: c["since"] <= F.col(at))
    return rows.withColumn(name, F.coalesce(F.try_element_at(valid, F.lit(-1))["version"], F.lit(""))).drop("_of", "_group", "_changes")


def snapshot(spark: SparkSession, checkpoint: str, watermark: int | None = None) -> DataFrame:
    """The contexts that a stream of contexts() holds at its checkpoint: rows (version, key, start, since, counter, events, fires, rules,
    event_ids, stale), read from its state. Stale ones are due at the watermark given, and will end with the next batch."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    opened = read("open")
    one = opened.schema["key"].dataType.names
    keys = [F.col(f"key.{n}").alias("version" if n == one[0] else "key") for n in one]
    rows = opened.select(*keys, "value.*")
    ids = read("ids")
    ids = ids.select(*keys, F.col("list_element.id").alias("id")).groupBy("version", "key").agg(F.array_sort(F.collect_list("id")).alias("event_ids"))
    out = rows.join(ids, ["version", "key"], "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast("array<string>")))
    return out.withColumn("stale", F.lit(False) if watermark is None else F.col("fires") <= watermark)


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that a stream in order (contexts, recent events, holds) has read and not yet worked off, from its checkpoint's state:
    columns key (struct), second and those of the rows."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    return held.select("key", F.col("user_map_key.second").alias("second"), F.explode("user_map_value.rows").alias("row")).select("key", "second", "row.*")


class Recent(Ordered):
    """A condition on the recent events of a key, answered for every row: what the condition needs of each event is kept by second for as
    long as a frame of a row to come can reach it."""

    def __init__(self, age: int, reach: int, names: list[str], make: Callable[[], State], fields: Sequence[StructField]):
        super().__init__([StructField("arrival", LongType()), StructField("id", StringType()), *fields, StructField("asked", BooleanType())])
        self.age, self.reach, self.names, self.make, self.own = age, reach, names, make, list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("kept", *seconds(self.own))

    def advance(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        if not rows:
            return
        state, first = self.make(), rows[0][0]
        for second in sorted(k[0] for k in self.kept.keys()):
            if second >= first - self.reach:
                for row in self.kept.getValue((second,))[0]:
                    state.add(tuple(row), first - self.age)
            if second < now - self.reach:
                self.kept.removeKey((second,))
        out = []
        for second, some in groupby(rows, lambda r: r[0]):
            some, limit = list(some), second - self.age
            state.expire(limit)
            own = [r[2:-1] for r in some]
            for row in own:
                state.add(row, limit)
            if any(r[-1] for r in some):
                answer = state.answer()
                out += [(r[1], key[0], second, answer) for r in some if r[-1]]
            if second >= now - self.reach and (own := [r for r in own if state.matters(r)]):
                self.kept.updateValue((second,), (own,))
        if out:
            yield pd.DataFrame(out, columns=self.names)


def recent(stream: DataFrame, key: str, age: int, late: int, columns: dict[str, Column], make: Callable[[], State], name: str, kind: DataType, reach: int | None = None, asked: Column | None = None) -> DataFrame:
    """Rows (id, key, arrival, name): the answer of a state of operators.sweeps for every row (or those that `asked` selects).

    columns: what the state gets of each row; reach: for how long a row matters (default: age). A row is answered when the watermark has
    passed its second: rows may come in any order as long as they are at most `late` seconds late. Needs the RocksDB state store.
    """
    rows = watermarked(stream.withColumns(columns | {"asked": F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))}), late)
    fields = [StructField(c, rows.schema[c].dataType) for c in columns]
    schema = StructType([StructField("id", StringType()), StructField(key, StringType()), StructField("arrival", LongType()), StructField(name, kind)])
    processor = Recent(age, age if reach is None else reach, ["id", key, "arrival", name], make, fields)
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def sliding_counts(stream: DataFrame, query: Column, key: str, age: int, late: int) -> DataFrame:
    """Rows (id, key, arrival, n): how many rows the query selects in [arrival - age, arrival] of the key, for every row."""
    columns = {"w_time": F.when(query, F.col("arrival").cast("long"))}
    return recent(stream, key, age, late, columns, sweeps.Counted, "n", LongType())


def _times(stream: DataFrame, queries: Sequence[Column], key: str, age: int, late: int, make: Callable[[], State], sort: str, source: str, skew: int) -> DataFrame:
    if source not in ("arrival", "creation"):
        raise ValueError("source: arrival or creation")
    columns = {"w_source": F.col(source).cast("long"), "w_sort": F.col(sort).cast("long"), "w_mask": sweeps.mask(queries)}
    return recent(stream, key, age, late, columns, make, "hit", BooleanType(), age + (skew if source == "creation" else 0))


def sequences(stream: DataFrame, queries: Sequence[Column], key: str, age: int, late: int, match: str = "any", sort: str = "creation", source: str = "arrival", skew: int = 0) -> DataFrame:
    """Rows (id, key, arrival, hit): conditions.sequence_two_axes on a stream, for two queries or more."""
    if match not in ("any", "all") or len(queries) < 2:
        raise ValueError("match: any or all; two queries or more")
    kind, n = sweeps.SequenceAny if match == "any" else sweeps.SequenceAll, len(queries)
    return _times(stream, queries, key, age, late, lambda: kind(n), sort, source, skew)


def closeness(stream: DataFrame, queries: Sequence[Column], key: str, age: int, timeframe: int, late: int, match: str = "any", sort: str = "creation", source: str = "arrival", skew: int = 0) -> DataFrame:
    """Rows (id, key, arrival, hit): conditions.within_two_axes on a stream, for one query or more."""
    if match not in ("any", "all") or not queries:
        raise ValueError("match: any or all; one query or more")
    kind, n = sweeps.WithinAny if match == "any" else sweeps.WithinAll, len(queries)
    return _times(stream, queries, key, age, late, lambda: kind(n, timeframe), sort, source, skew)


def patterns(stream: DataFrame, alphabet: Sequence[tuple[str, Column]], pattern: str, key: str, age: int, late: int, sort: str = "arrival", source: str = "arrival", skew: int = 0) -> DataFrame:
    """Rows (id, key, arrival, matched): conditions.pattern_dfa on a stream. State holds a symbol per event."""
    made, (sym, number) = Automaton(pattern, [letter for letter, _ in alphabet]), symbol(alphabet)
    columns = {"w_source": F.col(source).cast("long"), "w_sort": F.col(sort).cast("long"), "w_number": number, "w_event": F.col("id").cast("string"), "w_letter": sym}
    return recent(stream, key, age, late, columns, lambda: sweeps.SortedSymbols(made), "matched", BooleanType(), age + (skew if source == "creation" else 0))


def seen_events(stream: DataFrame, query: Column, key: str, age: int, late: int, fields: Sequence[str], triggers: Column | None = None) -> DataFrame:
    """Rows (id, key, arrival, events): for every row (or those that `triggers` selects) the whole recent events that its query sees, as
    structs of the fields in the order of arrival."""
    kinds = [stream.schema[f].dataType for f in fields]
    columns = {"w_time": F.when(query, F.col("arrival").cast("long"))} | {f"w_f_{f}": F.when(query, F.col(f)) for f in fields}
    names = list(fields)
    events = ArrayType(StructType([StructField(f, k) for f, k in zip(names, kinds, strict=True)]))
    return recent(stream, key, age, late, columns, lambda: sweeps.Whole(names), "events", events, asked=triggers)


def drained(complete: DataFrame, emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left to forward when a stream has ended: rows of the batch form over its input that the stream has not emitted (those
    that the watermark never passed)."""
    return complete.join(emitted.select(*keys), list(keys), "left_anti")


def released(ended: DataFrame, held: DataFrame) -> DataFrame:
    """The held events that contexts release when they end: rows of held whose id an ended context lists, with the time of release."""
    freed = ended.select(F.explode("event_ids").alias("id"), F.col("fires").alias("released")).groupBy("id").agg(F.min("released").alias("released"))
    return held.join(freed, "id")


class Held(Ordered):
    """One event and what holds it back: its delay, and contexts. It leaves when the last of these has gone."""

    FIELDS = (StructField("arrival", LongType()), StructField("order", StringType()), StructField("kind", StringType()), StructField("context", StringType()), StructField("delay", LongType()))

    def __init__(self, names: list[str]):
        super().__init__(self.FIELDS)
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.holds = handle.getValueState("holds", StructType([StructField("delay", LongType()), StructField("contexts", ArrayType(StringType()))]))

    def advance(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        delay, contexts = (lambda x: (x[0], set(x[1])))(self.holds.get()) if self.holds.exists() else (None, set())
        left = None
        for at, _, kind, context, until in rows:
            if left is None and delay is not None and not contexts and delay < at:
                left = delay
            if kind == "event":
                delay = until
            elif delay is None:  # an event that has left, or was never seen
                continue
            elif kind == "begin":
                contexts.add(context)
            elif context in contexts:
                contexts.discard(context)
                delay = delay if contexts else max(delay, at)
        if left is None and delay is not None and not contexts and delay <= now:
            left = delay
        if left is not None:
            self.holds.clear()
            yield pd.DataFrame([(key[0], left)], columns=self.names)
        elif delay is not None:
            self.holds.update((delay, sorted(contexts)))
            if not contexts:
                self.handle.registerTimer(delay * 1000)


def hold_changes(ended: DataFrame) -> DataFrame:
    """From the rows of contexts(.., joined=True), rows (id, arrival, kind, context): when a context begins and ceases to hold an event."""
    name = F.concat_ws("/", *[c for c in ended.columns[:1]], F.col("start").cast("string"))
    return ended.select(F.explode("event_ids").alias("id"), F.col("fires").alias("arrival"), F.when(F.col("ended") == "joined", "begin").otherwise("end").alias("kind"), name.alias("context"))


def forwarded_by_holds(delayed: DataFrame, changes: DataFrame, late: int) -> DataFrame:
    """Rows (id, released): when each event of a stream with delay_time leaves, given the begins and ends (id, arrival, kind, context) of
    contexts that hold it: at its delay_time, or later when the last hold ends that began before it left. Both inputs meet by id in one
    state, which goes when the event does. Batch form: released_at(). Needs the RocksDB state store."""
    a = delayed.select("id", "arrival", F.lit("0").alias("order"), F.lit("event").alias("kind"), F.lit(None).cast("string").alias("context"), F.col("delay_time").cast("long").alias("delay"))
    # what begins in a second comes before what ends in it
    b = changes.select("id", "arrival", F.when(F.col("kind") == "begin", "1").otherwise("2").alias("order"), "kind", "context", F.lit(None).cast("long").alias("delay"))
    rows = watermarked(a.unionByName(b), late)
    schema = StructType([StructField("id", StringType()), StructField("released", LongType())])
    return rows.groupBy("id").transformWithStateInPandas(Held(["id", "released"]), outputStructType=schema, outputMode="append", timeMode="eventTime")


def released_at(delayed: DataFrame, holds: DataFrame) -> DataFrame:
    """Batch form: rows (id, released) of events with delay_time, from holds (id, begin, end). Of an event's holds, in the order of their
    beginning, each that has begun by the time reached moves it to its end. An event has as many holds as contexts took it."""
    held = holds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_holds"))
    reached = F.aggregate(F.coalesce("_holds", F.array().cast("array<struct<begin:bigint,end:bigint>>")), F.col("delay_time").cast("long"), lambda t, h: F.when(h["begin"] <= t, F.greatest(t, h["end"])).otherwise(t))
    return delayed.join(held, "id", "left").select("id", reached.alias("released"))


def forwarded(delayed: DataFrame, late: int) -> DataFrame:
    """Rows of a stream with delay_time, held back until the watermark passes it. Grouping by it makes the state the held rows alone;
    a row leaves once, with others of its delay_time."""
    held = delayed.withColumn("at", F.timestamp_seconds(F.col("delay_time"))).withWatermark("at", f"{late} seconds")
    return held.groupBy(F.window("at", "1 second").alias("w"), "delay_time").agg(F.array_sort(F.collect_list(F.struct("creation", "id", "name", "host"))).alias("events")).select("delay_time", F.inline("events"))


def followed(opening: DataFrame, closing: DataFrame, keys: Sequence[str], timeout: int, late: int) -> DataFrame:
    """Each opening with the closings of its key (later, within the timeout), or once with nulls if none came. Stream-stream join."""
    a = watermarked(opening, late).select("id", *keys, F.col("at").alias("opened"))
    b = watermarked(closing, late).select(F.col("id").alias("closing_id"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("closed"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    within = (F.col("closed") > F.col("opened")) & (F.col("closed") <= F.col("opened") + F.expr(f"interval {timeout} seconds"))
    return a.join(b, same & within, "leftOuter").drop(*[f"_{k}" for k in keys])


def split_late(df: DataFrame, watermark: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows that a watermark at this time would drop): for a foreachBatch that keeps late rows in a table of their own."""
    late = F.col("arrival") < watermark
    return df.where(~late), df.where(late)


class LateRows:
    """For foreachBatch: gives sink(in_time, late, number) each batch in two parts. Late are rows more than `late` seconds before the
    latest arrival of all earlier batches.

    Each batch's latest arrival is a file of its own in the folder, so the mark is known without the caller's help, never falls, survives
    a restart, and a batch that is run again is split alike. Nothing is late in the first batch. An empty batch, or one whose arrivals
    are all null, moves no mark; rows without an arrival are in time."""

    def __init__(self, folder: str, late: int, sink: Callable[[DataFrame, DataFrame, int], None]):
        self.folder, self.late, self.sink = folder.rstrip("/"), late, sink

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(F.max(F.col("arrival").cast("long")).alias("latest"))
        own.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        marks = spark.read.schema("latest long, batch long").option("basePath", self.folder).parquet(self.folder)
        # a row per batch; the files' own column tells which
        latest = marks.where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        rows = batch.withColumn("_late", F.lit(False) if latest is None else F.coalesce(F.col("arrival") < latest - self.late, F.lit(False)))
        self.sink(rows.where(~F.col("_late")).drop("_late"), rows.where("_late").drop("_late"), number)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, checkpoint: str = "", mode: str = "append") -> None:
    """Works off what is there, then ends: rows go to sink (foreachBatch) or to a Parquet folder."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
