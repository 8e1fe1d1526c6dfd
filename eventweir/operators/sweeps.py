"""Conditions by one sweep over a key's rows in time, for what no window function expresses.

Rows of a key and bucket of time (see frames) come in Arrow batches in the order of arrival. A state takes each row in, forgets those that a
query no longer sees, and is asked once per second, since all events of a second see each other. It holds the rows of one frame, so memory
is linear in a frame, and a key with very many rows is spread over its buckets.

The states also serve streams, where a key's rows come in order behind the watermark.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventweir.operators.automata import Automaton, Sliding, Sorted
from eventweir.operators.frames import Frames

NEVER = -(1 << 62)
#: Characters of answers that leave a sweep in one batch, so that long ones do not fill the memory.
AT_ONCE = 1 << 23


def changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; nulls equal each other. The first row does."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


class State:
    """What a sweep knows of one key. Rows come as tuples of the columns that the condition has asked for."""

    #: The answer for a row without a time.
    nothing = False

    def expire(self, limit: int) -> None:
        """Forgets what lies before the limit."""

    def add(self, row: tuple, limit: int) -> None:
        raise NotImplementedError

    def answer(self):
        raise NotImplementedError

    def matters(self, row: tuple) -> bool:
        """Whether later answers may depend on the row."""
        return all(x is not None for x in row)


def swept(df: DataFrame, keys: Sequence[str], age: int, columns: Sequence[Column], make: Callable[[], State], name: str, source: str = "arrival", skew: int = 0, order: Sequence[str] = (), asked: Column | None = None, kind: T.DataType | None = None) -> DataFrame:
    """df with the state's answer for each row, a boolean or what kind says. columns: what add() gets of a row; rows of a second come in the
    order given. asked: the rows that are answered and stay (default: all).

    A row whose arrival is null sees nothing and is not seen.
    """
    if source not in ("arrival", "creation"):
        raise ValueError("source: arrival or creation")
    frames = Frames(df, keys, "arrival", age + (skew if source == "creation" else 0))
    own = {f"_sweep{k}": c for k, c in enumerate(columns)} | {"_now": F.coalesce(F.col("arrival").cast("long"), F.lit(NEVER))}
    own["_asked"] = frames.own if asked is None else frames.own & F.coalesce(asked, F.lit(False))
    rows = frames.rows.withColumns(own).repartition(*frames.by).sortWithinPartitions(*frames.by, "_now", *order)
    by, inputs = list(frames.by), [c for c in own if c not in ("_now", "_asked")]
    kept, answer_type = [c for c in rows.columns if c not in own and c != name], kind or T.BooleanType()
    schema = T.StructType([f for f in rows.schema.fields if f.name in kept] + [T.StructField(name, answer_type)])
    arrow_type = to_arrow_type(answer_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, rest = make(), None, None

        def told(batch: pa.RecordBatch, at: list[int], answers: list) -> pa.RecordBatch:
            together = at[-1] - at[0] + 1 == len(at)
            rows = batch.slice(at[0], len(at)) if together else batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(answers, arrow_type)], [*kept, name])

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal state, key
            new = changes(batch, by)
            now = batch.column("_now").to_numpy()
            cuts = new.copy()
            cuts[1:] |= now[1:] != now[:-1]
            starts = np.flatnonzero(cuts)
            data = list(zip(*[batch.column(c).to_pylist() for c in inputs], strict=True))
            wanted = batch.column("_asked").to_numpy(zero_copy_only=False)
            first = tuple(batch.column(c)[0].as_py() for c in by)
            new[0] = first != key
            rows, answers, size = [], [], 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if new[a]:
                    state = make()
                at = int(now[a])
                if at != NEVER:
                    state.expire(at - age)
                    for row in data[a:b]:
                        state.add(row, at - age)
                own = (np.flatnonzero(wanted[a:b]) + a).tolist()
                if not own:
                    continue
                answer = state.answer() if at != NEVER else state.nothing
                each = len(answer) if isinstance(answer, str) else 1
                step = max(AT_ONCE // max(each, 1), 1)
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    rows += some
                    answers += [answer] * len(some)
                    size += each * len(some)
                    if size >= AT_ONCE:
                        yield told(batch, rows, answers)
                        rows, answers, size = [], [], 0
            if rows:
                yield told(batch, rows, answers)
            key = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by)

        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cuts = changes(batch, [*by, "_now"])
            last = int(np.flatnonzero(cuts)[-1])  # more rows of the last second may come
            if last:
                yield from work(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None:
            yield from work(rest)

    return frames.close(rows.mapInArrow(scan, schema))


class Times(State):
    """Per query the times, by the axis that the condition goes by, of the rows that are seen. Rows: (source, sort, mask of queries)."""

    def __init__(self, queries: int):
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.leaving: list[tuple[int, int, int]] = []

    def expire(self, limit: int) -> None:
        while self.leaving and self.leaving[0][0] < limit:
            source, sort, mask = heapq.heappop(self.leaving)
            for k, run in enumerate(self.runs):
                if mask >> k & 1:
                    del run[bisect_left(run, (sort, source))]

    def matters(self, row: tuple) -> bool:
        return bool(row[2]) and row[0] is not None and row[1] is not None

    def add(self, row: tuple, limit: int) -> None:
        source, sort, mask = row
        if not mask or source is None or sort is None or source < limit:
            return
        heapq.heappush(self.leaving, (source, sort, mask))
        for k, run in enumerate(self.runs):
            if mask >> k & 1:
                insort(run, (sort, source))


class Counted(State):
    """How many rows are seen. Rows: (time,), null for those that do not count."""

    def __init__(self) -> None:
        self.times: deque[int] = deque()

    def expire(self, limit: int) -> None:
        while self.times and self.times[0] < limit:
            self.times.popleft()

    def add(self, row: tuple, limit: int) -> None:
        if row[0] is not None and row[0] >= limit:
            self.times.append(row[0])

    def answer(self) -> int:
        return len(self.times)


class Whole(State):
    """The rows that are seen, as dicts of the fields. Rows: (time, fields ..), time null for those that are not looked for."""

    def __init__(self, fields: Sequence[str]):
        self.fields, self.rows = list(fields), deque()

    def expire(self, limit: int) -> None:
        while self.rows and self.rows[0][0] < limit:
            self.rows.popleft()

    def add(self, row: tuple, limit: int) -> None:
        if row[0] is not None and row[0] >= limit:
            self.rows.append(row)

    def answer(self) -> list[dict]:
        return [dict(zip(self.fields, r[1:], strict=True)) for r in self.rows]

    def matters(self, row: tuple) -> bool:
        return row[0] is not None


class SequenceAny(Times):
    """Times t1 < t2 < .. < tn, one of each query: the earliest that is later than the one before."""

    def answer(self) -> bool:
        reached = NEVER
        for run in self.runs:
            k = bisect_right(run, (reached, 1 << 62))
            if k == len(run):
                return False
            reached = run[k][0]
        return True


class SequenceAll(Times):
    """All times of each query before those of the next."""

    def answer(self) -> bool:
        return all(self.runs) and all(a[-1][0] < b[0][0] for a, b in zip(self.runs, self.runs[1:], strict=False))


class WithinAll(Times):
    """Every query has times, and all lie within the timeframe."""

    def __init__(self, queries: int, timeframe: int):
        super().__init__(queries)
        self.timeframe = timeframe

    def answer(self) -> bool:
        return all(self.runs) and max(r[-1][0] for r in self.runs) - min(r[0][0] for r in self.runs) <= self.timeframe


class WithinAny(WithinAll):
    """Times, one of each query, within the timeframe.

    What was found holds until one of its rows leaves, and is the latest there is. What was not found can only come about by new rows, so
    only times around these are looked at. A look steps down from a latest time: of each query the last time up to it is taken; if
    they do not fit, nothing later than the earliest of them and the timeframe does.
    """

    def __init__(self, queries: int, timeframe: int):
        super().__init__(queries, timeframe)
        self.until: int | None = None  # the found rows are seen while the limit is not above
        self.low: int | None = 1 << 62
        self.high = NEVER
        self.limit = NEVER

    def expire(self, limit: int) -> None:
        super().expire(limit)
        if self.until is not None and self.until < limit:
            self.until, self.low, self.high = None, NEVER, 1 << 62

    def add(self, row: tuple, limit: int) -> None:
        super().add(row, limit)
        if row[2] and row[1] is not None:
            self.low, self.high = min(self.low, row[1]), max(self.high, row[1])

    def answer(self) -> bool:
        if self.until is None and self.low <= self.high and all(self.runs):
            self.look()
        if all(self.runs):
            self.low, self.high = 1 << 62, NEVER
        return self.until is not None

    def look(self) -> None:
        last = min(self.high + self.timeframe, max(r[-1][0] for r in self.runs))
        while last >= self.low:
            taken = []
            for run in self.runs:
                k = bisect_right(run, (last, 1 << 62)) - 1
                if k < 0:
                    return
                taken.append(run[k])
            low, high = min(taken)[0], max(taken)[0]
            if high - low <= self.timeframe:
                self.until = min(source for _, source in taken)
                return
            last = low + self.timeframe if low + self.timeframe < last else last - 1


def mask(queries: Sequence[Column]) -> Column:
    if len(queries) > 62:
        raise ValueError("no more than 62 queries")
    found = F.lit(0).cast("long")
    for k, q in enumerate(queries):
        found = found + F.when(q, F.lit(1 << k)).otherwise(F.lit(0))
    return found


def times(df: DataFrame, queries: Sequence[Column], keys: Sequence[str], age: int, make: Callable[[], State], name: str, sort: str, source: str, skew: int) -> DataFrame:
    return swept(df, keys, age, [F.col(source).cast("long"), F.col(sort).cast("long"), mask(queries)], make, name, source, skew)


class Symbols(State):
    """A pattern over the symbols of the rows in the order they come; rows leave in that order. Rows: (time, letter)."""

    def __init__(self, automaton: Automaton):
        self.run, self.times = Sliding(automaton), deque()

    def expire(self, limit: int) -> None:
        while self.times and self.times[0] < limit:
            self.times.popleft()
            self.run.pop()

    def add(self, row: tuple, limit: int) -> None:
        time, letter = row
        if letter is not None:
            self.times.append(time)
            self.run.push(letter)

    def answer(self) -> bool:
        return self.run.matched()


class SortedSymbols(State):
    """The same in the order of another axis. Rows: (source, sort, number of the symbol, id, letter)."""

    def __init__(self, automaton: Automaton):
        self.run, self.leaving = Sorted(automaton), []

    def expire(self, limit: int) -> None:
        while self.leaving and self.leaving[0][0] < limit:
            _, key, letter = heapq.heappop(self.leaving)
            self.run.remove(key, letter)

    def add(self, row: tuple, limit: int) -> None:
        source, sort, number, event, letter = row
        if letter is None or source is None or sort is None or source < limit:
            return
        key = (sort, number, event or "")
        heapq.heappush(self.leaving, (source, key, letter))
        self.run.add(key, letter)

    def answer(self) -> bool:
        return self.run.matched()


class Text(State):
    """The letters of what is seen, as a string in the order of another axis. Rows: (source, sort, number of the symbol, id, letter)."""

    nothing = ""

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.letters: list[str] = []
        self.leaving: list[tuple[int, tuple]] = []

    def expire(self, limit: int) -> None:
        while self.leaving and self.leaving[0][0] < limit:
            k = bisect_left(self.keys, heapq.heappop(self.leaving)[1])
            del self.keys[k], self.letters[k]

    def add(self, row: tuple, limit: int) -> None:
        source, sort, number, event, letter = row
        if letter is None or source is None or source < limit:
            return
        key = sort is not None, sort or 0, number, event is not None, "" if event is None else event  # nulls first
        heapq.heappush(self.leaving, (source, key))
        k = bisect_right(self.keys, key)
        self.keys.insert(k, key)
        self.letters.insert(k, letter)

    def answer(self) -> str:
        return "".join(self.letters)
