"""Repair of a conversation's structure by the cheapest edits.

Rows of a conversation, in order, are kept, given another role, or deleted, and turns without text are inserted, so that the initials of
the roles read (s?(ua)+)?. Among the cheapest ways the one whose edits spell the ASCII-least word (D, I, K, R) is taken. That is a
shortest path through four states: nothing yet, after the system turn, after a user turn, after an assistant turn.

Costs to the end (a number per state) are computed backwards, but stored only at checkpoints: inside a fragment at every square root of
its length, from which the blocks are computed again one by one while walking forward and emitting the tight edits. Between fragments
of a conversation that lies in several partitions the same is done in Spark: each fragment gives the matrix of its costs between states,
matrices are multiplied backwards to the vectors at the ends of fragments, each fragment is walked from every state to tell where that
leads, and these maps are followed forwards to the state it begins with. So no task sees more than one fragment, and vectors of whole
conversations are nowhere.

Vectors matter up to a constant; the few that occur are numbered, and a step backwards is one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import held, whole_groups, written
from eventweir.llm.turns import in_order, turn_digest

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 40
#: By state: the state after the next turn, and that turn's role. States: 0 nothing, 1 system, 2 user, 3 assistant.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Costs of ending, by state: an unfinished pair is finished by insertions.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's code is 4 * initial + fault: initials u, a, s, other; faults none, blank, duplicate, truncated.
INITIALS, FAULTS = ("u", "a", "s"), ("blank", "duplicate", "truncated")
SPACE = " \t\n\x0b\x0c\r"
CONV = ["void", "conv"]
FRAGMENT = ["part", *CONV]


def row_edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state: (letter, cost, next state), ASCII order of letters without the insertion."""
    initial, fault = divmod(code, 4)
    found = [("D", DELETE, state)]
    if fault in (0, 3):
        more = TRUNCATED if fault else 0
        after = NEXT[state] if initial < 2 and ROLE[state][0] == INITIALS[initial] else 1 if initial == 2 and state == 0 else None
        if after is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


class Walker:
    """Numbers the vectors that occur, and remembers steps."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.tight: dict[tuple[int, int, int], tuple[str, int]] = {}

    def of(self, vector) -> int:
        """The number of a vector, taken up to a constant."""
        low = min(vector)
        v = tuple(x - low if x < FAR else FAR for x in vector)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def before(self, code: int, after: tuple[int, ...]) -> list[int]:
        """Costs before a row from those after it."""
        cost = [min(c + after[t] for _, c, t in row_edits(code, s)) for s in range(4)]
        for _ in range(2):  # no more than two insertions in a row help
            cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
        return [min(c, FAR) for c in cost]

    def back(self, number: int, code: int) -> tuple[int, int]:
        """(number of the vector before the row, constant by which its costs are higher)."""
        key = number, code
        if key not in self.steps:
            made = self.before(code, self.vectors[number])
            self.steps[key] = self.of(made), min(made)
        return self.steps[key]

    def forth(self, number: int, code: int, state: int) -> tuple[str, int]:
        """The ASCII-least tight edits from a state up to and with the row, and the state after it; number: of the vector after it."""
        key = number, code, state
        if key not in self.tight:
            after, word, then = self.vectors[number], "", None
            now = self.before(code, after)
            while then is None:
                ways = [("I", INSERT + now[NEXT[state]], None), *[(x, c + after[t], t) for x, c, t in row_edits(code, state)]]
                letter, _, then = min(w for w in ways if w[1] == now[state])
                word, state = word + letter, NEXT[state]
            self.tight[key] = word, then
        return self.tight[key]

    def matrix(self, codes: bytes) -> list[int]:
        """Costs from each state before the codes to each state after them, row by row."""
        columns = []
        for t in range(4):
            number, more = self.of([0 if s == t else FAR for s in range(4)]), 0
            for code in reversed(codes):
                number, up = self.back(number, code)
                more += up
            columns.append([x + more if x < FAR else FAR for x in self.vectors[number]])
        return [columns[t][s] for s in range(4) for t in range(4)]

    def walk(self, codes: bytes, end: int, state: int) -> Iterator[tuple[str, int]]:
        """(edits, state before them) for each code, from a state; end: number of the vector after the last. Checkpoints at every square
        root of the length; a block's vectors are computed again when it is reached."""
        n = len(codes)
        size = max(isqrt(n), 1)
        marks, number = {n: end}, end
        for k in range(n - 1, -1, -1):
            number = self.back(number, codes[k])[0]
            if k % size == 0:
                marks[k] = number
        for begin in range(0, n, size):
            stop = min(begin + size, n)
            after = [marks[stop]]
            for k in range(stop - 1, begin, -1):
                after.append(self.back(after[-1], codes[k])[0])
            for k in range(begin, stop):
                word, then = self.forth(after[stop - 1 - k], codes[k], state)
                yield word, state
                state = then
        yield "", state  # where it ends


def walker() -> Walker:
    return held("turn-repair", Walker)


def features(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows as a written table (void, conv, turn, role, text, rid), the rows in order, without texts, as a written table with uid,
    part and code)."""
    conv = F.col(conv_col).cast("long")
    own = [conv.isNull().cast("int").alias("void"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col(turn_col).cast("long").alias("turn")]
    own += [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(x) for c, x in ((role_col, "role"), (text_col, "text"))]
    rows = written(turns.select(*own).withColumn("rid", F.monotonically_increasing_id()), "repair-rows")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    shorn = F.rtrim("text", F.lit(SPACE))
    fault = F.when(shorn == "", 1).when(F.substring(shorn, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    narrow = rows.select(*CONV, "turn", "rid", turn_digest(F.col("role"), F.col("text")).alias("digest"), number.alias("initial"), fault.alias("fault"))
    order = in_order(written(narrow, "repair-features"), [*CONV, "turn", "digest", "rid"])
    order = written(order, "repair-order")
    first = order.where("fault <> 1").groupBy(*CONV, "digest").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("first"))
    order = order.join(first, "uid", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    return rows, written(order.select(*FRAGMENT, "uid", "rid", "turn", (F.col("initial") * 4 + fault).cast("int").alias("code")), "repair-codes")


def by_fragment(rows: DataFrame) -> DataFrame:
    at = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(at, *FRAGMENT).sortWithinPartitions(*FRAGMENT, "uid")


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bytes]]:
    for table, starts in whole_groups(batches, FRAGMENT):
        ends = [*starts[1:].tolist(), table.num_rows]
        for a, b in zip(starts.tolist(), ends, strict=True):
            own = table.slice(a, b - a)
            yield own, bytes(own.column("code").to_pylist())


def key_of(table: pa.Table) -> list[int]:
    return [table.column(k)[0].as_py() for k in FRAGMENT]


def ends_and_starts(codes: DataFrame) -> DataFrame:
    """Rows (part, void, conv, start, end, last) for the fragments of conversations that lie in several partitions: the state that each
    begins with, and the costs after it. At most three rows per partition."""
    pieces = codes.groupBy(*FRAGMENT).agg(F.count("*").alias("n"))
    several = pieces.groupBy(*CONV).agg(F.count("*").alias("parts")).where("parts > 1").select(*CONV)
    rows = written(by_fragment(codes.join(F.broadcast(several), CONV, "left_semi")), "repair-several")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, word in fragments(batches):
            yield pa.RecordBatch.from_pylist([dict(zip([*FRAGMENT, "m"], [*key_of(own), walker().matrix(word)], strict=True))], schema=pa.schema([("part", pa.int64()), ("void", pa.int32()), ("conv", pa.int64()), ("m", pa.list_(pa.int64()))]))

    def backwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part", ascending=False)
        now, ends = list(END), []
        for m in frame["m"]:
            ends.append(list(now))
            now = [min(min(int(m[4 * s + t]) + now[t] for t in range(4)), FAR) for s in range(4)]
            low = min(now)
            now = [x - low for x in now]
        return frame[FRAGMENT].assign(end=ends, last=[k == 0 for k in range(len(ends))])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, word in fragments(batches):
            end = own.column("end")[0].as_py()
            to = []
            for s in range(4):
                for _, state in walker().walk(word, walker().of(end), s):
                    pass
                to.append(state)
            row = dict(zip(FRAGMENT, key_of(own), strict=True)) | {"to": to, "end": end, "last": own.column("last")[0].as_py()}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("void", pa.int32()), ("conv", pa.int64()), ("to", pa.list_(pa.int32())), ("end", pa.list_(pa.int64())), ("last", pa.bool_())]))

    def forwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        state, starts = 0, []
        for to in frame["to"]:
            starts.append(state)
            state = int(to[state])
        return frame[[*FRAGMENT, "end", "last"]].assign(start=starts)

    ddl = "part long, void int, conv long"
    ends = by_fragment(rows).mapInArrow(matrices, f"{ddl}, m array<long>").groupBy(*CONV).applyInPandas(backwards, f"{ddl}, end array<long>, last boolean")
    ends = written(ends, "repair-ends")
    walked = by_fragment(rows.join(F.broadcast(ends), FRAGMENT)).mapInArrow(maps, f"{ddl}, to array<int>, end array<long>, last boolean")
    return written(walked.groupBy(*CONV).applyInPandas(forwards, f"{ddl}, end array<long>, last boolean, start int"), "repair-starts")


EDITS = pa.schema([("void", pa.int32()), ("conv", pa.int64()), ("uid", pa.int64()), ("sub", pa.int32()), ("rid", pa.int64()), ("turn", pa.int64()), ("code", pa.int32()), ("edit", pa.string()), ("new_role", pa.string()), ("cost", pa.int32())])


def edit_rows(own: pa.Table, word: bytes, end: list[int], state: int, last: bool) -> Iterator[pa.RecordBatch]:
    """A row per edit of a fragment, in bounded batches. rid, turn and code tell of the row that an edit is about; insertions have none."""
    void, conv = own.column("void")[0].as_py(), own.column("conv")[0].as_py()
    uids, rids, turns = (own.column(c).to_pylist() for c in ("uid", "rid", "turn"))
    made: list[list] = [[] for _ in EDITS.names]

    def add(uid: int, sub: int, row: int | None, letter: str, role: str | None, cost: int) -> None:
        code = None if row is None else word[row]
        for c, x in zip(made, (void, conv, uid, sub, None if row is None else rids[row], None if row is None else turns[row], code, letter, role, cost), strict=True):
            c.append(x)

    for k, (letters, at) in enumerate(walker().walk(word, walker().of(end), state)):
        state = at
        for sub, letter in enumerate(letters):
            if letter == "I":
                add(uids[k], sub, None, "I", ROLE[state], INSERT)
                state = NEXT[state]
            else:
                kept = 0 if letter == "D" else TRUNCATED * (word[k] % 4 == 3)
                add(uids[k], sub, k, letter, ROLE[state] if letter == "R" else None, kept + {"D": DELETE, "K": 0, "R": REROLE}[letter])
        if len(made[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, EDITS, strict=True)], schema=EDITS)
            made = [[] for _ in EDITS.names]
    sub = 1 << 20  # after the last row
    while last and END[state]:
        add(uids[-1], sub, None, "I", ROLE[state], INSERT)
        state, sub = NEXT[state], sub + 1
    if made[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, EDITS, strict=True)], schema=EDITS)


def edits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit: (void, conv, uid, sub, rid, turn, code, edit, role, text, cost); (uid, sub) order those of a conversation.

    edit is K, R, D or I; role and text are those after it (a deleted row has none). Rows of a conversation come by turn (null first), then
    by SHA-256 of role and text. Null roles and texts count as one space, rows with a null conversation are one conversation (void 1).
    A role's initial is its first character; a role without one cannot be kept. Rows that repeat a role and text are duplicates. An empty
    table gives no rows. Other columns are not looked at.
    """
    rows, codes = features(turns, conv_col, turn_col, role_col, text_col)
    given = codes.join(F.broadcast(ends_and_starts(codes)), FRAGMENT, "left")
    given = given.withColumns({"end": F.coalesce("end", F.array(*[F.lit(x) for x in END]).cast("array<long>")), "start": F.coalesce("start", F.lit(0)), "last": F.coalesce("last", F.lit(True))})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, word in fragments(batches):
            yield from edit_rows(own, word, *[own.column(c)[0].as_py() for c in ("end", "start", "last")])

    made = by_fragment(given).mapInArrow(emit, "void int, conv long, uid long, sub int, rid long, turn long, code int, edit string, new_role string, cost int")
    made = made.join(rows.select("rid", "role", "text"), "rid", "left")
    text = F.when(F.col("edit") == "D", None).when(F.col("edit") == "I", "").otherwise(F.col("text"))
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new_role"))
    return made.select(*CONV, "uid", "sub", "rid", "turn", "code", "edit", role.alias("role"), text.alias("text"), "cost")


def repaired(turns: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations: rows (conv_id, place, role, text), place telling the order (long, ascending with gaps, unique).
    Arguments and cases as in edits(). A conversation of which nothing is left has no rows."""
    left = edits(turns, **columns).where("edit <> 'D'")
    return left.select(F.when(F.col("void") == 0, F.col("conv")).alias("conv_id"), F.struct("uid", "sub").alias("place"), "role", "text")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(made: DataFrame) -> DataFrame:
    """From edits(), one row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A digest of a whole conversation can only be taken in its order: rows stream through the task that has the conversation, which holds
    a batch, a digest and the word of edits.
    """
    at = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = made.select(*CONV, "uid", "sub", "turn", "code", "edit", "cost", "role", "text").repartition(at, *CONV).sortWithinPartitions(*CONV, "uid", "sub")
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for *own, turn, code, edit, cost, role, text in zip(*[batch.column(c).to_pylist() for c in (*CONV, "turn", "code", "edit", "cost", "role", "text")], strict=True):
                if own != key:
                    if key is not None:
                        done.append(state.told(key))
                    key, state = own, Told()
                state.add(turn, code, edit, cost, role, text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, state.told(key), strict=True))], schema=schema)

    return rows.mapInArrow(stream, ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in names))


class Told:
    """What is told of one conversation, row by row."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.word, self.hash, self.begun = [0, 0, 0, 0], 0, 0, [], hashlib.sha256(), False
        self.low = self.high = self.before = None
        self.distinct = 0

    def add(self, turn: int | None, code: int | None, edit: str, cost: int, role: str | None, text: str | None) -> None:
        self.word.append(edit)
        self.cost += cost
        if code is not None:
            initial, fault = divmod(code, 4)
            self.faults[fault] += 1
            if self.before is not None:
                self.illegal += (self.before, initial) not in ((2, 0), (0, 1), (1, 0))
            self.before = initial
            if turn is not None and turn != self.high:
                self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if edit != "D":
            self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True

    def told(self, key: list[int]) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (None if key[0] else key[1], gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.word), self.hash.hexdigest())


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults, told by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its
    text, 2 removes full stops, exclamation and question marks, 3 repeats the row, 4 makes it a user's. Nulls become one space first."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def audit_damaged(turns: DataFrame) -> DataFrame:
    """audits() of the damaged conversations; one of which damage left no rows has zeros, an empty audit and the empty text's digest."""
    found = audits(edits(damaged(turns)))
    every = turns.select("conv_id").distinct()
    out = every.join(found.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    given = {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.select("conv_id", *[x.alias(c) for c, x in given.items()])


def repair_sql() -> str:
    """DuckDB SQL for audit_damaged(conversations): from the last row backwards, for each state the cheapest costs (c), the ASCII-least word
    (w) and what is left (r) of the rows from there on."""
    from eventweir.llm.prefix_trie import CRC_TABLE, crc_sql

    made = lambda c, w, r: f"{{'c': CAST({c} AS BIGINT), 'w': {w}, 'r': {r}}}"
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    late = f"CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END"

    def ways(s: int) -> str:
        t, role = NEXT[s], ROLE[s]
        keep = f"CASE WHEN fault IN (0, 3) AND initial = '{role[0]}' THEN {made(f'n{t}.c + {late}', f"'K' || n{t}.w", f"chr(10) || role || ':' || text || n{t}.r")} END"
        more = [f"CASE WHEN fault IN (0, 3) AND initial = 's' THEN {made(f'n1.c + {late}', "'K' || n1.w", "chr(10) || role || ':' || text || n1.r")} END"] if s == 0 else []
        again = f"CASE WHEN fault IN (0, 3) THEN {made(f'n{t}.c + {REROLE} + {late}', f"'R' || n{t}.w", f"chr(10) || '{role}:' || text || n{t}.r")} END"
        return least(made(f"n{s}.c + {DELETE}", f"'D' || n{s}.w", f"n{s}.r"), keep, *more, again)

    def inserted(s: int, of: str) -> str:
        t = f"{of}{NEXT[s]}"
        return made(f"{t}.c + {INSERT}", f"'I' || {t}.w", f"chr(10) || '{ROLE[s]}:' || {t}.r")

    end = {0: made(0, "''", "''"), 3: made(0, "''", "''"), 2: made(INSERT, "'I'", "chr(10) || 'assistant:'"), 1: made(2 * INSERT, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}
    each = lambda f: ", ".join(f(s) for s in range(4))
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    place = "turn NULLS FIRST, unhex(sha256(strlen(role) || ':' || role || text))"
    space = " || ".join(f"chr({ord(x)})" for x in SPACE)
    return f"""WITH RECURSIVE {CRC_TABLE},
ra AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(key)} % 20 AS k FROM conversations, crc),
da AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM ra WHERE k <> 0),
so AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, {space}) AS shorn, row_number() OVER (PARTITION BY conv_id ORDER BY {place}) AS i FROM da),
fa AS MATERIALIZED (SELECT *, CASE WHEN shorn = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(shorn, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM so),
be(conv_id, i, n0, n1, n2, n3) AS (SELECT conv_id, max(i) + 1, {each(end.get)} FROM fa GROUP BY conv_id
  UNION ALL SELECT conv_id, i, {each(lambda s: least(f"p{s}", inserted(s, "q")))} FROM (SELECT *, {each(lambda s: f"{least(f'p{s}', inserted(s, 'p'))} AS q{s}")} FROM
  (SELECT fa.conv_id, fa.i, {each(lambda s: f"{ways(s)} AS p{s}")} FROM be JOIN fa ON fa.conv_id IS NOT DISTINCT FROM be.conv_id AND fa.i = be.i - 1))),
co AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM fa GROUP BY conv_id)
SELECT a.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTS[:-1])}, coalesce(n0.c, 0) AS cost, coalesce(n0.w, '') AS audit, sha256(coalesce(n0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN co ON co.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN be ON be.conv_id IS NOT DISTINCT FROM a.conv_id AND be.i = 1"""


SQL = repair_sql()
