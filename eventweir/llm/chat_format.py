r"""Chat formatting by token-level assembly.

A conversation becomes one sequence of token ids. Each turn's role and text are encoded separately, so no token spans a border, and
reserved ids, which no text can produce, are spliced in for the template's control strings:

    <s> [INST] text [/INST]          a user turn
    <s> [SYS] text [/SYS]            a system turn
    <s> [ROLE] role [TEXT] text [/ROLE]   a turn of any other role
    <s> text </s>                    an assistant turn; its text is what is learned

The loss mask comes from the segments' lengths by prefix sums. As the formatted sequence may also be written out as a string,
control strings that occur in a text are escaped: every backslash is doubled, and a backslash is put after a control string's first
character. Read from the left, a doubled backslash is one, any other is dropped; so escaping is reversible and an escaped text holds
no control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.llm.common import held, scratch_path
from eventweir.llm.pieces import Pieces, byte_values

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\(\\?)")
#: By role: what stands before and after the text.
TEMPLATE = {"assistant": (["<s>"], ["</s>"]), "user": (["<s>", "[INST]"], ["[/INST]"]), "system": (["<s>", "[SYS]"], ["[/SYS]"])}
LEARNED = "assistant"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1], text)


class Codec:
    """Ids of a byte-level vocabulary and, after it, one reserved id per control string."""

    def __init__(self, vocabulary: str):
        self.pieces = Pieces(vocabulary, True)
        self.base = self.pieces.own.get_vocab_size(with_added_tokens=True)
        self.reserved = {c: self.base + k for k, c in enumerate(CONTROLS)}
        to_byte = byte_values()
        self.bytes = [b""] * self.base
        for token, number in self.pieces.own.get_vocab(with_added_tokens=True).items():
            self.bytes[number] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask (uint8) of the turns (role, text)."""
        segments: list[str | int] = []
        learned: list[int] = []
        for role, text in turns:
            if role in TEMPLATE:
                before, after = TEMPLATE[role]
                segments += [self.reserved[c] for c in before]
            else:
                segments += [self.reserved["<s>"], self.reserved["[ROLE]"], escaped(role), self.reserved["[TEXT]"]]
                after = ["[/ROLE]"]
            if role == LEARNED:
                learned.append(len(segments))
            segments.append(escaped(text))
            segments += [self.reserved[c] for c in after]
        encoded = iter(self.pieces.encode([x for x in segments if isinstance(x, str)]))
        ids = [next(encoded) if isinstance(x, str) else np.array([x], np.int32) for x in segments]
        ends = np.cumsum([len(x) for x in ids])
        marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
        for k in learned:
            marks[ends[k - 1]] += 1
            marks[ends[k]] -= 1
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(marks)[:-1].astype(np.uint8)

    def text(self, ids: list[int]) -> str:
        return b"".join([self.bytes[k] for k in ids]).decode("utf-8", "replace")

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """The turns back from the ids."""
        where = np.flatnonzero(ids >= self.base).tolist()
        names = [CONTROLS[k - self.base] for k in ids[where].tolist()]
        role = LEARNED
        for k, name in enumerate(names[:-1]):
            between = unescaped(self.text(ids[where[k] + 1 : where[k + 1]].tolist()))
            if name == "<s>":
                role = {"[INST]": "user", "[SYS]": "system"}.get(names[k + 1], LEARNED)
                if names[k + 1] == "</s>":
                    yield role, between
            elif name in ("[INST]", "[SYS]", "[TEXT]"):
                yield role, between
            elif name == "[ROLE]":
                role = between

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, unescaped, one per turn."""
        # a turn without text has no masked id; what separates two runs of masked ids is never masked
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        return [unescaped(self.text(ids[a:b].tolist())) for a, b in runs.reshape(-1, 2).tolist()]

    def string(self, ids: np.ndarray) -> str:
        """The formatted sequence as a string."""
        out, at = [], 0
        for k in np.flatnonzero(ids >= self.base).tolist():
            out += [self.text(ids[at:k].tolist()), CONTROLS[int(ids[k]) - self.base]]
            at = k + 1
        return "".join([*out, self.text(ids[at:].tolist())])


def codec(vocabulary: str) -> Codec:
    return held(("chat", vocabulary), lambda: Codec(vocabulary))


SCHEMA = "conv_id long, n_turns int, ids array<int>, mask binary"
FIELDS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int32()), ("ids", pa.list_(pa.int32())), ("mask", pa.binary())])


def assemble(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text): conv_id, n_turns, ids, mask (a byte per id, 1: learned).

    Turns are ordered by turn (null first), then role and text; rows that repeat a turn are turns of their own. A null text or role is
    empty; an empty role is one of "any other". Rows without a conv_id are one conversation. Other columns are not read. A task holds
    one conversation at a time.
    """
    at = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(at, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        done: dict[str, list] = {f.name: [] for f in FIELDS}
        current: int | None = None
        open_: list[tuple[str, str]] = []

        def close() -> None:
            if open_:
                ids, mask = own.assemble(open_)
                for k, v in zip(done, (current, len(open_), ids, mask.tobytes()), strict=True):
                    done[k].append(v)
                open_.clear()

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if conv != current:
                    close()
                    current = conv
                open_.append((role, text))
                if len(done["ids"]) >= 512:
                    yield pa.RecordBatch.from_pydict(done, schema=FIELDS)
                    done = {f.name: [] for f in FIELDS}
        close()
        yield pa.RecordBatch.from_pydict(done, schema=FIELDS)

    return rows.mapInArrow(work, SCHEMA)


def digests(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """Read back from a written table: conv_id, n_turns, turns_sha256 (of role, line break, text, line break of each turn), loss_chars,
    loss_sha256 (of all learned text), formatted_chars (of the formatted string)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            rows: list[dict] = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask").to_pylist(), strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False)
                turns = list(own.turns(ids))
                loss = "".join(own.learned(ids, np.frombuffer(mask, np.uint8)))
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha256(told), "loss_chars": len(loss), "loss_sha256": sha256(loss), "formatted_chars": len(own.string(ids))})
            yield pa.RecordBatch.from_pylist(rows, schema=DIGESTS)

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the assembled conversations to the shared folder and returns the digests read back."""
    path = scratch_path(turns.sparkSession, "chat")
    assemble(turns, vocabulary).write.parquet(path)
    return digests(turns.sparkSession, path, vocabulary)
