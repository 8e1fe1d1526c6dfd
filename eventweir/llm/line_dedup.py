"""Line dedup by winnowing over line hashes.

A line is deleted if it lies in a run of lines with at least GUARANTEE words that stands at an earlier place too: in a document before
this one (by id) or further up in the same text. Lines without words do not count and go with the run around them.

Lines are hashed; a gram is the shortest run of lines from a line on that has at least NOISE words, and its hash is made of its lines'
hashes. A window is a run from a line on that is no longer than GUARANTEE words take; of the grams inside it the one with the least
hash is selected. Equal windows select the same gram, so whatever is to be deleted holds a selected gram that is selected elsewhere
too, and only the places of such grams are looked at further.

A gram that is found at several places is extended both ways, line by line, to every shortest run of GUARANTEE words around it: those
that begin at a line before it, and those that end at a line after it. Each is joined, by a hash of 128 bits, with the first place of
all that has the same run. Every deleted line is in one of these runs, since a longer repeated run is made of them; so none is missed,
whichever document shares which part of it, and shorter matches never count. The first place of a run is not deleted by its copies:
every deleted line has an equal one earlier, so one copy of each stays.

Documents meet only through hashes: a run that a third of all documents share is found by a minimum, not by pairs. A text that repeats
itself costs two runs a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import chunks, joined_by_hubs, written

#: Words of a gram, and of the shortest repeated run that is deleted.
NOISE, GUARANTEE = 40, 50


def shortest_runs(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it with at least so many words; -1 if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least, "left")
    return np.where(end <= len(words), end, -1)


def shortest_runs_back(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the first line of the shortest run that ends with it and has at least so many words; -1 if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total[1:] - least, "right") - 1


def hashed_text(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of the lines with words: their numbers, how many words they have, and their hashes, 16 bytes each. White space at a line's ends
    does not count."""
    lines = [x.strip() for x in text.encode("utf-8", "replace").split(b"\n")]
    at = [k for k, x in enumerate(lines) if x]
    digest = xxhash.xxh3_128_digest
    return np.array(at, np.int32), np.fromiter((len(lines[k].split()) for k in at), np.int32, len(at)), b"".join([digest(lines[k]) for k in at])


def winnowed(words: np.ndarray, raw: bytes, noise: int = NOISE, guarantee: int = GUARANTEE) -> tuple[np.ndarray, np.ndarray]:
    """By line: its gram's hash (0: none), and the line of the gram that the window from it selects (-1: no window)."""
    gram_end, window_end = shortest_runs(words, noise), shortest_runs(words, guarantee)
    grams, choice = np.zeros(len(words), np.uint64), np.full(len(words), -1, np.int64)
    if not len(words) or window_end[0] < 0:
        return grams.view(np.int64), choice
    starts = np.flatnonzero(gram_end >= 0)
    digest = xxhash.xxh3_64_intdigest
    grams[starts] = np.fromiter((digest(raw[16 * s : 16 * e]) for s, e in zip(starts.tolist(), gram_end[starts].tolist(), strict=True)), np.uint64, len(starts))
    gram, inside = grams.tolist(), gram_end.tolist()
    for line, stop in enumerate(window_end.tolist()):
        if stop < 0:
            break
        best, at = gram[line], line
        for k in range(line + 1, stop):
            if inside[k] < 0 or inside[k] > stop:
                break
            if gram[k] <= best:
                best, at = gram[k], k
        choice[line] = at
    return grams.view(np.int64), choice


def extended(words: np.ndarray, raw: bytes, choice: np.ndarray, repeated: np.ndarray, guarantee: int = GUARANTEE) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs around repeated grams (by the line of the gram): from each line whose window selected
    one, and to each line where a run ends that begins at such a line."""
    wanted = np.zeros(len(words) + 1, bool)  # the last one stands for: no window
    wanted[:-1] = np.isin(choice, repeated) & (choice >= 0)
    begin = np.flatnonzero(wanted)
    ahead = shortest_runs(words, guarantee)[begin] - 1
    back = shortest_runs_back(words, guarantee)
    last = np.flatnonzero(wanted[back])
    runs = np.unique(np.concatenate([np.column_stack([begin, ahead]), np.column_stack([back[last], last])]), axis=0)
    return runs[:, 0], runs[:, 1]


KEY = "doc long, tie long"


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, noise: int, guarantee: int) -> DataFrame:
    """A row for each text: doc and tie (its key), lines, words and hashes (bytes), grams (array of line and hash). Texts too short to
    hold a run: none."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("lines", pa.binary()), ("words", pa.binary()), ("hashes", pa.binary()), ("grams", pa.list_(pa.struct([("line", pa.int32()), ("gram", pa.int64())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: dict[str, list] = {name: [] for name in schema.names}
            for doc, tie, text in zip(*(batch.column(k).to_pylist() for k in ("doc", "tie", "text")), strict=True):
                lines, words, raw = hashed_text(text or "")
                grams, choice = winnowed(words, raw, noise, guarantee)
                chosen = np.unique(choice[choice >= 0])
                if chosen.size:
                    own = [{"line": a, "gram": b} for a, b in zip(chosen.tolist(), grams[chosen].tolist(), strict=True)]
                    for name, x in zip(schema.names, (doc, tie, lines.tobytes(), words.tobytes(), raw, own), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(*key(id_col, text_col), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"{KEY}, lines binary, words binary, hashes binary, grams array<struct<line:int,gram:long>>")


def key(id_col: str, text_col: str) -> list:
    """Documents are ordered by id (null first), then by their text's hash; rows that agree in both are one document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("tie")]


def runs_of(rows: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """From rows (doc, tie, lines, words, hashes, repeated): each run around a repeated gram with its hash (high, low) and its first
    and last line in the text."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in chunks(batches, 64):
            for doc, tie, lines, words, raw, repeated in zip(*(batch.column(k).to_pylist() for k in ("doc", "tie", "lines", "words", "hashes", "repeated")), strict=True):
                words, lines = np.frombuffer(words, np.int32), np.frombuffer(lines, np.int32)
                _, choice = winnowed(words, raw, noise, guarantee)
                begin, last = extended(words, raw, choice, np.array(repeated), guarantee)
                hashes = np.frombuffer(b"".join([digest(raw[16 * a : 16 * b + 16]) for a, b in zip(begin.tolist(), last.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                whose = [pa.array(np.full(len(begin), x)) for x in (doc, tie)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *whose, pa.array(lines[begin]), pa.array(lines[last])], schema=schema)

    return rows.mapInArrow(work, f"high long, low long, {KEY}, first int, last int")


def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc, tie, runs of first and last line) an array that says of each line, up to the last deleted one, whether it goes."""
    for batch in chunks(batches):
        out = []
        for runs in batch.column("runs"):
            first, last = (x.to_numpy(zero_copy_only=False) for x in runs.values.flatten())
            steps = np.zeros(int(last.max()) + 2, np.int32)
            np.add.at(steps, first, 1)
            np.add.at(steps, last + 1, -1)
            out.append(np.cumsum(steps)[:-1] > 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(out, pa.list_(pa.bool_()))], ["doc", "tie", "deleted"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """Rows (doc, tie, deleted): of each document with repeated runs, by line, from 0: whether it is to be deleted."""
    if not 0 < noise <= guarantee:
        raise ValueError("noise: above 0, at most guarantee")
    lines = written(hashed_lines(docs, id_col, text_col, noise, guarantee).dropDuplicates(["doc", "tie"]), "lines")
    grams = lines.select("doc", "tie", F.explode("grams").alias("g")).select("doc", "tie", "g.line", "g.gram")
    several = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "line-grams")
    total = several.agg(F.sum("n")).first()[0] or 0
    found = joined_by_hubs(grams, several, ["gram"], total).groupBy("doc", "tie").agg(F.collect_list("line").alias("repeated"))
    runs = written(runs_of(lines.drop("grams").join(found, ["doc", "tie"]), noise, guarantee), "line-runs")
    place = F.struct("doc", "tie", "first")
    earliest = written(runs.groupBy("high", "low").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1"), "line-earliest")
    total = earliest.agg(F.sum("n")).first()[0] or 0
    later = joined_by_hubs(runs, earliest, ["high", "low"], total).where(place != F.col("earliest"))
    # as many runs as the text has lines, twice
    of = later.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return written(of.mapInArrow(flags, f"{KEY}, deleted array<boolean>"), "line-deletions")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """All rows of docs, their columns and removed_lines (int); the text without the lines of repeated runs.

    A text all of whose lines go becomes empty, and the row stays; a null text stays null. Repeated runs inside one text count too.
    Rows that repeat an id and a text count as one document and get the same result. Clashing columns doc, tie and deleted of docs
    are kept; removed_lines is replaced.
    """
    docs = docs.drop("removed_lines")
    gone = repeated_lines(docs, id_col, text_col, noise, guarantee).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("deleted").alias("_deleted"))
    doc, tie = key(id_col, text_col)
    rows = docs.select("*", doc.alias("_doc"), tie.alias("_tie")).join(gone.hint("merge"), ["_doc", "_tie"], "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.coalesce(F.get("_deleted", i), F.lit(False))), "\n")
    text = F.when(F.col("_deleted").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    count = F.coalesce(F.size(F.filter("_deleted", lambda x: x)), F.lit(0))
    return rows.select(*[text if c == text_col else F.col(c) for c in docs.columns], F.when(F.col("_deleted").isNull(), 0).otherwise(count).alias("removed_lines"))
