"""Token files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

A token's number is its rank by frequency in the whole corpus (ties: the smaller id first), so most numbers take one byte. Four
numbers share a control byte of four 2-bit lengths (1 to 4 bytes); their bytes follow in a stream of their own, least significant
first. Control byte and data being apart, a reader finds every number's length and place by table lookup and prefix sums, without
a loop over numbers.

A file set is a folder with three Parquet tables: `ranks` (rank, id, n); `documents`, whose files in name order hold the documents
in ascending id order, a row each: doc_id, part (number of the file), start (tokens before it in the file), n_tokens, control, data;
and `parts` (part, n, before: tokens of all files before it). Texts are encoded where they lie; only their ids are shuffled, once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.llm.common import chunks, ragged, scratch_path, written
from eventweir.llm.pieces import pieces

END_ID = 2
#: By control byte: the lengths of its four numbers.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encoded_all(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes documents that follow each other in an array of unsigned 32-bit numbers, counts[k] numbers each: control bytes, data bytes,
    and the ends of each document's control and data bytes. A document's control bytes are its own: the last one is filled up."""
    x = numbers.astype("<u4")
    controls = -(-counts // 4)
    control_ends = np.cumsum(controls)
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    size = np.ones(len(x), np.uint8)
    for k in range(1, width):
        size += x >= 1 << 8 * k
    codes = np.zeros(int(controls.sum()) * 4, np.uint8)
    codes[ragged(4 * (control_ends - controls), counts)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    begin = ends - size
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[begin] = x.astype(np.uint8)
    for k in range(1, width):
        long = np.flatnonzero(size > k)
        data[begin[long] + k] = (x[long] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data, control_ends, np.concatenate([[0], ends])[np.cumsum(counts)]


def decoded_all(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers (uint32) of documents that follow each other, back from their bytes."""
    controls = -(-counts // 4)
    size = LENGTHS[control].reshape(-1)[ragged(4 * (np.cumsum(controls) - controls), counts)].astype(np.int64)
    begin = np.cumsum(size) - size
    raw = np.concatenate([data, np.zeros(3, np.uint8)])
    out = raw[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > k)
        out[long] |= raw[begin[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose values follow each other in data."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value after the other, and the length of each."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, np.diff(offsets)


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes every whole text with a byte-level vocabulary, appends end_id to each document and writes the file set to path.

    A null or empty text is its end id alone. Documents that repeat an id follow each other, ordered by their text's hash; a null id
    comes first. An empty table gives a file set without documents.
    """
    spark = docs.sparkSession
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(vocabulary, True)
        size = max(encoder.own.get_vocab_size(), end_id + 1)
        width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        counts = np.zeros(size, np.int64)
        for batch in chunks(batches):
            ids, n = encoder.encode_flat([x or "" for x in batch.column("text").to_pylist()], end_id)
            counts += np.bincount(ids, minlength=size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n), binaries(ids.astype(width).view(np.uint8), np.cumsum(n) * width.itemsize), pa.nulls(len(n), pa.binary())], TOKENS.names)
        if counts.any():  # the ids that occur in the task's texts and their counts are a row of their own
            ids = np.flatnonzero(counts)
            found = np.zeros(len(ids), COUNTS)
            found["id"], found["n"] = ids, counts[ids]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, TOKENS.field(k).type) for k in range(4)], pa.array([found.tobytes()], pa.binary())], TOKENS.names)

    table = written(rows.mapInArrow(tokens, "doc_id long, tie long, n_tokens long, ids binary, counts binary"), "tokens")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array(counts["id"].astype(np.int64)), pa.array(counts["n"].copy())], ["id", "n"])

    # one row per token of the vocabulary, so its size bounds what comes to the driver
    ranks = table.where("counts is not null").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ranks.insert(0, "rank", np.arange(len(ranks)))
    spark.createDataFrame(ranks if len(ranks) else [], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranks["id"].max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks["id"].to_numpy()] = ranks["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(rank_of)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, before = shared.value, TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            n = batch.column("n_tokens").to_numpy()
            raw, _ = values_of(batch.column("ids"))
            ends = np.cumsum(n)
            control, data, control_ends, data_ends = encoded_all(of[raw.view("<u2" if len(raw) == 2 * ends[-1] else "<u4")], n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(before + ends - n), batch.column("n_tokens"), binaries(control, control_ends), binaries(data, data_ends)], DOCUMENTS.names)
            before += int(ends[-1])

    ordered = table.where("counts is null").drop("counts").repartitionByRange(at, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(coded, DOCUMENTS).write.parquet(f"{path}/documents")
    # one row per file, from the footers' columns alone
    parts = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents").groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    parts["before"] = parts["n"].cumsum() - parts["n"]
    spark.createDataFrame(parts if len(parts) else [], "part int, n long, before long").coalesce(1).write.parquet(f"{path}/parts")


#: An id and how often it occurs.
COUNTS = np.dtype([("id", "<u4"), ("n", "<i8")])
TOKENS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start, n_tokens, ids (array<int>)."""

    def listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))

    return _decoded(spark, path, listed, "ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each document of a file set, from its decoded ids: doc_id, start, n_tokens, ids_crc32."""

    def crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw, at = memoryview(ids.astype("<u4")).cast("B"), [0, *(4 * ends).tolist()]
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return _decoded(spark, path, crc, "ids_crc32 long")


def _decoded(spark: SparkSession, path: str, made, column: str) -> DataFrame:
    ranks = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").toPandas()  # the size of the vocabulary at most
    id_of = np.zeros(max(1, len(ranks)), np.int32)
    id_of[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    parts = spark.read.schema("part int, n long, before long").parquet(f"{path}/parts").toPandas()  # one row per file
    offset = np.zeros(int(parts["part"].max()) + 1 if len(parts) else 1, np.int64)
    offset[parts["part"].to_numpy()] = parts["before"].to_numpy()
    shared = spark.sparkContext.broadcast((id_of, offset))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, before = shared.value
        for batch in chunks(batches):
            control, controls = values_of(batch.column("control"))
            data, _ = values_of(batch.column("data"))
            n = batch.column("n_tokens").to_numpy()
            if (controls != -(-n // 4)).any():
                raise ValueError("control bytes do not fit the number of tokens")
            ids = of[decoded_all(control, data, n)]
            start = batch.column("start").to_numpy() + before[batch.column("part").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), made(ids, np.cumsum(n))], ["doc_id", "start", "n_tokens", column.split()[0]])

    return spark.read.schema(DOCUMENTS).parquet(f"{path}/documents").mapInArrow(work, f"doc_id long, start long, n_tokens long, {column}")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes a file set to the shared folder and returns the digests read back from it."""
    path = scratch_path(docs.sparkSession, "token-file")
    write(docs, path, vocabulary)
    return digests(docs.sparkSession, path)
