"""SimHash near-duplicates by pigeonhole blocks.

A text gets a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of the text's word shingles. Fingerprints
within 3 bits of each other link. Five blocks of 13 or 12 bits: two fingerprints that differ in at most 3 bits agree on at least
two blocks, so each fingerprint goes to the ten buckets named by a pair of its blocks (26 bits or less), buckets are joined, and
the candidates are verified by Hamming distance.

Texts with one fingerprint are one class from the start: only classes enter the buckets, so exact copies cost one row however many
they are, and a bucket of many near copies is dealt out in blocks (common.within_buckets).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import chunks, connected, within_buckets, written

DISTANCE = 3
SHINGLE = 3
SEED = 42
BITS = (13, 13, 13, 13, 12)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number. Null, empty or without a word: zero."""
    data = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    if not data:
        return 0
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    ends = np.append(starts[1:] - 1, len(data))
    n = max(1, len(starts) - shingle + 1)
    last = ends[min(shingle, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp): the id and the fingerprint as a signed long of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, fp long")


def block_keys(fp: Column) -> Column:
    """The ten bucket numbers of a fingerprint: which two blocks (upper bits) and their bits."""
    blocks, at = [], 0
    for width in BITS:
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        at += width
    return F.array(*[F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(blocks[a], 13)).bitwiseOR(blocks[b]) for k, (a, b) in enumerate(combinations(range(len(BITS)), 2))])


class Near:
    """Fingerprints within DISTANCE bits; nothing is counted."""

    @staticmethod
    def prepare(x: dict) -> dict:
        return x

    @staticmethod
    def pairs(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x["fp"][i] ^ x["fp"][j]).view(np.uint64)) <= DISTANCE

    @staticmethod
    def matrix(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        links = np.bitwise_count((left["fp"][:, None] ^ right["fp"][None, :]).view(np.uint64)) <= DISTANCE
        return links, np.zeros(links.shape, bool)


def classes(prints: DataFrame) -> DataFrame:
    """From rows (id, fp): one row (fp, rep, component) per fingerprint; rep is the smallest id that has it, component the smallest
    id reachable by links. A fingerprint that only rows without an id have has no rep; its component is null."""
    reps = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    known = reps.where("rep is not null")
    rows = known.select(F.explode(block_keys(F.col("fp"))).alias("bucket"), F.col("rep").alias("id"))
    payload = known.select(F.col("rep").alias("id"), "fp", F.lit(1).cast("long").alias("weight"))
    edges, _ = within_buckets(rows, payload, Near, "simhash")
    found = connected(edges, "simhash-links")
    return written(reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "rep", F.coalesce("component", "rep").alias("component")), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint as 16 hex digits, component_id), one per row of docs.

    Null and empty texts have fingerprint zero and so are one class. Rows that repeat an id each get a row. A row with a null id
    gets its class's component, null if no row of the class has an id. Other columns of docs are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    out = prints.join(classes(prints), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with its smallest id. Rows that repeat that id are all but one left
    out (which of them is decided by their fingerprint, then by their text's hash); rows without an id stay. Columns as in docs.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    found = classes(prints)
    keep = found.where("rep = component").select(F.col("rep").alias("_keep"), F.col("fp").alias("_fp")).groupBy("_keep").agg(F.min("_fp").alias("_fp"))
    stay = docs.withColumn("_key", F.col(id_col).cast("long"))
    repeated = prints.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    out = stay.join(keep.select(F.col("_keep").alias("_key")), "_key", "left_semi").unionByName(stay.where("_key is null"))
    if repeated.limit(1).count():
        tie = F.xxhash64(text_col)
        again = out.join(repeated.withColumnRenamed("id", "_key"), "_key", "left_semi")
        one = again.groupBy("_key").agg(F.min_by(F.struct(*docs.columns), F.struct(tie, *[F.col(c).cast("string") for c in docs.columns])).alias("_row")).select("_row.*")
        out = out.join(repeated.withColumnRenamed("id", "_key"), "_key", "left_anti").select(*docs.columns).unionByName(one)
    return out.select(*docs.columns)
