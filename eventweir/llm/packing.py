"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a task form one stream of tokens, in the order of the input. A sequence is a window of the stream of at most
`window` tokens; it is padded to `window` unless its length is a power of two. Windows are cut at document ends, or at sentence
ends (and, inside a sentence longer than a window, at any multiple of a window) for a penalty. With f(j) the least cost of the
stream up to cut point j,

    f(j) = penalty(j) + min over i with pos(j) - pos(i) <= window of f(i) + window - (pos(j) - pos(i)),

the minimum of f(i) + pos(i) over a sliding window, which a monotone queue gives in constant time per cut point; windows of exactly
a half and a quarter are tried beside it. The stream is worked off in blocks of documents, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import chunks
from eventweir.llm.pieces import pieces

WINDOW = 2048
END_ID = 1
#: Cost, in tokens of padding, of cutting a document at a sentence end, and inside a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 2, 64
#: Tokens of a block, about: each block ends a sequence.
BLOCK_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


def sentence_ends(vocab: dict[str, int]) -> np.ndarray:
    """By token id: whether the token ends a sentence (only . ! or ? and the mark of a word's end)."""
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if (s := t.removesuffix("</w>")) and not s.strip(".!?")]] = True
    return out


def cut_points(lengths: np.ndarray, ids: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, ascending, from 0 to its end; and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int8)
    cost[1:][ends[ids]] = SENTENCE_PENALTY
    cost[np.cumsum(lengths)] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    for k in np.flatnonzero(np.diff(at) > window).tolist():
        cost[at[k] + window // 4 : at[k + 1] : window // 4] = INNER_PENALTY
    at = np.flatnonzero(cost >= 0)
    return at, cost[at].astype(np.int64)


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The cut points (positions) of the cheapest windows, the first and the last position included."""
    pos, pen = at.tolist(), penalty.tolist()
    index = {p: k for k, p in enumerate(pos)}
    powers = [window // 2, window // 4] if window & (window - 1) == 0 else []
    cost, back = [0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        here = pos[j]
        while here - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + window - here + pos[i]
        for size in powers:
            if (k := index.get(here - size, -1)) >= 0 and cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + pen[j], i
        value = cost[j] + here
        while queue and cost[queue[-1]] + pos[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [pos[-1]], len(pos) - 1
    while j:
        j = back[j]
        out.append(pos[j])
    return out[::-1]


def packed_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, ends: np.ndarray, window: int, first: int) -> tuple[dict[str, list], int]:
    """The pieces of one block, and the number of its sequences; first: the id of its first sequence."""
    ids = ids.astype("<u4")
    at, penalty = cut_points(lengths, ids, ends, window)
    cuts = np.array(best_cuts(at, penalty, window))
    doc_at = np.concatenate([[0], np.cumsum(lengths)])
    edges = np.unique(np.concatenate([cuts, doc_at]))
    begin, end = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_at, begin, "right") - 1
    seq = np.searchsorted(cuts, begin, "right") - 1
    kind = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    raw = memoryview(ids.tobytes())
    return {
        "doc_id": [doc_ids[k] for k in doc.tolist()],
        "start": (begin - doc_at[doc]).tolist(),
        "length": (end - begin).tolist(),
        "ids_crc32": [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)],
        "doc_tokens": lengths[doc].tolist(),
        "sequence_id": (first + seq).tolist(),
        "offset": (begin - cuts[seq]).tolist(),
        "cut": [{0: "document", SENTENCE_PENALTY: "sentence"}.get(kind[e], "inner") for e in end.tolist()],
    }, len(cuts) - 1


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and cut (what the piece's end is).

    vocabulary: file of a vocabulary that drops white space. The order of the input is kept, task by task; sequence_id is the task's
    number times 2^32 and a count. A null or empty text is its end id alone. Rows that repeat an id are packed each by itself; a
    null id is carried. An empty table gives no rows.
    """
    encode_limit = block_tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(vocabulary, False)
        ends = sentence_ends(encoder.own.get_vocab(with_added_tokens=True))
        first = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        encoded: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, size
            if doc_ids:
                rows, n = packed_block(doc_ids, np.concatenate(lengths), np.concatenate(encoded), ends, window, first)
                first, size = first + n, 0
                for x in (doc_ids, lengths, encoded):
                    x.clear()
                yield pa.RecordBatch.from_pydict(rows, schema=FIELDS)

        for batch in chunks(batches):
            ids, n = encoder.encode_flat([x or "" for x in batch.column(1).to_pylist()], end_id)
            doc_ids += batch.column(0).to_pylist()
            lengths.append(n)
            encoded.append(ids)
            size += len(ids)
            if size >= encode_limit:
                yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)


FIELDS = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in SCHEMA.split(", ")])
