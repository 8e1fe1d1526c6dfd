"""Quality rules: rule counts of every text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to BUCKETS features. Two multinomials over them, each smoothed by one count per
bucket, are estimated: the raw corpus, from every word of every document, and the trusted target, from every word of every trusted
document. A document's score is its mean log ratio of target to raw over its features, so length does not matter. Every document is
held against one threshold: the score that only TAIL of all trusted documents fall below, or, if lower, the score that parts all trusted
from all distrusted documents best. Nothing is sampled: labels meet texts in a shuffled join, and scores are ranked by running counts
inside ranges of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweir.llm.common import chunks, held, with_columns, written

BUCKETS = 1 << 14
TAIL = 0.005
#: Rules of the base filter: fewer words than this fail; so does a larger share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
#: Words that a worker remembers, and the length in bytes of the longest that it does.
REMEMBERED, LONGEST = 600_000, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class TooLong(Exception):
    """A word that is not remembered."""


class Words(dict):
    """Numbers of words (bytes); remembers their hashes. Long ones are refused, so they are always new."""

    def __init__(self):
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST:
            raise TooLong
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hash of each word; those of a text with a very long one are not remembered."""
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except TooLong:
            at = None
        if self.fresh:
            begin = len(self) - len(self.fresh)
            while len(self) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[begin : len(self)] = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), np.uint64, len(self.fresh))
            self.fresh = []
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) if at is None else self.hashes[at]


def word_hashes(data: bytes) -> np.ndarray:
    words = held("quality", Words)
    if len(words) > REMEMBERED:
        words.clear()
    return words.of(data.split())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = mixed(hashes[:-1] * _A + hashes[1:])
    return (np.concatenate([mixed(hashes), pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def rules(data: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    letters = data.translate(None, SPACE)
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                repeated_lines += 1
            else:
                seen.add(line)
    n = len(hashes)
    repeated = 0
    if n > REPEAT_WINDOW:
        windows = np.zeros(n - REPEAT_WINDOW + 1, np.uint64)
        for k in range(REPEAT_WINDOW):
            windows = mixed(windows) * _A + hashes[k : k + len(windows)]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            often = np.zeros(len(windows), bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.flatnonzero(often), 1)
            np.add.at(steps, np.flatnonzero(often) + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(steps)[:-1] > 0).sum())
    return n, len(letters.decode("utf-8", "replace")), len(data) - len(data.translate(None, SYMBOLS)), repeated_lines, repeated


@dataclass
class Ratio:
    weight: np.ndarray  # by bucket: log of target share over raw share
    threshold: float = -np.inf

    def score(self, hashes: np.ndarray) -> float:
        return float(self.weight[features(hashes)].mean()) if len(hashes) else 0.0


def kinds(labels: DataFrame, trusted: Column, distrusted: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, kind), one per labelled id: 1 trusted, 0 distrusted (also if it is both). The conditions are on labels, which has id_col.
    A written table, so that adaptive execution can split joins with it where many rows have one id or none."""
    kind = F.when(trusted, 1).when(distrusted, 0)
    marked = labels.select(F.col(id_col).cast("long").alias("id"), kind.alias("kind")).where("kind is not null and id is not null")
    return written(marked.groupBy("id").agg(F.min("kind").alias("kind")), "quality-kinds")


def weighed(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """The weights, without a threshold, from every row of docs; marked as of kinds. If no trusted row has a word every weight is 0."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in chunks(batches):
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    one = np.bincount(features(word_hashes(text.encode("utf-8", "replace"))), minlength=BUCKETS)
                    counts[0] += one
                    if kind == 1:
                        counts[1] += one
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "raw", "target"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(marked.hint("shuffle_hash"), "id", "left").select("text", "kind")  # texts are shuffled, but not sorted
    totals = texts.mapInArrow(counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows at most
    if not totals["target"].any():
        return Ratio(np.zeros(BUCKETS))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[totals["bucket"].to_numpy()] += totals["raw"].to_numpy()
    target[totals["bucket"].to_numpy()] += totals["target"].to_numpy()
    return Ratio(np.log(target / target.sum()) - np.log(raw / raw.sum()))


def calibrated(scored: DataFrame, marked: DataFrame, id_col: str = "doc_id") -> float:
    """The threshold from all labelled rows of scored (id_col and RULES) with LEAST_WORDS words; minus infinity without trusted ones.

    Distinct scores are dealt out in ranges, with how many trusted and distrusted rows have each; what lies below a score is a sum over
    the ranges before (a row per range comes to the driver) and a running sum inside its own.
    """
    own = scored.where(F.col("n_words") >= LEAST_WORDS).select(F.col(id_col).cast("long").alias("id"), "score").join(marked.hint("shuffle_hash"), "id")
    values = own.groupBy("score").agg(F.sum("kind").alias("good"), F.sum(1 - F.col("kind")).alias("bad"))
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = written(values.repartitionByRange(ranges, "score").withColumn("part", F.spark_partition_id()), "quality-scores")
    parts = values.groupBy("part").agg(F.min("score").alias("least"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("least")
    good, bad = int(parts["good"].sum()), int(parts["bad"].sum())
    if not good:
        return -np.inf
    before = zip(parts["part"].tolist(), (parts["good"].cumsum() - parts["good"]).tolist(), (parts["bad"].cumsum() - parts["bad"]).tolist(), strict=True)
    before = scored.sparkSession.createDataFrame(list(before), "part int, good_before long, bad_before long")
    inside = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow)
    below = lambda c: F.col(f"{c}_before") + F.sum(c).over(inside) - F.col(c)
    ranked = values.join(F.broadcast(before), "part").select("score", "good", below("good").alias("good_below"), below("bad").alias("bad_below"))
    rank = TAIL * (good - 1)
    at = lambda k: F.min(F.when(F.col("good_below") + F.col("good") > k, F.col("score")))
    # the gain in whole numbers: share of distrusted below less share of trusted below, times both sizes; of equal ones the lowest score
    gain = F.col("bad_below") * good - F.col("good_below") * bad
    low, high, best = ranked.agg(at(int(np.floor(rank))), at(int(np.ceil(rank))), F.max(F.struct(gain, -F.col("score")))).first()
    tail = low + (high - low) * (rank - np.floor(rank))
    return float(min(tail, -best[1]) if bad else tail)


def train(docs: DataFrame, labels: DataFrame, trusted: Column, distrusted: Column, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """trusted and distrusted are conditions on labels, which has id_col. Every row of docs and every label counts. Without trusted rows
    every weight is 0 and the threshold lets all pass."""
    marked = kinds(labels, trusted, distrusted, id_col)
    ratio = weighed(docs, marked, id_col, text_col)
    ratio.threshold = calibrated(judge(docs.select(id_col, text_col), ratio, text_col), marked, id_col)
    return ratio


def graded(docs: DataFrame, labels: DataFrame, trusted: Column, distrusted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What train and then judge give, as rows of id_col and the columns of RULES. The texts are scored once: the threshold is found in
    the scores that are written."""
    marked = kinds(labels, trusted, distrusted, id_col)
    ratio = weighed(docs, marked, id_col, text_col)
    scored = written(judge(docs.select(id_col, text_col), ratio, text_col).drop(text_col), "quality-scored")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= calibrated(scored, marked, id_col)))


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, ratio: Ratio, text_col: str = "text") -> DataFrame:
    """docs and the columns of RULES. A null or empty text has no words and fails. Columns of docs with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def judged(texts: list[str | None]) -> list[tuple]:
        own = shared.value
        rows = []
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            hashes = word_hashes(data)
            counts = rules(data, hashes)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
            score = own.score(hashes)
            rows.append((*counts, failed, score, not failed and score >= own.threshold))
        return list(zip(*rows, strict=True))

    texts = docs.withColumn("_text", F.col(text_col).cast("string"))
    return with_columns(texts, ["_text"], RULES, judged).drop("_text")
