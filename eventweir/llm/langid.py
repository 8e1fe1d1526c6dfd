"""Language ID by interpolated Kneser-Ney character models, one per language.

A model predicts the characters of a word, and its end, from up to ORDER - 1 characters before them in the word. The highest order
holds counts, lower orders hold continuation counts (in how many contexts a gram was seen); each order is discounted and interpolated
with the next lower one, the lowest with a uniform distribution over the alphabet.

All languages share sorted arrays of gram hashes, one per order, with a row of numbers per hash: the discounted share of each
language and, for contexts, its interpolation weight. A text's score in a language is its cross-entropy, bits per character; the
lowest one wins. The cross-entropies that documents of a language have in their own model calibrate rejection.

Learning counts grams over all labelled documents and calibrates on all of them; prediction reads every whole text and nothing but
the text. What comes to the driver and to workers is a row per distinct gram.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import chunks, held, with_columns, written

ORDER = 5
DISCOUNT = 0.75
#: Distinct words that a task counts before it passes their grams on.
LEARNED = 200_000
#: Symbols of grams before and after a word; no letters.
BEFORE, AFTER = " ", "."
#: A text is rejected if its cross-entropy is this many bits above all but this share of its language's documents.
SLACK, TAIL = 0.75, 0.001
#: Of percentile_approx: ranks are right to one in so many.
ACCURACY = 100_000
#: Bits by which one symbol may be off by chance, taken three times over: a text of n symbols is allowed NOISE / sqrt(n) more.
NOISE = 7.5
#: Letters with a number of their own; rarer ones share OTHER. 0 stands before a word, END after it.
LETTERS, END, OTHER = 252, 1, 2
#: Words whose scores a worker remembers; beyond it, it starts again. Longer ones than LONGEST letters are not remembered.
REMEMBERED, LONGEST = 300_000, 64
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(packed: np.ndarray) -> np.ndarray:
    """Bijective hash of packed grams (8 bits a character, at most seven)."""
    x = packed.astype(np.uint64) * _MIX
    return x ^ (x >> np.uint64(29))


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _WORDS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Model:
    languages: list[str]
    number: dict[str, int]  # of letters
    keys: list[np.ndarray] = field(default_factory=list)  # by order: sorted gram hashes
    share: list[np.ndarray] = field(default_factory=list)  # by order: (grams, languages), discounted share of the gram after its context
    contexts: list[np.ndarray] = field(default_factory=list)  # by order: sorted context hashes
    weight: list[np.ndarray] = field(default_factory=list)  # by order: (contexts, languages), interpolation weight
    limit: np.ndarray | None = None  # by language: rejection above it
    typical: np.ndarray | None = None  # by language: mean cross-entropy of its own documents

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ORDER packed positions: for each predicted symbol of each word its gram's codes, and the word it belongs to."""
        number = self.number
        pad = [0] * (ORDER - 1)
        flat: list[int] = []
        sizes = []
        for w in words:
            flat += pad
            flat += [number.get(c, OTHER) for c in w]
            flat.append(END)
            sizes.append(len(w) + 1)
        seq, size = np.array(flat, np.uint64), np.array(sizes)
        begin = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[word]
        return seq[at[:, None] + np.arange(ORDER)], word

    def symbol_bits(self, grams: np.ndarray) -> np.ndarray:
        """(symbols, languages): the bits that each model needs for the last symbol of each gram."""
        p = np.full((len(grams), len(self.languages)), 1.0 / (LETTERS + 3))
        for k in range(1, ORDER + 1):
            context = packed(grams[:, ORDER - k : ORDER - 1])
            gram = (context << np.uint64(8)) | grams[:, ORDER - 1]
            p = found(self.contexts[k - 1], self.weight[k - 1], hashed(context), 1.0) * p + found(self.keys[k - 1], self.share[k - 1], hashed(gram), 0.0)
        return -np.log2(p)

    def word_bits(self, words: list[str]) -> np.ndarray:
        """(words, languages): the bits that each model needs for each word with its end."""
        grams, word = self.codes(words)
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, word, self.symbol_bits(grams))
        return out

    def long_bits(self, word: str) -> np.ndarray:
        """The same for one word of any length."""
        grams = self.codes([word])[0]
        return sum(self.symbol_bits(grams[a : a + 20_000]).sum(0) for a in range(0, len(grams), 20_000))


def packed(codes: np.ndarray) -> np.ndarray:
    out = np.ones(len(codes), np.uint64)  # a leading one tells lengths apart
    for k in range(codes.shape[1]):
        out = (out << np.uint64(8)) | codes[:, k].astype(np.uint64)
    return out


def found(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], rows[at], otherwise)


def grams_of(words: dict[str, int]) -> dict[str, int]:
    """Grams of ORDER characters and how often they are in words that are there so often."""
    out: defaultdict[str, int] = defaultdict(int)
    for w, n in words.items():
        symbols = f"{BEFORE * (ORDER - 1)}{w}{AFTER}"
        for k in range(len(w) + 1):
            out[symbols[k : k + ORDER]] += n
    return out


def fit(words: pd.DataFrame) -> Model:
    """A model from rows (lang, word, n): how often each language has each word."""
    rows = [(lang, g, n) for lang, own in words.groupby("lang") for g, n in grams_of(own.groupby("word")["n"].sum().to_dict()).items()]
    lang, gram, n = zip(*rows, strict=True) if rows else ((), (), ())
    return fit_grams(pa.table({"lang": pa.array(lang, pa.string()), "gram": pa.array([spelled(g) for g in gram], pa.binary()), "n": pa.array(n, pa.int64())}))


def spelled(gram: str) -> bytes:
    """A gram as its code points, four bytes each."""
    return gram.encode("utf-32-le", "surrogatepass")


def fit_grams(grams: pa.Table) -> Model:
    """A model from rows (lang, gram, n): how often each language has each gram of ORDER characters, spelled. No rows: no languages.

    Works on arrays of numbers only: no row becomes a Python object."""
    if not grams.num_rows:
        return Model([], {})
    coded = grams.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    lang = np.array([languages.index(x) for x in names])[coded.indices.to_numpy()]
    gram = grams.column("gram").combine_chunks()
    points = np.frombuffer(gram.buffers()[2], "<u4")[gram.offset * ORDER : (gram.offset + len(gram)) * ORDER].reshape(-1, ORDER)
    times = grams.column("n").to_numpy()
    every, at = np.unique(points[:, -1], return_inverse=True)
    letters = {chr(c): n for c, n in zip(every.tolist(), np.bincount(at, times, len(every)).tolist(), strict=True) if chr(c) not in (BEFORE, AFTER)}
    order = sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS]
    model = Model(languages, {c: k + 3 for k, c in enumerate(order)})
    number = {BEFORE: 0, AFTER: END} | model.number
    of = np.full(int(points.max()) + 1, OTHER, np.uint8)
    for c, k in number.items():
        if ord(c) < len(of):
            of[ord(c)] = k
    codes = of[points]
    counts: list[dict] = [None] * len(languages)  # by language, by order: grams and their (continuation) counts
    for i in range(len(languages)):
        own = lang == i
        by_order = {}
        unique, at = np.unique(packed(codes[own]), return_inverse=True)
        by_order[ORDER] = (unique, np.bincount(at, times[own]))
        for k in range(ORDER - 1, 0, -1):
            higher = by_order[k + 1][0]  # distinct longer grams: each is one context of its tail
            tail = (higher & np.uint64((1 << 8 * k) - 1)) | np.uint64(1 << 8 * k)
            by_order[k] = tuple(np.unique(tail, return_counts=True))
        counts[i] = by_order
    for k in range(1, ORDER + 1):
        per = []
        for by_order in counts:
            gram, n = by_order[k]
            context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, n)
            kinds = np.bincount(at)
            per.append((gram, np.maximum(n - DISCOUNT, 0) / total[at], context, DISCOUNT * kinds / total))
        for which, into_keys, into_rows, otherwise in ((0, model.keys, model.share, 0.0), (2, model.contexts, model.weight, 1.0)):
            every = np.unique(np.concatenate([x[which] for x in per]))
            rows = np.full((len(every), len(languages)), otherwise)
            for i, x in enumerate(per):
                rows[np.searchsorted(every, x[which]), i] = x[which + 1]
            h = hashed(every)
            by_hash = np.argsort(h)
            into_keys.append(h[by_hash])
            into_rows.append(rows[by_hash])
    return model


class Scorer:
    """Cross-entropies of texts; remembers the bits of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bits = np.zeros((1 << 12, len(self.model.languages)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits per symbol, and the number of symbols; 0 symbols: no letter."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, fresh, rows, long = self.known, [], [], []
        for text in texts:
            counted = Counter(words_of(text or ""))
            # a run of letters may be a whole sentence of a script without spaces: such runs are not remembered
            new = [w for w in counted if w not in known]
            if apart := [w for w in new if len(w) > LONGEST]:
                new = [w for w in new if len(w) <= LONGEST]
            long.append([(w, counted.pop(w)) for w in apart])
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            fresh += new
            rows.append(counted)
        begin = len(known) - len(fresh)
        while len(known) > len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        for at in range(0, len(fresh) if self.model.languages else 0, 20_000):
            some = fresh[at : at + 20_000]
            self.bits[begin + at : begin + at + len(some)] = self.model.word_bits(some)
        out, symbols = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for k, counted in enumerate(rows):
            if counted:
                at = np.fromiter(map(known.__getitem__, counted), np.int64, len(counted))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                symbols[k] = sum(map(len, counted)) if times.max() == 1 else sum(n * len(w) for w, n in counted.items())
                symbols[k] += times.sum()
                if self.model.languages:
                    out[k] = times @ self.bits[at]
            for w, n in long[k]:
                symbols[k] += n * (len(w) + 1)
                if self.model.languages:
                    out[k] += n * self.model.long_bits(w)
            if symbols[k]:
                out[k] /= symbols[k]
        return out, symbols


def scorer(shared) -> Scorer:
    """The worker's scorer; the value of a broadcast model is one object per process."""
    model = shared.value
    return held(("langid", id(model)), lambda: Scorer(model))


def language_of(labelled: Column, lang_col: str) -> Column:
    """The label where labelled holds and it names a language, else null."""
    lang = F.col(lang_col).cast("string")
    return F.when(labelled & (lang != UNDETERMINED), lang)


def learned(docs: DataFrame, labelled: Column, text_col: str, lang_col: str) -> Model:
    """A model without limits, from the grams of all labelled rows."""
    rows = docs.select(language_of(labelled, lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                grams = grams_of(total)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": [spelled(g) for g in grams], "n": list(grams.values())}, schema=schema)
            totals.clear()

        for batch in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, totals.values())) > LEARNED:
                yield from passed_on()
        yield from passed_on()

    # a row per language and distinct gram of five characters
    grams = rows.mapInArrow(counted, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return fit_grams(grams)


def calibrate(model: Model, scores: DataFrame) -> None:
    """Sets the model's limits from the bits that all labelled documents have in their own language."""
    bits = F.col("_own_bits")
    rows = scores.where(bits.isNotNull()).groupBy("_own").agg(F.percentile_approx(bits, 1 - TAIL, ACCURACY).alias("high"), F.avg(bits).alias("mean")).collect()
    high, mean = ({r["_own"]: r[c] for r in rows} for c in ("high", "mean"))
    model.limit = np.array([high.get(x, np.inf) for x in model.languages]) + SLACK
    model.typical = np.array([mean.get(x, np.log2(LETTERS)) for x in model.languages])


def train(docs: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows where labelled holds and text and language are not null. If they have no letter, the model knows no language."""
    model = learned(docs, labelled, text_col, lang_col)
    mine = language_of(labelled, lang_col)
    calibrate(model, scored(docs.select(F.col(text_col).cast("string").alias("_text"), mine.alias("_own")).where("_own is not null"), model).select("_own", "_own_bits"))
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows, which have columns _text and _own (a language or null), without _text, and lang_pred, score, bits, _symbols, _own_bits."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    number = {lang: k for k, lang in enumerate(model.languages)}
    model_languages = bool(model.languages)

    def judged(texts: list[str | None], own: list[str | None]) -> tuple:
        known = scorer(shared)
        bits, symbols = known.entropies(texts)
        if not model_languages:
            nothing = pa.nulls(len(texts), pa.float64())
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), nothing, symbols, nothing
        every = np.arange(len(bits))
        best = bits.argmin(1)
        low = bits[every, best]
        score = 1 / np.exp2(-16 * (bits - low[:, None])).sum(1)
        none = symbols == 0
        which = np.array([number.get(x, -1) for x in own], np.int64)
        pred = np.where(none, UNDETERMINED, np.array(known.model.languages, object)[best]).tolist()
        return pred, np.where(none, 0.0, score), pa.array(low, mask=none), symbols, pa.array(bits[every, which], mask=none | (which < 0))

    return with_columns(rows, ["_text", "_own"], "lang_pred string, score double, bits double, _symbols long, _own_bits double", judged).drop("_text")


JUDGED = ["lang_pred", "score", "bits", "rejected"]


def verdict(scores: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    if not model.languages:  # there is nothing to hold a text against
        return scores.withColumn("rejected", F.col("_symbols") == 0).select(*kept, *JUDGED)
    limit = F.create_map(*[F.lit(x) for lang, bits in zip(model.languages, model.limit.tolist(), strict=True) for x in (lang, bits)])[F.col("lang_pred")]
    above = F.col("bits") > limit + NOISE / F.sqrt(F.greatest("_symbols", F.lit(1)))
    return scores.withColumn("rejected", F.coalesce(above, F.lit(True))).select(*kept, *JUDGED)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs and lang_pred, score (0 to 1), bits (per character, in the predicted language), rejected.

    A null text or one without a letter: und, score 0, bits null, rejected. Otherwise the language with the lowest cross-entropy
    (ties: the first by name); score is its share when each language weighs 2 ** -(bits of 16 characters). rejected: bits lie above
    the language's calibrated limit (a short text's more, as chance has it). A model that knows no language says und, score 0, bits
    null, and rejects only texts without a letter. Columns of docs with these names are replaced; rows with a null or repeated id are
    judged each by its text.
    """
    kept = [c for c in docs.columns if c not in JUDGED]
    return verdict(scored(docs.select(*kept, F.col(text_col).cast("string").alias("_text"), F.lit(None).cast("string").alias("_own")), model), model, kept)


def judge(docs: DataFrame, labelled: Column, kept: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns `kept` of docs and what predict adds, by the model that train makes of docs. Scores each text once: the scores,
    a written table, both calibrate and are judged."""
    model = learned(docs, labelled, text_col, lang_col)
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"), language_of(labelled, lang_col).alias("_own"))
    scores = written(scored(rows, model), "langid-scores")
    calibrate(model, scores)
    return verdict(scores, model, kept)
