"""Token ids of whole texts with the tokenizers library, encoding each distinct word once.

Both vocabularies cut a text before their merges work, and never join what a single space or line break separates. So a text whose
white space is single spaces and line breaks between words is the sequence of its words. A word of Latin letters, with or without
punctuation after it, is cut into these two pieces, and the library's model is asked for each distinct piece; other new words are
encoded together. Pieces and words are remembered up to a limit of bytes. Every other text is encoded as it is, so is one with a very long
word: what stands between white space may be a sentence of a script without spaces, or a picture in base64, and is not worth remembering.
All of it gives the ids that the library gives for the text. Texts are taken up to a number of characters at a time, so what a worker
holds is bounded by these limits and its longest text.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, chain, groupby, pairwise

import numpy as np

from eventweir.llm.common import held, ragged

#: Bytes, about, that a worker spends on remembered words and their ids; beyond it, it starts again. Words longer than LONGEST characters
#: are not remembered.
REMEMBERED, LONGEST = 192 << 20, 64
#: What a word costs beside its characters and ids: its entry, number, place and length.
_ENTRY = 120
#: Characters that are encoded at once.
_BLOCK = 1 << 22
#: Words that are encoded together: short strings are quicker.
_TOGETHER = 32
# letters of Latin-1, then ASCII punctuation but for the apostrophe, which opens contractions
_SIMPLE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class TooLong(Exception):
    """A word that is not remembered."""


class Known(dict):
    """Numbers of words; a new word gets the next one and is noted as fresh. Long ones are refused, so they are always new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            raise TooLong
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def byte_values() -> dict[str, int]:
    """By printable character the byte that byte-level vocabularies write with it: printable Latin-1 as it is, the others in order
    from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Store:
    """The ids of numbered words: runs of one growing array."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(numbers) and int(numbers.max()) >= len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[numbers] = self.used + np.cumsum(lengths) - lengths
        self.size[numbers] = lengths
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return self.flat[ragged(self.begin[numbers], size)], size


class Pieces:
    """Encoder of one vocabulary file. byte_level: spaces belong to the next word's token; else white space is dropped."""

    def __init__(self, path: str, byte_level: bool):
        self.own = tokenizer(path)
        self.byte_level = byte_level
        shown = {b: c for c, b in byte_values().items()}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}
        if byte_level:
            vocab = self.own.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin a piece: by a space or a line break
            self.opens[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True
        else:
            self.mark = self.own.encode("\x01", add_special_tokens=False).ids
            assert len(self.mark) == 1
        self.forget()

    def forget(self) -> None:
        self.known, self.words = Known(), Store()
        self.parts, self.pieces = Known(), Store()
        self.spent = 0

    def _note(self, fresh: list[str]) -> None:
        self.spent += sum(map(sys.getsizeof, fresh)) + _ENTRY * len(fresh)

    def held_bytes(self) -> int:
        """What is remembered, about."""
        return self.spent + 4 * (self.words.used + self.pieces.used)

    def _learn(self) -> None:
        """Encodes the fresh words."""
        fresh, part, space = self.known.fresh, self.parts.__getitem__, " " if self.byte_level else ""
        first = len(self.known) - len(fresh)
        self._note(fresh)
        cut = list(map(_SIMPLE.fullmatch, fresh))
        self.known.fresh = []
        if found := [m.groups() for m in cut if m]:
            if not self.byte_level:
                found = [("", letters.lower(), mark) for _, letters, mark in found]
            three = np.array([[part(x) for x, _, _ in found], [part(x if line else space + x) for line, x, _ in found], [part(x) for _, _, x in found]])
            if self.parts.fresh:
                self._ask()
            ids, size = self.pieces.get(three.T.ravel())
            self.words.put(first + np.flatnonzero([m is not None for m in cut]), ids, size.reshape(-1, 3).sum(1))
        if len(found) < len(cut):
            self._encode([w for w, m in zip(fresh, cut, strict=True) if m is None])

    def _ask(self) -> None:
        """Asks the model for the fresh pieces, each of which the library would not cut any further."""
        ask, shown, space = self.own.model.tokenize, self.shown, self.shown[32]
        fresh, self.parts.fresh = self.parts.fresh, []
        self._note(fresh)
        written = [x.translate(shown) if x == "\n" or not x.isascii() else space + x[1:] if x[:1] == " " else x for x in fresh]
        found = [[t.id for t in ask(x)] if x else [] for x in written]
        self.pieces.put(np.arange(len(self.parts) - len(fresh), len(self.parts)), np.array(list(chain.from_iterable(found)), np.int32), np.array(list(map(len, found))))

    def _encode(self, words: list[str]) -> None:
        texts, groups = [], []
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            groups.append(np.array([self.known[w] for w in some]))
            texts.append("".join(w if w[0] == "\n" else " " + w for w in some) if self.byte_level else " \x01 ".join(some))
        for encoded, numbers in zip(self.own.encode_batch(texts, add_special_tokens=False), groups, strict=True):
            ids = np.array(encoded.ids, np.int32)
            if self.byte_level:
                lengths = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
            else:
                marks = np.flatnonzero(ids == self.mark[0])
                lengths = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                ids = np.delete(ids, marks)
            assert len(lengths) == len(numbers)
            self.words.put(numbers, ids, lengths)

    def encode_flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (int32), end_id after each if it is given; and how many each text has."""
        if len(texts) <= 1 or sum(map(len, filter(None, texts))) <= _BLOCK:
            return self._block(texts, end_id)
        ends = np.cumsum([len(t or "") for t in texts]) // _BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        made = [self._block(texts[a:b], end_id) for a, b in pairwise(cuts) if a < b]
        return np.concatenate([ids for ids, _ in made]), np.concatenate([n for _, n in made])

    def _whole(self, texts: list[str]) -> Iterator[list[int]]:
        """Texts as they are; long ones by themselves, since the library notes much about each id."""
        for many, some in groupby(texts, lambda t: len(t) < 1 << 14):
            if many:
                for few in batched(some, _TOGETHER):
                    yield from (x.ids for x in self.own.encode_batch(list(few), add_special_tokens=False))
            else:
                yield from (self.own.encode(t, add_special_tokens=False).ids for t in some)

    def _block(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.held_bytes() > REMEMBERED:
            self.forget()
        number, rows, numbers, whole = self.known.__getitem__, [], [], []
        ending = end_id is not None
        if ending:
            end = number("\x00end")
            if self.known.fresh:
                self.known.fresh = []
                self.words.put(np.array([end]), np.array([end_id], np.int32), np.array([1]))
        lengths = np.full(len(texts), int(ending))
        for k, text in enumerate(texts):
            if not text:
                if ending:
                    rows.append(k)
                    numbers.append(np.array([end]))
                continue
            plain = text.replace("\n", " ")
            # printable: no white space but spaces, no control characters
            if not plain.isprintable() or "  " in plain or plain[0] == " " or plain[-1] == " ":
                whole.append(k)
                continue
            words = (("\n" + text).replace("\n", " \n")[1:] if self.byte_level else plain).split(" ")
            at = np.empty(len(words) + ending, np.int64)
            try:
                at[: len(words)] = np.fromiter(map(number, words), np.int64, len(words))
            except TooLong:
                whole.append(k)
                continue
            if ending:
                at[-1] = end
            rows.append(k)
            numbers.append(at)
        if self.known.fresh:
            self._learn()
        ids = np.zeros(0, np.int32)
        if rows:
            at = np.concatenate(numbers)
            begin, size = self.words.begin[at], self.words.size[at]
            per = np.array([len(x) for x in numbers])
            first = np.cumsum(per) - per
            if self.byte_level:  # a text's first word was looked up with a line break before it
                opening = first[[k for k, r in enumerate(rows) if texts[r]]]
                begin[opening] += 1
                size[opening] -= 1
            ids = self.words.flat[ragged(begin, size)]
            lengths[rows] = np.add.reduceat(size, first)
        if not whole:
            return ids, lengths
        own = [np.array([*x, *([end_id] if ending else [])], np.int32) for x in self._whole([texts[k] for k in whole])]
        lengths[whole] = [len(x) for x in own]
        out = np.empty(int(lengths.sum()), np.int32)
        begin = np.cumsum(lengths) - lengths
        out[ragged(begin[rows], lengths[rows])] = ids
        out[ragged(begin[whole], lengths[whole])] = np.concatenate(own)
        return out, lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (int32)."""
        ids, lengths = self.encode_flat(texts)
        return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []


def pieces(path: str, byte_level: bool) -> Pieces:
    """The worker's encoder of this vocabulary."""
    return held(("pieces", path, byte_level), lambda: Pieces(path, byte_level))
