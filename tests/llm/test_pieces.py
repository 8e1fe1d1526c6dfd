import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventweir.llm.pieces import Pieces, tokenizer
from eventweir.llm.queries import vocabulary

WORDS = ["the", "The", "don't", "x.y", "foo,", "bar.", "a..", "naïve", "été.", "Ω.", "日本", "12", "½", "'s", "!?", "\t", "", "\x01", "\x00", "<|endoftext|>", "<|endoftext|>.", " ", "᠎", "é", "İ", "ς.", "ΑΣ", "\x1c", "\r", "ſ", "​", "q" * 300]
BOTH = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.fixture(scope="module")
def encoders():
    return {name: Pieces(vocabulary(name), byte_level) for name, byte_level in BOTH}


@pytest.mark.parametrize("name", [x for x, _ in BOTH])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(WORDS), st.text(max_size=6)), st.sampled_from([" ", "\n", " ", "  ", "\n\n", ""]))).map(lambda x: "".join(a + b for a, b in x)), max_size=4))
def test_same_ids_as_the_library(encoders, name, texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    expected = [tokenizer(vocabulary(name)).encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in encoders[name].encode(texts)] == expected


def test_forgetting_keeps_ids(encoders, monkeypatch):
    monkeypatch.setattr("eventweir.llm.pieces.REMEMBERED", 3)
    for k in range(5):
        text = f"some words{k} here.\nand there, again{k}."
        for name, encoder in encoders.items():
            assert encoder.encode([text])[0].tolist() == tokenizer(vocabulary(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [x for x, _ in BOTH])
def test_words_without_spaces_are_not_held(name, monkeypatch):
    """Sentences of a script without spaces, pictures in base64, random words: what is remembered stays within the bound, ids stay right."""
    rng = random.Random(2)
    monkeypatch.setattr("eventweir.llm.pieces.REMEMBERED", 1 << 20)
    monkeypatch.setattr("eventweir.llm.pieces._BLOCK", 1 << 14)
    encoder = Pieces(vocabulary(name), dict(BOTH)[name])
    most = 0
    for k in range(40):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500)), "data " + "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(5000)), " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(900)), None, "", "plain words here"]
        got = encoder.encode(texts)
        if k % 8 == 0:
            assert [x.tolist() for x in got] == [tokenizer(vocabulary(name)).encode(t or "", add_special_tokens=False).ids for t in texts]
        most = max(most, encoder.held_bytes())
    assert most < (1 << 20) + 1_000_000  # the bound and what a block of texts adds


def test_long_letter_runs_are_scored_alike():
    """A run of letters too long to be remembered needs the bits that it would need if it were."""
    from eventweir.llm import langid

    words = ["river", "q" * 63, "日本" * 40, "e" * 200]
    model = langid.Model(["a", "b"], {c: 3 + k for k, c in enumerate("rivequ")})
    grams = np.unique(np.arange(1, 2000, dtype=np.uint64))
    for _ in range(langid.ORDER):
        keys = np.sort(langid.hashed(grams))
        model.keys.append(keys)
        model.share.append(np.full((len(keys), 2), [0.1, 0.2]))
        model.contexts.append(keys)
        model.weight.append(np.full((len(keys), 2), [0.5, 0.6]))
    long = langid.Scorer(model).entropies([" ".join(words), None, "12"])
    assert np.allclose(model.long_bits("e" * 200), model.word_bits(["e" * 200])[0])
    langid_longest, langid.LONGEST = langid.LONGEST, 1000
    try:
        short = langid.Scorer(model).entropies([" ".join(words), None, "12"])
    finally:
        langid.LONGEST = langid_longest
    assert np.allclose(long[0], short[0]) and (long[1] == short[1]).all() and long[1].tolist() == [5 + 63 + 80 + 200 + 4, 0, 0]


def test_long_words_are_hashed_alike():
    from eventweir.llm import quality

    data = b"some words " + b"x" * 500 + b" some"
    assert quality.word_hashes(data).tolist()[0] == quality.word_hashes(b"some")[0] == quality.word_hashes(data).tolist()[3]
    assert quality.word_hashes(b"").tolist() == []
