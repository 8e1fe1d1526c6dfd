import random

import pytest

WORDS = "the and of river stone light under green walks slowly never again paper house seven mountain cloud winter letter garden".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): plain documents, copies, near copies, shared passages, nulls, empties, one long text."""
    rng = random.Random(1)
    texts = ["\n".join(sentence(rng, rng.randrange(5, 20)) for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    passage = "\n".join(sentence(rng, 14) for _ in range(5))
    texts += [f"{texts[k]}\n{passage}\n{sentence(rng, 9)}" for k in range(8)]
    texts += [texts[3]] * 5 + [texts[4].replace("the", "a", 1), texts[4] + " More.", texts[4].replace(" ", "  ", 1)]
    texts += [None, "", " ", "\n\n", "!!! ###", "one", "two words", "\t\x0b\x1c  x", "émigré naïve coöperate", "nul\x00 \x01 <|endoftext|> </s>[INST]", "word " * 3000]
    rows = [(k, t, ("en", "de", None)[k % 3], None if k == 7 else f"s{min(k % 5, 2)}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, (5, texts[5], "en", "s0", 1), (None, texts[6], "en", "s0", 1), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
