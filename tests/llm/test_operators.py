"""Each operator against a brute-force version, on nulls, empties, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from eventweir.llm import chat_format, embed_dedup, html_extract, langid, line_dedup, mixing, packing, quality, simhash_dedup, token_file
from eventweir.llm.pieces import tokenizer
from eventweir.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def ids_of(name, text, end):
    return np.array([*tokenizer(vocabulary(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 1


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_variable_length_coding(numbers):
    x, counts = np.array(numbers * 3 + [7], np.uint32), np.array([len(numbers), 0, len(numbers), len(numbers), 1])
    control, data, control_ends, data_ends = token_file.encoded_all(x, counts)
    assert token_file.decoded_all(control, data, counts).tolist() == x.tolist()
    assert np.diff(control_ends, prepend=0).tolist() == [-(-n // 4) for n in counts.tolist()] and control_ends[-1] == len(control)
    # each document alone is coded the same
    for k, (a, b) in enumerate(zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)):
        own = token_file.encoded_all(x[a:b], counts[k : k + 1])
        assert own[1].tobytes() == data[data_ends[k - 1] if k else 0 : data_ends[k]].tobytes()
        assert own[0].tobytes() == control[control_ends[k - 1] if k else 0 : control_ends[k]].tobytes()


def test_token_file(spark, docs, corpus, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_file.write(docs.withColumn("start", F.lit("clash")), path, vocabulary(BYTE_BPE))
    got = [tuple(r) for r in token_file.digests(spark, path).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in corpus), key=lambda x: -1 if x is None else x)
    wanted = Counter((r[0], len(x := ids_of(BYTE_BPE, r[1], 2)), zlib.crc32(x.tobytes())) for r in corpus)
    assert Counter((a, n, crc) for a, _, n, crc in got) == wanted
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    by_id = {r["doc_id"]: r["ids"] for r in token_file.read(spark, path).collect()}
    assert by_id[0] == ids_of(BYTE_BPE, corpus[0][1], 2).tolist()
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [(-r["n"], r["id"]) for r in ranks] == sorted((-r["n"], r["id"]) for r in ranks)


def test_token_file_is_in_order(spark, tmp_path):
    """Files in name order hold ascending ids and starts without gaps, though a reread of the intermediate table packs files by size."""
    docs = spark.range(4000).select(((F.col("id") * 1237) % 4000).alias("doc_id"), F.expr("repeat(concat('w', id, ' '), cast(1 + id % 40 as int))").alias("text"))
    token_file.write(docs.repartition(5), f"file://{tmp_path}/tokens", vocabulary(BYTE_BPE))
    files = sorted((tmp_path / "tokens" / "documents").glob("*.parquet"))
    rows = [r for f in files for r in pq.read_table(f).select(["doc_id", "part", "start", "n_tokens"]).to_pylist()]
    assert len(files) > 1 and [r["doc_id"] for r in rows] == list(range(4000))
    before = {r["part"]: r["before"] for r in spark.read.parquet(f"file://{tmp_path}/tokens/parts").collect()}
    starts = np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert [r["start"] + before[r["part"]] for r in rows] == starts
    assert [r["start"] for r in token_file.read(spark, f"file://{tmp_path}/tokens").orderBy("doc_id").collect()] == starts


def test_token_file_of_nothing(empty):
    assert token_file.round_trip(empty, vocabulary(BYTE_BPE)).count() == 0


# 2


def brute_lines(corpus, guarantee=line_dedup.GUARANTEE):
    """By document (id, text) the lines that are to go: every run of lines of so many words is looked up among all runs before it."""
    gone, seen = {}, set()
    for i, text in sorted({(r[0], r[1]) for r in corpus}, key=lambda x: (-(2**63) if x[0] is None else x[0], str(x[1]))):
        lines = [x.strip() for x in (text or "").split("\n")]
        own = [k for k, x in enumerate(lines) if x]
        out, runs = set(), []
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(lines[own[b]].split())
                if n >= guarantee:
                    run = tuple(lines[k] for k in own[a : b + 1])
                    if run in seen:
                        out.update(range(own[a], own[b] + 1))
                    seen.add(run)
        gone[i, text] = out
    return gone


def check_lines(rows, out):
    gone = brute_lines(rows)
    assert len(out) == len(rows)
    for r in rows:
        lines = (r[1] or "").split("\n")
        wanted = None if r[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[r[0], r[1]])
        assert any(x["doc_id"] == r[0] and x["text"] == wanted and x["removed_lines"] == len(gone[r[0], r[1]]) for x in out), r[0]
    return sum(map(len, gone.values()))


def test_line_dedup(docs, corpus):
    out = line_dedup.drop_repeated_lines(docs.withColumn("removed_lines", F.lit("clash")).withColumn("doc", F.lit(1)))
    assert out.columns == [*docs.columns, "doc", "removed_lines"]
    assert check_lines(corpus, out.collect()) >= 60


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_finds_every_line(spark, seed):
    """Random texts made of few lines, with parts of shared passages, periods inside a text, blank lines and long lines: the deleted
    lines are those of every repeated run of GUARANTEE words, no more."""
    import random

    rng = random.Random(seed)
    pool = [" ".join(f"w{seed}x{k}y{j}" for j in range(rng.choice([1, 3, 8, 14, 25, 60]))) for k in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(3, 9))] for _ in range(6)]
    rows = []
    for k in range(70):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            lines += rng.choice([p, p[a:], p[: a + 1], [rng.choice(pool)], ["", "  "], [rng.choice(pool)] * rng.randrange(1, 9)])
        rows.append((k if k else None, "\n".join(lines)))
    # the case of a gram whose first place has a part of the run only
    run = [" ".join(f"r{k}z{j}" for j in range(10)) for k in range(6)]
    rows += [(100, "\n".join(run[1:5])), (101, "\n".join(run)), (102, "\n".join(run))]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert check_lines(rows, out) > 100
    assert next(r["removed_lines"] for r in out if r["doc_id"] == 102) == 6


def test_line_dedup_of_one_long_text(spark):
    """A text of many equal lines, and one of a long period: linear, and all but the first lines go."""
    period = "\n".join(f"line {k} of a period of thirty lines" for k in range(30))
    rows = [(1, "\n".join(["the same line of some words"] * 100_000)), (2, "\n".join([period] * 2000)), (3, "\n" * 200_000 + "end")]
    out = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (99_999, "the same line of some words") and out[2] == (59_970, period) and out[3][0] == 0


def test_line_dedup_windows():
    raw = lambda hashes: b"".join(int(x).to_bytes(16, "little") for x in hashes)
    assert line_dedup.winnowed(np.array([60, 3, 3]), raw([1, 2, 3]))[1].tolist() == [0, -1, -1]
    assert line_dedup.winnowed(np.array([20, 20]), raw([1, 2]))[1].tolist() == [-1, -1]
    # equal runs of GUARANTEE words in different surroundings share a selected gram
    rng = np.random.default_rng(3)
    for _ in range(200):
        run, sizes = rng.integers(1, 9, 12), rng.integers(1, 20, 12)
        if sizes.sum() < line_dedup.GUARANTEE:
            continue
        grams = []
        for _ in range(2):
            before, after = (rng.integers(10, 10**9, n) for n in rng.integers(0, 6, 2))
            words = np.concatenate([rng.integers(1, 20, len(before)), sizes, rng.integers(1, 20, len(after))])
            hashes, choice = line_dedup.winnowed(words, raw(np.concatenate([before, run, after])))
            grams.append(set(hashes[choice[choice >= 0]].tolist()))
        assert grams[0] & grams[1]


def test_line_dedup_of_nothing(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(empty, noise=60)


# 3


@pytest.fixture(scope="module")
def languages(spark):
    import random

    rng = random.Random(2)
    kinds = {"xx": "ka lo mi ne ru ta shi vo".split(), "yy": "bra stö gli pfu ünd echt zwi ßen".split(), "zz": "que ción la ñor ía rre ll os".split()}
    rows = [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))), lang) for k in range(300) for lang in [rng.choice(list(kinds))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, languages):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.train(languages, ~held)
    out = langid.predict(languages.where(held).withColumn("score", F.lit("clash")), model)
    assert out.where("lang = lang_pred and not rejected").count() == out.count() > 50
    assert out.where("score < 0 or score > 1 or bits is null").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²³ !?"), (4, "漢字仮名交文" * 30), (5, "ka" * 50000), (6, "KALO MINE " * 9)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    for k in (1, 2, 3):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["bits"], got[k]["rejected"]) == ("und", 0.0, None, True)
    assert got[4]["rejected"] and got[4]["lang_pred"] in model.languages
    assert got[6]["lang_pred"] == "xx" and not got[6]["rejected"]
    assert langid.predict(odd.limit(0), model).count() == 0


def test_probabilities_sum_to_one(languages):
    """Over every symbol that can follow a context, seen or not, each model's probabilities sum to one."""
    words = languages.limit(40).toPandas()
    import pandas as pd

    counted = Counter((lang, w) for t, lang in zip(words["text"], words["lang"], strict=True) for w in langid.words_of(t))
    model = langid.fit(pd.DataFrame([(a, b, n) for (a, b), n in counted.items()], columns=["lang", "word", "n"]))
    symbols = np.array([langid.END, *range(2, langid.LETTERS + 4)])  # END, OTHER, letters, known and unknown
    for word in ("", "k", "sch", "qqqq"):
        context = np.array([0] * 4 + [model.number.get(c, langid.OTHER) for c in word], np.uint64)[-4:]
        grams = np.column_stack([np.tile(context, (len(symbols), 1)), symbols]).astype(np.uint64)
        p = np.full((len(grams), len(model.languages)), 1.0 / (langid.LETTERS + 3))
        for k in range(1, langid.ORDER + 1):
            c = langid.packed(grams[:, langid.ORDER - k : langid.ORDER - 1])
            p = langid.found(model.contexts[k - 1], model.weight[k - 1], langid.hashed(c), 1.0) * p + langid.found(model.keys[k - 1], model.share[k - 1], langid.hashed((c << np.uint64(8)) | grams[:, -1]), 0.0)
        assert np.allclose(p.sum(0), 1.0)


def test_language_id_learns_from_all_rows(spark):
    """Letters that one document each has are all learned, and limits are quantiles over all labelled documents."""
    rows = [(k, f"kalo mine {'tashi ' * (k % 7)}{chr(0x4E00 + k // 6) * 3 if k % 6 == 0 else 'ruvo'}", "xx") for k in range(1200)]
    docs = spark.createDataFrame([*rows, (9000, "bra gli pfu", "yy"), (9001, "echt", "und"), (9002, None, "xx"), (9003, "odd", None)], "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.lit(True))
    assert {chr(0x4E00 + k) for k in range(200)} <= set(model.number) and model.languages == ["xx", "yy"]
    bits, _ = langid.Scorer(model).entropies([r[1] for r in rows])
    assert math.isclose(model.limit[0], sorted(bits[:, 0])[math.ceil(0.999 * len(rows)) - 1] + langid.SLACK)
    judged = langid.judge(docs, F.lit(True), ["doc_id"])
    assert judged.columns == ["doc_id", "lang_pred", "score", "bits", "rejected"]
    assert Counter(tuple(r) for r in judged.collect()) == Counter(tuple(r) for r in langid.predict(docs.select("doc_id", "text"), model).drop("text").collect())


def test_no_languages(spark, empty):
    """Nothing to learn from: und for all, and only texts without a letter are rejected."""
    assert langid.train(empty, F.lit(True)).languages == []
    assert langid.judge(empty, F.lit(True), ["doc_id"]).count() == 0
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", "xx"), (3, None, "xx"), (None, "words", "und")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: tuple(r)[1:] for r in langid.judge(docs, F.lit(True), ["doc_id"]).collect()}
    assert got == {k: ("und", 0.0, None, k in (2, 3)) for k in (1, 2, 3, None)}


def brute_bits(words, text, letters):
    """Bits per symbol of a text in an interpolated Kneser-Ney model of words (a Counter), by the textbook's recursion."""
    order, d = langid.ORDER, langid.DISCOUNT
    symbols = lambda w: ["<"] * (order - 1) + [c if c in letters else "?" for c in w] + [">"]
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for w, n in words.items():
        s = symbols(w)
        for k in range(order - 1, len(s)):
            counts[order][tuple(s[k - order + 1 : k + 1])] += n
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    after = defaultdict(list)
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            after[g[:-1]].append(n)

    def p(gram):
        if not gram:
            return 1.0 / (langid.LETTERS + 3)
        same, lower = after.get(gram[:-1]), p(gram[1:])
        if not same:
            return lower
        return max(counts[len(gram)][gram] - d, 0) / sum(same) + d * len(same) / sum(same) * lower

    bits = n = 0
    for w in langid.words_of(text):
        s = symbols(w)
        for k in range(order - 1, len(s)):
            bits -= math.log2(p(tuple(s[k - order + 1 : k + 1])))
            n += 1
    return bits / n


def test_language_id_against_the_recursion(spark):
    """Cross-entropies are those of the model's definition, for known and unknown words; ties go to the first language by name, and rows
    with null or repeated ids are each judged."""
    said = {"xx": ["ka lo mi ka", "lomi kalo mi", "ru"], "yy": ["bra stö gli", "stögli bra", "ünd"]}
    rows = [(k, t, lang) for lang, texts in said.items() for k, t in enumerate(texts)]
    odd = [(7, "kalo stögli zzz", None), (7, "kalo stögli zzz", None), (None, "mi mi bra", None), (None, "漢", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.lit(True))
    got = langid.judge(docs, F.lit(True), ["doc_id", "text"]).collect()
    assert len(got) == len(rows) + len(odd)
    words = {lang: Counter(w for t in texts for w in langid.words_of(t)) for lang, texts in said.items()}
    for r in got:
        wanted = {lang: brute_bits(words[lang], r["text"], set(model.number)) for lang in said}
        best = min(wanted, key=lambda x: (round(wanted[x], 9), x))
        assert r["lang_pred"] == best and math.isclose(r["bits"], wanted[best], rel_tol=1e-9)
        assert math.isclose(r["score"], 1 / sum(2 ** (-16 * (x - wanted[best])) for x in wanted.values()), rel_tol=1e-6)
    same = spark.createDataFrame([(1, "ka lo", "b"), (2, "ka lo", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.judge(same, F.lit(True), ["doc_id"]).collect()} == {"a"}


# 4


def test_packing(docs, corpus):
    rows = packing.pack(docs.withColumn("start", F.lit("clash")), vocabulary(WORD_BPE)).collect()
    wanted = Counter((r[0], zlib.crc32(x.tobytes()), len(x)) for r in corpus for x in [ids_of(WORD_BPE, r[1], 1)])
    whole = Counter((r["doc_id"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["length"] == r["doc_tokens"])
    assert not whole - wanted
    # the pieces of each document, put together, are its ids
    by_ids = defaultdict(list)
    for i, (doc, text) in enumerate((r[0], r[1]) for r in corpus):
        by_ids[doc].append(ids_of(WORD_BPE, text, 1))
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in by_ids[r["doc_id"]])
    assert any(r["length"] < r["doc_tokens"] for r in rows)
    for doc, all_ids in by_ids.items():
        covered = Counter(k for r in rows if r["doc_id"] == doc for k in range(r["start"], r["start"] + r["length"]))
        assert covered == sum((Counter(range(len(x))) for x in all_ids), Counter())
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == sum((Counter({i: n * c}) for (i, _, n), c in wanted.items()), Counter())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW


@pytest.mark.parametrize("seed", range(6))
def test_best_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    window = 16
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))])
    penalty = rng.integers(0, 5, len(at))
    cost = [0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if (n := at[j] - at[i]) <= window:
                cost[j] = min(cost[j], cost[i] + (0 if n in (4, 8, 16) else window - n) + penalty[j])
    cuts = packing.best_cuts(at, penalty, window)
    index = {p: k for k, p in enumerate(at.tolist())}
    total = sum((0 if (n := b - a) in (4, 8, 16) else window - n) + penalty[index[b]] for a, b in zip(cuts, cuts[1:], strict=False))
    assert total == cost[-1]


def test_packing_of_nothing(empty):
    assert packing.pack(empty, vocabulary(WORD_BPE)).count() == 0


# 5


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(16) for _ in range(150)]
    rows += [rows[0] + 0.05 * rng.standard_normal(16) for _ in range(200)]  # a bucket of several blocks
    rows += [rows[1]] * 9 + [3.5 * rows[1]] + [rows[2] + 0.3 * rng.standard_normal(16) for _ in range(20)]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [1.0, 2.0]), (1008, [1e300] * 16), (1009, [1e-300] * 16)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[k]["n_links"] for k in range(len(rows)))
    assert 0.98 * links.sum() <= found <= links.sum()
    assert all(got[k]["n_links"] <= links[k].sum() for k in range(len(rows)))
    component = roots(zip(*map(np.ndarray.tolist, np.nonzero(links)), strict=True), range(len(rows)))
    assert sum(got[k]["component_id"] == component[k] for k in range(len(rows))) >= 0.98 * len(rows)
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in got)
    assert all((got[k]["n_links"], got[k]["component_id"]) == (0, k) for k in range(1000, 1006))
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in (1006, 1007, 1008, 1009)] == [(1, 1006), (1, 1006), (1, 1008), (1, 1008)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    vectors = [(1, a), (1, a), (2, a * 2), (None, a), (None, b), (3, -b)]
    got = Counter(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")).collect())
    # a row without an id links by equality only, and has the component of its equals
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 1, (None, 3, 1, False): 1, (None, 0, None, False): 1, (3, 0, 3, True): 1})


@pytest.mark.parametrize("table", ["check_s", "sf0.01"])
def test_recall_on_a_table(spark, table):
    """Links found of those that brute force finds, where the tables are: 57,266 of 57,266 on check_s; sf0.01 has none."""
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip(f"no table {path}")
    rows = [r for r in pq.read_table(path).to_pylist() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = sum(int((x[k : k + 512] @ x.T >= embed_dedup.COSINE).sum()) for k in range(0, len(x), 512)) - len(x)
    found = embed_dedup.near_duplicates(spark.read.parquet(path)).agg(F.sum("n_links")).first()[0]
    assert 0.98 * links <= found <= links


def test_recall_of_planted_links(spark):
    """A table with links of its own: 300 pairs at cosines from 0.9 to 0.99 among 1,200 vectors, one group of 100; all against brute force."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a, o = unit(rng.standard_normal((300, 64))), rng.standard_normal((300, 64))
    o = unit(o - (o * a).sum(1, keepdims=True) * a)
    cosine = np.linspace(0.901, 0.99, 300)[:, None]
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * o, rng.standard_normal((500, 64)), a[:1] + 0.02 * rng.standard_normal((100, 64))])
    links = unit(x) @ unit(x).T >= embed_dedup.COSINE
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.array([r["n_links"] for r in embed_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    want = links.sum(1)
    assert want.sum() >= 600 and (n <= want).all() and n.sum() >= 0.98 * want.sum()
    assert n[300:600].sum() >= 0.95 * want[300:600].sum() and (n[450:600] == want[450:600]).mean() >= 0.99


def test_filters_recall():
    rng = np.random.default_rng(5)
    code = embed_dedup.Filters(64, 50_000)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((400, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.95), (0.95, 0.99)):
        b = cosine * a + math.sqrt(1 - cosine**2) * o
        shared = [np.intersect1d(x, y).size > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
        assert np.mean(shared) >= least
    # the decoded list is exactly the filters that are passed
    v, code = a[:3], embed_dedup.Filters(64, 1000)
    for k, listed in enumerate(code.decode(v)):
        passed = []
        for c, (rotation, (first, second)) in enumerate(zip(code.rotations, code.halves, strict=True)):
            t = v[k] @ rotation
            sums = (first @ t[:32])[:, None] + (second @ t[32:])[None, :]
            passed += [(c * code.codewords + i) * code.codewords + j for i, j in zip(*np.nonzero(sums >= code.alpha * math.sqrt(2)), strict=True)]
        assert listed.tolist() == sorted(passed)


# 6

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body class="page-{n}">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="main"><div class="post post-{n}"><h1>Title {n}</h1><p>First <b>bold</b>  part&nbsp;&copy; {n}.<br>Second line &lt;tag&gt; &#x41;&#66;.<p>Unclosed paragraph with <a href="#">a link</a> inside it.
<!-- <p>comment</p> --><ul><li>Item one<li>Item two</ul><div class="ad">Buy!</div><form><input value="x"><label>Name</label></form><p>Last paragraph, long enough to be text.</p></div>
<div class="comments"><p>Reader says a very long thing that goes on and on and on, much longer than the article itself if need be, on and on and on.</p></div></div>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""
TEXT = "Title {n} First bold part © {n}. Second line <tag> AB. Unclosed paragraph with a link inside it. Item one Item two Last paragraph, long enough to be text."


def test_html(spark):
    rows = [(n, f"http://h{n % 2}.example.com:80/p{n}?q#f", PAGE.format(n=n)) for n in range(12)]
    odd = [(100, None, None), (101, "http://h0.example.com/x", ""), (102, "no url", "just text"), (103, "", "<p>a<p>b"), (104, "http://x/", "<script>x"), (105, "http://h0.example.com/y", "<body><main><p>Another template altogether here.</p></main></body>"), (106, "http://y/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for n in range(12):
        assert got[n] == TEXT.format(n=n)
    assert (got[100], got[101], got[102], got[103], got[104]) == ("", "", "just text", "a b", "")
    assert got[105] == "Another template altogether here." and got[106] == "deep"
    assert html_extract.extract(df.limit(0)).count() == 0
    winners = {r["host"]: r["path"] for r in html_extract.votes(df).collect()}
    assert winners["h0.example.com"] == winners["h1.example.com"] == "/html/body.page-#/div/div.post.post-#"


TEMPLATES = [  # what stands around an article of headings, paragraphs and lists
    "<body><nav><a href=/>Home</a></nav><article>{}</article><footer>Foot</footer></body>",
    "<body><div id=wrap><div class='post-body p{n}'>{}</div><div class=comments><p>A reader says much, and more than that, at length.</p></div></div></body>",
    "<body><table><tr><td class=left><a href=a>One</a> <a href=b>Two</a><td class=content>{}</table></body>",
    "<body><header>Head</header><section><div class='article share-price'>{}</div></section><aside>Side</aside></body>",
    "<body><main><div role=navigation>Menu</div><h1>Title</h1><p>Lead.</p><div class=text>{}</div></main></body>",
    "<p>stray</p><div class=story>{}</div><div style='display: none'>unseen</div><div hidden>unseen</div><form>Search</form>",
]


def test_html_templates(spark):
    """Articles put into templates, a host each, come out again; with a tie between two templates, repeated rows and null ids."""
    import random

    rng = random.Random(6)
    rows, wanted = [], {}
    for host, template in enumerate(TEMPLATES):
        for n in range(15):
            said = [" ".join(rng.choice(["wörd", "a &amp; b", "x&lt;y", "end.", "<b>bold</b>", "<a href=z>link</a>", "more&nbsp;text", "plain"]) for _ in range(rng.randrange(6, 40))) for _ in range(rng.randrange(2, 7))]
            body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(x) for x in said)
            shown = [" ".join(re.sub("<[^>]*>", "", x).replace("&nbsp;", " ").replace("&lt;", "<").replace("&amp;", "&").split()) for x in said]
            before = {4: ["Title", "Lead."], 5: ["stray"]}.get(host, [])
            page = len(wanted)
            wanted[page] = " ".join([*before, *shown])
            rows.append((page, f"https://u@H{host}.example:8/p?{n}", template.replace("{n}", str(n)).replace("{}", body)))
    tie = [(1000 + k, "//tie/x", f"<body><div class={c}><p>Equal votes for both of these.</p></div></body>") for k, c in enumerate("abab")]
    more = [rows[3], rows[3], (None, "http://n/", "<p>no id</p>"), (None, None, "<p>no id</p>")]
    df = spark.createDataFrame(rows + tie + more, "page_id long, url string, html string").repartition(4)
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert len(got) == len(rows) + len(tie) + len(more)
    for page, text in got:
        assert text == ("no id" if page is None else wanted.get(page, "Equal votes for both of these.")), page
    assert {r["host"]: r["path"] for r in html_extract.votes(df).collect()}["tie"] == "/body/div.b"


DOUBTFUL = {  # pages whose article stands under a doubtful name, or beside more comments than article: what stands around "{}", and what comes out before it
    "story in main": ("<body><main><h1>Title here</h1><div class='related-story'>{}</div></main></body>", "Title here "),
    "piece of a builder": ("<body><article><h1>Title</h1><div class='elementor-widget-container'>{}</div></article></body>", "Title "),
    "class about a subject": ("<body><article><h1>Title</h1><p>Lead.</p><div class='body social-science'>{}</div></article></body>", "Title Lead. "),
    "long comments": ("<body><div class='post'>{}</div><div class='comments'>" + "<p>A reader who goes on about it.</p>" * 200 + "</div></body>", ""),
    "long comments in main": ("<body><main><div class='post'>{}</div><div class='comment-list'>" + "<p>A reader who goes on about it.</p>" * 200 + "</div></main></body>", ""),
    "comments inside widgets": ("<body><div class='content-widget'>{}</div><div id='comments'>" + "<div class='widget'>A reader who goes on about it.</div>" * 200 + "</div></body>", ""),
    "class that says comments are open": ("<body><div class='post comments-open'><h1>Title</h1>{}</div><div>Copyright</div></body>", "Title "),
    "class that says so, alone": ("<body><div class='post comments-open'>{}</div><div>Copyright</div></body>", ""),
    "page-wide form": ("<body><form id=aspnetForm><input type=hidden><div class=header>Site</div><div id=content>{}</div><div class=sidebar>Side</div></form></body>", ""),
    "article in a page-wide form": ("<body><form id=aspnetForm><nav>Menu</nav><article><h1>Title</h1>{}<div class=share>Share this</div></article></form></body>", "Title "),
    "fieldset": ("<body><fieldset><button>Go</button>{}</fieldset></body>", ""),
    "newsletter and search form": ("<body><article><h1>Title</h1><div class=newsletter>Get our letter</div>{}<form>Search <input></form></article></body>", "Title "),
}


@pytest.mark.parametrize("alone", [True, False], ids=["a page a host", "many pages a host"])
@pytest.mark.parametrize("body", ["many", "one", "plain"])
def test_html_doubtful_names(spark, alone, body):
    """The article comes out whole, whatever the class of what it stands in, and comments do not, however long."""
    rows, wanted = [], {}
    for host, (template, before) in enumerate(DOUBTFUL.values()):
        for n in range(1 if alone else 8):
            said = [f"This is sentence {k} of the text on page {n} and it says things." for k in range(12 + n)]
            shown = "".join(f"<p>{x}</p>" for x in said) if body == "many" else f"<p>{' '.join(said)}</p>" if body == "one" else " ".join(said)
            wanted[len(rows)] = before + " ".join(said)
            rows.append((len(rows), f"http://h{host}.example/{n}", template.replace("{}", shown)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    names = list(DOUBTFUL)
    wrong = {names[int(rows[k][1][8:].split(".")[0])]: (got[k][:90], len(got[k]), len(w)) for k, w in wanted.items() if got[k] != w}
    assert not wrong


def test_html_pieces_of_a_builder_are_weighed_together():
    pieces = "".join(f"<div class='elementor-widget'><p>Paragraph {k} is a piece of its own, and no piece is most of it.</p></div>" for k in range(8))
    html = f"<body><main><h1>Title</h1>{pieces}<div class='related'><p>Another story.</p></div></main></body>"
    assert html_extract.main_text(html, html_extract.best_path(html)) == "Title " + " ".join(f"Paragraph {k} is a piece of its own, and no piece is most of it." for k in range(8))


@pytest.mark.parametrize("piece", ["<a", "<div>", "<", "</", '<p title="a>x</p>', '<a x=">"', "<div></span>", "<b><i></b>", "<!--", "<script>", "<i><p></p>", "<ul><b><li>", "&amp", "<td>x", "<div class=comments>x", "<form><p>x", "<div class=share>x</div>"])
def test_hostile_html_is_linear(piece):
    """Twice the page, about twice the time: a page of a quarter of a megabyte takes seconds at most."""
    import time

    html = piece * (250_000 // len(piece))
    began = time.time()
    html_extract.main_text(html, html_extract.best_path(html))
    assert time.time() - began < 8


def test_html_attributes():
    text = lambda html: html_extract.main_text(html, None)
    assert text('<div title="hidden gems" data-id="ad"><p>x</p></div>') == "x"
    assert text("<p>a<div class='comments'><p>b</p></div><p>c long enough to be the text") == "a c long enough to be the text"
    assert text('<p title="a>The lost paragraph.</p>') == "The lost paragraph."
    assert text("<p>1 < 2 <3 </ 4") == "1 < 2 <3 </ 4"
    assert text("<article><h1>T</h1><p>lead</p><div class=body>" + "<p>a long article</p>" * 20 + "</div></article>").startswith("T lead a long")


# 7


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<s>", "<\\s>", "</s>[INST] ok [/INST]", "[\\INST]", "\\<s>\\", "<<s>>", "[ROLE]\n\\[TEXT]", "é\u0000 \U0001f600"])
def test_escaping(text):
    made = chat_format.escaped(text)
    assert chat_format.unescaped(made) == text
    assert not any(c in made for c in chat_format.CONTROLS)


def test_chat(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|endoftext|> \\ \\\\ [ROLE]", None, "", "  spaces \n\n lines\t", "naïve \U0001f600", "long " * 3000]
    rows = [(c, t, role, hostile[(c + t) % len(hostile)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant", "tool", "assistant", "assistant", None][: c % 8])]
    rows += [(50, None, "user", "first"), (50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = {r["conv_id"]: r for r in chat_format.round_trip(df, vocabulary(BYTE_BPE)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["formatted_chars"] >= sum(len(t) for *_, t in turns)
    assert chat_format.round_trip(df.limit(0), vocabulary(BYTE_BPE)).count() == 0


# 8


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    repeated = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


def test_quality(spark, docs, corpus):
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    ratio = quality.train(docs, labels, F.col("quality") == 1, F.col("quality") == 0)
    out = quality.judge(docs.withColumn("kept", F.lit("clash")), ratio)
    got = out.collect()
    assert len(got) == len(corpus)
    for r in got:
        counts = brute_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, r["text"]
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= ratio.threshold)
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, text, *_ in corpus:
        for b in quality.features(np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().split()], np.uint64)) if text else []:
            raw[b] += 1
            target[b] += i is not None and i < 60 and i % 4 > 0
    assert np.allclose(ratio.weight, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_quality_separates(spark):
    import random

    rng = random.Random(3)
    good = "the and of river stone light under green walks slowly never again".split()
    rows = [(k, " ".join(rng.choice(good) + ("!!" if k % 4 == 0 else "") for _ in range(rng.randrange(12, 40)))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    out = quality.judge(df, quality.train(df, labels, F.col("quality") == 1, F.col("quality") == 0))
    assert out.where("doc_id % 4 = 0 and kept").count() == 0
    assert out.where("doc_id % 4 <> 0 and kept").count() >= 140


def test_quality_learns_from_every_label(spark, monkeypatch):
    """More trusted and distrusted rows than any sample of a few thousand: weights, threshold and verdicts against brute force."""
    import random

    rng = random.Random(8)
    common = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(common[:45] if k % 3 else common[25:]) for _ in range(rng.randrange(6, 16)))) for k in range(15000)]
    rows += [(k, rows[7][1]) for k in range(0, 900, 30)] + [(k, rows[k][1]) for k in range(50)] + [(None, rows[1][1]), (None, rows[3][1]), (1, None), (2, "")]
    labels = [(k, int(k % 3 > 0)) for k in range(15000) if k % 7] + [(1, 0), (2, None), (None, 1), (99999, 1), (4, 1)]
    kind = {}
    for k, label in labels:
        if k is not None and label is not None:
            kind[k] = min(label, kind.get(k, 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ask = docs.repartition(5), marks, F.col("quality") == 1, F.col("quality") == 0
    ratio = quality.train(*ask)
    raw, target, scores = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS), {0: [], 1: []}
    hashes = [np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().split()], np.uint64) for _, text in rows]
    for (k, _), h in zip(rows, hashes, strict=True):
        if len(h):
            np.add.at(raw, quality.features(h), 1)
            if kind.get(k) == 1:
                np.add.at(target, quality.features(h), 1)
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.array_equal(ratio.weight, weight)
    for (k, _), h in zip(rows, hashes, strict=True):
        if len(h) >= quality.LEAST_WORDS and k in kind:
            scores[kind[k]].append(float(weight[quality.features(h)].mean()))
    good, bad = np.sort(scores[1]), np.sort(scores[0])
    assert len(good) > 4000
    cuts = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(bad, cuts) * len(good) - np.searchsorted(good, cuts) * len(bad)
    tail, best = np.quantile(good, quality.TAIL), cuts[gain.argmax()]
    assert math.isclose(ratio.threshold, min(tail, best), rel_tol=1e-12)
    wanted = sorted(map(str, quality.judge(docs, ratio).drop("text").collect()))
    assert sorted(map(str, quality.graded(*ask).collect())) == wanted
    # trusted rows alone: the tail of them all; a large tail: the best cut
    marked, scored = quality.kinds(*ask[1:]), quality.judge(docs, ratio)
    assert math.isclose(quality.calibrated(scored, marked.where("kind = 1")), tail, rel_tol=1e-12)
    assert quality.calibrated(scored, marked.where("kind = 0")) == -math.inf
    monkeypatch.setattr(quality, "TAIL", 0.9)
    assert best < np.quantile(good, 0.9) and quality.calibrated(scored, marked) == best


def test_quality_without_labels(docs, empty):
    none = docs.select("doc_id").withColumn("quality", F.lit(0)).limit(0)
    ratio = quality.train(docs, none, F.col("quality") == 1, F.col("quality") == 0)
    assert quality.judge(docs, ratio).where("kept = base_failed").count() == 0
    assert quality.judge(empty, quality.train(empty, none, F.col("quality") == 1, F.col("quality") == 0)).count() == 0


# 9


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(docs, corpus):
    out = simhash_dedup.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in corpus]
    smallest = {}
    for i, fp in prints:
        if i is not None:
            smallest[fp] = min(i, smallest.get(fp, i))
    near = [(smallest[a], smallest[b]) for a, b in combinations(smallest, 2) if (a ^ b).bit_count() <= 3]
    component = roots(near, smallest.values())
    wanted = Counter((i, f"{fp:016x}", component[smallest[fp]] if fp in smallest else None) for i, fp in prints)
    assert Counter(tuple(r) for r in out) == wanted
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_buckets_miss_no_pair(spark):
    """Every way to differ in up to 3 bits, in a bucket of several blocks."""
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ sum(1 << b for b in bits) for n in (1, 2, 3) for bits in list(combinations(range(64), n))[:: 1 if n == 1 else 37]]
    rows = spark.createDataFrame([(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(prints)], "id long, fp long")
    assert simhash_dedup.classes(rows).where("component <> 0").count() == 0


def test_one_of_each_group_stays(docs, corpus):
    out = simhash_dedup.drop_near_duplicates(docs)
    stay = sorted((r["doc_id"] for r in out.collect() if r["doc_id"] is not None))
    component = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert stay == sorted({c for i, c in component.items() if i is not None})
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 2


# 10


def test_mixing(spark, docs, corpus):
    out = mixing.mix(docs.withColumn("copy", F.lit("clash")), weights={"s0": 3.0, "s1": 1.0, None: 1.0}, seed=7)
    got = Counter(r["doc_id"] for r in out.collect())
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, weights={"s0": 3.0, "s1": 1.0, None: 1.0}).collect()}
    assert rates["s2"] == 0 and math.isclose(sum(rates[r[3]] for r in corpus), len(corpus))
    wanted = Counter()
    for i, _, _, source, _ in corpus:
        parts = max(1, math.ceil(rates[source] / mixing.PART))
        rate = rates[source] / parts
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"7:{'' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            n, p, c = 0, math.exp(-rate), math.exp(-rate)
            while rate and c <= u:
                n += 1
                p *= rate / n
                c += p
            wanted[i] += n
    assert got == +wanted
    rows = out.collect()
    assert len({r["shuffle_key"] for r in rows}) == len({(r["doc_id"], r["copy"]) for r in rows})
    assert set(out.columns) == {*docs.columns, "copy", "shuffle_key"}


def test_mixing_large_rates(spark):
    """A rate above the largest single inversion is split; the mean comes out."""
    rows = spark.range(0, 2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "rare").otherwise("common").alias("source"))
    n = mixing.mix(rows, weights={"rare": 1.0, "common": 1.0}).where("source = 'rare'").count()
    assert abs(n - 1000) < 5 * math.sqrt(1000)


def test_mixing_spreads_rows_without_an_id(spark):
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(rows, weights={"s": 1.0})
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert out.count() in (0, 400, 800, 1200) and (not parts or len(parts) > 1)


def test_mixing_of_nothing(empty, docs):
    assert mixing.mix(empty).count() == 0
    for bad in ({}, {"s0": 0.0}, {"s0": -1.0}):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights=bad)
