"""Each stage of the pipeline against brute force on what its predecessor kept, with null ids, and on an empty table."""

import importlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from test_operators import WORD_BPE, brute_bits, brute_fingerprint, brute_lines, ids_of, roots

import corpus_pipeline
from eventweir.llm import langid, mixing


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """By stage the rows it was given and gave."""
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    docs, seen = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        before, docs = docs, spark.read.parquet(str(folder / name))
        seen[name] = before.collect(), docs.collect()
        if name != "packed":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    return folder, seen


def test_language(stages):
    before, after = stages[1]["language"]
    words, letters = defaultdict(Counter), Counter()
    for r in before:
        if r["lang"] and r["text"]:
            said = langid.words_of(r["text"])
            words[r["lang"]].update(said)
            letters.update(c for w in said for c in w)
    known = set(sorted(letters, key=lambda c: (-letters[c], c))[: langid.LETTERS])
    bits = [{lang: brute_bits(words[lang], r["text"], known) for lang in words} if langid.words_of(r["text"] or "") else None for r in before]
    limit = {}
    for lang in words:
        own = sorted(b[lang] for r, b in zip(before, bits, strict=True) if b and r["lang"] == lang)
        limit[lang] = own[max(0, math.ceil((1 - langid.TAIL) * len(own)) - 1)] + langid.SLACK
    kept = Counter()
    for r, b in zip(before, bits, strict=True):
        if b:
            best = min(b, key=lambda x: (round(b[x], 9), x))
            symbols = sum(len(w) + 1 for w in langid.words_of(r["text"]))
            if b[best] <= limit[best] + langid.NOISE / math.sqrt(symbols):
                kept[r["doc_id"], r["text"], best] += 1
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in after) == kept


def test_lines(stages):
    before, after = stages[1]["lines"]
    gone = brute_lines([tuple(r) for r in before])
    wanted = Counter()
    for r in before:
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[r["doc_id"], r["text"]])
        wanted[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in after) == wanted
    assert sum(map(len, gone.values())) > 20


def test_near_duplicates(stages):
    before, after = stages[1]["near_duplicates"]
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in before]
    smallest = {}
    for i, fp in prints:
        if i is not None:
            smallest[fp] = min(i, smallest.get(fp, i))
    component = roots([(smallest[a], smallest[b]) for a, b in combinations(smallest, 2) if (a ^ b).bit_count() <= 3], smallest.values())
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(set(component.values()))
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) < len(before)


def test_mixed(stages):
    folder, seen = stages
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/near_duplicates/*.parquet')")
        names = [x[0] for x in db.execute(mixing.SQL).description]
        rows = db.execute(mixing.SQL).fetchall()
    at = [names.index(c) for c in corpus_pipeline.COLUMNS]
    assert Counter(tuple(r[k] for k in at) for r in rows) == Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in seen["mixed"][1])


def test_packed(stages):
    before, after = stages[1]["packed"]
    whole = defaultdict(list)
    for r in before:
        whole[r["doc_id"]].append(ids_of(WORD_BPE, r["text"], 1))
    for doc, all_ids in whole.items():
        mine = [r for r in after if r["doc_id"] == doc]
        assert all(any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in all_ids) for r in mine)
        covered = Counter(k for r in mine for k in range(r["start"], r["start"] + r["length"]))
        assert covered == sum((Counter(range(len(x))) for x in all_ids), Counter())


def test_whole_run(spark, stages, empty, tmp_path):
    folder, seen = stages
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(folder)).collect()) == sum(r["length"] for r in seen["packed"][1])
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n[: n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
