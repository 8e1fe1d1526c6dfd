"""Sweeps, automata and sliding distinct counts against plain loops."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.operators import conditions as C
from eventweir.operators import sweeps
from eventweir.operators.automata import Automaton, Sliding, Sorted

PATTERNS = ["ab", "a.*b", "^ab*c", "(ab|c)+a", "a[^b]c", "b$", "^$", "^a.?b$", "a{2,3}b", "(a|b)*c(a|b)c", "", "c??a", "[a-b]{2}c", "a|^b|c$"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_automata_find_what_expressions_find(pattern):
    made = Automaton(pattern, "abc")
    for n in range(7):
        for word in product("abc", repeat=n):
            run = 0
            for letter in word:
                run = made.compose(run, made.steps[letter])
            assert made.matched(run) == bool(re.search(pattern, "".join(word))), (pattern, word)


def test_patterns_that_are_refused():
    for wrong in (r"(a)\1", "a(?=b)", "(?i)ab"):
        with pytest.raises(ValueError):
            Automaton(wrong, "ab")
    with pytest.raises(re.error):
        Automaton("(", "ab")
    with pytest.raises(ValueError, match="states"):
        Automaton("a[ab]{13}c", "abc")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_frames_of_letters(pattern):
    rng, made = random.Random(1), Automaton(pattern, "abc")
    queue, sliding = [], Sliding(made)
    held, blocks = [], Sorted(made)
    for k in range(1500):
        if queue and rng.random() < 0.45:
            queue.pop(0)
            sliding.pop()
        else:
            queue.append(rng.choice("abc"))
            sliding.push(queue[-1])
        if len(held) > 300 or held and rng.random() < 0.2:
            blocks.remove(*held.pop(rng.randrange(len(held))))
        else:
            held.append(((rng.randrange(50), k), rng.choice("abc")))
            blocks.add(*held[-1])
        assert sliding.matched() == bool(re.search(pattern, "".join(queue)))
        if k % 5 == 0:
            assert blocks.matched() == bool(re.search(pattern, "".join(x for _, x in sorted(held))))


def brute(kind, times, timeframe):
    if kind == "sequence any":
        return any(all(a < b for a, b in zip(c, c[1:], strict=False)) for c in product(*times))
    if kind == "within any":
        return any(max(c) - min(c) <= timeframe for c in product(*times))
    if not all(times):
        return False
    if kind == "sequence all":
        return all(max(a) < min(b) for a, b in zip(times, times[1:], strict=False))
    return max(map(max, times)) - min(map(min, times)) <= timeframe


@pytest.mark.parametrize("kind", ["sequence any", "sequence all", "within any", "within all"])
@pytest.mark.parametrize("seed", range(6))
def test_states(kind, seed):
    """A state after each second equals the condition over what is seen, whatever left and came before."""
    rng = random.Random(seed)
    m, frame, age = rng.choice([1, 2, 3]), rng.choice([0, 2, 9]), rng.choice([3, 20, 60])
    make = {"sequence any": lambda: sweeps.SequenceAny(m), "sequence all": lambda: sweeps.SequenceAll(m), "within any": lambda: sweeps.WithinAny(m, frame), "within all": lambda: sweeps.WithinAll(m, frame)}[kind]
    state, rows, now = make(), [], 0
    for _ in range(250):
        now += rng.choice([0, 1, 1, 5, 30])
        new = [(now - rng.randrange(25), now - rng.choice([0, 3, 40]), rng.choice([0, 0, 1, 2, 3, 4]) % (1 << m)) for _ in range(rng.randrange(4))]
        rows += new
        state.expire(now - age)
        for r in new:
            state.add(r, now - age)
        times = [[t for source, t, mask in rows if mask >> k & 1 and source >= now - age] for k in range(m)]
        assert state.answer() == brute(kind, times, frame)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for k in range(500):
        t = rng.randrange(0, 1500) if k % 50 else None
        rows.append((f"{k:03}", rng.choice("ABCD"), rng.choice(["x", "x", "y", None]), t, None if k % 33 == 0 or t is None else t - rng.randrange(-5, 40), rng.choice([None, "u", "v", "w"])))
    return spark.createDataFrame(rows, "id string, name string, host string, arrival long, creation long, user string").repartition(3).persist()


def seen(rows, t, age, source="arrival"):
    return [r for r in rows if t.arrival is not None and r.arrival is not None and r[source] is not None and r.host == t.host and r.arrival <= t.arrival and r[source] + age >= t.arrival]


@pytest.mark.parametrize("source", ["arrival", "creation"])
@pytest.mark.parametrize("age", [0, 30, 200])
def test_two_axes_with_nulls_and_skew(spark, table, source, age):
    """Null keys meet, null times see and are seen by nothing; creation may lie after arrival."""
    rows = table.collect()
    queries = [P.event_name(n) for n in "ABC"]
    for match in ("any", "all"):
        for kind, made in (("sequence", C.sequence_two_axes(table, queries, ["host"], age, match, source=source, skew=5)), ("within", C.within_two_axes(table, queries, ["host"], age, 20, match, source=source, skew=5))):
            got = {r["id"]: r["hit"] for r in made.collect()}
            for t in rows:
                times = [[r.creation for r in seen(rows, t, age, source) if r.name == n and r.creation is not None] for n in "ABC"]
                assert got[t.id] == brute(f"{kind} {match}", times, 20), (kind, match, t)


@pytest.mark.parametrize(("sort", "source"), [("arrival", "arrival"), ("creation", "arrival"), ("creation", "creation")])
def test_pattern_dfa(table, sort, source):
    rows = table.collect()
    out = C.pattern_dfa(table, [("a", P.event_name("A")), ("b", P.event_name("B"))], "a.*bb", ["host"], 100, sort, source, skew=5)
    assert [c for c in out.columns if c != "matched"] == table.columns
    got = {r["id"]: r["matched"] for r in out.collect()}
    for t in rows:
        own = sorted((r[sort], "AB".index(r.name), r.id) for r in seen(rows, t, 100, source) if r.name in "AB" and r[sort] is not None)
        assert got[t.id] == bool(re.search("a.*bb", "".join("ab"[k] for _, k, _ in own)))


@pytest.mark.parametrize("age", [0, 7, 90, 5000])
def test_distinct_values(table, age):
    rows = table.where("arrival is not null").collect()
    out = C.count_unique_sliding(table.where("arrival is not null"), P.event_name("A") | P.event_name("B"), F.col("user"), ["host"], age)
    assert out.columns == [*table.columns, "n"]
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got == {t.id: len({r.user or "" for r in seen(rows, t, age) if r.name in "AB"}) for t in rows}


def test_no_rows(table):
    none = table.limit(0)
    assert C.count_unique_sliding(none, P.event_name("A"), F.col("user"), ["host"], 5).count() == 0
    assert C.pattern_dfa(none, [("a", P.event_name("A"))], "a", ["host"], 5).count() == 0
