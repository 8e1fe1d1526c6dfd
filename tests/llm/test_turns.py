"""Conversation repair and the prefix trie against brute force: nulls, ties, repeated rows, long and absent conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventweir.llm import prefix_trie, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
TABLES = "/root/testdata"
SPACE = "[^\x20\x09-\x0d]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows, blank):
    """Rows (turn, role, text) by conversation, in the order that the operators define."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn, blank if role is None else role, blank if text is None else text))
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2]))) for c, r in found.items()}


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in (*range(40), 100, 101, 107, 250, 999):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"] if turn else ["user", "system"]) if rng.random() < 0.9 else rng.choice(["tool", "", "system", None])
            text = rng.choice(["Yes.", "No!", "so it is", "", " \t", None, "Why?", "é.\n", "Ok. "])
            rows.append((conv, turn if rng.random() < 0.95 else rng.choice([None, turn + 5, turn - 1]), role, text))
    rows += [(7, 3, "user", "again."), (7, 3, "user", "again."), (None, 0, "user", "lost."), (None, None, None, None), (5, 1, "assistant", "word " * 3000)]
    # one conversation holds a third of all rows
    rows += [(300, t, ("user", "assistant", "tool")[rng.randrange(3)], f"t{rng.randrange(60)}.") for t in range(len(rows) // 2)]
    rng.shuffle(rows)
    return rows


# repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(rows):
    """(audit row without id) of rows (turn, role, text) in order. A plain table of (cost, word, repaired) from the end backwards."""
    seen, faults, codes = set(), [0, 0, 0], []
    for _, role, text in rows:
        marks = re.findall(SPACE, text)
        fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
        seen.add((role, text))
        codes.append(fault)
        if fault is not None:
            faults[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    best = {s: (0, "", []) if s in "a" else None for s in moves}
    for k in range(len(rows), -1, -1):
        now = dict.fromkeys(moves) if k < len(rows) else dict(best)
        if k < len(rows):
            _, role, text = rows[k]
            late = 5 * (codes[k] == 2)
            for s, to in moves.items():
                ways = [(2, "D", s, [])]
                if codes[k] in (None, 2):
                    if role[:1] in to:
                        ways.append((late, "K", to[role[:1]], [f"{role}:{text}"]))
                    ways += [(1 + late, "R", to[r], [f"{name[r]}:{text}"]) for r in "ua" if r in to]
                found = [(c + best[t][0], x + best[t][1], made + best[t][2]) for c, x, t, made in ways if best[t]]
                now[s] = min(found, key=lambda w: w[:2], default=None)
        for _ in range(3):
            for s, to in moves.items():
                ways = [(5 + now[to[r]][0], "I" + now[to[r]][1], [f"{name[r]}:", *now[to[r]][2]]) for r in "ua" if r in to and now[to[r]]]
                now[s] = min([*ways, *([now[s]] if now[s] else [])], key=lambda w: w[:2], default=None)
        best = now
    cost, word, made = best[""]
    return (gaps, *faults, illegal, cost, word, sha("\n".join(made)))


COLUMNS = ["conv_id", *turn_repair.COUNTS, "audit", "repaired_sha256"]


def audited(rows):
    after = in_order(damage(rows), " ")
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    return sorted(((c, *(repair(after[c]) if c in after else nothing)) for c in {r[0] for r in rows}), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_repair(spark):
    rows = conversations()
    assert told(turn_repair.audit_damaged(spark.createDataFrame(rows, SCHEMA).repartition(5))) == audited(rows)


def test_repair_of_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_turn_repair(spark, f"{TABLES}/sf0.01")) == audited(rows)


@pytest.mark.parametrize("seed", range(4))
def test_walk_is_the_cheapest_and_least(seed):
    """Every word of codes up to a length, cut into fragments at random, against the plain table."""
    rng = random.Random(seed)
    roles = ("user", "assistant", "system", "tool")
    for _ in range(150):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(0, 14)))
        texts = {0: "%d.", 1: " ", 2: "x.", 3: "%d"}
        rows = [(k, roles[c // 4], texts[c % 4] % k if "%" in texts[c % 4] else texts[c % 4]) for k, c in enumerate(codes)]
        rows = [(0, r, "x.") for r in roles] + rows  # what the duplicates repeat
        codes = bytes((0, 4, 8, 12)) + codes
        w, word, state = turn_repair.Walker(), "", 0
        cuts = sorted({0, len(codes), *[rng.randrange(len(codes) + 1) for _ in range(2)]})
        pieces = [codes[a:b] for a, b in itertools.pairwise(cuts)]
        ends, now = [], list(turn_repair.END)
        for piece in reversed(pieces):
            ends.append(now)
            m = w.matrix(piece)
            now = [min(m[4 * s + t] + now[t] for t in range(4)) for s in range(4)]
        for piece, end in zip(pieces, reversed(ends), strict=True):
            for letters, at in w.walk(piece, w.of(end), state):
                word, state = word + letters, at
        word += "I" * (turn_repair.END[state] // 5)
        _, _, _, _, _, cost, least, _ = repair(rows)
        assert (now[0], word) == (cost, least)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C"), (2, 0, "system", "S."), (2, 1, "user", "U."), (2, 2, "assistant", "V."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("uid", "part", "code", "rid", "void", "conv", "edit", "n")})
    out = turn_repair.repaired(df)
    assert out.columns == ["conv_id", "place", "role", "text"]
    made = [(r.conv_id, r.role, r.text) for r in out.orderBy("conv_id", "place").collect()]
    assert [m for m in made if m[0] == 2] == [(2, "system", "S."), (2, "user", "U."), (2, "assistant", "V.")]
    assert not [m for m in made if m[0] == 3]
    assert [m[1:] for m in made if m[0] == 1] == [("user", "A."), ("assistant", "B.")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.edits(none).count() == 0 and turn_repair.audit_damaged(none).count() == 0


# trie


def nodes_of(rows, group=100, longest=5):
    turns = in_order([r for r in rows if r[0] is not None], "")
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (longest + 1)
        rebuilt[c] = tuple(t[1:] for t in (turns.get(c - c % group, [])[:h] + own[h:]))
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in children[node])
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(rebuilt[c]) == len(node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], sha(ends)))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shown(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=str)


def branching(seed):
    """Conversations that share beginnings of all lengths, copies of one, one long, one without turns of its own."""
    rng = random.Random(seed)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab")) for c in range(100, 190) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "same") for c in (205, 217, 301, 333, 441) for t in range(6)]
    rows += [(500, t, "user", f"x{t % 3}") for t in range(400)] + [(501, t, "user", f"x{t % 3}") for t in range(300)]
    return rows


@pytest.mark.parametrize("rows", [conversations(), branching(1), branching(2)], ids=["odd", "one", "two"])
def test_trie(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("conv", "digest", "a0", "path", "up", "n")})
    assert shown(prefix_trie.hundreds(df.repartition(5))) == nodes_of(rows)


def test_trie_of_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(queries.op13_prefix_trie(spark, f"{TABLES}/sf0.01")) == nodes_of(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.hundreds(none).count() == 0
    assert prefix_trie.hundreds(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_long_paths_are_summed_in_blocks(spark, monkeypatch):
    from eventweir.llm import turns

    monkeypatch.setattr(turns, "BLOCK", 7)
    rows = branching(3)
    assert shown(prefix_trie.hundreds(spark.createDataFrame(rows, SCHEMA))) == nodes_of(rows)


def test_collisions_are_seen(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MODULI", (3, 3, 3, 3))
    monkeypatch.setattr(prefix_trie, "SEEDS", 2)
    with pytest.raises(ValueError, match="collide"):
        prefix_trie.hundreds(spark.createDataFrame(branching(1), SCHEMA))
