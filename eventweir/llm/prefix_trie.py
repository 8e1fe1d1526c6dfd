"""The trie of conversations that are rebuilt from a base conversation's first turns and their own later ones.

A sequence of turns has a fingerprint (P**length, sum of turn * P**place) modulo primes of 31 bits; sequences are appended by
(w1, a1)(w2, a2) = (w1 * w2, a1 + w1 * a2), an associative product. So a rebuilt conversation's prefix is the product of a prefix of its
base and of a stretch of its own turns, and that stretch is the difference of two prefixes divided by a power of P: all come from prefix
products of the conversations as they are, and no rebuilt sequence or text is made. Heads that conversations of one base share are counted
once per base and length.

Prefixes with one depth and fingerprint make a node. Each carries a reference to its last turn (the SHA-256 of role and text) and its
parent's fingerprint; a node whose prefixes disagree on either is a collision, after which all is done again with other multipliers. If
none disagrees, equal fingerprints mean equal sequences, by induction over the depth.

Sums over subtrees: a node belongs to its smallest member, and the nodes of one member are a path that goes down to that member's end. The
paths form a tree, each hung below its smallest member's path. Sums over that tree take a round per doubling of the distance; a path's
nodes then need one running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.llm.common import joined_by_hubs, written
from eventweir.llm.turns import in_order, suffix_sums, turn_digest

#: The four largest primes below 2**31: products of two numbers fit a long, and fingerprints have 124 bits.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
#: Multipliers that are tried before collisions are given up on.
SEEDS = 4
A, B = [f"a{k}" for k in range(4)], [f"b{k}" for k in range(4)]


def multipliers(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") % (p - 2) + 2 for k, p in enumerate(MODULI)]


def power(base: int, exponent: Column, modulus: int) -> Column:
    """base ** exponent modulo a prime; the exponent may be negative."""
    left, out, square = F.pmod(exponent, F.lit(modulus - 1).cast("long")), F.lit(1).cast("long"), base % modulus
    for bit in range((modulus - 1).bit_length()):
        out = out * F.when(F.getbit(left, F.lit(bit)) == 1, F.lit(square)).otherwise(F.lit(1)) % modulus
        square = square * square % modulus
    return F.when(exponent == 0, F.lit(1)).otherwise(out).cast("long")


def combined(w: list[Column], left: list[Column], right: list[Column]) -> list[Column]:
    """The fingerprints of sequences appended to others with the powers w."""
    return [(a + x * b % p) % p for x, a, b, p in zip(w, left, right, MODULI, strict=True)]


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """rows (conv, turn, digest, points) in order, with part, k (place in its fragment, from 1), and the fingerprints of the fragment up
    to the row (a0..) and before it (b0..). Batches carry the open fragment's place and fingerprint on; a written table."""
    base = multipliers(seed)
    order = in_order(rows, ["conv", "turn", "digest", "rid"]).select("part", "conv", "digest", "points")
    schema = T.StructType([*order.schema.fields, T.StructField("k", T.LongType()), *[T.StructField(c, T.LongType()) for c in A + B]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.ones(1, np.int64) for _ in base]
        key, place, sums = None, 0, [0] * 4
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy()
            part = batch.column("part").to_numpy()
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])
            new[0] = (part[0], conv[0]) != key
            starts = np.flatnonzero(new)
            begin = np.concatenate([[0], starts]) if not new[0] else starts
            of = np.cumsum(new) - (1 if new[0] else 0)
            k = np.arange(n) - begin[of] + 1
            if not new[0]:
                k[: starts[0] if len(starts) else n] += place
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(n, 8)[:, :4].astype(np.int64)
            upto, before = [], []
            for j, p in enumerate(MODULI):
                while len(powers[j]) <= k.max():
                    powers[j] = np.concatenate([powers[j], powers[j] * (int(powers[j][-1]) * base[j] % p) % p])
                term = (words[:, j] % p + 1) % p * powers[j][k] % p
                total = np.cumsum(term)
                offset = np.concatenate([[0], total])[begin]
                offset[0] -= 0 if new[0] else sums[j]
                upto.append((total - offset[of]) % p)
                before.append((total - term - offset[of]) % p)
            key, place, sums = (part[-1], conv[-1]), int(k[-1]), [int(u[-1]) for u in upto]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k), *map(pa.array, upto), *map(pa.array, before)], [*batch.schema.names, "k", *A, *B])

    return written(order.mapInArrow(scan, schema), "trie-prefixes")


def placed(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with pos, the place in the whole conversation, and fingerprints of the conversation up to the row and before it; one row per
    conversation (conv, n, t0..): its turns and its fingerprint)."""
    base = multipliers(seed)
    pieces = rows.groupBy("part", "conv").agg(F.max("k").alias("n"), F.max_by(F.struct(*A), "k").alias("a"))
    several = pieces.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")  # at most two per partition
    pieces = written(pieces.select("part", "conv", "n", "a.*"), "trie-pieces")

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        length, now, out = 0, [0] * 4, []
        for part, conv, n, *a in frame[["part", "conv", "n", *A]].itertuples(index=False):
            w = [pow(b, length, p) for b, p in zip(base, MODULI, strict=True)]
            out.append((part, conv, length, *w, *now))
            now = [(x + y * int(z)) % p for x, y, z, p in zip(now, w, a, MODULI, strict=True)]
            length += int(n)
        return pd.DataFrame(out, columns=["part", "conv", "off", *[f"w{k}" for k in range(4)], *[f"o{k}" for k in range(4)]])

    ddl = "part long, conv long, off long, " + ", ".join(f"{c}{k} long" for c in "wo" for k in range(4))
    offsets = written(pieces.join(F.broadcast(several), "conv", "left_semi").groupBy("conv").applyInPandas(follow, ddl), "trie-offsets")

    def moved(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(offsets), ["part", "conv"], "left")
        w = [F.coalesce(f"w{k}", F.lit(1)) for k in range(4)]
        o = [F.coalesce(f"o{k}", F.lit(0)) for k in range(4)]
        made = {c: x for own in (A, B) if own[0] in df.columns for c, x in zip(own, combined(w, o, [F.col(c) for c in own]), strict=True)}
        return df.withColumns(made | {"off": F.coalesce("off", F.lit(0))}).drop(*[f"{c}{k}" for c in "wo" for k in range(4)])

    whole = moved(pieces).groupBy("conv").agg(F.max(F.col("off") + F.col("n")).alias("n"), F.max_by(F.struct(*A), F.col("off")).alias("t"))
    return moved(rows).withColumn("pos", F.col("off") + F.col("k")).drop("off", "k"), whole.select("conv", "n", *[F.col(f"t.{c}").alias(f"t{k}") for k, c in enumerate(A)])


def packed(parts: list[Column], name: str) -> list[Column]:
    """A fingerprint as two longs."""
    return [(F.shiftleft(parts[0], 31) + parts[1]).alias(f"{name}1"), (F.shiftleft(parts[2], 31) + parts[3]).alias(f"{name}2")]


def members(rows: DataFrame, whole: DataFrame, base_of: Column, head_of: Column, longest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes (depth, f1, f2, p1, p2, digest, points, n, conv) of rebuilt conversations, n of them with the smallest member conv; the
    rebuilt conversations (conv, depth, f1, f2) as whole ones)."""
    base = multipliers(seed)
    fixed = whole.select("*", base_of.alias("base"), head_of.cast("long").alias("head"))
    heads = written(rows.where((F.col("pos") <= longest) & (base_of == F.col("conv"))).select(F.col("conv").alias("base"), "pos", *A, *B, "digest", "points"), "trie-heads")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("longest"))
    own = rows.where(F.col("pos") == head_of).select("conv", *[F.col(c).alias(f"s{k}") for k, c in enumerate(A)])
    marks = heads.select("base", F.col("pos").alias("hb"), *[F.col(c).alias(f"h{k}") for k, c in enumerate(A)])
    fixed = fixed.join(lengths, "base", "left").withColumn("hb", F.least(F.col("head"), F.coalesce("longest", F.lit(0))))
    fixed = fixed.join(marks, ["base", "hb"], "left").join(own, "conv", "left")
    zero = {f"{c}{k}": F.coalesce(f"{c}{k}", F.lit(0)) for c in "hs" for k in range(4)}
    shift = {f"w{k}": power(b, F.col("hb") - F.col("head"), p) for k, (b, p) in enumerate(zip(base, MODULI, strict=True))}
    fixed = written(fixed.withColumns(zero).withColumns(shift).drop("longest"), "trie-rebuilt")
    w, h = ([F.col(f"{c}{k}") for k in range(4)] for c in "wh")
    since = lambda own: [F.pmod(F.col(c) - F.col(f"s{k}"), F.lit(p)) for k, (c, p) in enumerate(zip(own, MODULI, strict=True))]
    later = F.col("n") > F.col("head")
    ends = fixed.withColumns({f"e{k}": F.when(later, x).otherwise(F.col(f"h{k}")) for k, x in enumerate(combined(w, h, since([f"t{k}" for k in range(4)])))})
    ends = ends.select("conv", (F.col("hb") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("depth"), *packed([F.col(f"e{k}") for k in range(4)], "f"))
    # heads, counted per base and length
    shared = fixed.where("hb > 0").groupBy("base", "hb").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    shared = shared.withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hb")))).join(heads, ["base", "pos"])
    shared = shared.select(F.col("pos").alias("depth"), *packed([F.col(c) for c in A], "f"), *packed([F.col(c) for c in B], "p"), "digest", "points", "n", "conv")
    # turns after the head
    total = rows.count()
    given = fixed.where(later).select("conv", "n", "head", "hb", *[f"{c}{k}" for c in "whs" for k in range(4)])
    after = joined_by_hubs(rows.where(F.col("pos") > head_of), given, ["conv"], total)
    after = after.select((F.col("hb") + F.col("pos") - F.col("head")).alias("depth"), *packed(combined(w, h, since(A)), "f"), *packed(combined(w, h, since(B)), "p"), "digest", "points", F.lit(1).cast("long").alias("n"), "conv")
    root = whole.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    nothing = {c: F.lit(0).cast("long") for c in ("depth", "f1", "f2", "p1", "p2", "points")} | {"digest": F.lit(b"")}
    return shared.unionByName(after).unionByName(root.withColumns(nothing)), ends


def grouped(found: DataFrame) -> DataFrame | None:
    """Nodes (depth, f1, f2, p1, p2, points, n, conv) as a written table; None if a fingerprint stands for two sequences."""
    told = F.struct("p1", "p2", "digest")
    nodes = found.groupBy("depth", "f1", "f2").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("points").alias("points"), F.min(told).alias("told"), F.max(told).alias("other"))
    nodes = written(nodes.select("depth", "f1", "f2", "told.p1", "told.p2", "points", "n", "conv", (F.col("told") == F.col("other")).alias("same")), "trie-nodes")
    return None if nodes.where("not same").limit(1).count() else nodes.drop("same")


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (depth, f1, f2, ends_sha256): of the ids of the conversations that end at a node. They stream through a task in ascending order."""
    key = ["depth", "f1", "f2"]
    at = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select(*key, "conv").repartition(at, *key).sortWithinPartitions(*key, "conv")
    schema = pa.schema([*[(k, pa.int64()) for k in key], ("ends_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *own, conv in zip(*[batch.column(c).to_pylist() for c in (*key, "conv")], strict=True):
                if own != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = own, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, digest.hexdigest()), strict=True))], schema=schema)

    return rows.mapInArrow(stream, "depth long, f1 long, f2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (with path: the smallest member, depth, and up: the parent's smallest member) with the values summed over their subtrees."""
    paths = nodes.groupBy("path").agg(F.min("depth").alias("top"), F.min_by("up", "depth").alias("up"), *[F.sum(v).alias(v) for v in values])
    paths = written(paths, "trie-paths")
    state = paths.select("path", "up", *values)
    while True:
        below = written(state.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"_{v}") for v in values]), "trie-below")
        total = below.agg(F.sum("n")).first()[0]
        if not total:
            break
        summed = state.join(below.drop("n"), "path", "left").select("path", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        # the target of very many paths, as the root's is, comes to them
        target = below.select(F.col("path").alias("up"), "n").join(state.select(F.col("path").alias("up"), F.col("up").alias("_up")), "up")
        jump = joined_by_hubs(state.where("up is not null").select("path", "up"), written(target, "trie-targets"), ["up"], total).select("path", F.col("_up").alias("up"))
        state = written(summed.drop("up").join(jump, "path", "left"), "trie-sums")
    hung = paths.where("up is not null").select("path", F.col("up").alias("_up"), (F.col("top") - 1).alias("_at"))
    hung = hung.join(state.select("path", *values), "path").groupBy("_up", "_at").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    rows = nodes.join(hung, (F.col("path") == F.col("_up")) & (F.col("depth") == F.col("_at")), "left")
    rows = rows.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("_up", "_at", *[f"_{v}" for v in values])
    return suffix_sums(rows, "path", "depth", values)


def trie(turns: DataFrame, base_of: Column, head_of: Column, longest: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    base_of and head_of tell, from the column conv (long), which conversation each is rebuilt on, and by how many of its first turns;
    a base is its own base, and no head is longer than `longest`. A rebuilt conversation is the base's first turns (all if it has fewer,
    none if there is no such conversation), then its own turns after as many of its first. A node is a distinct sequence of (role, text);
    members are the rebuilt conversations that begin with it. conv_id is the smallest member, n_leaves counts nodes without children in
    the subtree, saved_tokens sums (n_convs - 1) times the code points of the last text over it, ends_sha256 is of the ids, in ascending
    order, of conversations that are this sequence.

    Turns come by turn (null first), then by SHA-256 of role and text. Null roles and texts are empty. Rows without a conversation are left
    out. A conversation of which nothing is left is a member of the root. An empty table gives no rows. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("points"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "trie-turns")
    for seed in range(SEEDS):
        found, ends = members(*placed(prefixes(rows, seed), seed), base_of, head_of, longest, seed)
        if (nodes := grouped(found)) is not None:
            break
    else:
        raise ValueError("fingerprints collide")
    key = ["depth", "f1", "f2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    # a parent that very many nodes share comes to them
    above = written(nodes.join(children, key).select(F.col("depth").alias("above"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("up"), F.col("n_children").alias("n"), "n_children"), "trie-parents")
    total = above.agg(F.sum("n")).first()[0] or 0
    own = nodes.select("depth", "f1", "f2", "p1", "p2", "points", F.col("n").alias("n_convs"), F.col("conv").alias("path"), (F.col("depth") - 1).alias("above"))
    below = joined_by_hubs(own.where("depth > 0"), above.drop("n_children"), ["above", "p1", "p2"], total).drop("n")
    rows = below.unionByName(own.where("depth = 0").withColumn("up", F.lit(None).cast("long"))).drop("above", "p1", "p2")
    rows = rows.join(children, key, "left").join(end_digests(ends), key, "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    rows = rows.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("points"), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))})
    rows = written(rows.withColumn("up_path", F.col("up")).drop("points"), "trie-rows")
    # within a path the parent is the path itself
    rows = rows.withColumn("up", F.when(F.col("up") != F.col("path"), F.col("up")))
    out = subtree_sums(rows, ["n_leaves", "saved_tokens"])
    return out.select(F.col("path").alias("conv_id"), "depth", F.col("up_path").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Conversations of a hundred share the one with the smallest id as their base; at most so many of its turns.
GROUP, LONGEST = 100, 5


def hundreds(turns: DataFrame) -> DataFrame:
    """trie() with conversation c rebuilt on c - c % 100, by crc32 of its decimal id modulo 6 turns."""
    conv = F.col("conv")
    return trie(turns, conv - F.pmod(conv, F.lit(GROUP)), F.crc32(conv.cast("string").cast("binary")) % (LONGEST + 1), LONGEST)


#: CRC-32 in DuckDB SQL: its table as a list, by rule, and the sum of an ASCII text.
CRC_TABLE = "crc(t) AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)))"


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters; crc is among the tables."""
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


#: DuckDB SQL for hundreds(conversations). Prefixes are lists of turns, which stand for themselves.
SQL = f"""WITH {CRC_TABLE},
tu AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
hd AS (SELECT c, c - c % {GROUP} AS b, {crc_sql("CAST(c AS VARCHAR)")} % {LONGEST + 1} AS h FROM (SELECT DISTINCT c FROM tu), crc),
hb AS (SELECT c, b, h, (SELECT count(*) FROM tu WHERE tu.c = hd.b AND pos <= h) AS hb FROM hd),
re AS (SELECT hb.c, pos AS d, role, text FROM hb JOIN tu ON tu.c = hb.b AND pos <= h UNION ALL SELECT hb.c, hb.hb + pos - h, role, text FROM hb JOIN tu ON tu.c = hb.c AND pos > h),
me AS (SELECT c, d, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS p, length(text) AS points FROM re UNION ALL SELECT c, 0, [], 0 FROM hb),
ed AS (SELECT c, max(d) AS d FROM me GROUP BY c),
en AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM me JOIN ed USING (c, d) GROUP BY p),
no AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n, max(points) AS points FROM me GROUP BY p, d),
ch AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM no WHERE d > 0 GROUP BY 1),
va AS (SELECT no.p, no.d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN no.d = 0 THEN 0 ELSE (n - 1) * points END AS saved FROM no LEFT JOIN ch ON ch.p = no.p),
up AS (SELECT p[1:k] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS k FROM va) GROUP BY 1)
SELECT no.conv_id, CAST(no.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, no.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM no LEFT JOIN no a ON no.d > 0 AND a.d = no.d - 1 AND a.p = no.p[1:no.d - 1] LEFT JOIN ch ON ch.p = no.p LEFT JOIN en ON en.p = no.p JOIN up ON up.p = no.p"""
