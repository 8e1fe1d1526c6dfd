"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction c; a vector v passes it if <v, c> >= ALPHA. Two vectors at a small angle pass common filters, two random
ones hardly ever. Directions form a random product code: the space, turned by a random rotation, is cut into two halves, each with
its own random unit vectors, and every pair (a, b) of these is the direction (a, b)/sqrt(2). So B^2 directions cost 2B products:
the list of all filters that a vector passes is decoded by taking, in one half, the entries that the other half's best can lift over
the threshold, and completing only those. Several such codes, each with its own rotation, even out how many filters a
vector passes.

The number of filters is set from the threshold on cosines so that independent filters would miss a linked pair with probability
MISS at most (those of a code are not quite independent: about 1 pair in 120 exactly at the threshold is missed, and none that the
tests found at a cosine of 0.95), and the height of the caps from the number of vectors so that a filter holds few unrelated ones. Vectors are joined on their filters and
verified in double precision; a link is counted in the smallest common filter.

Equal vectors are one class with a weight: only classes enter the filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweir.llm.common import chunks, connected, within_buckets, written

COSINE = 0.9
#: Probability of missing a pair at exactly the threshold, and how many unrelated vectors may pass a filter, on average.
MISS, CROWD = 3e-5, 0.3
#: Product codes, each with a rotation of its own; many small codes are more nearly independent than few large ones.
CODES = 64
SEED = 42


def cap(alpha: float, dim: int) -> float:
    """Share of the unit sphere's surface with <v, c> >= alpha."""
    t = np.linspace(alpha, 1, 4001)
    whole = np.linspace(-1, 1, 40001)
    density = lambda x: np.maximum(1 - x * x, 0) ** ((dim - 3) / 2)
    return float(np.trapezoid(density(t), t) / np.trapezoid(density(whole), whole))


def also(alpha: float, cosine: float, dim: int) -> float:
    """Probability that a vector at this cosine to one that passes a filter passes it too."""
    t = np.linspace(alpha, 1 - 1e-9, 400)
    density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2)
    # what the second vector needs from the directions orthogonal to the first
    need = (alpha - cosine * t) / (math.sqrt(1 - cosine**2) * np.sqrt(1 - t * t))
    passing = np.array([cap(x, dim - 1) if x < 1 else 0.0 for x in np.clip(need, -1, 1)])
    return float(np.trapezoid(density * passing, t) / np.trapezoid(density, t))


class Filters:
    """The code for vectors of one dimension. n: number of vectors, which sets the height of the caps."""

    def __init__(self, dim: int, n: int, cosine: float = COSINE, seed: int = SEED):
        self.dim = dim
        self.padded = dim + dim % 2 if dim > 3 else 4
        crowd = CROWD / max(n, 1)
        heights = [a for a in np.arange(0.2, 0.81, 0.05) if cap(a, self.padded) >= crowd]
        self.alpha = float(heights[-1]) if heights else 0.2
        per_vector = math.log(MISS) / math.log1p(-min(also(self.alpha, cosine, self.padded), 1 - 1e-9))
        self.codewords = max(8, math.ceil(math.sqrt(per_vector / cap(self.alpha, self.padded) / CODES)))
        draw = np.random.default_rng([seed, dim])
        self.rotations = [np.linalg.qr(draw.standard_normal((self.padded, self.padded)))[0][:dim] for _ in range(CODES)]
        halves = draw.standard_normal((CODES, 2, self.codewords, self.padded // 2))
        self.halves = halves / np.linalg.norm(halves, axis=3, keepdims=True)

    @property
    def number_type(self) -> str:
        return "int" if CODES * self.codewords**2 < 1 << 31 else "long"

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The numbers of the filters that each unit vector passes, ascending."""
        half, limit = self.padded // 2, self.alpha * math.sqrt(2)
        owners, numbers = [], []
        for code, (rotation, (first, second)) in enumerate(zip(self.rotations, self.halves, strict=True)):
            turned = vectors @ rotation
            left, right = turned[:, :half] @ first.T, turned[:, half:] @ second.T
            v, row = np.nonzero(left >= limit - right.max(1, keepdims=True))
            some, column = np.nonzero(right[v] >= (limit - left[v, row])[:, None])
            owners.append(v[some])
            numbers.append((code * self.codewords + row[some]) * self.codewords + column)
        owner, number = np.concatenate(owners), np.concatenate(numbers)
        order = np.argsort(owner, kind="stable")  # numbers ascend already, code by code
        return np.split(number[order], np.searchsorted(owner[order], np.arange(1, len(vectors))))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors (double precision) of the bytes of vectors of one dimension."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Near:
    """Vectors at this cosine or above. kind: type of the numbers in a vector's bytes."""

    def __init__(self, cosine: float, kind: str):
        self.cosine, self.kind = cosine, kind

    def reduce(self, rows: DataFrame) -> DataFrame:
        """Of a member's list of filters, a bucket needs those before it."""
        return rows.withColumn("filters", F.slice("filters", 1, F.col("place"))).drop("place")

    def prepare(self, x: dict) -> dict:
        return x | {"vector": units(x["vector"].tolist(), self.kind)}

    def pairs(self, x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        v = x["vector"]
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 4096):
            out[at : at + 4096] = np.einsum("ij,ij->i", v[i[at : at + 4096]], v[j[at : at + 4096]]) >= self.cosine - 1e-9  # decided by matrix()
        return out

    def matrix(self, left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        links = left["vector"] @ right["vector"].T >= self.cosine
        # this bucket counts a link if the two have no smaller filter in common
        raw = [*left["filters"], *right["filters"]]
        kinds, at = np.unique(np.concatenate(raw), return_inverse=True)
        passes = np.zeros((len(raw), len(kinds)), np.float32)
        passes[np.repeat(np.arange(len(raw)), [len(x) for x in raw]), at] = 1
        n = len(left["id"])
        return links, passes[:n] @ passes[n:].T < 0.5


def classes(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """From rows (id, vector array<float> or array<double>, usable only): one row per distinct vector with rep (smallest id), weight (rows),
    links (other rows linked with each of them) and component (smallest id reachable)."""
    reps = written(vectors.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "cap-classes")
    sizes = reps.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row per dimension
    out = None
    for dim, n in sorted(map(tuple, sizes)):
        own = _links(reps.where(F.size("vector") == dim), Filters(dim, n, cosine, seed), cosine)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else reps.select("*", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))


def _links(reps: DataFrame, filters: Filters, cosine: float) -> DataFrame:
    shared = reps.sparkSession.sparkContext.broadcast(filters)
    kind = "<f4" if reps.schema["vector"].dataType.elementType == T.FloatType() else "<f8"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, 1024):
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind)
            vectors = [x.tobytes() for x in flat.reshape(batch.num_rows, -1)]
            lists = own.decode(units(vectors, kind))
            number = pa.int32() if own.number_type == "int" else pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), pa.array(vectors, pa.binary()), pa.array(lists, pa.list_(number))], ["id", "weight", "vector", "filters"])

    known = written(reps.where("rep is not null").select("rep", "weight", "vector").mapInArrow(work, f"id long, weight long, vector binary, filters array<{filters.number_type}>"), "cap-vectors")
    rows = known.select("id", F.posexplode("filters").alias("place", "bucket")).withColumn("bucket", F.col("bucket").cast("long"))
    edges, counts = within_buckets(rows, known, Near(cosine, kind), "cap")
    found = connected(edges, "cap-links")
    out = reps.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("vector", "rep", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row.

    n_links: other rows at this cosine or above that were found; component_id: smallest id reachable by links, itself included; kept:
    whether it is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths do not link. Rows that repeat an id each count. A null id: such rows link by equality only, and have
    the component of rows with an equal vector (null if none has an id); kept is then false. Other columns are not read.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    if base.schema["vector"].dataType != T.ArrayType(T.FloatType()):
        base = base.withColumn("vector", F.col("vector").cast("array<double>"))
    good = base.where(usable(F.col("vector")))
    found = written(classes(good, cosine, seed), "cap-result")
    linked = good.join(found.drop("rep", "weight"), "vector").select("id", F.col("links").alias("n_links"), "component")
    alone = base.where(~usable(F.col("vector"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
