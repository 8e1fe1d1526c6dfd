"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its target share of all rows over its present share. Each document is copied a
Poisson-distributed number of times with that rate as mean; the distribution function is inverted at a uniform number hashed from
seed and document, so the same input gives the same copies on any cluster. Copies are exploded and shuffled globally by a hash.

Rates above PART are split: the sum of m Poisson numbers of rate r/m is a Poisson number of rate r, so exp(-r) never underflows.
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import sized, written

#: Largest rate that one inversion takes, and the terms kept of its distribution function (beyond them lies under 1e-15).
PART, TERMS = 8.0, 48
#: Exponent of the default target weights: a source with n rows weighs n ** POWER.
POWER = 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: the first 52 bits of their MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS - 1 of a Poisson variable, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """Rows (source, n, rate): n rows of the source, and the mean number of copies of each that gives it its target weight.

    weights: target weight by source; a source that is not named gets 0. Without weights, n ** power. Weights are relative; the
    expected number of rows stays that of the input. Null is a source like any other (named None in weights).
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        if not weights or min(weights.values()) < 0 or not sum(weights.values()):
            raise ValueError("weights: none negative, one at least above zero")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = written(counts.withColumn("weight", weight), "mixing-counts")
    total = counts.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    scale = float(total["rows"] or 0) / total["weights"] if total["weights"] else 0.0
    return counts.select("source", "n", (F.lit(scale) * F.col("weight") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The copies of all rows, in random order, with copy (int, from 0) and shuffle_key (string): columns of docs and these two.

    Rows that repeat an id in a source are copied equally often (their uniform number hashes id and seed). A null id counts as an
    empty one; such rows are dealt out by their content. An empty table gives no rows. Clashing columns copy and shuffle_key of docs
    are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    table = rates(docs, source_col, weights)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = table.select(F.col("source").alias("_source"), F.when(F.col("rate") > 0, parts).otherwise(0).alias("_parts"), distribution(F.col("rate") / parts).alias("_steps"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # an array of one: the hash is taken once a row, not once a step
    inverted = lambda j: F.transform(F.array(uniform(F.lit(str(seed)), key, j.cast("string"))), lambda u: F.size(F.filter("_steps", lambda c: c <= u)))[0]
    copies = F.when(F.col("_parts") == 0, 0).when(F.col("_parts") == 1, inverted(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest("_parts", F.lit(1))), F.lit(0), lambda acc, j: acc + inverted(j)))
    out = docs.join(sized(table), F.col(source_col).cast("string").eqNullSafe(F.col("_source"))).withColumn("_copies", copies).where("_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), key, F.col("copy").cast("string"))))
    at = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(*docs.columns)).otherwise(0)
    out = out.select(*docs.columns, "copy", "shuffle_key", spread.alias("_spread")).repartition(at, "shuffle_key", "_spread")
    return out.sortWithinPartitions("shuffle_key", "_spread").drop("_spread")


#: DuckDB SQL for mix(documents) with the default weights and seed 0.
SQL = f"""
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {POWER}) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) * (weight / (SELECT sum(weight) FROM counts)) / n AS rate FROM counts),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {PART})) AS INTEGER) AS m FROM rates),
steps AS (SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM
  (SELECT source, m, k, exp(k * ln(rate / m) - rate / m - lgamma(k + 1)) AS p FROM parts, range({TERMS}) t(k) WHERE rate > 0)),
draws AS (SELECT DISTINCT d.doc_id, d.source, j, CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || j), 1, 13) AS BIGINT) / pow(2.0, 52) AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.m + 1)) AS j)),
copies AS (SELECT d.doc_id, d.source, CAST(sum((SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u)) AS INTEGER) AS n FROM draws d GROUP BY ALL)
SELECT d.*, CAST(c.copy AS INTEGER) AS copy, md5('order:0:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || c.copy) AS shuffle_key
FROM documents d JOIN (SELECT doc_id, source, unnest(range(n)) AS copy FROM copies WHERE n > 0) c
  ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source
"""
