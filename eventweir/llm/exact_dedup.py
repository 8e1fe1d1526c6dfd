"""Exact duplicates by a tree merge of sorted digest runs. SQL functions only.

Each partition of the input writes one run: a row per text with its digest, sorted by digest. In a round, `fan` neighbouring runs meet
(a partition sends to the one whose number is its own without the lowest bits, so a round of fan 2**k is k binomial rounds at once) and
are merged by a sorted aggregation: of equal digests the best identifier and the number of texts stay. The last round leaves one run,
spread over all tasks by digest. A digest that a third of all texts share is one row per run after the first step, which every task
takes before it sends anything, and at most `fan` rows in any later merge.

Texts count as equal if SHA-256, length in bytes and XXH64 all agree: each merge compares all three, so two texts that agreed in the first
alone would stay apart at every level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import joined_by_hubs, written

#: Runs that one merge takes: three binomial rounds at once.
FAN = 8
#: What a text is compared by.
DIGEST = ["digest", "bytes", "check"]


def digest_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """A written table (digest, bytes, check, id, row): row numbers the rows of docs, its upper bits the run. Each run is sorted by digest."""
    text = F.col(text_col).cast("string")
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"), F.col(id_col).alias("id"))
    return written(rows.sortWithinPartitions(*DIGEST, "id").withColumn("row", F.monotonically_increasing_id()), "digest-runs")


def merged(runs: DataFrame, keep: str = "smallest", fan: int = FAN) -> DataFrame:
    """One row per distinct text: (digest, bytes, check, keep_id, keep_row, n). Rounds of merges until one run is left."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    if fan < 2:
        raise ValueError("fan: two or more")
    # a null id is kept only if the group has no other; of rows with one id the first run's stays
    largest = keep == "largest"
    best = F.struct((F.col("id").isNotNull() if largest else F.col("id").isNull()).alias("rank"), F.col("id"), (-F.col("row") if largest else F.col("row")).alias("row"))
    pick = F.max if largest else F.min
    left = ((runs.agg(F.max("row")).first()[0] or 0) >> 33) + 1
    level = runs.select(F.shiftright("row", 33).alias("run"), *DIGEST, best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        left = -(-left // fan)
        level = level.withColumn("run", F.floor(F.col("run") / fan)).groupBy("run", *DIGEST).agg(pick("best").alias("best"), F.sum("n").alias("n"))
        if left == 1:
            break
    return written(level.select(*DIGEST, F.col("best.id").alias("keep_id"), F.abs("best.row").alias("keep_row"), "n"), "digest-merged")


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after `normalise` (a function of a text Column; nothing by default). Of equal texts the row
    with the smallest or largest id stays; keep_id is its id. A null text counts as empty, so do nulls that normalise returns. A null id
    stays only where no row of the group has one. Rows that repeat an id and text are one group, of which one row stays. An empty table
    gives no rows. Other columns of docs are not looked at, whatever their names.
    """
    runs = digest_runs(docs, text_col, id_col, normalise)
    table = merged(runs, keep, fan)
    total = table.agg(F.sum("n")).first()[0] or 0
    rows = joined_by_hubs(runs, table, DIGEST, total)
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat an id and text, any one stays."""
    runs = digest_runs(docs, text_col, id_col, normalise)
    table = merged(runs, keep)
    total = table.agg(F.sum("n")).first()[0] or 0
    text = F.col(text_col).cast("string")
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    # names that docs may have are out of the way in a struct
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"))
    stay = joined_by_hubs(rows, table, DIGEST, total).where(F.col("id").eqNullSafe(F.col("keep_id")))
    # one row per text is left but for repeated ids
    return stay.dropDuplicates(DIGEST).select("doc.*")


#: DuckDB SQL for classes(documents, keep="largest").
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
