"""Sinks: lines, XML, JSON, Parquet, CSV; and one batch to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.schema import PUBLIC_FIELDS, effective_count
from eventweir.sources.readers import XML_SCHEMA


def line() -> Column:
    """An event as one line of text."""
    count = F.when(F.col("type") == "compressed", F.concat(F.lit(", count: "), F.col("count").cast("string"))).otherwise("")
    return F.concat(F.col("name"), F.lit(" (type: "), F.col("type"), F.lit(", status: "), F.col("status"), F.lit(", host: "), F.col("host"), F.lit(", creation: "), F.col("creation").cast("string"), count, F.lit(")"))


def public(df: DataFrame) -> DataFrame:
    """The fields that leave the engine, of those that df has."""
    return df.select(*[c for c in PUBLIC_FIELDS if c in df.columns])


def write_lines(df: DataFrame, path: str, prefix: str = "") -> None:
    df.select(F.concat(F.lit(prefix), line()).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str, prefix: str) -> None:
    df.select(F.concat(F.lit(prefix), line()).alias("value")).write.mode("append").text(path)


def to_xml_rows(df: DataFrame) -> DataFrame:
    """Events as rows in XML_SCHEMA; the count is always given, arrival and local are not."""
    attributes = F.transform(F.array_sort(F.map_entries("attributes")), lambda a: F.struct(a["key"].alias("_key"), a["value"].alias("_VALUE")))
    references = F.flatten(F.transform(F.array_sort(F.map_keys("references")), lambda k: F.transform(F.try_element_at("references", k), lambda r: F.struct(k.alias("_type"), r.alias("_VALUE")))))
    history = F.transform(
        "history",
        lambda h: F.struct(h["rule"]["groupname"].alias("_groupname"), h["rule"]["rulename"].alias("_rulename"), h["host"].alias("_host"), h["timestamp"].alias("_timestamp"), h["fields"].alias("field"), h["reason"].alias("reason")),
    )
    columns = {"count": effective_count(), "attributes": F.struct(attributes.alias("attribute")), "references": F.struct(references.alias("reference")), "history": F.struct(history.alias("entry"))}
    return df.select(*[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in XML_SCHEMA])


def write_xml(df: DataFrame, path: str) -> None:
    to_xml_rows(df).write.mode("overwrite").format("xml").option("rootTag", "events").option("rowTag", "event").save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; columns in the order of df."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the same rows to every sink. Sinks get the batch's number, to be idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return write


def drain_since(log: DataFrame, offset: int, batch: str = "batch") -> DataFrame:
    """Rows of an append log that came after a reader's offset, in batches of whole numbers."""
    return log.where(F.col(batch) > offset)
