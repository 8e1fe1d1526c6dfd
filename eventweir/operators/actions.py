"""Actions of rules as transformations of the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.schema import ENGINE_HOST, HISTORY, MULTIPLE, effective_count, event_id
from eventweir.operators.joins import select_events
from eventweir.sources.scratch import written


def entry(group: str, rule: str, at: Column, fields: Sequence[str] = (), reason: str = "", host: str = ENGINE_HOST) -> Column:
    """One entry of an event's history."""
    return F.struct(F.struct(F.lit(group).alias("groupname"), F.lit(rule).alias("rulename")).alias("rule"), F.lit(host).alias("host"), at.cast("long").alias("timestamp"), F.array(*[F.lit(f) for f in fields]).cast("array<string>").alias("fields"), F.lit(reason).alias("reason"))


def noted(where: Column, note: Column) -> Column:
    return F.when(where, F.array_append(F.coalesce(F.col("history"), F.array().cast(HISTORY)), note)).otherwise(F.col("history"))


def drop(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def modify(df: DataFrame, where: Column, group: str, rule: str, status: str | None = None, local: bool | None = None, reason: str = "") -> DataFrame:
    """Sets status and local where they differ, and notes in the history what changed."""
    for name, new in (("status", status), ("local", local)):
        if new is not None:
            change = where & (F.col(name) != F.lit(new))
            df = df.withColumn("_change", F.coalesce(change, F.lit(False))).withColumn(name, F.when(F.col("_change"), F.lit(new)).otherwise(F.col(name)))
            df = df.withColumn("history", noted(F.col("_change"), entry(group, rule, F.col("arrival"), [name], reason))).drop("_change")
    return df


def forward(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(all rows with forwarded set on those that leave, the rows that leave): selected, not local, not forwarded before."""
    leaves = where & ~F.col("local") & ~F.col("forwarded")
    marked = df.withColumn("_leaves", F.coalesce(leaves, F.lit(False)))
    out = marked.where("_leaves").drop("_leaves")
    return marked.withColumn("forwarded", F.col("forwarded") | F.col("_leaves")).drop("_leaves"), out


def same_or(name: str, default: Column) -> Column:
    """The value that all rows of a group share, else the default."""
    return F.when(F.min(name).eqNullSafe(F.max(name)) & (F.count(name) == F.count(F.lit(1))), F.min(name)).otherwise(default).alias(name)


def compress(df: DataFrame, keys: Sequence[str], attributes: Sequence[str] = ()) -> DataFrame:
    """One compressed event for each key with more than one event; an event alone in its key stays as it is.

    Counts are summed (a compressed event counts as many as it holds), times are the earliest, description, host, status and local are
    kept if all agree. Of the attributes named, one that all events that have it agree on is kept, any other disagreement is marked.
    keys: name first, then whatever keeps events apart (a correlated field, a window). Aggregates only: partial ones meet in a shuffle.
    """
    kept = {a: F.try_element_at("attributes", F.lit(a)) for a in attributes}
    merged = [F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.lit(MULTIPLE)).alias(f"_a_{a}") for a, c in kept.items()]
    one = F.struct("id", "type", "count")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.min_by(one, F.struct("creation", "id")).alias("_one"),
        F.sum(effective_count()).cast("long").alias("_count"),
        same_or("description", F.lit("")),
        *([] if "host" in keys else [same_or("host", F.lit(ENGINE_HOST))]),
        same_or("status", F.lit("active")),
        same_or("local", F.lit(False)),
        F.min("creation").alias("creation"),
        F.min("arrival").alias("arrival"),
        *merged,
    )
    several = F.col("_rows") > 1
    made = event_id(F.lit("compress"), *[F.col(k).cast("string") for k in keys], F.col("arrival").cast("string"))
    if attributes:
        pairs = F.array(*[F.struct(F.lit(a).alias("key"), F.col(f"_a_{a}").alias("value")) for a in attributes])
        out = out.withColumn("attributes", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))).drop(*[f"_a_{a}" for a in attributes])
    return (
        out.withColumn("id", F.when(several, made).otherwise(F.col("_one.id")))
        .withColumn("type", F.when(several, F.lit("compressed")).otherwise(F.col("_one.type")))
        .withColumn("count", F.when(several, F.col("_count")).otherwise(F.col("_one.count")))
        .drop("_rows", "_one", "_count")
    )


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Keys equal those with the prefix, nulls included."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def merged_references(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, reftype, refs): the union of the references of each type, sorted; types without references are left out."""
    pairs = df.select(*keys, F.explode("references").alias("reftype", "_refs")).select(*keys, "reftype", F.explode("_refs").alias("_ref"))
    return pairs.groupBy(*keys, "reftype").agg(F.array_sort(F.collect_set("_ref")).alias("refs"))


def compressible() -> Column:
    """What may be compressed: raw and compressed events that were not forwarded."""
    return F.col("type").isin("raw", "compressed") & ~F.col("forwarded")


def compress_events(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """df (rows of the event schema, maybe with further columns) with the rows that `where` selects compressed by key; keys: name first,
    then whatever keeps events apart.

    where: compressible() by default; add what else excludes an event, such as being in a context. Rows that it does not select, and an
    event alone in its key, stay as they are. Of several events one is made: counts are summed, times the earliest, description, host,
    status and local kept if all agree, of every attribute the value that all events that have it share (else the mark of several),
    references the union by type. Its history is empty. Columns beyond the event schema are kept if all agree, else null.
    """
    chosen = F.coalesce(compressible() if where is None else where, F.lit(False))
    own = [k for k in keys if k not in df.columns]
    if own:
        raise ValueError(f"no such columns: {own}")
    rows = written(df.where(chosen), "compress")
    new, marks = merged_events(rows, keys)
    return df.where(~chosen).unionByName(rows.join(marks, same_keys(keys, "_k_"), "left_anti")).unionByName(new)


def merged_events(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(an event for each key of df with several rows, those keys as columns _k_<key>). df is read several times: a written table."""
    fixed = {"id", "type", "count", "attributes", "references", "history", "forwarded", "creation", "arrival", "description", "host", "status", "local"}
    others = [c for c in df.columns if c not in fixed | set(keys)]
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.min(F.struct("creation", "id")).alias("_first"),
        F.sum(effective_count()).cast("long").alias("_count"),
        same_or("description", F.lit("")).alias("_description"),
        *([] if "host" in keys else [same_or("host", F.lit(ENGINE_HOST)).alias("_host")]),
        same_or("status", F.lit("active")).alias("_status"),
        same_or("local", F.lit(False)).alias("_local"),
        F.min("creation").alias("_creation"),
        F.min("arrival").alias("_arrival"),
        *[F.when(F.min(F.struct(c)).eqNullSafe(F.max(F.struct(c))), F.min(F.struct(c))[c]).alias(f"_o_{c}") for c in others],
    )
    several = grouped.where("_rows > 1")
    marks = several.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    many = df.join(marks, same_keys(keys, "_k_"), "left_semi")
    name = lambda c: [F.col(k).alias(f"{c}{k}") for k in keys]
    pairs = merged_attributes(many, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("_attributes"))
    refs = merged_references(many, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("reftype", "refs"))).alias("_references"))
    made = several.join(pairs.select(*name("_a_"), "_attributes"), same_keys(keys, "_a_"), "left").join(refs.select(*name("_r_"), "_references"), same_keys(keys, "_r_"), "left")
    columns = {
        "id": event_id(F.lit("compress"), *[F.col(k).cast("string") for k in keys], F.col("_arrival").cast("string")),
        "type": F.lit("compressed"),
        "count": F.col("_count"),
        "creation": F.col("_creation"),
        "arrival": F.col("_arrival"),
        "description": F.col("_description"),
        "host": F.col("host" if "host" in keys else "_host"),
        "status": F.col("_status"),
        "local": F.col("_local"),
        "forwarded": F.lit(False),
        "attributes": F.coalesce("_attributes", F.create_map().cast("map<string,string>")),
        "references": F.coalesce("_references", F.create_map().cast("map<string,array<string>>")),
        "history": F.array().cast(HISTORY),
    }
    return made.select(*[(F.col(c) if c in keys else columns.get(c, F.col(f"_o_{c}"))).alias(c) for c in df.columns]), marks


def merged_attributes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, attribute, value) over whatever attributes there are: the value that all events that have it share, or the mark of
    several. The map is exploded, and each (key, attribute) aggregated map-side."""
    pairs = df.select(*keys, F.explode("attributes").alias("attribute", "_value"))
    agree = F.min("_value") == F.max("_value")
    return pairs.groupBy(*keys, "attribute").agg(F.when(agree, F.min("_value")).otherwise(F.lit(MULTIPLE)).alias("value"))


def aggregate(triggers: DataFrame, events: DataFrame, keys: Sequence[str], age: int, name: str) -> DataFrame:
    """For each firing trigger one aggregated event with the events that its query sees as children, at the trigger's time."""
    seen = select_events(triggers, events, keys, age)
    grouped = seen.groupBy("trigger_id", "trigger_time").agg(F.array_sort(F.collect_set("id")).alias("children"))
    return grouped.select(
        event_id(F.lit(name), F.col("trigger_id")).alias("id"),
        F.lit(name).alias("name"),
        F.lit(ENGINE_HOST).alias("host"),
        F.lit("aggregated").alias("type"),
        F.lit("active").alias("status"),
        F.col("trigger_time").alias("creation"),
        F.col("trigger_time").alias("arrival"),
        "trigger_id",
        F.create_map(F.lit("child"), F.col("children")).alias("references"),
    )


def parents_of(made: DataFrame) -> DataFrame:
    """From events with child references, rows (id, parents): what is written back to the children."""
    pairs = made.select(F.col("id").alias("parent"), F.explode(F.try_element_at("references", F.lit("child"))).alias("id"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def add_references(df: DataFrame, found: DataFrame, reftype: str, group: str, rule: str) -> DataFrame:
    """df with the ids of found (id, refs) added to its references of that type, without duplicates, and a history entry where one was
    added. df has references and history."""
    rows = df.join(found.select("id", F.col("refs").alias("_refs")), "id", "left")
    old = F.coalesce(F.try_element_at("references", F.lit(reftype)), F.array().cast("array<string>"))
    new = F.array_union(old, F.coalesce("_refs", F.array().cast("array<string>")))
    rows = rows.withColumn("_added", F.size(new) > F.size(F.array_distinct(old)))
    changed = F.map_concat(F.map_filter("references", lambda k, _: k != reftype), F.create_map(F.lit(reftype), new))
    rows = rows.withColumn("history", noted(F.col("_added"), entry(group, rule, F.col("arrival"), ["references"])))
    return rows.withColumn("references", F.when(F.col("_added"), changed).otherwise(F.col("references"))).drop("_refs", "_added")


def suppress(df: DataFrame, found: DataFrame, group: str, rule: str, reason: str = "") -> DataFrame:
    """Active events of found (id, parents) become inactive and get the responsible events as parents."""
    hit = found.select("id", F.col("parents").alias("refs"))
    active = df.where(F.col("status") == "active").select("id")
    hit = hit.join(active, "id", "left_semi")
    out = add_references(df, hit, "parent", group, rule)
    marked = out.join(hit.select("id", F.lit(True).alias("_hit")), "id", "left")
    return modify(marked, F.coalesce("_hit", F.lit(False)), group, rule, status="inactive", reason=reason).drop("_hit")


def create(firing: DataFrame, name: Column | str, attributes: dict[str, Column], description: Column | str = "-") -> DataFrame:
    """One synthetic event per firing trigger, at its time, on the engine's host."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return firing.select(
        event_id(text(name), F.col("id"), F.lit("create")).alias("id"),
        text(name).alias("name"),
        F.lit(ENGINE_HOST).alias("host"),
        text(description).alias("description"),
        F.lit("synthetic").alias("type"),
        F.lit("active").alias("status"),
        F.col("arrival").alias("creation"),
        F.col("arrival").alias("arrival"),
        F.create_map(*[x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]).alias("attributes"),
        F.create_map(F.lit("cross"), F.array("id")).alias("references"),
    )


def unique_by(df: DataFrame, field: Column, time: str = "creation", keep: str = "first", id_col: str = "id") -> DataFrame:
    """One row per value of the field (absent: the empty text): the first or last by time, then id. Partial aggregation, no sort."""
    if keep not in ("first", "last"):
        raise ValueError("keep: first or last")
    pick = F.min_by if keep == "first" else F.max_by
    value = F.coalesce(field, F.lit(""))
    return df.groupBy(value.alias("_value")).agg(pick(F.struct(*df.columns), F.struct(time, id_col)).alias("_row")).select("_row.*")


def first_of(df: DataFrame, time: str = "creation", id_col: str = "id") -> DataFrame:
    """The row with the smallest time, then id; no row if there is none."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(time, id_col)).alias("_row")).where("_row is not null").select("_row.*")


def last_of(df: DataFrame, time: str = "creation", id_col: str = "id") -> DataFrame:
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(time, id_col)).alias("_row")).where("_row is not null").select("_row.*")


def dedupe(df: DataFrame, id_col: str = "id", time: str = "arrival") -> DataFrame:
    """One row per id: the one that arrived first."""
    return df.groupBy(id_col).agg(F.min_by(F.struct(*[c for c in df.columns if c != id_col]), F.struct(time, *[c for c in ("name", "host") if c in df.columns])).alias("_row")).select(id_col, "_row.*")
