"""Joins of events with events, rules, classes and contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.schema import TYPES
from eventweir.sources.scratch import sized, written


def select_events(triggers: DataFrame, events: DataFrame, keys: Sequence[str], age: int, time_source: str = "arrival", skew: int = 0, id_col: str = "id") -> DataFrame:
    """Rows (trigger_id, trigger_time, then the columns of events): for each trigger the events of its key that its query sees.

    Seen are events that arrived by the trigger's time, with time_source + age not before it. Both sides are cut into buckets of
    max(age, 1) seconds: an event of bucket b can only be seen from b and the next one, so a trigger is joined with two buckets by
    equality, and the exact bounds are checked after. skew: with time_source creation, by how much creation may lie after arrival. A null
    key is a key.
    """
    width = max(age + (skew if time_source == "creation" else 0), 1)
    t = triggers.select(F.col(id_col).alias("trigger_id"), F.col("arrival").alias("trigger_time"), *[F.col(k).alias(f"_t_{k}") for k in keys])
    t = t.withColumn("_at", F.floor(F.col("trigger_time") / width)).select("*", F.explode(F.array(F.col("_at"), F.col("_at") - 1)).alias("_bucket")).drop("_at")
    e = events.withColumn("_e_bucket", F.floor(F.col("arrival") / width))
    same = F.col("_bucket") == F.col("_e_bucket")
    for k in keys:
        same = same & F.col(f"_t_{k}").eqNullSafe(F.col(k))
    seen = (F.col("arrival") <= F.col("trigger_time")) & (F.col(time_source) + age >= F.col("trigger_time"))
    return t.join(e, same & seen).drop("_bucket", "_e_bucket", *[f"_t_{k}" for k in keys])


def route(events: DataFrame, triggers: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, group, group_order, rule, rule_order): which rules each event triggers, each once.

    triggers: rows (group, group_order, rule, rule_order, kind, value, event_type) with kind any, class or event; event_type any
    takes every type. The rules are turned into one row per event name; only names that rules list are joined.
    """
    kinds = lambda k: triggers.where(F.col("kind") == k)
    by_name = kinds("event").withColumnRenamed("value", "name").unionByName(kinds("class").join(classes.withColumnRenamed("class", "value"), "value").drop("value"))
    rule = ["group", "group_order", "rule", "rule_order"]
    of = events.select("id", "name", "type")
    fits = (F.col("event_type") == "any") | (F.col("event_type") == F.col("type"))
    named = of.join(sized(by_name.drop("kind").distinct()), "name").where(fits).select("id", *rule)
    # rules for any name meet a type's events by equality: those for any type are listed under every type, null standing for unknown ones
    of_types, any_rules = F.array(*[F.lit(t) for t in TYPES], F.lit(None)), kinds("any").drop("kind", "value")
    any_rules = any_rules.withColumn("_type", F.explode(F.when(F.col("event_type") == "any", of_types).otherwise(F.array("event_type")))).drop("event_type")
    known = of.select("id", F.when(F.col("type").isin(*TYPES), F.col("type")).alias("type"))
    every = known.join(sized(any_rules.distinct()), F.col("type").eqNullSafe(F.col("_type"))).select("id", *rule)
    return named.unionByName(every).distinct()


def classes_of(names: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (name, classes): the sorted classes of each name of `names`, empty if it has none."""
    known = classes.groupBy("name").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return names.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def parents_found(children: DataFrame, responsible: DataFrame, keys: Sequence[str], age: int) -> DataFrame:
    """Rows (id, parents): for each child the sorted ids of the responsible events that its query sees."""
    pairs = select_events(children, responsible, keys, age).where(F.col("trigger_id") != F.col("id"))
    return pairs.groupBy(F.col("trigger_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("parents"))


def edges(events: DataFrame) -> DataFrame:
    """Rows (id, reftype, ref_id) of the references map."""
    listed = events.select("id", F.explode("references").alias("reftype", "refs"))
    return listed.select("id", "reftype", F.explode("refs").alias("ref_id")).distinct()


def depths(edges: DataFrame, limit: int = 32) -> DataFrame:
    """Rows (id, depth, root) of a forest given as rows (id, ref_id = parent): roots have depth 0. Each round every row's pointer jumps
    to its target's pointer, so a chain of length n needs log n joins; an id with several parents goes below the smallest."""
    links = edges.groupBy("id").agg(F.min("ref_id").alias("up"))
    nodes = links.select("id").union(edges.select("ref_id")).distinct()
    state = nodes.join(links, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"))
    rounds, state = 0, written(state, "depths")
    while True:
        target = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumped = state.join(target, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_up") != F.col("up")).alias("moved"))
        rounds += 1
        if rounds > limit:
            raise ValueError("the references form a cycle")
        jumped = written(jumped, "depths")
        if not jumped.where("moved").limit(1).count():
            return jumped.select("id", "depth", F.col("up").alias("root"))
        state = jumped.drop("moved")  # a written table


def by_ids(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """The events whose id is among wanted.id."""
    return events.join(wanted.select("id").distinct(), "id", "left_semi")


def not_among(events: DataFrame, others: DataFrame) -> DataFrame:
    return events.join(others.select("id"), "id", "left_anti")


def has_context(group: str, name: Column | str, contexts: str) -> Column:
    """Whether the array column of (group, name) structs holds the context."""
    wanted = name if isinstance(name, Column) else F.lit(name)
    return F.exists(contexts, lambda c: (c["group"] == group) & (c["name"] == wanted))
