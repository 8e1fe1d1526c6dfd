"""Rules as plans: ordered stages over one event table.

A rule's condition looks at the table that the rules before it have left; its actions make the next rule's table. A query of an action
looks at the table as the rule's earlier actions left it. Stages run in the order of group and rule. A row that an earlier rule dropped,
compressed or made inactive triggers no later rule, nor does one that was inactive from the start; queries see it all the same, unless it
was dropped or compressed.

Rules that only change the rows that trigger them are columns of one plan, and no table is written for them. Before the first rule whose
actions look for other events or add some, the events are written once; after each such rule one table of changes is written: of each row
that any rule has touched the fields that rules may change, and all of each row that rules have added. The next rule's table is the
events joined with these changes, so a plan of many rules reads two tables, however many came before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.schema import HISTORY, STATUSES, TYPES
from eventweir.sources.scratch import sized, written

#: Types that trigger a rule that names none.
DEFAULT_TYPES = ("raw", "compressed")

#: Fields of an event that no action changes.
FIXED = ("id", "name", "host", "description", "type", "count", "creation", "arrival")
#: What a plan notes of a row: touched by a rule, compressed away, added by a rule.
MARKS = ("_touched", "_gone", "_added")

Action = Callable[[DataFrame, Column], DataFrame]


def selecting(action: Action) -> Action:
    """Marks an action that looks for other events or adds some."""
    action.selects = True
    return action


class Stages:
    """A plan's table between rules: the events as written once, and one written table of changes."""

    def __init__(self, df: DataFrame):
        self.base = written(df.withColumn("_row", F.monotonically_increasing_id()), "plan-events")
        self.changes: DataFrame | None = None

    def view(self) -> DataFrame:
        if self.changes is None:
            return self.base
        kept = [c for c in self.changes.columns if c in FIXED]
        own = [c for c in self.changes.columns if c not in (*kept, "_row")]
        old = self.changes.where("not _added").select(F.col("_row").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in own])
        rows = self.base.join(sized(old), F.col("_row") == F.col("_at"), "left")
        hit, before = F.col("_at").isNotNull(), set(self.base.columns)
        now = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in before else F.col(f"_new_{c}") for c in own}
        rows = rows.select("_row", *kept, *[x.alias(c) for c, x in now.items()])
        return rows.unionByName(self.changes.where("_added")).where("not _gone")

    def cut(self, df: DataFrame) -> DataFrame:
        """The table after a rule, from what its actions made of the one before."""
        kept = [c for c in FIXED if c in df.columns]
        own = [c for c in df.columns if c not in (*kept, "_row")]
        rows = df.where("_touched or _added").where("not (_added and _gone)")
        rows = rows.select("_row", *own, *[F.when(F.col("_added"), F.col(c)).alias(c) for c in kept])
        if self.changes is not None:  # the view no longer has what went before
            rows = rows.unionByName(self.changes.where("_gone"), allowMissingColumns=True)
        self.changes = written(rows, "plan-changes")
        return self.view()


@dataclass(frozen=True)
class Trigger:
    """kind any, class or event; value: the class or name; types: those of its events ("any" for all)."""

    kind: str
    value: str | None = None
    types: Sequence[str] = DEFAULT_TYPES

    def __post_init__(self):
        if self.kind not in ("any", "class", "event") or (self.kind == "any") != (self.value is None):
            raise ValueError(f"not a trigger: {self.kind} {self.value}")
        if unknown := set(self.types) - {*TYPES, "any"}:
            raise ValueError(f"unknown types: {sorted(unknown)}")

    def matches(self, classes: dict[str, Sequence[str]]) -> Column:
        """classes: names by class."""
        kind = F.lit(True) if "any" in self.types else F.col("type").isin(*self.types)
        if self.kind == "any":
            return kind
        names = [self.value] if self.kind == "event" else list(classes.get(self.value, ()))
        return kind & (F.col("name").isin(*names) if names else F.lit(False))


@dataclass(frozen=True)
class Rule:
    """If its condition holds for a triggering row, its actions apply to that row, else its alternative actions.

    condition: a function from the stage's table to (table with helper columns, condition), or a Column. An action is a function of the
    table and a condition, and returns the table; it may add rows. creates and listens name the events of injected rows, to refuse rules
    that would trigger themselves.
    """

    group: str
    name: str
    triggers: Sequence[Trigger]
    condition: Column | Callable[[DataFrame], tuple[DataFrame, Column]] | None = None
    actions: Sequence[Action] = ()
    otherwise: Sequence[Action] = ()
    group_order: int = 0
    order: int = 0
    creates: Sequence[str] = ()

    def __post_init__(self):
        listens = {t.value for t in self.triggers if t.kind == "event"}
        if loop := listens & set(self.creates):
            raise ValueError(f"rule {self.name} triggers itself by {sorted(loop)}")


@dataclass
class Plan:
    rules: Sequence[Rule]
    classes: dict[str, Sequence[str]] = field(default_factory=dict)

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: (r.group_order, r.order))

    def run(self, events: DataFrame) -> DataFrame:
        """The table after all rules, with live (whether later rules would still be triggered) and one boolean column fired_<n> per
        rule (null: not triggered). Dropped rows are there, with dropped set; see remaining()."""
        df = events.withColumns({"live": F.col("status") == "active", "dropped": F.lit(False)} | {c: F.lit(False) for c in MARKS})
        stages: Stages | None = None
        for n, rule in enumerate(self.ordered()):
            selects = any(getattr(a, "selects", False) for a in (*rule.actions, *rule.otherwise))
            if selects and stages is None:
                stages = Stages(df)
                df = stages.view()
            before = df.columns
            condition = F.lit(True) if rule.condition is None else rule.condition
            if callable(condition) and not isinstance(condition, Column):
                df, condition = condition(df)
            triggered = F.col("live") & reduce(lambda a, b: a | b, [t.matches(self.classes) for t in rule.triggers], F.lit(False))
            fired = f"fired_{n}"
            df = df.withColumn(fired, F.when(triggered, F.coalesce(condition, F.lit(False))))
            df = df.select(*before, fired).withColumn("_touched", F.col("_touched") | F.col(fired).isNotNull())
            for chosen, actions in ((F.col(fired), rule.actions), (~F.col(fired), rule.otherwise)):
                for action in actions:
                    df = action(df, F.coalesce(chosen, F.lit(False)))
            df = df.withColumn("live", F.col("live") & (F.col("status") == "active") & ~F.col("dropped"))
            if selects:
                df = stages.cut(df)
        fired = [c for c in df.columns if c.startswith("fired_")]
        return df.where("not _gone").select(*events.columns, "live", "dropped", *fired)

    def remaining(self, events: DataFrame) -> DataFrame:
        return self.run(events).where(~F.col("dropped")).select(*events.columns)

    def firings(self, events: DataFrame) -> DataFrame:
        """Rows (id, group, rule, condition) for every rule that a row triggered."""
        df, rules = self.run(events), self.ordered()
        told = F.array(*[F.struct(F.lit(r.group).alias("group"), F.lit(r.name).alias("rule"), F.col(f"fired_{n}").alias("condition")) for n, r in enumerate(rules)])
        rows = df.select("id", F.explode(F.filter(told, lambda x: x["condition"].isNotNull())).alias("r"))
        return rows.select("id", "r.group", "r.rule", "r.condition")

    def triggers(self, spark) -> DataFrame:
        """The rules' triggers as a table, for operators.joins.route()."""
        rows = [(r.group, r.group_order, r.name, r.order, t.kind, t.value, kind) for r in self.ordered() for t in r.triggers for kind in (["any"] if "any" in t.types else t.types)]
        return spark.createDataFrame(rows, "group string, group_order int, rule string, rule_order int, kind string, value string, event_type string")

    def class_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, n) for c, names in self.classes.items() for n in names], "class string, name string")


def drop(df: DataFrame, where: Column) -> DataFrame:
    return df.withColumn("dropped", F.col("dropped") | where)


def set_status(status: str) -> Action:
    if status not in STATUSES:
        raise ValueError(f"not a status: {status}")
    return lambda df, where: df.withColumn("status", F.when(where, F.lit(status)).otherwise(F.col("status")))


def set_attribute(name: str, value: Column | str) -> Action:
    from eventweir.functions import scalar

    return lambda df, where: df.withColumn("attributes", scalar.set_attribute(name, value if isinstance(value, Column) else F.lit(value), where))


def when(condition: Column, actions: Sequence[Action], otherwise: Sequence[Action] = ()) -> Action:
    """A nested block: the actions where the condition holds too, the alternative ones where it does not."""

    def act(df: DataFrame, where: Column) -> DataFrame:
        own, test = (f"_{what}{len(df.columns)}" for what in ("where", "if"))  # blocks nest
        df = df.withColumn(own, where).withColumn(test, F.coalesce(condition, F.lit(False)))
        for chosen, some in ((F.col(own) & F.col(test), actions), (F.col(own) & ~F.col(test), otherwise)):
            for action in some:
                df = action(df, F.coalesce(chosen, F.lit(False)))
        return df.drop(own, test)

    return selecting(act) if any(getattr(a, "selects", False) for a in (*actions, *otherwise)) else act


def there(df: DataFrame) -> Column:
    """Rows that queries see: not dropped, nor compressed away."""
    return ~F.col("dropped") & ~F.col("_gone")


def _seen(df: DataFrame, where: Column, query: Column, keys: Sequence[str], age: int) -> DataFrame:
    """Rows (id, name, arrival, keys, _due): the events that the queries of firing rows see (those of its key, at most `age` old at its
    time), with the time of the first firing that sees them. A frame forward in time, so a firing is not paired with its events."""
    from eventweir.operators.frames import Frames

    own = list(dict.fromkeys(["id", "name", "arrival", *keys]))
    marked = df.select(*own, F.when(where & ~F.col("_gone"), F.col("arrival")).alias("_fires"), F.coalesce(query & there(df), F.lit(False)).alias("_wanted"))
    marked = marked.where(F.col("_wanted") | F.col("_fires").isNotNull()).withColumn("_turned", -F.col("arrival"))
    f = Frames(marked, keys, "_turned", age)
    rows = f.close(f.rows.withColumn("_due", F.min("_fires").over(f.frame())))
    return rows.where("_wanted and _due is not null").select(*own, "_due")


def on_selected(query: Column, keys: Sequence[str], age: int, actions: Sequence[Action]) -> Action:
    """The actions on the events that the query of each firing row sees, each event once."""

    def act(df: DataFrame, where: Column) -> DataFrame:
        own = f"_selected{len(df.columns)}"  # blocks nest
        seen = written(_seen(df, where, query, keys, age).select(F.col("id").alias("_seen"), F.lit(True).alias(own)).distinct(), "plan-seen")
        df = df.join(sized(seen), F.col("id") == F.col("_seen"), "left").drop("_seen").withColumn(own, F.coalesce(own, F.lit(False)))
        df = df.withColumn("_touched", F.col("_touched") | F.col(own))
        for action in actions:
            df = action(df, F.coalesce(F.col(own), F.lit(False)))
        return df.drop(own)

    return selecting(act)


def _with(df: DataFrame, made: DataFrame, live: bool) -> DataFrame:
    """df and the made events, which are written first: df stays a table that is read once."""
    given = {"local": F.lit(False), "forwarded": F.lit(False), "description": F.lit("-")}
    given |= {"attributes": F.create_map().cast("map<string,string>"), "references": F.create_map().cast("map<string,array<string>>"), "history": F.array().cast(HISTORY)}
    made = made.withColumns({k: v for k, v in given.items() if k in df.columns and k not in made.columns})
    made = written(made.select(*[c for c in made.columns if c in df.columns]), "plan-made")
    marks = {"dropped": F.lit(False), "live": F.lit(live), "_touched": F.lit(True), "_gone": F.lit(False), "_added": F.lit(True)}
    return df.unionByName(made.withColumns(marks), allowMissingColumns=True)


def _injected(df: DataFrame, made: DataFrame, inject: str) -> DataFrame:
    """df and the made events: as input they trigger later rules, as output they only leave."""
    if inject not in ("input", "output"):
        raise ValueError("inject: input or output")
    return _with(df, made, inject == "input")


def create_event(name: str, attributes: dict[str, Column] | None = None, description: Column | str = "-", inject: str = "input") -> Action:
    """A synthetic event for each firing row, at its time."""
    from eventweir.operators import actions

    return selecting(lambda df, where: _injected(df, actions.create(df.where(where), name, attributes or {}, description), inject))


def aggregate_selected(name: str, query: Column, keys: Sequence[str], age: int, inject: str = "input") -> Action:
    """An aggregated event for each firing row, its children the events that the query sees. These get it as a parent, if the events have
    references."""
    from eventweir.operators import actions

    def act(df: DataFrame, where: Column) -> DataFrame:
        made = written(actions.aggregate(df.where(where), df.where(query & there(df)), keys, age, name).drop("trigger_id"), "plan-aggregated")
        if "references" in df.columns:
            found = actions.parents_of(made).select(F.col("id").alias("_child"), F.col("parents").alias("_parents"))
            df = df.join(sized(written(found, "plan-parents")), F.col("id") == F.col("_child"), "left")
            old = F.coalesce(F.try_element_at("references", F.lit("parent")), F.array().cast("array<string>"))
            more = F.map_concat(F.map_filter("references", lambda k, _: k != "parent"), F.create_map(F.lit("parent"), F.array_union(old, F.col("_parents"))))
            hit = F.col("_child").isNotNull()
            df = df.withColumns({"references": F.when(hit, more).otherwise(F.col("references")), "_touched": F.col("_touched") | hit}).drop("_child", "_parents")
        return _injected(df, made, inject)

    return selecting(act)


def suppress_selected(query: Column, keys: Sequence[str], age: int) -> Action:
    """The events that the query sees become inactive. operators.actions.suppress() also notes who made them so."""
    return on_selected(query, keys, age, [set_status("inactive")])


def compress_selected(query: Column, keys: Sequence[str], age: int) -> Action:
    """Each firing compresses what its query then sees of each name into one event, and the next one sees that event in place of those it
    holds, at their earliest time; the old ones are gone. The new event triggers no rule, but queries see it.

    An event is first seen by the first firing at or after its arrival, if that comes within `age`. What a firing sees of earlier
    firings is one event at most per name, and it is seen as long as its earliest time is: so a group takes events whose first firing
    comes by its first event's arrival + age, and the next event begins a group. That is an anchored window whose rows are due at their first
    firing, so the groups of a key with many events are not one task's work.
    """
    from eventweir.operators import actions, contexts

    def act(df: DataFrame, where: Column) -> DataFrame:
        by = ["name", *[k for k in keys if k != "name"]]
        rows = written(_seen(df, where, query & actions.compressible(), keys, age), "plan-seen")
        groups = contexts.anchored(rows, by, age, due="_due").select(F.col("id").alias("_seen"), F.col("win_start").alias("_group"))
        plain = [c for c in df.columns if not c.startswith(("_", "fired_")) and c not in ("live", "dropped")]
        full = df.select(*plain).join(groups, F.col("id") == F.col("_seen")).drop("_seen")
        more = {"references": F.create_map().cast("map<string,array<string>>"), "attributes": F.create_map().cast("map<string,string>"), "history": F.array().cast(HISTORY)}
        full = written(full.withColumns({c: x for c, x in more.items() if c not in plain}), "plan-members")
        made, marks = actions.merged_events(full, [*by, "_group"])
        gone = written(full.join(marks, actions.same_keys([*by, "_group"], "_k_"), "left_semi").select(F.col("id").alias("_seen")), "plan-gone")
        df = df.join(sized(gone.withColumn("_hit", F.lit(True))), F.col("id") == F.col("_seen"), "left")
        hit = F.coalesce("_hit", F.lit(False))
        df = df.withColumns({"_gone": F.col("_gone") | hit, "_touched": F.col("_touched") | hit}).drop("_seen", "_hit")
        return _with(df, made.drop("_group"), False)

    return selecting(act)


class Plugins:
    """Conditions and actions by name. A condition is made from its parameters when the plan is built, so bad ones fail there."""

    def __init__(self) -> None:
        self.conditions: dict[str, Callable[..., Callable[[DataFrame], tuple[DataFrame, Column]]]] = {}
        self.actions: dict[str, Callable[..., Action]] = {}

    def condition(self, name: str, **parameters):
        return self._find(self.conditions, name)(**parameters)

    def action(self, name: str, **parameters) -> Action:
        return self._find(self.actions, name)(**parameters)

    @staticmethod
    def _find(kind: dict, name: str):
        if name not in kind:
            raise KeyError(f"no plugin {name}; there are {sorted(kind)}")
        return kind[name]


def weekday(days: Sequence[str | int], time: str = "arrival"):
    """Condition plugin: the row's time falls on one of the days."""
    from eventweir.functions.scalar import weekday_in

    test = weekday_in(F.col(time), list(days))
    return lambda df: (df, test)


def enrich(source: str, pattern: str, target: str) -> Action:
    """Action plugin: attribute target from the first group of the pattern in attribute source."""
    from eventweir.functions import scalar
    from eventweir.functions.predicates import attribute

    def act(df: DataFrame, where: Column) -> DataFrame:
        own = attribute(source)
        hit = where & F.coalesce(own.rlike(pattern), F.lit(False))
        return df.withColumn("attributes", scalar.set_attribute(target, F.regexp_extract(own, pattern, 1), hit))

    return act


def opaque(test: Callable, columns: Sequence[str]):
    """Condition plugin around a Python function that gets a pandas Series per column and returns a boolean Series (Arrow batches)."""
    import pandas as pd

    def judge(*series: pd.Series) -> pd.Series:
        return test(*series).astype(bool)

    judge.__annotations__ = {"series": pd.Series, "return": pd.Series}
    made = F.pandas_udf(judge, "boolean")
    return lambda df: (df, made(*[F.col(c) for c in columns]))


def over_queries(test: Callable, queries: Sequence[Column], keys: Sequence[str], age: int, fields: Sequence[str] = ("id", "name", "host", "creation", "arrival")):
    """Condition plugin around a Python function of the triggering rows and of what each query sees: it gets a pandas DataFrame of the
    rows' fields and, for each query, a Series whose values are lists of events (dicts of the fields), and returns a boolean Series."""
    import pandas as pd

    from eventweir.operators.conditions import Seen

    def judge(*series: pd.Series) -> pd.Series:
        return test(pd.DataFrame(dict(zip(fields, series[: len(fields)], strict=True))), *series[len(fields) :]).astype(bool)

    judge.__annotations__ = {"series": pd.Series, "return": pd.Series}
    made = F.pandas_udf(judge, "boolean")

    def condition(df: DataFrame) -> tuple[DataFrame, Column]:
        seen = Seen(df, keys, age)
        names = [f"_query{k}" for k in range(len(queries))]
        for name, query in zip(names, queries, strict=True):
            seen.collect(F.when(query, F.struct(*fields)), name)
        seen.helpers.clear()  # the plan drops them after the condition
        return seen.close(), made(*[F.col(f) for f in fields], *[F.col(n) for n in names])

    return condition


def default_plugins() -> Plugins:
    found = Plugins()
    found.conditions |= {"weekday": weekday, "opaque": opaque, "over_queries": over_queries}
    found.actions |= {"enrich_regexp": enrich, "set_status": set_status}
    return found
