"""Predicates on events as Columns that are never null, boolean combinations, fields and templates.

A predicate that needs the trigger's fields takes its value from a column of the joined or windowed row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = r"^[0-9]+$"


def sure(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def value(v: Column | str | int | bool) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(name))


def event_name(name: Column | str) -> Column:
    return sure(F.col("name") == value(name))


def event_type(kind: Column | str) -> Column:
    return sure(F.col("type") == value(kind))


def event_status(status: Column | str) -> Column:
    return sure(F.col("status") == value(status))


def event_host(host: Column | str) -> Column:
    return sure(F.col("host") == value(host))


def number(c: Column) -> Column:
    """The number that a text of digits only stands for; null for any other (signs and decimals included)."""
    return F.when(c.rlike(DIGITS), c.try_cast("decimal(38,0)"))


def event_attribute(name: str, than: Column | str, op: str = "eq") -> Column:
    """eq compares texts; ge and le compare numbers and are false unless both sides are digits only; re searches a pattern."""
    own = attribute(name)
    if op == "re":
        return sure(own.rlike(than))
    than = value(than).cast("string")
    if op not in ("eq", "ge", "le"):
        raise ValueError(f"op: eq, ge, le or re, not {op}")
    return sure({"eq": own == than, "ge": number(own) >= number(than), "le": number(own) <= number(than)}[op])


def event_min_age(age: int) -> Column:
    return sure(F.col("arrival") - F.col("creation") >= age)


def event_max_age(age: int | None, now: Column, time_source: str = "arrival") -> Column:
    """Visible at `now`: arrived by then, and not older than age by its time source. Without an age, all that arrived."""
    seen = F.col("arrival") <= now
    return sure(seen if age is None else seen & (F.col(time_source) + age >= now))


def in_class(df: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Rows of df whose name is in the class. classes: rows (class, name)."""
    return df.join(classes.where(F.col("class") == name).select("name").distinct(), "name", "left_semi")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    """At least one; true if there are none to choose from."""
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def possible(condition: Column) -> Column:
    """Not certainly false: a condition that is null (unknown) counts as true."""
    return F.coalesce(condition, F.lit(True))


def field(path: str) -> Column:
    """A field of the event, or attributes.x; the empty text if it is absent."""
    own = attribute(path.removeprefix("attributes.")) if path.startswith("attributes.") else F.col(path)
    return F.coalesce(own.cast("string"), F.lit(""))


def template(*parts: Column | str) -> Column:
    """Texts and columns put together, without white space at the ends."""
    return F.trim(F.concat(*[F.coalesce(value(p).cast("string"), F.lit("")) for p in parts]))


class NamedQueries:
    """Reusable predicates by (group, name). A definition may use others; cycles are refused when it is resolved."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Callable[[NamedQueries], Column]] = {}
        self._open: list[tuple[str, str]] = []

    def define(self, group: str, name: str, make: Callable[[NamedQueries], Column]) -> None:
        self._made[group, name] = make

    def __call__(self, group: str, name: str) -> Column:
        key = (group, name)
        if key not in self._made:
            raise KeyError(f"no query {name} in group {group}")
        if key in self._open:
            raise ValueError(f"query {name} of group {group} uses itself")
        self._open.append(key)
        try:
            return self._made[key](self)
        finally:
            self._open.pop()
