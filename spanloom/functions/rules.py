"""Facts, rules and filters: bags of typed attributes, Boolean trees over them as Columns, chains of filters.

A fact is a row (id, attributes), attributes an array of structs (name, type, bool, int, double, string, date). Rules
look at any attribute of a name and type. Everything is built-in higher-order functions, so plans stay in the JVM.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTE = "struct<name:string,type:string,bool:boolean,int:bigint,double:double,string:string,date:date>"
_KINDS = {"bool": "boolean", "int": "bigint", "double": "double", "string": "string", "date": "date"}


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "bool"
    for t, k in ((int, "int"), (float, "double"), (str, "string"), (dt.date, "date")):
        if isinstance(value, t):
            return k
    raise TypeError(f"no attribute type for {value!r}")


def attribute(name: str, value, kind: str | None = None) -> Column:
    """One attribute from a constant, or from a Column of a given kind."""
    kind = kind or kind_of(value)
    v = value if isinstance(value, Column) else F.lit(value)
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), *[(v if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _KINDS.items()])


def attributes(**values) -> Column:
    """An array of attributes; lists make several of one name, (Column, kind) pairs make attributes of columns, nulls none."""
    out = []
    for name, v in values.items():
        for x in v if isinstance(v, list) else [v]:
            out.append(F.when(x[0].isNotNull(), attribute(name, *x)) if isinstance(x, tuple) else attribute(name, x))
    return F.filter(F.array(*out), lambda a: a.isNotNull())


def facts_from(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """Rows as facts: columns by name with their attribute kinds."""
    return df.select(F.col(id_col).cast("string").alias("id"), attributes(**{c: (F.col(c), k) for c, k in columns.items()}).alias("attributes"))


def facts_to(facts: DataFrame, **columns: str) -> DataFrame:
    """Facts as rows: the one value of each name; more than one is an error, none is null."""

    def one(name: str, kind: str) -> Column:
        hit = F.filter("attributes", lambda a: (a["name"] == name) & (a["type"] == kind))
        return F.when(F.size(hit) > 1, F.raise_error(F.lit(f"more than one {name}"))).otherwise(F.get(hit, 0)[kind]).alias(name)

    return facts.select("id", *[one(n, k) for n, k in columns.items()])


class Rule:
    """A test of attributes (an array Column); combine by &, | and ~."""

    def __init__(self, test: Callable[[Column], Column]):
        self.test = test

    def __call__(self, attrs: Column | str = "attributes") -> Column:
        return self.test(F.col(attrs) if isinstance(attrs, str) else attrs)

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda a: self.test(a) & other.test(a))

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda a: self.test(a) | other.test(a))

    def __invert__(self) -> Rule:
        return Rule(lambda a: ~self.test(a))


ANYTHING = Rule(lambda a: F.lit(True))


class Own:
    """A value to compare with that comes from the fact itself: an attribute of a name and kind (the first, if it has several), changed by a function of Columns. A fact without it passes no comparison."""

    def __init__(self, name: str, kind: str, change: Callable[[Column], Column] = lambda v: v):
        self.name, self.kind, self.change = name, kind, change

    def of(self, attrs: Column) -> Column:
        return self.change(F.get(F.filter(attrs, lambda x: (x["name"] == self.name) & (x["type"] == self.kind)), F.lit(0))[self.kind])


def _match(name: str, value, compare: Callable[[Column, Column], Column], kinds: tuple[str, ...]) -> Rule:
    kind = value.kind if isinstance(value, Own) else kind_of(value)
    if kind not in kinds:
        raise TypeError(f"{kind} attributes can't be compared that way")
    to = value.of if isinstance(value, Own) else lambda a: F.lit(value)
    return Rule(lambda a: F.exists(a, lambda x: (x["name"] == name) & (x["type"] == kind) & F.coalesce(compare(x[kind], to(a)), F.lit(False))))


def equals(name: str, value) -> Rule:
    return _match(name, value, lambda x, y: x == y, tuple(_KINDS))


def greater(name: str, value) -> Rule:
    return _match(name, value, lambda x, y: x > y, ("int", "double", "string", "date"))


def less(name: str, value) -> Rule:
    return _match(name, value, lambda x, y: x < y, ("int", "double", "string", "date"))


def contains(name: str, value: str) -> Rule:
    return _match(name, value, lambda x, y: F.contains(x, y), ("string",))


def all_of(*rules: Rule) -> Rule:
    return reduce(lambda a, b: a & b, rules, ANYTHING)


def any_of(*rules: Rule) -> Rule:
    return reduce(lambda a, b: a | b, rules) if rules else ~ANYTHING


# --- attributes of facts ---
def add(attrs: Column, more: Column) -> Column:
    return F.array_union(attrs, more)


def drop(attrs: Column, gone: Column) -> Column:
    return F.array_except(attrs, gone)


def merge(mine: Column, theirs: Column, style: str = "keeping_all") -> Column:
    """keeping_all: both; when_absent: theirs only for names that mine lacks; as_replacement: theirs instead of mine's of their names."""
    names = lambda a: F.transform(a, lambda x: x["name"])
    lacking = lambda a, b: F.filter(a, lambda x: ~F.array_contains(names(b), x["name"]))
    if style == "keeping_all":
        return F.array_union(mine, theirs)
    if style == "when_absent":
        return F.array_union(mine, lacking(theirs, mine))
    if style == "as_replacement":
        return F.array_union(lacking(mine, theirs), theirs)
    raise ValueError(style)


def merge_all(these: DataFrame, those: DataFrame, style: str = "keeping_all") -> DataFrame:
    """Facts of both sides, those of equal ids merged."""
    b = those.select("id", F.col("attributes").alias("_b"))
    both = these.join(b, "id", "full_outer")
    none = F.array().cast(f"array<{ATTRIBUTE}>")
    return both.select("id", merge(F.coalesce("attributes", none), F.coalesce("_b", none), style).alias("attributes"))


# --- filters: functions from facts to facts ---
Filter = Callable[[DataFrame], DataFrame]


def select(rule: Rule) -> Filter:
    return lambda f: f.filter(rule())


def _changed(change: Callable[[Column], Column]) -> Filter:
    """Attributes are named once, as the variable of a function: else each step of a chain would repeat all steps before it, wherever filters are pushed down."""
    return lambda f: f.withColumn("attributes", F.get(F.transform(F.array("attributes"), change), F.lit(0)))


def augment(rule: Rule, more: Column, style: str = "keeping_all") -> Filter:
    return _changed(lambda a: F.when(rule(a), merge(a, more, style)).otherwise(a))


def redact(rule: Rule, names: list[str]) -> Filter:
    return _changed(lambda a: F.when(rule(a), F.filter(a, lambda x: ~x["name"].isin(names))).otherwise(a))


def exclude(ids: list[str]) -> Filter:
    return lambda f: f.filter(~F.col("id").isin(ids))


def either(*filters: Filter, style: str = "keeping_all") -> Filter:
    """What any of the filters lets through, merged."""
    return lambda f: reduce(lambda a, b: merge_all(a, b, style), [g(f) for g in filters])


def chain(*filters: Filter) -> Filter:
    return lambda f: reduce(lambda a, g: g(a), filters, f)


# --- facts over time ---
def progress(facts: DataFrame, recorded: str) -> DataFrame:
    """(id, name, value, at): each attribute of facts as text with the day that the fact was recorded on (its date attribute of that name, which is no row itself). Facts without that day are left out."""
    at = F.get(F.filter("attributes", lambda x: (x["name"] == recorded) & (x["type"] == "date")), 0)["date"]
    each = facts.select("id", at.alias("at"), F.explode("attributes").alias("a")).filter((F.col("a.name") != recorded) & F.col("at").isNotNull())
    text = F.coalesce(*[F.col(f"a.{k}").cast("string") for k in _KINDS])
    return each.select("id", F.col("a.name").alias("name"), text.alias("value"), "at")
