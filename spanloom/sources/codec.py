"""JSON in and out: boundaries, intervals, rows, whole frames, difference actions, versioned frames; folds over JSON paths.

A boundary is "Top", "Bottom", {"point": v} or {"open": v}; an interval {"start": [..], "end": [..]} with one boundary a
dimension; a row {"value": .., "interval": ..}; a frame an array of rows; an action {"action": "Create" | "Update",
"validData": row} or {"action": "Delete", "key": [..]}. Everything is made and read by Spark's expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import BOTTOM, TOP, Dim, Open, Span
from ..operators.frame import IntervalFrame


def boundary_json(d: Dim, cut: Column, end: bool) -> Column:
    """A cut as JSON text of the boundary that it stands for."""
    if d.discrete:
        v, open_ = (d.pred(cut) if end else cut), F.lit(False)
    else:
        v, open_ = cut["v"], cut["side"] == (0 if end else 1)
    text = v.cast("string") if d.type in ("bigint", "double") else F.concat(F.lit('"'), v.cast("string"), F.lit('"'))
    closed = F.when(open_, F.concat(F.lit('{"open":'), text, F.lit("}"))).otherwise(F.concat(F.lit('{"point":'), text, F.lit("}")))
    return F.when(d.is_first(cut), F.lit('"Bottom"')).when(d.is_last(cut), F.lit('"Top"')).otherwise(closed)


def interval_json(frame: IntervalFrame) -> Column:
    side = lambda end: F.concat(F.lit("["), F.concat_ws(",", *[boundary_json(d, F.col(d.hi if end else d.lo), end) for d in frame.dims]), F.lit("]"))
    return F.concat(F.lit('{"start":'), side(False), F.lit(',"end":'), side(True), F.lit("}"))


def value_json(frame: IntervalFrame) -> Column:
    """One value as its JSON, several as an object."""
    if len(frame.values) == 1:
        return F.regexp_replace(F.to_json(F.struct(F.col(frame.values[0]).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")
    return F.to_json(F.struct(*frame.values), {"ignoreNullFields": "false"})


def to_json(frame: IntervalFrame) -> DataFrame:
    """(keys, json): one JSON text a row, ready for JSON lines."""
    if not frame.values:
        return frame.df.select(*frame.keys, interval_json(frame).alias("json"))
    return frame.df.select(*frame.keys, F.concat(F.lit('{"value":'), value_json(frame), F.lit(',"interval":'), interval_json(frame), F.lit("}")).alias("json"))


def whole_json(frame: IntervalFrame) -> DataFrame:
    """(keys, json): one JSON array a key, rows in order of their starts."""
    ordered = frame.df.select(*frame.keys, F.struct(*[F.col(d.lo).alias(f"s{k}") for k, d in enumerate(frame.dims)]).alias("_s"), _row_text(frame).alias("_j"))
    return ordered.groupBy(*frame.keys).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_s", "_j"))), lambda x: x["_j"]), ","), F.lit("]")).alias("json"))


def _row_text(frame: IntervalFrame) -> Column:
    return interval_json(frame) if not frame.values else F.concat(F.lit('{"value":'), value_json(frame), F.lit(',"interval":'), interval_json(frame), F.lit("}"))


def _cut(d: Dim, text: Column, end: bool) -> Column:
    """The cut of a boundary's JSON text."""
    point, open_ = F.get_json_object(text, "$.point"), F.get_json_object(text, "$.open")
    make = d.end if end else d.start
    bare = F.trim(F.regexp_replace(text, '"', ""))
    edge = F.when(bare == "Bottom", d.column(d.first)).when(bare == "Top", d.column(d.last))
    return F.coalesce(edge, F.when(point.isNotNull(), d.column(make(point))), F.when(open_.isNotNull(), d.column(make(Open(open_)))))


def from_json(rows: DataFrame, dims: list[Dim], value_type: str | None = "string", *, json_col: str = "json", keys: tuple[str, ...] = ()) -> IntervalFrame:
    """Rows (or, for shapes, intervals) from JSON texts, one a row."""
    base = F.col(json_col) if value_type is None else F.get_json_object(json_col, "$.interval")
    ends = {side: F.from_json(F.get_json_object(base, f"$.{side}"), "array<string>") for side in ("start", "end")}
    cols = [c for k, d in enumerate(dims) for c in (_cut(d, F.get(ends["start"], k), False).alias(d.lo), _cut(d, F.get(ends["end"], k), True).alias(d.hi))]
    value = [] if value_type is None else [F.from_json(F.concat(F.lit('{"v":'), _raw(F.col(json_col)), F.lit("}")), f"v {value_type}")["v"].alias("value")]
    return IntervalFrame(rows.select(*keys, *cols, *value), dims, () if value_type is None else ("value",), keys)


def _raw(text: Column) -> Column:
    """The value's raw JSON; text is quoted again."""
    bare = F.get_json_object(text, "$.value")
    is_text = text.rlike(r'^\s*\{\s*"value"\s*:\s*"')
    return F.when(is_text, F.regexp_replace(F.to_json(F.struct(bare.alias("v"))), r'^\{"v":|\}$', "")).otherwise(F.coalesce(bare, F.lit("null")))


def from_whole_json(rows: DataFrame, dims: list[Dim], value_type: str | None = "string", *, json_col: str = "json", keys: tuple[str, ...] = ()) -> IntervalFrame:
    """Rows from JSON arrays."""
    each = rows.select(*keys, F.explode(F.from_json(json_col, "array<string>")).alias("json"))
    return from_json(each, dims, value_type, keys=keys)


def actions_json(actions: DataFrame, frame: IntervalFrame) -> DataFrame:
    """Difference actions as JSON texts."""
    row = _row_text(frame)
    key = F.concat(F.lit("["), F.concat_ws(",", *[boundary_json(d, F.col(d.lo), False) for d in frame.dims]), F.lit("]"))
    text = F.when(F.col("action") == "Delete", F.concat(F.lit('{"action":"Delete","key":'), key, F.lit("}"))).otherwise(F.concat(F.lit('{"action":"'), F.col("action"), F.lit('","validData":'), row, F.lit("}")))
    return actions.select(*frame.keys, text.alias("json"))


def actions_from_json(rows: DataFrame, dims: list[Dim], value_type: str = "string", *, json_col: str = "json", keys: tuple[str, ...] = ()) -> DataFrame:
    """Difference actions from their JSON texts, as IntervalFrame.apply_diff_actions takes them."""
    parsed = rows.withColumns({"_row": F.get_json_object(json_col, "$.validData"), "_key": F.from_json(F.get_json_object(json_col, "$.key"), "array<string>"), "_action": F.get_json_object(json_col, "$.action")})
    whole = from_json(parsed.withColumnRenamed(json_col, "_text"), dims, value_type, json_col="_row", keys=("_action", "_key", *keys)).df
    starts = [F.coalesce(d.lo, _cut(d, F.get(F.col("_key"), k), False)).alias(d.lo) for k, d in enumerate(dims)]
    return whole.select(F.col("_action").alias("action"), *keys, *[c for d, a in zip(dims, starts, strict=True) for c in (a, F.col(d.hi))], "value")


def multi_json(multi) -> DataFrame:
    """A frame of sets: values are JSON arrays."""
    return to_json(multi)


def multi_from_json(rows: DataFrame, dims: list[Dim], element_type: str = "string", **how):
    from ..operators.frame import Multi

    return from_json(rows, dims, f"array<{element_type}>", **how).as_kind(Multi)


def monoid_from_json(rows: DataFrame, dims: list[Dim], value_type: str, *, aggregate=F.sum, identity: Any = 0, **how):
    """A monoid's rows; its aggregate and identity are no data and are given."""
    from ..operators.frame import Monoid

    f = from_json(rows, dims, value_type, **how)
    return Monoid(f.df, f.dims, f.values, f.keys, aggregate=aggregate, identity=identity)


def variable_json(variable) -> DataFrame:
    """A variable's history as one JSON array."""
    return whole_json(variable.frame)


def variable_from_json(rows: DataFrame, value_type: str = "string"):
    from ..operators.versioned import Variable

    return Variable.from_history(from_whole_json(rows, [Variable.TIME], value_type))


def versioned_json(versioned) -> DataFrame:
    """A versioned frame as one JSON object: initialVersion, currentVersion, versionTimestamps, data."""
    head = json.dumps({"initialVersion": versioned.initial, "currentVersion": versioned.current, "versionTimestamps": {str(v): [str(t), c] for v, t, c in versioned.log}})[:-1]
    return whole_json(versioned.frame).select(F.concat(F.lit(head + ',"data":'), "json", F.lit("}")).alias("json"))


def versioned_from_json(spark: SparkSession, text: str, dims: list[Dim], value_type: str = "string"):
    from ..operators.versioned import VERSION, Versioned

    whole = json.loads(text)
    rows = spark.createDataFrame([(json.dumps(r),) for r in whole["data"]], "json string")
    log = tuple((int(v), *x) for v, x in whole["versionTimestamps"].items())
    return Versioned(from_json(rows, [VERSION, *dims], value_type), whole["currentVersion"], log, whole["initialVersion"])


def write_lines(frame: IntervalFrame, path: str) -> None:
    to_json(frame).select(F.col("json").alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, dims: list[Dim], value_type: str | None = "string") -> IntervalFrame:
    return from_json(spark.read.text(path).withColumnRenamed("value", "json"), dims, value_type)


def upsert_by_start(frame: IntervalFrame, actions: DataFrame) -> IntervalFrame:
    """What a keyed store holds after insert, replace and delete by start: the document-store bridge without a store."""
    return frame.apply_diff_actions(actions)


# --- paths ---
@dataclass(frozen=True)
class Step:
    """An object's key, or a slice [begin, end) of an array."""

    key: str | None = None
    begin: int = 0
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> list[Step]:
        """`name`, `name[2]`, `name[1:4]`, `[:]`, `[*]`, a bare index `2`; ~1 is a slash and ~0 a tilde within names."""
        m = re.fullmatch(r"([^\[\]]*)((?:\[(?:\d*(?::\d*)?|\*)\])*)", text)
        if not m:
            raise ValueError(f"no path component: {text}")
        if text.isdecimal():
            return [cls(None, int(text), int(text) + 1)]
        out = [cls(m[1].replace("~1", "/").replace("~0", "~"))] if m[1] else []
        for part in re.findall(r"\[([^\]]*)\]", m[2]):
            a, colon, b = (":" if part == "*" else part).partition(":")
            out.append(cls(None, int(a or 0), (int(b) if b else None) if colon else int(a) + 1))
        return out

    def matches(self, at: str | int | Step) -> bool:
        """A key, an index, or another step: equal keys, or slices with an index in common."""
        if isinstance(at, Step):
            if self.key is not None or at.key is not None:
                return self.key == at.key
            ends = [e for e in (self.end, at.end) if e is not None]
            return not ends or max(self.begin, at.begin) < min(ends)
        if isinstance(at, str):
            return self.key == at
        return self.key is None and self.begin <= at and (self.end is None or at < self.end)


def parse_path(text: str) -> list[Step]:
    return [s for part in text.split("/") if part for s in Step.parse(part)]


def path_text(path: list[Step]) -> str:
    """The path as it is parsed."""
    def one(s: Step) -> str:
        if s.key is not None:
            return s.key.replace("~", "~0").replace("/", "~1")
        if s.begin == 0 and s.end is None:
            return "[*]"
        return f"[{s.begin}]" if s.end == s.begin + 1 else f"[{s.begin}:{'' if s.end is None else s.end}]"

    return "/".join(map(one, path))


def compare(path: list[Step], at: list[str | int | Step]) -> str:
    """Whether a place is on the way to the path ("prefix"), at it or inside ("match"), or elsewhere ("otherwise")."""
    if not all(s.matches(x) for s, x in zip(path, at, strict=False)):
        return "otherwise"
    return "match" if len(at) >= len(path) else "prefix"


def _down(found: Column, s: Step) -> Column:
    """The variants one step further down."""
    if s.key is not None:
        return F.transform(found, lambda x: F.try_variant_get(x, f"$['{s.key}']", "variant"))
    n = F.lit(s.end - s.begin if s.end is not None else (1 << 31) - 2 - s.begin)
    each = F.transform(found, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")))
    return F.flatten(F.transform(each, lambda x: F.slice(x, s.begin + 1, n)))


def nodes_at(text: Column, path: str) -> Column:
    """The JSON nodes at a path as an array of variants: the text is parsed once, arrays on the way are sliced and flattened, and JSON nulls count as absent. Texts that are no JSON have no nodes."""
    found: Any = F.array(F.try_parse_json(text))
    for s in parse_path(path):
        found = _down(found, s)
    return F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x))


def fold_path(text: Column, path: str, zero: Column, op, element_type: str = "string") -> Column:
    """A fold over the JSON nodes at a path, inside one expression."""
    return F.aggregate(nodes_at(text, path), zero, lambda a, x: op(a, x.cast(element_type)))


# --- for people ---
def chart(frame: IntervalFrame, width: int = 60) -> str:
    """A text chart of a small frame's first dimension, other dimensions as labels."""
    rows = frame.get_all().collect()
    d = frame.dims[0]
    cut = lambda r, c, x: r[c] if x.discrete else tuple(r[c])
    cuts = sorted({cut(r, c, d) for r in rows for c in (d.lo, d.hi)})
    lines = []
    for r in rows:
        a, b = (round(cuts.index(cut(r, c, d)) * width / max(1, len(cuts) - 1)) for c in (d.lo, d.hi))
        label = " x ".join(repr(Span(x, cut(r, x.lo, x), cut(r, x.hi, x))) for x in frame.dims)
        lines.append(f"|{' ' * a}{'-' * max(1, b - a)}{' ' * (width - b)}| {label} -> {', '.join(str(r[v]) for v in frame.values)}")
    return "\n".join(lines)


def code(frame: IntervalFrame) -> str:
    """A small frame as Python source."""
    rows = frame.get_all().collect()

    def side(d: Dim, r) -> str:
        lo, hi = (r[c] if d.discrete else tuple(r[c]) for c in (d.lo, d.hi))
        a = "BOTTOM" if lo == d.first else repr(lo) if d.discrete else f"Open({lo[0]!r})" if lo[1] else repr(lo[0])
        b = "TOP" if hi == d.last else repr(d.pred(hi)) if d.discrete else repr(hi[0]) if hi[1] else f"Open({hi[0]!r})"
        return f"interval({d.name}, {a}, {b})"

    return "[" + ", ".join(f"([{', '.join(side(d, r) for d in frame.dims)}], {', '.join(repr(r[v]) for v in frame.values)})" for r in rows) + "]"


__all__ = ["BOTTOM", "TOP", "actions_json", "chart", "code", "compare", "fold_path", "from_json", "from_whole_json", "parse_path", "read_lines", "to_json", "versioned_from_json", "versioned_json", "whole_json", "write_lines"]
