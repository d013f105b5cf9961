"""IntervalFrame: values valid in boxes, as a DataFrame of one row per box, many independent structures by key.

Columns: the keys, for each dimension its two cuts, the values (none for a pure shape). Rows of one key are disjoint
unless said otherwise. Two workhorses carry most operators:

* cells: rows of one or more frames are split on the grid of their cuts, key by key and dimension by dimension, and only
  cells that some row covers are made; one aggregation by cell then decides what holds there;
* coalesce: adjacent rows of equal value are merged by a window (gaps and islands), one dimension after the other; after
  cells this gives a unique canonical form.

Keys make every step an equi-join, a window or an aggregation by key. Without keys a frame is one structure: its rows are
dealt by ranges of the first dimension where cells are made or islands found, and meet in bins where they are joined. `hot`
cuts the first dimension at given values, which become part of the key while cells are made, so that one large structure
of a key is worked on in many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cuts import BOTTOM, TOP, Box, Dim, Probe, Span, contains, contains_point, dilated, displaced, eroded, intersects, padded, reflected, scaled, touches, unbounded
from . import meeting, tiles


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class IntervalFrame:
    #: Whether keys differ so much in size that the largest are dealt to many tasks: None looks at large tables, see `meeting`.
    skewed: bool | None = None

    def __init__(self, df: DataFrame, dims: Iterable[Dim], values: Iterable[str] = ("value",), keys: Iterable[str] = (), *, hot: tuple = ()):
        self.dims, self.values, self.keys, self.hot = tuple(dims), tuple(values), tuple(keys), tuple(hot)
        self.df = df.select(*self.columns)

    # --- structure ---
    @property
    def bounds(self) -> list[str]:
        return [c for d in self.dims for c in (d.lo, d.hi)]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.bounds, *self.values]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def box(self, prefix: str = "") -> Box:
        """The row's box as Columns."""
        return [Span(d, _col(prefix + d.lo), _col(prefix + d.hi)) for d in self.dims]

    def _with(self, df: DataFrame, **change) -> IntervalFrame:
        kind = type(self) if change.get("values", self.values) or type(self) is not IntervalFrame else IntervalFrame
        return kind(df, change.get("dims", self.dims), change.get("values", self.values), change.get("keys", self.keys), hot=change.get("hot", self.hot)).on_keys(skewed=self.skewed)

    def on_keys(self, *, skewed: bool | None) -> IntervalFrame:
        """The same frame, of which it is known whether some keys have very many rows."""
        self.skewed = skewed
        return self

    def _said(self, others: Iterable[IntervalFrame]) -> bool | None:
        """Whether some keys of the frames have very many rows, if that is known of all of them or of one that has."""
        said = [x.skewed for x in (self, *others)]
        return True if True in said else None if None in said else False

    def _hot(self, tables: list[tuple[DataFrame, str, str]], *others: IntervalFrame, keys: list[str] | None = None) -> DataFrame | None:
        """The keys of very many rows, as `meeting.hot_keys`. A frame whose keys were found small hands that on to those made of it."""
        found = meeting.counted(self.keys if keys is None else keys, self.dims[0], tables, skewed=self._said(others))
        if found is meeting.CALM:
            for x in (self, *others):
                x.skewed = False
            return None
        return found

    def _set(self, spans: Box) -> list[Column]:
        return [c for d, s in zip(self.dims, spans, strict=True) for c in (d.column(s.lo).alias(d.lo), d.column(s.hi).alias(d.hi))]

    # --- construction ---
    @classmethod
    def from_df(cls, df: DataFrame, dims: dict[Dim, tuple[Any, Any]], values: Iterable[str] = ("value",), keys: Iterable[str] = (), **how) -> IntervalFrame:
        """From boundary columns or constants: dims maps each dimension to (start, end) boundaries; rows with an empty extent are dropped."""
        keys, values = tuple(keys), tuple(values)
        out = df.select(*keys, *values, *[c for d, (a, b) in dims.items() for c in (d.column(d.start(a)).alias(d.lo), d.column(d.end(b)).alias(d.hi))])
        return cls(out.filter(reduce(lambda x, y: x & y, [_col(d.lo) < _col(d.hi) for d in dims])), dims, values, keys, **how)

    @classmethod
    def of(cls, spark: SparkSession, dims: Iterable[Dim], rows: Iterable[tuple], value_types: Iterable[str] = ("string",), values: Iterable[str] = ("value",)) -> IntervalFrame:
        """From literals: rows are (box, value...) with boxes as lists of Spans (or one Span)."""
        dims, values = tuple(dims), tuple(values)
        types = [*[f"{c} {d.cut_type}" for d in dims for c in (d.lo, d.hi)], *[f"{v} {t}" for v, t in zip(values, value_types, strict=False)]]
        data = [(*[c for s in _boxed(r[0]) for c in (s.lo, s.hi)], *r[1:]) for r in rows]
        return cls(spark.createDataFrame(data, ", ".join(types)), dims, values)

    @classmethod
    def empty(cls, spark: SparkSession, dims: Iterable[Dim], value_types: Iterable[str] = ("string",), values: Iterable[str] = ("value",)) -> IntervalFrame:
        return cls.of(spark, dims, [], value_types, values)

    @classmethod
    def of_value(cls, spark: SparkSession, dims: Iterable[Dim], value, value_type: str = "string") -> IntervalFrame:
        """One row that is valid everywhere."""
        dims = tuple(dims)
        return cls.of(spark, dims, [([unbounded(d) for d in dims], value)], (value_type,))

    # --- conversions ---
    def as_kind(self, kind: type, **how) -> IntervalFrame:
        """The same rows with another flavour's operators."""
        return kind(self.df, self.dims, self.values, self.keys, **how).on_keys(skewed=self.skewed)

    def copy(self) -> IntervalFrame:
        return self._with(self.df)

    def with_value(self, value, name: str = "value") -> IntervalFrame:
        """A shape with a constant value."""
        return IntervalFrame(self.df.withColumn(name, F.lit(value)), self.dims, (*self.values, name), self.keys)

    def with_monoid_value(self, value, *, aggregate: Callable[[Column], Column] = F.sum, identity: Any = 0, name: str = "value") -> Monoid:
        """A shape with a constant value that adds up where regions meet."""
        f = self.with_value(value, name)
        return Monoid(f.df, f.dims, f.values, f.keys, aggregate=aggregate, identity=identity)

    def collect_with_value(self, value: Column, align_to: IntervalFrame | None = None, name: str = "value") -> IntervalFrame:
        """A value computed from the row's box where it isn't null, perhaps on another frame's grid."""
        base = self if align_to is None else self.decompressed(align_to)
        return IntervalFrame(base.df.withColumn(name, value).filter(_col(name).isNotNull()), self.dims, (*self.values, name), self.keys)

    # --- look-ups ---
    def get_all(self) -> DataFrame:
        """Rows in order of their starts."""
        return self.df.orderBy(*self.keys, *[d.lo for d in self.dims])

    def get_data_at(self, *point) -> DataFrame:
        """The rows that hold at a point (values, Columns, TOP or BOTTOM), one a key at most."""
        return self.df.filter(contains_point(self.box(), point))

    def get_at(self, *point) -> DataFrame:
        return self.get_data_at(*point).select(*self.keys, *self.values)

    def is_defined_at(self, *point) -> bool:
        return not self.get_data_at(*point).isEmpty()

    def get_intersecting(self, box: Box | Span) -> IntervalFrame:
        """Rows that overlap a box, as they are."""
        return self._with(self.df.filter(intersects(self.box(), self._literal(box))))

    def intersects_box(self, box: Box | Span) -> bool:
        return not self.get_intersecting(box).is_empty()

    def _literal(self, box: Box | Span) -> Box:
        return [Span(d, d.column(s.lo), d.column(s.hi)) for d, s in zip(self.dims, _boxed(box), strict=True)]

    def get(self):
        """The value if the first row is valid everywhere, else an error."""
        out = self.get_option()
        if out is None:
            raise LookupError("the value isn't unbounded")
        return out

    def get_option(self):
        row = self.df.filter(reduce(lambda a, b: a & b, [s.dim.is_first(s.lo) & s.dim.is_last(s.hi) for s in self.box()])).select(*self.values).first()
        return None if row is None else row[0] if len(row) == 1 else tuple(row)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def size(self) -> int:
        return self.df.count()

    def distinct_values(self) -> DataFrame:
        return self.df.select(*self.values).distinct()

    def intervals(self, value) -> DataFrame:
        """Boxes in which a value is valid."""
        return self.df.filter(self._is(value)).select(*self.keys, *self.bounds)

    def all_intervals(self) -> DataFrame:
        return self.df.select(*self.keys, *self.bounds)

    def _is(self, value) -> Column:
        given = value if isinstance(value, tuple) and len(self.values) > 1 else (value,)
        return reduce(lambda a, b: a & b, [_col(v).eqNullSafe(F.lit(x)) for v, x in zip(self.values, given, strict=True)])

    def domain(self) -> Shape:
        """The covered region, values left out."""
        return self._region().coalesce()

    def _region(self) -> Shape:
        return Shape(self.df, self.dims, (), self.keys).on_keys(skewed=self.skewed)

    def bounding_interval(self) -> DataFrame:
        """The hull of each key's rows."""
        return self.df.groupBy(*self.keys).agg(*[f(c).alias(c) for d in self.dims for f, c in ((F.min, d.lo), (F.max, d.hi))])

    def fold_left(self, zero: Column, op: Callable[[Column, Column], Column], name: str = "result") -> DataFrame:
        """An ordered fold over each key's rows (structs of bounds and values) by start; a key's rows come together, so prefer sums and the like where order is no matter."""
        rows = F.sort_array(F.collect_list(F.struct(*self.bounds, *self.values)))
        return self.df.groupBy(*self.keys).agg(F.aggregate(rows, zero, op).alias(name))

    # --- row by row ---
    def filter(self, test: Column) -> IntervalFrame:
        return self._with(self.df.filter(test))

    def map_values(self, **exprs: Column) -> IntervalFrame:
        """New values, then coalesced."""
        df = self.df.select(*self.keys, *self.bounds, *[e.alias(n) for n, e in exprs.items()])
        return IntervalFrame(df, self.dims, tuple(exprs), self.keys).on_keys(skewed=self.skewed).coalesce()

    def map_intervals(self, dims: dict[Dim, tuple[Column, Column]], *, coalesce: bool = True) -> IntervalFrame:
        """New cuts (perhaps of other dimensions) from Columns; empty boxes are dropped; then coalesced."""
        df = self.df.select(*self.keys, *self.values, *[c for d, (a, b) in dims.items() for c in (a.alias(d.lo), b.alias(d.hi))])
        out = self._with(df.filter(reduce(lambda x, y: x & y, [_col(d.lo) < _col(d.hi) for d in dims])), dims=tuple(dims))
        return out.coalesce() if coalesce else out

    def map(self, dims: dict[Dim, tuple[Column, Column]], **exprs: Column) -> IntervalFrame:
        df = self.df.select(*self.keys, *[e.alias(n) for n, e in exprs.items()], *[c for d, (a, b) in dims.items() for c in (a.alias(d.lo), b.alias(d.hi))])
        return IntervalFrame(df, dims, tuple(exprs), self.keys).coalesce()

    def collect(self, defined: Column, **exprs: Column) -> IntervalFrame:
        """Values where the expression is defined, then coalesced."""
        return self.filter(defined).map_values(**exprs) if exprs else self.filter(defined).coalesce()

    def flat_map(self, rows: Column) -> IntervalFrame:
        """Each row becomes the structs of an array (bounds and values by name); disjointness is the caller's duty; then coalesced."""
        names = [*self.bounds, *self.values]
        df = self.df.select(*self.keys, F.explode(rows).alias("_r")).select(*self.keys, *[F.col("_r")[n].alias(n) for n in names])
        return self._with(df).coalesce()

    # --- workhorse 1: cells ---
    def _split(self, rows: DataFrame, grid: DataFrame | None = None, *, others: Iterable[IntervalFrame] = ()) -> DataFrame:
        """Rows (keys, bounds, anything) on the grid of their own cuts, or those of a larger table with the same keys and bounds."""
        rows = _short(rows)
        keys, out, grid = list(self.keys), rows, None if grid is None else _short(grid)
        if self.hot:
            out, grid, keys = self._dealt(out), grid if grid is None else self._dealt(grid), [*keys, "_part"]
        hot = self._hot([(out if grid is None else grid, self.dims[0].lo, self.dims[0].hi)], *others, keys=keys) if keys else None
        if keys and hot is None:
            if grid is not None:
                mine, cuts = out.withColumn("_mine", F.lit(True)), grid.select(*keys, *self.bounds).distinct().withColumn("_mine", F.lit(False))
                out = mine.unionByName(cuts, allowMissingColumns=True)
            return _gridded(meeting.together(out, keys), keys, self.dims, None if grid is None else "_mine").drop("_part")
        grid = out if grid is None else grid
        for d in self.dims:
            ends = grid.select(*keys, F.explode(F.array(d.lo, d.hi)).alias("_from")).distinct()
            rest = [c for c in out.columns if c not in (d.lo, d.hi)]
            covers = [_col(d.lo) <= F.col("_from"), F.col("_to") <= _col(d.hi)]
            if keys:
                segments = ends.withColumn("_to", F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from"))).filter("_to is not null")
                other = segments.select(*[_col(k).alias(f"_k_{k}") for k in keys], "_from", "_to")
                covers = [_col(k).eqNullSafe(_col(f"_k_{k}")) for k in keys] + covers
                if d is self.dims[0]:
                    out, other, meet = meeting.binned(keys, out, (d.lo, d.hi), other, ("_from", "_to"), [f"_k_{k}" for k in keys], d, hot)
                    covers += meet
            else:
                other = _segments(ends, d)
                if (bins := _bins(d, (grid, d.lo, d.hi))) is not None:
                    out, other, meet = _binned(out, (d.lo, d.hi), other, ("_from", "_to"), d, bins)
                    covers += meet
            out = out.join(other, reduce(lambda a, b: a & b, covers)).select(*rest, F.col("_from").alias(d.lo), F.col("_to").alias(d.hi))
        return out.drop("_part")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows clipped to the parts of the first dimension that `hot` cuts out, with the part's number."""
        d = self.dims[0]
        cuts = [d.first, *(d.start(h) for h in self.hot), d.last]
        parts = F.array(*[F.struct(F.lit(k).alias("n"), d.column(a).alias("a"), d.column(b).alias("b")) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
        hit = F.filter(parts, lambda p: (p["a"] < _col(d.hi)) & (_col(d.lo) < p["b"]))
        spread = rows.withColumn("_p", F.explode(hit))
        return spread.withColumns({d.lo: F.greatest(d.lo, F.col("_p.a")), d.hi: F.least(d.hi, F.col("_p.b")), "_part": F.col("_p.n")}).drop("_p")

    def decompressed(self, *others: IntervalFrame) -> IntervalFrame:
        """Rows split on their own cuts and those of others."""
        grid = reduce(DataFrame.union, [x.df.select(*self.keys, *self.bounds) for x in (self, *others)])
        return self._with(self._split(self.df, grid, others=others))

    def _overlay(self, others: list[IntervalFrame], aggs: Callable[[list[Column], Callable[[Column], Column]], list[Column]], *, universe: bool = False, nested: bool = False) -> DataFrame:
        """One row per covered cell of all frames. aggs gets for each frame a Column that is its values' struct where a row of it covers (else null), and the function by which rows of a cell become one. nested: cells need not lie on the whole grid."""
        frames = [self, *others]
        if len(self.dims) == 1 and self.keys and not self.hot:
            return self._swept(frames, aggs, universe=universe)
        rows = [
            f.df.select(*self.keys, *self.bounds, F.lit(i).alias("_of"), *[(F.struct(*f.values, F.lit(True).alias("_here")) if j == i else F.lit(None)).alias(f"_v{j}") for j in range(len(frames))])
            for i, f in enumerate(frames)
        ]
        if universe:
            whole = [c for d in self.dims for c in (d.column(d.first).alias(d.lo), d.column(d.last).alias(d.hi))]
            known = reduce(DataFrame.union, [f.df.select(*self.keys) for f in frames]).distinct() if self.keys else self.spark.range(1)
            rows.append(known.select(*self.keys, *whole, F.lit(-1).alias("_of"), *[F.lit(None).alias(f"_v{j}") for j in range(len(frames))]))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        cells = self._nested(rows, others=others) if nested else self._split(rows, others=others)
        return cells.groupBy(*self.keys, *self.bounds).agg(*aggs([F.col(f"_v{j}") for j in range(len(frames))], F.max))

    def _swept(self, frames: list[IntervalFrame], aggs: Callable, *, universe: bool) -> DataFrame:
        """_overlay in one dimension by a sweep: what begins and ends at each cut of a key, carried along a window. No join; keys with very many rows are dealt into ranges of cuts, and one row a range is carried over. Rows of a frame with values are disjoint."""
        d, n = self.dims[0], len(frames)
        keys = list(self.keys)
        frames = [f._with(self._settled(f.df)) for f in frames]
        ends = []
        for i, f in enumerate(frames):
            value = F.struct(*f.values, F.lit(True).alias("_here"))
            two = F.array(F.struct(_col(d.lo).alias("c"), F.lit(1).alias("n"), value.alias("v")), F.struct(_col(d.hi).alias("c"), F.lit(-1).alias("n"), F.lit(None).alias("v")))
            ends.append(f.df.select(*keys, F.explode(two).alias("e")).select(*keys, F.col("e.c").alias("_c"), *[c for j in range(n) for c in ((F.col("e.n") if j == i else F.lit(0)).alias(f"_n{j}"), (F.col("e.v") if j == i else F.lit(None)).alias(f"_v{j}"))]))
        if universe:
            known = reduce(DataFrame.union, [f.df.select(*keys) for f in frames]).distinct()
            edges = F.explode(F.array(d.column(d.first), d.column(d.last))).alias("_c")
            ends.append(known.select(*keys, edges, *[c for j in range(n) for c in (F.lit(0).alias(f"_n{j}"), F.lit(None).alias(f"_v{j}"))]))
        at = reduce(lambda a, b: a.unionByName(b), ends)
        hot = self._hot([(f.df, d.lo, d.hi) for f in frames], *frames[1:])
        by = keys if hot is None else [*keys, "_part"]
        if hot is not None:
            at = meeting.dealt(at, keys, d, "_c", hot)
        at = at.groupBy(*by, "_c").agg(*[a for j in range(n) for a in (F.sum(f"_n{j}").alias(f"_n{j}"), F.max(f"_v{j}").alias(f"_v{j}"))])
        if hot is not None:
            last = lambda j: F.max_by(F.col(f"_v{j}"), F.when(F.col(f"_v{j}").isNotNull(), F.col("_c")))
            before = {f"_b{j}": (F.sum(f"_n{j}"), meeting.earlier(F.sum)) for j in range(n)} | {f"_w{j}": (last(j), meeting.earlier(lambda c: F.last(c, ignorenulls=True))) for j in range(n)}
            at = meeting.carried(at, keys, before | {"_next": (F.min("_c"), meeting.following)})
        w = Window.partitionBy(*by).orderBy("_c")
        here, held = (lambda j: F.sum(f"_n{j}").over(w)), (lambda j: F.last(f"_v{j}", ignorenulls=True).over(w))
        if hot is not None:
            own_here, own_held = here, held
            here, held = (lambda j: own_here(j) + F.coalesce(f"_b{j}", F.lit(0))), (lambda j: F.coalesce(own_held(j), F.col(f"_w{j}")))
        to = F.lead("_c").over(w)
        run = at.select(*keys, F.col("_c").alias(d.lo), (to if hot is None else F.coalesce(to, F.col("_next"))).alias(d.hi), *[c for j in range(n) for c in (here(j).alias(f"_h{j}"), held(j).alias(f"_u{j}"))])
        covered = F.lit(True) if universe else reduce(lambda a, b: a | b, [F.col(f"_h{j}") > 0 for j in range(n)])
        run = run.filter(_col(d.hi).isNotNull() & covered)
        run = run.select(*keys, d.lo, d.hi, *[F.when(F.col(f"_h{j}") > 0, F.col(f"_u{j}")).alias(f"_v{j}") for j in range(n)])
        return run.select(*keys, d.lo, d.hi, *aggs([F.col(f"_v{j}") for j in range(n)], lambda c: c))

    def _nested(self, rows: DataFrame, *, others: Iterable[IntervalFrame] = ()) -> DataFrame:
        """Rows cut only where boxes can meet: a key's rows fall into islands, dimension by dimension, that lie apart; the last dimension is cut on the cuts of an island, and each dimension before it on the cuts of those rows that lie in the same strip. What holds is the same in all of a cell, and coalescing gives the same canonical form as from the whole grid."""
        if len(self.dims) == 1 or not self.keys or self.hot:
            return self._split(rows, others=others)
        rows = _short(rows)
        by, out = list(self.keys), rows
        hot = self._hot_rows(rows, *others)
        out = rows if hot is not None else meeting.together(rows, by)
        for i, d in enumerate(self.dims):
            out = self._islands(out, d, by, name=f"_i{i}", even=hot is None)
            by.append(f"_i{i}")
        for d in reversed(self.dims):
            out = self._sliced(out, d, by) if hot is None else self._met(_short(out), d, by)
            by += [d.lo, d.hi]
        return out.drop(*[f"_i{i}" for i in range(len(self.dims))])

    def _sliced(self, rows: DataFrame, d: Dim, by: list[str]) -> DataFrame:
        """Rows on the cuts of their group in one dimension."""
        return _on_cuts(rows.withColumn("_cuts", _cuts(d, by)), d, "_cuts")

    def _met(self, rows: DataFrame, d: Dim, by: list[str]) -> DataFrame:
        """_sliced by a join, for groups that may have very many cuts."""
        rest = [c for c in rows.columns if c not in (d.lo, d.hi)]
        ends = rows.select(*by, F.explode(F.array(d.lo, d.hi)).alias("_from")).distinct()
        other = ends.withColumn("_to", F.lead("_from").over(Window.partitionBy(*by).orderBy("_from"))).filter("_to is not null").select(*[_col(k).alias(f"_k_{k}") for k in by], "_from", "_to")
        on = [_col(k).eqNullSafe(_col(f"_k_{k}")) for k in by] + [_col(d.lo) <= F.col("_from"), F.col("_to") <= _col(d.hi)]
        return rows.join(other, reduce(lambda a, b: a & b, on)).select(*rest, F.col("_from").alias(d.lo), F.col("_to").alias(d.hi))

    def atoms(self) -> IntervalFrame:
        """Rows on the whole grid of their key's cuts (overlapping rows then share atoms)."""
        return self._with(self._split(self.df))

    # --- workhorse 2: coalesce ---
    def coalesce(self) -> IntervalFrame:
        """Merges rows of equal value that are adjacent (or overlap) in one dimension and equal in the others, dimension by dimension."""
        df = self._settled(self.df)
        even = len(self.dims) > 1 and bool(self.keys) and self._hot_rows(df) is None
        if even:
            df = meeting.together(df, self.keys)
        for d in self.dims:
            same = [*self.keys, *self.values, *[c for x in self.dims if x is not d for c in (x.lo, x.hi)]]
            df = self._islands(df, d, same, even=even).groupBy(*same, "_island").agg(F.min(d.lo).alias(d.lo), F.max(d.hi).alias(d.hi)).select(*self.columns)
        return self._with(df)

    def _settled(self, df: DataFrame) -> DataFrame:
        """df, staged if its plan is long, or if it does more than read and its keys are to be counted first: it would run once for the counts and once more."""
        counts = bool(self.keys) and self.skewed is not False and (self.skewed is True or meeting.estimate(df) >= meeting.CHECK_BYTES)
        return _short(df, most=0 if counts else 8)

    def _hot_rows(self, df: DataFrame, *others: IntervalFrame) -> DataFrame | None:
        """_hot of a table with this frame's bounds; which keys they are is the same in all dimensions."""
        return self._hot([(df, self.dims[0].lo, self.dims[0].hi)], *others) if self.keys else None

    def _islands(self, df: DataFrame, d: Dim, same: list[str], name: str = "_island", *, even: bool = False) -> DataFrame:
        """df with the number of each row's island among rows of equal `same`: rows that overlap or touch in a dimension. even: no key has very many rows. Without keys and in one dimension, and where keys have very many rows, rows are dealt by ranges of their starts, and only what each range reaches and how many islands begin in it is carried over."""
        hot = self._hot([(df, d.lo, d.hi)]) if self.keys and not even else None
        cuts = None if self.keys or len(self.dims) > 1 else _quantiles(df, d, d.lo)
        if cuts is None and hot is None:
            order = Window.partitionBy(*same, *([] if same else [F.lit(0)])).orderBy(d.lo, d.hi)
            reach = F.max(d.hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
            marked = df.withColumn("_new", F.when(reach >= _col(d.lo), 0).otherwise(1))
            return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
        dealt = df.withColumn("_part", _part_of(d, d.lo, cuts)) if hot is None else meeting.dealt(df, self.keys, d, d.lo, hot)
        inside = Window.partitionBy(*same, "_part").orderBy(d.lo, d.hi)
        with_top = _carried(dealt, same, F.max(d.hi), F.max, "_top")
        reach = F.greatest(F.max(d.hi).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))
        marked = with_top.withColumn("_new", F.when(reach >= _col(d.lo), 0).otherwise(1))
        numbered = marked.withColumn(name, F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        both = _carried(numbered, same, F.sum("_new"), F.sum, "_before")
        return both.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_top", "_new", "_before")

    compress_all = coalesce

    def compress(self, value) -> IntervalFrame:
        """Coalesces the rows of one value."""
        one = self._is(value)
        return self._with(self._with(self.df.filter(one)).coalesce().df.unionByName(self.df.filter(~one)))

    def recompress_all(self, *grid: IntervalFrame) -> IntervalFrame:
        """The canonical form: cells, then islands of each dimension in turn."""
        return self.decompressed(*grid).coalesce()

    def is_compressible(self) -> bool:
        return self.coalesce().size() < self.size()

    def is_disjoint(self) -> bool:
        """Whether no two rows of a key overlap: no cell is covered twice."""
        return self._nested(self.df).groupBy(*self.keys, *self.bounds).count().filter("count > 1").isEmpty()

    # --- joins ---
    def _joined(self, that: IntervalFrame, how: str = "inner", test: Callable[[Box, Box], Column] = intersects) -> DataFrame:
        """Overlap join (or another test that implies meeting ends): equal keys, boxes that pass; that's columns are prefixed by `_r_`. Rows without keys, and those of keys with very many rows, meet in bins of the first dimension."""
        right = that.df.select(*[_col(c).alias(f"_r_{c}") for c in that.columns])
        on = [_col(k).eqNullSafe(_col(f"_r_{k}")) for k in self.keys] + [test(self.box(), self.box("_r_"))]
        left = self.df
        d = self.dims[0]
        if not self.keys and how == "inner" and (bins := _bins(d, (left, d.lo, d.hi), (that.df, d.lo, d.hi))) is not None:
            left, right, meet = _binned(left, (d.lo, d.hi), right, (f"_r_{d.lo}", f"_r_{d.hi}"), d, bins)
            on += meet
        if how == "inner" and not meeting.told_small(that.df) and (hot := self._hot([(left, d.lo, d.hi), (that.df, d.lo, d.hi)], that)) is not None:
            left, right, meet = meeting.binned(self.keys, left, (d.lo, d.hi), right, (f"_r_{d.lo}", f"_r_{d.hi}"), [f"_r_{k}" for k in self.keys], d, hot)
            on += meet
        return left.join(right, reduce(lambda a, b: a & b, on), how)

    def zip(self, that: IntervalFrame, *, suffix: str = "_2") -> IntervalFrame:
        """Pairs of values on every overlap; not coalesced."""
        names = [v if v not in self.values else v + suffix for v in that.values]
        cut = [c for d in self.dims for c in (F.greatest(d.lo, f"_r_{d.lo}").alias(d.lo), F.least(d.hi, f"_r_{d.hi}").alias(d.hi))]
        df = self._joined(that).select(*self.keys, *cut, *self.values, *[_col(f"_r_{v}").alias(n) for v, n in zip(that.values, names, strict=True)])
        return IntervalFrame(df, self.dims, (*self.values, *names), self.keys).on_keys(skewed=self._said([that]))

    def zip_all(self, that: IntervalFrame, this_default: dict, that_default: dict, *, suffix: str = "_2") -> IntervalFrame:
        """Outer pairs on the common grid, with defaults for the missing side; not coalesced."""
        names = {v: v if v not in self.values else v + suffix for v in that.values}

        def aggs(v: list[Column], one: Callable[[Column], Column]) -> list[Column]:
            mine = [F.when(one(v[0]["_here"]), one(v[0][c])).otherwise(F.lit(this_default[c])).alias(c) for c in self.values]
            return mine + [F.when(one(v[1]["_here"]), one(v[1][c])).otherwise(F.lit(that_default[c])).alias(n) for c, n in names.items()]

        return IntervalFrame(self._overlay([that], aggs), self.dims, (*self.values, *names.values()), self.keys)

    def overlay(self, that: IntervalFrame, handle: Callable[[Column, Column, Column, Column], Column], *, both_missing: bool = False, name: str = "value") -> IntervalFrame:
        """handle(has this, this, has that, that) on each cell of the common grid; null drops the cell. both_missing adds cells that neither covers. Not coalesced. One value column a side."""

        def aggs(v: list[Column], one: Callable[[Column], Column]) -> list[Column]:
            here = [F.coalesce(one(x["_here"]), F.lit(False)) for x in v]
            val = [one(x[f.values[0]]) if f.values else F.lit(None) for x, f in zip(v, (self, that), strict=True)]
            return [here[0].alias("_a"), val[0].alias("_x"), here[1].alias("_b"), val[1].alias("_y")]

        cells = self._overlay([that], aggs, universe=both_missing)
        out = cells.withColumn(name, handle(F.col("_a"), F.col("_x"), F.col("_b"), F.col("_y"))).filter(_col(name).isNotNull())
        return IntervalFrame(out, self.dims, (name,), self.keys)

    def _cells_with(self, that: IntervalFrame, *, universe: bool = False) -> DataFrame:
        """Cells with flags _a (this covers), _b (that covers), this's values and that's as _r_*. Rows of either side are disjoint."""

        def aggs(v: list[Column], one: Callable[[Column], Column]) -> list[Column]:
            return [
                F.coalesce(one(v[0]["_here"]), F.lit(False)).alias("_a"), F.coalesce(one(v[1]["_here"]), F.lit(False)).alias("_b"),
                *[one(v[0][c]).alias(c) for c in self.values], *[one(v[1][c]).alias(f"_r_{c}") for c in that.values],
            ]

        return self._overlay([that], aggs, universe=universe, nested=True)

    def difference(self, that: IntervalFrame) -> IntervalFrame:
        """What that doesn't cover; values of that are no matter."""
        return self._with(self._cells_with(that._region().recompress_all()).filter("_a and not _b")).coalesce()

    def intersection_shape(self, that: IntervalFrame) -> Shape:
        """The region in which both are valid."""
        z = Shape(self.df, self.dims, (), self.keys).zip(Shape(that.df, self.dims, (), self.keys))
        return Shape(z.df, self.dims, (), self.keys).recompress_all()

    def clip(self, box: Box | Span) -> IntervalFrame:
        """Rows cut to a box, coalesced."""
        b = self._literal(box)
        hit = self.df.filter(intersects(self.box(), b))
        cut = [c for d, s in zip(self.dims, b, strict=True) for c in (F.greatest(_col(d.lo), s.lo).alias(d.lo), F.least(_col(d.hi), s.hi).alias(d.hi))]
        return self._with(hit.select(*self.keys, *cut, *self.values)).coalesce()

    def symmetric_difference(self, that: IntervalFrame) -> IntervalFrame:
        """Values valid in exactly one of both."""
        cells = self._cells_with(that).filter("_a <> _b")
        return self._with(cells.select(*self.keys, *self.bounds, *[F.when(F.col("_a"), _col(v)).otherwise(_col(f"_r_{w}")).alias(v) for v, w in zip(self.values, that.values, strict=True)])).coalesce()

    def is_subset_of(self, that: IntervalFrame) -> bool:
        """Whether that covers all this covers; values are no matter."""
        return self.difference(that).is_empty()

    def is_equivalent_to(self, that: IntervalFrame) -> bool:
        """Whether both hold the same value everywhere."""
        cells = self._cells_with(that)
        same = reduce(lambda a, b: a & b, [_col(v).eqNullSafe(_col(f"_r_{w}")) for v, w in zip(self.values, that.values, strict=True)], F.lit(True))
        return cells.filter((F.col("_a") != F.col("_b")) | ~same).isEmpty()

    # --- writes ---
    def set_many(self, rows: IntervalFrame, *, order: Column | None = None) -> IntervalFrame:
        """Overwrites in order, the last write wins; rows may overlap. order is a Column over rows' columns, by default the starts."""
        by = order if order is not None else F.struct(*[d.lo for d in self.dims])
        both = self.df.select(*self.keys, *self.bounds, *self.values, F.lit(0).alias("_w"), F.lit(None).alias("_s")).unionByName(
            rows.df_full.select(*self.keys, *self.bounds, *self.values, F.lit(1).alias("_w"), by.alias("_s"))
        )
        cells = self._nested(both, others=[rows]).groupBy(*self.keys, *self.bounds).agg(F.max_by(F.struct(*self.values), F.struct("_w", "_s")).alias("_v"))
        return self._with(cells.select(*self.keys, *self.bounds, *[F.col("_v")[v].alias(v) for v in self.values])).coalesce()

    @property
    def df_full(self) -> DataFrame:
        """The frame's table with further columns, if set_many's rows carry an order."""
        return getattr(self, "_full", self.df)

    def carrying(self, df: DataFrame) -> IntervalFrame:
        """The same frame with a table that has further columns, for orders of writes."""
        self._full = df
        return self

    def _one(self, box: Box | Span, value) -> IntervalFrame:
        """A row for every key."""
        given = value if isinstance(value, tuple) and len(self.values) > 1 else (value,)
        base = self.df.select(*self.keys).distinct() if self.keys else self.spark.range(1).select()
        types = dict(self.df.dtypes)
        cols = [F.lit(x).cast(types[v]).alias(v) for v, x in zip(self.values, given, strict=True)] if self.values else []
        return self._with(base.select(*self.keys, *self._set(_boxed(box)), *cols))

    def set(self, box: Box | Span, value) -> IntervalFrame:
        return self.set_many(self._one(box, value))

    def set_if_no_conflict(self, box: Box | Span, value) -> IntervalFrame | None:
        """Set where nothing is valid yet in the box; None on conflict."""
        return None if self.intersects_box(box) else self._with(self.df.unionByName(self._one(box, value).df)).coalesce()

    def _pieces(self, box: Box) -> tuple[DataFrame, list[str]]:
        """Rows cut along a box's faces, with whether the piece lies inside; rows that don't meet the box stay whole."""
        lit = self._literal(box)
        out = self.df.withColumn("_in", intersects(self.box(), lit))
        for d, s in zip(self.dims, lit, strict=True):
            a, b = _col(d.lo), _col(d.hi)
            three = F.array(
                F.struct(a.alias("lo"), F.least(b, s.lo).alias("hi"), F.lit(False).alias("in")),
                F.struct(F.greatest(a, s.lo).alias("lo"), F.least(b, s.hi).alias("hi"), F.lit(True).alias("in")),
                F.struct(F.greatest(a, s.hi).alias("lo"), b.alias("hi"), F.lit(False).alias("in")),
            )
            whole = F.array(F.struct(a.alias("lo"), b.alias("hi"), F.lit(False).alias("in")))
            parts = F.when(F.col("_in"), F.filter(three, lambda p: p["lo"] < p["hi"])).otherwise(whole)
            out = out.withColumn("_p", F.explode(parts)).withColumns({d.lo: F.col("_p.lo"), d.hi: F.col("_p.hi"), "_in": F.col("_in") & F.col("_p.in")}).drop("_p")
        return out

    def update(self, box: Box | Span, value) -> IntervalFrame:
        """A new value where something is valid in the box; value is a constant, a tuple of them, or Columns."""
        given = value if isinstance(value, tuple) else (value,)
        cut = self._pieces(_boxed(box))
        new = [F.when(F.col("_in"), x if isinstance(x, Column) else F.lit(x)).otherwise(_col(v)).cast(dict(self.df.dtypes)[v]).alias(v) for v, x in zip(self.values, given, strict=True)]
        return self._with(cut.select(*self.keys, *self.bounds, *new)).coalesce()

    def remove(self, box: Box | Span) -> IntervalFrame:
        return self._with(self._pieces(_boxed(box)).filter("not _in")).coalesce()

    def remove_many(self, boxes: IntervalFrame) -> IntervalFrame:
        return self.difference(boxes)

    def remove_value(self, value) -> IntervalFrame:
        return self._with(self.df.filter(~self._is(value)))

    def remove_by_key(self, *start, missing: str = "error") -> IntervalFrame:
        """Deletes the row that starts exactly there."""
        here = self._starts(start)
        if missing == "error" and self.df.filter(here).isEmpty():
            raise KeyError(start)
        return self._with(self.df.filter(~here))

    def _starts(self, start: tuple) -> Column:
        return reduce(lambda a, b: a & b, [_col(d.lo) == d.column(d.start(p)) for d, p in zip(self.dims, start, strict=True)])

    def replace(self, old_start: tuple, box: Box | Span, value) -> IntervalFrame:
        """Deletes a row by its start, then sets another."""
        return self.remove_by_key(*old_start).set(box, value)

    def fill(self, box: Box | Span, value) -> IntervalFrame:
        """The value where nothing is valid in the box, for every key."""
        one = self._one(box, value)
        gaps = one.difference(self)
        return self._with(self.df.unionByName(gaps.df)).coalesce()

    def merge(self, that: IntervalFrame, combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> IntervalFrame:
        """Values combined on overlaps (this one's by default), taken from either side elsewhere."""
        cells = self._cells_with(that)
        pick = [
            F.when(F.col("_a") & F.col("_b"), (combine or {}).get(v, lambda x, y: x)(_col(v), _col(f"_r_{w}"))).when(F.col("_a"), _col(v)).otherwise(_col(f"_r_{w}")).alias(v)
            for v, w in zip(self.values, that.values, strict=True)
        ]
        return self._with(cells.select(*self.keys, *self.bounds, *pick)).coalesce()

    def merge_many(self, rows: IntervalFrame, aggregate: dict[str, Callable[[Column], Column]]) -> IntervalFrame:
        """Rows that may overlap one another and this, combined by an aggregate of each value (F.sum, F.max, ...)."""
        cells = self._nested(self.df.unionByName(rows.df), others=[rows])
        return self._with(cells.groupBy(*self.keys, *self.bounds).agg(*[aggregate[v](_col(v)).alias(v) for v in self.values])).coalesce()

    def merge_fold(self, rows: IntervalFrame, op: Callable[[Column, Column], Column], *, order: Column | None = None) -> IntervalFrame:
        """Like merge_many by a left fold of op over the one value, in order; for operations whose order matters."""
        v = self.values[0]
        by = order if order is not None else F.struct(*[_col(d.lo).alias(f"o{k}") for k, d in enumerate(self.dims)])
        both = self.df.withColumn("_s", F.struct(F.lit(0).alias("w"), F.lit(None).alias("s"))).unionByName(rows.df_full.select(*self.columns, F.struct(F.lit(1).alias("w"), by.alias("s")).alias("_s")))
        if self.keys:
            # a place for each row in its key's order: pieces are then put in order by a number, not by structs in structs
            both = meeting.together(both, self.keys).withColumn("_s", F.row_number().over(Window.partitionBy(*self.keys).orderBy("_s", v)))
        listed = self._nested(both, others=[rows]).groupBy(*self.keys, *self.bounds).agg(F.transform(F.sort_array(F.collect_list(F.struct("_s", v))), lambda x: x[v]).alias("_l"))
        return self._with(listed.withColumn(v, F.aggregate(F.slice("_l", 2, F.size("_l")), F.element_at("_l", 1), op))).coalesce()

    # --- differences as actions ---
    def diff_actions_from(self, old: IntervalFrame) -> DataFrame:
        """What turns old into this, by start: (action, keys, bounds, values); bounds' ends and values are null for Delete."""
        start = [*self.keys, *[d.lo for d in self.dims]]
        new = self.df.withColumn("_n", F.lit(True))
        was = old.df.select(*[_col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_o"))
        both = new.join(was, reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_o_{c}")) for c in start]), "full_outer")
        rest = [c for c in self.columns if c not in start]
        same = reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_o_{c}")) for c in rest], F.lit(True))
        action = F.when(F.col("_o").isNull(), "Create").when(F.col("_n").isNull(), "Delete").when(~same, "Update")
        return both.select(action.alias("action"), *[F.coalesce(_col(c), _col(f"_o_{c}")).alias(c) if c in start else _col(c) for c in self.columns]).filter("action is not null")

    def signed_changes_from(self, old: IntervalFrame, *, sign: str = "sign") -> DataFrame:
        """What came (1) and what went (-1) since old, by start: (keys, bounds, values, sign). A new row came, a deleted one went, one of another value did both; of a row of one dimension that only got another end, the stretch between both ends. Measures by value of what came, less of what went, are those of this less those of old."""
        start = [*self.keys, *[d.lo for d in self.dims]]
        rest = [c for c in self.columns if c not in start]
        new = self.df.select(*[_col(c) for c in start], F.struct(*[_col(c) for c in self.columns]).alias("_new"))
        was = old.df.select(*[_col(c).alias(f"_o_{c}") for c in start], F.struct(*[_col(c) for c in self.columns]).alias("_old"))
        both = new.join(was, reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_o_{c}")) for c in start]), "full_outer")
        a, b = F.col("_new"), F.col("_old")

        def row(x: Column, n: int, **change: Column) -> Column:
            return F.struct(*[change.get(c, x[c]).alias(c) for c in self.columns], F.lit(n).alias(sign))

        def alike(names: Iterable[str]) -> Column:
            return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names], F.lit(True))

        rows = F.when(b.isNull(), F.array(row(a, 1))).when(a.isNull(), F.array(row(b, -1))).when(~alike(rest), F.array(row(b, -1), row(a, 1)))
        if len(self.dims) == 1:
            d = self.dims[0]
            longer = F.when(a[d.hi] > b[d.hi], F.array(row(a, 1, **{d.lo: b[d.hi]}))).when(a[d.hi] < b[d.hi], F.array(row(b, -1, **{d.lo: a[d.hi]})))
            rows = F.when(a.isNotNull() & b.isNotNull() & alike(self.values), longer).otherwise(rows)
        return both.select(F.explode(rows).alias("_r")).select("_r.*")

    def apply_diff_actions(self, actions: DataFrame) -> IntervalFrame:
        """Upserts and deletes by start, as they are."""
        start = [*self.keys, *[d.lo for d in self.dims]]
        touched = actions.select(*[_col(c).alias(f"_t_{c}") for c in start])
        kept = self.df.join(touched, reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_t_{c}")) for c in start]), "left_anti")
        return self._with(kept.unionByName(actions.filter("action <> 'Delete'").select(*self.columns)))

    def sync_with(self, that: IntervalFrame) -> IntervalFrame:
        return self.apply_diff_actions(that.diff_actions_from(self))

    # --- dimensions ---
    def slice_at(self, name: str, point) -> IntervalFrame:
        """What is valid at a point of one dimension, without that dimension ("as of")."""
        d = next(x for x in self.dims if x.name == name)
        rest = tuple(x for x in self.dims if x is not d)
        return self._with(self.df.filter(d.covers(_col(d.lo), _col(d.hi), point)), dims=rest).coalesce()

    def drop_dimension(self, name: str) -> IntervalFrame:
        return self._with(self.df, dims=tuple(d for d in self.dims if d.name != name))

    def collapse(self, name: str, aggregate: dict[str, Callable[[Column], Column]]) -> IntervalFrame:
        """Projects a dimension away, combining what then overlaps."""
        flat = self.drop_dimension(name)
        return flat._with(flat.df.limit(0)).merge_many(flat, aggregate)

    def collapse_fold(self, name: str, op: Callable[[Column, Column], Column]) -> IntervalFrame:
        """collapse by a left fold in start order."""
        flat = self.drop_dimension(name).carrying(self.df)
        return flat._with(flat.df.limit(0)).merge_fold(flat, op, order=F.struct(*[_col(d.lo).alias(f"o{k}") for k, d in enumerate(self.dims)]))

    def flatten(self, name: str) -> Shape:
        """The region covered at any point of a dimension."""
        return Shape(self.drop_dimension(name).df, [d for d in self.dims if d.name != name], (), self.keys).recompress_all()

    def extrude(self, at: int, extent: Span) -> IntervalFrame:
        """A new dimension with the same extent everywhere."""
        d = extent.dim
        df = self.df.withColumns({d.lo: d.column(extent.lo), d.hi: d.column(extent.hi)})
        return self._with(df, dims=(*self.dims[:at], d, *self.dims[at:]))

    def swap(self, i: int, j: int) -> IntervalFrame:
        dims = list(self.dims)
        dims[i], dims[j] = dims[j], dims[i]
        return self._with(self.df, dims=tuple(dims))

    def cross(self, that: IntervalFrame) -> IntervalFrame:
        """All pairs of boxes of two structures of different dimensions (keys must match)."""
        df = self.df.join(that.df, list(self.keys)) if self.keys else self.df.crossJoin(that.df)
        return IntervalFrame(df, (*self.dims, *that.dims), (*self.values, *that.values), self.keys)

    def update_dimension(self, name: str, extent: Span) -> IntervalFrame:
        d = next(x for x in self.dims if x.name == name)
        return self._with(self.df.withColumns({d.lo: d.column(extent.lo), d.hi: d.column(extent.hi)}))

    # --- affine ---
    def _moved(self, f: Callable[[Span], Span], *, coalesce: bool = True) -> IntervalFrame:
        return self.map_intervals({d: (s.lo, s.hi) for d, s in ((d, f(s)) for d, s in zip(self.dims, self.box(), strict=True))}, coalesce=coalesce)

    def displaced(self, *by) -> IntervalFrame:
        amount = dict(zip([d.name for d in self.dims], by, strict=True))
        return self._moved(lambda s: displaced(s, amount[s.dim.name]))

    def displaced_in(self, name: str, by) -> IntervalFrame:
        return self._moved(lambda s: displaced(s, by) if s.dim.name == name else s)

    def reflected(self, *pivot) -> IntervalFrame:
        at = dict(zip([d.name for d in self.dims], pivot, strict=True))
        return self._moved(lambda s: reflected(s, at[s.dim.name]))

    def scaled(self, center: tuple, by: tuple) -> IntervalFrame:
        """Scaled rows; where rounding makes them overlap, the row of the later start wins."""
        at = {d.name: (c, b) for d, c, b in zip(self.dims, center, by, strict=True)}
        moved = {d: (s.lo, s.hi) for d, s in ((d, scaled(s, *at[d.name])) for d, s in zip(self.dims, self.box(), strict=True))}
        order = [_col(d.lo).alias(f"_o{k}") for k, d in enumerate(self.dims)]
        df = self.df.select(*self.keys, *self.values, *order, *[c for d, (a, b) in moved.items() for c in (a.alias(d.lo), b.alias(d.hi))])
        df = df.filter(reduce(lambda x, y: x & y, [_col(d.lo) < _col(d.hi) for d in moved]))
        rows = self._with(df).carrying(df)
        return rows._with(rows.df.limit(0)).set_many(rows, order=F.struct(*[f"_o{k}" for k in range(len(self.dims))]))

    def reflected_in(self, name: str, pivot) -> IntervalFrame:
        """Reflected along one dimension."""
        return self._moved(lambda s: reflected(s, pivot) if s.dim.name == name else s)

    def scaled_in(self, name: str, center, by: float) -> IntervalFrame:
        """Scaled along one dimension."""
        origin = lambda d: center if d.name == name else _origin(d)
        return self.scaled(tuple(origin(d) for d in self.dims), tuple(by if d.name == name else 1 for d in self.dims))

    def measured(self, name: str = "measure") -> DataFrame:
        """Rows with the measure of their box (null if unbounded)."""
        from ..functions.cuts import measure

        return self.df.withColumn(name, measure(self.box()))

    def map_reduce_measure(self, aggregate: Callable[[Column], Column] = F.sum, f: Callable[[Column], Column] = lambda m: m) -> DataFrame:
        """The reduced measures of each key's rows."""
        return self.measured("_m").groupBy(*self.keys).agg(aggregate(f(F.col("_m"))).alias("measure"))

    def covered_measure(self) -> DataFrame:
        """The measure of what each key's rows cover, however often: of the canonical region."""
        return self._region().recompress_all().map_reduce_measure()

    def convolved_in(self, name: str, kernel: list[tuple[Span, float]], center, epsilon: float, *, discrete_step: bool = True) -> IntervalFrame:
        """Riemann-sum convolution along a dimension of one numeric value: for each kernel piece and step, the rows moved by the offset from the centre, times value and step, added up."""
        from ..functions.cuts import steps

        d = next(x for x in self.dims if x.name == name)
        v = self.values[0]
        parts = []
        for span, k in kernel:
            for offset, size in steps(d.minus(span.lo, d.start(center)), d.minus(span.hi, d.start(center)), epsilon):
                parts.append((-offset, float(k) * abs(size)))  # a kernel's value left of the centre carries the signal to the right
        table = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in parts])
        spread = self.df.withColumn("_k", F.explode(table))
        moved = displaced(Span(d, _col(d.lo), _col(d.hi)), F.col("_k.o"))
        rows = spread.withColumns({d.lo: moved.lo, d.hi: moved.hi, v: _col(v) * F.col("_k.w")})
        base = self._with(rows.limit(0))
        return base.merge_many(self._with(rows), {v: F.sum})


    def convolved_running(self, name: str, kernel: list[tuple[Span, int]], center) -> IntervalFrame:
        """convolved_in of a discrete dimension by steps of one, for whole values and weights: a kernel piece is the difference of the signal's running sum at two shifts, so a row makes four events a piece however wide the piece is. Between two events the result is a straight line: one row where it is level, one a step where it climbs."""
        d = next(x for x in self.dims if x.name == name)
        v, same = self.values[0], [*self.keys, *[c for x in self.dims if x is not d for c in (x.lo, x.hi)]]
        events = []
        for span, k in kernel:
            first, last = d.minus(span.lo, d.start(center)), d.minus(span.hi, d.start(center))
            # the kernel's weight at an offset carries the signal from there to the centre
            for cut, sign in ((d.lo, 1), (d.hi, -1)):
                for shift, way in ((first, 1), (last, -1)):
                    moved = displaced(Span(d, _col(cut), _col(cut)), F.lit(-shift)).lo
                    events.append(F.struct(moved.alias("c"), (_col(v) * (-sign * way * k)).alias("x"), F.lit(-sign * way).alias("n")))
        at = self.df.select(*same, F.explode(F.array(*events)).alias("e")).groupBy(*same, F.col("e.c").alias("_c")).agg(F.sum("e.x").alias("_x"), F.sum("e.n").alias("_n"))
        w = Window.partitionBy(*same, *([] if same else [F.lit(0)])).orderBy("_c")
        run = at.select(*same, "_c", F.lead("_c").over(w).alias("_to"), F.sum("_x").over(w).alias("_x"), F.sum("_n").over(w).alias("_n")).filter("_to is not null")
        long = d.minus(F.col("_to"), F.col("_c"))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        run = run.withColumn("_long", long).withColumns({"_y": F.coalesce(F.sum(F.col("_x") * F.col("_long")).over(before), F.lit(0)), "_m": F.coalesce(F.sum(F.col("_n") * F.col("_long")).over(before), F.lit(0))})
        level = (F.col("_x") == 0) & (F.col("_n") == 0)
        steps = F.when(level, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (F.col("_long") - 1).cast("bigint")))
        out = run.withColumn("_i", F.explode(steps)).withColumn("_at", displaced(Span(d, F.col("_c"), F.col("_c")), F.col("_i")).lo)
        out = out.withColumns({v: F.col("_y") + F.col("_x") * F.col("_i"), "_m": F.col("_m") + F.col("_n") * F.col("_i")}).filter("_m > 0")
        end = F.when(level, F.col("_to")).otherwise(displaced(Span(d, F.col("_at"), F.col("_at")), F.lit(1)).lo)
        return self._with(out.select(*same, F.col("_at").alias(d.lo), end.alias(d.hi), v)).coalesce()


class Shape(IntervalFrame):
    """A region: boxes without values, with Boolean algebra, topology and morphology. Keys make it many regions."""

    def __init__(self, df: DataFrame, dims: Iterable[Dim], values: Iterable[str] = (), keys: Iterable[str] = (), *, hot: tuple = ()):
        super().__init__(df, dims, (), keys, hot=hot)

    @classmethod
    def of_boxes(cls, spark: SparkSession, dims: Iterable[Dim], boxes: Iterable[Box | Span], *, check: bool = False) -> Shape:
        out = cls.of(spark, dims, [(b,) for b in boxes], (), ())
        if check and not out.is_disjoint():
            raise ValueError("boxes overlap")
        return out

    @classmethod
    def universe(cls, spark: SparkSession, dims: Iterable[Dim]) -> Shape:
        dims = tuple(dims)
        return cls.of_boxes(spark, dims, [[unbounded(d) for d in dims]])

    def union(self, that: IntervalFrame) -> Shape:
        return Shape(self.df.unionByName(that.df.select(*self.columns)), self.dims, (), self.keys).recompress_all()

    def _split_once(self) -> Shape:
        return self._with(self._nested(self.df).distinct())

    def recompress_all(self, *grid: IntervalFrame) -> Shape:
        """The canonical region; in one dimension islands alone do it."""
        if len(self.dims) == 1 and not grid:
            return self.coalesce()
        if grid:
            return Shape(self.decompressed(*grid).df.distinct(), self.dims, (), self.keys).coalesce()
        return self._split_once().coalesce()

    def intersection(self, that: IntervalFrame) -> Shape:
        return self.intersection_shape(that)

    def complement(self) -> Shape:
        """What a key's region doesn't cover; keys without rows aren't known here."""
        if len(self.dims) == 1:
            return self._gaps()
        cells = self._cells_with(self, universe=True).filter("not _a")
        return self._with(cells).coalesce()

    def _gaps(self) -> Shape:
        """One dimension: gaps between islands by a window, and the two outer ends."""
        d, flat = self.dims[0], self.coalesce().df
        w = (Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))).orderBy(d.lo)
        ends = flat.select(*self.keys, F.coalesce(F.lag(d.hi).over(w), d.column(d.first)).alias("_a"), _col(d.lo).alias("_b"), F.when(F.lead(d.lo).over(w).isNull(), _col(d.hi)).alias("_c"))
        pairs = F.array(F.struct(F.col("_a").alias("lo"), F.col("_b").alias("hi")), F.struct(F.col("_c").alias("lo"), d.column(d.last).alias("hi")))
        out = ends.select(*self.keys, F.explode(pairs).alias("p")).select(*self.keys, F.col("p.lo").alias(d.lo), F.col("p.hi").alias(d.hi))
        out = Shape(out.filter(_col(d.lo) < _col(d.hi)), self.dims, (), self.keys)
        if not self.keys and self.df.isEmpty():
            return Shape.universe(self.spark, self.dims)
        return out

    def symmetric_difference(self, that: IntervalFrame) -> Shape:
        return Shape(self._cells_with(that).filter("_a <> _b"), self.dims, (), self.keys).coalesce()

    def difference(self, that: IntervalFrame) -> Shape:
        return Shape(self._cells_with(that).filter("_a and not _b"), self.dims, (), self.keys).coalesce()

    def add(self, box: Box | Span) -> Shape:
        return self.union(self._one(box, ()))

    def add_many(self, boxes: IntervalFrame) -> Shape:
        return self.union(boxes)

    def add_if_no_conflict(self, box: Box | Span) -> Shape | None:
        return None if self.intersects_box(box) else self.add(box)

    def _one(self, box: Box | Span, value=()) -> Shape:
        base = self.df.select(*self.keys).distinct() if self.keys else self.spark.range(1).select()
        return Shape(base.select(*self.keys, *self._set(_boxed(box))), self.dims, (), self.keys)

    def remove(self, box: Box | Span) -> Shape:
        return self.difference(self._one(box))

    def contains_point(self, *point) -> bool:
        return self.is_defined_at(*point)

    def contains_box(self, box: Box | Span) -> bool:
        return self._one(box).difference(self).is_empty()

    def intersects_shape(self, that: IntervalFrame) -> bool:
        return not self._joined(that).isEmpty()

    def is_equivalent_to(self, that: IntervalFrame) -> bool:
        return self._cells_with(that).filter("_a <> _b").isEmpty()

    def is_universe(self) -> bool:
        return not self.is_empty() and self.complement().is_empty()

    # --- topology ---
    def touches_shape(self, that: IntervalFrame) -> bool:
        """Whether any two rows touch (adjacent, with all other dimensions overlapping or adjacent) and none overlap."""
        return self._touching(that, touches)

    def is_connected_to(self, that: IntervalFrame) -> bool:
        return self._touching(that, touches) or self.intersects_shape(that)

    def _touching(self, that: IntervalFrame, test) -> bool:
        return not self._joined(that, test=test).isEmpty()

    def relation_with(self, that: Shape) -> str:
        """RCC-8 between two regions: counts of cells in neither, either and both decide, and whether edges meet."""
        n = self._cells_with(that).agg(
            F.count_if(F.expr("_a and not _b")).alias("a"), F.count_if(F.expr("_b and not _a")).alias("b"), F.count_if(F.expr("_a and _b")).alias("both"),
        ).first()
        a, b, both = n["a"] or 0, n["b"] or 0, n["both"] or 0
        if not both:
            return "EC" if (a and b and self.touches_shape(that)) else "DC"
        if not a and not b:
            return "EQ"
        if a and b:
            return "PO"
        inner, outer, names = (self, that, ("TPP", "NTPP")) if b else (that, self, ("TPPi", "NTPPi"))
        return names[0] if inner.touches_shape(outer.complement()) else names[1]

    def relations(self, that: Shape) -> DataFrame:
        """(keys, relation): RCC-8 between the two regions of each key that either has. Cells in one, the other and both decide; where they share no cell, or one holds the other, touching rows tell whether edges meet."""
        flags = self._cells_with(that).groupBy(*self.keys).agg(
            F.count_if(F.expr("_a and not _b")).alias("_na"), F.count_if(F.expr("_b and not _a")).alias("_nb"), F.count_if(F.expr("_a and _b")).alias("_both"),
        )

        def touching(x: Shape, y: Shape, name: str) -> DataFrame:
            return x._joined(y, test=touches).select(*[_col(k).alias(f"_{name}_{k}") for k in self.keys], F.lit(True).alias(name)).distinct()

        for name, x, y in (("edge", self, that), ("inner", self, that.complement()), ("outer", that, self.complement())):
            more = touching(x, y, name)
            flags = flags.join(more, reduce(lambda p, q: p & q, [_col(k).eqNullSafe(_col(f"_{name}_{k}")) for k in self.keys], F.lit(True)), "left").drop(*[f"_{name}_{k}" for k in self.keys])
        relation = (
            F.when(F.col("_both") == 0, F.when(F.col("edge") & (F.col("_na") > 0) & (F.col("_nb") > 0), "EC").otherwise("DC"))
            .when((F.col("_na") == 0) & (F.col("_nb") == 0), "EQ").when((F.col("_na") > 0) & (F.col("_nb") > 0), "PO")
            .when(F.col("_nb") > 0, F.when(F.col("inner"), "TPP").otherwise("NTPP")).otherwise(F.when(F.col("outer"), "TPPi").otherwise("NTPPi"))
        )
        return flags.select(*self.keys, relation.alias("relation"))

    def components(self) -> DataFrame:
        """Rows with `component`, a number for each connected part of a key. In one dimension islands are the parts: windows alone. In several, boxes are joined inside tiles, and tiles by the boxes that cross their borders (see `tiles`)."""
        if len(self.dims) == 1:
            return self._islands(self.df, self.dims[0], list(self.keys), name="component")
        return tiles.components(self.df, list(self.dims), list(self.keys), skewed=self.skewed)

    def contiguous_subshapes(self) -> Shape:
        """The connected parts as one table of regions: `component` is a further key."""
        return Shape(self.components(), self.dims, (), (*self.keys, "component"))

    def flat_map(self, rows: Column) -> Shape:
        """Each box becomes the structs of an array (bounds by name), perhaps overlapping."""
        df = self.df.select(*self.keys, F.explode(rows).alias("_r")).select(*self.keys, *[F.col("_r")[n].alias(n) for n in self.bounds])
        return Shape(df, self.dims, (), self.keys).recompress_all()

    def collect(self, defined: Column, dims: dict[Dim, tuple[Column, Column]] | None = None) -> Shape:
        """Boxes where the test holds, perhaps with new cuts."""
        out = Shape(self.df.filter(defined), self.dims, (), self.keys)
        return (out.map_intervals(dims, coalesce=False) if dims else out).recompress_all()

    def is_contiguous(self) -> bool:
        return self.components().select("component").distinct().count() == 1

    def cavities(self) -> DataFrame:
        """Rows of the bounded connected parts of the complement, with their component."""
        rows = self.complement().components()
        edge = reduce(lambda a, b: a | b, [s.dim.is_first(s.lo) | s.dim.is_last(s.hi) for s in self.box()])
        open_ = rows.groupBy(*self.keys, "component").agg(F.max(edge).alias("_open")).filter("not _open")
        return rows.join(open_.drop("_open"), [*self.keys, "component"]).select(*self.columns, "component")

    def is_solid(self) -> bool:
        return self.is_contiguous() and self.cavities().isEmpty()

    def topology(self) -> DataFrame:
        """Per key: whether its region is contiguous, its number of cavities, whether it is solid (contiguous, without cavities) and whether it is bounded."""
        edge = reduce(lambda a, b: a | b, [s.dim.is_first(s.lo) | s.dim.is_last(s.hi) for s in self.box()])
        whole = self.components().groupBy(*self.keys).agg((F.count_distinct("component") == 1).alias("contiguous"), (~F.max(edge)).alias("bounded"))
        holes = self.cavities().groupBy(*[_col(k).alias(f"_h_{k}") for k in self.keys]).agg(F.count_distinct("component").alias("_n"))
        on = reduce(lambda a, b: a & b, [_col(k).eqNullSafe(_col(f"_h_{k}")) for k in self.keys], F.lit(True))
        n = F.coalesce("_n", F.lit(0)).alias("cavities")
        return whole.join(holes, on, "left").select(*self.keys, "contiguous", n, (F.col("contiguous") & (F.coalesce("_n", F.lit(0)) == 0)).alias("solid"), "bounded")

    def is_bounded(self) -> bool:
        return self.df.filter(reduce(lambda a, b: a | b, [s.dim.is_first(s.lo) | s.dim.is_last(s.hi) for s in self.box()])).isEmpty()

    # --- morphology ---
    def dilated(self, *probes: Probe) -> Shape:
        by = {p.span.dim.name: p for p in probes}
        return self._moved(lambda s: dilated(s, by[s.dim.name]), coalesce=False).recompress_all()

    def eroded(self, *probes: Probe) -> Shape:
        """The complement of the complement dilated by the reflected probe."""
        if len(self.dims) == 1:
            flat = self.coalesce()
            by = {p.span.dim.name: p for p in probes}
            return flat._moved(lambda s: eroded(s, by[s.dim.name]))
        return self.complement().dilated(*[p.reflected() for p in probes]).complement()

    def opening(self, *probes: Probe) -> Shape:
        return self.eroded(*probes).dilated(*probes)

    def closing(self, *probes: Probe) -> Shape:
        return self.dilated(*probes).eroded(*probes)

    def gradient(self, *probes: Probe) -> Shape:
        return self.dilated(*probes).difference(self.eroded(*[p.reflected() for p in probes]))

    def white_top_hat(self, *probes: Probe) -> Shape:
        return self.difference(self.opening(*probes))

    def black_top_hat(self, *probes: Probe) -> Shape:
        return self.closing(*probes).difference(self)

    def bounding_shape(self, *thickness) -> Shape:
        """The outer shell of a thickness."""
        by = dict(zip([d.name for d in self.dims], thickness, strict=True))
        return self._moved(lambda s: padded(s, by[s.dim.name]), coalesce=False).recompress_all().symmetric_difference(self)


class Multi(IntervalFrame):
    """Several values valid at once: one sorted array column, never empty."""

    @classmethod
    def from_single(cls, rows: IntervalFrame) -> Multi:
        """From rows of single values that may overlap."""
        v = rows.values[0]
        cells = rows._nested(rows.df).groupBy(*rows.keys, *rows.bounds).agg(F.array_sort(F.collect_set(v)).alias(v))
        return cls(cells, rows.dims, rows.values, rows.keys).on_keys(skewed=rows.skewed).coalesce()

    @classmethod
    def from_writes(cls, rows: IntervalFrame, add: Column, order: Column) -> Multi:
        """addOne and removeOne of single values, many at once: rows (which may overlap) add their value where `add` holds and take it away otherwise, in order. add and order are Columns over rows' table; rows that it doesn't say to add take away."""
        v = rows.values[0]
        done = rows.df_full.select(*rows.keys, *rows.bounds, v, F.coalesce(add, F.lit(False)).alias("_in"), F.struct(order.alias("o")).alias("_at"))
        flags = IntervalFrame(done, rows.dims, ("_in",), (*rows.keys, v))
        last = flags._with(flags.df.select(*flags.columns).limit(0)).set_many(flags.carrying(done), order=F.col("_at"))
        return cls.from_single(IntervalFrame(last.df.filter("_in"), rows.dims, (v,), rows.keys))

    def single(self) -> IntervalFrame:
        """One row per element, coalesced."""
        v = self.values[0]
        return IntervalFrame(self.df.withColumn(v, F.explode(v)), self.dims, self.values, self.keys).on_keys(skewed=self.skewed).coalesce()

    def values_one(self) -> DataFrame:
        return self.df.select(F.explode(self.values[0]).alias(self.values[0])).distinct()

    def intervals_one(self, element) -> Shape:
        return Shape(self.df.filter(F.array_contains(self.values[0], F.lit(element))), self.dims, (), self.keys).coalesce()

    def add_one(self, box: Box | Span, element) -> Multi:
        return self.union(self._one(box, [element]))

    def remove_one(self, box: Box | Span, element) -> Multi:
        v = self.values[0]
        out = self._pieces(_boxed(box)).withColumn(v, F.when(F.col("_in"), F.array_remove(v, F.lit(element))).otherwise(_col(v)))
        return self._with(out.filter(F.size(v) > 0)).coalesce()

    def union(self, that: Multi) -> Multi:
        return self.merge(that, {self.values[0]: lambda a, b: F.array_sort(F.array_union(a, b))})

    def intersection(self, that: Multi) -> Multi:
        """Elements valid in both; not coalesced."""
        z = self.zip(that)
        a, b = z.values
        return self._with(z.df.withColumn(a, F.array_sort(F.array_intersect(a, b))).filter(F.size(a) > 0))

    def flatten(self, name: str) -> Multi:
        return Multi.from_single(IntervalFrame(self.single().df, [d for d in self.dims if d.name != name], self.values, self.keys))


class Monoid(IntervalFrame):
    """Values with an identity and an associative, commutative aggregate, such as sum or max."""

    def __init__(self, df, dims, values=("value",), keys=(), *, hot=(), aggregate: Callable[[Column], Column] = F.sum, identity: Any = 0):
        self.aggregate, self.identity = aggregate, identity
        super().__init__(df, dims, values, keys, hot=hot)

    def _with(self, df: DataFrame, **change) -> Monoid:
        out = Monoid(df, change.get("dims", self.dims), change.get("values", self.values), change.get("keys", self.keys), hot=self.hot, aggregate=self.aggregate, identity=self.identity)
        return out.on_keys(skewed=self.skewed)

    def union(self, that: IntervalFrame) -> Monoid:
        return self.merge_many(that, {v: self.aggregate for v in self.values})

    def intersection(self, that: IntervalFrame, op: Callable[[Column, Column], Column]) -> Monoid:
        """Combined where both are valid; not coalesced."""
        z = self.zip(that)
        a, b = z.values
        return self._with(z.df.withColumn(a, op(F.col(a), F.col(b))))

    def complement(self) -> Monoid:
        """The void with the identity as its value."""
        void = self._region().complement()
        return self._with(void.df.withColumn(self.values[0], F.lit(self.identity).cast(dict(self.df.dtypes)[self.values[0]])))

    def flatten(self, name: str) -> Monoid:
        return self.collapse(name, {v: self.aggregate for v in self.values})

    @classmethod
    def universe(cls, spark: SparkSession, dims: Iterable[Dim], identity, value_type: str, *, of: DataFrame | None = None) -> Monoid:
        """The identity everywhere; `of` has the keys of the structures, one without keys by default."""
        if of is not None:
            base = IntervalFrame.from_df(of.distinct().withColumn("value", F.lit(identity).cast(value_type)), {d: (BOTTOM, TOP) for d in dims}, keys=of.columns)
            return cls(base.df, base.dims, keys=base.keys, identity=identity)
        base = IntervalFrame.of_value(spark, dims, identity, value_type)
        return cls(base.df, base.dims, identity=identity)


def sweep_sum(rows: IntervalFrame) -> Monoid:
    """Sums of overlapping one-dimensional rows by a sweep: a delta at each cut, added up along it. No join, one shuffle by key."""
    (d,), (v,) = rows.dims, rows.values
    ends = rows.df.select(*rows.keys, F.explode(F.array(F.struct(_col(d.lo).alias("c"), _col(v).alias("x"), F.lit(1).alias("n")), F.struct(_col(d.hi).alias("c"), (-_col(v)).alias("x"), F.lit(-1).alias("n")))).alias("e"))
    at = ends.groupBy(*rows.keys, F.col("e.c").alias("_c")).agg(F.sum("e.x").alias("_x"), F.sum("e.n").alias("_n"))
    w = (Window.partitionBy(*rows.keys) if rows.keys else Window.partitionBy(F.lit(0))).orderBy("_c")
    run = at.select(*rows.keys, F.col("_c").alias(d.lo), F.lead("_c").over(w).alias(d.hi), F.sum("_x").over(w).alias(v), F.sum("_n").over(w).alias("_n"))
    return Monoid(run.filter("_n > 0"), rows.dims, rows.values, rows.keys).coalesce()


def timeline(df: DataFrame, dim: Dim, start: Column, value: Column, keys: Iterable[str], order: list[Column], name: str = "value") -> IntervalFrame:
    """set([start, +inf) -> value) row by row in order of start: each write lasts until the next start, and of equal starts the last in order stays. Windows only, one shuffle by key."""
    keys = list(keys)
    rows = df.select(*keys, start.alias("_s"), value.alias(name), F.struct(*order).alias("_o"))
    last = rows.groupBy(*keys, "_s").agg(F.max_by(F.struct(name), "_o").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_s")
    out = last.select(*keys, dim.column(dim.start(F.col("_s"))).alias(dim.lo), F.coalesce(dim.column(dim.start(F.lead("_s").over(w))), dim.column(dim.last)).alias(dim.hi), F.col("_v")[name].alias(name))
    return IntervalFrame(out, (dim,), (name,), keys).coalesce()


#: Rows of a keyless table that one task may work on.
ONE_TASK = 20_000


def _number(d: Dim, c: Column) -> Column:
    """A cut as a number, null if unbounded."""
    bounded = F.when(d.is_first(c) | d.is_last(c), F.lit(None)).otherwise(c)
    return d.minus(bounded, d.column(d.start(_origin(d)))).cast("double")


def _quantiles(df: DataFrame, d: Dim, cut: str) -> list[float] | None:
    """Numbers that deal a keyless table's cuts into as many ranges as a shuffle has partitions; None for a table so small that one task does."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n == 1:
        return None
    r = df.select(_number(d, _col(cut)).alias("x")).agg(F.count("x").alias("n"), F.percentile_approx("x", [k / n for k in range(1, n)], 100 * n).alias("q")).first()
    return sorted(set(r["q"])) if r["n"] > ONE_TASK else None


def _part_of(d: Dim, cut: str, cuts: list[float]) -> Column:
    """The number of the range that a cut falls into, in order; unbounded ones come first and last."""
    x = _number(d, _col(cut))
    return F.when(d.is_first(_col(cut)), F.lit(0)).when(x.isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= x)))


def _carried(dealt: DataFrame, same: list[str], each: Column, total: Callable[[Column], Column], name: str) -> DataFrame:
    """dealt with what an aggregate of all earlier ranges (`_part`) of equal `same` comes to: one row a range is gathered."""
    by = [*same, "_part"]
    sums = dealt.groupBy(*by).agg(each.alias(name)).select(*[_col(c).alias(f"_c_{c}") for c in by], name)
    order = Window.partitionBy(*[f"_c_{c}" for c in same], *([] if same else [F.lit(0)])).orderBy("_c__part")
    before = sums.withColumn(name, total(F.col(name)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return dealt.join(before, reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_c_{c}")) for c in by]), "left").drop(*[f"_c_{c}" for c in by])


def _segments(ends: DataFrame, d: Dim) -> DataFrame:
    """(_from, _to) between neighbouring cuts of a keyless table."""
    cuts = _quantiles(ends, d, "_from")
    if cuts is None:
        return ends.withColumn("_to", F.lead("_from").over(Window.partitionBy(F.lit(0)).orderBy("_from"))).filter("_to is not null")
    dealt = ends.withColumn("_part", _part_of(d, "_from", cuts))
    own = dealt.withColumn("_to", F.lead("_from").over(Window.partitionBy("_part").orderBy("_from")))
    firsts = dealt.groupBy("_part").agg(F.min("_from").alias("_first"))  # one row a range
    after = firsts.select(F.col("_part").alias("_p"), F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("_next"))
    return own.join(after, F.col("_part") == F.col("_p"), "left").select("_from", F.coalesce("_to", "_next").alias("_to")).filter("_to is not null")


def _bins(d: Dim, *tables: tuple[DataFrame, str, str]) -> tuple[float, float, int] | None:
    """Where bins of a dimension begin, the width of the narrowest and the number of levels, each four times as wide; None if nothing is bounded."""
    both = reduce(DataFrame.union, [t.select(_number(d, _col(lo)).alias("a"), _number(d, _col(hi)).alias("b")) for t, lo, hi in tables])
    r = both.agg(F.min(F.least("a", "b")).alias("a"), F.max(F.greatest("a", "b")).alias("b"), F.percentile_approx(F.col("b") - F.col("a"), 0.5).alias("w"), F.count("*").alias("n")).first()
    if r["a"] is None or r["b"] <= r["a"]:
        return None
    span = r["b"] - r["a"]
    width = max(r["w"] or 0, span / max(1, r["n"]), span / (1 << 24))
    return r["a"], width, max(1, math.ceil(math.log(span / width, 4)) + 1)


def _binned(left: DataFrame, a: tuple[str, str], right: DataFrame, b: tuple[str, str], d: Dim, bins: tuple[float, float, int]) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both tables in bins as wide as the wider of two rows, and the equalities to join them by: a row is at home on the level whose bins are as wide as it is, and a guest on the wider levels where rows of the other table are at home. Each pair meets once, in its first common bin."""
    low, width, levels = bins

    def level(lo: str, hi: str) -> Column:
        x, y = _number(d, _col(lo)), _number(d, _col(hi))
        fit = F.ceil(F.log(4.0, F.greatest(y - x, F.lit(width)) / width)).cast("int")
        return F.when(x.isNull() | y.isNull(), F.lit(levels)).otherwise(F.least(F.lit(levels), F.greatest(F.lit(0), fit)))

    rows = [left.withColumn("_l_level", level(*a)), right.withColumn("_s_level", level(*b))]
    homes = [[r[0] for r in t.select(n).distinct().collect()] for t, n in zip(rows, ("_l_level", "_s_level"), strict=True)]  # a number a level

    def placed(t: DataFrame, n: str, lo: str, hi: str, home: int, guest: int, others: list[int], least: int) -> DataFrame:
        at = lambda x, k: F.when(k == levels, F.lit(0)).otherwise(F.floor(F.coalesce(_number(d, _col(x)) - low, F.lit(0.0)) / (F.lit(width) * F.pow(F.lit(4.0), k)))).cast("bigint")
        visits = F.filter(F.lit(others or [-1]).cast("array<int>"), lambda k: k >= F.col(f"{n}_level") + least)
        stays = F.concat(F.array(F.struct(F.lit(home).alias("role"), F.col(f"{n}_level").alias("at"))), F.transform(visits, lambda k: F.struct(F.lit(guest).alias("role"), k.alias("at"))))
        out = t.withColumn(f"{n}_stay", F.explode(stays)).withColumn(f"{n}_first", at(lo, F.col(f"{n}_stay.at")))
        return out.withColumn(f"{n}_bin", F.explode(F.sequence(F.col(f"{n}_first"), at(hi, F.col(f"{n}_stay.at")))))

    x = placed(rows[0], "_l", *a, 1, 2, homes[1], 1)
    y = placed(rows[1], "_s", *b, 2, 1, homes[0], 0)
    return x, y, [F.col("_l_bin") == F.col("_s_bin"), F.col("_l_stay") == F.col("_s_stay"), F.col("_l_bin") == F.greatest("_l_first", "_s_first")]


def _cuts(d: Dim, by: list[str]) -> Column:
    """The cuts of a row's group in one dimension, gathered by a window: rows are shuffled by key once and not joined with themselves."""
    w = Window.partitionBy(*by)
    return F.concat(F.collect_set(d.lo).over(w), F.collect_set(d.hi).over(w))


def _gridded(rows: DataFrame, by: list[str], dims: tuple[Dim, ...], mine: str | None = None) -> DataFrame:
    """Rows on the grid of their group's cuts. A group is gathered, so that its cuts are put in order once and not for each row. mine: a flag of the rows that are wanted; the others give cuts only."""
    rest = [c for c in rows.columns if c not in by and c != mine]
    row = F.struct(*[_col(c) for c in rest])
    cuts = [F.concat(F.collect_set(d.lo), F.collect_set(d.hi)).alias(f"_c{i}") for i, d in enumerate(dims)]
    groups = rows.groupBy(*by).agg(F.collect_list(row if mine is None else F.when(_col(mine), row)).alias("_rows"), *cuts)
    groups = groups.select(*by, "_rows", *[_in_order(f"_c{i}").alias(f"_c{i}") for i in range(len(dims))])
    out = groups.select(*by, F.explode("_rows").alias("_r"), *[f"_c{i}" for i in range(len(dims))]).select(*by, *[F.col("_r")[c].alias(c) for c in rest], *[f"_c{i}" for i in range(len(dims))])
    for i, d in enumerate(dims):
        first, last = (F.array_position(f"_c{i}", _col(c)).cast("int") for c in (d.lo, d.hi))
        kept = [c for c in out.columns if c not in (d.lo, d.hi, f"_c{i}")]
        pieces = F.arrays_zip(F.slice(f"_c{i}", first, last - first).alias("a"), F.slice(f"_c{i}", first + 1, last - first).alias("b"))
        out = out.select(*kept, F.explode(pieces).alias("_p")).select(*kept, F.col("_p")["a"].alias(d.lo), F.col("_p")["b"].alias(d.hi))
    return out


def _in_order(cuts: str) -> Column:
    """Different cuts in order; neighbours are compared, as Spark compares structs each with each to tell which are different."""
    return F.get(F.transform(F.array(F.sort_array(cuts)), lambda s: F.filter(s, lambda c, i: (i == 0) | (c != F.get(s, i - 1)))), F.lit(0))


def _on_cuts(rows: DataFrame, d: Dim, cuts: str) -> DataFrame:
    """Each row in pieces between those of the cuts that lie in it."""
    own = rows.withColumn(cuts, F.filter(cuts, lambda c: (_col(d.lo) <= c) & (c <= _col(d.hi))))
    own = own.withColumn(cuts, F.sort_array(F.array_distinct(cuts)) if d.discrete else _in_order(cuts))
    rest = [c for c in rows.columns if c not in (d.lo, d.hi, cuts)]
    n = F.size(cuts) - 1
    pieces = F.arrays_zip(F.slice(cuts, 1, n).alias("a"), F.slice(cuts, 2, n).alias("b"))
    return own.select(*rest, F.explode(pieces).alias("_p")).select(*rest, F.col("_p")["a"].alias(d.lo), F.col("_p")["b"].alias(d.hi))


def _short(df: DataFrame, most: int = 8) -> DataFrame:
    """df, staged if its plan reads more than `most` tables or has more than `most` windows and aggregates: they run in few stages, as rows are dealt by key once, and a task holds memory for each, so chains of writes would grow. most=0: if it joins, sorts or aggregates at all."""
    from ..sources.staging import stage

    plan = df._jdf.queryExecution().logical()
    steps = re.findall(r"^[\s:+|-]*(?:Window|Aggregate" + ("" if most else "|Join") + ") ", str(plan.toString()), re.M)
    return stage(df, "cells") if plan.collectLeaves().size() > (most or 8) or len(steps) > most else df


def _boxed(box: Box | Span) -> Box:
    return [box] if isinstance(box, Span) else list(box)


def _origin(d: Dim):
    import datetime as dt

    return dt.date(1970, 1, 1) if d.type == "date" else dt.datetime(1970, 1, 1) if d.type.startswith("timestamp") else 0


__all__ = ["BOTTOM", "TOP", "IntervalFrame", "Monoid", "Multi", "Probe", "Shape", "contains", "sweep_sum", "timeline"]
