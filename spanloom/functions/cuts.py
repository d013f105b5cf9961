"""Boundaries as cuts: every interval, discrete or continuous, is half-open between two cuts.

A discrete dimension's cut is a plain value (BIGINT or DATE); an interval that ends at v has the cut v + 1. A continuous
dimension's cut is STRUCT<v, side>: side 0 lies just before v, side 1 just after it, so [a, b] is (a,0)..(b,1) and
(a, b) is (a,1)..(b,0). Unbounded ends are the type's sentinels. Cuts of a dimension are totally ordered by <, whether
Python values or Columns, so everything below works on either: literals on the driver, columns in plans.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least and greatest cut of each type; no row may hold them as data.
_EDGES: dict[str, tuple[Any, Any]] = {
    "bigint": (-(1 << 63), (1 << 63) - 1),
    "date": (dt.date(1, 1, 1), dt.date(9999, 12, 31)),
    "double": (-math.inf, math.inf),
    "timestamp": (dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)),
    "timestamp_ntz": (dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)),
}


@dataclass(frozen=True)
class Open:
    """A boundary value that is itself not part of the interval (continuous dimensions only)."""

    v: Any


class _Edge:
    def __init__(self, name: str, sign: int):
        self.name, self.sign = name, sign

    def __repr__(self) -> str:
        return self.name


BOTTOM, TOP = _Edge("Bottom", -1), _Edge("Top", 1)


def not_(x):
    return ~x if isinstance(x, Column) else not x


def if_(test, then, other):
    if not isinstance(test, Column):
        return then if test else other
    return F.when(test, then).otherwise(other)


def least(*xs):
    return F.least(*xs) if any(isinstance(x, Column) for x in xs) else min(xs)


def greatest(*xs):
    return F.greatest(*xs) if any(isinstance(x, Column) for x in xs) else max(xs)


@dataclass(frozen=True)
class Dim:
    """A dimension: its name, Spark type (bigint, date, double, timestamp, timestamp_ntz) and kind. Ordinals of ordered categories are bigint."""

    name: str
    type: str = "bigint"
    kind: str = "discrete"
    labels: tuple[str, ...] = ()

    def __post_init__(self):
        if self.type not in _EDGES or self.kind not in ("discrete", "continuous"):
            raise ValueError(f"no such dimension: {self.type} {self.kind}")
        if self.kind == "discrete" and self.type not in ("bigint", "date"):
            raise ValueError(f"{self.type} has no successor; make it continuous")

    @property
    def lo(self) -> str:
        return f"{self.name}_lo"

    @property
    def hi(self) -> str:
        return f"{self.name}_hi"

    @property
    def discrete(self) -> bool:
        return self.kind == "discrete"

    # --- cuts of boundaries ---
    @property
    def first(self):
        """The cut before everything."""
        return _EDGES[self.type][0] if self.discrete else (_EDGES[self.type][0], 0)

    @property
    def last(self):
        """The cut after everything."""
        return _EDGES[self.type][1] if self.discrete else (_EDGES[self.type][1], 1)

    def succ(self, v):
        """The next value of a discrete dimension; after the greatest there is only the last cut."""
        if isinstance(v, Column):
            return F.date_add(v, 1) if self.type == "date" else F.coalesce(F.try_add(v, F.lit(1)), F.lit(self.last).cast("bigint"))
        if v >= self.last:
            return self.last
        return v + (dt.timedelta(1) if self.type == "date" else 1)

    def pred(self, v):
        if isinstance(v, Column):
            return F.date_sub(v, 1) if self.type == "date" else v - 1
        return v - (dt.timedelta(1) if self.type == "date" else 1)

    def _value(self, v):
        if isinstance(v, Column):
            return v.cast(self.type) + 0.0 if self.type == "double" else v.cast(self.type)
        if self.type == "double":
            return float(v) + 0.0  # -0.0 is 0.0
        if self.labels and isinstance(v, str):
            return self.labels.index(v)
        return v

    def _cut(self, v, side: int):
        if isinstance(v, Column):
            return F.struct(v.alias("v"), F.lit(side).alias("side"))
        return (v, side)

    def start(self, bound):
        """The cut at which an interval with this start begins."""
        if bound is BOTTOM:
            return self.first
        if bound is TOP:
            raise ValueError("an interval can't start at the top")
        if isinstance(bound, Open):
            if self.discrete:
                return self.succ(self._value(bound.v))
            return self._cut(self._value(bound.v), 1)
        v = self._value(bound)
        return v if self.discrete else self._cut(v, 0)

    def end(self, bound):
        """The cut at which an interval with this end stops."""
        if bound is TOP:
            return self.last
        if bound is BOTTOM:
            raise ValueError("an interval can't end at the bottom")
        if isinstance(bound, Open):
            v = self._value(bound.v)
            return v if self.discrete else self._cut(v, 0)
        v = self._value(bound)
        return self.succ(v) if self.discrete else self._cut(v, 1)

    def column(self, cut) -> Column:
        """A cut as a Column of the dimension's cut type."""
        if isinstance(cut, Column):
            return cut
        if self.discrete:
            return self._literal(cut)
        return F.struct(self._literal(cut[0]).alias("v"), F.lit(cut[1]).alias("side"))

    def _literal(self, v) -> Column:
        return F.lit(v.isoformat() if hasattr(v, "isoformat") else v).cast(self.type)  # by text: years under 1000 have no other safe way

    @property
    def cut_type(self) -> str:
        return self.type if self.discrete else f"struct<v:{self.type},side:int>"

    def is_first(self, cut):
        return cut == (self.column(self.first) if isinstance(cut, Column) else self.first)

    def is_last(self, cut):
        return cut == (self.column(self.last) if isinstance(cut, Column) else self.last)

    def covers(self, lo, hi, point):
        """Whether an interval holds a value, Top or Bottom; open points belong to nothing."""
        if point is BOTTOM:
            return self.is_first(lo)
        if point is TOP:
            return self.is_last(hi)
        if isinstance(point, Open):
            return F.lit(False) if isinstance(lo, Column) else False
        p = self._value(point)
        if self.discrete:
            p = self.column(p) if isinstance(lo, Column) else p
            return (lo <= p) & (p < hi)
        before, after = self._cut(p, 0), self._cut(p, 1)
        if isinstance(lo, Column):
            before, after = self.column(before), self.column(after)
        return (lo <= before) & (after <= hi)

    # --- arithmetic on cuts ---
    def _arith(self, cut, f, flip: bool = False):
        """f on the value of a bounded cut; unbounded cuts stay (or change ends if flipped)."""
        if isinstance(cut, Column):
            v = cut if self.discrete else cut["v"]
            new = f(v)
            new = new.cast(self.type)
            if not self.discrete:
                new = F.struct(new.alias("v"), (1 - cut["side"] if flip else cut["side"]).alias("side"))
            a, b = self.column(self.first), self.column(self.last)
            return F.when(cut == a, b if flip else a).when(cut == b, a if flip else b).otherwise(new)
        if cut == self.first:
            return self.last if flip else cut
        if cut == self.last:
            return self.first if flip else cut
        return f(cut) if self.discrete else (f(cut[0]), 1 - cut[1] if flip else cut[1])

    def shift(self, cut, by):
        """The cut moved by a number (days for dates, seconds for timestamps)."""
        return self._arith(cut, lambda v: self._plus(v, by))

    def _plus(self, v, by):
        col = isinstance(v, Column)
        if self.type == "date":
            return F.date_add(v, F.lit(by).cast("int") if not isinstance(by, Column) else by.cast("int")) if col else v + dt.timedelta(int(by))
        if self.type.startswith("timestamp"):
            return v + F.make_dt_interval(secs=F.lit(by).cast("decimal(18,6)")) if col else v + dt.timedelta(seconds=float(by))
        return v + by

    def minus(self, a, b):
        """The distance between two cuts' values."""
        if isinstance(a, Column) or isinstance(b, Column):
            a, b = self.column(a), self.column(b)
            x, y = (a, b) if self.discrete else (a["v"], b["v"])
            if self.type == "date":
                return F.datediff(x, y).cast("bigint")
            if self.type.startswith("timestamp"):
                return (F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))) / 1e6
            return x - y
        x, y = (a, b) if self.discrete else (a[0], b[0])
        if self.type == "date":
            return (x - y).days
        return (x - y).total_seconds() if self.type.startswith("timestamp") else x - y

    def scale(self, cut, center, by: float):
        """The cut scaled about a value: center + (v - center) * by, halves rounded up for whole numbers and days."""
        c = self._value(center)

        def f(v):
            if self.type == "date":
                if isinstance(v, Column):
                    return F.date_add(F.lit(c), F.floor(F.datediff(v, F.lit(c)) * F.lit(float(by)) + 0.5).cast("int"))
                return c + dt.timedelta(math.floor((v - c).days * by + 0.5))
            if self.type == "bigint":
                return c + (F.floor((v - c) * F.lit(float(by)) + 0.5) if isinstance(v, Column) else math.floor((v - c) * by + 0.5))
            if self.type == "double":
                return c + (v - c) * by
            gap = self.minus(v if self.discrete else self._cut(v, 0), self._cut(c, 0))
            return self._plus(F.lit(c).cast(self.type) if isinstance(v, Column) else c, gap * by)

        return self._arith(cut, f, flip=by < 0)

    # --- back to boundaries, for people ---
    def bound(self, cut, end: bool) -> str:
        if cut == self.first:
            return "-∞"
        if cut == self.last:
            return "+∞"
        if self.discrete:
            v = self.pred(cut) if end else cut
            return self.labels[v] if self.labels else str(v)
        return str(cut[0])

    def text(self, lo, hi) -> str:
        left = "(" if lo == self.first or not self.discrete and lo[1] else "["
        right = ")" if hi == self.last or not self.discrete and not hi[1] else "]"
        return f"{left}{self.bound(lo, False)}..{self.bound(hi, True)}{right}"


class Span:
    """One dimension's extent: two cuts, Python values or Columns."""

    __slots__ = ("dim", "hi", "lo")

    def __init__(self, dim: Dim, lo, hi):
        self.dim, self.lo, self.hi = dim, lo, hi

    def __eq__(self, other):
        return isinstance(other, Span) and (self.lo, self.hi) == (other.lo, other.hi)

    def __hash__(self):
        return hash((self.lo, self.hi))

    def __repr__(self):
        return self.dim.text(self.lo, self.hi)

    @property
    def valid(self):
        return self.lo < self.hi


# --- constructors of one-dimensional extents ---
def interval(dim: Dim, start, end) -> Span:
    """From start to end, both as boundaries: a value, Open(value), BOTTOM or TOP."""
    s = Span(dim, dim.start(start), dim.end(end))
    if not isinstance(s.lo, Column) and not isinstance(s.hi, Column) and not s.valid:
        raise ValueError(f"{start} .. {end} is empty")
    return s


def interval_from(dim: Dim, start) -> Span:
    return interval(dim, start, TOP)


def interval_from_after(dim: Dim, start) -> Span:
    return interval(dim, Open(start), TOP)


def interval_to(dim: Dim, end) -> Span:
    return interval(dim, BOTTOM, end)


def interval_to_before(dim: Dim, end) -> Span:
    return interval(dim, BOTTOM, Open(end))


def interval_at(dim: Dim, v) -> Span:
    return interval(dim, v, v)


def unbounded(dim: Dim) -> Span:
    return Span(dim, dim.first, dim.last)


def between(a: Span, b: Span) -> Span | None:
    """What lies strictly between the end of a and the start of b."""
    return Span(a.dim, a.hi, b.lo) if a.hi < b.lo else None


def after(a: Span) -> Span | None:
    return None if a.hi == a.dim.last else Span(a.dim, a.hi, a.dim.last)


def before(a: Span) -> Span | None:
    return None if a.lo == a.dim.first else Span(a.dim, a.dim.first, a.lo)


def points(box: list[Span]) -> list[tuple]:
    """All points of a bounded discrete box; none if a dimension is continuous or unbounded."""
    import itertools

    sides = []
    for s in box:
        if not s.dim.discrete or s.lo == s.dim.first or s.hi == s.dim.last:
            return []
        side, v = [], s.lo
        while v < s.hi:
            side.append(v)
            v = s.dim.succ(v)
        sides.append(side)
    return list(itertools.product(*sides))


def vertices(box: list[Span]) -> list[tuple]:
    import itertools

    return list(itertools.product(*[(s.lo, s.hi) for s in box]))


# --- boundaries and changed ends; spans of Python values or Columns ---
def close_if_open(bound):
    """An open boundary as the closed one at its value; others as they are."""
    return bound.v if isinstance(bound, Open) else bound


def is_closed_or_unbounded(bound) -> bool:
    return not isinstance(bound, Open)


def starting(s: Span, start) -> Span:
    """The extent with another start: a value, Open(value) or BOTTOM."""
    return Span(s.dim, _like(s, s.dim.start(start)), s.hi)


def starting_after(s: Span, v) -> Span:
    return starting(s, Open(v))


def from_bottom(s: Span) -> Span:
    return starting(s, BOTTOM)


def ending(s: Span, end) -> Span:
    """The extent with another end: a value, Open(value) or TOP."""
    return Span(s.dim, s.lo, _like(s, s.dim.end(end)))


def ending_before(s: Span, v) -> Span:
    return ending(s, Open(v))


def to_top(s: Span) -> Span:
    return ending(s, TOP)


def at_start(s: Span) -> Span:
    """The extent's first point, if it starts closed."""
    d = s.dim
    return Span(d, s.lo, d.succ(s.lo) if d.discrete else d._cut(d.column(s.lo)["v"] if isinstance(s.lo, Column) else s.lo[0], 1))


def at_end(s: Span) -> Span:
    """The extent's last point, if it ends closed."""
    d = s.dim
    return Span(d, d.pred(s.hi) if d.discrete else d._cut(d.column(s.hi)["v"] if isinstance(s.hi, Column) else s.hi[0], 0), s.hi)


def _like(s: Span, cut):
    """A literal cut as a Column where the extent is one of Columns."""
    return s.dim.column(cut) if isinstance(s.lo, Column) or isinstance(s.hi, Column) else cut


def after_start(a: Span, b: Span):
    """Whether a starts after b starts."""
    return a.lo > b.lo


def after_or_at_start(a: Span, b: Span):
    return a.lo >= b.lo


def before_end(a: Span, b: Span):
    """Whether a ends before b ends."""
    return a.hi < b.hi


def before_or_at_end(a: Span, b: Span):
    return a.hi <= b.hi


def has_same_start(x: list[Span], y: list[Span]):
    return _all(a.lo == b.lo for a, b in zip(x, y, strict=True))


def has_same_end(x: list[Span], y: list[Span]):
    return _all(a.hi == b.hi for a, b in zip(x, y, strict=True))


def is_unbounded(box: list[Span]):
    """Whether a box is everything."""
    return _all(s.dim.is_first(s.lo) & s.dim.is_last(s.hi) for s in box)


def is_bounded(box: list[Span]):
    """Whether a box is bounded on all sides."""
    return _all(not_(s.dim.is_first(s.lo)) & not_(s.dim.is_last(s.hi)) for s in box)


# --- relations and algebra of boxes (lists of Spans), on Python values and Columns alike ---
Box = list


def _all(tests):
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def _any(tests):
    out = None
    for t in tests:
        out = t if out is None else out | t
    return out


def contains_point(box: Box, point: tuple):
    return _all(s.dim.covers(s.lo, s.hi, p) for s, p in zip(box, point, strict=True))


def contains(outer: Box, inner: Box):
    return _all((a.lo <= b.lo) & (b.hi <= a.hi) for a, b in zip(outer, inner, strict=True))


def intersects(x: Box, y: Box):
    return _all((a.lo < b.hi) & (b.lo < a.hi) for a, b in zip(x, y, strict=True))


def equivalent(x: Box, y: Box):
    return _all((a.lo == b.lo) & (a.hi == b.hi) for a, b in zip(x, y, strict=True))


def clip(x: Box, y: Box) -> Box:
    """The common box; only meaningful where intersects holds."""
    return [Span(a.dim, greatest(a.lo, b.lo), least(a.hi, b.hi)) for a, b in zip(x, y, strict=True)]


def intersection(x: Box, y: Box) -> Box | None:
    return clip(x, y) if intersects(x, y) else None


def hull(x: Box, y: Box) -> Box:
    """The bounding box of both."""
    return [Span(a.dim, least(a.lo, b.lo), greatest(a.hi, b.hi)) for a, b in zip(x, y, strict=True)]


def _count(tests):
    return sum((t.cast("int") if isinstance(t, Column) else int(t)) for t in tests)


def left_adjacent(x: Box, y: Box):
    """x ends where y starts in exactly one dimension and equals it in the others."""
    same = [(a.lo == b.lo) & (a.hi == b.hi) for a, b in zip(x, y, strict=True)]
    meet = [a.hi == b.lo for a, b in zip(x, y, strict=True)]
    return _any(meet[k] & (_all(s for i, s in enumerate(same) if i != k) if len(same) > 1 else True) for k in range(len(same)))


def adjacent(x: Box, y: Box):
    return left_adjacent(x, y) | left_adjacent(y, x)


def touches(x: Box, y: Box):
    """Every dimension overlaps or is adjacent, and one at least is adjacent."""
    pairs = list(zip(x, y, strict=True))
    return _all((a.lo <= b.hi) & (b.lo <= a.hi) for a, b in pairs) & _any((a.hi == b.lo) | (b.hi == a.lo) for a, b in pairs)


def connected(x: Box, y: Box):
    return touches(x, y) | intersects(x, y)


def _tip(a: Span, b: Span):
    """Closed ends at one point: a ends with the value that b starts with."""
    if a.dim.discrete:
        return a.hi == a.dim.succ(b.lo)
    if isinstance(a.hi, Column) or isinstance(b.lo, Column):
        ah, bl = a.dim.column(a.hi), b.dim.column(b.lo)
        return (ah["v"] == bl["v"]) & (ah["side"] == 1) & (bl["side"] == 0)
    return a.hi[0] == b.lo[0] and a.hi[1] == 1 and b.lo[1] == 0


def shares_boundary(x: Box, y: Box):
    pairs = list(zip(x, y, strict=True))
    return intersects(x, y) & _any((a.lo == b.lo) | (a.hi == b.hi) | _tip(a, b) | _tip(b, a) for a, b in pairs)


def relation(x: Box, y: Box):
    """RCC-8: DC, EC, PO, EQ, TPP, NTPP, TPPi or NTPPi."""
    edge = _any((a.lo == b.lo) | (a.hi == b.hi) for a, b in zip(x, y, strict=True))
    name = (lambda s: F.lit(s)) if isinstance(edge, Column) else (lambda s: s)
    return if_(
        equivalent(x, y), name("EQ"),
        if_(contains(y, x), if_(edge, name("TPP"), name("NTPP")),
        if_(contains(x, y), if_(edge, name("TPPi"), name("NTPPi")),
        if_(intersects(x, y), name("PO"), if_(touches(x, y), name("EC"), name("DC"))))),
    )


def gap(x: Box, y: Box) -> Box | None:
    """The region between: dimensions without a gap keep the extent of x; None if no dimension has one."""
    out, some = [], False
    for a, b in zip(x, y, strict=True):
        lo, hi = (a.hi, b.lo) if a.hi < b.lo else (b.hi, a.lo)
        if lo < hi:
            some = True
            out.append(Span(a.dim, lo, hi))
        else:
            out.append(a)
    return out if some else None


def excluding(x: Box, y: Box) -> list[list[Span]]:
    """For each dimension what is left of x without y: none, one or two extents."""
    out = []
    for a, b in zip(x, y, strict=True):
        parts = [Span(a.dim, a.lo, least(a.hi, b.lo)), Span(a.dim, greatest(a.lo, b.hi), a.hi)]
        out.append([p for p in parts if p.lo < p.hi])
    return out


def remainder(a: Span, b: Span) -> Column:
    """excluding for Columns, in one dimension: an array of (lo, hi), none, one or two."""
    ends = ((a.lo, least(a.hi, b.lo)), (greatest(a.lo, b.hi), a.hi))
    return F.filter(F.array(*[F.struct(x.alias("lo"), y.alias("hi")) for x, y in ends]), lambda p: p["lo"] < p["hi"])


def along(a: Span, b: Span) -> Column:
    """separate for Columns, in one dimension: an array of one to three (lo, hi)."""
    ends = ((a.lo, least(a.hi, b.lo)), (greatest(a.lo, b.lo), least(a.hi, b.hi)), (greatest(a.lo, b.hi), a.hi))
    return F.filter(F.array(*[F.struct(x.alias("lo"), y.alias("hi")) for x, y in ends]), lambda p: p["lo"] < p["hi"])


def where(test: Column, s: Span) -> Span:
    """The extent where the test holds, else null cuts: for what may not be there."""
    return Span(s.dim, F.when(test, s.lo), F.when(test, s.hi))


def gap_where(a: Span, b: Span) -> Span:
    """gap for Columns, in one dimension: null cuts where there is none."""
    s = Span(a.dim, least(a.hi, b.hi), greatest(a.lo, b.lo))
    return where(s.lo < s.hi, s)


def points_where(s: Span) -> Column:
    """points for Columns, in one discrete dimension: an array, empty if unbounded."""
    d = s.dim
    none = F.array().cast(f"array<{d.type}>")
    return F.when(d.is_first(s.lo) | d.is_last(s.hi), none).otherwise(F.sequence(s.lo, d.pred(s.hi)))


def separate(x: Box, y: Box) -> list[Box]:
    """x in pieces along the faces of y, at most three a dimension."""
    import itertools

    sides = []
    for a, b in zip(x, y, strict=True):
        cuts = sorted({a.lo, a.hi, *(c for c in (b.lo, b.hi) if a.lo < c < a.hi)})
        sides.append([Span(a.dim, p, q) for p, q in itertools.pairwise(cuts)])
    return [list(p) for p in itertools.product(*sides)]


def measure(box: Box):
    """Length, area, volume: number of cells if discrete, extent if continuous; None (or null) if unbounded."""
    if isinstance(box[0].lo, Column):
        total = F.lit(1)
        for s in box:
            total = total * F.when(s.dim.is_first(s.lo) | s.dim.is_last(s.hi), F.lit(None)).otherwise(s.dim.minus(s.hi, s.lo))
        return total
    if any(s.lo == s.dim.first or s.hi == s.dim.last for s in box):
        return None
    return math.prod(s.dim.minus(s.hi, s.lo) for s in box)


# --- affine transformations of one extent; the result may be empty (check .valid) ---
def displaced(s: Span, by) -> Span:
    return Span(s.dim, s.dim.shift(s.lo, by), s.dim.shift(s.hi, by))


def padded(s: Span, by) -> Span:
    return Span(s.dim, s.dim.shift(s.lo, -by), s.dim.shift(s.hi, by))


def scaled(s: Span, center, by: float) -> Span:
    if by == 0:
        raise ValueError("scaling by nothing")
    lo, hi = s.dim.scale(s.lo, center, by), s.dim.scale(s.hi, center, by)
    return Span(s.dim, lo, hi) if by > 0 else Span(s.dim, hi, lo)


def reflected(s: Span, pivot) -> Span:
    return scaled(s, pivot, -1)


@dataclass(frozen=True)
class Probe:
    """A structuring element: an extent with a centre value."""

    span: Span
    center: Any

    def _reach(self) -> tuple[Any, Any]:
        d = self.span.dim
        c = d.start(self.center)
        lo = None if self.span.lo == d.first else d.minus(self.span.lo, c)
        hi = None if self.span.hi == d.last else d.minus(self.span.hi, c)
        return lo, hi

    def reflected(self) -> Probe:
        return Probe(reflected(self.span, self.center), self.center)

    def super_element(self) -> Probe:
        """The probe joined with its reflection: it holds its centre."""
        other = self.reflected().span
        return Probe(Span(self.span.dim, least(self.span.lo, other.lo), greatest(self.span.hi, other.hi)), self.center)


def containing_center(probes: list[Probe]) -> list[Probe]:
    """super_element in each dimension of a box of probes."""
    return [p.super_element() for p in probes]


def dilated(s: Span, p: Probe) -> Span:
    """Minkowski sum with the probe; an unbounded side of the probe makes that side unbounded."""
    lo, hi = p._reach()
    d = s.dim
    col = isinstance(s.lo, Column)
    edge = (lambda c: d.column(c)) if col else (lambda c: c)
    return Span(d, edge(d.first) if lo is None else d.shift(s.lo, lo), edge(d.last) if hi is None else d.shift(s.hi, hi))


def eroded(s: Span, p: Probe) -> Span:
    """Minkowski difference; empty (not valid) where the probe doesn't fit."""
    lo, hi = p._reach()
    d = s.dim
    if lo is None or hi is None:
        return Span(d, s.hi, s.lo)
    return Span(d, d.shift(s.lo, -lo), d.shift(s.hi, -hi))


def steps(start: float, end: float, step: float) -> list[tuple[float, float]]:
    """(offset, length) of steps from start to end, the last perhaps short."""
    if step <= 0 or start > end:
        raise ValueError("steps don't reach the end")
    out, at = [], start
    while at < end:
        out.append((at, min(step, end - at)))
        at += step
    return out
