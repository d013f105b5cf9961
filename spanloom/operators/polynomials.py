"""Functions as data: piecewise polynomials whose pieces are values in a column.

A piece is an array of terms (powers, one a dimension, and a coefficient) in normal form: terms in order of their powers,
equal powers added up, none of coefficient 0. Equal functions of a box are thus equal values, so all that frames do works
on functions too: coalescing, writes, overlays, differences as actions, staging and JSON. Arithmetic, partial application,
derivatives and integrals are expressions on the arrays; nothing about a function is known to the driver.

Cases: the polynomial 0 has no terms; a row without a value (null) has none; pieces are integrated over bounded extents
only, an unbounded extent gives null, which is no row; whole coordinates and days count as numbers (days since 1970).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Span, contains_point
from ..sources import codec
from .frame import IntervalFrame
from .meeting import number

TERMS = "array<struct<p:array<int>,c:double>>"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def term(c: Column, *powers: int) -> Column:
    return F.struct(F.array(*[F.lit(int(p)) for p in powers]).alias("p"), c.cast("double").alias("c"))


def polynomial(*terms: Column) -> Column:
    """A piece from terms, in normal form."""
    return normal(F.array(*terms) if terms else F.array().cast(TERMS))


def normal(terms: Column) -> Column:
    """Terms by their powers, each once, zeros left out."""
    powers = F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["p"])))
    summed = F.transform(powers, lambda p: F.struct(p.alias("p"), F.aggregate(F.filter(terms, lambda t: t["p"] == p), F.lit(0.0), lambda a, t: a + t["c"]).alias("c")))
    return F.filter(summed, lambda t: t["c"] != 0)


def plus(x: Column, y: Column) -> Column:
    return normal(F.concat(x, y))


def times(x: Column, y: Column) -> Column:
    each = F.transform(x, lambda s: F.transform(y, lambda t: F.struct(F.zip_with(s["p"], t["p"], lambda a, b: a + b).alias("p"), (s["c"] * t["c"]).alias("c"))))
    return normal(F.flatten(each))


def scaled(x: Column, by: Column | float) -> Column:
    return normal(F.transform(x, lambda t: F.struct(t["p"].alias("p"), (t["c"] * by).alias("c"))))


def value(x: Column, *at: Column) -> Column:
    """The value at a point."""
    point = F.array(*[a.cast("double") for a in at])
    power = lambda t: F.aggregate(F.zip_with(point, t["p"], lambda a, p: F.when(p == 0, F.lit(1.0)).otherwise(F.pow(a, p))), F.lit(1.0), lambda a, f: a * f)
    return F.aggregate(x, F.lit(0.0), lambda a, t: a + t["c"] * power(t))


def _without(p: Column, i: int) -> Column:
    return F.concat(F.slice(p, 1, i), F.slice(p, i + 2, F.size(p))) if i else F.slice(p, 2, F.size(p))


def applied(x: Column, i: int, at: Column) -> Column:
    """One coordinate held fast."""
    factor = lambda t: F.when(t["p"][i] == 0, F.lit(1.0)).otherwise(F.pow(at.cast("double"), t["p"][i]))
    return normal(F.transform(x, lambda t: F.struct(_without(t["p"], i).alias("p"), (t["c"] * factor(t)).alias("c"))))


def integrated(x: Column, i: int, lo: Column, hi: Column) -> Column:
    """The definite integral along one coordinate."""
    return normal(_integrals(x, i, lo, hi))


def _integrals(x: Column, i: int, lo: Column, hi: Column) -> Column:
    """The integral of each term: not in normal form."""
    whole = lambda t, at: F.pow(at, t["p"][i] + 1) / (t["p"][i] + 1)
    return F.transform(x, lambda t: F.struct(_without(t["p"], i).alias("p"), (t["c"] * (whole(t, hi) - whole(t, lo))).alias("c")))


def derived(x: Column, i: int) -> Column:
    """The derivative along one coordinate."""
    less = lambda t: F.transform(t["p"], lambda p, k: F.when(k == i, p - 1).otherwise(p))
    kept = F.filter(x, lambda t: t["p"][i] > 0)
    return normal(F.transform(kept, lambda t: F.struct(less(t).alias("p"), (t["c"] * t["p"][i]).alias("c"))))


class PolynomialFrame:
    """An IntervalFrame of one value column that holds polynomials in its dimensions' coordinates."""

    def __init__(self, frame: IntervalFrame):
        self.frame = frame
        (self.name,) = frame.values

    def _do(self, frame: IntervalFrame) -> PolynomialFrame:
        return PolynomialFrame(frame)

    @property
    def _piece(self) -> Column:
        return _col(self.name)

    # --- from and to values ---
    @classmethod
    def from_values(cls, frame: IntervalFrame) -> PolynomialFrame:
        """A frame of numbers as constant functions."""
        (v,) = frame.values
        return cls(frame._with(frame.df.filter(_col(v).isNotNull()).withColumn(v, polynomial(term(_col(v), *[0] * len(frame.dims))))))

    def to_values(self) -> IntervalFrame:
        """The numbers of constant functions; other pieces give no row."""
        level = F.forall(self._piece, lambda t: F.forall(t["p"], lambda p: p == 0))
        c = F.when(F.size(self._piece) == 0, F.lit(0.0)).otherwise(F.get(self._piece, F.lit(0))["c"])
        return self.frame._with(self.frame.df.filter(level).withColumn(self.name, c))

    # --- reading ---
    def at(self, points: DataFrame, *coordinates: str, result: str = "result") -> DataFrame:
        """points with the value of their key's function at their coordinates; those where none is defined are left out. Points keep all their columns; the frame's keys are theirs."""
        names = {k: f"_f_{k}" for k in self.frame.keys}
        f = self.frame.df.withColumnsRenamed(names)
        box = [Span(d, _col(d.lo), _col(d.hi)) for d in self.frame.dims]
        on = [_col(k).eqNullSafe(_col(n)) for k, n in names.items()] + [contains_point(box, [_col(c) for c in coordinates])]
        met = points.join(f, reduce(lambda a, b: a & b, on))
        number_of = [F.datediff(_col(c), F.lit("1970-01-01").cast("date")) if d.type == "date" else _col(c) for d, c in zip(self.frame.dims, coordinates, strict=True)]
        return met.select(*[_col(c) for c in points.columns], value(self._piece, *number_of).alias(result))

    # --- arithmetic on overlaps, either function elsewhere ---
    def plus(self, that: PolynomialFrame) -> PolynomialFrame:
        return self._do(self.frame.merge(that.frame, {self.name: plus}))

    def times(self, that: PolynomialFrame) -> PolynomialFrame:
        """Products where both are defined."""
        z = self.frame.zip(that.frame)
        a, b = z.values
        return self._do(self.frame._with(z.df.withColumn(a, times(_col(a), _col(b)))).coalesce())

    def minus(self, that: PolynomialFrame) -> PolynomialFrame:
        return self.plus(that.mapped(lambda x: scaled(x, -1.0)))

    def mapped(self, f) -> PolynomialFrame:
        """A function of pieces (an expression that keeps the normal form)."""
        return self._do(self.frame.map_values(**{self.name: f(self._piece)}))

    def derivative(self, name: str) -> PolynomialFrame:
        i = [d.name for d in self.frame.dims].index(name)
        return self.mapped(lambda x: derived(x, i))

    # --- dimensions ---
    def slice_at(self, name: str, point) -> PolynomialFrame:
        """Partial application: one coordinate held fast."""
        i = [d.name for d in self.frame.dims].index(name)
        d = self.frame.dims[i]
        held = number(d, d.column(d.start(point)))
        cut = self.frame._with(self.frame.df.withColumn(self.name, applied(self._piece, i, held)).filter(d.covers(_col(d.lo), _col(d.hi), point)))
        return self._do(cut.drop_dimension(name).coalesce())

    def collapse(self, name: str) -> PolynomialFrame:
        """A coordinate integrated away, each piece over its own extent; pieces that then lie over one another add up, cell by cell."""
        i = [d.name for d in self.frame.dims].index(name)
        d = self.frame.dims[i]
        df = self.frame.df.withColumn(self.name, _integrals(self._piece, i, number(d, _col(d.lo)), number(d, _col(d.hi))))
        flat = self.frame._with(df.filter(number(d, _col(d.lo)).isNotNull() & number(d, _col(d.hi)).isNotNull())).drop_dimension(name)
        # coefficients add up by power, so that what is gathered is a term a power, however many pieces lie over one another
        by = [*flat.keys, *flat.bounds]
        sums = flat._nested(flat.df).select(*by, F.explode_outer(self.name).alias("_t")).groupBy(*by, F.col("_t.p").alias("p")).agg(F.sum("_t.c").alias("c"))
        cells = sums.groupBy(*by).agg(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.col("c").alias("c")))).alias(self.name))
        return self._do(flat._with(cells.withColumn(self.name, normal(self._piece))).coalesce())

    # --- as documents and differences ---
    def to_json(self) -> DataFrame:
        return codec.to_json(self.frame)

    @classmethod
    def from_json(cls, rows: DataFrame, like: PolynomialFrame, *, json_col: str = "json") -> PolynomialFrame:
        return cls(like.frame._with(codec.from_json(rows, list(like.frame.dims), TERMS, json_col=json_col, keys=like.frame.keys).df.withColumnRenamed("value", like.name)))

    def diff_actions_from(self, old: PolynomialFrame) -> DataFrame:
        return self.frame.diff_actions_from(old.frame)

    def apply_diff_actions(self, actions: DataFrame) -> PolynomialFrame:
        return self._do(self.frame.apply_diff_actions(actions))
