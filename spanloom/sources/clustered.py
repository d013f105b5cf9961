"""Frames stored for look-ups by point and box.

Rows are written in an order that keeps near boxes together: first by how wide they are (wide rows would stretch the bounds
of every file they lie in), then along a Z-order curve of their centres, each dimension on a scale of quantiles so that
the curve follows the data. The order is cut into at most `MOST_PARTS` parts of equal numbers of rows, each a folder; a
small table has the bounds of each part. A look-up filters that table, which is broadcast (its size is bounded), so Spark
prunes the other parts' files by its partition filter at run time; inside a part, plain bound columns let Parquet's
minima and maxima skip row groups.

Cases: an empty frame is one part without rows; unbounded rows are the widest, in parts of their own; rows are kept as
they are, repeated ones too; values may have any type that Parquet can hold.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import BOTTOM, TOP, Box, Dim, Span, contains_point, intersects
from ..operators.frame import IntervalFrame
from ..operators.meeting import number
from .staging import shared_folder

MOST_PARTS = 4096
_BITS = 8


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _steps(values: list[float], x: Column) -> Column:
    """How many of the sorted values are at most x, by halving."""
    table = F.lit(values or [0.0]).cast("array<double>")
    jumps = F.lit([1 << k for k in reversed(range(max(1, len(values).bit_length())))])
    return F.aggregate(jumps, F.lit(0), lambda at, k: F.when((at + k <= len(values)) & (F.get(table, at + k - 1) <= x), at + k).otherwise(at))


def _plain(d: Dim, c: str) -> Column:
    """A cut as one value that Parquet keeps minima and maxima of: the least value that can lie after it."""
    return _col(c) if d.discrete else _col(c)["v"]


class Clustered:
    """A stored frame: `path` holds rows and the table of parts."""

    def __init__(self, frame: IntervalFrame, path: str):
        self.dims, self.values, self.keys, self.path, self.spark = frame.dims, frame.values, frame.keys, path, frame.spark
        self.kind = type(frame)
        self.schema = frame.df.select(*frame.columns).schema

    @classmethod
    def write(cls, frame: IntervalFrame, path: str | None = None, *, part_rows: int = 1 << 20) -> Clustered:
        path = path or f"{shared_folder(frame.spark)}/spanloom/clustered-{uuid.uuid4().hex}"
        out = cls(frame, path)
        at = {d: (number(d, _col(d.lo)), number(d, _col(d.hi))) for d in frame.dims}
        marks = [k / (1 << _BITS) for k in range(1, 1 << _BITS)]
        scale = frame.df.agg(F.count("*").alias("n"), *[F.percentile_approx((a + b) / 2, marks, 20 << _BITS).alias(f"q{i}") for i, (a, b) in enumerate(at.values())], *[F.percentile_approx(b - a, [0.5], 1000)[0].alias(f"w{i}") for i, (a, b) in enumerate(at.values())]).first()
        n = scale["n"]
        parts = max(1, min(MOST_PARTS, -(-n // part_rows)))
        wide, places = F.lit(0), []
        for i, (a, b) in enumerate(at.values()):
            width = b - a
            level = F.when(width.isNull(), F.lit(20)).otherwise(F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(width / (scale[f"w{i}"] or 1.0), F.lit(1.0))))).cast("int"))
            wide = F.greatest(wide, level)
            places.append(_steps(sorted(set(scale[f"q{i}"] or [])), F.coalesce((a + b) / 2, a, b, F.lit(0.0))))
        curve = F.lit(0).cast("bigint")
        for bit in reversed(range(_BITS)):
            for p in places:
                curve = F.shiftleft(curve, 1).bitwiseOR(F.shiftright(p, bit).bitwiseAND(F.lit(1)).cast("bigint"))
        key = (F.least(wide, F.lit(31)).cast("bigint") * (1 << (_BITS * len(places)))) + curve
        rows = frame.df.withColumn("_curve", key)
        cuts = [] if parts == 1 else rows.agg(F.percentile_approx("_curve", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]  # MOST_PARTS numbers
        made = rows.withColumn("_part", _steps([float(c) for c in sorted(set(cuts))], F.col("_curve").cast("double")))
        bounds = [x.alias(f"_p_{c}") for d in frame.dims for c, x in ((d.lo, _plain(d, d.lo)), (d.hi, _plain(d, d.hi)))]
        made = made.select(*frame.columns, *bounds, "_curve", "_part")
        made.repartition(parts, "_part").sortWithinPartitions("_part", "_curve").drop("_curve").write.partitionBy("_part").parquet(f"{path}/rows")
        stored = frame.spark.read.parquet(f"{path}/rows") if n else made.drop("_curve")
        stored.groupBy("_part").agg(F.count("*").alias("_n"), *[f(f"_p_{c}").alias(f"_{e}_{c}") for d in frame.dims for c in (d.lo, d.hi) for e, f in (("min", F.min), ("max", F.max))]).coalesce(1).write.parquet(f"{path}/parts")
        return out

    @property
    def parts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/parts")

    def frame(self) -> IntervalFrame:
        """All rows."""
        return self._as(self._rows())

    def _rows(self) -> DataFrame:
        if self.parts.isEmpty():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/rows")

    def _as(self, df: DataFrame) -> IntervalFrame:
        return self.kind(df.select(*[f.name for f in self.schema]), self.dims, self.values, self.keys)

    def _pruned(self, box: list[tuple[Column, Column]], test: Column) -> IntervalFrame:
        """Rows that pass the test and may lie in a box of plain bounds, from the parts whose bounds meet it."""
        here = reduce(lambda a, b: a & b, [(F.col(f"_min_{d.lo}") <= hi) & (F.col(f"_max_{d.hi}") >= lo) for d, (lo, hi) in zip(self.dims, box, strict=True)])
        near = reduce(lambda a, b: a & b, [(F.col(f"_p_{d.lo}") <= hi) & (F.col(f"_p_{d.hi}") >= lo) for d, (lo, hi) in zip(self.dims, box, strict=True)])
        parts = self.parts.filter(here).select(F.col("_part").alias("_at"))
        rows = self._rows()
        if "_part" not in rows.columns:
            return self._as(rows)
        return self._as(rows.join(F.broadcast(parts), F.col("_part") == F.col("_at")).filter(near & test))  # MOST_PARTS numbers

    def get_data_at(self, *point) -> IntervalFrame:
        """The rows that hold at a point."""
        edges = lambda d: {BOTTOM: (d.first, d.first), TOP: (d.last, d.last)}
        spans = [Span(d, *(edges(d)[p] if p in (BOTTOM, TOP) else (d.start(p), d.end(p)))) for d, p in zip(self.dims, point, strict=True)]
        return self._pruned(self._bounds(spans), contains_point(self._box(), point))

    def get_intersecting(self, box: Box | Span) -> IntervalFrame:
        """Rows that overlap a box, as they are."""
        spans = [box] if isinstance(box, Span) else list(box)
        literal = [Span(d, d.column(s.lo), d.column(s.hi)) for d, s in zip(self.dims, spans, strict=True)]
        return self._pruned(self._bounds(spans), intersects(self._box(), literal))

    def _box(self) -> Box:
        return [Span(d, _col(d.lo), _col(d.hi)) for d in self.dims]

    def _bounds(self, spans: list[Span]) -> list[tuple[Column, Column]]:
        out = []
        for d, s in zip(self.dims, spans, strict=True):
            lo, hi = d.column(s.lo), d.column(s.hi)
            out.append((lo, hi) if d.discrete else (lo["v"], hi["v"]))
        return out
