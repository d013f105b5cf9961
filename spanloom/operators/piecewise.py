"""Functions valid in boxes: the value of a row is the number of a piece, and pieces are builders of Columns.

A piece takes the point's coordinates as Columns and gives a Column, so evaluating many points is one join to find each
point's piece and one CASE. Pieces that only Python can compute may return the Column of a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import Box, Dim, Span, contains_point
from .frame import IntervalFrame, _boxed

Piece = Callable[..., Column]


class FunctionFrame:
    def __init__(self, frame: IntervalFrame, pieces: dict[int, Piece]):
        self.frame, self.pieces = frame, dict(pieces)

    @classmethod
    def of(cls, spark: SparkSession, dims: list[Dim], rows: list[tuple[Box | Span, Piece]]) -> FunctionFrame:
        numbers: dict[Piece, int] = {}
        data = [(box, numbers.setdefault(f, len(numbers))) for box, f in rows]
        return cls(IntervalFrame.of(spark, dims, data, ("int",), ("piece",)), {k: f for f, k in numbers.items()})

    def evaluate(self, points: DataFrame, coordinates: list[str], name: str = "value") -> DataFrame:
        """Points (a Column for each dimension) with the function's value, null where nothing is defined."""
        at = [F.col(c) for c in coordinates]
        rows = self.frame.df.select(*[F.col(c).alias(f"_f_{c}") for c in self.frame.columns])
        test = [contains_point(self.frame.box("_f_"), tuple(at))] + [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in self.frame.keys]
        joined = points.join(rows, reduce(lambda a, b: a & b, test), "left")
        value = F.lit(None)
        for k, f in self.pieces.items():
            value = F.when(F.col("_f_piece") == k, f(*at)).otherwise(value)
        return joined.select(*points.columns, value.alias(name))

    def at(self, *point):
        d = self.frame.dims
        spark = self.frame.spark
        one = spark.range(1).select(*[F.lit(p).cast(x.type).alias(x.name) for x, p in zip(d, point, strict=True)])
        return self.evaluate(one, [x.name for x in d]).first()["value"]

    def _new(self, frame: IntervalFrame, pieces: dict | None = None) -> FunctionFrame:
        return FunctionFrame(frame, self.pieces if pieces is None else pieces)

    def set(self, box: Box | Span, f: Piece) -> FunctionFrame:
        k = next((i for i, g in self.pieces.items() if g is f), max(self.pieces, default=-1) + 1)
        return self._new(self.frame.set(_boxed(box), k), {**self.pieces, k: f})

    def remove(self, box: Box | Span) -> FunctionFrame:
        return self._new(self.frame.remove(box))

    def update(self, box: Box | Span, f: Piece) -> FunctionFrame:
        k = max(self.pieces, default=-1) + 1
        return self._new(self.frame.update(box, k), {**self.pieces, k: f})

    def fill(self, box: Box | Span, f: Piece) -> FunctionFrame:
        k = max(self.pieces, default=-1) + 1
        return self._new(self.frame.fill(box, k), {**self.pieces, k: f})

    def map_values(self, g: Callable[[Column], Column]) -> FunctionFrame:
        """g after each piece; pieces keep their identity."""
        return self._new(self.frame, {k: (lambda *x, f=f: g(f(*x))) for k, f in self.pieces.items()})

    # --- rows of pieces ---
    def piece_of(self, f: Piece) -> int | None:
        """The number of a piece, None if it isn't one."""
        return next((k for k, g in self.pieces.items() if g is f), None)

    def filter(self, test: Column) -> FunctionFrame:
        """Rows by a test of their bounds and piece numbers."""
        return self._new(self.frame.filter(test))

    def collect(self, change: Callable[[Piece], Piece | None]) -> FunctionFrame:
        """Other pieces for those that change gives one for; rows of the others go."""
        new = {k: g for k, f in self.pieces.items() if (g := change(f)) is not None}
        return self._new(self.frame.filter(F.col("piece").isin(list(new))), new)

    def map_intervals(self, dims: dict[Dim, tuple[Column, Column]]) -> FunctionFrame:
        return self._new(self.frame.map_intervals(dims))

    def map(self, dims: dict[Dim, tuple[Column, Column]], g: Callable[[Column], Column]) -> FunctionFrame:
        return self.map_values(g).map_intervals(dims)

    def replace(self, old_start: tuple, box: Box | Span, f: Piece) -> FunctionFrame:
        """Deletes the row that starts there, then sets another."""
        return self.remove_by_key(*old_start).set(box, f)

    def remove_by_key(self, *start) -> FunctionFrame:
        return self._new(self.frame.remove_by_key(*start))

    def remove_many(self, boxes: IntervalFrame) -> FunctionFrame:
        return self._new(self.frame.remove_many(boxes))

    def remove_piece(self, f: Piece) -> FunctionFrame:
        return self._new(self.frame.remove_value(self.piece_of(f)))

    def set_many(self, rows: list[tuple[Box | Span, Piece]]) -> FunctionFrame:
        return reduce(lambda a, r: a.set(*r), rows, self)

    def set_if_no_conflict(self, box: Box | Span, f: Piece) -> FunctionFrame | None:
        return None if self.frame.intersects_box(box) else self.set(box, f)

    def difference(self, that: IntervalFrame | FunctionFrame) -> FunctionFrame:
        return self._new(self.frame.difference(that.frame if isinstance(that, FunctionFrame) else that))

    def clip(self, box: Box | Span) -> FunctionFrame:
        return self._new(self.frame.clip(box))

    def symmetric_difference(self, that: FunctionFrame) -> FunctionFrame:
        """Where exactly one of both is defined, that one."""
        return self.difference(that).merge(that.difference(self), lambda a, b: a)

    def compress_all(self) -> FunctionFrame:
        return self._new(self.frame.coalesce())

    def recompress_all(self, *grid: IntervalFrame) -> FunctionFrame:
        return self._new(self.frame.recompress_all(*grid))

    def diff_actions_from(self, old: FunctionFrame) -> DataFrame:
        """Differences by start; pieces are compared by number, so both must come from one frame of pieces."""
        return self.frame.diff_actions_from(old.frame)

    # --- look-ups, those of the frame of pieces ---
    def get_all(self) -> DataFrame:
        return self.frame.get_all()

    def get_intersecting(self, box: Box | Span) -> FunctionFrame:
        return self._new(self.frame.get_intersecting(box))

    def is_defined_at(self, *point) -> bool:
        return self.frame.is_defined_at(*point)

    def intersects_box(self, box: Box | Span) -> bool:
        return self.frame.intersects_box(box)

    def domain(self):
        return self.frame.domain()

    def bounding_interval(self) -> DataFrame:
        return self.frame.bounding_interval()

    def is_empty(self) -> bool:
        return self.frame.is_empty()

    def size(self) -> int:
        return self.frame.size()

    def fuse(self, that: FunctionFrame, op: Callable[[Column, Column], Column], frame: IntervalFrame) -> FunctionFrame:
        """Pieces of pairs of numbers (piece, piece_2) combined by op."""
        width = max(that.pieces, default=0) + 1
        pieces = {a * width + b: (lambda *x, f=f, g=g: op(f(*x), g(*x))) for a, f in self.pieces.items() for b, g in that.pieces.items()}
        df = frame.df.withColumn("piece", F.col("piece") * width + F.col("piece_2"))
        return FunctionFrame(IntervalFrame(df, frame.dims, ("piece",), frame.keys), pieces)

    def zip(self, that: FunctionFrame) -> FunctionFrame:
        return self.fuse(that, lambda a, b: F.struct(a.alias("_1"), b.alias("_2")), self.frame.zip(that.frame))

    def intersection(self, that: FunctionFrame, op: Callable[[Column, Column], Column]) -> FunctionFrame:
        return self.fuse(that, op, self.frame.zip(that.frame))

    def zip_all(self, that: FunctionFrame, this_default: Piece, that_default: Piece, op: Callable[[Column, Column], Column] = lambda a, b: F.struct(a.alias("_1"), b.alias("_2"))) -> FunctionFrame:
        a, b = max(self.pieces, default=-1) + 1, max(that.pieces, default=-1) + 1
        left, right = self._new(self.frame, {**self.pieces, a: this_default}), that._new(that.frame, {**that.pieces, b: that_default})
        return left.fuse(right, op, self.frame.zip_all(that.frame, {"piece": a}, {"piece": b}))

    def merge(self, that: FunctionFrame, op: Callable[[Column, Column], Column]) -> FunctionFrame:
        """op on overlaps, either function elsewhere."""
        both = self.zip_all(that, lambda *x: F.lit(None).cast("double"), lambda *x: F.lit(None).cast("double"), lambda a, b: F.coalesce(op(a, b), a, b))
        return both

    def slice_at(self, name: str, point) -> FunctionFrame:
        """Partial application at a point of one dimension."""
        i = [d.name for d in self.frame.dims].index(name)
        return self._new(self.frame.slice_at(name, point), {k: (lambda *x, f=f: f(*x[:i], F.lit(point), *x[i:])) for k, f in self.pieces.items()})

    def extrude(self, at: int, extent: Span) -> FunctionFrame:
        """A new dimension that the pieces don't look at."""
        return self._new(self.frame.extrude(at, extent), {k: (lambda *x, f=f: f(*x[:at], *x[at + 1 :])) for k, f in self.pieces.items()})

    def collapse(self, name: str, project: Callable[[Piece], Piece], op: Callable[[Column, Column], Column]) -> FunctionFrame:
        """Each piece projected to fewer coordinates; pieces that then overlap are combined by op in order of their starts."""
        flat = self.frame.drop_dimension(name)
        cells = flat._split(flat.df.select(*flat.columns)).groupBy(*flat.keys, *flat.bounds).agg(F.array_join(F.array_sort(F.collect_list("piece")), ",").alias("g"))
        groups = {r["g"]: i for i, r in enumerate(cells.select("g").distinct().orderBy("g").collect())}  # combinations of pieces
        pieces = {}
        for g, i in groups.items():
            fs = [project(self.pieces[int(k)]) for k in g.split(",")]
            pieces[i] = lambda *x, fs=fs: reduce(op, [f(*x) for f in fs])
        number = F.lit(None).cast("int")
        for g, i in groups.items():
            number = F.when(F.col("g") == g, i).otherwise(number)
        return FunctionFrame(IntervalFrame(cells.withColumn("piece", number), flat.dims, ("piece",), flat.keys).coalesce(), pieces)
