"""Versioned frames: a leading dimension of versions, a pointer to the current one, a log, and approvals.

A write made at a version holds from it on, so what is written at the current version is seen by all later ones, and what
is written as unapproved (the greatest version) waits until it is approved. Clocks are always given, never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cuts import TOP, Box, Dim, Span, equivalent, interval, interval_from
from .frame import IntervalFrame, _boxed

VERSION = Dim("version")
#: The version of what isn't approved yet.
UNAPPROVED = (1 << 31) - 1
CURRENT = "current"


@dataclass(frozen=True)
class Versioned:
    """An IntervalFrame whose first dimension is VERSION, with the current version and a log of (version, time, comment)."""

    frame: IntervalFrame
    current: int = 0
    log: tuple[tuple[int, Any, str], ...] = field(default=())
    initial: int = 0

    @classmethod
    def from_frame(cls, data: IntervalFrame, *, now: Any, version: int = 0, comment: str = "init") -> Versioned:
        """Rows valid from the initial version on."""
        return cls(data.extrude(0, interval_from(VERSION, version)), version, ((version, now, comment),), version)

    @classmethod
    def empty(cls, spark: SparkSession, dims: list[Dim], value_type: str = "string", *, now: Any) -> Versioned:
        return cls.from_frame(IntervalFrame.empty(spark, dims, (value_type,)), now=now)

    def boundary(self, selection: Any = CURRENT) -> int:
        """CURRENT, UNAPPROVED or a number."""
        return self.current if selection == CURRENT else int(selection)

    # --- reading ---
    def selected(self, selection: Any = CURRENT) -> IntervalFrame:
        """What is valid at a version; all of IntervalFrame's look-ups apply to it."""
        return self.frame.slice_at(VERSION.name, self.boundary(selection))

    def get_at(self, *point, selection: Any = CURRENT) -> DataFrame:
        return self.selected(selection).get_at(*point)

    def is_valid_at(self, *point, selection: Any = CURRENT) -> bool:
        return self.selected(selection).is_defined_at(*point)

    def timestamps(self, spark: SparkSession) -> DataFrame:
        """The version log as a table."""
        return spark.createDataFrame([(v, str(t), c) for v, t, c in self.log], "version bigint, time string, comment string")

    # --- writing from a version on ---
    def _from(self, box: Box | Span, selection: Any) -> Box:
        return [interval_from(VERSION, self.boundary(selection)), *_boxed(box)]

    def _do(self, frame: IntervalFrame) -> Versioned:
        return replace(self, frame=frame)

    def set(self, box: Box | Span, value, *, selection: Any = CURRENT) -> Versioned:
        return self._do(self.frame.set(self._from(box, selection), value))

    def set_many(self, rows: IntervalFrame, *, selection: Any = CURRENT, order: Column | None = None) -> Versioned:
        extent = interval_from(VERSION, self.boundary(selection))
        more = rows.extrude(0, extent)
        if hasattr(rows, "_full"):
            more.carrying(rows.df_full.withColumns({VERSION.lo: F.lit(extent.lo), VERSION.hi: F.lit(extent.hi)}))
        return self._do(self.frame.set_many(more, order=order))

    def set_if_no_conflict(self, box: Box | Span, value, *, selection: Any = CURRENT) -> Versioned | None:
        out = self.frame.set_if_no_conflict(self._from(box, selection), value)
        return None if out is None else self._do(out)

    def update(self, box: Box | Span, value, *, selection: Any = CURRENT) -> Versioned:
        return self._do(self.frame.update(self._from(box, selection), value))

    def remove(self, box: Box | Span, *, selection: Any = CURRENT) -> Versioned:
        return self._do(self.frame.remove(self._from(box, selection)))

    def remove_value(self, value, *, selection: Any = CURRENT) -> Versioned:
        v = self.boundary(selection)
        hit = self.frame._is(value)
        # the value's rows end where the selected version begins
        cut = F.when(hit, F.least(F.col(VERSION.hi), F.lit(v))).otherwise(F.col(VERSION.hi))
        return self._do(self.frame._with(self.frame.df.withColumn(VERSION.hi, cut).filter(F.col(VERSION.lo) < F.col(VERSION.hi))).coalesce())

    def fill(self, box: Box | Span, value, *, selection: Any = CURRENT) -> Versioned:
        return self._do(self.frame.fill(self._from(box, selection), value))

    # --- versions ---
    def set_current(self, version: int, *, now: Any, comment: str = "version set") -> Versioned:
        if not 0 <= version < UNAPPROVED:
            raise ValueError(f"no such version: {version}")
        log = (*(x for x in self.log if x[0] != version), (version, now, comment))
        return replace(self, current=version, log=tuple(sorted(log, key=lambda x: x[0])))

    def increment(self, *, now: Any, comment: str = "incremented") -> Versioned:
        return self.set_current(self.current + 1, now=now, comment=comment)

    def reset_to(self, version: int) -> Versioned:
        """Forgets what began after a version; what reaches it goes on for ever."""
        df = self.frame.df.filter(F.col(VERSION.lo) <= version).withColumn(VERSION.hi, F.when(F.col(VERSION.hi) > version, F.lit(VERSION.last)).otherwise(F.col(VERSION.hi)))
        return replace(self, frame=self.frame._with(df).coalesce(), current=version, log=tuple(x for x in self.log if x[0] <= version))

    def collapse_history(self, *, now: Any, selection: Any = CURRENT) -> Versioned:
        """The selected state as version 0, without history."""
        return Versioned.from_frame(self.selected(selection), now=now)

    # --- approvals ---
    def approve(self, box: Box | Span, value) -> Versioned | None:
        """Makes an unapproved row current if the first unapproved row that meets its box is exactly it; else None."""
        waiting = self._waiting().get_intersecting(box)
        row = waiting.get_all().limit(1)
        same = equivalent(waiting.box(), waiting._literal(box)) & waiting._is(value)
        return None if row.filter(same).isEmpty() else self.set(box, value)

    def _waiting(self) -> IntervalFrame:
        """Rows that begin as unapproved."""
        f = self.frame.filter(F.col(VERSION.lo) == UNAPPROVED)
        return f.drop_dimension(VERSION.name)

    def approve_all(self, box: Box | Span) -> Versioned:
        """Makes all unapproved rows that meet a box current; what is removed but not yet approved so goes too, inside the box only."""
        rows = self._waiting().get_intersecting(box)
        out = self.set_many(rows)
        gone = out.frame.filter(F.col(VERSION.hi) == UNAPPROVED).drop_dimension(VERSION.name).clip(box)
        removed = gone.difference(out.selected(UNAPPROVED))
        whole = removed.extrude(0, interval(VERSION, self.current, TOP))
        return out._do(out.frame.difference(whole))

    def approve_rows(self, rows: IntervalFrame) -> Versioned:
        """approve, row by row and key by key: a row becomes current if the first unapproved row of its key that meets its box is exactly it; all others change nothing."""
        waiting = self._waiting()
        met = rows._joined(waiting)
        first = Window.partitionBy(*rows.keys, *rows.bounds, *rows.values).orderBy(*[f"_r_{d.lo}" for d in rows.dims])
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in [*rows.bounds, *rows.values]])
        exact = met.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1).filter(same)
        return self.set_many(rows._with(exact.select(*rows.columns)))

    # --- whole tables ---
    def merge(self, that: Versioned, combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> Versioned:
        """Merged data; of both logs the later time of a version, comments joined by &."""
        logs: dict[int, tuple[Any, str]] = {}
        for v, t, c in (*self.log, *that.log):
            old = logs.get(v)
            logs[v] = (t, c) if old is None else (max(old[0], t), f"{old[1]} & {c}")
        log = tuple((v, *x) for v, x in sorted(logs.items()))
        return replace(self, frame=self.frame.merge(that.frame, combine), current=max(self.current, that.current), log=log)

    def diff_actions_from(self, old: Versioned) -> DataFrame:
        return self.frame.diff_actions_from(old.frame)

    def diff_actions_between(self, old: int, new: int) -> DataFrame:
        return self.reset_to(new).frame.diff_actions_from(self.reset_to(old).frame)

    def zip(self, that: Versioned) -> Versioned:
        return self._do(self.frame.zip(that.frame))

    def zip_all(self, that: Versioned, this_default: dict, that_default: dict) -> Versioned:
        return self._do(self.frame.zip_all(that.frame, this_default, that_default))

    def slice_at(self, name: str, point) -> Versioned:
        return self._do(self.frame.slice_at(name, point))

    # --- row by row, over all versions ---
    def filter(self, test: Column) -> Versioned:
        return self._do(self.frame.filter(test))

    def map_values(self, **exprs: Column) -> Versioned:
        return self._do(self.frame.map_values(**exprs))

    def map_intervals(self, dims: dict[Dim, tuple[Column, Column]]) -> Versioned:
        """New cuts of the data's dimensions; versions stay."""
        return self._do(self.frame.map_intervals(self._kept(dims)))

    def map(self, dims: dict[Dim, tuple[Column, Column]], **exprs: Column) -> Versioned:
        return self._do(self.frame.map(self._kept(dims), **exprs))

    def _kept(self, dims: dict[Dim, tuple[Column, Column]]) -> dict[Dim, tuple[Column, Column]]:
        return {VERSION: (F.col(VERSION.lo), F.col(VERSION.hi)), **dims}

    def collect(self, defined: Column, **exprs: Column) -> Versioned:
        return self._do(self.frame.collect(defined, **exprs))

    def flat_map(self, rows: Column) -> Versioned:
        """Each row becomes the structs of an array (bounds, with those of the version, and values by name)."""
        return self._do(self.frame.flat_map(rows))

    def compress(self, value) -> Versioned:
        return self._do(self.frame.compress(value))

    def compress_all(self) -> Versioned:
        return self._do(self.frame.coalesce())

    def recompress_all(self, *grid: IntervalFrame) -> Versioned:
        return self._do(self.frame.recompress_all(*grid))

    def apply_diff_actions(self, actions: DataFrame) -> Versioned:
        return self._do(self.frame.apply_diff_actions(actions))

    def sync_with(self, that: Versioned) -> Versioned:
        return self._do(self.frame.sync_with(that.frame))


@dataclass(frozen=True)
class Variable:
    """A value that changes over time: an unbounded history in whole nanoseconds, one row a change."""

    frame: IntervalFrame
    TIME = Dim("time_ns")

    @classmethod
    def of(cls, spark: SparkSession, value, value_type: str = "string") -> Variable:
        return cls(IntervalFrame.of_value(spark, [cls.TIME], value, value_type))

    @classmethod
    def from_history(cls, history: IntervalFrame) -> Variable:
        return cls(history)

    def last_change(self) -> int | None:
        """When the last change was made; None if there was none."""
        row = self.frame.df.filter(F.col(self.TIME.lo) != F.lit(self.TIME.first)).agg(F.max(self.TIME.lo)).first()
        return row[0]

    def set(self, value, *, now: int) -> Variable:
        """The value from now on; a clock that didn't advance moves on by ten nanoseconds."""
        last = self.last_change()
        at = now if last is None or now > last else last + 10
        return Variable(self.frame.update(interval(self.TIME, at, TOP), value))

    def unset(self) -> Variable:
        """Undoes the last change."""
        last = self.last_change()
        if last is None:
            return self
        d = self.TIME
        df = self.frame.df.filter(F.col(d.lo) < last).withColumn(d.hi, F.when(F.col(d.hi) >= last, F.lit(d.last)).otherwise(F.col(d.hi)))
        return Variable(self.frame._with(df))

    def reset(self) -> Variable:
        """Forgets history and keeps the present value."""
        d = self.TIME
        df = self.frame.df.filter(F.col(d.hi) == F.lit(d.last)).withColumn(d.lo, F.lit(d.first))
        return Variable(self.frame._with(df))

    def get(self):
        return self.frame.get_at(TOP).first()[0]

    def get_prior(self):
        last = self.last_change()
        return None if last is None else self.get_at(last - 1)

    def get_at(self, time_ns: int):
        return self.frame.get_at(time_ns).first()[0]

    def history(self) -> DataFrame:
        return self.frame.get_all()


class Variables:
    """Many variables, one a key: the table of their histories, one row a value and its time in whole nanoseconds."""

    TIME = Variable.TIME

    def __init__(self, frame: IntervalFrame):
        self.frame = frame

    @classmethod
    def from_changes(cls, changes: DataFrame, keys: list[str], *, time: Column, value: Column, order: list[Column], initial: Any) -> Variables:
        """Each change sets its key's variable, in order; a change whose clock didn't advance since the last one comes ten nanoseconds after it, and setting the value that holds changes nothing. Before the first change the initial value holds. Sorted rows, with the state of a key carried from batch to batch."""
        rows = changes.select(*keys, time.cast("bigint").alias("_now"), value.alias("value"), F.struct(*order).alias("_o"))
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_o").drop("_o")
        d = cls.TIME
        every = rows.select(*keys).distinct()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_now")

        def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, last, held = None, None, None
            for batch in batches:
                kept, at = [], []
                for i, (*key, now, v) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    if here != key:
                        here, last, held = key, None, initial
                    if v != held:
                        last, held = now if last is None or now > last else last + 10, v
                        kept.append(i)
                        at.append(last)
                out = batch.take(pa.array(kept, pa.int64()))
                yield pa.record_batch([*[out.column(k) for k in keys], out.column("value"), pa.array(at, pa.int64())], [*keys, "value", "_at"])

        sets = rows.mapInArrow(timed, f"{kinds}, _at bigint")
        begins = sets.select(*keys, F.col("_at").alias(d.lo), "value").unionByName(every.select(*keys, F.lit(d.first).alias(d.lo), F.lit(initial).cast(rows.schema["value"].dataType).alias("value")))
        ends = F.coalesce(F.lead(d.lo).over(Window.partitionBy(*keys).orderBy(d.lo)), F.lit(d.last))
        return cls(IntervalFrame(begins.withColumn(d.hi, ends), [d], ["value"], keys))

    def history(self) -> DataFrame:
        return self.frame.get_all()

    def get(self) -> DataFrame:
        """(keys, value) now."""
        return self.frame.get_at(TOP)

    def get_at(self, time_ns: int) -> DataFrame:
        return self.frame.get_at(time_ns)

    def last_changes(self) -> DataFrame:
        """(keys, changed, prior): when each variable last changed (null if never) and its value before."""
        d = self.TIME
        w = Window.partitionBy(*self.frame.keys).orderBy(d.lo)
        prior = self.frame.df.withColumn("prior", F.lag("value").over(w))
        return prior.filter(F.col(d.hi) == d.last).select(*self.frame.keys, F.when(F.col(d.lo) != d.first, F.col(d.lo)).alias("changed"), "prior")

    def unset(self) -> Variables:
        """Undoes each variable's last change; those that never changed stay."""
        d = self.TIME
        w = Window.partitionBy(*self.frame.keys).orderBy(d.lo)
        marked = self.frame.df.withColumns({"_next": F.lead(d.lo).over(w), "_last": F.max(d.lo).over(Window.partitionBy(*self.frame.keys))})
        kept = marked.filter((F.col(d.lo) < F.col("_last")) | (F.col(d.lo) == d.first)).withColumn(d.hi, F.when(F.col("_next") == F.col("_last"), F.lit(d.last)).otherwise(F.col(d.hi)))
        return Variables(self.frame._with(kept))

    def reset(self) -> Variables:
        """Forgets history and keeps the present values."""
        d = self.TIME
        return Variables(self.frame._with(self.frame.df.filter(F.col(d.hi) == d.last).withColumn(d.lo, F.lit(d.first))))
