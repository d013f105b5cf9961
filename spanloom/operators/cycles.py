"""Runs over time: what a structure is known to be at each of a few moments, and what is to be paid or given back between them.

A cycle has a moment at which it is run and a day up to which it bills. What it knows are the writes known by then, cut off
at that day; its transactions are the signed changes since the cycle before it, at the rates of their days. Cycles are keys,
so all are made in one plan: a write is copied once for each cycle that knows it. Sums over cycles telescope: what was paid
in all is what the last cycle knows, however often the past was changed in between.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Dim, measure
from ..sources.staging import stage
from .frame import IntervalFrame, timeline

CYCLE = "cycle"


@dataclass(frozen=True)
class Cycle:
    """number; the day of the run; the first day that isn't billed any more."""

    number: int
    run: dt.date
    upto: dt.date


def as_known(df: DataFrame, dim: Dim, start: Column, value: Column, known: Column, keys: Iterable[str], order: list[Column], cycles: list[Cycle]) -> IntervalFrame:
    """The timeline of each key (`value` from `start` on) as each cycle knows it, up to the cycle's last day; `cycle` is one more key. Rows without a day of knowledge are known to none."""
    told = F.array(*[F.struct(F.lit(c.number).alias("n"), F.lit(c.run).alias("run"), F.lit(c.upto).alias("upto")) for c in cycles])
    rows = df.withColumns({"_s": start, "_k": known}).withColumn("_c", F.explode(F.filter(told, lambda c: (F.col("_k") <= c["run"]) & (F.col("_s") < c["upto"]))))
    line = timeline(rows.withColumn(CYCLE, F.col("_c.n")), dim, F.col("_s"), value, [*keys, CYCLE], order)
    upto = F.element_at(F.create_map(*[F.lit(x) for c in cycles for x in (c.number, c.upto)]), F.col(CYCLE))
    return line._with(line.df.withColumn(dim.hi, F.least(dim.hi, upto)))


def transactions(known: IntervalFrame, cycles: list[Cycle], rates: IntervalFrame, *, amount: str = "amount") -> DataFrame:
    """(keys, cycle, value, bounds, amount): bills (positive) and refunds (negative) of each cycle but the first, which stands for what is settled.

    known is keyed by a last key `cycle` and has one value of one dimension; rates are keyed by the value and give a rate a
    unit of length. Periods are cut where rates change; those without a rate cost nothing and are left out. What a cycle
    knows as the one before it did gives no transaction.
    """
    *keys, cycle = known.keys
    known = known._with(stage(known.df, "known"))  # both sides of the differences
    (value,), (rate,), (tier,), d = known.values, rates.values, rates.keys, known.dims[0]
    after = F.create_map(*[F.lit(x) for c, n in pairwise(cycles) for x in (c.number, n.number)])
    prior = known.df.filter(F.col(cycle) != cycles[-1].number).withColumn(cycle, F.element_at(after, F.col(cycle)))
    changes = known._with(known.df.filter(F.col(cycle) != cycles[0].number)).signed_changes_from(known._with(prior))
    due = IntervalFrame(changes.withColumnRenamed(value, tier), known.dims, (*keys, cycle, "sign"), rates.keys)
    z = due.zip(rates)
    return z.df.select(*keys, cycle, F.col(tier).alias(value), d.lo, d.hi, (F.col("sign") * F.col(rate) * measure(z.box())).alias(amount))
