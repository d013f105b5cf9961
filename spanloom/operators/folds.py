"""Ordered folds over the rows of a key that don't gather the key.

An associative operation folds in any grouping that keeps the order: rows are dealt into parts of a key by the order of
their starts (keys of very many rows on their own scale, see `meeting`), each part folds by itself, and the parts' states
fold again, part by part, until a key has one state. No task holds more than a part's rows. `lift` makes a state of a row;
`combine` joins the state of earlier rows with that of later ones.

Any other operation needs its rows one after the other: `fold_stream` sorts them in place and carries the state of a key
from batch to batch, so that memory holds a batch whatever a key's size.

Cases: keys without rows have no result; a key of one row gives its lifted state; rows that start together (in frames whose
rows overlap) go by their ends, then by their values; null keys are a key; an empty frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import meeting
from .frame import IntervalFrame

#: States that one step gathers: parts of a part.
FAN_IN = 4096


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def fold(frame: IntervalFrame, lift: Column, combine: Callable[[Column, Column], Column], *, name: str = "result", skewed: bool | None = None) -> DataFrame:
    """(keys, result): the states of each key's rows combined in order of start."""
    d, keys = frame.dims[0], list(frame.keys)
    by = keys or ["_all"]
    rows = frame.df if keys else frame.df.withColumn("_all", F.lit(0))
    hot = meeting.hot_keys(by, d, [(rows, d.lo, d.hi)], skewed=skewed if skewed is not None else frame.skewed)
    dealt = rows.withColumn("_part", F.lit(0).cast("bigint")) if hot is None else meeting.dealt(rows, by, d, d.lo, hot)
    order = F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate([*[x.lo for x in frame.dims], *[x.hi for x in frame.dims], *frame.values])])
    states = dealt.select(*by, "_part", order.alias("_o"), lift.alias("_s")).groupBy(*by, "_part").agg(_folded("_o", combine))
    if hot is not None:  # the parts of a key, in groups of neighbours, until one is left
        most = states.agg(F.max("_part")).first()[0] or 0
        while most > 0:
            states = states.select(*by, F.col("_part").alias("_o"), "_s", F.floor(F.col("_part") / FAN_IN).cast("bigint").alias("_part")).groupBy(*by, "_part").agg(_folded("_o", combine))
            most //= FAN_IN
    return states.select(*keys, F.col("_s").alias(name))


def _folded(order: str, combine: Callable[[Column, Column], Column]) -> Column:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "_s"))), lambda x: x["_s"])
    return F.aggregate(F.slice(listed, 2, F.size(listed)), F.element_at(listed, 1), lambda a, b: combine(a, b)).alias("_s")


def fold_stream(frame: IntervalFrame, start: Callable[[], Any], step: Callable[[Any, dict], Any], finish: Callable[[Any], Any], result: str, *, name: str = "result") -> DataFrame:
    """(keys, result) by a Python function of state and row, for operations that aren't associative: rows in order of start, a batch in memory at a time. result is the Spark type of what finish returns."""
    keys = list(frame.keys)
    by = keys or ["_all"]
    rows = frame.df if keys else frame.df.withColumn("_all", F.lit(0))
    sorted_rows = rows.repartition(*[_col(k) for k in by]).sortWithinPartitions(*[_col(c) for c in [*by, *[d.lo for d in frame.dims], *[d.hi for d in frame.dims], *frame.values]])
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{kinds}, `{name}` {result}"
    arrow = _arrow_schema(sorted_rows, by, name, result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, done = None, None, []

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip([*by, name], x, strict=True)) for x in done], arrow)
            done.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in by)
                if here is None or key != here:
                    if here is not None:
                        done.append((*here, finish(state)))
                    here, state = key, start()
                state = step(state, r)
            if len(done) > 10_000:
                yield flushed()
        if here is not None:
            done.append((*here, finish(state)))
        yield flushed()

    return sorted_rows.mapInArrow(run, schema).select(*keys, name)


def _arrow_schema(df: DataFrame, by: list[str], name: str, result: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*by).withColumn(name, F.lit(None).cast(result)).schema)
