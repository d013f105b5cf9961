"""Connected parts of boxes in several dimensions.

A key's boxes are one tile, or, where there are very many, lie in tiles of equal numbers of boxes along the first dimension
(on the key's own scale, see `meeting`); a box that reaches into several tiles is copied to each. One pass joins the boxes
of each tile by union-find behind a sweep. The boxes that lie in several tiles then link the parts found there: a graph of
parts at tiles' borders, whatever the number of boxes, whose labels spread in rounds that grow with the logarithm of a
chain of tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import Dim
from ..sources.staging import stage
from . import meeting

#: Boxes of a tile, on the average of a key's tiles.
TILE_ROWS = 16_384


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _plain(d: Dim, c: str) -> tuple[Column, Column]:
    """A cut as a number that keeps its order, and its side."""
    v, side = (_col(c), F.lit(0)) if d.discrete else (_col(c)["v"], _col(c)["side"])
    if d.type == "date":
        v = F.unix_date(v).cast("bigint")
    elif d.type.startswith("timestamp"):
        v = F.unix_micros(v.cast("timestamp"))
    return v, side.cast("int")


def components(df: DataFrame, dims: list[Dim], keys: list[str], *, skewed: bool | None = None) -> DataFrame:
    """df's different rows (keys and bounds) with `component`, the least number of a row in the connected part."""
    bounds = [c for d in dims for c in (d.lo, d.hi)]
    one = df.select(*keys, *bounds).dropDuplicates().withColumn("_id", F.xxhash64(*keys, *bounds))
    rows = stage(one if keys else one.withColumn("_all", F.lit(0)), "regions")
    by, d = keys or ["_all"], dims[0]
    hot = meeting.hot_keys(by, d, [(rows, d.lo, d.hi)], most=TILE_ROWS, skewed=skewed is not False)
    flat = rows.select(*by, "_id", *[x.alias(f"_{n}{k}{e}") for k, y in enumerate(dims) for e, c in (("a", y.lo), ("b", y.hi)) for n, x in zip("vs", _plain(y, c), strict=True)], d.lo, d.hi)
    if hot is None:
        tiled = flat.withColumn("_tile", F.lit(0).cast("bigint"))
    else:
        at = lambda c, end: F.coalesce(F.floor(meeting.placed(meeting.number(d, _col(c))) / (2.0 * TILE_ROWS)), end).cast("bigint")
        there = meeting.with_scale(flat, by, hot)
        first, last = at(d.lo, F.lit(0)), at(d.hi, F.floor(F.col("_n") / (2.0 * TILE_ROWS)))
        tiled = there.withColumn("_tile", F.explode(F.when(F.col("_q").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, F.greatest(first, last))))).drop("_q", "_n")
    tiled = tiled.drop(d.lo, d.hi)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    # small keys by the thousand in one call, which costs more than the work on a few boxes
    calls = max(1, -(-rows.count() // TILE_ROWS))
    tiled = tiled.withColumn("_group", F.xxhash64(*by, "_tile")).withColumn("_call", F.pmod("_group", F.lit(calls)))
    local = stage(tiled.groupBy("_call").applyInArrow(_joined(len(dims), by), f"{kinds}, _id bigint, _part bigint"), "parts")
    if hot is None:
        return rows.join(local.select(F.col("_id").alias("_i"), F.col("_part").alias("component")), F.col("_id") == F.col("_i")).select(*keys, *bounds, "component")
    # a row's parts are one part
    least = F.min("_part").over(Window.partitionBy("_id"))
    links = local.select("_part", least.alias("_least")).filter("_part <> _least").distinct()
    links = stage(links.select(F.col("_part").alias("a"), F.col("_least").alias("b")).unionByName(links.select(F.col("_least").alias("a"), F.col("_part").alias("b"))).distinct(), "borders")
    of = local.groupBy("_id").agg(F.min("_part").alias("_part"))
    labels = spread(links)
    named = of.join(labels, F.col("_part") == F.col("i"), "left").select(F.col("_id").alias("_i"), F.coalesce("c", "_part").alias("component"))
    return rows.join(named, F.col("_id") == F.col("_i")).select(*keys, *bounds, "component")


def spread(links: DataFrame) -> DataFrame:
    """(i, c): for each node of a graph (a, b), links in both directions, the least node of its part. Labels spread along links and jump to the labels of their labels."""
    labels = stage(links.select(F.col("a").alias("i")).distinct().withColumn("c", F.col("i")), "labels")
    while True:
        near = links.join(labels, links.b == labels.i).groupBy("a").agg(F.min("c").alias("n"))
        least = labels.join(near, labels.i == near.a, "left").select("i", "c", F.least("c", F.coalesce("n", "c")).alias("n"))
        hop = labels.select(F.col("i").alias("_i"), F.col("c").alias("_c"))
        lent = least.groupBy(F.col("c").alias("_l")).agg(F.min("n").alias("_m"))  # what a label's rows met
        new = stage(least.join(hop, F.col("n") == F.col("_i")).join(lent, F.col("i") == F.col("_l"), "left").select("i", "c", F.least("n", "_c", F.coalesce("_m", "n")).alias("n")), "labels")
        labels = new.select("i", F.col("n").alias("c"))
        if new.filter("n <> c").isEmpty():
            return labels


def _joined(dims: int, by: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("_id").to_numpy()
        spans = []
        for k in range(dims):
            v, s = (np.concatenate([t.column(f"_{n}{k}{e}").to_numpy() for e in "ab"]) for n in "vs")
            order = np.lexsort((s, v))
            new = np.append(True, (np.diff(v[order]) != 0) | (np.diff(s[order]) != 0))
            rank = np.empty(len(v), np.int64)
            rank[order] = np.cumsum(new)
            spans.append((rank[: len(ids)], rank[len(ids) :]))
        part = parts(spans, t.column("_group").to_numpy())
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, part, ids)
        return pa.table([*[t.column(k) for k in by], pa.array(ids), pa.array(least[part])], names=[*by, "_id", "_part"])

    return run


def parts(spans: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray | None = None) -> np.ndarray:
    """For each box (its two cuts in every dimension) the number of a box of the same connected part: boxes of a group that overlap or touch. A sweep along the first dimension, group by group, compares each box with those that reach it."""
    a, b = spans[0]
    root = list(range(len(a)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    group = np.zeros(len(a), np.int64) if group is None else group
    active, here = np.empty(0, np.int64), None
    for n, i in enumerate(np.lexsort((b, a, group)).tolist()):
        if group[i] != here:
            active, here = np.empty(0, np.int64), group[i]
        elif n % 64 == 0:
            active = active[b[active] >= a[i]]
        near = b[active] >= a[i]
        for x, y in spans[1:]:
            near &= (x[active] <= y[i]) & (x[i] <= y[active])
        mine = find(i)
        for j in {find(j) for j in active[near].tolist()}:
            root[j] = mine
        active = np.append(active, i)
    return np.array([find(i) for i in range(len(a))], np.int64)
