"""Stored frames, runs of writes, ordered folds and connected parts over tiles."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, interval
from spanloom.operators import folds, meeting, tiles
from spanloom.operators.frame import IntervalFrame, Shape
from spanloom.operators.runs import RunFrame
from spanloom.sources.clustered import Clustered

D, Y, T = Dim("x"), Dim("y"), Dim("t", "double", "continuous")


def rows(f):
    return sorted((tuple(r) for r in f.df.collect()), key=repr)


def read_by(df):
    """Rows that the scans of a query read."""
    df.collect()
    plan, seen = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plan.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            plan.append(p.plan())
            continue
        if name.startswith("Scan parquet") and "_p_x_lo" in p.toString():
            seen += p.metrics().apply("numOutputRows").value()
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return seen


def test_lookups_read_few_parts(spark):
    wide = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 7).alias("x_lo"), (F.col("id") * 7 + 300_000).alias("x_hi"), F.lit(0).cast("bigint").alias("y_lo"), F.lit(900).cast("bigint").alias("y_hi"), F.lit("wide").alias("value"))
    small = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 37 % 400_000).alias("x_lo"), (F.col("id") * 37 % 400_000 + 20).alias("x_hi"), (F.col("id") * 101 % 1000).alias("y_lo"), (F.col("id") * 101 % 1000 + 3).alias("y_hi"), F.lit("small").alias("value"))
    f = IntervalFrame(small.unionByName(wide), [D, Y], ["value"], ["k"])
    stored = Clustered.write(f, part_rows=512)
    assert stored.frame().size() == 40_050 and stored.parts.agg(F.sum("_n")).first()[0] == 40_050
    box = [interval(D, 100_000, 101_000), interval(Y, 400, 450)]
    got = stored.get_intersecting(box)
    assert rows(got) == rows(f.get_intersecting(box)) and got.size() > 50
    assert read_by(got.df) < 4_005
    at = stored.get_data_at(120_003, 440)
    assert rows(at) == sorted((tuple(r) for r in f.get_data_at(120_003, 440).collect()), key=repr) and read_by(at.df) < 4_005
    assert stored.get_intersecting([interval(D, -50, -40), interval(Y, 0, 9)]).is_empty()


def test_stored_frames_in_odd_cases(spark):
    f = IntervalFrame.of(spark, [T], [(interval(T, Open(0), 2.5), "a"), (interval(T, 2.5, TOP), "b"), (interval(T, BOTTOM, 0), "c"), (interval(T, BOTTOM, 0), "c")])
    stored = Clustered.write(f, part_rows=1)
    for p in (0.0, 1e-9, 2.5, -5.0, 1e9, TOP):
        assert sorted(r["value"] for r in stored.get_data_at(p).df.collect()) == sorted(r["value"] for r in f.get_data_at(p).collect())
    empty = Clustered.write(f._with(f.df.limit(0)))
    assert empty.frame().is_empty() and empty.get_data_at(1.0).is_empty()


def test_runs_of_writes(spark):
    r, day = random.Random(3), lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    d = Dim("day", "date")
    held: dict = {}
    like = IntervalFrame(spark.createDataFrame([], "k bigint, day_lo date, day_hi date, value string"), [d], ["value"], ["k"])
    store = RunFrame(like, buckets=4)
    assert store.frame().is_empty() and store.compact().frame().is_empty()
    for n in range(6):
        data = [] if n == 3 else [(r.choice([1, 2, None]) if n < 4 else 2, a := r.randrange(40), a + r.randint(1, 12), r.choice("pq"), i) for i in range(5)]
        for k, a, b, v, _ in data:
            held.update({(k, x): v for x in range(a, b)})
        df = spark.createDataFrame([(k, day(a), day(b), v, i) for k, a, b, v, i in data], "k bigint, day_lo date, day_hi date, value string, seq int")
        store.append(IntervalFrame(df, [d], ["value"], ["k"]).carrying(df), order=F.col("seq"))
        if n in (1, 3):
            store.compact()
    before = dict(store.generations)
    touched = store.touched()
    assert len(touched) == 1  # the last two runs wrote to one key
    got = rows(store.frame())
    store.compact()
    assert rows(store.frame()) == got
    assert {b: g for b, g in store.generations.items() if b not in touched} == {b: g for b, g in before.items() if b not in touched}
    assert {(k, x): v for k, a, b, v in got for x in range((a - day(0)).days, (b - day(0)).days)} == held


def test_ordered_folds(spark, monkeypatch):
    monkeypatch.setattr(meeting, "HOT_ROWS", 4)
    r = random.Random(5)
    data = [(k, 10 * i + (i % 3), 10 * i + 5, r.choice("abcd")) for k, n in ((0, 700), (1, 3), (None, 2)) for i in range(n)]
    r.shuffle(data)
    f = IntervalFrame(spark.createDataFrame(data, "k bigint, x_lo bigint, x_hi bigint, value string"), [D], ["value"], ["k"])
    want = {k: "".join(v for q, *_, v in sorted(data, key=lambda x: x[1]) if q == k) for k in (0, 1, None)}
    for skewed in (True, False):
        assert dict(map(tuple, folds.fold(f, F.col("value"), F.concat, skewed=skewed).collect())) == want
    assert dict(map(tuple, folds.fold_stream(f, str, lambda s, x: s + x["value"], lambda s: s, "string").collect())) == want
    one = IntervalFrame(f.df.filter("k = 0"), [D], ["value"])
    assert folds.fold(one, F.col("value"), F.concat, skewed=True).first()[0] == want[0]
    none = f._with(f.df.limit(0))
    assert folds.fold(none, F.col("value"), F.concat).collect() == [] and folds.fold_stream(none, str, lambda s, x: s, lambda s: s, "string").collect() == []


@pytest.mark.parametrize("keyed", [True, False])
def test_parts_that_cross_many_tiles(spark, monkeypatch, keyed):
    monkeypatch.setattr(tiles, "TILE_ROWS", 8)
    r = random.Random(2)
    data = [(0, 3 * i, 3 * i + 3, 50, 51) for i in range(60)]  # a chain through all tiles
    data += [(0, x, x + r.randint(1, 9), y, y + r.randint(1, 3)) for x, y in ((r.randrange(200), r.randrange(48)) for _ in range(120))] + [(0, 0, 200, 60, 61), (1, 5, 6, 5, 6), (1, 6, 7, 6, 7), (1, 9, 10, 6, 7)]
    if not keyed:
        data = [x for x in data if x[0] == 0]
    df = spark.createDataFrame(data, "k int, x_lo bigint, x_hi bigint, y_lo bigint, y_hi bigint")
    s = Shape(df, [D, Y], (), ["k"] if keyed else [])
    got = [tuple(x) for x in s.components().collect()]
    boxes = sorted(set(data)) if keyed else sorted({x[1:] for x in data})
    n = len(boxes[0]) - 4
    meets = lambda a, b: a[:n] == b[:n] and a[n] <= b[n + 1] and b[n] <= a[n + 1] and a[n + 2] <= b[n + 3] and b[n + 2] <= a[n + 3]
    label = {b: i for i, b in enumerate(boxes)}
    while True:
        new = {a: min(label[b] for b in boxes if meets(a, b)) for a in boxes}
        if new == label:
            break
        label = new
    groups = lambda pairs: sorted(sorted(b for b, c in pairs if c == x) for x in {c for _, c in pairs})
    assert groups([(x[:-1], x[-1]) for x in got]) == groups(list(label.items()))


def test_union_find_of_a_tile():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, c = rng.integers(0, 30, (2, 40))
        spans = [(a, a + rng.integers(1, 5, 40)), (c, c + rng.integers(1, 5, 40))]
        part = tiles.parts(spans)
        meet = np.logical_and.reduce([(x[:, None] <= y[None]) & (x[None] <= y[:, None]) for x, y in spans])
        reach = np.linalg.matrix_power(meet.astype(float), 64) > 0
        assert ((part[:, None] == part[None]) == reach).all()
