"""Keys of very many rows, and boxes in several dimensions: the same results as by key alone and as on the whole grid, with bounded copies."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.cuts import BOTTOM, TOP, Dim
from spanloom.operators import meeting
from spanloom.operators.frame import IntervalFrame, Shape

D, Y, Z = Dim("x"), Dim("y"), Dim("z")


def disjoint(seed, sizes, *, key=0):
    """Rows of a few keys, of which the first has most, some unbounded."""
    r, out = random.Random(seed), []
    for k, n in enumerate(sizes):
        at = sorted(r.sample(range(20 * n + 10), 2 * n))
        rows = [(a, b) for a, b in zip(at[::2], at[1::2], strict=True)]
        for i, (a, b) in enumerate(rows):
            lo = BOTTOM if i == 0 and seed % 2 else a
            hi = TOP if i == n - 1 and seed % 3 else b - 1
            out.append((k + key, lo, hi, r.choice("pqr")))
    return out


def frame(spark, rows, *, skewed):
    made = [(k, D.start(lo), D.end(hi), v) for k, lo, hi, v in rows]
    df = spark.createDataFrame([(k, a, b, v) for k, a, b, v in made], "k bigint, x_lo bigint, x_hi bigint, value string")
    return IntervalFrame(df, [D], ["value"], ["k"]).on_keys(skewed=skewed)


def rows(f):
    return sorted((tuple(r) for r in f.df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(meeting, "HOT_ROWS", 16)


@pytest.mark.parametrize("seed", [2])
def test_many_rows_of_a_key_meet_as_by_key(spark, small, seed):
    a, b = disjoint(seed, [400, 5, 1, 30]), disjoint(seed + 5, [300, 4, 2, 20])
    pairs = [[frame(spark, x, skewed=s) for x in (a, b)] for s in (True, False)]
    for f in (
        lambda x, y: x.zip(y), lambda x, y: x.zip_all(y, {"value": "<"}, {"value": ">"}), lambda x, y: x.difference(y), lambda x, y: x.coalesce(), lambda x, y: x.set_many(y),
    ):
        got, want = (rows(f(x, y)) for x, y in pairs)
        assert got == want and got


def test_overlapping_rows_of_a_key_and_long_ones(spark, small):
    r = random.Random(4)
    many = [(0, x := r.randrange(3000), x + r.choice([1, 5, 40, 2500]), "v") for _ in range(300)] + [(0, BOTTOM, TOP, "all"), (1, 5, 9, "w")]
    few = [(0, x := r.randrange(3000), x + r.choice([1, 900]), "u") for _ in range(100)] + [(0, 7, TOP, "half"), (1, 9, 9, "w"), (2, 0, 1, "none")]
    got, want = (rows(frame(spark, many, skewed=s).zip(frame(spark, few, skewed=s))) for s in (True, False))
    brute = sorted((k, D.start(max(lo, p, key=lambda e: D.start(e))), D.end(min(hi, q, key=lambda e: D.end(e))), v, w) for k, lo, hi, v in many for m, p, q, w in few if k == m and D.start(lo) < D.end(q) and D.start(p) < D.end(hi))
    assert got == want and [tuple(x) for x in got] == sorted(brute, key=repr)


def test_copies_and_bins_are_bounded(spark):
    """A key of 60,000 disjoint rows beside 500 keys of five: on the average two or three copies a row, and no bin with more than a few times its share."""
    def made(shift):
        hot = spark.range(60_000).select(F.lit(0).cast("bigint").alias("k"), (F.col("id") * 10 + shift).alias("x_lo"), (F.col("id") * 10 + shift + 7).alias("x_hi"), F.lit("v").alias("value"))
        cold = spark.range(2_500).select((F.col("id") % 500 + 1).alias("k"), (F.col("id") * 3).alias("x_lo"), (F.col("id") * 3 + 2).alias("x_hi"), F.lit("v").alias("value"))
        return IntervalFrame(hot.unionByName(cold), [D], ["value"], ["k"])

    a, b = made(0), made(4)
    right = b.df.select(*[F.col(c).alias(f"_r_{c}") for c in b.columns])
    hot = meeting.hot_keys(["k"], D, [(a.df, "x_lo", "x_hi"), (b.df, "x_lo", "x_hi")], skewed=True)
    assert [r[0] for r in hot.select("_h_k").collect()] == [0]
    left, right, _ = meeting.binned(["k"], a.df, ("x_lo", "x_hi"), right, ("_r_x_lo", "_r_x_hi"), ["_r_k"], D, hot)
    assert left.count() <= 3 * 62_500 and right.count() <= 3 * 62_500
    most = left.groupBy("k", "_l_stay", "_l_bin").count().agg(F.max("count")).first()[0]
    assert most <= meeting.HOT_ROWS
    met = a.on_keys(skewed=True).zip(b).df
    few = [x.filter(F.col("k") > 0).on_keys(skewed=False) for x in (a, b)]
    assert met.groupBy((F.col("k") > 0).alias("few")).count().orderBy("few").collect() == [(False, 119_999), (True, few[0].zip(few[1]).size())]


def test_small_inputs_cost_no_count(spark):
    assert meeting.hot_keys(["k"], D, [(spark.range(5).selectExpr("id k", "id x_lo", "id + 1 x_hi"), "x_lo", "x_hi")]) is None


def boxes(spark, seed, n, dims, *, keys=3, wide=3, span=30):
    r = random.Random(seed)
    side = lambda x: (x, x + r.randint(1, wide))
    data = [(r.randrange(keys), *[c for _ in dims for c in side(r.randrange(span))], r.choice("pq"), i) for i in range(n)]
    names = ", ".join(f"{d.lo} bigint, {d.hi} bigint" for d in dims)
    df = spark.createDataFrame(data, f"k bigint, {names}, value string, seq bigint")
    return IntervalFrame(df, dims, ["value"], ["k"]).carrying(df), data


@pytest.mark.parametrize(("dims", "n", "span"), [((D, Y), 60, 30), ((D, Y, Z), 30, 9)])
def test_overlay_without_the_grid_is_canonical(spark, monkeypatch, dims, n, span):
    f, data = boxes(spark, 7, n, dims, span=span)
    base = f._with(f.df.limit(0))
    got = base.set_many(f, order=F.col("seq"))
    cut = f._nested(f.df).count()
    want = {}
    for k, *bounds, v, _ in data:
        want.update({(k, *p): v for p in _points(bounds)})
    cells = {}
    for k, *bounds, v in got.df.collect():
        for p in _points(bounds):
            assert (k, *p) not in cells
            cells[k, *p] = v
    assert cells == want
    shape = Shape(f.df, dims, (), ["k"])
    more = (lambda: rows(shape.complement())) if len(dims) == 2 else (lambda: rows(shape.recompress_all()))
    nested = [rows(got), more()]
    monkeypatch.setattr(IntervalFrame, "_nested", IntervalFrame._split)
    assert nested == [rows(base.set_many(f, order=F.col("seq"))), more()]
    assert cut < 0.7 * f._split(f.df).count()


def _points(bounds):
    out = [()]
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        out = [(*p, x) for p in out for x in range(a, b)]
    return out


def test_cells_grow_with_overlaps_not_with_the_grid(spark):
    """A staircase of boxes that don't meet: as many cells as boxes, where the grid has their square."""
    df = spark.range(300).select(F.lit(1).alias("k"), *[c for d in (D, Y) for c in ((F.col("id") * 3).alias(d.lo), (F.col("id") * 3 + 2).alias(d.hi))], F.lit("v").alias("value"))
    wide = spark.createDataFrame([(2, 0, 900, 0, 900, "base")], "k int, x_lo bigint, x_hi bigint, y_lo bigint, y_hi bigint, value string")
    f = IntervalFrame(df.unionByName(wide).unionByName(df.withColumn("k", F.lit(2))), [D, Y], ["value"], ["k"])
    cut = f._nested(f.df)
    assert cut.filter("k = 1").count() == 300
    assert cut.filter("k = 2").count() < 300 * 10


def test_cells_shuffle_their_rows_once_and_join_nothing(spark):
    """What large inputs take: rows are dealt by key, and windows gather the cuts of a key."""
    f = IntervalFrame(spark.range(200).selectExpr("id % 20 k", "id % 9 x_lo", "id % 9 + 3 x_hi", "id % 5 y_lo", "id % 5 + 2 y_hi", "id value"), [D, Dim("y")], ("value",), ("k",))
    for nested in (f._nested(f.df), f._split(f.df), f.decompressed(f).df):
        plan = nested.groupBy("k", *f.bounds).count()._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
    plan = f._nested(f.df).groupBy("k", *f.bounds).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_chains_of_windows_are_staged(spark):
    from spanloom.operators.frame import _short

    df = spark.range(5).selectExpr("id k", "id % 3 v")
    assert _short(df) is df
    for _ in range(10):
        df = df.groupBy("k").agg(F.max("v").alias("v")).selectExpr("k", "v + 1 v")
    assert _short(df).inputFiles()
