"""Frames without keys, against brute force and by their plans; connected parts; ends of intervals; versions cut by a box; paths."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import cuts as C
from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, Probe, Span, interval, intersects
from spanloom.operators import frame
from spanloom.operators.frame import IntervalFrame, Shape
from spanloom.operators.versioned import UNAPPROVED, Versioned
from spanloom.sources import codec

X, Y = Dim("x"), Dim("y")


def boxes(r, n, dims=(X,)):
    """Boxes of many widths, some unbounded, with their numbers."""
    out = []
    for k in range(n):
        box = []
        for d in dims:
            a = r.randint(0, 200)
            b = a + r.choice([1, 2, 4, 30, 150])
            box.append(Span(d, d.first if r.random() < 0.06 else a, d.last if r.random() < 0.06 else b))
        out.append((box, k))
    return out


@pytest.fixture
def dealt(monkeypatch):
    """Even small tables are dealt by ranges."""
    monkeypatch.setattr(frame, "ONE_TASK", 5)


def made(spark, rows, dims=(X,)):
    return IntervalFrame.of(spark, dims, rows, ("bigint",))


def test_keyless_joins_cells_and_islands(spark, dealt):
    r = random.Random(1)
    a, b = boxes(r, 70), boxes(r, 50)
    f, g = made(spark, a), made(spark, b)
    got = sorted((x.value, x.value_2) for x in f.zip(g).df.collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if intersects(p[0], q[0]))
    cuts = sorted({c for p in a for c in (p[0][0].lo, p[0][0].hi)})
    cells = sorted((x.x_lo, x.x_hi, x.value) for x in f._split(f.df).collect())
    assert cells == sorted((u, v, p[1]) for p in a for u, v in itertools.pairwise(cuts) if p[0][0].lo <= u and v <= p[0][0].hi)
    short = [p for p in a if p[0][0].lo != X.first and p[0][0].hi != X.last and p[0][0].hi - p[0][0].lo < 5]
    want: list = []
    for lo, hi in sorted((p[0][0].lo, p[0][0].hi) for p in short):
        if want and lo <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], hi))
        else:
            want.append((lo, hi))
    region = Shape.of_boxes(spark, [X], [p[0] for p in short])
    assert sorted((x.x_lo, x.x_hi) for x in region.coalesce().df.collect()) == want
    assert region.components().select("component").distinct().count() == len(want)


def test_keyless_cells_of_two_dimensions(spark, dealt):
    rows = boxes(random.Random(2), 16, (X, Y))
    f = made(spark, rows, (X, Y))
    grid = [sorted({c for p in rows for c in (p[0][i].lo, p[0][i].hi)}) for i in (0, 1)]
    want = sorted(
        (p[1], u, v, w, z) for p in rows for u, v in itertools.pairwise(grid[0]) for w, z in itertools.pairwise(grid[1])
        if p[0][0].lo <= u and v <= p[0][0].hi and p[0][1].lo <= w and z <= p[0][1].hi
    )
    assert sorted((x.value, x.x_lo, x.x_hi, x.y_lo, x.y_hi) for x in f._split(f.df).collect()) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyless_plans_have_no_nested_loops(spark, dealt):
    rows = boxes(random.Random(3), 60)
    f = made(spark, rows)
    for df in (f._split(f.df), f.zip(made(spark, rows)).df):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    one = Shape(f.df, [X]).coalesce().df
    assert "NestedLoop" not in plan(one)


def test_long_rows_make_few_copies(spark):
    """A row without an end is at home in one bin and no guest where nobody is."""
    rows = spark.range(5000).select(F.col("id").alias("x_lo"), F.when(F.col("id") == 7, X.column(X.last)).otherwise(F.col("id") + 1).alias("x_hi"))
    bins = frame._bins(X, (rows, "x_lo", "x_hi"))
    left, right, _ = frame._binned(rows, ("x_lo", "x_hi"), rows, ("x_lo", "x_hi"), X, bins)
    assert left.count() <= 8 * 5000 and right.count() <= 8 * 5000


def test_long_chains_are_one_part(spark):
    cells = spark.range(100_000).select(F.col("id").alias("x_lo"), (F.col("id") + 1).alias("x_hi"))
    assert Shape(cells, [X]).components().select("component").distinct().count() == 1
    flat = spark.range(120).select(F.col("id").alias("x_lo"), (F.col("id") + 1).alias("x_hi"), F.lit(0).cast("bigint").alias("y_lo"), F.lit(1).cast("bigint").alias("y_hi"))
    two = flat.union(flat.select("x_lo", "x_hi", F.col("y_lo") + 5, F.col("y_hi") + 5))
    parts = Shape(two, [X, Y]).components()
    assert sorted(x["count"] for x in parts.groupBy("component").count().collect()) == [120, 120]


def test_ends_and_probes():
    s = interval(X, 3, 9)
    assert (C.starting(s, 5), C.starting_after(s, 5), C.from_bottom(s)) == (interval(X, 5, 9), interval(X, 6, 9), interval(X, BOTTOM, 9))
    assert (C.ending(s, 5), C.ending_before(s, 5), C.to_top(s)) == (interval(X, 3, 5), interval(X, 3, 4), interval(X, 3, TOP))
    assert C.at_start(s) == interval(X, 3, 3) and C.at_end(s) == interval(X, 9, 9) and C.is_bounded([s]) and not C.is_unbounded([s]) and C.is_unbounded([C.unbounded(X)])
    z = Dim("z", "double", "continuous")
    assert C.at_start(interval(z, 1, 2)) == interval(z, 1, 1) and C.at_end(interval(z, 1, 2)) == interval(z, 2, 2) and C.close_if_open(Open(4)) == 4 and not C.is_closed_or_unbounded(Open(4))
    assert C.after_start(interval(X, 4, 9), s) and C.before_or_at_end(s, s) and not C.before_end(s, s)
    (p,) = C.containing_center([Probe(interval(X, -4, Open(2)), 3)])
    assert C.contains_point([p.span], (3,))


def test_a_box_cuts_an_unapproved_removal(spark):
    n = Dim("n")
    v = Versioned.from_frame(IntervalFrame.of(spark, [n], [(interval(n, 0, 20), "x")]), now=0).remove(interval(n, 5, 15), selection=UNAPPROVED)
    out = v.approve_all(interval(n, 5, 7))
    assert sorted((r.n_lo, r.n_hi) for r in out.selected().df.collect()) == [(0, 5), (8, 21)]
    assert sorted((r.n_lo, r.n_hi) for r in out.selected(UNAPPROVED).df.collect()) == [(0, 5), (16, 21)]


def test_paths_with_all_elements_and_slices():
    assert codec.path_text(codec.parse_path("shop/rows[2:]/prices[:3]/7/tags[*]")) == "shop/rows/[2:]/prices/[0:3]/[7]/tags/[*]"
    step = lambda t: codec.Step.parse(t)[0]
    assert step("[1:4]").matches(step("[3:9]")) and not step("[1:4]").matches(step("[4:9]")) and step("[*]").matches(step("[7]")) and not step("[1]").matches(step("a"))
    assert codec.compare(codec.parse_path("shop/rows"), codec.parse_path("shop/rows/[1]")) == "match"


def test_json_lines(spark, tmp_path):
    d = Dim("day", "date")
    f = IntervalFrame.of(spark, [d], [(interval(d, dt.date(2024, 1, 1), TOP), "a"), (interval(d, BOTTOM, dt.date(2023, 1, 1)), "b")])
    codec.write_lines(f, f"file://{tmp_path}/lines")
    assert codec.read_lines(spark, f"file://{tmp_path}/lines", [d]).is_equivalent_to(f)
