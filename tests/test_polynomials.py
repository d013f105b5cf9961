"""Functions as data against their values, point by point."""

import random

from pyspark.sql import functions as F

from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, interval
from spanloom.operators.frame import IntervalFrame
from spanloom.operators.polynomials import PolynomialFrame, applied, derived, integrated, normal, plus, polynomial, scaled, term, times, value

X, Y = Dim("x", "double", "continuous"), Dim("y", "double", "continuous")


def test_arithmetic_of_pieces(spark):
    r = random.Random(1)
    made = lambda: [((r.randrange(3), r.randrange(3)), float(r.randint(-3, 3))) for _ in range(4)]
    of = lambda terms, x, y: sum(c * x**p * y**q for (p, q), c in terms)
    a, b = made(), made()
    f, g = (polynomial(*[term(F.lit(c), *p) for p, c in z]) for z in (a, b))
    x, y = 1.5, -2.0
    at = lambda e, *c: value(e, *[F.lit(v) for v in c])
    out = spark.range(1).select(
        at(f, x, y), at(plus(f, g), x, y), at(times(f, g), x, y), at(scaled(f, 2.0), x, y), at(applied(f, 1, F.lit(y)), x), at(integrated(f, 0, F.lit(1.0), F.lit(3.0)), y),
        at(derived(f, 0), x, y), F.size(plus(f, scaled(f, -1.0))), normal(F.reverse(f)).eqNullSafe(f),
    ).first()
    u, v = of(a, x, y), of(b, x, y)
    want = [u, u + v, u * v, 2 * u, u, sum(c * (3 ** (p + 1) - 1) / (p + 1) * y**q for (p, q), c in a), sum(c * p * x ** (p - 1) * y**q for (p, q), c in a if p), 0, True]
    assert all(abs(s - t) < 1e-9 for s, t in zip(out, want, strict=True))


def test_frames_of_functions(spark):
    rows = [(0.0, 4.0, 0.0, 2.0, 1.0), (2.0, 6.0, 5.0, 6.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, p double, q double, c double").withColumn("value", polynomial(term(F.col("c"), 1, 0), term(F.lit(2.0), 0, 1)))
    f = PolynomialFrame(IntervalFrame.from_df(df, {X: (F.col("a"), Open(F.col("b"))), Y: (F.col("p"), Open(F.col("q")))}))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 5.5), (3, 5.0, 1.0)], "id int, x double, y double")
    assert sorted(tuple(r) for r in f.at(points, "x", "y").select("id", "result").collect()) == [(1, 3.0), (2, 20.0)]
    flat = f.collapse("y")
    got = dict(flat.at(points, "x").select("id", "result").collect())
    assert got == {1: 1.0 * 2 + 4, 2: 3.0 * 2 + 4 + 3 * 3.0 + 11, 3: 15.0 + 11}
    assert flat.frame.size() == 3
    held = f.slice_at("y", 1.0)
    assert held.frame.size() == 1 and dict(held.at(points, "x").select("id", "result").collect()) == {1: 3.0, 2: 5.0}
    back = PolynomialFrame.from_json(f.to_json(), f)
    assert back.diff_actions_from(f).isEmpty() and back.frame.is_equivalent_to(f.frame)
    twice = f.plus(f)
    assert dict(twice.at(points, "x", "y").select("id", "result").collect()) == {1: 6.0, 2: 40.0} and not twice.diff_actions_from(f).isEmpty()
    assert f.minus(f).to_values().df.select("value").distinct().collect() == [(0.0,)]
    assert dict(f.times(f).at(points, "x", "y").select("id", "result").collect()) == {1: 9.0, 2: 400.0}
    assert f.apply_diff_actions(twice.diff_actions_from(f)).frame.is_equivalent_to(twice.frame)


def test_values_as_functions_and_back(spark):
    v = IntervalFrame.of(spark, [X], [(interval(X, BOTTOM, 1), 2.0), (interval(X, Open(1), TOP), None), (interval(X, 5, 6), 0.0)], ("double",))
    f = PolynomialFrame.from_values(v)
    assert sorted(r["value"] for r in f.to_values().df.collect()) == [0.0, 2.0]
    assert f.derivative("x").to_values().df.select("value").distinct().collect() == [(0.0,)]
    wide = PolynomialFrame(f.frame.extrude(1, interval(Y, 0, Open(3)))).mapped(lambda x: F.transform(x, lambda t: F.struct(F.concat(t["p"], F.array(F.lit(0))).alias("p"), t["c"].alias("c"))))
    assert wide.collapse("y").to_values().df.agg(F.max("value")).first()[0] == 6.0
