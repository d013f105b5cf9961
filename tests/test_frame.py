"""Interval frames: golden rows, and laws over random frames compared cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, Probe, Span, interval, unbounded
from spanloom.operators.frame import IntervalFrame, Monoid, Multi, Shape, sweep_sum

D, Y, K = Dim("x"), Dim("y"), Dim("t", "double", "continuous")


def show(f):
    cut = lambda r, c, d: r[c] if d.discrete else tuple(r[c])
    return sorted((*(repr(Span(d, cut(r, d.lo, d), cut(r, d.hi, d))) for d in f.dims), *(r[v] for v in f.values)) for r in f.df.collect())


def iv(a, b, d=D):
    return interval(d, a, b)


@pytest.fixture(scope="module")
def two(spark):
    a = IntervalFrame.of(spark, [D], [(iv(0, 9), "Hello"), (iv(12, 20), "World")])
    return a, IntervalFrame.of(spark, [D], [(iv(-4, -2), "Goodbye"), (iv(6, 14), "Cruel"), (iv(16, 24), "World")])


def test_lookups(spark):
    f = IntervalFrame.of(spark, [D], [(iv(0, 10), "Hello"), (iv(Open(10), TOP), "World")])
    assert [f.get_at(p).first() and f.get_at(p).first()[0] for p in (5, 15, -1, TOP)] == ["Hello", "World", None, "World"]
    assert show(f.domain()) == [("[0..+∞)",)] and show(f.domain().complement()) == [("(-∞..-1]",)]
    assert f.get_intersecting(iv(5, 15)).size() == 2 and f.get_option() is None and IntervalFrame.of_value(spark, [D], "v").get() == "v"
    assert Shape.of_boxes(spark, [D], []).complement().is_universe()


def test_joins(two):
    a, b = two
    assert show(a.zip(b)) == [("[12..14]", "World", "Cruel"), ("[16..20]", "World", "World"), ("[6..9]", "Hello", "Cruel")]
    assert a.zip_all(b, {"value": "<"}, {"value": ">"}).size() == 8
    both = a.overlay(b, lambda p, x, q, y: F.when(p & q, F.concat(x, y)).when(p, x).when(q, y).otherwise(F.lit("--")), both_missing=True)
    assert both.size() == 11 and both.domain().is_universe()
    assert show(a.difference(b)) == [("[0..5]", "Hello"), ("[15..15]", "World")]


def test_writes(spark):
    g = IntervalFrame.of(spark, [D], [(iv(-7, 7), "World")])
    assert show(g.remove(iv(0, 3))) == [("[-7..-1]", "World"), ("[4..7]", "World")]
    assert show(g.remove(iv(8, 9))) == [("[-7..7]", "World")] and show(g.remove(iv(BOTTOM, 0))) == [("[1..7]", "World")]
    assert show(g.update(iv(0, 20), "x")) == [("[-7..-1]", "World"), ("[0..7]", "x")]
    assert show(g.fill(iv(-9, 9), "z")) == [("[-7..7]", "World"), ("[-9..-8]", "z"), ("[8..9]", "z")]
    assert g.set_if_no_conflict(iv(0, 1), "q") is None and g.set_if_no_conflict(iv(8, 9), "World").size() == 1
    new = g.set(iv(0, 3), "q")
    acts = new.diff_actions_from(g)
    assert sorted(r[0] for r in acts.collect()) == ["Create", "Create", "Update"] and g.apply_diff_actions(acts).is_equivalent_to(new)
    with pytest.raises(KeyError):
        g.remove_by_key(5)


def test_removal_topologies_2d(spark):
    q = lambda a, b, c, e: [iv(a, b), iv(c, e, Y)]
    f = IntervalFrame.of(spark, [D, Y], [(q(-14, 14, 4, 7), "World")])
    for box in (q(-14, 0, 4, 7), q(-5, 5, 4, 7), q(-20, 0, 0, 5), q(-5, 5, 6, 9), q(-5, 5, 5, 6), q(20, 30, 0, 9)):
        out = f.remove(box)
        rows = {(x, y) for r in out.df.collect() for x in range(r.x_lo, r.x_hi) for y in range(r.y_lo, r.y_hi)}
        hole = {(x, y) for x in range(box[0].lo, box[0].hi) for y in range(box[1].lo, box[1].hi)}
        assert rows == {(x, y) for x in range(-14, 15) for y in range(4, 8)} - hole and out.is_disjoint()


def test_multi_and_monoid(spark):
    rows = IntervalFrame.of(spark, [D], [(iv(0, 20), "A"), (iv(5, 25), "B"), (iv(10, 30), "C")])
    m = Multi.from_single(rows)
    assert show(m) == [("[0..4]", ["A"]), ("[10..20]", ["A", "B", "C"]), ("[21..25]", ["B", "C"]), ("[26..30]", ["C"]), ("[5..9]", ["A", "B"])]
    assert show(m.remove_one(iv(0, 12), "A"))[0] == ("[10..12]", ["B", "C"]) and m.intersection(m).is_equivalent_to(m)
    q = lambda a, b, c, e: [iv(a, b), iv(c, e, Y)]
    f = IntervalFrame.of(spark, [D, Y], [(q(BOTTOM, -1, 0, TOP), 2), (q(BOTTOM, -1, BOTTOM, -1), 3), (q(0, TOP, BOTTOM, -1), 4)], ("int",))
    mo = Monoid(f.df, f.dims)
    assert show(mo.complement()) == [("[0..+∞)", "[0..+∞)", 0)] and show(mo.flatten("y")) == [("(-∞..-1]", 5), ("[0..+∞)", 4)]


def test_convolution(spark):
    s = IntervalFrame.of(spark, [K], [(iv(0, Open(4), K), 1.0)], ("double",))
    assert show(s.convolved_in("t", [(iv(0, Open(2), K), 0.5)], 1, 1)) == [("[0.0..1.0)", 0.5), ("[1.0..4.0)", 1.0), ("[4.0..5.0)", 0.5)]


def test_topology(spark):
    q = lambda a, b, c, e: [iv(a, b), iv(c, e, Y)]
    ring = Shape.of_boxes(spark, [D, Y], [q(0, 9, 0, 2), q(0, 9, 7, 9), q(0, 2, 3, 6), q(7, 9, 3, 6)])
    assert ring.is_contiguous() and not ring.is_solid() and [tuple(r)[:4] for r in ring.cavities().collect()] == [(3, 7, 3, 7)]
    other = lambda *b: Shape.of_boxes(spark, [D, Y], [q(*b)])
    assert [ring.relation_with(x) for x in (other(0, 9, 0, 9), ring, other(3, 6, 3, 6), other(-1, 10, -1, 10))] == ["TPP", "EQ", "EC", "NTPP"]
    assert not Shape.of_boxes(spark, [D], [iv(0, 1), iv(5, 6)]).is_contiguous()


def _random(spark, seed, n=6):
    r = random.Random(seed)
    at = sorted(r.sample(range(-30, 30), 2 * n))
    return [(a, b, r.choice("pq")) for a, b in zip(at[::2], at[1::2], strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_laws_cell_by_cell(spark, seed):
    ra, rb = _random(spark, seed), _random(spark, seed + 10)
    a, b = (IntervalFrame.of(spark, [D], [(iv(x, y - 1), v) for x, y, v in rows]) for rows in (ra, rb))
    at = lambda rows, k: next((v for x, y, v in rows if x <= k < y), None)
    line = range(-35, 35)

    def cells(f):
        return {k: r.asDict().get("value", True) for r in f.df.collect() for k in line if r.x_lo <= k < r.x_hi}

    A, B = {k: at(ra, k) for k in line if at(ra, k)}, {k: at(rb, k) for k in line if at(rb, k)}
    assert cells(a.merge(b)) == B | A and cells(a.difference(b)) == {k: v for k, v in A.items() if k not in B}
    assert cells(a.symmetric_difference(b)) == {k: v for k, v in (A | B).items() if (k in A) != (k in B)}
    assert cells(a.set_many(b)) == A | B
    sa, sb = a.domain(), b.domain()
    assert set(cells(sa.union(sb))) == set(A) | set(B) and set(cells(sa.intersection(sb))) == set(A) & set(B)
    assert sa.complement().complement().is_equivalent_to(sa) and sa.union(sb).complement().is_equivalent_to(sa.complement().intersection(sb.complement()))
    p = Probe(iv(-1, 2), 0)
    assert sa.opening(p).opening(p).is_equivalent_to(sa.opening(p)) and sa.is_subset_of(sa.closing(p)) and sa.opening(p).is_subset_of(sa)
    n = IntervalFrame.of(spark, [D], [(iv(x, y + 3), 1) for x, y, _ in ra + rb], ("bigint",))
    summed = cells(sweep_sum(n))
    assert summed == {k: c for k in line if (c := sum(x <= k <= y + 3 for x, y, _ in ra + rb))} and cells(n._with(n.df.limit(0)).merge_many(n, {"value": F.sum})) == summed


def test_hot_parts_give_the_same(spark):
    rows = IntervalFrame.of(spark, [D], [(iv(0, 50), 1), (iv(10, 90), 2), (iv(40, 45), 5)], ("bigint",))
    cut = IntervalFrame(rows.df, rows.dims, rows.values, hot=(20, 44, 70))
    f = lambda x: x._with(x.df.limit(0)).merge_many(x, {"value": F.sum})
    assert show(f(cut)) == show(f(rows))


def test_dimensions(two):
    a, _ = two
    wide = a.extrude(1, interval(Y, 0, 5))
    assert show(wide.slice_at("y", 3)) == show(a) and wide.flatten("y").is_equivalent_to(a.domain()) and [d.name for d in wide.swap(0, 1).dims] == ["y", "x"]
    assert show(a.displaced(3)) == [("[15..23]", "World"), ("[3..12]", "Hello")] and a.map_reduce_measure().first()[0] == 19
    assert IntervalFrame.of(a.spark, [D], [([unbounded(D)], "v")]).scaled((0,), (0.5,)).get() == "v"
