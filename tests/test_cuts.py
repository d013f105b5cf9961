"""Interval algebra against a brute-force model: sets of points on a small line, halves standing for open gaps."""

import itertools

import pytest

from spanloom.functions.cuts import (
    BOTTOM, TOP, Dim, Open, Probe, adjacent, after, before, between, contains, dilated, displaced, eroded, excluding, gap, hull, interval, interval_at,
    intersection, intersects, left_adjacent, measure, padded, points, reflected, relation, scaled, separate, shares_boundary, steps, touches, unbounded,
)

D, K = Dim("x"), Dim("y", "double", "continuous")


def spans(d):
    bounds = [BOTTOM, *range(4)] + ([Open(k) for k in range(4)] if not d.discrete else [])
    ends = [TOP, *bounds[1:]]
    for a, b in itertools.product(bounds, ends):
        try:
            yield interval(d, a, b)
        except ValueError:
            pass


def cells(d, s):
    """Points and open gaps between them, far ends included, that a span covers."""
    out = set()
    for k in range(-2, 7):
        if d.discrete:
            if s.lo <= k < s.hi:
                out.add(k)
        else:
            if s.lo <= (k, 0) and (k, 1) <= s.hi:
                out.add(k)
            if s.lo <= (k, 1) and (k + 1, 0) <= s.hi:
                out.add(k + 0.5)
    return out


@pytest.mark.parametrize("d", [D, K], ids=["discrete", "continuous"])
def test_relations_match_point_sets(d):
    all_ = list(spans(d))
    for a, b in itertools.product(all_, all_):
        x, y = cells(d, a), cells(d, b)
        assert intersects([a], [b]) == bool(x & y)
        assert contains([a], [b]) == (y <= x)
        got = intersection([a], [b])
        assert (cells(d, got[0]) if got else set()) == x & y
        assert cells(d, hull([a], [b])[0]) >= x | y
        assert set().union(*(cells(d, s) for s in excluding([a], [b])[0])) == x - y
        pieces = [cells(d, p[0]) for p in separate([a], [b])]
        assert set().union(*pieces) == x and all(p <= y or not p & y for p in pieces)
        assert not (adjacent([a], [b]) and intersects([a], [b]))
        if adjacent([a], [b]) or intersects([a], [b]):
            assert gap([a], [b]) is None
        r = relation([a], [b])
        assert (r == "EQ") == (x == y) and (r in ("TPP", "NTPP")) == (x < y) and (r == "DC") == (not x & y and not touches([a], [b]))


def test_constructors_and_edges():
    assert repr(interval(D, Open(3), Open(6))) == "[4..5]" and repr(interval_at(D, 3)) == "[3..3]"
    assert repr(unbounded(K)) == "(-∞..+∞)" and after(unbounded(D)) is None and before(unbounded(D)) is None
    assert repr(between(interval(D, 0, 2), interval(D, 5, 6))) == "[3..4]" and between(interval(D, 0, 4), interval(D, 5, 6)) is None
    for bad in ((TOP, TOP), (5, 4)):
        with pytest.raises(ValueError):
            interval(D, *bad)
    assert D.covers(*(lambda s: (s.lo, s.hi))(unbounded(D)), TOP) and not K.covers((0, 0), (5, 1), Open(3))
    assert points([interval(D, 0, 1), interval(Dim("z"), 5, 6)]) == [(0, 5), (0, 6), (1, 5), (1, 6)] and points([unbounded(D)]) == []
    assert measure([interval(D, 0, 3), interval(Dim("z"), 0, 1)]) == 8 and measure([unbounded(D)]) is None
    assert left_adjacent([interval(D, 0, 1)], [interval(D, 2, 5)]) and shares_boundary([interval(K, 0, 2)], [interval(K, 2, 5)])


def test_affine_and_morphology():
    a, p = interval(K, -5, Open(5)), Probe(interval(K, -4, Open(5)), 3)
    assert repr(dilated(a, p)) == "[-12.0..7.0)" and repr(eroded(a, p)) == "[2.0..3.0)" and repr(eroded(a, p.reflected())) == "[-3.0..-2.0)"
    for s in spans(K):
        assert reflected(reflected(s, 2), 2) == s and displaced(displaced(s, 3), -3) == s and scaled(scaled(s, 1, 4), 1, 0.25) == s
        assert padded(s, 1).valid
    assert steps(0, 5, 2) == [(0, 2), (2, 2), (4, 1)]
    with pytest.raises(ValueError):
        steps(0, 5, 0)
