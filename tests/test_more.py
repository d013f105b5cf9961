"""Versions, variables, functions, codecs, rules, and the catalogue against SQL."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions import rules as R
from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, interval, unbounded
from spanloom.operators.frame import IntervalFrame
from spanloom.operators.piecewise import FunctionFrame
from spanloom.operators.versioned import UNAPPROVED, Variable, Versioned
from spanloom.plans.catalogue import QUERIES, SQL
from spanloom.sources import codec

from .conftest import DATA

D = Dim("day", "date")


def day(k):
    return dt.date(2024, 7, 15) + dt.timedelta(k)


def test_versions_and_approvals(spark):
    v = Versioned.from_frame(IntervalFrame.of(spark, [D], [(unbounded(D), "Testing")]), now=0)
    v = v.increment(now=1).set(interval(D, day(1), day(15)), "Hello").increment(now=2).set(interval(D, day(10), TOP), "World")
    v = v.set(interval(D, day(-30), day(0)), "Zoinks!", selection=UNAPPROVED)
    at = lambda x, k, s="current": x.get_at(day(k), selection=s).first()[0]
    assert (at(v, 0), at(v, 0, UNAPPROVED), at(v, 12), at(v, 12, 1)) == ("Testing", "Zoinks!", "World", "Hello")
    assert at(v.approve(interval(D, day(-30), day(0)), "Zoinks!"), 0) == "Zoinks!" and v.approve(interval(D, day(-30), day(1)), "Zoinks!") is None
    assert at(v.approve_all(unbounded(D)), 0) == "Zoinks!" and at(v.reset_to(1), 12) == "Hello"
    assert not v.remove(interval(D, day(10), TOP), selection=UNAPPROVED).approve_all(unbounded(D)).is_valid_at(day(12))
    back = codec.versioned_from_json(spark, codec.versioned_json(v).first()[0], [D])
    assert back.frame.is_equivalent_to(v.frame) and (back.current, len(back.log)) == (2, 3)


def test_variable(spark):
    v = Variable.of(spark, "a").set("b", now=100).set("c", now=100)
    assert (v.get(), v.get_prior(), v.get_at(50), v.unset().get(), v.last_change(), v.reset().history().count()) == ("c", "b", "a", "b", 110, 1)


def test_functions(spark):
    x, y = Dim("x", "double", "continuous"), Dim("y", "double", "continuous")
    f = FunctionFrame.of(spark, [x, y], [
        ([interval(x, 0, TOP), interval(y, 0, TOP)], lambda a, b: F.exp(-(a * a + b * b))), ([interval(x, BOTTOM, Open(0)), interval(y, 0, TOP)], lambda a, b: F.lit(1.0)),
        ([unbounded(x), interval(y, BOTTOM, Open(0))], lambda a, b: F.greatest(F.lit(0.0), 1 - (a * a + b * b))),
    ])
    got = [f.at(*p) for p in ((0.0, 0.0), (1.0, 1.0), (-1.5, 2.0), (0.5, -0.5))] + [f.slice_at("x", 1.0).at(1.0)]
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, (1, math.exp(-2), 1, 0.5, math.exp(-2)), strict=True))


def test_json(spark):
    x = Dim("x", "double", "continuous")
    f = IntervalFrame.of(spark, [D, x], [([interval(D, day(0), TOP), interval(x, Open(0), 2.5)], 'He"llo'), ([interval(D, BOTTOM, day(-1)), interval(x, 1, Open(2))], "x")])
    assert codec.from_json(codec.to_json(f), [D, x]).is_equivalent_to(f) and codec.from_whole_json(codec.whole_json(f), [D, x]).is_equivalent_to(f)
    one = spark.createDataFrame([('{"a":{"b":[1,2,3,4]}}',)], "j string").select(codec.fold_path(F.col("j"), "a/b[1:3]", F.lit(0).cast("bigint"), lambda s, e: s + e, "bigint"))
    assert one.first()[0] == 5
    path = codec.parse_path("a/b[1:3]/c~1d")
    assert [codec.compare(path, p) for p in (["a"], ["a", "b", 1, "c/d"], ["a", "b", 3])] == ["prefix", "match", "otherwise"]
    assert "day" in codec.code(f) and "->" in codec.chart(f)


def test_rules(spark):
    rows = spark.createDataFrame([("1", 5, "abc", None), ("2", 9, "xyz", True)], "id string, n bigint, s string, b boolean")
    g = R.facts_from(rows, "id", n="int", s="string", b="bool")
    assert R.select(R.greater("n", 6) | R.contains("s", "bc") & ~R.equals("b", True))(g).count() == 2
    out = R.chain(R.augment(R.less("n", 6), R.attributes(s="new"), "as_replacement"), R.redact(R.equals("b", True), ["n"]))(g)
    assert sorted(map(tuple, R.facts_to(out, n="int", s="string", b="bool").collect())) == [("1", 5, "new", None), ("2", None, "xyz", True)]
    with pytest.raises(TypeError):
        R.greater("b", True)


def _rows(df):
    def text(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6g}"
        return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)

    names = sorted(df.columns)
    return names, sorted("|".join(map(text, r)) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "part", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    (na, ra), (nb, rb) = _rows(a), _rows(b)
    assert na == nb and ra == rb
