"""Binary documents, JSON paths parsed once, convolutions by running sums, variables and approvals as tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, interval
from spanloom.operators.frame import IntervalFrame
from spanloom.operators.versioned import Variable, Variables
from spanloom.sources import bson, codec

D, DAY, T = Dim("x"), Dim("day", "date"), Dim("t", "double", "continuous")


def test_bytes_of_a_document():
    """{"hello": "world"} is the format's own first example; the second has one element of each kind."""
    assert bson.document({"hello": "world"}) == b"\x16\x00\x00\x00\x02hello\x00\x06\x00\x00\x00world\x00\x00"
    doc = {"i": 1, "l": 1 << 40, "d": -0.5, "s": "é\0z", "t": True, "n": None, "a": [1, "x", []], "o": {}, "w": dt.datetime(1969, 12, 31, 23, 59, 59, 500000)}
    raw = bson.document(doc)
    assert raw[:4] == len(raw).to_bytes(4, "little") and b"\x10i\x00\x01\x00\x00\x00" in raw and b"\x12l\x00\x00\x00\x00\x00\x00\x01\x00\x00" in raw
    assert b"\x01d\x00\x00\x00\x00\x00\x00\x00\xe0\xbf" in raw and b"\x09w\x00\x0c\xfe\xff\xff\xff\xff\xff\xff" in raw and b"\x08t\x00\x01\x0an\x00" in raw
    assert bson.parsed(raw) == doc
    with pytest.raises(ValueError):
        bson.parsed(raw[:-1])


def test_frames_as_binary_documents(spark):
    f = IntervalFrame.of(spark, [DAY, T], [([interval(DAY, dt.date(2024, 2, 29), TOP), interval(T, Open(0), 2.5)], 'a"é'), ([interval(DAY, BOTTOM, dt.date(1969, 1, 1)), interval(T, 1, Open(2))], None), ([interval(DAY, BOTTOM, TOP), interval(T, BOTTOM, TOP)], "")])
    back = bson.from_bson(bson.to_bson(f), f)
    assert sorted(map(repr, back.df.collect())) == sorted(map(repr, f.df.collect()))
    many = IntervalFrame(f.df.withColumns({"n": F.lit(7).cast("bigint"), "s": F.array(F.lit("p"))}).withColumn("k", F.lit(1)), f.dims, ("value", "n", "s"), ("k",))
    assert sorted(map(repr, bson.from_bson(bson.to_bson(many), many).df.collect())) == sorted(map(repr, many.df.collect()))
    assert bson.from_bson(bson.to_bson(f._with(f.df.limit(0))), f).is_empty()


def test_paths_parse_a_text_once(spark):
    texts = ['{"shop":{"rows":[{"n":[1,2]},{"n":[3]},{"m":4},null,{"n":7}]}}', "no json", None, "[]", '{"shop":{"rows":{"n":1}}}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    total = lambda path: codec.fold_path(F.col("j"), path, F.lit(0).cast("bigint"), lambda a, x: a + x, "bigint")
    got = df.select(total("shop/rows[*]/n[*]").alias("a"), total("shop/rows[1:]/n[:1]").alias("b"), total("shop/rows[4]/n").alias("c"), total("shop/rows/n").alias("d"))
    assert [tuple(r) for r in got.collect()] == [(6, 3, 7, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)]
    one = df.select(total("shop/rows[*]/n[*]").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("parse") == 1 and "from_json" not in one


@pytest.mark.parametrize("kernel", [[(0, 2, 1)], [(-3, 4, 2), (6, 9, -1)], [(5, 8, 3), (-9, -2, 1)]])
def test_convolution_by_running_sums(spark, kernel):
    r = random.Random(6)
    at = sorted(r.sample(range(60), 14))
    rows = [(k, a, b, r.randint(-3, 5)) for k in (1, 2) for a, b in zip(at[::2], at[1::2], strict=True) if r.random() < 0.8]
    f = IntervalFrame(spark.createDataFrame(rows, "k int, x_lo bigint, x_hi bigint, value bigint"), [D], ["value"], ["k"])
    spans = [(interval(D, a, b), w) for a, b, w in kernel]
    got = {(k, x): v for k, a, b, v in f.convolved_running("x", spans, 1).df.collect() for x in range(a, b)}
    want: dict = {}
    for k, a, b, v in rows:
        for lo, hi, w in kernel:
            for o in range(lo - 1, hi):  # offsets from the centre
                for x in range(a - o, b - o):
                    want[k, x] = want.get((k, x), 0) + v * w
    assert {p: v for p, v in got.items() if v} == {p: v for p, v in want.items() if v}
    if len(kernel) == 1:
        assert set(got) == set(want)
        old = f._with(f.df.withColumn("value", F.col("value").cast("double"))).convolved_in("x", [(s, float(w)) for s, w in spans], 1, 1)
        assert {(k, x): v for k, a, b, v in old.df.collect() for x in range(a, b)} == got


def test_variables_as_a_table(spark):
    r = random.Random(8)
    changes = [(k, i, r.randrange(0, 60), r.choice("ab")) for k in (1, 2) for i in range(k * 3)]
    v = Variables.from_changes(spark.createDataFrame(changes, "k int, i int, now bigint, v string"), ["k"], time=F.col("now"), value=F.col("v"), order=[F.col("i")], initial="-")
    for k in (1, 2):
        one = Variable.of(spark, "-")
        for _, _, now, x in sorted(c for c in changes if c[0] == k):
            one = one.set(x, now=now)
        mine = lambda df, k=k: [tuple(x)[1:] for x in df.filter(F.col("k") == k).collect()]
        assert sorted(mine(v.frame.df)) == sorted(tuple(x) for x in one.history().collect())
        assert mine(v.get()) == [(one.get(),)] and mine(v.unset().get()) == [(one.unset().get(),)] and mine(v.get_at(25)) == [(one.get_at(25),)]
        assert mine(v.last_changes()) == [(one.last_change(), one.get_prior())] and mine(v.reset().get_at(0)) == [(one.get(),)]
