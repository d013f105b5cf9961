"""Signed changes, billing cycles, writes of sets, rules that compare attributes with one another."""

import datetime as dt
import random

from pyspark.sql import functions as F

from spanloom.functions import rules as R
from spanloom.functions.cuts import BOTTOM, TOP, Dim, Open, interval
from spanloom.operators.cycles import Cycle, as_known, transactions
from spanloom.operators.frame import IntervalFrame, Multi

X, Y, DAY = Dim("x"), Dim("y"), Dim("day", "date")


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "k int, a long, b long, value string")
    return IntervalFrame.from_df(df, {X: (F.col("a"), Open(F.col("b")))}, keys=["k"])


def test_signed_changes_balance(spark):
    dice = random.Random(4)

    def rows():
        out = []
        for k in range(12):
            at = 0
            for _ in range(dice.randrange(5)):
                at += dice.randrange(3)
                out.append((k, at, at := at + 1 + dice.randrange(4), dice.choice("pq")))
        return out

    def days(rows):
        return {(k, x, v) for k, a, b, v in rows for x in range(a, b)}

    old, new = rows(), rows()
    got = [tuple(r) for r in _frame(spark, new).signed_changes_from(_frame(spark, old)).select("k", "x_lo", "x_hi", "value", "sign").collect()]
    net: dict = {}
    for k, a, b, v, n in got:
        assert a < b
        for x in range(a, b):
            net[k, x, v] = net.get((k, x, v), 0) + n
    assert {c: n for c, n in net.items() if n} == {c: 1 for c in days(new) - days(old)} | {c: -1 for c in days(old) - days(new)}
    assert _frame(spark, old).signed_changes_from(_frame(spark, old)).count() == 0


def test_signed_changes_by_start(spark):
    old = [(1, 0, 5, "p"), (2, 0, 5, "p"), (3, 0, 5, "p"), (4, 0, 5, "p"), (5, 0, 5, "p")]
    new = [(1, 0, 8, "p"), (2, 0, 3, "p"), (3, 0, 5, "q"), (5, 0, 5, "p"), (6, 1, 2, None)]
    got = {tuple(r) for r in _frame(spark, new).signed_changes_from(_frame(spark, old)).select("k", "x_lo", "x_hi", "value", "sign").collect()}
    assert got == {(1, 5, 8, "p", 1), (2, 3, 5, "p", -1), (3, 0, 5, "p", -1), (3, 0, 5, "q", 1), (4, 0, 5, "p", -1), (6, 1, 2, None, 1)}
    flat = IntervalFrame.of(spark, [X, Y], [([interval(X, 0, 4), interval(Y, 0, TOP)], "p")])
    wide = IntervalFrame.of(spark, [X, Y], [([interval(X, 0, 9), interval(Y, 0, TOP)], "p")])
    assert {(r["x_hi"], r["sign"]) for r in wide.signed_changes_from(flat).collect()} == {(5, -1), (10, 1)}  # several dimensions: both rows


def test_cycles_telescope(spark):
    """What all cycles bill equals what the last knows less what the first knew, day by day."""
    dice, zero = random.Random(5), dt.date(2024, 1, 1)
    day = lambda n: zero + dt.timedelta(n)
    cycles = [Cycle(n * 3, day(30 * n + 15), day(30 * n + 45)) for n in range(4)]  # numbers needn't be consecutive
    writes = [(k, day(dice.randrange(160)), dice.choice("pq"), day(dice.randrange(160)), n) for n, k in enumerate(dice.choices(range(6), k=40))]
    writes += [(1, day(3), "p", None, 98), (2, None, "p", day(1), 99)]  # never known; never valid
    df = spark.createDataFrame(writes, "k int, s date, v string, known date, n int")
    known = as_known(df, DAY, F.col("s"), F.col("v"), F.col("known"), ["k"], [F.col("n")], cycles)
    rates = IntervalFrame(
        IntervalFrame.of(spark, [DAY], [(interval(DAY, BOTTOM, day(49)), "p", 3), (interval(DAY, day(50), TOP), "p", 5), (interval(DAY, BOTTOM, day(99)), "q", 7)], ("string", "int"), ("tier", "rate")).df, [DAY], ("rate",), ("tier",)
    )
    rows = transactions(known, cycles, rates).collect()

    def knows(c, k):
        told = sorted((s, n, v) for kk, s, v, at, n in writes if kk == k and s and at and at <= c.run and s < c.upto)
        out = {}
        for s, _, v in told:
            for n in range((s - zero).days, (c.upto - zero).days):
                out[n] = v
        return out

    def worth(line):
        return sum((3 if n < 50 else 5) if v == "p" else 7 if n < 100 else 0 for n, v in line.items())

    for k in range(6):
        for a, b in zip(cycles, cycles[1:], strict=False):
            assert sum(r["amount"] for r in rows if r["k"] == k and r["cycle"] == b.number) == worth(knows(b, k)) - worth(knows(a, k))
    assert {r["cycle"] for r in rows} <= {c.number for c in cycles[1:]}
    assert any(r["amount"] < 0 for r in rows) and all(r["day_lo"] < r["day_hi"] for r in rows)
    assert transactions(known._with(known.df.limit(0)), cycles, rates).count() == 0


def test_sets_written_in_order(spark):
    dice = random.Random(6)
    writes = []
    for n in range(60):
        x, y = dice.randrange(6), dice.randrange(6)
        writes.append((dice.randrange(3), x, x + 1 + dice.randrange(4), y, y + 1 + dice.randrange(4), dice.choice("abc"), dice.choice([True, True, False, None]), n))
    df = spark.createDataFrame(writes, "k int, a long, b long, p long, q long, value string, put boolean, n int")
    f = IntervalFrame.from_df(df, {X: (F.col("a"), Open(F.col("b"))), Y: (F.col("p"), Open(F.col("q")))}, ("value", "put", "n"), ["k"])
    made = Multi.from_writes(IntervalFrame(f.df, f.dims, ("value",), f.keys).carrying(f.df), F.col("put"), F.col("n"))
    want: dict = {}
    for k, a, b, p, q, v, put, _ in writes:
        for x in range(a, b):
            for y in range(p, q):
                (set.add if put else set.discard)(want.setdefault((k, x, y), set()), v)
    got = {(r["k"], x, y): set(r["value"]) for r in made.df.collect() for x in range(r["x_lo"], r["x_hi"]) for y in range(r["y_lo"], r["y_hi"])}
    assert got == {c: s for c, s in want.items() if s}
    assert made.is_disjoint() and not made.is_compressible()


def test_rules_compare_attributes(spark):
    people = [("a", dt.date(2000, 2, 29), dt.date(2018, 2, 28)), ("b", dt.date(2000, 3, 2), dt.date(2018, 3, 1)), ("c", None, dt.date(2018, 1, 1)), ("d", dt.date(2000, 1, 1), None)]
    facts = R.facts_from(spark.createDataFrame(people, "id string, born date, day date"), "id", born="date", day="date")
    minor = R.greater("born", R.Own("day", "date", lambda d: F.add_months(d, -12 * 18)))
    assert {r["id"]: r["m"] for r in facts.select("id", minor().alias("m")).collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert {(r["id"], r["name"], r["value"]) for r in R.progress(facts, "day").collect()} == {("a", "born", "2000-02-29"), ("b", "born", "2000-03-02")}


def test_long_chains_of_filters_stay_small(spark):
    """Each step names the attributes once: a plan grows with the steps, not with their power."""
    facts = R.facts_from(spark.range(5).withColumn("x", F.col("id").cast("double")), "id", x="double")

    def plan(n):
        out = R.chain(*[R.augment(R.greater("x", float(k)), R.attributes(**{f"over{k}": True}), "when_absent") for k in range(n)])(facts).filter(F.size("attributes") > 0)
        return out, len(out._jdf.queryExecution().optimizedPlan().toString())

    (_, few), (out, many) = plan(6), plan(24)
    assert many < 6 * few
    assert sorted((r["id"], len(r["attributes"])) for r in out.collect()) == [(str(k), 1 + k) for k in range(5)]
