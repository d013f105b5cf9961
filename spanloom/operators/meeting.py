"""Where rows of keyed tables meet when keys differ in size by orders of magnitude.

Small keys need nothing: their rows meet by key. A key with more than `most` rows (a hot key) has a scale of its own: up to
128 quantiles of its cuts, between which a cut's place is interpolated, so that a place counts the cuts of the key before
it. On this scale rows lie evenly however they lie in the dimension itself. It serves two ends:

* joins: a row is at home in bins of a 64th of its own width and a guest in the wider bins where rows of the other table
  are at home; each pair meets in its first common bin. A row makes 65 copies at home at most (of disjoint rows the average
  is two, as together they are as wide as the scale) and two on each wider level, and levels grow with the logarithm of
  the key's rows. An unbounded row ends where the scale does;
* windows: a key is dealt into ranges of equal numbers of cuts, and one row a range carries over what went before.

Whether there are hot keys costs a job of counts. It is spent only on tables that Spark's optimizer estimates at more than
`CHECK_BYTES`, or always where a frame says `skewed=True`, never with `skewed=False`.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import Dim

#: Rows of a key that one task compares with one another at most, on the average of a bin.
HOT_ROWS = 4096
#: Estimated bytes of input from which keys are counted.
CHECK_BYTES = 16 << 20
_QUANTILES = 128


class Calm:
    """What a count of keys says that found none with more than a sixteenth of `HOT_ROWS` rows."""


CALM = Calm()
#: Bytes of input (as estimated) for a task of plans that keep a key's rows in one place.
TASK_BYTES = 4 << 20


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def number(d: Dim, c: Column) -> Column:
    """A cut as a number, null if unbounded."""
    import datetime as dt

    origin = dt.date(1970, 1, 1) if d.type == "date" else dt.datetime(1970, 1, 1) if d.type.startswith("timestamp") else 0
    bounded = F.when(d.is_first(c) | d.is_last(c), F.lit(None)).otherwise(c)
    return d.minus(bounded, d.column(d.start(origin))).cast("double")


def estimate(*tables: DataFrame) -> int:
    """Bytes that the optimizer expects of what the tables are read from, each source once; sources of unknown size count nothing."""
    sizes = set()
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes |= {int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())}
    return sum(s for s in sizes if s < 1 << 60)


def hot_keys(keys: Iterable[str], d: Dim, tables: list[tuple[DataFrame, str, str]], *, most: int | None = None, skewed: bool | None = None) -> DataFrame | None:
    """(keys as `_h_*`, `_q` quantiles of their bounded cuts, `_n` cuts) of the keys with over `most` rows in all tables together, as a table in the shared folder; None if there are none."""
    found = counted(keys, d, tables, most=most, skewed=skewed)
    return None if found is CALM else found


def counted(keys: Iterable[str], d: Dim, tables: list[tuple[DataFrame, str, str]], *, most: int | None = None, skewed: bool | None = None) -> DataFrame | Calm | None:
    """hot_keys, or CALM if a count found all keys so small that frames made of them need no count of their own."""
    from ..sources.staging import stage

    keys, most = list(keys), most or HOT_ROWS
    if not keys or skewed is False or (skewed is None and estimate(*[t for t, *_ in tables]) < CHECK_BYTES):
        return None
    named = [_col(k).alias(f"_h_{k}") for k in keys]
    hs = [f"_h_{k}" for k in keys]
    # dealt by key in as many tasks as the input asks for: where keys have few rows, a task's table of counts is as long as its input
    all_rows = together(reduce(DataFrame.union, [t.select(*named) for t, *_ in tables]), hs)
    sizes = stage(all_rows.groupBy(*hs).agg((2 * F.count("*")).alias("_n")).filter(16 * F.col("_n") > 2 * most), "sizes")
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= 2 * most:
        return None if largest else CALM
    counts = sizes.filter(F.col("_n") > 2 * most)
    rows = reduce(DataFrame.union, [t.select(*named, F.explode(F.array(number(d, _col(lo)), number(d, _col(hi)))).alias("_x")) for t, lo, hi in tables])
    other = counts.select(*[_col(h).alias(f"_{h}") for h in hs], "_n")
    of = rows.join(other, reduce(lambda a, b: a & b, [_col(h).eqNullSafe(_col(f"_{h}")) for h in hs]))
    marks = [k / (_QUANTILES - 1) for k in range(_QUANTILES)]
    found = of.groupBy(*hs).agg(F.percentile_approx("_x", marks, 20 * _QUANTILES).alias("_q"), F.first("_n").alias("_n"))
    # a key of unbounded rows only has no places to deal by
    return stage(found.withColumn("_q", F.array_distinct(F.coalesce("_q", F.array().cast("array<double>")))).filter(F.size("_q") > 1), "scales")


def together(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """rows dealt by key once, for all windows and aggregates by key and more that follow; more tasks for more input, so that one task's memory doesn't grow with it. Small inputs are left to Spark."""
    if (size := estimate(rows)) < CHECK_BYTES:
        return rows
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return rows.repartition(n, *[_col(k) for k in keys])


def told_small(t: DataFrame) -> bool:
    """Whether a table is marked to be broadcast: rows of any number meet it where they are."""
    return "strategy=broadcast" in t._jdf.queryExecution().analyzed().toString()


def placed(x: Column) -> Column:
    """About how many cuts of the row's key (`_q`, `_n`) lie before a number: monotone in it, from 0 to `_n`; null for null."""
    q, n = F.col("_q"), F.col("_n")
    steps = F.lit([1 << k for k in range((_QUANTILES).bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda a, k: F.when((a + k <= F.size(q)) & (F.get(q, a + k - 1) <= x), a + k).otherwise(a))
    near = lambda a: (a - 1 + (x - F.get(q, a - 1)) / (F.get(q, a) - F.get(q, a - 1))) * n / (F.size(q) - 1)
    # one evaluation of the search, used three times
    return F.get(F.transform(F.array(at), lambda a: F.when(x.isNull(), F.lit(None)).when(a == 0, F.lit(0.0)).when(a >= F.size(q), n.cast("double")).otherwise(near(a))), F.lit(0))


def with_scale(rows: DataFrame, keys: Iterable[str], hot: DataFrame) -> DataFrame:
    """rows with `_q` and `_n` of their key, null for keys that aren't hot. The table of hot keys is broadcast only if Spark finds it small."""
    names = hot.columns[:-2]
    return rows.join(hot, reduce(lambda a, b: a & b, [_col(k).eqNullSafe(_col(h)) for k, h in zip(keys, names, strict=True)]), "left").drop(*names)


def binned(
    keys: Iterable[str], left: DataFrame, a: tuple[str, str], right: DataFrame, b: tuple[str, str], right_keys: Iterable[str], d: Dim, hot: DataFrame, *, most: int | None = None
) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both tables with the bins of their rows, and the equalities by which pairs meet once, beside the keys'. a and b name the cuts."""
    keys, right_keys = list(keys), list(right_keys)
    base = float(max(1, (most or HOT_ROWS) // 8))

    def level(t: DataFrame, lo: str, hi: str) -> DataFrame:
        x, y = number(d, _col(lo)), number(d, _col(hi))
        t = t.withColumns({"_a": F.when(F.col("_q").isNotNull(), F.coalesce(placed(x), F.lit(0.0))), "_b": F.when(F.col("_q").isNotNull(), F.coalesce(placed(y), F.col("_n").cast("double")))})
        own = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest((F.col("_b") - F.col("_a")) / base, F.lit(1.0)))).cast("int") - 3)
        return t.withColumn("_level", F.when(F.col("_q").isNull(), F.lit(-1)).otherwise(own))

    x, y = level(with_scale(left, keys, hot), *a), level(with_scale(right, right_keys, hot), *b)

    def homes(t: DataFrame, by: list[str], name: str) -> DataFrame:
        """The levels where rows of each hot key are at home."""
        return t.filter("_level >= 0").groupBy(*[_col(k).alias(f"_h_{k}") for k in by]).agg(F.collect_set("_level").alias(name))

    def spread(t: DataFrame, by: list[str], others: DataFrame, side: str, home: int, guest: int, least: int) -> DataFrame:
        names = others.columns[:-1]
        t = t.join(others, reduce(lambda p, q: p & q, [_col(k).eqNullSafe(_col(h)) for k, h in zip(by, names, strict=True)]), "left").drop(*names)
        visits = F.filter(F.coalesce("_homes", F.array().cast("array<int>")), lambda k: k >= F.col("_level") + least)
        hot_stays = F.concat(F.array(F.struct(F.lit(home).alias("role"), F.col("_level").alias("at"))), F.transform(visits, lambda k: F.struct(F.lit(guest).alias("role"), k.alias("at"))))
        stays = F.when(F.col("_level") >= 0, hot_stays).otherwise(F.array(F.struct(F.lit(1).alias("role"), F.lit(-1).alias("at"))))
        out = t.withColumn("_stay", F.explode(stays))
        at = lambda c: F.when(F.col("_stay.at") < 0, F.lit(0)).otherwise(F.floor(F.col(c) / (F.lit(base) * F.pow(F.lit(4.0), F.col("_stay.at"))))).cast("bigint")
        out = out.withColumn("_first", at("_a"))
        out = out.withColumn("_bin", F.explode(F.sequence("_first", F.greatest(F.col("_first"), at("_b")))))
        return out.withColumnsRenamed({"_stay": f"{side}_stay", "_first": f"{side}_first", "_bin": f"{side}_bin"}).drop("_q", "_n", "_a", "_b", "_level", "_homes")

    l_homes, r_homes = homes(x, keys, "_homes"), homes(y, right_keys, "_homes")
    p = spread(x, keys, r_homes, "_l", 1, 2, 1)
    q = spread(y, right_keys, l_homes, "_s", 2, 1, 0)
    return p, q, [F.col("_l_bin") == F.col("_s_bin"), F.col("_l_stay") == F.col("_s_stay"), F.col("_l_bin") == F.greatest("_l_first", "_s_first")]


def dealt(rows: DataFrame, keys: Iterable[str], d: Dim, cut: str, hot: DataFrame, *, most: int | None = None) -> DataFrame:
    """rows with `_part`: the range of the key's scale that a cut falls into, in order; 0 for keys that aren't hot."""
    c = _col(cut)
    size = float(16 * (most or HOT_ROWS))
    part = F.floor(placed(number(d, c)) / size)
    t = with_scale(rows, keys, hot)
    whole = F.when(F.col("_q").isNull() | d.is_first(c), F.lit(0)).when(d.is_last(c), F.floor(F.col("_n") / size) + 1).otherwise(part)
    return t.withColumn("_part", whole.cast("bigint")).drop("_q", "_n")


def carried(rows: DataFrame, keys: Iterable[str], aggregates: dict[str, tuple[Column, object]]) -> DataFrame:
    """rows with what aggregates of all earlier parts of their key come to: name -> (aggregate of a part, how parts combine over a window). One row a part is gathered."""
    by = [*keys, "_part"]
    sums = rows.groupBy(*by).agg(*[a.alias(n) for n, (a, _) in aggregates.items()]).select(*[_col(c).alias(f"_c_{c}") for c in by], *aggregates)
    order = Window.partitionBy(*[f"_c_{k}" for k in keys]).orderBy("_c__part")
    before = sums.select(*[f"_c_{c}" for c in by], *[over(F.col(n), order).alias(n) for n, (_, over) in aggregates.items()])
    on = reduce(lambda a, b: a & b, [_col(c).eqNullSafe(_col(f"_c_{c}")) for c in by])
    return rows.join(before, on, "left").drop(*[f"_c_{c}" for c in by])


def earlier(f):
    """An aggregate over the parts before a part."""
    return lambda c, order: f(c).over(order.rowsBetween(Window.unboundedPreceding, -1))


def following(c: Column, order) -> Column:
    return F.lead(c).over(order)
