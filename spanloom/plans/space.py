"""Queries over keys of very different sizes, regions of several dimensions, ordered folds and stored frames, with the same results in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.cuts import Dim, Open, interval
from ..operators.folds import fold, fold_stream
from ..operators.frame import IntervalFrame, Shape, timeline
from ..operators.runs import RunFrame
from ..sources.clustered import Clustered
from .catalogue import DAY, QTY, SPANS_SQL, _boxes, merged, query, read, shown, spans

POS, PCT, X, Y = Dim("pos"), Dim("pct"), Dim("x"), Dim("y")

# --- a key with a third of all rows ---
_KEY = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END"

_LINES_SQL = f"""
li AS (SELECT {_KEY} k, l_orderkey * 10 + min(l_linenumber) a, l_orderkey * 10 + max(l_linenumber) + 1 b, max(l_returnflag) f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey),
ol AS (SELECT {_KEY} k, o_orderkey * 10 s, o_orderstatus v FROM orders),
os AS (SELECT k, s, v, CASE WHEN lag(v) OVER (PARTITION BY k ORDER BY s) = v THEN 0 ELSE 1 END n FROM ol),
oi AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s) i FROM os),
og AS (SELECT k, min(s) a, max(v) v FROM oi GROUP BY k, i),
st AS (SELECT k, a, coalesce(lead(a) OVER (PARTITION BY k ORDER BY a), 1000000000000) b, v FROM og)"""


def _lines(spark, d) -> IntervalFrame:
    """Per key, where an order's lines lie on the line of all orders, with their last return flag. Key 0 has a third of all rows."""
    orders = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).alias("k"))
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.max("l_returnflag").alias("value"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("k", "value", (F.col("l_orderkey") * 10 + F.col("a")).alias("a"), (F.col("l_orderkey") * 10 + F.col("b")).alias("b"))
    return IntervalFrame.from_df(rows, {POS: (F.col("a"), F.col("b"))}, keys=["k"]).on_keys(skewed=True)


def _statuses(spark, d) -> IntervalFrame:
    """Per key, the status of the last order so far along the line."""
    orders = read(spark, d, "orders").withColumn("k", F.when(F.col("o_custkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))
    return timeline(orders, POS, F.col("o_orderkey") * 10, F.col("o_orderstatus"), ["k"], [F.col("o_orderkey")]).on_keys(skewed=True)


@query(f"WITH {_LINES_SQL} SELECT l.k, greatest(l.a, s.a) pos_lo, least(l.b, s.b) pos_hi, l.f AS value, s.v AS value_2 FROM li l JOIN st s ON l.k = s.k AND l.a < s.b AND s.a < l.b")
def zip_skewed(spark, d):
    """zip where one key has a third of all rows: its rows meet in bins of the key's own scale."""
    return shown(_lines(spark, d).zip(_statuses(spark, d)))


_CELLS_SQL = """
cu AS (SELECT k, a c FROM li UNION SELECT k, b FROM li UNION SELECT k, a FROM st UNION SELECT k, b FROM st),
se AS (SELECT k, c a, lead(c) OVER (PARTITION BY k ORDER BY c) b FROM cu),
ce AS (SELECT se.k, se.a, se.b, l.f, s.v FROM se ASOF LEFT JOIN li l ON se.k = l.k AND se.a >= l.a ASOF LEFT JOIN st s ON se.k = s.k AND se.a >= s.a WHERE se.b IS NOT NULL),
cl AS (SELECT se.k, se.a, se.b, CASE WHEN l.b >= se.b THEN l.f END f, CASE WHEN s.b >= se.b THEN s.v END v
  FROM se ASOF LEFT JOIN li l ON se.k = l.k AND se.a >= l.a ASOF LEFT JOIN st s ON se.k = s.k AND se.a >= s.a WHERE se.b IS NOT NULL)"""


@query(f"WITH {_LINES_SQL}, {_CELLS_SQL} SELECT k, a pos_lo, CASE WHEN b < 1000000000000 THEN b END pos_hi, coalesce(f, '-') AS value, coalesce(v, '+') AS value_2 FROM cl WHERE f IS NOT NULL OR v IS NOT NULL")
def zip_all_skewed(spark, d):
    """zipAll where one key has a third of all rows: a sweep along ranges of the key's scale, with what each carries over."""
    return shown(_lines(spark, d).zip_all(_statuses(spark, d), {"value": "-"}, {"value": "+"}))


@query(f"WITH {_LINES_SQL}, {_CELLS_SQL}, ok AS (SELECT k, a, b, v FROM cl WHERE f IS NULL AND v IS NOT NULL), {merged('ok', 'k', value=', v')} SELECT k, a pos_lo, CASE WHEN b < 1000000000000 THEN b END pos_hi, v AS value FROM out")
def difference_skewed(spark, d):
    """difference where one key has a third of all rows."""
    return shown(_statuses(spark, d).difference(_lines(spark, d)))


# --- writes in two and three dimensions ---
def _writes(spark, d, dims: dict, columns: list) -> IntervalFrame:
    """Lines as overlapping boxes, in order of their numbers."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("shipped", F.col("l_shipdate").cast("date")).filter("shipped > ordered")
    rows = lines.select("o_custkey", "ordered", "shipped", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("c"), F.col("l_returnflag").alias("value"), F.struct("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), "l_returnflag").alias("seq"))
    f = IntervalFrame.from_df(rows.distinct(), dims, ["value", "seq"], ["o_custkey"])
    return IntervalFrame(f.df, f.dims, ("value",), f.keys).carrying(f.df)


_BOXES = f"""{SPANS_SQL.replace('AS (SELECT l_orderkey,', 'AS (SELECT l_partkey, CAST(round(l_discount * 100) AS BIGINT) c, l_orderkey,')},
bx AS (SELECT DISTINCT o_custkey, a, b, greatest(q - 3, 1) qa, q + 4 qb, c ca, c + 2 cb, l_returnflag f, l_orderkey, l_linenumber, l_partkey FROM spans)"""


def _grid(*dims: tuple[str, str, str]) -> str:
    """Segments between neighbouring cuts of each dimension, by customer."""
    return ", ".join(f"c{n} AS (SELECT o_custkey, {a} c FROM bx UNION SELECT o_custkey, {b} FROM bx), s{n} AS (SELECT o_custkey, c {a}, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) {b} FROM c{n})" for n, a, b in dims)


def _cells(*dims: tuple[str, str, str], values: str) -> str:
    joins = " ".join(f"JOIN s{n} ON s{n}.o_custkey = bx.o_custkey AND bx.{a} <= s{n}.{a} AND s{n}.{b} <= bx.{b}" for n, a, b in dims)
    return f"cell AS (SELECT bx.o_custkey, {', '.join(f's{n}.{a}, s{n}.{b}' for n, a, b in dims)}, {values} FROM bx {joins} GROUP BY ALL)"


def _runs(dims: tuple[tuple[str, str, str], ...], value: str) -> str:
    """Canonical boxes of cells: runs of each dimension in turn."""
    out, src = [], "cell"
    for n, a, b in dims:
        by = ", ".join(["o_custkey", value, *[c for m, x, y in dims if m != n for c in (x, y)]])
        out.append(f"n{n} AS (SELECT *, CASE WHEN lag({b}) OVER (PARTITION BY {by} ORDER BY {a}) = {a} THEN 0 ELSE 1 END nw FROM {src}), i{n} AS (SELECT *, sum(nw) OVER (PARTITION BY {by} ORDER BY {a}) isl FROM n{n}), r{n} AS (SELECT {by}, min({a}) {a}, max({b}) {b} FROM i{n} GROUP BY {by}, isl)")
        src = f"r{n}"
    return ", ".join(out)


_TWO = (("d", "a", "b"), ("q", "qa", "qb"))
_THREE = (*_TWO, ("p", "ca", "cb"))
_LAST = "arg_max(f, (l_orderkey, l_linenumber, l_partkey, f)) v"


@query(f"WITH {_BOXES}, {_grid(*_TWO)}, {_cells(*_TWO, values=_LAST)}, {_runs(_TWO, 'v')} SELECT o_custkey, a day_lo, b day_hi, qa qty_lo, qb qty_hi, v AS value FROM rq")
def set_many_2d(spark, d):
    """setMany of overlapping day x quantity boxes, the last line wins: canonical boxes, cut only where boxes meet."""
    f = _writes(spark, d, {DAY: (F.col("ordered"), Open(F.col("shipped"))), QTY: (F.greatest(F.col("q") - 3, F.lit(1)), F.col("q") + 3)}, ["q"])
    return shown(f._with(f.df.limit(0)).set_many(f, order=F.col("seq")))


@query(f"WITH {_BOXES}, {_grid(*_THREE)}, {_cells(*_THREE, values=_LAST)}, {_runs(_THREE, 'v')} SELECT o_custkey, a day_lo, b day_hi, qa qty_lo, qb qty_hi, ca pct_lo, cb pct_hi, v AS value FROM rp")
def set_many_3d(spark, d):
    """setMany of overlapping day x quantity x discount boxes."""
    f = _writes(spark, d, {DAY: (F.col("ordered"), Open(F.col("shipped"))), QTY: (F.greatest(F.col("q") - 3, F.lit(1)), F.col("q") + 3), PCT: (F.col("c"), F.col("c") + 1)}, ["q", "c"])
    return shown(f._with(f.df.limit(0)).set_many(f, order=F.col("seq")))


@query(f"WITH {_BOXES}, {_grid(*_TWO)}, {_cells(*_TWO, values='count(*) n')} SELECT o_custkey, CAST(sum((b - a) * (qb - qa)) AS DOUBLE) AS measure FROM cell GROUP BY 1")
def covered_area(spark, d):
    """The measure of a union: days x quantities that any line of a customer covers."""
    f = _writes(spark, d, {DAY: (F.col("ordered"), Open(F.col("shipped"))), QTY: (F.greatest(F.col("q") - 3, F.lit(1)), F.col("q") + 3)}, ["q"])
    return Shape(f.df, f.dims, (), f.keys).covered_measure().withColumn("measure", F.col("measure").cast("double"))


# --- topology in two dimensions ---
@query(f"""WITH RECURSIVE {_BOXES}, one AS (SELECT *, row_number() OVER () r FROM (SELECT DISTINCT o_custkey, a, b, qa, qb FROM bx)),
met AS (SELECT x.o_custkey, x.r, y.r s FROM one x JOIN one y ON x.o_custkey = y.o_custkey AND x.a <= y.b AND y.a <= x.b AND x.qa <= y.qb AND y.qa <= x.qb),
reach(o_custkey, r, s) AS (SELECT * FROM met UNION SELECT g.o_custkey, g.r, m.s FROM reach g JOIN met m ON g.s = m.r AND g.o_custkey = m.o_custkey),
lab AS (SELECT o_custkey, r, min(s) c FROM reach GROUP BY ALL)
SELECT o_custkey, CAST(count(DISTINCT c) AS BIGINT) AS parts, count(*) AS boxes, count(DISTINCT c) = 1 AS contiguous FROM lab GROUP BY 1""")
def components_2d(spark, d):
    """contiguousSubshapes and isContiguous of each customer's boxes: how many connected parts they make."""
    f = _writes(spark, d, {DAY: (F.col("ordered"), Open(F.col("shipped"))), QTY: (F.greatest(F.col("q") - 3, F.lit(1)), F.col("q") + 3)}, ["q"])
    parts = Shape(f.df, f.dims, (), f.keys).components()
    return parts.groupBy("o_custkey").agg(F.count_distinct("component").alias("parts"), F.count("*").alias("boxes"), (F.count_distinct("component") == 1).alias("contiguous"))


def _frames(spark, d) -> Shape:
    """For each customer a picture frame of four bars whose place and size come from the row: whole, with its right bar missing, filled, or with a box apart."""
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 10).cast("bigint").alias("x"), (F.col("c_custkey") % 7 + 3).alias("w"), F.floor("c_acctbal").cast("bigint").alias("y"))
    x, y, w, kind = F.col("x"), F.col("y"), F.col("w"), F.col("c_custkey") % 4
    box = lambda a, b, p, q: F.struct(a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"))
    bars = [box(x, x + w + 2, y, y + 1), box(x, x + w + 2, y + w + 1, y + w + 2), box(x, x + 1, y + 1, y + w + 1)]
    right, inside, apart = box(x + w + 1, x + w + 2, y + 1, y + w + 1), box(x + 1, x + w + 1, y + 1, y + w + 1), box(x + w + 5, x + w + 6, y, y + 1)
    rows = F.when(kind == 1, F.array(*bars)).when(kind == 2, F.array(*bars, right, inside)).when(kind == 3, F.array(*bars, right, apart)).otherwise(F.array(*bars, right))
    made = c.select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.*")
    f = IntervalFrame.from_df(made, {X: (F.col("a"), F.col("b") - 1), Y: (F.col("p"), F.col("q") - 1)}, (), ["c_custkey"])
    return Shape(f.df, f.dims, (), f.keys)


@query("""SELECT c_custkey, c_custkey % 4 <> 3 AS contiguous, CAST(c_custkey % 4 IN (0, 3) AS BIGINT) AS cavities, c_custkey % 4 IN (1, 2) AS solid, true AS bounded FROM customer
UNION ALL SELECT -c_custkey, true, 1, false, false FROM customer WHERE c_custkey % 4 = 2""")
def topology_2d(spark, d):
    """isContiguous, cavities, isSolid and isBounded of each customer's frame, and of the outside of the filled ones (keys below 0), in which the frame is a cavity."""
    s = _frames(spark, d)
    filled = Shape(s.df.filter("c_custkey % 4 = 2"), s.dims, (), s.keys).complement()
    both = s.df.unionByName(filled.df.withColumn("c_custkey", -F.col("c_custkey")))
    return Shape(both, s.dims, (), s.keys).topology()


@query("SELECT c_custkey, c_nationkey * 10 + 1 AS x_lo, c_nationkey * 10 + c_custkey % 7 + 4 AS x_hi, CAST(floor(c_acctbal) AS BIGINT) + 1 AS y_lo, CAST(floor(c_acctbal) AS BIGINT) + c_custkey % 7 + 4 AS y_hi FROM customer WHERE c_custkey % 4 IN (0, 3)")
def cavities_2d(spark, d):
    """The insides of whole frames: bounded parts of what a region doesn't cover."""
    s = _frames(spark, d)
    return s.cavities().select(*s.keys, *s.bounds)


# --- ordered folds ---
_P = 1_000_003


@query(f"""WITH {_LINES_SQL}, m AS (SELECT k, list({{'a': a % 1000 + 1, 'b': (b + ascii(f)) % 1000}} ORDER BY a) l FROM li GROUP BY k),
r AS (SELECT k, list_reduce(l, lambda f, g: {{'a': (g.a * f.a) % {_P}, 'b': (g.a * f.b + g.b) % {_P}}}) x FROM m) SELECT k, x.a AS a, x.b AS b FROM r""")
def fold_ordered(spark, d):
    """foldLeft of an associative operation (affine maps, one after the other) in parts of a key, without gathering it."""
    f = _lines(spark, d)
    state = lambda a, b: F.struct((a % _P).cast("bigint").alias("a"), (b % _P).cast("bigint").alias("b"))
    lift = state(F.col("pos_lo") % 1000 + 1, (F.col("pos_hi") + F.ascii("value")) % 1000)
    return fold(f, lift, lambda x, y: state(y["a"] * x["a"], y["a"] * x["b"] + y["b"]), name="s").select("k", "s.a", "s.b")


@query(f"""WITH {_LINES_SQL}, m AS (SELECT k, list(a ORDER BY a) l FROM li GROUP BY k) SELECT k, list_reduce(list_prepend(CAST(0 AS BIGINT), l), lambda s, v: ((s * 7 + v) // 3) % 1000) AS value FROM m""")
def fold_streamed(spark, d):
    """foldLeft of an operation that isn't associative: sorted rows, the state carried from batch to batch."""
    return fold_stream(_lines(spark, d), lambda: 0, lambda s, r: (s * 7 + r["pos_lo"]) // 3 % 1000, lambda s: s, "bigint", name="value")


# --- stored frames ---
_LOOKED = (("winter", "1997-01-10", "1997-01-12", 45, 48), ("point", "1999-06-01", "1999-06-01", 50, 50), ("none", "1980-01-01", "1980-12-31", 1, 50))


@query(f"WITH {SPANS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS look, o_custkey, a AS day_lo, b AS day_hi, CAST(1 AS BIGINT) AS qty_lo, q + 1 AS qty_hi, CAST(1 AS BIGINT) AS value FROM spans WHERE a <= DATE '{y}' AND b > DATE '{x}' AND q >= {p}" for n, x, y, p, _ in _LOOKED))
def clustered_lookup(spark, d):
    """getIntersecting and getAt on a stored frame: parts of which no row can match aren't read."""
    stored = Clustered.write(_boxes(spark, d), part_rows=4096)
    out = None
    for name, a, b, p, q in _LOOKED:
        a, b = (dt.date.fromisoformat(x) for x in (a, b))
        f = stored.get_data_at(a, p) if name == "point" else stored.get_intersecting([interval(DAY, a, b), interval(QTY, p, q)])
        one = shown(f).withColumn("look", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SPANS_SQL},
cuts AS (SELECT o_custkey, a c FROM spans UNION SELECT o_custkey, b FROM spans),
seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT s.o_custkey, s.a, s.b, arg_max(r.l_returnflag, (r.l_linenumber, r.l_orderkey, r.l_returnflag)) v FROM seg s JOIN spans r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b GROUP BY ALL),
{merged('cell', 'o_custkey', value=', v')}
SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out""")
def incremental_writes(spark, d):
    """Seven runs of writes, one for each line number, with compactions in between: only touched buckets are rewritten."""
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"), "l_linenumber", F.struct("l_orderkey", "l_returnflag").alias("seq"))
    f = IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, ["value", "l_linenumber", "seq"], ["o_custkey"])
    store = RunFrame(IntervalFrame(f.df, f.dims, ("value",), f.keys), buckets=8)
    for n in range(1, 8):
        run = f.df.filter(F.col("l_linenumber") == n)
        store.append(IntervalFrame(run, f.dims, ("value",), f.keys).carrying(run), order=F.col("seq"))
        if n in (2, 5):
            store.compact()
    return shown(store.frame())
