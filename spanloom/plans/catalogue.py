"""Queries over the star schema, one or more for each family of operators, with the same results in DuckDB's SQL.

Results show inclusive starts and exclusive ends of discrete dimensions, null where unbounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cuts as C
from ..functions import rules as R
from ..functions.cuts import BOTTOM, TOP, Dim, Open, Probe, interval
from ..operators.frame import IntervalFrame, Multi, Shape, sweep_sum, timeline
from ..operators.piecewise import FunctionFrame
from ..operators.versioned import Versioned
from ..sources import codec
from ..sources.staging import stage

DAY, QTY, SEC, AMOUNT = Dim("day", "date"), Dim("qty"), Dim("sec"), Dim("amount", "double", "continuous")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shown(frame: IntervalFrame, *, df: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Keys, bounds (null if unbounded) and values."""
    out = [F.col(k) for k in frame.keys]
    for d in frame.dims:
        for c, edge in ((d.lo, d.first), (d.hi, d.last)):
            out.append(F.when(F.col(c) != d.column(edge), F.col(c)).alias((names or {}).get(c, c)))
    return (frame.df if df is None else df).select(*out, *frame.values)


def priority(spark: SparkSession, d: str, column: str = "o_orderpriority") -> IntervalFrame:
    """Per customer, the priority (or status) of the last order so far, from its day on."""
    orders = read(spark, d, "orders")
    return timeline(orders, DAY, F.col("o_orderdate").cast("date"), F.col(column), ["o_custkey"], [F.col("o_orderkey")])


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines that ship after they are ordered, with customer and days."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("shipped"), "l_returnflag")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).filter("shipped > ordered")


def open_orders(spark: SparkSession, d: str) -> IntervalFrame:
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_quantity").cast("bigint").alias("value"))
    return IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, keys=["o_custkey"])


def sessions(spark: SparkSession, d: str) -> Shape:
    """Per user, a minute from each event on, in whole seconds."""
    events = read(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("s"))
    rows = IntervalFrame.from_df(events, {SEC: (F.col("s"), Open(F.col("s") + 60))}, (), ["user_id"])
    return Shape(rows.df, rows.dims, (), rows.keys).recompress_all()


# --- the same in SQL ---
def line(column: str, name: str) -> str:
    return f"""
{name}_last AS (SELECT o_custkey, CAST(o_orderdate AS DATE) s, arg_max({column}, o_orderkey) v FROM orders GROUP BY ALL),
{name}_step AS (SELECT o_custkey, s, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) e, v, CASE WHEN lag(v) OVER (PARTITION BY o_custkey ORDER BY s) = v THEN 0 ELSE 1 END n FROM {name}_last),
{name}_isl AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s) i FROM {name}_step),
{name} AS (SELECT o_custkey, min(s) lo, CASE WHEN count(e) = count(*) THEN max(e) END hi, max(v) v FROM {name}_isl GROUP BY o_custkey, i)"""


SPANS_SQL = """
spans AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) q, l_returnflag, o_custkey, CAST(o_orderdate AS DATE) a, CAST(l_shipdate AS DATE) b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE))"""

SESSIONS_SQL = """
ev AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) a, CAST(floor(epoch(ts)) AS BIGINT) + 60 b FROM events),
ev_new AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END n FROM ev),
ev_isl AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a) i FROM ev_new),
ses AS (SELECT user_id, min(a) a, max(b) b FROM ev_isl GROUP BY user_id, i)"""


def merged(src: str, key: str, a: str = "a", b: str = "b", *, name: str = "out", value: str = "") -> str:
    """Islands of a region per key."""
    by = f"{key}{value}"
    return f"""
{name}_new AS (SELECT *, CASE WHEN max({b}) OVER (PARTITION BY {by} ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {a} THEN 0 ELSE 1 END n FROM {src}),
{name}_isl AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY {a}, {b} ROWS UNBOUNDED PRECEDING) i FROM {name}_new),
{name} AS (SELECT {by}, min({a}) a, max({b}) b FROM {name}_isl GROUP BY {by}, i)"""


TIMELINE = f"WITH {line('o_orderpriority', 'p')} SELECT o_custkey, lo day_lo, hi day_hi, v AS value FROM p"


# --- writes ---
@query(TIMELINE)
def set_many_timeline(spark, d):
    """setMany of [order day, +inf) -> priority in order, coalesced; right-unbounded writes in start order need windows only."""
    return shown(priority(spark, d))


@query(f"""WITH {SPANS_SQL},
cuts AS (SELECT o_custkey, a c FROM spans UNION SELECT o_custkey, b FROM spans),
seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT s.o_custkey, s.a, s.b, arg_max(r.l_returnflag, r.l_orderkey * 1000 + r.l_linenumber * 100 + ascii(r.l_returnflag)) v FROM seg s JOIN spans r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b GROUP BY ALL),
{merged('cell', 'o_custkey', value=', v')}
SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out""")
def set_many_overlapping(spark, d):
    """setMany of bounded, overlapping rows: the last line written wins in each cell."""
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.ascii("l_returnflag")).alias("seq"))
    f = IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, ["value", "seq"], ["o_custkey"])
    writes = IntervalFrame(f.df, f.dims, ("value",), f.keys).carrying(f.df)
    return shown(writes._with(writes.df.limit(0)).set_many(writes, order=F.col("seq")))


@query(f"""WITH {line('o_orderpriority', 'p')},
cut AS (SELECT o_custkey, lo, coalesce(hi, DATE '9999-12-31') hi, v FROM p),
pieces AS (SELECT o_custkey, lo a, least(hi, DATE '1998-01-01') b, v FROM cut UNION ALL SELECT o_custkey, greatest(lo, DATE '1998-01-01'), least(hi, DATE '1998-07-01'), 'FROZEN' FROM cut UNION ALL SELECT o_custkey, greatest(lo, DATE '1998-07-01'), hi, v FROM cut),
ok AS (SELECT * FROM pieces WHERE a < b), {merged('ok', 'o_custkey', value=', v')}
SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM out""")
def update_region(spark, d):
    import datetime as dt

    return shown(priority(spark, d).update(interval(DAY, dt.date(1998, 1, 1), dt.date(1998, 6, 30)), "FROZEN"))


@query(f"""WITH {line('o_orderpriority', 'p')},
cut AS (SELECT o_custkey, lo, coalesce(hi, DATE '9999-12-31') hi, v FROM p),
pieces AS (SELECT o_custkey, lo a, least(hi, DATE '1998-01-01') b, v FROM cut UNION ALL SELECT o_custkey, greatest(lo, DATE '1998-07-01'), hi, v FROM cut)
SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM pieces WHERE a < b""")
def remove_region(spark, d):
    import datetime as dt

    return shown(priority(spark, d).remove(interval(DAY, dt.date(1998, 1, 1), dt.date(1998, 6, 30))))


@query(f"""WITH {SESSIONS_SQL}, edge AS (SELECT user_id, min(a) a, max(b) b FROM ses GROUP BY 1),
gap AS (SELECT user_id, b a, lead(a) OVER (PARTITION BY user_id ORDER BY a) b FROM ses)
SELECT user_id, a sec_lo, b sec_hi, 'busy' AS value FROM ses UNION ALL SELECT user_id, a, b, 'idle' FROM gap WHERE b IS NOT NULL""")
def fill_gaps(spark, d):
    """Gaps between a user's sessions filled with idle, up to its first and last event: a fill whose box differs from key to key."""
    busy = sessions(spark, d)
    hull = Shape(busy.bounding_interval(), busy.dims, (), busy.keys)
    return shown(IntervalFrame(busy.with_value("busy").df.unionByName(hull.difference(busy).with_value("idle").df), busy.dims, ("value",), busy.keys))


@query(f"""WITH {SPANS_SQL},
delta AS (SELECT o_custkey, c, sum(x) x, sum(n) n FROM (SELECT o_custkey, a c, q x, 1 n FROM spans UNION ALL SELECT o_custkey, b, -q, -1 FROM spans) GROUP BY ALL),
run AS (SELECT o_custkey, c a, lead(c) OVER w b, sum(x) OVER w v, sum(n) OVER w k FROM delta WINDOW w AS (PARTITION BY o_custkey ORDER BY c)),
held AS (SELECT * FROM run WHERE k > 0), {merged('held', 'o_custkey', value=', v')}
SELECT o_custkey, a day_lo, b day_hi, CAST(v AS BIGINT) AS value FROM out""")
def monoid_sum_sweep(spark, d):
    """Open quantity per customer over time, by a sweep."""
    out = sweep_sum(open_orders(spark, d))
    return shown(out)


@query(SQL["monoid_sum_sweep"])
def merge_many_sum(spark, d):
    """The same by cells and an aggregate: mergeMany, the monoid's union."""
    rows = open_orders(spark, d)
    return shown(rows._with(rows.df.limit(0)).merge_many(rows, {"value": F.sum}))


@query(f"""WITH {line('o_orderpriority', 'p')}, {line('o_orderstatus', 's')},
old AS (SELECT o_custkey, lo, hi, v FROM p), new AS (SELECT o_custkey, lo, hi, v FROM s)
SELECT CASE WHEN old.lo IS NULL THEN 'Create' WHEN new.lo IS NULL THEN 'Delete' ELSE 'Update' END AS action, coalesce(new.o_custkey, old.o_custkey) o_custkey, coalesce(new.lo, old.lo) day_lo, new.hi day_hi, new.v AS value
FROM old FULL JOIN new ON old.o_custkey = new.o_custkey AND old.lo = new.lo WHERE NOT (old.lo IS NOT NULL AND new.lo IS NOT NULL AND old.hi IS NOT DISTINCT FROM new.hi AND old.v = new.v)""")
def diff_actions(spark, d):
    """What turns the priority timeline into the status timeline."""
    new, old = priority(spark, d, "o_orderstatus"), priority(spark, d)
    acts = new.diff_actions_from(old)
    return acts.select("action", "o_custkey", "day_lo", F.when(F.col("day_hi") != DAY.column(DAY.last), F.col("day_hi")).alias("day_hi"), "value")


@query(f"WITH {line('o_orderstatus', 'p')} SELECT o_custkey, lo day_lo, hi day_hi, v AS value FROM p")
def apply_diff(spark, d):
    """The priority timeline synchronised with the status timeline."""
    return shown(priority(spark, d).sync_with(priority(spark, d, "o_orderstatus")))


# --- look-ups and joins ---
@query(f"WITH {line('o_orderpriority', 'p')} SELECT o_custkey, v AS value FROM p WHERE lo <= DATE '1998-06-01' AND (hi IS NULL OR hi > DATE '1998-06-01')")
def get_at_asof(spark, d):
    import datetime as dt

    return priority(spark, d).get_at(dt.date(1998, 6, 1))


@query(f"""WITH {line('o_orderpriority', 'p')} SELECT o_custkey, greatest(lo, DATE '1997-01-01') day_lo, least(coalesce(hi, DATE '1998-01-01'), DATE '1998-01-01') day_hi, v AS value
FROM p WHERE lo < DATE '1998-01-01' AND (hi IS NULL OR hi > DATE '1997-01-01')""")
def get_intersecting_clipped(spark, d):
    import datetime as dt

    return shown(priority(spark, d).clip(interval(DAY, dt.date(1997, 1, 1), dt.date(1997, 12, 31))))


@query(f"""WITH {line('o_orderpriority', 'p')}, {line('o_orderstatus', 's')}
SELECT p.o_custkey, greatest(p.lo, s.lo) day_lo, CASE WHEN p.hi IS NULL THEN s.hi WHEN s.hi IS NULL THEN p.hi ELSE least(p.hi, s.hi) END day_hi, p.v AS value, s.v AS value_2
FROM p JOIN s ON p.o_custkey = s.o_custkey AND (s.hi IS NULL OR p.lo < s.hi) AND (p.hi IS NULL OR s.lo < p.hi)""")
def zip_overlap(spark, d):
    """Temporal join of two timelines."""
    return shown(priority(spark, d).zip(priority(spark, d, "o_orderstatus")))


def _late(spark, d) -> IntervalFrame:
    """Per customer, when urgent orders were open."""
    rows = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").cast("date").alias("s"))
    f = IntervalFrame.from_df(rows, {DAY: (F.col("s"), F.date_add("s", 29))}, (), ["o_custkey"])
    return Shape(f.df, f.dims, (), f.keys).recompress_all().with_value("urgent")


LATE_SQL = f"u0 AS (SELECT o_custkey, CAST(o_orderdate AS DATE) a, CAST(o_orderdate AS DATE) + 30 b FROM orders WHERE o_orderpriority = '1-URGENT'), {merged('u0', 'o_custkey', name='u')}"
_GRID = f"""WITH {line('o_orderstatus', 's')}, {LATE_SQL}, st AS (SELECT o_custkey, lo a, coalesce(hi, DATE '9999-12-31') b, v FROM s),
cuts AS (SELECT o_custkey, a c FROM st UNION SELECT o_custkey, b FROM st UNION SELECT o_custkey, a FROM u UNION SELECT o_custkey, b FROM u),
seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT seg.o_custkey, seg.a, seg.b, st.v, u.a IS NOT NULL urgent FROM seg LEFT JOIN st ON st.o_custkey = seg.o_custkey AND st.a <= seg.a AND seg.b <= st.b LEFT JOIN u ON u.o_custkey = seg.o_custkey AND u.a <= seg.a AND seg.b <= u.b
  WHERE seg.b IS NOT NULL AND (st.v IS NOT NULL OR u.a IS NOT NULL))"""


@query(_GRID + " SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, coalesce(v, '<') AS value, CASE WHEN urgent THEN 'urgent' ELSE '>' END AS value_2 FROM cell")
def zip_all_defaults(spark, d):
    """Outer temporal join with defaults on the common grid."""
    return shown(priority(spark, d, "o_orderstatus").zip_all(_late(spark, d), {"value": "<"}, {"value": ">"}))


@query(_GRID + f", w AS (SELECT o_custkey, a, b, CASE WHEN urgent THEN v || '!' ELSE v END v FROM cell WHERE v IS NOT NULL), {merged('w', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM out")
def overlay_handlers(spark, d):
    """Overlay with handlers: both, only this; what only that covers is dropped."""
    f = priority(spark, d, "o_orderstatus").overlay(_late(spark, d), lambda a, x, b, y: F.when(a & b, F.concat(x, F.lit("!"))).when(a, x))
    return shown(f.coalesce())


@query(_GRID + f", w AS (SELECT o_custkey, a, b, v FROM cell WHERE v IS NOT NULL AND NOT urgent), {merged('w', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM out")
def difference_anti(spark, d):
    """The status timeline without urgent spans."""
    return shown(priority(spark, d, "o_orderstatus").difference(_late(spark, d)))


@query(_GRID + f", w AS (SELECT o_custkey, a, b, coalesce(CASE WHEN NOT urgent THEN v END, 'urgent') v FROM cell WHERE NOT (v IS NOT NULL AND urgent)), {merged('w', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM out")
def symmetric_difference_values(spark, d):
    return shown(priority(spark, d, "o_orderstatus").symmetric_difference(_late(spark, d)))


@query(_GRID + f", w AS (SELECT o_custkey, a, b, CASE WHEN urgent AND v IS NOT NULL THEN v || '+urgent' ELSE coalesce(v, 'urgent') END v FROM cell), {merged('w', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END day_hi, v AS value FROM out")
def merge_values(spark, d):
    f = priority(spark, d, "o_orderstatus").merge(_late(spark, d), {"value": lambda x, y: F.concat(x, F.lit("+"), y)})
    return shown(f)


# --- regions ---
@query(f"WITH {SESSIONS_SQL} SELECT user_id, a sec_lo, b sec_hi FROM ses")
def domain_sessions(spark, d):
    return shown(sessions(spark, d))


@query(f"""WITH {SESSIONS_SQL}, g AS (SELECT user_id, lag(b) OVER w a, a b, lead(a) OVER w nxt, b c FROM ses WINDOW w AS (PARTITION BY user_id ORDER BY a))
SELECT user_id, a sec_lo, b sec_hi FROM g UNION ALL SELECT user_id, c, NULL FROM g WHERE nxt IS NULL""")
def complement_sessions(spark, d):
    return shown(sessions(spark, d).complement())


@query(f"""WITH {SESSIONS_SQL}, x AS (SELECT user_id, a, b + 1801 b FROM ses), {merged('x', 'user_id')} SELECT user_id, a sec_lo, b - 1801 sec_hi FROM out""")
def closing_sessions(spark, d):
    """Morphological closing: sessions up to 30 minutes apart become one."""
    return shown(sessions(spark, d).closing(Probe(interval(SEC, 0, Open(1801)), 0)), names={})


@query(f"WITH {SESSIONS_SQL}, x AS (SELECT user_id, a - 300 a, b + 301 b FROM ses), {merged('x', 'user_id')} SELECT user_id, a sec_lo, b sec_hi FROM out")
def dilate_sessions(spark, d):
    return shown(sessions(spark, d).dilated(Probe(interval(SEC, -300, Open(301)), 0)), names={})


@query(f"WITH {SESSIONS_SQL} SELECT user_id, a + 30 sec_lo, b - 30 sec_hi FROM ses WHERE b - a > 60")
def erode_sessions(spark, d):
    return shown(sessions(spark, d).eroded(Probe(interval(SEC, -30, Open(30)), 0)))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, a sec_lo, b sec_hi FROM ses WHERE b - a > 89")
def opening_sessions(spark, d):
    """Morphological opening: only sessions of a minute and a half or more are left."""
    return shown(sessions(spark, d).opening(Probe(interval(SEC, 0, Open(89)), 0)))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, count(*) n, CAST(sum(b - a) AS BIGINT) AS measure FROM ses GROUP BY 1")
def measure_sessions(spark, d):
    s = sessions(spark, d)
    return s.df.groupBy("user_id").agg(F.count("*").alias("n")).join(s.map_reduce_measure(), "user_id")


@query(f"WITH {SESSIONS_SQL} SELECT user_id, a + 3600 sec_lo, b + 3600 sec_hi FROM ses")
def displace_sessions(spark, d):
    return shown(sessions(spark, d).displaced(3600))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, 3408134400 - b sec_lo, 3408134400 - a sec_hi FROM ses")
def reflect_sessions(spark, d):
    return shown(sessions(spark, d).reflected(1704067200))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, min(a) sec_lo, max(b) sec_hi FROM ses GROUP BY 1")
def bounding_interval(spark, d):
    return sessions(spark, d).bounding_interval()


# --- several dimensions ---
def _boxes(spark, d) -> IntervalFrame:
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_quantity").cast("bigint").alias("q"), F.lit(1).cast("bigint").alias("value"))
    return IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped"))), QTY: (1, F.col("q"))}, keys=["o_custkey"])


_BOX_SQL = f"WITH {SPANS_SQL}, bx AS (SELECT o_custkey, a, b, q FROM spans)"


@query(_BOX_SQL + f""", hit AS (SELECT o_custkey, a, b FROM bx WHERE q >= 47), {merged('hit', 'o_custkey')} SELECT o_custkey, a day_lo, b day_hi FROM out""")
def slice_2d(spark, d):
    """A slice of day x quantity boxes at a quantity, as a region."""
    return shown(_boxes(spark, d).slice_at("qty", 47)).drop("value")


@query(_BOX_SQL + """, cuts AS (SELECT o_custkey, a c FROM bx UNION SELECT o_custkey, b FROM bx), seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT s.o_custkey, s.a, s.b, count(*) v FROM seg s JOIN bx r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b GROUP BY ALL), """ + merged("cell", "o_custkey", value=", v") + " SELECT o_custkey, a day_lo, b day_hi, CAST(v AS BIGINT) AS value FROM out")
def flatten_dimension(spark, d):
    """How many boxes cover each day, the quantity projected away."""
    return shown(_boxes(spark, d).collapse("qty", {"value": F.sum}))


@query(_BOX_SQL + """, c0 AS (SELECT o_custkey, a c FROM bx UNION SELECT o_custkey, b FROM bx), s0 AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM c0),
c1 AS (SELECT o_custkey, CAST(1 AS BIGINT) c FROM bx UNION SELECT o_custkey, q + 1 FROM bx), s1 AS (SELECT o_custkey, c qa, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) qb FROM c1)
SELECT r.o_custkey, s0.a day_lo, s0.b day_hi, s1.qa qty_lo, s1.qb qty_hi, CAST(count(*) AS BIGINT) AS value FROM bx r JOIN s0 ON s0.o_custkey = r.o_custkey AND r.a <= s0.a AND s0.b <= r.b JOIN s1 ON s1.o_custkey = r.o_custkey AND s1.qb <= r.q + 1 GROUP BY ALL""")
def cells_2d(spark, d):
    """Cells of overlapping boxes with their depth: the canonical atoms of a two-dimensional monoid."""
    f = _boxes(spark, d)
    cells = f.atoms().df.groupBy(*f.keys, *f.bounds).agg(F.sum("value").alias("value"))
    return shown(f, df=cells)


@query(f"""WITH {SPANS_SQL}, x AS (SELECT o_custkey, a, b, list_sort(list(DISTINCT f)) AS value FROM (SELECT s.o_custkey, s.a, s.b, r.l_returnflag f FROM
(SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM (SELECT o_custkey, a c FROM spans UNION SELECT o_custkey, b FROM spans)) s JOIN spans r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b) GROUP BY ALL),
y AS (SELECT o_custkey, a, b, array_to_string(value, ',') v FROM x), {merged('y', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out""")
def multi_values(spark, d):
    """Sets of return flags valid at once."""
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"))
    m = Multi.from_single(IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, keys=["o_custkey"]))
    return shown(m).withColumn("value", F.array_join("value", ","))


@query(f"WITH {SPANS_SQL}, hit AS (SELECT o_custkey, a, b FROM spans WHERE l_returnflag = 'R'), {merged('hit', 'o_custkey')} SELECT o_custkey, a day_lo, b day_hi FROM out")
def multi_intervals_one(spark, d):
    """Where one element of the sets is valid."""
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"))
    m = Multi.from_single(IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, keys=["o_custkey"]))
    return shown(m.intervals_one("R"))


# --- relations ---
@query(f"""WITH {SPANS_SQL}, s AS (SELECT l_orderkey, l_linenumber, a, b FROM spans)
SELECT r AS relation, count(*) n FROM (SELECT CASE WHEN x.b = y.b AND x.a = y.a THEN 'EQ' WHEN y.a <= x.a AND x.b <= y.b THEN CASE WHEN x.a = y.a OR x.b = y.b THEN 'TPP' ELSE 'NTPP' END
WHEN x.a <= y.a AND y.b <= x.b THEN CASE WHEN x.a = y.a OR x.b = y.b THEN 'TPPi' ELSE 'NTPPi' END WHEN x.a < y.b AND y.a < x.b THEN 'PO' WHEN x.b = y.a OR y.b = x.a THEN 'EC' ELSE 'DC' END r
FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber) GROUP BY 1""")
def rcc8_matrix(spark, d):
    """RCC-8 relations of the spans of an order's lines."""
    s = spans(spark, d).select("l_orderkey", "l_linenumber", "ordered", "shipped")
    x, y = (s.select(*[F.col(c).alias(f"{p}_{c}") for c in s.columns]) for p in "xy")
    pairs = x.join(y, (F.col("x_l_orderkey") == F.col("y_l_orderkey")) & (F.col("x_l_linenumber") < F.col("y_l_linenumber")))
    box = lambda p: [C.Span(DAY, F.col(f"{p}_ordered"), F.col(f"{p}_shipped"))]
    return pairs.groupBy(C.relation(box("x"), box("y")).alias("relation")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand, p_size s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) i FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT p_brand, CAST(min(s) AS BIGINT) size_lo, CAST(max(s) + 1 AS BIGINT) size_hi, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY p_brand, s - i""")
def components_1d(spark, d):
    """Connected parts of the sizes of each brand, with the number of sizes in each."""
    size = Dim("size")
    rows = read(spark, d, "part").select("p_brand", "p_size").distinct()
    cells = IntervalFrame.from_df(rows, {size: (F.col("p_size"), F.col("p_size"))}, (), ["p_brand"])
    parts = Shape(cells.df, [size], (), ["p_brand"]).components()
    return parts.groupBy("p_brand", "component").agg(F.min("size_lo").alias("size_lo"), F.max("size_hi").alias("size_hi"), F.count("*").alias("n")).drop("component")


# --- versions, functions, codecs, rules, examples ---
@query("""WITH v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) s, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END ver, o_orderkey k, o_orderpriority p FROM orders),
w AS (SELECT o_custkey, s, arg_max(p, ver * 1000000000 + k) v FROM v WHERE ver <= 2 GROUP BY ALL),
x AS (SELECT o_custkey, s, v, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) e, CASE WHEN lag(v) OVER (PARTITION BY o_custkey ORDER BY s) = v THEN 0 ELSE 1 END n FROM w),
y AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s) i FROM x) SELECT o_custkey, min(s) day_lo, CASE WHEN count(e) = count(*) THEN max(e) END day_hi, max(v) AS value FROM y GROUP BY o_custkey, i""")
def version_select(spark, d):
    """Single days written in two versions, laid out to the next write, at the current version."""
    orders = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("s"), "o_orderkey", "o_orderpriority")
    w = {1: "o_orderkey % 3 <> 0", 2: "o_orderkey % 3 = 0"}

    def rows(v: int) -> IntervalFrame:
        df = orders.filter(w[v]).groupBy("o_custkey", "s").agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))
        return IntervalFrame.from_df(df, {DAY: (F.col("s"), F.col("s"))}, keys=["o_custkey"])

    none = rows(1)
    state = Versioned.from_frame(none._with(none.df.limit(0)), now=0).increment(now=1).set_many(rows(1)).increment(now=2).set_many(rows(2))
    cells = state.selected()
    days = cells.df.select("o_custkey", F.explode(F.sequence("day_lo", F.date_sub("day_hi", 1))).alias("s"), "value")
    return shown(timeline(days, DAY, F.col("s"), F.col("value"), ["o_custkey"], [F.col("value")]))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 0.0 WHEN o_totalprice < 250000 THEN (o_totalprice - 100000) * 0.05 ELSE 7500 + (o_totalprice - 250000) * 0.08 END AS discount FROM orders")
def function_piecewise(spark, d):
    """A piecewise discount over order totals."""
    f = FunctionFrame.of(spark, [AMOUNT], [
        (interval(AMOUNT, BOTTOM, Open(100000)), lambda x: F.lit(0.0)), (interval(AMOUNT, 100000, Open(250000)), lambda x: (x - 100000) * 0.05),
        (interval(AMOUNT, 250000, TOP), lambda x: 7500 + (x - 250000) * 0.08),
    ])
    return f.evaluate(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "discount").drop("o_totalprice")


#: Progressive rates in per cent with the first and last unit that each holds for.
BRACKETS = [(1, 23200, 10), (23201, 94300, 12), (94301, 201050, 22), (201051, 383900, 24), (383901, 487450, 32), (487451, 731200, 35), (731201, None, 37)]
_VALUES = ", ".join(f"({a}, {b or 'NULL'}, {r})" for a, b, r in BRACKETS)


@query(f"SELECT o_orderkey, CAST(sum(r * (least(coalesce(b, i), i) - a + 1)) AS BIGINT) AS tax_cents FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) i FROM orders) JOIN (VALUES {_VALUES}) t(a, b, r) ON a <= i GROUP BY 1")
def tax_brackets(spark, d):
    """Progressive tax: the rate frame clipped by [1, income] per order, rate times measure."""
    income = Dim("income")
    rates = IntervalFrame.of(spark, [income], [(interval(income, a, TOP if b is None else b), r) for a, b, r in BRACKETS], ("bigint",), ("rate",))
    rows = read(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("i"))
    own = IntervalFrame.from_df(rows, {income: (1, F.col("i"))}, ("o_orderkey",))
    z = own.zip(IntervalFrame(F.broadcast(rates.df), rates.dims, rates.values))  # seven rows
    return z.measured("n").groupBy("o_orderkey").agg(F.sum(F.col("rate") * F.col("n")).cast("bigint").alias("tax_cents"))


@query(f"""WITH {line('o_orderpriority', 'p')}, t AS (SELECT o_custkey, greatest(lo, DATE '1998-01-01') a, least(coalesce(hi, DATE '1999-01-01'), DATE '1999-01-01') b, v FROM p WHERE lo < DATE '1999-01-01' AND coalesce(hi, DATE '9999-12-31') > DATE '1998-01-01'),
r(a, b, c) AS (VALUES (DATE '1995-01-01', DATE '1998-04-20', 100), (DATE '1998-04-20', DATE '9999-12-31', 120))
SELECT o_custkey, CAST(sum(c * (CASE WHEN left(v, 1) = '1' THEN 3 ELSE 2 END) * (least(t.b, r.b) - greatest(t.a, r.a))) AS BIGINT) AS bill FROM t JOIN r ON t.a < r.b AND r.a < t.b GROUP BY 1""")
def billing_run(spark, d):
    """Bills of a year: tier timeline x rate timeline, rate times days, urgent customers at one and a half."""
    import datetime as dt

    tiers = priority(spark, d).clip(interval(DAY, dt.date(1998, 1, 1), dt.date(1998, 12, 31)))
    rates = IntervalFrame.of(spark, [DAY], [(interval(DAY, dt.date(1995, 1, 1), dt.date(1998, 4, 19)), 100), (interval(DAY, dt.date(1998, 4, 20), TOP), 120)], ("bigint",), ("rate",))
    flat = IntervalFrame(tiers.df, tiers.dims, ("o_custkey", "value"))
    z = flat.zip(IntervalFrame(F.broadcast(rates.df), rates.dims, rates.values))  # two rows
    weight = F.when(F.substring("value", 1, 1) == "1", 3).otherwise(2)
    return z.measured("n").groupBy("o_custkey").agg(F.sum(F.col("rate") * weight * F.col("n")).cast("bigint").alias("bill"))


@query("SELECT CASE WHEN l_quantity > 40 AND l_returnflag = 'R' THEN 'large return' WHEN l_discount > 0.05 OR contains(l_linestatus, 'F') THEN 'cheap or final' ELSE 'plain' END AS class, count(*) n FROM lineitem GROUP BY 1")
def rules_classify(spark, d):
    """Lines as facts, classified by rules."""
    lines = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    facts = R.facts_from(lines, "id", l_quantity="double", l_discount="double", l_returnflag="string", l_linestatus="string")
    big = R.greater("l_quantity", 40.0) & R.equals("l_returnflag", "R")
    cheap = R.greater("l_discount", 0.05) | R.contains("l_linestatus", "F")
    return facts.groupBy(F.when(big(), "large return").when(cheap(), "cheap or final").otherwise("plain").alias("class")).agg(F.count("*").alias("n"))


@query(TIMELINE)
def json_roundtrip(spark, d):
    """The timeline as JSON texts, written to the shared folder and read back."""
    texts = stage(codec.to_json(priority(spark, d)), "json")
    return shown(codec.from_json(texts, [DAY], keys=("o_custkey",)))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_path_fold(spark, d):
    events = read(spark, d, "events")
    k = codec.fold_path(F.col("props"), "k", F.lit(0).cast("bigint"), lambda a, x: a + x, "bigint")
    return events.groupBy("event_type").agg(F.sum(k).alias("total"))


@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) q FROM lineitem GROUP BY 1), k AS (SELECT unnest([-1, 0, 1]) o),
x AS (SELECT a + CAST(o AS INTEGER) a, CAST(sum(q) AS BIGINT) v FROM s, k GROUP BY 1), y AS (SELECT a, a + 1 b, v FROM x), """ + merged("y", "v") + " SELECT a day_lo, b day_hi, v AS value FROM out")
def convolve_box(spark, d):
    """Daily quantity with a box kernel of three days."""
    daily = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("s")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    f = IntervalFrame.from_df(daily, {DAY: (F.col("s"), F.col("s"))})
    import datetime as dt

    base = dt.date(2000, 1, 1)
    out = f.convolved_in("day", [(interval(DAY, base - dt.timedelta(1), base + dt.timedelta(1)), 1.0)], base, 1)
    return shown(out).withColumn("value", F.col("value").cast("bigint"))


@query(_GRID + " SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count_if(urgent AND v IS NOT NULL) AS BIGINT) AS both_sides FROM cell")
def decompress_counts(spark, d):
    cells = priority(spark, d, "o_orderstatus")._cells_with(_late(spark, d))
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.expr("_a and _b")).alias("both_sides"))


from . import each, outcomes, space, worked  # noqa: E402  register the queries that take the operators one by one, those of many dimensions and large keys, and worked examples

__all__ = ["QUERIES", "SQL", "each", "outcomes", "space", "worked"]
