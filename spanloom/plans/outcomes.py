"""Queries whose results have both outcomes of a test, and tables of structures that were single ones: variables, approvals, relations, monoids; binary documents, paths into JSON, wide convolutions. With the same results in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.cuts import Dim, Open, interval
from ..operators.frame import IntervalFrame, Monoid, Shape
from ..operators.polynomials import PolynomialFrame, polynomial, term, value
from ..operators.versioned import UNAPPROVED, Variables, Versioned
from ..sources import bson, codec
from ..sources.staging import stage
from .catalogue import DAY, SEC, SESSIONS_SQL, TIMELINE, merged, priority, query, read, sessions, shown
from .space import X, Y

_DAY_NS = 86_400_000_000_000

# --- variables ---
_VARIABLES = f"""
c AS (SELECT o_custkey, o_orderstatus v, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * {_DAY_NS} AS clock, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i FROM orders),
t(o_custkey, i, v, s, n) AS (SELECT o_custkey, CAST(0 AS BIGINT), '-', CAST(NULL AS BIGINT), 0 FROM orders GROUP BY 1
  UNION ALL SELECT t.o_custkey, c.i, c.v, CASE WHEN c.v = t.v THEN t.s WHEN t.s IS NULL OR c.clock > t.s THEN c.clock ELSE t.s + 10 END, CAST(c.v <> t.v AS INTEGER) FROM t JOIN c ON c.o_custkey = t.o_custkey AND c.i = t.i + 1),
h AS (SELECT o_custkey, v, s, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC) r FROM t WHERE n = 1)"""


@query(f"""WITH RECURSIVE {_VARIABLES}, every AS (SELECT DISTINCT o_custkey FROM orders)
SELECT e.o_custkey, coalesce(a.v, '-') AS now, a.s AS changed, coalesce(b.v, CASE WHEN a.v IS NOT NULL THEN '-' END) AS prior, coalesce(b.v, '-') AS undone, CAST(1 + (SELECT count(*) FROM h WHERE h.o_custkey = e.o_custkey) AS BIGINT) AS n,
coalesce((SELECT v FROM h WHERE h.o_custkey = e.o_custkey AND s <= 10000 * {_DAY_NS} ORDER BY s DESC LIMIT 1), '-') AS early
FROM every e LEFT JOIN h a ON a.o_custkey = e.o_custkey AND a.r = 1 LEFT JOIN h b ON b.o_custkey = e.o_custkey AND b.r = 2""")
def variables(spark, d):
    """Variable by customer: set, unset, get, getPrior, getAt, lastChange, history, times made unique."""
    orders = read(spark, d, "orders")
    v = Variables.from_changes(orders, ["o_custkey"], time=F.datediff(F.col("o_orderdate").cast("date"), F.lit(dt.date(1970, 1, 1))).cast("bigint") * _DAY_NS, value=F.col("o_orderstatus"), order=[F.col("o_orderkey")], initial="-")
    n = v.frame.df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = v.get().withColumnRenamed("value", "now").join(v.last_changes(), "o_custkey").join(v.unset().get().withColumnRenamed("value", "undone"), "o_custkey").join(n, "o_custkey")
    return out.join(v.get_at(10_000 * _DAY_NS).withColumnRenamed("value", "early"), "o_custkey")


@query(f"WITH RECURSIVE {_VARIABLES} SELECT DISTINCT e.o_custkey, coalesce(a.v, '-') AS value FROM orders e LEFT JOIN h a ON a.o_custkey = e.o_custkey AND a.r = 1")
def variables_reset(spark, d):
    """Variable by customer: reset, fromHistory: the present value, everywhere."""
    orders = read(spark, d, "orders")
    v = Variables.from_changes(orders, ["o_custkey"], time=F.datediff(F.col("o_orderdate").cast("date"), F.lit(dt.date(1970, 1, 1))).cast("bigint") * _DAY_NS, value=F.col("o_orderstatus"), order=[F.col("o_orderkey")], initial="-")
    return Variables(v.reset().frame).get_at(0)


# --- monoids ---
@query(f"""WITH {SESSIONS_SQL}, g AS (SELECT user_id, a, b, lag(b) OVER (PARTITION BY user_id ORDER BY a) p, lead(a) OVER (PARTITION BY user_id ORDER BY a) x FROM ses)
SELECT user_id, a AS sec_lo, b AS sec_hi, 5 AS value FROM g UNION ALL SELECT user_id, p, a, 0 FROM g UNION ALL SELECT user_id, b, NULL, 0 FROM g WHERE x IS NULL""")
def monoid_everywhere(spark, d):
    """withMonoidValue, universe, union and intersection of monoids: 5 in a session, the identity elsewhere."""
    s = sessions(spark, d)
    five = s.with_monoid_value(5)
    whole = Monoid.universe(spark, [SEC], 0, "int", of=s.df.select("user_id"))
    both = five.intersection(whole, lambda a, b: a + b)  # as five, as the universe has the identity everywhere
    return shown(IntervalFrame(whole.union(both).df, whole.dims, ("value",), whole.keys)).withColumn("value", F.col("value").cast("int"))


# --- relations of regions ---
@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'EQ' WHEN 1 THEN 'EC' WHEN 2 THEN 'DC' WHEN 3 THEN 'PO' WHEN 4 THEN 'TPP' WHEN 5 THEN 'NTPP' WHEN 6 THEN 'TPPi' ELSE 'NTPPi' END AS relation FROM customer""")
def relations_2d(spark, d):
    """relationWith, touches and isConnectedTo of two regions a customer, in two dimensions: all eight relations."""
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 20).cast("bigint").alias("x"), F.floor("c_acctbal").cast("bigint").alias("y"), (F.col("c_custkey") % 8).alias("kind"))
    x, y, kind = F.col("x"), F.col("y"), F.col("kind")

    def region(a, b, p, q):
        # two boxes side by side, so that no relation is that of one row alone
        half = F.floor((a + b) / 2).cast("bigint")
        made = c.select("c_custkey", F.explode(F.array(*[F.struct(s.alias("a"), e.alias("b"), p.alias("p"), q.alias("q")) for s, e in ((a, half), (half, b))])).alias("r")).select("c_custkey", "r.*")
        f = IntervalFrame.from_df(made, {X: (F.col("a"), F.col("b") - 1), Y: (F.col("p"), F.col("q") - 1)}, (), ["c_custkey"])
        return Shape(f.df, f.dims, (), f.keys)

    base = region(x, x + 8, y, y + 8)
    move = F.when(kind == 1, 8).when(kind == 2, 9).when(kind == 3, 4).otherwise(0)
    grow = F.when(kind.isin(4, 5), 3).when(kind.isin(6, 7), -2).otherwise(0)
    near = F.when(kind == 5, 3).when(kind == 7, -2).otherwise(0)  # the sides that grow or shrink too
    other = region(x + move - near, x + 8 + move + grow, y - near, y + 8 + grow)
    return base.relations(other)


# --- approvals ---
_APPROVED = """
f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) a FROM orders GROUP BY 1)"""


@query(f"""WITH {_APPROVED} SELECT o_custkey, a AS day_lo, CASE WHEN o_custkey % 3 = 0 THEN a + 5 ELSE a + 20 END AS day_hi, 'now' AS value FROM f
UNION ALL SELECT o_custkey, a + 5, a + 10, 'next' FROM f WHERE o_custkey % 3 = 0 UNION ALL SELECT o_custkey, a + 10, a + 20, 'now' FROM f WHERE o_custkey % 3 = 0""")
def approve_by_rows(spark, d):
    """approve: what is asked for becomes current where it is exactly what waits; elsewhere (another end, another value) nothing changes."""
    first = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    at = lambda value, b, e: IntervalFrame.from_df(first.withColumn("value", value), {DAY: (F.date_add("a", b), Open(F.date_add("a", e)))}, keys=["o_custkey"])
    v = Versioned.from_frame(at(F.lit("now"), 0, 20), now=0).set_many(at(F.lit("next"), 5, 10), selection=UNAPPROVED)
    kind = F.col("o_custkey") % 3
    asked = IntervalFrame.from_df(first.withColumn("value", F.when(kind == 1, "other").otherwise("next")).withColumn("e", F.date_add("a", F.when(kind == 2, 11).otherwise(10))), {DAY: (F.date_add("a", 5), Open(F.col("e")))}, keys=["o_custkey"])
    return shown(v.approve_rows(asked).selected())


@query(f"""WITH {_APPROVED} SELECT o_custkey, a AS day_lo, a + 5 AS day_hi, 'left' AS value, '-' AS value_2 FROM f UNION ALL SELECT o_custkey, a + 5, a + 10, 'left', 'right' FROM f UNION ALL SELECT o_custkey, a + 10, a + 15, '+', 'right' FROM f""")
def versions_apart_zipped(spark, d):
    """zipAll of two different version histories at their current version; merge keeps the left where both hold."""
    first = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    at = lambda value, b, e: IntervalFrame.from_df(first.withColumn("value", F.lit(value)), {DAY: (F.date_add("a", b), Open(F.date_add("a", e)))}, keys=["o_custkey"])
    left = Versioned.from_frame(at("old", 0, 10), now=0).increment(now=1).set_many(at("left", 0, 10))
    right = Versioned.from_frame(at("right", 5, 15), now=0).increment(now=2)
    z = left.zip_all(right, {"value": "+"}, {"value": "-"}).selected()
    return shown(z.coalesce())


@query(f"WITH {_APPROVED} SELECT o_custkey, a AS day_lo, a + 10 AS day_hi, 'left' AS value, CAST(2 AS BIGINT) AS time FROM f UNION ALL SELECT o_custkey, a + 10, a + 15, 'right', 2 FROM f")
def versions_apart_merged(spark, d):
    """merge of two different version histories: the later time of a version stays."""
    first = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    at = lambda value, b, e: IntervalFrame.from_df(first.withColumn("value", F.lit(value)), {DAY: (F.date_add("a", b), Open(F.date_add("a", e)))}, keys=["o_custkey"])
    left = Versioned.from_frame(at("old", 0, 10), now=0).increment(now=1).set_many(at("left", 0, 10))
    right = Versioned.from_frame(at("right", 5, 15), now=0).increment(now=2)
    m = left.merge(right)
    return shown(m.selected()).withColumn("time", F.lit(dict((v, t) for v, t, _ in m.log)[1]).cast("bigint"))


# --- documents ---
@query(TIMELINE)
def bson_roundtrip(spark, d):
    """Rows as binary documents and back: dates stay dates, unbounded ends unbounded."""
    f = priority(spark, d)
    return shown(bson.from_bson(bson.to_bson(f), f))


@query("""SELECT conv_id, CAST(count(*) FILTER (role = 'user' AND turn BETWEEN 1 AND 3) AS BIGINT) AS asked, CAST(coalesce(sum(turn * 10 + length(role)) FILTER (turn >= 1), 0) AS BIGINT) AS total FROM conversations GROUP BY 1""")
def json_nested_paths(spark, d):
    """Folds over nested [*] and slices of one parsed text: a conversation as one document, its turns from the second on."""
    rows = read(spark, d, "conversations").filter("conv_id is not null").select("conv_id", "turn", F.struct("turn", "role", F.array(F.struct((F.col("turn") * 10).alias("n")), F.struct(F.length("role").alias("n"))).alias("parts")).alias("r"))
    last = rows.agg(F.max("turn")).first()[0] or 0
    turns = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("int"), "r"))).alias("m"))
    docs = turns.select("conv_id", F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(int(last))), lambda i: F.element_at("m", i)).alias("turns")), {"ignoreNullFields": "false"}).alias("doc"))
    asked = codec.fold_path(F.col("doc"), "turns[1:4]/role", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x == "user", 1).otherwise(0))
    total = codec.fold_path(F.col("doc"), "turns[1:]/parts[*]/n", F.lit(0).cast("bigint"), lambda a, x: a + x, "bigint")
    return docs.select("conv_id", asked.alias("asked"), total.alias("total"))


# --- wide kernels ---
@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) q FROM lineitem GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series((SELECT min(a) - INTERVAL 5000 DAY FROM s), (SELECT max(a) + INTERVAL 5000 DAY FROM s), INTERVAL 1 DAY)) AS DATE) t),
x AS (SELECT t a, CAST(sum(q) AS BIGINT) v FROM days JOIN s ON s.a BETWEEN t - INTERVAL 5000 DAY AND t + INTERVAL 4999 DAY GROUP BY 1), y AS (SELECT a, a + 1 b, v FROM x), """ + merged("y", "v") + " SELECT a day_lo, b day_hi, v AS value FROM out")
def convolve_wide(spark, d):
    """Daily quantity with a box kernel of 10,000 days: four events a row, whatever the kernel's width."""
    daily = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("s")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    f = IntervalFrame.from_df(daily, {DAY: (F.col("s"), F.col("s"))})
    base = dt.date(2000, 1, 1)
    return shown(f.convolved_running("day", [(interval(DAY, base - dt.timedelta(5000), base + dt.timedelta(4999)), 1)], base))


# --- functions as data ---
_T, _U = Dim("t", "double", "continuous"), Dim("u", "double", "continuous")
_PIECES_SQL = """
ln AS (SELECT o_custkey k, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS DOUBLE) a, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS DOUBLE) b, l_quantity q, round(l_discount * 100) c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE)),
cu AS (SELECT k, a t FROM ln UNION SELECT k, b FROM ln), se AS (SELECT k, t a, lead(t) OVER (PARTITION BY k ORDER BY t) b FROM cu),
ce AS (SELECT se.k, se.a, se.b, sum(q) c0, sum(c * q * q / 2) c1 FROM se JOIN ln ON ln.k = se.k AND ln.a <= se.a AND se.b <= ln.b GROUP BY ALL)"""


def _price(spark, d) -> PolynomialFrame:
    """A function of time and amount for each line: 1 + c * t * u over the line's days and 0 to its quantity."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit(dt.date(1970, 1, 1))).alias("a"))
    lines = read(spark, d, "lineitem").withColumn("b", F.datediff(F.col("l_shipdate").cast("date"), F.lit(dt.date(1970, 1, 1)))).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("b > a")
    rows = lines.select("o_custkey", F.col("a").cast("double"), F.col("b").cast("double"), F.col("l_quantity").alias("q"), polynomial(term(F.lit(1.0), 0, 0), term(F.round(F.col("l_discount") * 100), 1, 1)).alias("value"))
    return PolynomialFrame(IntervalFrame.from_df(rows, {_T: (F.col("a"), Open(F.col("b"))), _U: (F.lit(0.0), Open(F.col("q")))}, keys=["o_custkey"]))


@query(f"WITH {_PIECES_SQL}, {merged('ce', 'k', value=', c0, c1')} SELECT k AS o_custkey, a AS t_from, b AS t_to, c0, c1 FROM out")
def function_collapse(spark, d):
    """collapseDimension of functions: the amount integrated away, pieces over one another added, as polynomials in time."""
    f = _price(spark, d).collapse("u").frame
    at = lambda x: value(F.col("value"), F.lit(x))
    return f.df.select("o_custkey", F.col("t_lo.v").alias("t_from"), F.col("t_hi.v").alias("t_to"), at(0.0).alias("c0"), (at(1.0) - at(0.0)).alias("c1"))


@query(f"WITH {_PIECES_SQL}, {merged('ce', 'k', value=', c0, c1')} SELECT k AS o_custkey, CAST(count(*) AS BIGINT) AS n, sum(c0 + 3 * c1) AS total, CAST(count(*) FILTER (c1 <> 0) AS BIGINT) AS changed FROM out GROUP BY 1")
def function_documents(spark, d):
    """Functions through JSON and back, and the actions that turn every slope round: equal pieces are equal values, so level ones need none."""
    f = _price(spark, d).collapse("u")
    f = f._do(f.frame._with(stage(f.frame.df, "functions")))  # read three times
    back = PolynomialFrame.from_json(f.to_json(), f)
    # with the slope turned round, only level pieces stay as they are
    turned = f._do(f.frame._with(f.frame.df.withColumn("value", F.transform("value", lambda t: F.struct(t["p"].alias("p"), F.when(F.get(t["p"], F.lit(0)) == 1, -t["c"]).otherwise(t["c"]).alias("c"))))))
    acts = turned.diff_actions_from(back).groupBy("o_custkey").agg(F.count("*").alias("changed"))
    sums = back.frame.df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(value(F.col("value"), F.lit(3.0))).alias("total"))
    return sums.join(acts, "o_custkey", "left").select("o_custkey", "n", "total", F.coalesce("changed", F.lit(0)).alias("changed"))
