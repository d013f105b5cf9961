"""Worked examples: billing runs with what was known at each, the progress of patients by rules, the plan of a product's features. With the same results in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.cuts import TOP, Dim, interval
from ..operators.cycles import Cycle, as_known, transactions
from ..operators.frame import IntervalFrame, Multi, timeline
from .catalogue import DAY, merged, query, read, shown
from .space import _runs

# --- billing ---
#: Run at the fifteenth for what lasts to the end of the next month; the first stands for what is settled.
CYCLES = [Cycle(n, dt.date(1998, n + 1, 15), dt.date(1998, n + 3, 1)) for n in range(5)]
_OPEN_DAY = dt.date(1995, 1, 1)
#: Daily rates in cents: from the first day, and from a change in the middle of a cycle on.
RATES = {"1": (150, 165), "2": (120, 120), "3": (100, 110), "4": (80, 75), "5": (50, 60)}
RATES_CHANGE = dt.date(1998, 4, 20)


def _tiers(spark, d) -> IntervalFrame:
    """Each customer's tier from an order's day on, known up to 30 days before or after it."""
    day = F.col("o_orderdate").cast("date")
    known = F.date_add(day, (F.col("o_orderkey") % 61 - 30).cast("int"))
    return as_known(read(spark, d, "orders"), DAY, day, F.substring("o_orderpriority", 1, 1), known, ["o_custkey"], [F.col("o_orderkey")], CYCLES)


_TIERS = f"""
cyc(k, run, upto) AS (VALUES {', '.join(f"({c.number}, DATE '{c.run}', DATE '{c.upto}')" for c in CYCLES)}),
rates(v, ra, rb, rate) AS (VALUES {', '.join(f"('{t}', DATE '{_OPEN_DAY}', DATE '{RATES_CHANGE}', {x}), ('{t}', DATE '{RATES_CHANGE}', DATE '9999-12-31', {y})" for t, (x, y) in RATES.items())}),
kn AS (SELECT o_custkey, k, upto, CAST(o_orderdate AS DATE) s, left(arg_max(o_orderpriority, o_orderkey), 1) v FROM orders, cyc
  WHERE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 30 AS INTEGER) <= run AND CAST(o_orderdate AS DATE) < upto GROUP BY ALL),
st AS (SELECT *, lead(s, 1, upto) OVER (PARTITION BY o_custkey, k ORDER BY s) e, CASE WHEN lag(v) OVER (PARTITION BY o_custkey, k ORDER BY s) = v THEN 0 ELSE 1 END n FROM kn),
il AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey, k ORDER BY s) i FROM st),
now AS (SELECT o_custkey, k, min(s) a, max(e) b, max(v) v FROM il GROUP BY o_custkey, k, i),
bo AS (SELECT coalesce(n.o_custkey, o.o_custkey) o_custkey, coalesce(n.k, o.k + 1) k, n.a na, n.b nb, n.v nv, o.a oa, o.b ob, o.v ov
  FROM now n FULL OUTER JOIN now o ON n.o_custkey = o.o_custkey AND n.k = o.k + 1 AND n.a = o.a),
sg AS (SELECT o_custkey, k, 1 g, na a, nb b, nv v FROM bo WHERE ov IS NULL OR nv <> ov UNION ALL SELECT o_custkey, k, -1, oa, ob, ov FROM bo WHERE nv IS NULL OR nv <> ov
  UNION ALL SELECT o_custkey, k, 1, ob, nb, nv FROM bo WHERE nv = ov AND nb > ob UNION ALL SELECT o_custkey, k, -1, nb, ob, ov FROM bo WHERE nv = ov AND nb < ob),
tx AS (SELECT o_custkey, k, sg.v, greatest(a, ra) a, least(b, rb) b, CAST(g * rate * (least(b, rb) - greatest(a, ra)) AS BIGINT) amount FROM sg JOIN rates ON sg.v = rates.v AND a < rb AND ra < b WHERE k BETWEEN 1 AND {CYCLES[-1].number})"""


def _billed(spark, d):
    rows = [([interval(DAY, a, b)], t, r) for t, (x, y) in RATES.items() for a, b, r in ((_OPEN_DAY, RATES_CHANGE - dt.timedelta(1), x), (RATES_CHANGE, TOP, y))]
    rates = IntervalFrame.of(spark, [DAY], rows, ("string", "bigint"), ("tier", "rate"))
    keyed = IntervalFrame(F.broadcast(rates.df), rates.dims, ("rate",), ("tier",))  # ten rows
    return transactions(_tiers(spark, d), CYCLES, keyed).withColumn("amount", F.col("amount").cast("bigint"))


@query(f"WITH {_TIERS} SELECT o_custkey, k AS cycle, v AS value, a AS day_lo, b AS day_hi, amount FROM tx")
def billing_transactions(spark, d):
    """Bills and refunds of four cycles run over time: tiers become known before and after they hold, so later cycles correct earlier ones."""
    return _billed(spark, d)


@query(f"""WITH {_TIERS}, due AS (SELECT o_custkey, CAST(sum(rate * (least(b, rb) - greatest(a, ra)) * CASE WHEN k = 0 THEN -1 ELSE 1 END) AS BIGINT) balance
  FROM now JOIN rates ON now.v = rates.v AND a < rb AND ra < b WHERE k IN (0, {CYCLES[-1].number}) GROUP BY 1)
SELECT due.o_custkey, balance, CAST(count(*) FILTER (amount > 0) AS BIGINT) bills, CAST(count(*) FILTER (amount < 0) AS BIGINT) refunds FROM due JOIN tx ON due.o_custkey = tx.o_custkey GROUP BY ALL""")
def billing_balances(spark, d):
    """What the cycles come to for each customer; the SQL takes it from what the last and the first know, without the cycles in between."""
    tx = _billed(spark, d)
    return tx.groupBy("o_custkey").agg(F.sum("amount").cast("bigint").alias("balance"), F.count_if(F.col("amount") > 0).alias("bills"), F.count_if(F.col("amount") < 0).alias("refunds"))


# --- clinical facts ---
_AGES = ((18, "under 18"), (25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
_PRESSURES = ((180.0, 120.0, "crisis"), (140.0, 90.0, "stage2"), (130.0, 80.0, "stage1"))


def _patients(spark, d):
    """A fact for each user and day with events: readings of that day, a date of birth and a group that changes after ten days."""
    e = read(spark, d, "events").filter("user_id is not null").groupBy("user_id", F.col("ts").cast("date").alias("recorded")).agg(F.max("value").alias("systolic"), (F.min("value") + 60).alias("diastolic"))
    first = e.groupBy("user_id").agg(F.min("recorded").alias("first"))
    rows = e.join(first, "user_id").select(
        "user_id", "recorded", "systolic", "diastolic", F.date_sub(F.lit(dt.date(2024, 1, 16)), (F.col("user_id") % 80 * 365 + F.floor(F.col("user_id") % 80 / 4)).cast("int")).alias("birthdate"),
        F.element_at(F.array(F.lit("F"), F.lit("M"), F.lit("Other")), (F.col("user_id") % 3 + 1).cast("int")).alias("gender"), F.when(F.datediff("recorded", "first") < 10, 1).otherwise(2).alias("trialGroup"),
    )
    return R.facts_from(rows, "user_id", recorded="date", systolic="double", diastolic="double", birthdate="date", gender="string", trialGroup="int")


def _judged(facts):
    """Categories of pressure and age, the first that applies; then only these, the gender and the group are left."""
    by = "when_absent"
    steps = [R.augment(R.greater("systolic", s) | R.greater("diastolic", p), R.attributes(bloodPressureCategory=c, hypertension=True), by) for s, p, c in _PRESSURES]
    steps += [R.augment(R.greater("systolic", 120.0), R.attributes(bloodPressureCategory="elevated", hypertension=False), by), R.augment(R.ANYTHING, R.attributes(bloodPressureCategory="normal", hypertension=False), by)]
    # whoever is younger than n years on the day of the record
    young = lambda n: R.greater("birthdate", R.Own("recorded", "date", lambda day: F.add_months(day, -12 * n)))
    steps += [R.augment(young(n), R.attributes(ageBracket=name, minor=n == 18), by) for n, name in _AGES]
    steps += [R.augment(R.ANYTHING, R.attributes(ageBracket="65 and over", minor=False), by), R.redact(R.ANYTHING, ["systolic", "diastolic", "birthdate"])]
    return R.chain(*steps)(facts)


_AGE_SQL = " ".join(f"WHEN born > r - INTERVAL {n} YEAR THEN '{name}'" for n, name in _AGES)
_PRESSURE_SQL = " ".join(f"WHEN sy > {s} OR di > {p} THEN '{c}'" for s, p, c in _PRESSURES)


@query(f"""WITH e AS (SELECT user_id u, CAST(ts AS DATE) r, max(value) sy, min(value) + 60 di FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, DATE '2024-01-16' - CAST(u % 80 * 365 + floor(u % 80 / 4) AS INTEGER) born, CASE WHEN r - min(r) OVER (PARTITION BY u) < 10 THEN '1' ELSE '2' END grp FROM e),
j AS (SELECT *, CASE {_AGE_SQL} ELSE '65 and over' END age, CASE {_PRESSURE_SQL} WHEN sy > 120 THEN 'elevated' ELSE 'normal' END bp FROM p),
v AS (SELECT u, r, unnest([{{'n': 'gender', 'v': CASE u % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Other' END}}, {{'n': 'trialGroup', 'v': grp}}, {{'n': 'ageBracket', 'v': age}}, {{'n': 'minor', 'v': CAST(age = 'under 18' AS VARCHAR)}},
  {{'n': 'bloodPressureCategory', 'v': bp}}, {{'n': 'hypertension', 'v': CAST(bp NOT IN ('elevated', 'normal') AS VARCHAR)}}]) x FROM j),
s AS (SELECT u, x.n n, r a, x.v v, lead(r) OVER (PARTITION BY u, x.n ORDER BY r) b, CASE WHEN lag(x.v) OVER (PARTITION BY u, x.n ORDER BY r) = x.v THEN 0 ELSE 1 END w FROM v),
i AS (SELECT *, sum(w) OVER (PARTITION BY u, n ORDER BY a) g FROM s)
SELECT CAST(u AS VARCHAR) AS id, n AS name, min(a) AS day_lo, CASE WHEN count(b) = count(*) THEN max(b) END AS day_hi, max(v) AS value FROM i GROUP BY u, n, g""")
def clinical_progress(spark, d):
    """Records of many test days as facts, judged by rules that compare attributes with one another, redacted, and kept as a timeline of each attribute of each patient."""
    rows = R.progress(_judged(_patients(spark, d)), "recorded")
    return shown(timeline(rows, DAY, F.col("at"), F.col("value"), ["id", "name"], [F.col("value")]))


# --- features ---
RELEASE = Dim("release")
_PLANNED = dt.date(1998, 6, 1)


@query(f"""WITH w AS (SELECT o_custkey, o_orderkey k, left(o_orderpriority, 1) f, o_orderstatus <> 'F' AS put, CAST(o_orderdate AS DATE) + 30 a, o_orderkey % 5 + 1 ra FROM orders
  WHERE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 91 AS INTEGER) <= DATE '{_PLANNED}'),
c AS (SELECT o_custkey, a c FROM w UNION SELECT o_custkey, DATE '9999-12-31' FROM w), sd AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM c),
sr AS (SELECT o_custkey, unnest([1, 2, 3, 4, 5]) ra FROM w GROUP BY 1), g AS (SELECT sd.o_custkey, a, b, ra FROM sd JOIN sr ON sd.o_custkey = sr.o_custkey WHERE b IS NOT NULL),
m AS (SELECT g.o_custkey, g.a, g.b, g.ra qa, w.f, arg_max(w.put, w.k) put FROM g JOIN w ON g.o_custkey = w.o_custkey AND w.a <= g.a AND w.ra <= g.ra GROUP BY ALL),
cell AS (SELECT o_custkey, a, b, qa, CASE WHEN qa < 5 THEN qa + 1 ELSE 99 END qb, array_to_string(list_sort(list(f)), ',') v FROM m WHERE put GROUP BY ALL), {_runs((("d", "a", "b"), ("q", "qa", "qb")), "v")}
SELECT o_custkey, a AS day_lo, CASE WHEN b < DATE '9999-12-31' THEN b END AS day_hi, CAST(qa AS BIGINT) AS release_lo, CAST(CASE WHEN qb < 99 THEN qb END AS BIGINT) AS release_hi, v AS value FROM rq""")
def feature_plan(spark, d):
    """A plan over days of planning, days in effect and releases: features are added and taken out in order, each from a release on; what is planned at a day, with the sets of features."""
    planned, day = Dim("planned", "date"), F.col("o_orderdate").cast("date")
    rows = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).alias("value"), (F.col("o_orderstatus") != "F").alias("put"), F.date_add(day, 30).alias("a"), F.date_add(day, (F.col("o_orderkey") % 91).cast("int")).alias("p"), (F.col("o_orderkey") % 5 + 1).alias("r"))
    w = IntervalFrame.from_df(rows, {planned: (F.col("p"), TOP), DAY: (F.col("a"), TOP), RELEASE: (F.col("r"), TOP)}, ("value", "put", "seq"), ("o_custkey",))
    # a slice of writes is the writes of the slice: cut first, two dimensions are left
    at = w._with(w.df.filter(planned.covers(F.col("planned_lo"), F.col("planned_hi"), _PLANNED)), dims=(DAY, RELEASE))
    plan = Multi.from_writes(IntervalFrame(at.df, at.dims, ("value",), at.keys).carrying(at.df), F.col("put"), F.col("seq"))
    return shown(plan).withColumn("value", F.array_join("value", ","))


@query(f"""WITH w AS (SELECT o_custkey, o_orderkey k, left(o_orderpriority, 1) v, CAST(o_orderdate AS DATE) a, CAST(o_orderdate AS DATE) + 90 b, o_orderkey % 5 + 1 r FROM orders),
c AS (SELECT o_custkey, v, a c FROM w UNION SELECT o_custkey, v, b FROM w), s AS (SELECT o_custkey, v, c a, lead(c) OVER (PARTITION BY o_custkey, v ORDER BY c) b FROM c),
cell AS (SELECT DISTINCT s.o_custkey, s.v, s.a, s.b FROM s JOIN w ON w.o_custkey = s.o_custkey AND w.v = s.v AND w.a <= s.a AND s.b <= w.b AND w.r <= 3), {merged('cell', 'o_custkey', value=', v')}
SELECT o_custkey, v AS value, a AS day_lo, b AS day_hi FROM out""")
def feature_when_live(spark, d):
    """When each feature is live in the third release: deployments of ninety days from a release on, sliced at it, and the days of each value looked up the other way round."""
    day = F.col("o_orderdate").cast("date")
    rows = read(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("value"), day.alias("a"), (F.col("o_orderkey") % 5 + 1).alias("r"))
    f = IntervalFrame.from_df(rows, {DAY: (F.col("a"), F.date_add("a", 89)), RELEASE: (F.col("r"), TOP)}, keys=["o_custkey"])
    live = Multi.from_single(f).slice_at("release", 3)
    return shown(live.single()).select("o_custkey", "value", "day_lo", "day_hi")
