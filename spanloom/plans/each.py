"""Queries that take the operators one by one, with the same results in DuckDB's SQL: interval algebra on Columns, look-ups, writes, row-by-row operators, regions, sets and monoids, versions, functions, codecs, rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cuts as C
from ..functions import rules as R
from ..functions.cuts import BOTTOM, TOP, Dim, Open, Probe, Span, interval
from ..operators.frame import IntervalFrame, Monoid, Multi, Shape
from ..operators.piecewise import FunctionFrame
from ..operators.versioned import UNAPPROVED, Variable, Versioned
from ..sources import codec
from .catalogue import _GRID, AMOUNT, DAY, SEC, SESSIONS_SQL, SPANS_SQL, _late, line, merged, open_orders, priority, query, read, sessions, shown, spans

B1, B2 = dt.date(1998, 1, 1), dt.date(1998, 6, 30)
BOX = interval(DAY, B1, B2)
END = "DATE '9999-12-31'"
IN, OUT = "DATE '1998-01-01'", "DATE '1998-07-01'"
STATUS = f"WITH {line('o_orderstatus', 's')}, st AS (SELECT o_custkey, lo a, coalesce(hi, {END}) b, v FROM s)"
SHOW = f"SELECT o_custkey, a day_lo, CASE WHEN b < {END} THEN b END day_hi, v AS value FROM"
OUTSIDE = f"SELECT o_custkey, a, least(b, {IN}) b, v FROM st WHERE a < {IN} UNION ALL SELECT o_custkey, greatest(a, {OUT}), b, v FROM st WHERE b > {OUT}"


def status(spark, d) -> IntervalFrame:
    return priority(spark, d, "o_orderstatus")


def one_row(spark, **values) -> DataFrame:
    """Results that are no tables, as one row."""
    kinds = {bool: "boolean", int: "bigint", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# --- intervals, two a row: x from an order's day on, y about it ---
PAIRS_SQL = """p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) xa, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 1 AS INTEGER) xb,
CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 - 30 AS INTEGER) ya, CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 - 30 + o_custkey % 25 + 1 AS INTEGER) yb FROM orders)"""
INT_SQL = "p AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS BIGINT) xa, CAST(o_orderkey % 40 + o_custkey % 9 + 1 AS BIGINT) xb FROM orders)"


def pairs(spark, d) -> tuple[DataFrame, Span, Span]:
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    plus = lambda c: F.date_add("day", c.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = interval(DAY, F.col("day"), plus(k % 40)), interval(DAY, plus(c % 60 - 30), plus(c % 60 - 30 + c % 25))
    df = o.select("o_orderkey", x.lo.alias("xa"), x.hi.alias("xb"), y.lo.alias("ya"), y.hi.alias("yb"))
    return df, Span(DAY, F.col("xa"), F.col("xb")), Span(DAY, F.col("ya"), F.col("yb"))


@query(f"""WITH {PAIRS_SQL} SELECT o_orderkey, xa < yb AND ya < xb AS hit, xb = ya OR yb = xa AS touching, xb = ya AS left_of, xb = ya OR yb = xa AS beside, xa <= yb AND ya <= xb AS connected,
xa <= ya AND yb <= xb AS holds, xa = ya AND xb = yb AS equal, xa < yb AND ya < xb AND (xa = ya OR xb = yb OR xb = ya + 1 OR yb = xa + 1) AS shared, xa = ya AS same_start, xb = yb AS same_end,
xa > ya AS after_start, xa >= ya AS from_start, xb < yb AS before_end, xb <= yb AS to_end FROM p""")
def interval_tests(spark, d):
    """intersects, touches, adjacency, connection, containment, equality, shared boundaries, starts and ends."""
    df, x, y = pairs(spark, d)
    a, b = [x], [y]
    tests = {
        "hit": C.intersects(a, b), "touching": C.touches(a, b), "left_of": C.left_adjacent(a, b), "beside": C.adjacent(a, b), "connected": C.connected(a, b), "holds": C.contains(a, b),
        "equal": C.equivalent(a, b), "shared": C.shares_boundary(a, b), "same_start": C.has_same_start(a, b), "same_end": C.has_same_end(a, b), "after_start": C.after_start(x, y),
        "from_start": C.after_or_at_start(x, y), "before_end": C.before_end(x, y), "to_end": C.before_or_at_end(x, y),
    }
    return df.select("o_orderkey", *[t.alias(n) for n, t in tests.items()])


@query(f"""WITH {PAIRS_SQL} SELECT o_orderkey, CASE WHEN xa < yb AND ya < xb THEN greatest(xa, ya) END AS meet_lo, CASE WHEN xa < yb AND ya < xb THEN least(xb, yb) END AS meet_hi, least(xa, ya) AS hull_lo, greatest(xb, yb) AS hull_hi,
CASE WHEN least(xb, yb) < greatest(xa, ya) THEN least(xb, yb) END AS gap_lo, CASE WHEN least(xb, yb) < greatest(xa, ya) THEN greatest(xa, ya) END AS gap_hi,
CAST((xa < least(xb, ya)) AS INTEGER) + CAST((greatest(xa, yb) < xb) AS INTEGER) AS n_left, CAST((xa < least(xb, ya)) AS INTEGER) + CAST((greatest(xa, yb) < xb) AS INTEGER) + CAST((greatest(xa, ya) < least(xb, yb)) AS INTEGER) AS n_along,
CASE WHEN xa < least(xb, ya) THEN xa WHEN greatest(xa, yb) < xb THEN greatest(xa, yb) END AS first_left, CASE WHEN xb < ya THEN xb END AS between_lo, CASE WHEN xb < ya THEN ya END AS between_hi FROM p""")
def interval_results(spark, d):
    """intersectionWith, joinedWith, gapWith, excluding, separateUsing, between."""
    df, x, y = pairs(spark, d)
    meet, hull, gap = C.where(C.intersects([x], [y]), C.clip([x], [y])[0]), C.hull([x], [y])[0], C.gap_where(x, y)
    left, parts, mid = C.remainder(x, y), C.along(x, y), C.where(x.hi < y.lo, Span(DAY, x.hi, y.lo))
    return df.select(
        "o_orderkey", meet.lo.alias("meet_lo"), meet.hi.alias("meet_hi"), hull.lo.alias("hull_lo"), hull.hi.alias("hull_hi"), gap.lo.alias("gap_lo"), gap.hi.alias("gap_hi"), F.size(left).alias("n_left"),
        F.size(parts).alias("n_along"), F.get(left, 0)["lo"].alias("first_left"), mid.lo.alias("between_lo"), mid.hi.alias("between_hi"),
    )


@query(f"""WITH {PAIRS_SQL} SELECT CASE WHEN xa = ya AND xb = yb THEN 'EQ' WHEN ya <= xa AND xb <= yb THEN CASE WHEN xa = ya OR xb = yb THEN 'TPP' ELSE 'NTPP' END
WHEN xa <= ya AND yb <= xb THEN CASE WHEN xa = ya OR xb = yb THEN 'TPPi' ELSE 'NTPPi' END WHEN xa < yb AND ya < xb THEN 'PO' WHEN xb = ya OR yb = xa THEN 'EC' ELSE 'DC' END AS relation, count(*) AS n FROM p GROUP BY 1""")
def rcc8_all(spark, d):
    """All eight relations between two intervals."""
    df, x, y = pairs(spark, d)
    return df.groupBy(C.relation([x], [y]).alias("relation")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS_SQL} SELECT o_orderkey, CAST(NULL AS DATE) AS from_lo, ya AS new_lo, ya + 1 AS after_lo, ya AS to_hi, ya + 1 AS end_hi, CAST(NULL AS DATE) AS top_hi, xa + 1 AS start_hi, xb - 1 AS last_lo,
xa - 1 AS before_x, xb AS after_x, false AS everything, true AS bounded FROM p""")
def interval_ends(spark, d):
    """from, fromAfter, fromBottom, to, toBefore, toTop, atStart, atEnd; leftAdjacent and rightAdjacent of the ends; isUnbounded, isBounded."""
    df, x, y = pairs(spark, d)
    null = lambda c: F.when(~DAY.is_first(c) & ~DAY.is_last(c), c)
    out = {
        "from_lo": null(C.from_bottom(x).lo), "new_lo": C.starting(x, y.lo).lo, "after_lo": C.starting_after(x, y.lo).lo, "to_hi": C.ending_before(x, y.lo).hi, "end_hi": C.ending(x, y.lo).hi,
        "top_hi": null(C.to_top(x).hi), "start_hi": C.at_start(x).hi, "last_lo": C.at_end(x).lo, "before_x": DAY.pred(x.lo), "after_x": DAY.succ(DAY.pred(x.hi)),
        "everything": C.is_unbounded([x]), "bounded": C.is_bounded([x]),
    }
    return df.select("o_orderkey", *[c.alias(n) for n, c in out.items()])


@query(f"""WITH {PAIRS_SQL} SELECT * FROM (SELECT o_orderkey, 'from' AS kind, xa AS lo, CAST(NULL AS DATE) AS hi FROM p UNION ALL SELECT o_orderkey, 'after', xa + 1, NULL FROM p UNION ALL SELECT o_orderkey, 'to', NULL, xa + 1 FROM p
UNION ALL SELECT o_orderkey, 'before', NULL, xa FROM p UNION ALL SELECT o_orderkey, 'at', xa, xa + 1 FROM p UNION ALL SELECT o_orderkey, 'all', NULL, NULL FROM p)""")
def interval_constructors(spark, d):
    """intervalFrom, intervalFromAfter, intervalTo, intervalToBefore, intervalAt, unbounded."""
    df, x, _ = pairs(spark, d)
    whole = C.unbounded(DAY)
    made = {"from": C.interval_from(DAY, x.lo), "after": C.interval_from_after(DAY, x.lo), "to": C.interval_to(DAY, x.lo), "before": C.interval_to_before(DAY, x.lo), "at": C.interval_at(DAY, x.lo), "all": whole}
    null = lambda c: F.when(~DAY.is_first(c) & ~DAY.is_last(c), c)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), null(DAY.column(s.lo)).alias("lo"), null(DAY.column(s.hi)).alias("hi")) for k, s in made.items()])
    return df.select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*")


@query(f"""WITH {INT_SQL} SELECT o_orderkey, xb - xa AS n_points, xa AS first_point, xb - 1 AS last_point, xb - xa AS measure, xa - 5 AS moved_lo, xb - 5 AS moved_hi, 2 * 20 - xb AS turned_lo, 40 - xa AS turned_hi,
20 + 3 * (xa - 20) AS scaled_lo, 20 + 3 * (xb - 20) AS scaled_hi, xa - 2 AS padded_lo, xb + 2 AS padded_hi, xa - 1 AS wide_lo, xb + 3 AS wide_hi, CASE WHEN xb - xa > 4 THEN xa + 1 END AS thin_lo, CASE WHEN xb - xa > 4 THEN xb - 3 END AS thin_hi, xb - xa AS reach FROM p""")
def interval_affine(spark, d):
    """points, measure, displacedBy, reflectedAbout, scaledAbout, paddedBy, dilatedBy, erodedBy, displacementTo."""
    n = Dim("n")
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("xa"), (F.col("o_orderkey") % 40 + F.col("o_custkey") % 9 + 1).alias("xb"))
    x = Span(n, F.col("xa"), F.col("xb"))
    probe = Probe(interval(n, -1, Open(3)), 0)
    moved, turned, scaled, padded, wide = C.displaced(x, -5), C.reflected(x, 20), C.scaled(x, 20, 3), C.padded(x, 2), C.dilated(x, probe)
    thin = C.eroded(x, probe)
    thin = C.where(thin.lo < thin.hi, thin)
    pts = C.points_where(x)
    out = {"n_points": F.size(pts).cast("bigint"), "first_point": F.get(pts, 0), "last_point": F.element_at(pts, -1), "measure": C.measure([x]), "reach": n.minus(x.hi, x.lo)}
    for name, s in (("moved", moved), ("turned", turned), ("scaled", scaled), ("padded", padded), ("wide", wide), ("thin", thin)):
        out |= {f"{name}_lo": s.lo.cast("bigint"), f"{name}_hi": s.hi.cast("bigint")}
    return o.select("o_orderkey", *[c.alias(k) for k, c in out.items()])


@query("""SELECT o_orderkey, o_totalprice AS closed, o_totalprice <> 100000 AND o_totalprice > 100000 AS inside, greatest(o_totalprice, 150000.0) AS start, least(o_totalprice, 150000.0) AS stop,
CASE WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 'yes' ELSE 'no' END AS member FROM orders""")
def continuous_bounds(spark, d):
    """closeIfOpen, belongsTo, maxStart and minEnd of a continuous dimension with open and closed boundaries."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    v = F.col("o_totalprice")
    above, band = C.interval_from_after(AMOUNT, 100000), interval(AMOUNT, Open(100000), 200000)
    col = lambda s: Span(AMOUNT, AMOUNT.column(s.lo), AMOUNT.column(s.hi))
    a, b = AMOUNT.start(v), AMOUNT.column(AMOUNT.start(150000.0))
    e, f = AMOUNT.end(v), AMOUNT.column(AMOUNT.end(150000.0))
    return o.select(
        "o_orderkey", C.close_if_open(Open(v)).alias("closed"), C.contains_point([col(above)], (v,)).alias("inside"), C.greatest(a, b)["v"].alias("start"), C.least(e, f)["v"].alias("stop"),
        F.when(C.contains_point([col(band)], (v,)), "yes").otherwise("no").alias("member"),
    )


@query(f"""WITH {INT_SQL} SELECT o_orderkey, xa - 3 AS joined_lo, xb + 3 AS joined_hi, true AS holds_center FROM p""")
def probe_with_center(spark, d):
    """withCenter, reflected, superElement, containingCenter: dilation by a skewed probe joined with its reflection."""
    n = Dim("n")
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("xa"), (F.col("o_orderkey") % 40 + F.col("o_custkey") % 9 + 1).alias("xb"))
    (probe,) = C.containing_center([Probe(interval(n, 8, Open(11)), 11)])
    wide = C.dilated(Span(n, F.col("xa"), F.col("xb")), probe)
    return o.select("o_orderkey", wide.lo.alias("joined_lo"), wide.hi.alias("joined_hi"), F.lit(bool(C.contains_point([probe.span], (11,)))).alias("holds_center"))


# --- look-ups ---
@query(f"""{STATUS} {SHOW} st WHERE a < {OUT} AND b > {IN}""")
def get_intersecting(spark, d):
    """Rows that meet a box, as they are."""
    return shown(status(spark, d).get_intersecting(BOX))


@query(f"""{STATUS} SELECT CAST(count(*) AS BIGINT) AS size, false AS empty, bool_or(a < {OUT} AND b > {IN}) AS hits, bool_or(a <= {IN} AND {IN} < b) AS defined, false AS whole, CAST(count(DISTINCT v) AS BIGINT) AS n_values FROM st""")
def frame_facts(spark, d):
    """size, isEmpty, intersects, isDefinedAt, getOption, values."""
    f = status(spark, d)
    return one_row(spark, size=f.size(), empty=f.is_empty(), hits=f.intersects_box(BOX), defined=f.is_defined_at(B1), whole=f.get_option() is not None, n_values=f.distinct_values().count())


@query(f"""{STATUS} SELECT o_custkey, a day_lo, CASE WHEN b < {END} THEN b END day_hi, n FROM (SELECT o_custkey, a, b, 'F' AS n FROM st WHERE v = 'F' UNION ALL SELECT o_custkey, a, b, 'all' FROM st)""")
def intervals_of_values(spark, d):
    """intervals(value) and allIntervals."""
    f = status(spark, d)
    rows = f.intervals("F").withColumn("n", F.lit("F")).unionByName(f.all_intervals().withColumn("n", F.lit("all")))
    return rows.select("o_custkey", "day_lo", F.when(F.col("day_hi") != DAY.column(DAY.last), F.col("day_hi")).alias("day_hi"), "n")


@query(f"{STATUS} SELECT o_custkey, min(a) day_lo, CAST(NULL AS DATE) day_hi FROM st GROUP BY 1")
def domain_of_timeline(spark, d):
    """domain: the covered region of each customer."""
    return shown(status(spark, d).domain())


@query(f"{STATUS} SELECT o_custkey, string_agg(v, '' ORDER BY a) AS result FROM st GROUP BY 1")
def fold_in_order(spark, d):
    """foldLeft over getAll's order, one key after the other."""
    f = status(spark, d)
    assert f.get_all().columns == f.columns
    return f.fold_left(F.lit(""), lambda acc, r: F.concat(acc, r["value"]))


@query("SELECT 'everywhere' AS value, 'everywhere' AS found, true AS empty_is_empty, true AS bottom, true AS top FROM range(1)")
def unbounded_value(spark, d):
    """ofValue, get, empty, isDefinedAt at both unbounded ends."""
    f = IntervalFrame.of_value(spark, [DAY], "everywhere")
    none = IntervalFrame.empty(spark, [DAY])
    return f.get_at(BOTTOM).select("value", F.lit(f.get()).alias("found"), F.lit(none.is_empty()).alias("empty_is_empty"), F.lit(f.is_defined_at(BOTTOM)).alias("bottom"), F.lit(f.is_defined_at(TOP)).alias("top"))


# --- row by row ---
@query(f"""{STATUS}, x AS (SELECT o_custkey, a, b, CASE WHEN v = 'F' THEN 'done' ELSE 'open' END v FROM st), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def map_values(spark, d):
    """mapValues, coalesced where values become equal."""
    return shown(status(spark, d).map_values(value=F.when(F.col("value") == "F", "done").otherwise("open")))


@query(f"""{STATUS}, x AS (SELECT o_custkey, a, b, v FROM st WHERE v <> 'O'), y AS (SELECT o_custkey, a + 1 a, b + 1 b, v || '!' v FROM x WHERE b < {END}), {merged('y', 'o_custkey', value=', v')} {SHOW} out""")
def filter_and_map(spark, d):
    """filter, then map of intervals and values."""
    f = status(spark, d).filter((F.col("value") != "O") & (F.col("day_hi") < DAY.column(DAY.last)))
    return shown(f.map({DAY: (F.date_add("day_lo", 1), F.date_add("day_hi", 1))}, value=F.concat("value", F.lit("!"))))


@query(f"""{STATUS}, x AS (SELECT o_custkey, a, b, lower(v) v FROM st WHERE v = 'P'), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def collect_values(spark, d):
    """collect: values where a partial function is defined."""
    return shown(status(spark, d).collect(F.col("value") == "P", value=F.lower("value")))


@query(f"""{STATUS}, x AS (SELECT o_custkey, a, a + 1 b, v FROM st UNION ALL SELECT o_custkey, a + 1, b, lower(v) FROM st WHERE b > a + 1), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def flat_map(spark, d):
    """flatMap: each row becomes its first day and the rest."""
    one = lambda lo, hi, v: F.struct(lo.alias("day_lo"), hi.alias("day_hi"), v.alias("value"))
    lo, hi, v = F.col("day_lo"), F.col("day_hi"), F.col("value")
    rows = F.filter(F.array(one(lo, F.date_add(lo, 1), v), one(F.date_add(lo, 1), hi, F.lower(v))), lambda r: r["day_lo"] < r["day_hi"])
    return shown(status(spark, d).flat_map(rows))


@query(f"""WITH {SESSIONS_SQL} SELECT user_id, a sec_lo, b sec_hi, b - a AS value FROM ses WHERE b - a > 60""")
def shape_with_values(spark, d):
    """collectWithValue: a value from each box of a region, where there is one."""
    s = sessions(spark, d)
    return shown(s.collect_with_value(F.when(F.col("sec_hi") - F.col("sec_lo") > 60, F.col("sec_hi") - F.col("sec_lo"))))


@query(_GRID + f" SELECT o_custkey, a day_lo, CASE WHEN b < {END} THEN b END day_hi, 1 AS value FROM cell WHERE v IS NOT NULL")
def shape_with_aligned_values(spark, d):
    """collectWithValue on another frame's grid; toShape."""
    f = status(spark, d)
    cells = Shape(f.df, f.dims, (), f.keys).collect_with_value(F.lit(1), _late(spark, d))
    return shown(cells)


# --- writes ---
@query(f"""{STATUS}, x AS ({OUTSIDE} UNION ALL SELECT DISTINCT o_custkey, {IN}, {OUT}, 'X' FROM st), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def set_one(spark, d):
    """set: a value in a box, over whatever was there."""
    return shown(status(spark, d).set(BOX, "X"))


@query(f"""{STATUS}, x AS (SELECT * FROM st UNION ALL SELECT DISTINCT o_custkey, DATE '1990-01-01', DATE '1990-02-01', 'X' FROM st), {merged('x', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, CASE WHEN b < {END} THEN b END day_hi, v AS value, true AS conflict_kept FROM out""")
def set_without_conflict(spark, d):
    """setIfNoConflict where nothing is, and None where something is."""
    f = status(spark, d)
    out = f.set_if_no_conflict(interval(DAY, dt.date(1990, 1, 1), dt.date(1990, 1, 31)), "X")
    return shown(out).withColumn("conflict_kept", F.lit(f.set_if_no_conflict(BOX, "X") is None))


@query(_GRID + f", w AS (SELECT o_custkey, a, b, v FROM cell WHERE v IS NOT NULL AND NOT urgent), {merged('w', 'o_custkey', value=', v')} {SHOW} out")
def remove_many(spark, d):
    return shown(status(spark, d).remove_many(_late(spark, d)))


@query(f"{STATUS} {SHOW} st WHERE v <> 'P'")
def remove_value(spark, d):
    return shown(status(spark, d).remove_value("P"))


@query(f"{STATUS} {SHOW} st WHERE a <> DATE '1995-03-01'")
def remove_by_key(spark, d):
    """removeByKey: rows that start on a day."""
    return shown(status(spark, d).remove_by_key(dt.date(1995, 3, 1), missing="ignore"))


@query(f"""WITH {line('o_orderstatus', 's')}, st AS (SELECT o_custkey, lo a, coalesce(hi, {END}) b, v FROM s WHERE lo <> (SELECT min(lo) FROM s)), x AS ({OUTSIDE} UNION ALL SELECT DISTINCT o_custkey, {IN}, {OUT}, 'X' FROM st), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def replace_rows(spark, d):
    """replace: rows of one start go, a box is set."""
    f = status(spark, d)
    first = f.df.agg(F.min("day_lo")).first()[0]
    return shown(f.replace((first,), BOX, "X"))


@query(f"""{STATUS}, x AS (SELECT * FROM st UNION ALL SELECT o_custkey, DATE '1990-01-01', least(min(a), {OUT}), 'none' FROM st GROUP BY 1), {merged('x', 'o_custkey', value=', v')} {SHOW} out""")
def fill_box(spark, d):
    """fill: a value where nothing is valid in a box."""
    return shown(status(spark, d).fill(interval(DAY, dt.date(1990, 1, 1), B2), "none"))


@query(_GRID + f" {SHOW} cell WHERE v IS NOT NULL")
def decompress_on_grid(spark, d):
    """decompressedData on another frame's cuts."""
    return shown(status(spark, d).decompressed(_late(spark, d)))


@query(f"{STATUS} {SHOW} st")
def compress_again(spark, d):
    """compressAll undoes a decompression; recompressAll gives the canonical form."""
    cut = status(spark, d).decompressed(_late(spark, d))
    return shown(cut.compress_all().recompress_all())


@query(_GRID + f", x AS (SELECT o_custkey, a, b, v FROM cell WHERE v = 'F'), {merged('x', 'o_custkey', value=', v')}, y AS (SELECT o_custkey, a, b, v FROM out UNION ALL SELECT o_custkey, a, b, v FROM cell WHERE v <> 'F') {SHOW} y")
def compress_value(spark, d):
    """compress(v): rows of one value only."""
    return shown(status(spark, d).decompressed(_late(spark, d)).compress("F"))


@query(f"""WITH {SPANS_SQL}, cuts AS (SELECT o_custkey, a c FROM spans UNION SELECT o_custkey, b FROM spans), seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT s.o_custkey, s.a, s.b, string_agg(r.l_returnflag, '' ORDER BY r.l_orderkey, r.l_linenumber, r.l_returnflag) v FROM seg s JOIN spans r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b GROUP BY ALL), {merged('cell', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out""")
def merge_fold_in_order(spark, d):
    """mergeMany with a function whose order matters: flags joined in order of the lines."""
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"), "l_orderkey", "l_linenumber")
    f = IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, ["value", "l_orderkey", "l_linenumber"], ["o_custkey"])
    writes = IntervalFrame(f.df, f.dims, ("value",), f.keys).carrying(f.df)
    none = writes._with(writes.df.limit(0))
    return shown(none.merge_fold(writes, lambda a, b: F.concat(a, b), order=F.struct("l_orderkey", "l_linenumber", "value")))


# --- regions ---
WIDE = "w AS (SELECT user_id, a - 20 a, b + 20 b FROM ses)"
_HALF = "h0 AS (SELECT user_id, a, b FROM ses WHERE a % 2 = 0), g0 AS (SELECT user_id, a + 30 a, b + 30 b FROM ses WHERE a % 3 = 0)"


def _halves(spark, d) -> tuple[Shape, Shape]:
    """Two overlapping regions: sessions that begin on even seconds; those on multiples of three, half a minute later."""
    s = sessions(spark, d)
    pick = lambda test: Shape(s.df.filter(test), s.dims, (), s.keys)
    return pick("sec_lo % 2 = 0"), Shape(pick("sec_lo % 3 = 0").displaced(30).df, s.dims, (), s.keys)


_TWO = f"""WITH {SESSIONS_SQL}, {_HALF}, cuts AS (SELECT user_id, a c FROM h0 UNION SELECT user_id, b FROM h0 UNION SELECT user_id, a FROM g0 UNION SELECT user_id, b FROM g0),
seg AS (SELECT user_id, c a, lead(c) OVER (PARTITION BY user_id ORDER BY c) b FROM cuts),
cell AS (SELECT s.user_id, s.a, s.b, h0.a IS NOT NULL x, g0.a IS NOT NULL y FROM seg s LEFT JOIN h0 ON h0.user_id = s.user_id AND h0.a <= s.a AND s.b <= h0.b LEFT JOIN g0 ON g0.user_id = s.user_id AND g0.a <= s.a AND s.b <= g0.b WHERE s.b IS NOT NULL)"""


def _region(test: str) -> str:
    return _TWO + f", w AS (SELECT user_id, a, b FROM cell WHERE {test}), {merged('w', 'user_id')} SELECT user_id, a sec_lo, b sec_hi FROM out"


@query(_region("x OR y"))
def shape_union(spark, d):
    """union, add, addMany."""
    a, b = _halves(spark, d)
    return shown(a.union(b).add_many(b))


@query(_region("x AND y"))
def shape_intersection(spark, d):
    a, b = _halves(spark, d)
    return shown(a.intersection(b))


@query(_region("x AND NOT y"))
def shape_difference(spark, d):
    """difference, removeMany."""
    a, b = _halves(spark, d)
    return shown(a.difference(b))


@query(_region("x <> y"))
def shape_symmetric_difference(spark, d):
    a, b = _halves(spark, d)
    return shown(a.symmetric_difference(b))


@query(_TWO + ", n AS (SELECT count(*) FILTER (x AND NOT y) p, count(*) FILTER (y AND NOT x) q, count(*) FILTER (x AND y) r FROM cell) SELECT CASE WHEN r = 0 THEN 'apart' WHEN p = 0 AND q = 0 THEN 'EQ' WHEN p > 0 AND q > 0 THEN 'PO' ELSE 'part' END AS relation, r > 0 AS meets, r > 0 AS connected, q = 0 AS subset, p = 0 AND q = 0 AS equivalent, false AS universe, false AS empty, true AS bounded FROM n")
def shape_tests(spark, d):
    """relationWith, intersects, isConnectedTo, isSubsetOf, isEquivalentTo, isUniverse, isEmpty, isBounded of regions."""
    a, b = _halves(spark, d)
    return one_row(spark, relation=a.relation_with(b), meets=a.intersects_shape(b), connected=a.is_connected_to(b), subset=b.is_subset_of(a), equivalent=a.is_equivalent_to(b), universe=a.is_universe(), empty=a.is_empty(), bounded=a.is_bounded())


@query(f"""WITH {SESSIONS_SQL}, {WIDE}, {merged('w', 'user_id')} SELECT count(*) = 0 OR bool_and(x.user_id IS NOT NULL) AS subset, (SELECT count(*) FROM ses) = (SELECT count(*) FROM (SELECT user_id, a, b FROM ses INTERSECT SELECT user_id, a, b FROM out)) AS equivalent,
(SELECT bool_or(r.b - s.b > 0 OR s.a - r.a > 0) FROM ses s JOIN out r ON r.user_id = s.user_id AND r.a <= s.a AND s.b <= r.b) AS larger, (SELECT count(*) = 0 FROM ses x JOIN ses y ON x.user_id = y.user_id AND x.a < y.a AND y.a < x.b) AS disjoint,
(SELECT count(*) > 0 FROM ses x JOIN ses y ON x.user_id = y.user_id AND x.b = y.a) AS compressible, (SELECT count(*) > 0 FROM w x JOIN w y ON x.user_id = y.user_id AND x.a < y.a AND y.a < x.b) AS wide_overlap
FROM ses s LEFT JOIN out x ON x.user_id = s.user_id AND x.a <= s.a AND s.b <= x.b""")
def region_tests(spark, d):
    """isSubsetOf, isEquivalentTo, isDisjoint, isCompressible, each where it holds and where it doesn't."""
    s = sessions(spark, d)
    w = s._moved(lambda x: C.padded(x, 20), coalesce=False)
    wide = Shape(w.df, w.dims, (), w.keys)
    return one_row(
        spark, subset=s.is_subset_of(wide.recompress_all()), equivalent=s.is_equivalent_to(wide.recompress_all()), larger=not wide.is_subset_of(s), disjoint=s.is_disjoint(), compressible=s.is_compressible(), wide_overlap=not wide.is_disjoint(),
    )


@query(f"WITH {SESSIONS_SQL}, x AS (SELECT user_id, a, b FROM ses UNION ALL SELECT DISTINCT user_id, 0, 10 FROM ses), y AS (SELECT user_id, a, least(b, 1704100000) b FROM x WHERE a < 1704100000 UNION ALL SELECT user_id, greatest(a, 1704200000), b FROM x WHERE b > 1704200000) SELECT user_id, CAST(a AS BIGINT) sec_lo, CAST(b AS BIGINT) sec_hi FROM y WHERE a < b")
def shape_add_remove(spark, d):
    """add, addIfNoConflict, remove of boxes."""
    s = sessions(spark, d).add_if_no_conflict(interval(SEC, 0, 9))
    return shown(s.remove(interval(SEC, 1704100000, Open(1704200000))))


@query(f"""WITH {SESSIONS_SQL}, z AS (SELECT 1 k, a, b FROM ses), {merged('z', 'k')} SELECT coalesce(bool_or(a <= 1704200000 AND b > 1704200000), false) AS at_point, coalesce(bool_or(a <= 1704200000 AND b >= 1704200010), false) AS at_box, (SELECT CAST(count(*) AS BIGINT) FROM ses) AS size FROM out""")
def shape_contains(spark, d):
    """contains(point), contains(interval) of the users together, size and allIntervals."""
    s = sessions(spark, d)
    whole = Shape(s.df.drop("user_id"), s.dims)
    return one_row(spark, at_point=whole.contains_point(1704200000), at_box=whole.recompress_all().contains_box(interval(SEC, 1704200000, Open(1704200010))), size=s.all_intervals().count())



@query(f"WITH {SESSIONS_SQL}, x AS (SELECT user_id, a, b FROM ses WHERE b - a > 60 UNION ALL SELECT user_id, a + 1000, b + 1000 FROM ses WHERE b - a > 60), {merged('x', 'user_id')} SELECT user_id, a sec_lo, b sec_hi FROM out")
def shape_flat_map(spark, d):
    """flatMap, filter and collect of regions."""
    s = sessions(spark, d).collect(F.col("sec_hi") - F.col("sec_lo") > 60)
    one = lambda k: F.struct((F.col("sec_lo") + k).alias("sec_lo"), (F.col("sec_hi") + k).alias("sec_hi"))
    return shown(s.flat_map(F.array(one(0), one(1000))))


def _near(k: int) -> str:
    return f"n{k} AS (SELECT user_id, a - {k} a, b + {k} b FROM ses), {merged(f'n{k}', 'user_id', name=f'o{k}')}"


@query(f"WITH {SESSIONS_SQL}, {_near(300)}, x AS (SELECT user_id, a, b FROM o300), cut AS (SELECT x.user_id, x.a, x.b, s.a sa, s.b sb, lag(s.b) OVER (PARTITION BY x.user_id, x.a ORDER BY s.a) prev, row_number() OVER (PARTITION BY x.user_id, x.a ORDER BY s.a DESC) r FROM x JOIN ses s ON s.user_id = x.user_id AND s.a >= x.a AND s.b <= x.b) SELECT user_id, coalesce(prev, a) sec_lo, sa sec_hi FROM cut UNION ALL SELECT user_id, sb, b FROM cut WHERE r = 1")
def bounding_shape(spark, d):
    """boundingShape: the shell of five minutes around the sessions."""
    return shown(sessions(spark, d).bounding_shape(300))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, a sec_lo, b sec_hi FROM ses WHERE b - a <= 89")
def white_top_hat(spark, d):
    """whiteTopHatBy: what an opening takes away."""
    return shown(sessions(spark, d).white_top_hat(Probe(interval(SEC, 0, Open(89)), 0)))


@query(f"WITH {SESSIONS_SQL}, g AS (SELECT user_id, b a, lead(a) OVER (PARTITION BY user_id ORDER BY a) b FROM ses) SELECT user_id, a sec_lo, b sec_hi FROM g WHERE b IS NOT NULL AND b - a <= 1801")
def black_top_hat(spark, d):
    """blackTopHatBy: the gaps that a closing fills."""
    return shown(sessions(spark, d).black_top_hat(Probe(interval(SEC, 0, Open(1801)), 0)))



@query(f"WITH {SESSIONS_SQL}, n AS (SELECT user_id, a - 10 a, b + 10 b FROM ses), {merged('n', 'user_id', name='o')}, c AS (SELECT o.user_id, o.a, o.b, s.a + 10 sa, s.b - 10 sb FROM o JOIN ses s ON s.user_id = o.user_id AND s.a >= o.a AND s.b <= o.b), q AS (SELECT *, lag(sb) OVER (PARTITION BY user_id, a ORDER BY sa) prev, row_number() OVER (PARTITION BY user_id, a ORDER BY sa DESC) r FROM c) SELECT user_id, coalesce(prev, a) sec_lo, sa sec_hi FROM q UNION ALL SELECT user_id, sb, b FROM q WHERE r = 1")
def gradient(spark, d):
    """gradientBy: dilation without erosion."""
    return shown(sessions(spark, d).gradient(Probe(interval(SEC, -10, Open(10)), 0)))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a) AS BIGINT) AS component, a sec_lo, b sec_hi FROM ses")
def contiguous_parts(spark, d):
    """contiguousSubshapes: one region for each connected part."""
    parts = sessions(spark, d).contiguous_subshapes()
    return shown(parts).withColumn("component", F.col("component").cast("bigint"))


@query(f"WITH {SESSIONS_SQL}, n AS (SELECT user_id, count(*) n FROM ses GROUP BY 1) SELECT max(n) = 1 AS contiguous, count(*) FILTER (n > 1) = 0 AS solid, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_cavities FROM n")
def cavities_and_solids(spark, d):
    """cavities, isContiguous and isSolid: gaps between a user's sessions are cavities in one dimension."""
    s = sessions(spark, d)
    n = s.components().groupBy("user_id").agg(F.countDistinct("component").alias("n")).agg(F.max("n")).first()[0]
    return one_row(spark, contiguous=n == 1, solid=s.cavities().isEmpty(), n_cavities=s.cavities().count())


@query(f"WITH {SESSIONS_SQL}, x AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a) r FROM ses) SELECT count(*) FILTER (r = 1) > 0 AND false AS touching, false AS connected FROM x")
def shapes_apart(spark, d):
    """touches and isConnectedTo of regions that are apart."""
    s = sessions(spark, d)
    far = Shape(s.displaced(10_000_000).df, s.dims, (), s.keys)
    return one_row(spark, touching=s.touches_shape(far), connected=s.is_connected_to(far))


# --- sets and monoids ---
_SETS = f"""{SPANS_SQL}, cuts AS (SELECT o_custkey, a c FROM spans UNION SELECT o_custkey, b FROM spans), seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
one AS (SELECT DISTINCT s.o_custkey, s.a, s.b, r.l_returnflag f FROM seg s JOIN spans r ON r.o_custkey = s.o_custkey AND r.a <= s.a AND s.b <= r.b)"""


def _flags(spark, d) -> Multi:
    rows = spans(spark, d).select("o_custkey", "ordered", "shipped", F.col("l_returnflag").alias("value"))
    return Multi.from_single(IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped")))}, keys=["o_custkey"]))


def _sets(rows: str) -> str:
    return f"WITH {_SETS}, pick AS ({rows}), y AS (SELECT o_custkey, a, b, array_to_string(list_sort(list(DISTINCT f)), ',') v FROM pick GROUP BY ALL), {merged('y', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out"


def _shown_sets(m: Multi) -> DataFrame:
    return shown(m).withColumn("value", F.array_join("value", ","))


@query("SELECT DISTINCT l_returnflag AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE)")
def multi_values_one(spark, d):
    """valuesOne: the elements of all sets."""
    return _flags(spark, d).values_one()


@query(_sets(f"SELECT o_custkey, a, least(b, {IN}) b, f FROM one WHERE a < {IN} UNION ALL SELECT o_custkey, greatest(a, {OUT}), b, f FROM one WHERE b > {OUT} UNION ALL SELECT o_custkey, greatest(a, {IN}), least(b, {OUT}), f FROM one WHERE a < {OUT} AND b > {IN} AND f <> 'R'"))
def multi_remove_one(spark, d):
    """removeOne: an element taken out of the sets in a box."""
    return _shown_sets(_flags(spark, d).remove_one(BOX, "R"))


_CUT = f"cut AS (SELECT o_custkey, a, least(b, {IN}) b, f FROM one WHERE a < {IN} UNION ALL SELECT o_custkey, greatest(a, {OUT}), b, f FROM one WHERE b > {OUT} UNION ALL SELECT o_custkey, greatest(a, {IN}), least(b, {OUT}), f FROM one WHERE a < {OUT} AND b > {IN})"


@query(f"""WITH {_SETS}, {_CUT}, c2 AS (SELECT o_custkey, a c FROM cut UNION SELECT o_custkey, b FROM cut UNION SELECT DISTINCT o_custkey, {IN} FROM spans UNION SELECT DISTINCT o_custkey, {OUT} FROM spans), s2 AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM c2),
pick AS (SELECT s2.o_custkey, s2.a, s2.b, cut.f FROM s2 JOIN cut ON cut.o_custkey = s2.o_custkey AND cut.a <= s2.a AND s2.b <= cut.b UNION ALL SELECT o_custkey, a, b, 'Z' FROM s2 WHERE a >= {IN} AND b <= {OUT}),
y AS (SELECT o_custkey, a, b, array_to_string(list_sort(list(DISTINCT f)), ',') v FROM pick GROUP BY ALL), {merged('y', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, b day_hi, v AS value FROM out""")
def multi_add_one(spark, d):
    """addOne and union (mergeOne): an element put into the sets of a box."""
    return _shown_sets(_flags(spark, d).add_one(BOX, "Z"))


@query(f"WITH {_SETS}, pick AS (SELECT * FROM one WHERE f <> 'A'), y AS (SELECT o_custkey, a, b, array_to_string(list_sort(list(DISTINCT f)), ',') v FROM one GROUP BY ALL), {merged('y', 'o_custkey', value=', v')} SELECT o_custkey, a day_lo, b day_hi, array_to_string([x for x in string_split(v, ',') if x <> 'A'], ',') AS value FROM out WHERE v <> 'A'")
def multi_intersection(spark, d):
    """intersection: the elements valid in both, on the rows of both; not coalesced."""
    m = _flags(spark, d)
    return _shown_sets(m.intersection(m.map_values(value=F.array(F.lit("N"), F.lit("R"))).as_kind(Multi)))


@query(f"""WITH {SPANS_SQL}, delta AS (SELECT o_custkey, c, sum(x) x, sum(n) n FROM (SELECT o_custkey, a c, q x, 1 n FROM spans UNION ALL SELECT o_custkey, b, -q, -1 FROM spans) GROUP BY ALL),
run AS (SELECT o_custkey, c a, lead(c) OVER w b, sum(x) OVER w v, sum(n) OVER w k FROM delta WINDOW w AS (PARTITION BY o_custkey ORDER BY c)), held AS (SELECT * FROM run WHERE k > 0), {merged('held', 'o_custkey', value=', v')}
SELECT o_custkey, a day_lo, b day_hi, CAST(2 * v AS BIGINT) AS value FROM out""")
def monoid_union(spark, d):
    """The monoid's union with itself doubles its sums; withMonoidValue, asData conversions, combine."""
    rows = open_orders(spark, d)
    m = Monoid(rows._with(rows.df.limit(0)).merge_many(rows, {"value": F.sum}).df, rows.dims, rows.values, rows.keys)
    return shown(m.union(m.as_kind(IntervalFrame).as_kind(Monoid)))


@query(f"""WITH {SPANS_SQL}, x AS (SELECT o_custkey, a, b FROM spans), {merged('x', 'o_custkey')}, g AS (SELECT o_custkey, lag(b) OVER w a, a b, lead(a) OVER w nxt, b c FROM out WINDOW w AS (PARTITION BY o_custkey ORDER BY a))
SELECT o_custkey, a day_lo, b day_hi, CAST(0 AS BIGINT) AS value FROM g UNION ALL SELECT o_custkey, c, NULL, 0 FROM g WHERE nxt IS NULL""")
def monoid_complement(spark, d):
    """complement: the void with the identity."""
    rows = open_orders(spark, d)
    m = Monoid(rows._with(rows.df.limit(0)).merge_many(rows, {"value": F.sum}).df, rows.dims, rows.values, rows.keys)
    return shown(m.complement())


@query("SELECT 0 AS everywhere, CAST(5 AS BIGINT) AS inside FROM range(1)")
def monoid_universe(spark, d):
    """universe of a monoid; withMonoidValue and the monoid's intersection."""
    whole = Monoid.universe(spark, [SEC], 0, "int")
    some = Shape.of_boxes(spark, [SEC], [interval(SEC, 0, 9)]).with_monoid_value(5)
    both = some.intersection(whole, lambda a, b: a + b)
    return whole.get_at(3).select(F.col("value").alias("everywhere"), F.lit(both.get_at(3).first()[0]).cast("bigint").alias("inside"))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, CAST(sum(b - a) AS BIGINT) AS measure, CAST(max(b - a) AS BIGINT) AS longest FROM ses GROUP BY 1")
def reduce_measures(spark, d):
    """mapReduceMeasure: sums and maxima of lengths."""
    s = sessions(spark, d)
    return s.map_reduce_measure().join(s.map_reduce_measure(F.max).withColumnRenamed("measure", "longest"), "user_id")


# --- dimensions ---
LINES_SQL = f"{SPANS_SQL}, ln AS (SELECT l_orderkey, l_linenumber, a, max(b) b, max(q) q, max(l_returnflag) l_returnflag FROM spans GROUP BY ALL)"


def _days_by_quantity(spark, d) -> IntervalFrame:
    rows = spans(spark, d).groupBy("l_orderkey", "l_linenumber", "ordered").agg(F.max("shipped").alias("shipped"), F.max("l_quantity").cast("bigint").alias("q"), F.max("l_returnflag").alias("value"))
    return IntervalFrame.from_df(rows, {DAY: (F.col("ordered"), Open(F.col("shipped"))), Dim("qty"): (1, F.col("q"))}, keys=["l_orderkey", "l_linenumber"])


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, a day_lo, b day_hi, l_returnflag AS value FROM ln WHERE q >= 30")
def slice_at_quantity(spark, d):
    """getByDimension: what is valid at a point of one dimension."""
    return shown(_days_by_quantity(spark, d).slice_at("qty", 30))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, a day_lo, b day_hi FROM ln")
def flatten_quantity(spark, d):
    """flattenDimension: the days covered at any quantity."""
    return shown(_days_by_quantity(spark, d).flatten("qty"))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, 1 AS qty_lo, CAST(6 AS BIGINT) AS qty_hi, a day_lo, b day_hi, l_returnflag AS value FROM ln")
def dimension_changes(spark, d):
    """swapDimensions, updateDimension, dropDimension with insertDimension."""
    f = _days_by_quantity(spark, d).swap(0, 1).update_dimension("qty", interval(Dim("qty"), 1, 5))
    out = f.drop_dimension("qty").extrude(0, interval(Dim("qty"), 1, 5))
    return shown(out).withColumn("qty_lo", F.col("qty_lo").cast("int"))


@query(f"WITH {SESSIONS_SQL}, n AS (SELECT user_id, min(a) a FROM ses GROUP BY 1) SELECT ses.user_id, ses.a sec_lo, ses.b sec_hi, CAST(0 AS BIGINT) AS n_lo, CAST(3 AS BIGINT) AS n_hi, 'x' AS value FROM ses JOIN n USING (user_id)")
def cross_dimensions(spark, d):
    """x (cross): boxes of two structures of different dimensions, by key."""
    s = sessions(spark, d)
    n = Dim("n")
    other = IntervalFrame(s.df.select("user_id").distinct().select("user_id", n.column(0).alias("n_lo"), n.column(3).alias("n_hi"), F.lit("x").alias("value")), [n], ("value",), ("user_id",))
    return shown(s.cross(other))


@query(f"WITH {SESSIONS_SQL} SELECT user_id, 2 * a - 1704067200 AS sec_lo, 2 * b - 1704067200 AS sec_hi FROM ses")
def scaled_sessions(spark, d):
    """scaledAboutIn: times two about a second."""
    return shown(sessions(spark, d).scaled_in("sec", 1704067200, 2))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, DATE '2000-01-01' + CAST(DATE '2000-01-01' - b AS INTEGER) AS day_lo, DATE '2000-01-01' + CAST(DATE '2000-01-01' - a AS INTEGER) AS day_hi, CAST(11 AS BIGINT) AS qty_lo, q + 11 AS qty_hi, l_returnflag AS value FROM ln")
def moved_in_one_dimension(spark, d):
    """displacedByIn and reflectedAboutIn: each along one dimension only."""
    return shown(_days_by_quantity(spark, d).displaced_in("qty", 10).reflected_in("day", dt.date(2000, 1, 1)))


# --- versions ---
_V = "v1 AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) a FROM orders GROUP BY 1)"


def _versions(spark, d) -> Versioned:
    """Per customer: 'first' for ten days from the first order on, then version 1 with 'second' for the five days after these."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"))
    rows = lambda x, y, v: IntervalFrame.from_df(o.select("o_custkey", F.date_add("a", x).alias("s"), F.date_add("a", y).alias("e"), F.lit(v).alias("value")), {DAY: (F.col("s"), Open(F.col("e")))}, keys=["o_custkey"])
    return Versioned.from_frame(rows(0, 10, "first"), now=0).increment(now=1).set_many(rows(10, 15, "second"))


@query(f"WITH {_V} SELECT o_custkey, a day_lo, a + 10 day_hi, 'first' AS value, 'v0' AS at FROM v1 UNION ALL SELECT o_custkey, a, a + 10, 'first', 'v1' FROM v1 UNION ALL SELECT o_custkey, a + 10, a + 15, 'second', 'v1' FROM v1")
def versions_apart(spark, d):
    """getSelectedData of versions; resetToVersion and collapseVersionHistory agree with it."""
    v = _versions(spark, d)
    old, new = v.reset_to(0), v.collapse_history(now=2)
    return shown(old.selected()).withColumn("at", F.lit("v0")).unionByName(shown(new.selected()).withColumn("at", F.lit("v1")))


@query(f"WITH {_V}, r AS (SELECT o_custkey, a, a + 10 b, 'FIRST' v FROM v1 UNION ALL SELECT o_custkey, a + 10, a + 15, 'SECOND' FROM v1) SELECT o_custkey, a day_lo, b day_hi, v AS value FROM r")
def versions_mapped(spark, d):
    """map, mapValues, filter, collect, flatMap, compress of versioned data."""
    v = _versions(spark, d).map_values(value=F.upper("value")).filter(F.col("value") != "none").collect(F.col("value").isNotNull()).map_intervals({DAY: (F.col("day_lo"), F.col("day_hi"))})
    one = F.array(F.struct("version_lo", "version_hi", "day_lo", "day_hi", "value"))
    return shown(v.flat_map(one).compress("FIRST").compress_all().recompress_all().selected())


@query(f"""WITH {_V}, w AS (SELECT o_custkey, a, DATE '1995-02-01' p, DATE '1995-03-01' q FROM v1), r AS (SELECT o_custkey, a, a + 10 b, p, q FROM w),
x AS (SELECT o_custkey, a, least(b, greatest(p, a)) b FROM r WHERE a < p UNION ALL SELECT o_custkey, greatest(a, q), b FROM r WHERE b > q) SELECT o_custkey, a day_lo, b day_hi, 'first' AS value FROM x WHERE a < b""")
def approve_partial(spark, d):
    """approveAll of a box that cuts an unapproved removal: only the part inside is removed."""
    o = _versions(spark, d).reset_to(0)
    wide = o.remove(interval(DAY, dt.date(1990, 1, 1), dt.date(2010, 1, 1)), selection=UNAPPROVED)
    return shown(wide.approve_all(interval(DAY, dt.date(1995, 2, 1), dt.date(1995, 2, 28))).selected())


@query(f"WITH {_V} SELECT o_custkey, a + 3 day_lo, a + 5 day_hi, 'new' AS value FROM v1 UNION ALL SELECT o_custkey, a, a + 3, 'first' FROM v1 UNION ALL SELECT o_custkey, a + 5, a + 10, 'first' FROM v1 UNION ALL SELECT o_custkey, a + 10, a + 15, 'second' FROM v1")
def approve_waiting(spark, d):
    """setMany as unapproved, then approveAll of everything."""
    v = _versions(spark, d)
    o = v.selected().df.groupBy("o_custkey").agg(F.min("day_lo").alias("a"))
    rows = IntervalFrame.from_df(o.select("o_custkey", F.date_add("a", 3).alias("s"), F.lit("new").alias("value")), {DAY: (F.col("s"), F.date_add("s", 1))}, keys=["o_custkey"])
    return shown(v.set_many(rows, selection=UNAPPROVED).approve_all(C.unbounded(DAY)).selected())


@query(f"WITH {_V} SELECT o_custkey, 'Create' AS action, a + 10 day_lo, a + 15 day_hi, 'second' AS value FROM v1")
def versions_differ(spark, d):
    """diffActionsBetween two versions."""
    acts = _versions(spark, d).diff_actions_between(0, 1)
    return acts.select("o_custkey", "action", "day_lo", "day_hi", "value")


@query("SELECT CAST(0 AS BIGINT) AS version, '0' AS time, 'init' AS comment UNION ALL SELECT 1, '1', 'incremented'")
def version_log(spark, d):
    """getVersionTimestamps; a clock is always given."""
    v = _versions(spark, d)
    assert v.current == 1
    return v.timestamps(spark)


@query(f"WITH {_V} SELECT o_custkey, a day_lo, a + 10 day_hi, 'first' AS value, 'first' AS value_2 FROM v1 UNION ALL SELECT o_custkey, a + 10, a + 15, 'second', 'second' FROM v1")
def versions_zipped(spark, d):
    """zip and merge of versioned data."""
    v = _versions(spark, d)
    return shown(v.merge(v).zip(v).selected())


@query(f"WITH {_V}, r AS (SELECT o_custkey, a, a + 2 b, 'first' v FROM v1 UNION ALL SELECT o_custkey, a + 2, a + 4, 'X' FROM v1 UNION ALL SELECT o_custkey, a + 4, a + 10, 'first' FROM v1 UNION ALL SELECT o_custkey, a + 10, a + 15, 'second' FROM v1) SELECT o_custkey, count(*) AS n_rows, true AS kept FROM r GROUP BY 1")
def versions_written(spark, d):
    """setMany, update, remove, removeValue, fill, setIfNoConflict of versioned data, and what older versions keep."""
    v = _versions(spark, d)
    o = v.selected().df.groupBy("o_custkey").agg(F.min("day_lo").alias("a"))
    rows = IntervalFrame.from_df(o.select("o_custkey", F.date_add("a", 2).alias("s"), F.lit("X").alias("value")), {DAY: (F.col("s"), F.date_add("s", 1))}, keys=["o_custkey"])
    w = v.set_many(rows)
    gone = w.remove_value("X").fill(interval(DAY, dt.date(1900, 1, 1), dt.date(1900, 1, 1)), "f").update(interval(DAY, dt.date(1900, 1, 1), dt.date(1900, 1, 1)), "g").remove(interval(DAY, dt.date(1900, 1, 1), dt.date(1900, 1, 1)))
    kept = w.reset_to(0).selected().is_equivalent_to(v.reset_to(0).selected()) and gone.selected().filter(F.col("value") == "X").is_empty() and w.set_if_no_conflict(interval(DAY, dt.date(1, 1, 2), TOP), "y") is None
    return w.selected().df.groupBy("o_custkey").agg(F.count("*").alias("n_rows")).withColumn("kept", F.lit(kept))


@query("SELECT 'c' AS now, 'b' AS prior, 'a' AS early, 'b' AS undone, CAST(110 AS BIGINT) AS changed, CAST(3 AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_reset FROM range(1)")
def variable_history(spark, d):
    """Variable: set, unset, reset, get, getPrior, getAt, lastChange, history, fromHistory, a clock that stands still."""
    v = Variable.from_history(Variable.of(spark, "a").set("b", now=100).set("c", now=100).frame)
    return one_row(spark, now=v.get(), prior=v.get_prior(), early=v.get_at(50), undone=v.unset().get(), changed=v.last_change(), n=v.history().count(), n_reset=v.reset().history().count())


# --- functions valid in boxes ---
def _fee(spark) -> FunctionFrame:
    return FunctionFrame.of(spark, [AMOUNT], [(interval(AMOUNT, 0, Open(100000)), _flat), (interval(AMOUNT, 100000, Open(300000)), _share)])


def _flat(x):
    return F.lit(10.0)


def _share(x):
    return x * 0.5


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 10.0 WHEN o_totalprice < 200000 THEN o_totalprice * 0.5 WHEN o_totalprice < 300000 THEN 1 + o_totalprice * 0.5 WHEN o_totalprice < 400000 THEN 1.0 END AS value FROM orders")
def function_merge(spark, d):
    """fuse and merge of functions: added where both are defined."""
    other = FunctionFrame.of(spark, [AMOUNT], [(interval(AMOUNT, 200000, Open(400000)), lambda x: F.lit(1.0))])
    return _fee(spark).merge(other, lambda a, b: a + b).evaluate(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 AND o_totalprice < 300000 THEN o_totalprice * 0.5 - 1 END AS both_there, CASE WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN o_totalprice END AS mapped, CASE WHEN o_totalprice < 100000 THEN 7.0 WHEN o_totalprice < 300000 THEN o_totalprice * 0.5 END AS replaced FROM orders")
def function_rows(spark, d):
    """intersection, filter, collect, mapValues, replace, set, remove of functions."""
    f = _fee(spark)
    other = FunctionFrame.of(spark, [AMOUNT], [(interval(AMOUNT, 200000, Open(400000)), lambda x: F.lit(1.0))])
    mapped = f.collect(lambda g: g if g is _share else None).map_values(lambda v: v * 2)
    replaced = f.replace((0,), interval(AMOUNT, 0, Open(100000)), lambda x: F.lit(7.0)).remove(interval(AMOUNT, 900000, TOP))
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    rows = f.intersection(other, lambda a, b: a - b).evaluate(rows, ["o_totalprice"], "both_there")
    rows = mapped.evaluate(rows, ["o_totalprice"], "mapped")
    return replaced.evaluate(rows, ["o_totalprice"], "replaced").drop("o_totalprice")


@query("SELECT o_orderkey, o_totalprice + 2 * (o_orderkey % 7) AS value, o_totalprice + 6 AS slice, CAST(2 AS BIGINT) AS size, true AS defined FROM orders")
def function_dimensions(spark, d):
    """extrudeDimension, getByDimension, look-ups of functions of two dimensions."""
    n = Dim("n", "double", "continuous")
    f = FunctionFrame.of(spark, [AMOUNT, n], [([C.unbounded(AMOUNT), interval(n, 0, Open(4))], lambda x, y: x + 2 * y), ([C.unbounded(AMOUNT), interval(n, 4, TOP)], lambda x, y: x + y + y)])
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 7).cast("double").alias("n"))
    out = f.slice_at("n", 3.0).evaluate(f.evaluate(rows, ["o_totalprice", "n"]), ["o_totalprice"], "slice")
    return out.select("o_orderkey", "value", "slice", F.lit(f.size()).cast("bigint").alias("size"), F.lit(f.is_defined_at(1.0, 2.0)).alias("defined"))


# --- JSON, facts ---
@query(f"WITH {SESSIONS_SQL} SELECT user_id, a sec_lo, b sec_hi FROM ses")
def json_shapes(spark, d):
    """Regions as JSON arrays of intervals, one a user, and back."""
    s = sessions(spark, d)
    back = codec.from_whole_json(codec.whole_json(s), [SEC], None, keys=("user_id",))
    return shown(back)


@query(_sets("SELECT * FROM one"))
def json_sets(spark, d):
    """Sets of values as JSON and back."""
    return _shown_sets(codec.multi_from_json(codec.multi_json(_flags(spark, d)), [DAY], keys=("o_custkey",)))


@query(f"WITH {line('o_orderstatus', 'p')} SELECT o_custkey, lo day_lo, hi day_hi, v AS value FROM p")
def json_actions(spark, d):
    """Difference actions written as JSON, read back and applied."""
    old, new = priority(spark, d), status(spark, d)
    texts = codec.actions_json(new.diff_actions_from(old), new)
    return shown(codec.upsert_by_start(old, codec.actions_from_json(texts, [DAY], keys=("o_custkey",))))


@query("SELECT 'c' AS now, CAST(3 AS BIGINT) AS n, CAST(1 AS BIGINT) AS current, CAST(2 AS BIGINT) AS n_rows, 'orders/[*]/lines/[2:]/parts/[0:3]/[7]' AS path, 'prefix' AS compared, CAST(5 AS BIGINT) AS monoid FROM range(1)")
def json_documents(spark, d):
    """Variables, versioned data and monoids as JSON documents; parsed paths and their comparison."""
    v = codec.variable_from_json(codec.variable_json(Variable.of(spark, "a").set("b", now=100).set("c", now=100)))
    w = Versioned.from_frame(IntervalFrame.of(spark, [DAY], [(interval(DAY, B1, B2), "x")]), now=0).increment(now=1).set(interval(DAY, B2, TOP), "y")
    back = codec.versioned_from_json(spark, codec.versioned_json(w).first()[0], [DAY])
    m = Shape.of_boxes(spark, [SEC], [interval(SEC, 0, 9)]).with_monoid_value(5)
    path = codec.parse_path("orders[*]/lines[2:]/parts[:3]/7")
    monoid = codec.monoid_from_json(codec.to_json(m), [SEC], "bigint")
    return one_row(spark, now=v.get(), n=v.history().count(), current=back.current, n_rows=back.selected().size(), path=codec.path_text(path), compared=codec.compare(path, codec.parse_path("orders")), monoid=int(monoid.get_at(3).first()[0]))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_all_elements(spark, d):
    """Folds over [*]: the events of a type as one array, folded without exploding rows."""
    events = read(spark, d, "events")
    docs = F.concat(F.lit('{"rows":['), F.col("props"), F.lit("]}"))
    return events.groupBy("event_type").agg(F.sum(codec.fold_path(docs, "rows[*]/k", F.lit(0).cast("bigint"), lambda a, x: a + x, "bigint")).alias("total"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'normal' END AS speed, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS state FROM orders WHERE o_totalprice > 1000""")
def facts_filtered(spark, d):
    """Facts with select, augment and redact filters in a chain; merge by replacement; to and from rows."""
    orders = read(spark, d, "orders")
    facts = R.facts_from(orders, "o_orderkey", o_totalprice="double", o_orderpriority="string", o_orderstatus="string")
    steps = R.chain(
        R.select(R.greater("o_totalprice", 1000.0)), R.augment(R.ANYTHING, R.attributes(speed="normal")), R.augment(R.equals("o_orderpriority", "1-URGENT"), R.attributes(speed="rush"), "as_replacement"),
        R.redact(R.equals("o_orderstatus", "F"), ["o_orderstatus"]),
    )
    return R.facts_to(steps(facts), speed="string", o_orderstatus="string").withColumnRenamed("o_orderstatus", "state")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(1 + CAST(o_orderkey % 2 = 0 AS INTEGER) AS BIGINT) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def facts_merged(spark, d):
    """mergeAll of facts by id; exclude and either (OrFilter)."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 2).alias("two"), (F.col("o_orderkey") % 3).alias("three"))
    facts = R.facts_from(orders, "o_orderkey", o_orderpriority="string", two="int", three="int")
    even = R.chain(R.select(R.equals("two", 0)), R.redact(R.ANYTHING, ["two", "three"]), R.augment(R.ANYTHING, R.attributes(even=True)))
    third = R.chain(R.select(R.equals("three", 0)), R.redact(R.ANYTHING, ["two", "three"]))
    out = R.chain(R.either(even, third), R.exclude(["none"]))(facts)
    return out.select("id", F.size("attributes").cast("bigint").alias("n"))


# --- worked examples ---
@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) s, max(value) m FROM events GROUP BY ALL), c AS (SELECT user_id, s, CASE WHEN m > 80 THEN 'high' WHEN m > 50 THEN 'raised' ELSE 'normal' END v FROM e),
t AS (SELECT user_id, s, v, lead(s) OVER (PARTITION BY user_id ORDER BY s) nx, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY s) = v THEN 0 ELSE 1 END n FROM c), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s) g FROM t)
SELECT user_id, min(s) day_lo, CASE WHEN count(nx) = count(*) THEN max(nx) END day_hi, max(v) AS value FROM i GROUP BY user_id, g""")
def clinical_categories(spark, d):
    """Readings as facts, categories by rules, and the timeline of each user's category."""
    from ..operators.frame import timeline

    daily = read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("s")).agg(F.max("value").alias("m"))
    attrs = R.attributes(reading=(F.col("m"), "double"))
    category = F.when(R.greater("reading", 80.0)(attrs), "high").when(R.greater("reading", 50.0)(attrs), "raised").otherwise("normal")
    return shown(timeline(daily.select("user_id", "s", category.alias("c")), DAY, F.col("s"), F.col("c"), ["user_id"], [F.col("c")]))


@query(f"""WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) s, o_orderpriority p FROM orders), cuts AS (SELECT o_custkey, s c FROM f UNION SELECT o_custkey, s + 90 FROM f), seg AS (SELECT o_custkey, c a, lead(c) OVER (PARTITION BY o_custkey ORDER BY c) b FROM cuts),
cell AS (SELECT g.o_custkey, g.a, g.b, array_to_string(list_sort(list(DISTINCT f.p)), ',') v FROM seg g JOIN f ON f.o_custkey = g.o_custkey AND f.s <= g.a AND g.b <= f.s + 90 GROUP BY ALL), {merged('cell', 'o_custkey', value=', v')} {SHOW} out""")
def feature_deployments(spark, d):
    """Features deployed for ninety days each: the set of features live at any time, slices of a frame of two dimensions (days and release)."""
    rows = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("s"), F.col("o_orderpriority").alias("value"))
    release = Dim("release")
    plan = IntervalFrame.from_df(rows, {DAY: (F.col("s"), F.date_add("s", 89)), release: (1, TOP)}, keys=["o_custkey"])
    live = IntervalFrame(plan.df.filter(release.covers(F.col("release_lo"), F.col("release_hi"), 3)), [DAY], ("value",), plan.keys)
    return _shown_sets(Multi.from_single(live))


@query(f"""WITH {line('o_orderstatus', 's')}, st AS (SELECT o_custkey, lo a, coalesce(hi, {END}) b, v FROM s), paid AS (SELECT o_custkey, DATE '1998-01-01' a, DATE '1999-01-01' b FROM st GROUP BY 1),
use AS (SELECT st.o_custkey, greatest(st.a, paid.a) a, least(st.b, paid.b) b, v FROM st JOIN paid ON st.o_custkey = paid.o_custkey AND st.a < paid.b AND paid.a < st.b)
SELECT p.o_custkey, CAST(365 AS BIGINT) AS prepaid, CAST(coalesce(sum(CASE WHEN v = 'F' THEN u.b - u.a END), 0) AS BIGINT) AS used, CAST(365 - coalesce(sum(CASE WHEN v = 'F' THEN u.b - u.a END), 0) AS BIGINT) AS refund FROM paid p LEFT JOIN use u ON u.o_custkey = p.o_custkey GROUP BY 1""")
def billing_refunds(spark, d):
    """A year prepaid for every customer; days without the billed status are refunded."""
    f = status(spark, d)
    year = interval(DAY, dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    paid = f._with(f._one(year, "paid").df)
    used = paid.zip(f.filter(F.col("value") == "F"))
    days = used.measured("n").groupBy("o_custkey").agg(F.sum("n").alias("used"))
    prepaid = paid.measured("prepaid").select("o_custkey", "prepaid")
    out = prepaid.join(days, "o_custkey", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("bigint"))
    return out.select("o_custkey", F.col("prepaid").cast("bigint").alias("prepaid"), "used", (F.col("prepaid") - F.col("used")).cast("bigint").alias("refund"))
