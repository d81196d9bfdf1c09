"""Queries over the driver's tables, each with SQL that gives the same rows.

Cubes: ``ship`` (lineitem by quantity, discount, tax, ship date and flags), ``ev`` (events by time, user and type),
``part`` (size by price) and ``cloud`` (the first two numbers of each embedding as a point).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import datetime as dt

from . import store
from .axes import Axis
from .cube import Cube
from .operators import areas, neighbours, points, results, transforms
from .plans import features
from .plans.request import Branch, Request, alternatives
from .shapes import All, Box, ConvexHull, Disk, Ellipsoid, Path, PathSegment, Point, Polygon, Product, Segment, Select, Shape, ShapePath, Span, Union
from .sources import cubes, grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QTY, DISC, TAX, DATE, FLAG, STATUS = "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"
SHIP_KEY = ["l_orderkey", "l_linenumber"]
AXES = {
    "lineitem": {QTY: Axis(QTY), DISC: Axis(DISC), TAX: Axis(TAX), DATE: Axis(DATE, "time", 0.0), FLAG: Axis(FLAG, "category"), STATUS: Axis(STATUS, "category")},
    "part": {"p_size": Axis("p_size"), "p_retailprice": Axis("p_retailprice")},
    "events": {"ts": Axis("ts", "time", 0.0), "user_id": Axis("user_id"), "event_type": Axis("event_type", "category")},
    "orders": {"o_orderdate": Axis("o_orderdate", "time", 0.0), "o_orderpriority": Axis("o_orderpriority", "category"), "o_totalprice": Axis("o_totalprice")},
}
VALUES = {"lineitem": [*SHIP_KEY, "l_extendedprice"], "part": ["p_partkey"], "events": ["event_id", "value"], "orders": ["o_orderkey"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cube(spark: SparkSession, sf_dir: str, table: str, axes: Sequence[str]) -> Cube:
    return Cube(_table(spark, sf_dir, table), list(axes), VALUES[table])


def _cut(name: str, table: str, *shapes: Shape, sql: str) -> None:
    """Registers a request over a table; ``sql`` is its condition, written by hand and not made of the shapes."""
    request = Request(*shapes)
    axes = [a for a in AXES[table] if a in request.axes]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cube(spark, sf_dir, table, axes).retrieve(request)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join([*axes, *VALUES[table]])} FROM {table} WHERE {sql}"


E12 = "1e-12"
near = lambda c, *vs: "(" + " OR ".join(f"abs({c} - {v!r}::DOUBLE) <= {E12}" for v in vs) + ")"
within = lambda c, a, b: f"{c} BETWEEN {a!r}::DOUBLE - {E12}::DOUBLE AND {b!r}::DOUBLE + {E12}::DOUBLE"
PRICE = "p_retailprice"
SLACK = "1e-9::DOUBLE"


def _turns(k: str = "k") -> tuple[str, str]:
    """The normal of the k-th side of the polygon with twelve sides around the unit circle: the sides touch it."""
    return f"cos(radians(15 + 30 * {k}))", f"sin(radians(15 + 30 * {k}))"


def _gon(x: str, y: str, cx: float, cy: float, rx: float, ry: float) -> str:
    """On the inner side of all twelve sides around an ellipse."""
    c, s = _turns()
    return f"list_max(list_transform(range(12), lambda k: {c} * ({x} - {cx}) / {rx}::DOUBLE + {s} * ({y} - {cy}) / {ry}::DOUBLE)) <= 1 + {SLACK}"


def _swept_box(x: str, y: str, half: tuple[float, float], way: Sequence[tuple[float, float]]) -> str:
    """In a box with some half sides at some moment of its way."""
    out = []
    for (x0, y0), (x1, y1) in zip(way, way[1:]):
        dx, dy, (hx, hy) = x1 - x0, y1 - y0, half
        near = lambda v, at, d, h, sign: f"({v} - {at} - {sign * h} * sign({d})) / ({d})::DOUBLE"
        firsts = [near(x, x0, dx, hx, 1), *([near(y, y0, dy, hy, 1)] if dy else [])]
        lasts = [near(x, x0, dx, hx, -1), *([near(y, y0, dy, hy, -1)] if dy else [])]
        out.append(f"(greatest(0, {', '.join(firsts)}) <= least(1, {', '.join(lasts)}) + {SLACK})")
    return " OR ".join(out)


def _swept_gon(x: str, y: str, radius: tuple[float, float], way: Sequence[tuple[float, float]]) -> str:
    """In the polygon with twelve sides around an ellipse at some moment of its way: each side gives a bound of the moment."""
    out, (c, s), (rx, ry) = [], _turns(), radius
    for (x0, y0), (x1, y1) in zip(way, way[1:]):
        out_by = f"({c} * ({x} - {x0}) / {rx}::DOUBLE + {s} * ({y} - {y0}) / {ry}::DOUBLE - 1)"
        along = f"({c} * ({x1 - x0}) / {rx}::DOUBLE + {s} * ({y1 - y0}) / {ry}::DOUBLE)"
        low = f"list_max(list_transform(range(12), lambda k: CASE WHEN {along} > 1e-12 THEN {out_by} / {along} ELSE 0 END))"
        high = f"list_min(list_transform(range(12), lambda k: CASE WHEN {along} < -1e-12 THEN {out_by} / {along} ELSE 1 END))"
        still = f"list_max(list_transform(range(12), lambda k: CASE WHEN abs({along}) <= 1e-12 THEN {out_by} ELSE -1 END)) <= {SLACK}"
        out.append(f"(greatest({low}, 0) <= least({high}, 1) + {SLACK} AND {still})")
    return " OR ".join(out)


def _hulled(x: str, y: str, box: tuple, gon: tuple) -> str:
    """In the hull of a box and a polygon with twelve sides: some mixture of both has the point on the inner side of all sides of either."""
    ((x0, x1), (y0, y1)), ((cx, cy), (rx, ry)) = box, gon
    c, s = _turns()
    normals = f"list_concat([[1e0, 0e0], [-1e0, 0e0], [0e0, 1e0], [0e0, -1e0]], list_transform(range(12), lambda k: [{c}, {s}]))"
    u = lambda v, at, r: f"(({v} - {at}) / {r}::DOUBLE)"
    of_box = f"(greatest(n[1] * {u(x0, cx, rx)}, n[1] * {u(x1, cx, rx)}) + greatest(n[2] * {u(y0, cy, ry)}, n[2] * {u(y1, cy, ry)}))"
    of_gon = "list_max(list_transform(range(12), lambda k: (n[1] * cos(radians(30 * k)) + n[2] * sin(radians(30 * k))) / cos(radians(15))))"
    a, b = f"(n[1] * {u(x, cx, rx)} + n[2] * {u(y, cy, ry)} - {of_box})", f"({of_gon} - {of_box})"
    low = f"list_max(list_transform({normals}, lambda n: CASE WHEN {b} > 1e-12 THEN {a} / {b} ELSE 0 END))"
    high = f"list_min(list_transform({normals}, lambda n: CASE WHEN {b} < -1e-12 THEN {a} / {b} ELSE 1 END))"
    still = f"list_max(list_transform({normals}, lambda n: CASE WHEN abs({b}) <= 1e-12 THEN {a} ELSE -1 END)) <= {SLACK}"
    return f"(greatest({low}, 0) <= least({high}, 1) + {SLACK} AND {still})"


def _grown(x: str, y: str, boxes: Sequence[tuple]) -> str:
    """In the hull of two boxes that follow each other: their sides move evenly from the one's to the other's."""
    out = []
    for first, second in zip(boxes, boxes[1:]):
        firsts, lasts, still = ["0"], ["1"], ["true"]
        for v, (a0, a1), (b0, b1) in zip((x, y), first, second):
            # a0 + t (b0 - a0) <= v <= a1 + t (b1 - a1)
            for sign, a, b in ((1, a0, b0), (-1, a1, b1)):
                d = round(sign * (b - a), 12)  # sign * (v - a) >= t * d
                at = f"(({v} - {a}::DOUBLE) * {sign} / {d}::DOUBLE)"
                (lasts if d > 0 else firsts if d < 0 else still).append(at if d else f"({v} - {a}) * {sign} >= -1e-12")
        out.append(f"(greatest({', '.join(firsts)}) <= least({', '.join(lasts)}) + {SLACK} AND {' AND '.join(still)})")
    return " OR ".join(out)


Y97, Y98 = dt.datetime(1997, 1, 1), dt.datetime(1998, 12, 31)
YEARS = f"{DATE} BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'"

_cut("slice_minimum", "lineitem", Select(FLAG, ["R"]), Box([DISC, QTY], [0.02, 10], [0.05, 20]), Span(DATE, Y97, Y98),
     sql=f"{FLAG} = 'R' AND {within(DISC, .02, .05)} AND {within(QTY, 10.0, 20.0)} AND {YEARS}")
_cut("box_2d", "lineitem", Box([QTY, DISC], [10, 0.02], [12, 0.04]), sql=f"{within(QTY, 10.0, 12.0)} AND {within(DISC, .02, .04)}")
_cut("box_3d", "lineitem", Box([QTY, DISC, TAX], [10, 0.02, 0.01], [20, 0.06, 0.03]),
     sql=f"{within(QTY, 10.0, 20.0)} AND {within(DISC, .02, .06)} AND {within(TAX, .01, .03)}")
_cut("box_4d", "lineitem", Box([QTY, DISC, TAX, DATE], [5, 0.0, 0.02, Y97], [30, 0.05, 0.06, Y98]),
     sql=f"{within(QTY, 5.0, 30.0)} AND {within(DISC, 0.0, .05)} AND {within(TAX, .02, .06)} AND {YEARS}")
_cut("select_numeric", "lineitem", Select(DISC, [0.01, 0.07]), Span(QTY, 1, 3), sql=f"{near(DISC, .01, .07)} AND {within(QTY, 1.0, 3.0)}")
_cut("select_many", "lineitem", Select(QTY, [x / 2 for x in range(1, 90)]), Select(DISC, [0.03]), sql=f"{QTY} * 2 = floor({QTY} * 2) AND {QTY} <= 44.5 AND {near(DISC, .03)}")
_cut("select_categorical", "lineitem", Select(FLAG, ["A", "N"]), Select(STATUS, ["F"]), Select(QTY, [7]),
     sql=f"{FLAG} IN ('A', 'N') AND {STATUS} = 'F' AND {QTY} = 7")
_cut("select_duplicates", "lineitem", Select(QTY, [50, 50.0, 50]), sql=f"{QTY} = 50")
_cut("select_nothing", "lineitem", Select(QTY, [0.5]), sql="false")
_cut("span", "lineitem", Span(DATE, dt.datetime(1998, 6, 1), dt.datetime(1998, 6, 30)), sql=f"{DATE} BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-30'")
_cut("span_reversed", "lineitem", Span(QTY, 4, 2), sql=f"{QTY} BETWEEN 2 AND 4")
_cut("span_open", "lineitem", Span(QTY, 49), sql=f"{QTY} >= 49")
_cut("all_axis", "part", All("p_size"), Span("p_retailprice", 900, 910), sql=f"p_size IS NOT NULL AND {within('p_retailprice', 900.0, 910.0)}")
_cut("point_2d", "lineitem", Point([QTY, DISC], [[25, 0.06]]), sql=f"{QTY} = 25 AND {near(DISC, .06)}")
_cut("product", "lineitem", Product(Select(FLAG, ["R"]), Span(QTY, 40, 42)), Box([DISC], [0.0], [0.01]),
     sql=f"{FLAG} = 'R' AND {QTY} BETWEEN 40 AND 42 AND {within(DISC, 0.0, .01)}")
_cut("disk", "lineitem", Disk([QTY, DISC], [15, 0.05], [6, 0.03]), sql=_gon(QTY, DISC, 15, 0.05, 6, 0.03))
_cut("disk_exact", "part", Disk(["p_size", "p_retailprice"], [25, 950], [10, 30], exact=True),
     sql="pow((p_size - 25) / 10e0, 2) + pow((p_retailprice - 950e0) / 30e0, 2) <= 1 + 1e-9")
_cut("disk_time", "events", Disk(["ts", "user_id"], [dt.datetime(2024, 1, 10), 50], [5 * 86400, 20]),
     sql=_gon("(epoch_us(ts) / 1e6)", "user_id", 1704844800, 50, 432000, 20))
_cut("disk_flat", "part", Disk(["p_size", PRICE], [25, 950], [0, 30]), sql=f"p_size = 25 AND abs({PRICE} - 950) <= 30 / cos(radians(15)) + 1e-9")
# the normals of an icosahedron are the corners of a dodecahedron; its inner radius is that of an edge of 2 sqrt(3) / tan(half of 138.19 degrees)
_cut("ellipsoid", "lineitem", Ellipsoid([QTY, DISC, TAX], [25, 0.05, 0.04], [10, 0.03, 0.02]),
     sql=f"""(SELECT greatest(u + v + w, v * g + w / g, u / g + w * g, u * g + v / g) FROM (SELECT (1 + sqrt(5)) / 2 AS g,
       abs({QTY} - 25) / 10 AS u, abs({DISC} - 0.05::DOUBLE) / 0.03::DOUBLE AS v, abs({TAX} - 0.04::DOUBLE) / 0.02::DOUBLE AS w))
       <= sqrt(3) * (3 + sqrt(5)) / (4 * sqrt(3)) * 2 * sqrt(3) / tan(radians(138.19 / 2)) + {SLACK}""")  # fmt: skip
_cut("convex_hull", "part", ConvexHull(["p_size", "p_retailprice"], [[5, 905], [40, 920], [30, 990], [10, 960], [20, 930]]),
     sql=f"""35 * ({PRICE} - 905) - 15 * (p_size - 5) >= -1e-6 AND -10 * ({PRICE} - 920) - 70 * (p_size - 40) >= -1e-6
       AND -20 * ({PRICE} - 990) + 30 * (p_size - 30) >= -1e-6 AND -5 * ({PRICE} - 960) + 55 * (p_size - 10) >= -1e-6""")  # fmt: skip
_cut("convex_hull_4d", "lineitem", ConvexHull([QTY, DISC, TAX, DATE], [
    [10, 0.0, 0.0, Y97], [40, 0.02, 0.01, Y97], [20, 0.1, 0.02, Y97], [15, 0.03, 0.08, Y97], [25, 0.05, 0.04, dt.datetime(2001, 1, 1)]]),
     sql=f"""(SELECT least(s, a, b, c, 1 - s - a - b - c) FROM (SELECT s, (74 * x - 7 * y - 2 * z) / 206 AS a, (-13 * x + 23.5 * y - 8 * z) / 206 AS b, (-6 * x - 5 * y + 28 * z) / 206 AS c
       FROM (SELECT s, {QTY} / 10 - 2.5 * s - (1 - s) AS x, {DISC} * 100 - 5 * s AS y, {TAX} * 100 - 4 * s AS z
       FROM (SELECT (epoch_us({DATE}) - 852076800000000) / 126230400000000e0 AS s)))) >= -1e-9""")  # fmt: skip
_cut("polygon_concave", "part", Polygon(["p_size", "p_retailprice"], [[5, 905], [45, 905], [25, 940], [45, 990], [5, 990]]),
     sql=f"p_size >= 5 AND {PRICE} BETWEEN 905 AND 990 AND p_size <= 25 + 20 * CASE WHEN {PRICE} < 940 THEN (940 - {PRICE}) / 35 ELSE ({PRICE} - 940) / 50 END + 1e-7")
_cut("polygon_crossing", "part", Polygon(["p_size", "p_retailprice"], [[5, 905], [45, 990], [45, 905], [5, 990]]),
     sql=f"p_size BETWEEN 5 AND 45 AND abs({PRICE} - 947.5) / 42.5 <= abs(p_size - 25) / 20 + 1e-9")
_cut("polygon_degenerate", "part", Polygon(["p_size", "p_retailprice"], [[10, 910], [10, 960], [10, 910]]), sql="p_size = 10 AND p_retailprice BETWEEN 910 AND 960")
_cut("union_overlap", "lineitem", Union([QTY, DISC], Box([QTY, DISC], [10, 0.0], [20, 0.03]), Box([QTY, DISC], [15, 0.02], [25, 0.05])),
     sql=f"({within(QTY, 10.0, 20.0)} AND {within(DISC, 0.0, .03)}) OR ({within(QTY, 15.0, 25.0)} AND {within(DISC, .02, .05)})")
_cut("union_disjoint", "lineitem", Union([QTY], Span(QTY, 1, 2), Span(QTY, 49, 50)), Select(FLAG, ["N"]), sql=f"({QTY} <= 2 OR {QTY} >= 49) AND {FLAG} = 'N'")
HUNDRED = [((3 + 7 * i) % 49 + 1, round((i % 11) / 100, 2)) for i in range(100)]
_cut("union_hundred_boxes", "lineitem", Union([QTY, DISC], *[Box([QTY, DISC], [q, d], [q + 0.5, d + 0.005]) for q, d in HUNDRED]),
     sql=f"""EXISTS (SELECT 1 FROM range(100) r(i) WHERE {QTY} BETWEEN (3 + 7 * i) % 49 + 1 AND (3 + 7 * i) % 49 + 1.5
       AND {DISC} BETWEEN (i % 11) / 100 - {E12} AND (i % 11) / 100 + 0.005::DOUBLE + {E12})""")  # fmt: skip
_cut("path_segment_box", "lineitem", PathSegment([QTY, DISC], Box([QTY, DISC], [-2, -0.01], [2, 0.01]), [10, 0.02], [40, 0.08]), sql=_swept_box(QTY, DISC, (2, 0.01), [(10, 0.02), (40, 0.08)]))
_cut("path_box", "lineitem", Path([QTY, DISC], Box([QTY, DISC], [-1, -0.01], [1, 0.01]), [5, 0.0], [25, 0.1], [45, 0.0]), sql=_swept_box(QTY, DISC, (1, 0.01), [(5, 0.0), (25, 0.1), (45, 0.0)]))
_cut("path_closed", "lineitem", Path([QTY, DISC], Disk([QTY, DISC], [0, 0], [2, 0.01]), [10, 0.02], [40, 0.02], [25, 0.09], closed=True),
     sql=_swept_gon(QTY, DISC, (2, 0.01), [(10, 0.02), (40, 0.02), (25, 0.09), (10, 0.02)]))
_cut("segment", "lineitem", Segment([QTY, DISC], Box([QTY, DISC], [5, 0.0], [10, 0.02]), Disk([QTY, DISC], [40, 0.08], [5, 0.02])),
     sql=_hulled(QTY, DISC, ((5, 10), (0.0, 0.02)), ((40, 0.08), (5, 0.02))))
_cut("shape_path", "lineitem", ShapePath([QTY, DISC], Box([QTY, DISC], [5, 0.0], [8, 0.02]), Box([QTY, DISC], [20, 0.05], [24, 0.07]), Box([QTY, DISC], [40, 0.0], [44, 0.02])),
     sql=_grown(QTY, DISC, [((5, 8), (0.0, 0.02)), ((20, 24), (0.05, 0.07)), ((40, 44), (0.0, 0.02))]))


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# --- snapping -------------------------------------------------------------------------------------------------

_AROUND = """SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_size BETWEEN {lo} AND {hi}
  AND (p_retailprice = (SELECT max(p_retailprice) FROM part WHERE p_retailprice < {v}) OR abs(p_retailprice - {v}) <= 1e-12
    OR p_retailprice = (SELECT min(p_retailprice) FROM part WHERE p_retailprice > {v} + 1e-12))"""


def _snap(name: str, value: float, method: str, sql: str) -> None:
    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cube = _cube(spark, sf_dir, "part", ["p_size", "p_retailprice"])
        return cube.retrieve(Request(Span("p_size", 1, 50), Select("p_retailprice", [value], method=method)))


_snap("surrounding", 950.05, "surrounding", _AROUND.format(lo=1, hi=50, v="950.05::DOUBLE"))
_snap("surrounding_edge", 100.0, "surrounding", _AROUND.format(lo=1, hi=50, v="100.0::DOUBLE"))
_snap("nearest_1d", 933.337, "nearest", """SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_retailprice =
  (SELECT p_retailprice FROM part ORDER BY abs(p_retailprice - 933.337::DOUBLE), p_retailprice LIMIT 1)""")


@_query("surrounding_point", f"""SELECT {QTY}, {DISC}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {QTY} IN (25, 26)
  AND {DISC} IN ((SELECT max({DISC}) FROM lineitem WHERE {DISC} < 0.065::DOUBLE), (SELECT min({DISC}) FROM lineitem WHERE {DISC} > 0.065::DOUBLE))""")
def surrounding_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir, "lineitem", [QTY, DISC]).retrieve(Request(Point([QTY, DISC], [[25.5, 0.065]], method="surrounding")))


# --- axis transformations -------------------------------------------------------------------------------------

_MINUTE = "hour(ts) * 60 + minute(ts)"


def _minutes(spark: SparkSession, sf_dir: str) -> Cube:
    rows = _table(spark, sf_dir, "events").select("event_id", "value", (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"))
    return Cube(rows, [Axis("minute", period=(0.0, 1440.0))], ["event_id", "value"])


@_query("cyclic_seam", f"SELECT m::DOUBLE AS minute, event_id, value FROM (SELECT *, {_MINUTE} AS m FROM events) WHERE m >= 1430 OR m <= 20")
def cyclic_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, sf_dir).retrieve(Request(Span("minute", -10, 20)))


@_query("cyclic_multi_lap", f"""SELECT m::DOUBLE AS minute, event_id, value, (m + 1440 * k)::DOUBLE AS minute_unwrapped
  FROM (SELECT *, {_MINUTE} AS m FROM events), range(-2, 4) r(k) WHERE m + 1440 * k BETWEEN 1400 AND 4400""")
def cyclic_multi_lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, sf_dir).retrieve(Request(Span("minute", 1400, 4400)), distinct=False)


@_query("cyclic_disk", f"""SELECT m::DOUBLE AS minute, user_id, event_id FROM (SELECT *, {_MINUTE} AS m FROM events)
  WHERE pow(least(m, 1440 - m) / 60e0, 2) + pow((user_id - 50) / 30e0, 2) <= 1 + 1e-9""")
def cyclic_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"))
    cube = Cube(rows, [Axis("minute", period=(0.0, 1440.0)), "user_id"], ["event_id"])
    return cube.retrieve(Request(Disk(["minute", "user_id"], [0, 50], [60, 30], exact=True)))


@_query("merge_datetime", "SELECT event_id, date_trunc('minute', ts) AS at FROM events WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-05 06:00' AND TIMESTAMP '2024-01-07 18:00'")
def merge_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("date"), F.date_format("ts", "HHmm").alias("time"))
    cube = Cube(transforms.merged(parts, "date", "time", into="at"), ["at"], ["event_id"])
    return cube.retrieve(Request(Span("at", dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 7, 18))))


@_query("unmerge_datetime", "SELECT event_id, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H%M') AS time FROM events")
def unmerge_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.unmerged(_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at")), "at", "date", "time")


def _typed(name: str, text: str, type_name: str, keep: tuple[object, object], sql: str) -> None:
    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = transforms.retyped(_table(spark, sf_dir, "events").select("event_id", F.expr(text).alias("axis")), "axis", type_name)
        return transforms.stored(Cube(rows, ["axis"], ["event_id"]).retrieve(Request(Span("axis", *keep))).withColumn("text", F.col("axis")), "text", type_name)


_typed("type_change_int", "cast(user_id as string)", "int", (10, 20), "SELECT user_id AS axis, event_id, user_id::VARCHAR AS text FROM events WHERE user_id BETWEEN 10 AND 20")
_typed("type_change_float", "cast(user_id / 2 as string)", "float", (5, 7.5),
       "SELECT user_id / 2e0 AS axis, event_id, CASE WHEN user_id % 2 = 0 THEN (user_id // 2)::VARCHAR ELSE (user_id / 2e0)::VARCHAR END AS text FROM events WHERE user_id BETWEEN 10 AND 15")
_typed("type_change_time", "date_format(ts, 'HHmm')", "time", (3600 * 5, 3600 * 6),
       "SELECT (hour(ts) * 3600 + minute(ts) * 60)::BIGINT AS axis, event_id, strftime(ts, '%H%M') AS text FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 300 AND 360")
_typed("type_change_date", "date_format(ts, 'yyyyMMdd')", "date", (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4)),
       "SELECT date_trunc('day', ts)::TIMESTAMP AS axis, event_id, strftime(ts, '%Y%m%d') AS text FROM events WHERE date_trunc('day', ts) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'")
_STEP = "concat(hour(ts), 'h', minute(ts), 'm')"
_typed("type_change_subhourly", "concat(hour(ts), 'h', minute(ts), 'm')", "subhourly_step", (0, 7200),
       """SELECT s AS axis, event_id, CASE WHEN s % 3600 = 0 THEN (s // 3600)::VARCHAR ELSE CASE WHEN s >= 3600 THEN (s // 3600) || 'h' ELSE '' END || (s % 3600 // 60) || 'm' END AS text
       FROM (SELECT *, (hour(ts) * 3600 + minute(ts) * 60)::BIGINT AS s FROM events) WHERE s <= 7200""")  # fmt: skip
_typed("type_change_subhourly_compact", "concat(hour(ts) * 60 + minute(ts), 'm')", "subhourly_step_compact", (0, 7200),
       """SELECT s AS axis, event_id, CASE WHEN s % 3600 = 0 THEN (s // 3600)::VARCHAR ELSE (s // 60) || 'm' END AS text
       FROM (SELECT *, (hour(ts) * 3600 + minute(ts) * 60)::BIGINT AS s FROM events) WHERE s <= 7200""")  # fmt: skip


@_query("type_change_failed", "SELECT event_type AS axis, event_id FROM events WHERE event_type = 'click'")
def type_change_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transforms.retyped(_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("axis")), "axis", "int")
    return Cube(rows, ["axis"], ["event_id"]).retrieve(Request(Select("axis", ["click"])))


@_query("reverse", "SELECT p_size, p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 ORDER BY p_size DESC")
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cube(_table(spark, sf_dir, "part"), [Axis("p_size", reverse=True)], ["p_partkey"])
    return transforms.in_axis_order(cube.retrieve(Request(Span("p_size", 10, 12))), cube.axes)


# --- grids ----------------------------------------------------------------------------------------------------


def _rounded(cells: DataFrame) -> DataFrame:
    return cells.select("cell", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@_query("grid_regular", """SELECT (i * 64 + j)::BIGINT AS cell, round(90 - i * 5.625, 6)::DOUBLE AS lat, round(j * 5.625, 6)::DOUBLE AS lon FROM range(32) a(i), range(64) b(j)
  WHERE 90 - i * 5.625 BETWEEN -20 AND 45 AND (j * 5.625 >= 350 OR j * 5.625 <= 30)""")
def grid_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grids.regular(16).cells(spark, (-20, 45), (-10, 30)))


@_query("grid_local", """SELECT (i * 21 + j)::BIGINT AS cell, round(-10 + i * 2, 6)::DOUBLE AS lat, round(30 + j * 1.5, 6)::DOUBLE AS lon FROM range(11) a(i), range(21) b(j) WHERE 30 + j * 1.5 <= 40""")
def grid_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grids.local_regular([-10, 10, 30, 60], (10, 20)).cells(spark, (-10, 10), (20, 40)))


#: The positive nodes of Gauss-Legendre quadrature with 16 and 32 points, as tables have them.
NODES_16 = (
    0.9894009349916499, 0.9445750230732326, 0.8656312023878318, 0.7554044083550030,
    0.6178762444026438, 0.4580167776572274, 0.2816035507792589, 0.0950125098376374,
)
NODES_32 = (
    0.9972638618494816, 0.9856115115452684, 0.9647622555875064, 0.9349060759377397, 0.8963211557660521, 0.8493676137325700,
    0.7944837959679424, 0.7321821187402897, 0.6630442669302152, 0.5877157572407623, 0.5068999089322294, 0.4213512761306353,
    0.3318686022821277, 0.2392873622521371, 0.1444719615827965, 0.0483076656877383,
)


def _gaussian(nodes: Sequence[float], counts: Sequence[int]) -> str:
    """(lat, n, base) of each row of a Gaussian grid, from published nodes and the points of its northern rows."""
    rows = [(z, c) for z, c in zip(nodes, counts)]
    rows += [(-z, c) for z, c in reversed(rows)]
    listed = ", ".join(f"({i}, {z!r}::DOUBLE, {c})" for i, (z, c) in enumerate(rows))
    return f"SELECT degrees(asin(z)) AS lat, n, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS base FROM (VALUES {listed}) r(i, z, n)"


_OCTAHEDRAL_16 = _gaussian(NODES_32, range(20, 84, 4))
_REDUCED = (2, 6, 12, 18, 20, 18, 12, 6, 2)
_REDUCED_LL = f"""SELECT 90 - i * 22.5::DOUBLE AS lat, n, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS base FROM (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(_REDUCED))}) r(i, n)"""


def _around(rows: str) -> str:
    """(cell, lat, lon) of rows around the circle that start at the first meridian."""
    return f"SELECT (base + j)::BIGINT AS cell, lat, j * 360e0 / n AS lon FROM ({rows}), LATERAL (SELECT unnest(range(n)) AS j)"


def _healpix(n: int) -> str:
    """(cell, lat, lon) in ring order: the height of a ring is quadratic in its number in the caps and linear between them."""
    ring = f"SELECT i, least(i, {n}, {4 * n} - i) AS w FROM range(1, {4 * n}) r(i)"
    height = f"CASE WHEN i < {n} THEN 1 - i * i / {3 * n * n}e0 WHEN i <= {3 * n} THEN {4 / 3!r} - 2 * i / {3 * n}e0 ELSE ({4 * n} - i) * ({4 * n} - i) / {3 * n * n}e0 - 1 END"
    rows = f"SELECT i, w, degrees(asin({height})) AS lat, (sum(4 * w) OVER (ORDER BY i) - 4 * w)::BIGINT AS base, CASE WHEN w < {n} OR (i - {n}) % 2 = 0 THEN 0.5 ELSE 0 END AS shift FROM ({ring})"
    return f"SELECT (base + j)::BIGINT AS cell, lat, (j + shift) * 90e0 / w AS lon FROM ({rows}), LATERAL (SELECT unnest(range(4 * w)) AS j)"


def _nested_healpix(n: int) -> str:
    """(cell, lat, lon) in nested order, from the bits of the number: face, then those of the two diagonals in turn."""
    bits = n.bit_length() - 1
    pick = lambda side: " + ".join(f"((c >> {2 * i + side}) & 1) * {1 << i}" for i in range(bits))
    cells = f"SELECT c, c // {n * n} AS f, {pick(0)} AS x, {pick(1)} AS y FROM range({12 * n * n}) r(c)"
    rings = f"SELECT c, f, x, y, (f // 4 + 2) * {n} - x - y - 1 AS i FROM ({cells})"
    rings = f"SELECT *, least(i, {n}, {4 * n} - i) AS w FROM ({rings})"
    height = f"CASE WHEN i < {n} THEN 1 - i * i / {3 * n * n}e0 WHEN i <= {3 * n} THEN {4 / 3!r} - 2 * i / {3 * n}e0 ELSE ({4 * n} - i) * ({4 * n} - i) / {3 * n * n}e0 - 1 END"
    turn = "CASE WHEN f BETWEEN 4 AND 7 THEN 2 * (f - 4) ELSE 2 * (f % 4) + 1 END"
    lon = f"(({turn}) + (x - y) / w::DOUBLE) * 45"
    return f"SELECT c::BIGINT AS cell, degrees(asin({height})) AS lat, CASE WHEN {lon} < 0 THEN {lon} + 360 ELSE {lon} END AS lon FROM ({rings})"


#: A conformal cone that touches the sphere at 45 degrees: its angles are those of longitude times sin(45).
_LAMBERT = """WITH k AS (SELECT sqrt(0.5) AS n, 6371229e0 AS r), c AS (SELECT n, r / tan(radians(45)) AS top, r / tan(radians(45)) * pow(tan(radians(67.5)), n) AS f FROM k),
  o AS (SELECT n, top, f, f / pow(tan(radians(60)), n) AS rho, n * radians(-20) AS turn FROM c),
  g AS (SELECT j * 60 + i AS cell, n, top, f, rho * sin(turn) + i * 50000 AS x, top - rho * cos(turn) + j * 50000 AS y FROM o, range(60) a(i), range(50) b(j))
  SELECT cell::BIGINT AS cell, degrees(2 * atan(pow(f / sqrt(x * x + (top - y) * (top - y)), 1 / n))) - 90 AS lat,
  (degrees(atan2(x, top - y) / n) + 10 + 360) % 360 AS lon FROM g"""


def _grid(name: str, make: Callable, lat: tuple[float, float], lon: tuple[float, float], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(make().cells(spark, lat, lon))
    ORACLES[name] = f"SELECT cell, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({sql}) WHERE lat BETWEEN {lat[0] - 1e-9} AND {lat[1] + 1e-9} AND lon BETWEEN {lon[0] - 1e-9} AND {lon[1] + 1e-9}"


_grid("grid_octahedral", lambda: grids.octahedral(16), (10, 60), (100, 200), _around(_OCTAHEDRAL_16))
_grid("grid_reduced_gaussian", lambda: grids.reduced_gaussian(8, [18, 25, 36, 40, 45, 54, 60, 64]), (-50, 50), (0, 90), _around(_gaussian(NODES_16, [18, 25, 36, 40, 45, 54, 60, 64])))
_grid("grid_reduced_ll", lambda: grids.reduced_ll(_REDUCED), (-90, 90), (0, 180), _around(_REDUCED_LL))
_grid("grid_healpix", lambda: grids.healpix(8), (-30, 70), (10, 300), _healpix(8))
_grid("grid_healpix_nested", lambda: grids.Nested(8), (-30, 70), (10, 300), _nested_healpix(8))


@_query("grid_lambert", f"SELECT cell, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({_LAMBERT})")
def grid_lambert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grids.Lambert(60, 50, 50_000, 50_000, 30.0, 350.0, 45.0, 10.0, 45.0, 45.0).cells(spark))


# --- cubes whose cells a grid numbers -------------------------------------------------------------------------


def _gridded(spark: SparkSession, sf_dir: str, mapper: dict, engines: dict | None = None, cyclic: bool = False) -> Cube:
    """Orders as fields: the number of an order is that of a cell, its priority another axis."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    axes: list[dict] = [{"axis_name": "o_orderkey", "transformations": [{"name": "mapper", "axes": ["lat", "lon"], **mapper}]}]
    if cyclic:
        axes.append({"axis_name": "lon", "transformations": [{"name": "cyclic", "range": [0, 360]}]})
    options = cubes.Options.parse({"axis_config": axes, "engine_options": engines or {}})
    return cubes.configured(orders, ["o_orderpriority", "o_orderkey"], ["o_orderkey", "o_totalprice"], options)


def _on_grid(name: str, mapper: dict, *shapes: Shape, cells: str, sql: str, cyclic: bool = False) -> None:
    @_query(name, f"SELECT o_orderpriority, round(lat, 6) AS lat, round(lon, 6) AS lon, o_orderkey, o_totalprice FROM orders JOIN ({cells}) ON cell = o_orderkey WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _gridded(spark, sf_dir, mapper, cyclic=cyclic).retrieve(Request(All("o_orderpriority"), *shapes))
        return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


_O16, _H16 = {"type": "octahedral", "resolution": 16}, {"type": "healpix", "resolution": 16}
_on_grid("gridded_box", _O16, Box(["lat", "lon"], [10, 20], [50, 80]), cells=_around(_OCTAHEDRAL_16), sql="lat BETWEEN 10 AND 50 AND lon BETWEEN 20 AND 80")
_on_grid("gridded_seam", _O16, Span("lat", -30, 30), Span("lon", -40, 10), cells=_around(_OCTAHEDRAL_16), sql="lat BETWEEN -30 AND 30 AND (lon >= 320 OR lon <= 10 + 1e-9)", cyclic=True)
_on_grid("gridded_disk", _H16, Disk(["lat", "lon"], [20, 180], [25, 60]), cells=_healpix(16), sql=_gon("lat", "lon", 20, 180, 25, 60))
_on_grid("gridded_nested", {"type": "healpix_nested", "resolution": 16}, Union(["lat", "lon"], Box(["lat", "lon"], [-20, 30], [10, 90]), Box(["lat", "lon"], [60, 200], [85, 330])),
         cells=_nested_healpix(16), sql="(lat BETWEEN -20 AND 10 AND lon BETWEEN 30 AND 90) OR (lat BETWEEN 60 AND 85 AND lon BETWEEN 200 AND 330)")
_on_grid("gridded_reduced_ll", {"type": "reduced_ll", "counts": list(_REDUCED)}, Box(["lat", "lon"], [-50, 0], [50, 200]), cells=_around(_REDUCED_LL), sql="lat BETWEEN -50 AND 50 AND lon BETWEEN 0 AND 200")
_on_grid("gridded_lambert", {"type": "lambert_conformal", "parameters": {"nx": 60, "ny": 50, "dx": 50_000, "dy": 50_000, "first_lat": 30.0, "first_lon": 350.0, "lad": 45.0, "lov": 10.0, "latin1": 45.0, "latin2": 45.0}},
         Box(["lat", "lon"], [35, 2], [45, 14]), cells=_LAMBERT, sql="lat BETWEEN 35 AND 45 AND lon BETWEEN 2 AND 14")
_LL_1441 = """SELECT lat, n, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS base FROM (SELECT i, 90 - i * 0.125e0 AS lat, greatest(2, 2 * ceil(1440 * sin(radians(i * 0.125e0)) - 0.25))::BIGINT AS n FROM range(1345) r(i))"""
_on_grid("gridded_reduced_ll_1441", {"type": "reduced_ll", "resolution": 1441}, Box(["lat", "lon"], [81, 30], [87.5, 200]), cells=_around(_LL_1441), sql="lat BETWEEN 81 AND 87.5 AND lon BETWEEN 30 AND 200")
_on_grid("gridded_regular", {"type": "regular", "resolution": 32}, Span("lat", 60, 80), Span("lon", -25, 25), cells="SELECT i * 128 + j AS cell, 90 - i * 2.8125e0 AS lat, j * 2.8125e0 AS lon FROM range(64) a(i), range(128) b(j)",
         sql="lat BETWEEN 60 AND 80 AND (lon >= 335 OR lon <= 25)", cyclic=True)
_on_grid("gridded_local", {"type": "local_regular", "resolution": [40, 50], "local": [35, 45, 5, 15]}, Disk(["lat", "lon"], [40, 10], [3, 4]), cells="SELECT i * 51 + j AS cell, 35 + i * 0.25e0 AS lat, 5 + j * 0.2e0 AS lon FROM range(41) a(i), range(51) b(j)",
         sql=_gon("lat", "lon", 40, 10, 3, 4))
_GAUSS_16 = [20, 27, 36, 40, 45, 50, 60, 64, 64, 72, 72, 75, 80, 80, 80, 80]
_on_grid("gridded_gaussian", {"type": "reduced_gaussian", "resolution": 16, "counts": _GAUSS_16}, Polygon(["lat", "lon"], [[10, 20], [70, 20], [70, 200], [40, 60]]), cells=_around(_gaussian(NODES_32, _GAUSS_16)),
         sql="lat <= 70 AND lon >= 20 AND lon <= CASE WHEN lat <= 40 THEN 20 + (lat - 10) * 4 / 3 ELSE 60 + (lat - 40) * 14 / 3 END + 1e-9")
# the nearest of all cells, around the circle; of two as near the one with the least coordinates
_NEAR = "(lat - ({a})) * (lat - ({a})) + pow(least(abs(lon - {o}), 360 - abs(lon - {o})), 2)"
_nearest = lambda a, o: f"cell IN (SELECT cell FROM ({_around(_OCTAHEDRAL_16)}) ORDER BY round({_NEAR.format(a=a, o=o)}, 9), lat, lon LIMIT 1)"
_on_grid("gridded_nearest", _O16, Union(["lat", "lon"], *[Point(["lat", "lon"], [p], method="nearest") for p in ([39, -76.45], [0.16, 359.9], [-61.5, 200])]),
         cells=_around(_OCTAHEDRAL_16), sql=" OR ".join(_nearest(a, o) for a, o in ((39, 283.55), (0.16, 359.9), (-61.5, 200))), cyclic=True)


@_query("nearest_of_cloud", "SELECT * FROM (" + " UNION ".join(
    f"(SELECT lat, lon, idx FROM ({{cloud}}) ORDER BY (lat - ({a})) * (lat - ({a})) + (lon - ({o})) * (lon - ({o})), lat, lon LIMIT {k})" for a, o, k in ((1, 2, 3), (-9.5, 31, 1))) + ")")
def nearest_of_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of one point and the nearest of another, under an engine of points."""
    cube = Cube(_cloud(spark, sf_dir), ["lat", "lon"], ["idx"], engines={"lat": "quadtree", "lon": "quadtree"})
    return cube.retrieve(Request(Union(["lat", "lon"], Point(["lat", "lon"], [[1, 2]], "nearest", 3), Point(["lat", "lon"], [[-9.5, 31]], "nearest"))))


_STATIONS = "SELECT p_partkey AS cell, 80 - (p_partkey // 25) * 2e0 AS lat, p_partkey % 25 * 14.4 AS lon FROM part"


@_query("gridded_cloud", f"""SELECT o_orderpriority, lat, lon, o_orderkey, o_totalprice FROM orders JOIN ({_STATIONS}) ON cell = o_orderkey
  WHERE {_gon('lat', 'lon', 60, 0, 15, 40)} OR {_gon('lat', 'lon', 60, 360, 15, 40)}""")
def gridded_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fields on a list of points that is a table: a disk over the seam."""
    points_of = _table(spark, sf_dir, "part").selectExpr("p_partkey AS cell", "80 - floor(p_partkey / 25) * 2e0 AS lat", "p_partkey % 25 * 14.4e0 AS lon")
    return _gridded(spark, sf_dir, {"type": "unstructured", "points": points_of}, cyclic=True).retrieve(Request(All("o_orderpriority"), Disk(["lat", "lon"], [60, 0], [15, 40])))


@_query("gridded_icon", f"""SELECT o_orderpriority, lat, lon, o_orderkey, o_totalprice FROM orders JOIN ({_STATIONS}) ON cell = o_orderkey
  WHERE (lat, lon) IN (SELECT (lat, lon) FROM ({_STATIONS}) ORDER BY pow(lat - 33.3, 2) + pow(lon - 100, 2), lat, lon LIMIT 4)""")
def gridded_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four points of a list that are nearest to a place."""
    points_of = _table(spark, sf_dir, "part").selectExpr("p_partkey AS cell", "80 - floor(p_partkey / 25) * 2e0 AS lat", "p_partkey % 25 * 14.4e0 AS lon")
    return _gridded(spark, sf_dir, {"type": "icon", "points": points_of}).retrieve(Request(All("o_orderpriority"), Point(["lat", "lon"], [[33.3, 100]], "nearest", 4)))


@_query("dynamic_grid", f"SELECT o_orderpriority, round(lat, 6) AS lat, round(lon, 6) AS lon, o_orderkey, o_totalprice FROM orders JOIN ({_around(_OCTAHEDRAL_16)}) ON cell = o_orderkey WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN 0 AND 90")
def dynamic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that the store's description names, in place of the one that the options name."""
    mapper = {"name": "mapper", "type": "regular", "resolution": 8, "axes": ["lat", "lon"]}
    options = cubes.Options.parse({"dynamic_grid": True, "axis_config": [{"axis_name": "o_orderkey", "transformations": [mapper]}]}).with_grid(lambda: {"type": "octahedral", "resolution": 16})
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    cube = cubes.configured(orders, ["o_orderpriority", "o_orderkey"], ["o_orderkey", "o_totalprice"], options)
    found = cube.retrieve(Request(All("o_orderpriority"), Box(["lat", "lon"], [30, 0], [40, 90])))
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@_query("wire_tree", f"""SELECT o_orderpriority, round(lat, 6) AS lat, round(lon, 6) AS lon, o_orderkey, o_totalprice, n FROM orders JOIN ({_around(_OCTAHEDRAL_16)}) ON cell = o_orderkey
  JOIN (SELECT o_orderpriority, count(DISTINCT o_orderkey - r) AS n FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders
    JOIN ({_around(_OCTAHEDRAL_16)}) ON cell = o_orderkey WHERE lat BETWEEN 10 AND 50 AND lon BETWEEN 20 AND 80) GROUP BY 1) USING (o_orderpriority)
  WHERE lat BETWEEN 10 AND 50 AND lon BETWEEN 20 AND 80""")
def wire_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box as a tree whose last level is runs of cells, read back; n is how many runs its branch has."""
    cube = _gridded(spark, sf_dir, _O16)
    found = cube.retrieve(Request(All("o_orderpriority"), Box(["lat", "lon"], [10, 20], [50, 80])))
    trees = results.wired(found.withColumn("cell", F.col("o_orderkey")), ["o_orderpriority"], "cell", ["o_orderkey", "o_totalprice"])
    runs = trees.select(F.explode("tree").alias("t")).select(F.col("t.value").alias("o_orderpriority"), F.size("t.below.runs").cast("bigint").alias("n"))
    rows = results.unwired(trees, ["o_orderpriority"], "cell", ["o_orderkey", "o_totalprice"], grid=grids.octahedral(16))
    return rows.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)}).drop("cell").join(runs, "o_orderpriority")


@_query("grid_locate", "SELECT p_partkey, (p_size * 32 + p_partkey % 32)::BIGINT AS cell FROM part WHERE p_size < 16")
def grid_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = 11.25
    stations = _table(spark, sf_dir, "part").where("p_size < 16").select("p_partkey", (90 - F.col("p_size") * step).alias("lat"), (F.col("p_partkey") % 32 * step + 360).alias("lon"))
    return grids.regular(8).locate(stations).select("p_partkey", "cell")


# --- points in a plane ----------------------------------------------------------------------------------------

_CLOUD = "SELECT vec_id AS idx, round(90 * embedding[1]::DOUBLE, 6) AS lat, round(180 * embedding[2]::DOUBLE, 6) AS lon FROM embeddings"
ORACLES["nearest_of_cloud"] = ORACLES["nearest_of_cloud"].replace("{cloud}", _CLOUD)
_AREA = Polygon(["lat", "lon"], [[-10, -20], [12, -25], [4, 0], [15, 30], [-12, 25]])


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda i, f: F.round(F.col("embedding")[i].cast("double") * f, 6)
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), number(0, 90).alias("lat"), number(1, 180).alias("lon"))


def _in(name: str, shape: Shape, engine: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: points.points_in(_cloud(spark, sf_dir), shape, engine)
    ORACLES[name] = f"SELECT * FROM ({_CLOUD}) WHERE {sql}"


_LOWER = "CASE WHEN lon < -20 THEN -10 - 22 * (lon + 20) / 5 WHEN lon <= 25 THEN -10 - 2 * (lon + 20) / 45 ELSE -12 + 27 * (lon - 25) / 5 END"
_UPPER = "CASE WHEN lon < 0 THEN 4 - 8 * lon / 25 ELSE 4 + 11 * lon / 30 END"
_in("points_closed", _AREA, "quadtree", f"lon BETWEEN -25 AND 30 AND lat BETWEEN {_LOWER} - 1e-9 AND {_UPPER} + 1e-9")
_in("points_open", _AREA, "point_in_polygon", f"lon > -25 AND lon < 30 AND lat > {_LOWER} + 1e-7 AND lat < {_UPPER} - 1e-7")
_in("points_bbox", Box(["lat", "lon"], [-5, -10], [5, 10]), "quadtree_bbox", "lat BETWEEN -5 AND 5 AND lon BETWEEN -10 AND 10")
_in("points_hull_open", ConvexHull(["lat", "lon"], [[-5, -10], [5, -10], [5, 10], [-5, 10]]), "point_in_polygon_bbox", "lat > -5 AND lat < 5 AND lon > -10 AND lon < 10")

_AT = [(0.0, 0.0), (5.5, -20.25), (-9.0, 31.0), (80.0, 170.0)]
_KNN = f"""SELECT query, idx, lat, lon, dist2, rank FROM (SELECT q.query, p.*, (lat - a) * (lat - a) + (lon - o) * (lon - o) AS dist2,
  (row_number() OVER (PARTITION BY q.query ORDER BY (lat - a) * (lat - a) + (lon - o) * (lon - o), idx))::INT AS rank
  FROM ({_CLOUD}) p, (VALUES {', '.join(f'({i}, {a}::DOUBLE, {o}::DOUBLE)' for i, (a, o) in enumerate(_AT))}) q(query, a, o)) WHERE rank <= """
_query("nn_1", _KNN + "1")(lambda spark, sf_dir: points.nearest_points(_cloud(spark, sf_dir), _AT, 1))
_query("knn_k", _KNN + "5")(lambda spark, sf_dir: points.nearest_points(_cloud(spark, sf_dir), _AT, 5))


@_query("knn_within", f"""SELECT * FROM (SELECT q.idx AS query, p.*, (p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon) AS dist2,
  (row_number() OVER (PARTITION BY q.idx ORDER BY (p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon), p.idx))::INT AS rank
  FROM ({_CLOUD}) p JOIN ({_CLOUD}) q ON q.idx % 50 = 0 AND (p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon) <= 36 * (1 + 1e-12)) WHERE rank <= 3""")
def knn_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = _cloud(spark, sf_dir)
    asked = cloud.where("idx % 50 = 0").select(F.col("idx").alias("query"), "lat", "lon")
    return points.nearest_to_each(cloud, asked, radius=6.0, k=3)


@_query("knn_join", f"""SELECT * FROM (SELECT q.idx AS query, p.*, (p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon) AS dist2,
  (row_number() OVER (PARTITION BY q.idx ORDER BY (p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon), p.idx))::INT AS rank
  FROM ({_CLOUD}) p JOIN ({_CLOUD}) q ON q.idx % 50 = 0) WHERE rank <= 3""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``knn_within``, without a radius."""
    cloud = _cloud(spark, sf_dir)
    return neighbours.nearest_join(cloud, cloud.where("idx % 50 = 0").select(F.col("idx").alias("query"), "lat", "lon"), k=3)


@_query("nearest_many", f"""SELECT DISTINCT lat, lon, idx FROM (SELECT p.*, row_number() OVER (PARTITION BY i ORDER BY (lat - a) * (lat - a) + (lon - o) * (lon - o), lat, lon) AS rank
  FROM ({_CLOUD}) p, (SELECT i, i * 0.4 - 30 AS a, i * 7 % 100 - 50.25 AS o FROM range(150) r(i))) WHERE rank <= 2""")
def nearest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of each of 150 places in one request: their look-up is one join."""
    cube = Cube(_cloud(spark, sf_dir), ["lat", "lon"], ["idx"], engines={"lat": "quadtree", "lon": "quadtree"})
    return cube.retrieve(Request(Union(["lat", "lon"], *[Point(["lat", "lon"], [[i * 0.4 - 30, i * 7 % 100 - 50.25]], "nearest", 2) for i in range(150)])))


@_query("polygons_join", f"""SELECT p.*, c_custkey AS area FROM ({_CLOUD}) p JOIN (SELECT c_custkey, c_custkey * 37 % 1000 / 20e0 - 25 AS a, c_custkey * 91 % 1000 / 10e0 - 50 AS o, 0.5 + c_custkey % 5 AS r FROM customer)
  ON abs(lat - a) / r + abs(lon - o) / (2 * r) <= 1 + 1e-9""")
def polygons_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the areas of a table, a rhombus for each customer."""
    key = F.col("c_custkey")
    a, o, r = key * 37 % 1000 / 20 - 25, key * 91 % 1000 / 10 - 50, (key % 5 + 0.5).cast("double")
    ring = F.array(*[F.array(a + i * r, o + j * 2 * r) for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    return areas.in_areas(_cloud(spark, sf_dir), _table(spark, sf_dir, "customer").select(key.alias("area"), ring.alias("ring")))


@_query("path_of_many_segments", f"""SELECT {QTY}, {DISC}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE EXISTS (SELECT 1 FROM range(200) r(i)
  WHERE least(({QTY} - (i / 4e0 - 0.1)) * 4, 1) - greatest(({QTY} - (i / 4e0 + 0.1)) * 4, 0) >= -1e-9
    AND {DISC} BETWEEN i % 20 / 200e0 - 0.006 - 1e-12 AND i % 20 / 200e0 + 0.006 + 1e-12)""")
def path_of_many_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of 200 sweeps of a box, each of a quarter to the right: a row meets those in its bin."""
    box = Box([QTY, DISC], [-0.1, -0.006], [0.1, 0.006])
    way = [PathSegment([QTY, DISC], box, [i / 4, i % 20 / 200], [(i + 1) / 4, i % 20 / 200]) for i in range(200)]
    return _cube(spark, sf_dir, "lineitem", [QTY, DISC]).retrieve(Request(Union([QTY, DISC], *way)))


# --- results --------------------------------------------------------------------------------------------------

_SHIP = f"{QTY} BETWEEN 10 AND 11 AND {within(DISC, .02, .03)}"
_CELLS = Request(Box([QTY, DISC], [10, 0.02], [11, 0.03]))


@_query("index_ranges", f"""WITH c AS (SELECT DISTINCT l_orderkey AS cell FROM lineitem WHERE {_SHIP}), g AS (SELECT cell, cell - row_number() OVER (ORDER BY cell) AS run FROM c)
  SELECT min(cell)::BIGINT AS start, (max(cell) + 1)::BIGINT AS stop, count(*)::BIGINT AS cells FROM g GROUP BY run""")
def index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cube(spark, sf_dir, "lineitem", [QTY, DISC]).retrieve(_CELLS).select(F.col("l_orderkey").alias("cell"))
    return results.index_ranges(cells)


@_query("index_ranges_by_path", f"""WITH c AS (SELECT DISTINCT {QTY}, l_orderkey AS cell FROM lineitem WHERE {_SHIP}),
  g AS (SELECT {QTY}, cell, cell - row_number() OVER (PARTITION BY {QTY} ORDER BY cell) AS run FROM c)
  SELECT {QTY}, min(cell)::BIGINT AS start, (max(cell) + 1)::BIGINT AS stop, count(*)::BIGINT AS cells FROM g GROUP BY {QTY}, run""")
def index_ranges_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cube(spark, sf_dir, "lineitem", [QTY, DISC]).retrieve(_CELLS).select(QTY, F.col("l_orderkey").alias("cell"))
    return results.index_ranges(cells, path=[QTY])


@_query("range_read", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {_SHIP})")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.in_ranges(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), index_ranges(spark, sf_dir), "o_orderkey")


@_query("compressed_leaves", f"SELECT {FLAG}, count(*)::BIGINT AS cells, count(DISTINCT {QTY})::BIGINT AS quantities, min({QTY}) AS low, max({QTY}) AS high FROM lineitem WHERE {_SHIP} GROUP BY {FLAG}")
def compressed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Cube(_table(spark, sf_dir, "lineitem"), [FLAG, QTY, DISC]).retrieve(Request(All(FLAG), *_CELLS.shapes))
    leaves = results.compressed(cells, [FLAG], [QTY])
    return leaves.select(FLAG, "cells", F.size(QTY).cast("bigint").alias("quantities"), F.array_min(QTY).alias("low"), F.array_max(QTY).alias("high"))


@_query("compressed_values", f"""WITH c AS (SELECT {FLAG} AS f, {QTY} AS q, {DISC} AS d, max(l_orderkey) AS v FROM lineitem WHERE {_SHIP} AND l_partkey % 5 < 2 GROUP BY ALL),
  a AS (SELECT f, q, d FROM (SELECT DISTINCT f, q FROM c) JOIN (SELECT DISTINCT f, d FROM c) USING (f))
  SELECT f AS {FLAG}, count(DISTINCT q)::BIGINT AS quantities, count(DISTINCT d)::BIGINT AS discounts, string_agg(coalesce(v::VARCHAR, '-'), ',' ORDER BY q, d) AS orders FROM a LEFT JOIN c USING (f, q, d) GROUP BY f""")
def compressed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest order in each cell of quantity and discount, as arrays with their holes."""
    cells = Cube(_table(spark, sf_dir, "lineitem").where("l_partkey % 5 < 2"), [FLAG, QTY, DISC], ["l_orderkey"]).retrieve(Request(All(FLAG), *_CELLS.shapes))
    largest = cells.groupBy(FLAG, QTY, DISC).agg(F.max("l_orderkey").alias("orders"))
    blocks = results.value_blocks(largest, [FLAG], [QTY, DISC], ["orders"])
    text = F.array_join(F.transform("orders", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    return blocks.select(FLAG, F.size(QTY).cast("bigint").alias("quantities"), F.size(DISC).cast("bigint").alias("discounts"), text.alias("orders"))


@_query("decompressed_requests", f"""SELECT f AS l_returnflag, q AS l_quantity, t AS l_tax FROM (SELECT DISTINCT {FLAG} AS f, {QTY} AS q FROM lineitem WHERE {_SHIP})
  JOIN (SELECT DISTINCT {FLAG} AS g, {TAX} AS t FROM lineitem WHERE {_SHIP}) ON f = g""")
def decompressed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Cube(_table(spark, sf_dir, "lineitem"), [FLAG, QTY, DISC], [TAX]).retrieve(Request(All(FLAG), *_CELLS.shapes))
    return results.decompressed(results.compressed(cells, [FLAG], [QTY, TAX]).drop("cells"), [QTY, TAX])


@_query("axis_indices", f"SELECT DISTINCT {DATE} FROM lineitem WHERE {YEARS}")
def axis_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir, "lineitem", [DATE]).indices(DATE, Y97, Y98)


@_query("empty_axis_dropped", f"SELECT {QTY}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {QTY} = 17")
def empty_axis_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("domain", F.lit(""))
    return Cube(rows, ["domain", QTY], VALUES["lineitem"]).without_empty_axes().retrieve(Request(Select(QTY, [17])))


@_query("open_engine", "SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice > 910 AND p_retailprice < 950")
def open_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = ["p_size", "p_retailprice"]
    cube = Cube(_table(spark, sf_dir, "part"), axes, ["p_partkey"], engines=dict.fromkeys(axes, "point_in_polygon"))
    return cube.retrieve(Request(Box(axes, [10, 910], [20, 950])))


@_query("wrapped_values", """SELECT event_id, round(CASE WHEN x < -1e-12 THEN x + (floor((-x - 1e-12) / 7e0) + 1) * 7 WHEN x <= 7 + 1e-12 THEN x
  ELSE x - (floor((x - 7) / 7e0) + 1) * 7 END, 6) AS wrapped FROM (SELECT event_id, value * 10 AS x FROM events)""")
def wrapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.round(transforms.wrapped(F.col("value") * 10, 0.0, 7.0), 6).alias("wrapped"))


@_query("fixed_path", f"SELECT {QTY}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {FLAG} = 'A' AND {QTY} = 2")
def fixed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cube(_table(spark, sf_dir, "lineitem"), [QTY], VALUES["lineitem"], fixed={FLAG: "A"}).retrieve(Request(Select(QTY, [2])))


@_query("planned_left_join", f"SELECT d.x::DOUBLE AS l_quantity, n FROM range(48, 54) d(x) LEFT JOIN (SELECT {QTY}, count(*)::DOUBLE AS n FROM lineitem GROUP BY {QTY}) ON {QTY} = x")
def planned_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = spark.range(48, 54).select(F.col("id").cast("double").alias(QTY))
    return results.planned_and_found(planned, _table(spark, sf_dir, "lineitem").groupBy(QTY).agg(F.count("*").cast("double").alias("n")), [QTY])


@_query("merge_results", f"SELECT DISTINCT {QTY}, {DISC} FROM lineitem WHERE {QTY} BETWEEN 10 AND 13 AND {within(DISC, .02, .04)}")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cube(_table(spark, sf_dir, "lineitem"), [QTY, DISC])
    parts = [cube.retrieve(Request(Box([QTY, DISC], [a, 0.02], [b, 0.04]))) for a, b in ((10, 12), (11, 13))]
    return results.merged_rows(*parts)


@_query("pruned_branch", f"SELECT DISTINCT {QTY}, {DISC} FROM lineitem WHERE {QTY} IN (10, 12) AND {within(DISC, .02, .04)}")
def pruned_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge_results(spark, sf_dir)
    return results.without(found, found.where(f"{QTY} in (11, 13)"), [QTY])


@_query("nested_tree", f"""SELECT {FLAG}, count(DISTINCT {QTY})::BIGINT AS branches, count(*)::BIGINT AS leaves
  FROM (SELECT DISTINCT {FLAG}, {QTY}, {DISC} FROM lineitem WHERE {_SHIP}) GROUP BY {FLAG}""")
def nested_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Cube(_table(spark, sf_dir, "lineitem"), [FLAG, QTY, DISC]).index(Request(All(FLAG), *_CELLS.shapes))
    trees = results.nested(cells, [FLAG, QTY, DISC], root=[FLAG])
    read = F.from_json("tree", "map<string, map<string, string>>")
    inner = F.map_values(read)
    return trees.select(FLAG, F.size(read).cast("bigint").alias("branches"), F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, m: a + F.size(F.map_keys(m))).alias("leaves"))


@_query("tree_leaves", f"SELECT DISTINCT {FLAG}, {QTY}, {DISC}::DECIMAL(5,2)::DOUBLE AS {DISC} FROM lineitem WHERE {_SHIP}")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of flags taken apart again."""
    cells = Cube(_table(spark, sf_dir, "lineitem"), [FLAG, QTY, DISC]).index(Request(All(FLAG), *_CELLS.shapes))
    found = results.tree_leaves(results.nested(cells, [FLAG, QTY, DISC], root=[FLAG]), [FLAG, QTY, DISC], root=[FLAG])
    return found.select(FLAG, F.col(QTY).cast("double"), F.col(DISC).cast("double"))


@_query("encoded_and_decoded", f"SELECT {QTY}, {DISC}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {_SHIP}")
def encoded_and_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{store.shared_folder(spark)}/result"
    results.encode(_cube(spark, sf_dir, "lineitem", [QTY, DISC]).retrieve(_CELLS), path)
    return results.decode(spark, path)


@_query("stored_for_ranges", f"SELECT {QTY}, {DISC}, {TAX}, l_orderkey, l_linenumber FROM lineitem WHERE {_SHIP} AND {within(TAX, .01, .03)}")
def stored_for_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box out of a store that was written for boxes on three axes."""
    path = f"{store.shared_folder(spark)}/cube"
    results.store(_table(spark, sf_dir, "lineitem").select(QTY, DISC, TAX, *SHIP_KEY), path, [QTY, DISC, TAX])
    return Cube.from_parquet(spark, path, [QTY, DISC, TAX], SHIP_KEY).retrieve(Request(Box([QTY, DISC, TAX], [10, 0.02, 0.01], [11, 0.03, 0.03])))


@_query("explicit_axes", "SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_size IN (7, 49) AND p_retailprice <= 950")
def explicit_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes snapped to values that the options list, without a look into the store."""
    options = cubes.Options.parse({"alternative_axes": [{"axis_name": "p_size", "values": list(range(1, 50, 3))}]})
    cube = cubes.configured(_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"], options)
    return cube.retrieve(Request(Select("p_size", [7.4, 80], method="nearest"), Span("p_retailprice", 0, 950)))


@_query("has_index", f"SELECT x::DOUBLE AS value, EXISTS (SELECT 1 FROM lineitem WHERE {QTY} = x) AS found FROM (VALUES (1), (17), (50.5), (51), (-3)) v(x)")
def has_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir, "lineitem", [QTY])
    return spark.createDataFrame([(float(v), cube.has_index(QTY, v)) for v in (1, 17, 50.5, 51, -3)], "value double, found boolean")


@_query("sub_cube", f"SELECT {DISC}, l_extendedprice, l_orderkey, l_linenumber FROM lineitem WHERE {QTY} = 33 AND {DISC} <= 0.01 + 1e-12")
def sub_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir, "lineitem", [QTY, DISC]).select(**{QTY: 33}).retrieve(Request(Span(DISC, 0, 0.01)))


@_query("axis_dims", f"SELECT DISTINCT {DISC} FROM lineitem")
def axis_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir, "lineitem", [DISC]).dims(DISC)


@_query("alternatives", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE ({QTY} = 3 OR {QTY} BETWEEN 7 AND 8) AND {near(TAX, .05)}")
def low_level_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = alternatives([Select(QTY, [3]), Box([QTY], [7], [8]), Select(TAX, [0.05])], AXES["lineitem"])
    return _table(spark, sf_dir, "lineitem").where(test).select(*SHIP_KEY)


def _branched(name: str, status: str, *shapes: Shape, sql: str) -> None:
    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = Branch(STATUS, ("O",), (TAX,))
        cube = Cube(_table(spark, sf_dir, "lineitem"), [STATUS, QTY, TAX], SHIP_KEY, [rule])
        return cube.retrieve(Request(Select(STATUS, [status]), Select(QTY, [9]), *shapes)).select(*SHIP_KEY)


_branched("branching_axis", "O", sql=f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {STATUS} = 'O' AND {QTY} = 9")
_branched("branching_axis_kept", "F", Select(TAX, [0.02]), sql=f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {STATUS} = 'F' AND {QTY} = 9 AND {near(TAX, .02)}")


@_query("mock_box", "SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, ((x * 50 + y) * 50 + z)::DOUBLE AS value FROM range(3, 7) a(x), range(3, 7) b(y), range(3, 7) c(z)")
def mock_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.mock(spark, {"x": 50, "y": 50, "z": 50}).retrieve(Request(Box(["x", "y", "z"], [3] * 3, [6] * 3)))


@_query("configured_cube", "SELECT strftime(ts, '%Y%m%d') AS day, user_id, event_id FROM events WHERE event_type = 'click' AND user_id BETWEEN 5 AND 6")
def configured_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("user_id").cast("string").alias("user_id"), "event_type", "event_id")
    options = cubes.Options.parse({
        "axis_config": [{"axis_name": "user_id", "transformations": [{"name": "type_change", "type": "int"}]}], "pre_path": {"event_type": "click"},
    })
    return cubes.configured(rows, ["day", "user_id"], ["event_id"], options).retrieve(Request(All("day"), Span("user_id", 5, 6)))


@_query("catalogue_values", """SELECT event_type, axis, count(DISTINCT value)::BIGINT AS size, min(value) AS first, max(value) AS last FROM (
  SELECT event_type, 'user' AS axis, lpad(user_id::VARCHAR, 5, '0') AS value FROM events UNION ALL SELECT event_type, 'day', strftime(ts, '%Y%m%d') FROM events) GROUP BY event_type, axis""")
def catalogue_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of what is stored for each type of event: its users and days."""
    listed = F.array(F.struct(F.lit("user").alias("axis"), F.lpad(F.col("user_id").cast("string"), 5, "0").alias("value")), F.struct(F.lit("day").alias("axis"), F.date_format("ts", "yyyyMMdd").alias("value")))
    rows = _table(spark, sf_dir, "events").select("event_type", F.explode(listed).alias("e")).select("event_type", "e.axis", "e.value")
    return cubes.catalogue(rows, path=["event_type"]).select("event_type", "axis", "size", F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


# --- features -------------------------------------------------------------------------------------------------


def _feature(name: str, feature: dict, body: dict, axes: Sequence[str], geo: Sequence[str], sql: str) -> None:
    @_query(name, f"SELECT {', '.join([*axes, *VALUES['lineitem']])} FROM lineitem WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cube(spark, sf_dir, "lineitem", axes).retrieve(features.feature_request(feature, body, geo))


_PAIR = (QTY, DISC)
_AT1 = f"{QTY} = 25 AND {near(DISC, .06)}"
_feature("feature_timeseries", {"type": "timeseries", "points": [[25, 0.06]], "time_axis": DATE, "range": {"start": Y97, "end": Y98}}, {}, [QTY, DISC, DATE], _PAIR, f"{_AT1} AND {YEARS}")
_feature("feature_profile", {"type": "verticalprofile", "points": [[25, 0.06]], "axes": TAX, "range": "0.02/to/0.05"}, {}, [QTY, DISC, TAX], _PAIR, f"{_AT1} AND {within(TAX, .02, .05)}")
_feature("feature_bbox", {"type": "boundingbox", "points": [[10, 0.02], [12, 0.04]]}, {FLAG: "A/R"}, [QTY, DISC, FLAG], _PAIR, f"{QTY} BETWEEN 10 AND 12 AND {within(DISC, .02, .04)} AND {FLAG} IN ('A', 'R')")
_cut("feature_circle", "part", *features.feature_request({"type": "circle", "center": [[25, 940]], "radius": 9}, {}, ("p_size", "p_retailprice")).shapes, sql=_gon("p_size", PRICE, 25, 940, 9, 9))
_feature("feature_position", {"type": "position", "points": [[25, 0.06], [26, 0.07]]}, {}, [QTY, DISC], _PAIR, f"({_AT1}) OR ({QTY} = 26 AND {near(DISC, .07)})")
_feature("feature_polygon", {"type": "polygon", "shape": [[5, 0.0], [45, 0.0], [25, 0.05], [45, 0.1], [5, 0.1]]}, {}, [QTY, DISC], _PAIR,
         f"{QTY} >= 5 AND {within(DISC, 0.0, .1)} AND {QTY} <= 25 + 20 * abs({DISC} - 0.05::DOUBLE) / 0.05::DOUBLE + 1e-7")
_feature("feature_trajectory", {"type": "trajectory", "points": [[5, 0.0], [25, 0.1], [45, 0.0]], "inflation": [1, 0.01], "inflate": "box"}, {}, [QTY, DISC], _PAIR,
         _swept_box(QTY, DISC, (1, 0.01), [(5, 0.0), (25, 0.1), (45, 0.0)]))
_feature("feature_trajectory_round", {"type": "trajectory", "points": [[5, 0.0], [25, 0.1]], "inflation": [2, 0.02]}, {}, [QTY, DISC], _PAIR,
         _swept_gon(QTY, DISC, (2, 0.02), [(5, 0.0), (25, 0.1)]))



@_query("feature_days", "SELECT strftime(ts, '%Y%m%d') AS day, user_id, event_id FROM events WHERE user_id = 7 AND strftime(ts, '%Y%m%d') IN ('20240105', '20240107', '20240109')")
def feature_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days with a step: every other day of five."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyyMMdd").alias("day"))
    days = features.axis_shape("day", "20240105/to/20240109/by/2")
    return Cube(rows, ["day", "user_id"], ["event_id"]).retrieve(Request(days, Select("user_id", [7])), check_values=False)


def _asked(name: str, columns: dict[str, str], body: dict, sql: str) -> None:
    """A request in a user's own words over the events, ``columns`` being its axes as SQL."""

    @_query(name, f"SELECT * FROM (SELECT {', '.join(f'{c} AS {n}' for n, c in _DUCK[name].items())}, event_id FROM events) WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "events").selectExpr(*[f"{c} AS {n}" for n, c in columns.items()], "event_id")
        request = features.feature_request({"type": "boundingbox", "points": [[0], [1e9]], "axes": ["event"]}, body, ())
        return Cube(rows.withColumn("event", F.col("event_id")), [*columns, "event"], ["event_id"]).retrieve(request).select(*columns, "event_id")


_CODE, _DAY = "lpad(cast(user_id AS string), 4, '0')", "date_format(ts, 'yyyyMMdd')"
_DUCK = {
    "feature_time_range": {"ts": "ts", "user_id": "user_id"},
    "feature_time_steps": {"hour": "date_trunc('hour', ts)", "user_id": "user_id"},
    "feature_codes": {"day": "strftime(ts, '%Y%m%d')", "code": "lpad(user_id::VARCHAR, 4, '0')"},
    "feature_range_text": {"day": "strftime(ts, '%Y%m%d')", "code": "lpad(user_id::VARCHAR, 4, '0')"},
    "feature_day_steps": {"day": "strftime(ts, '%Y%m%d')", "code": "lpad(user_id::VARCHAR, 4, '0')"},
}
_asked("feature_time_range", {"ts": "ts", "user_id": "user_id"}, {"ts": "20240103/to/20240105", "user_id": "5/to/9"},
       "ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' AND user_id BETWEEN 5 AND 9")
_asked("feature_time_steps", {"hour": "date_trunc('hour', ts)", "user_id": "user_id"}, {"hour": {"start": "2024-01-03", "end": "2024-01-05T12:00", "interval": "6h"}, "user_id": {"start": 1, "end": 99, "interval": 2}},
       "hour BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05 12:00:00' AND hour(hour) % 6 = 0 AND user_id BETWEEN 1 AND 99 AND user_id % 2 = 1")
_asked("feature_codes", {"day": _DAY, "code": _CODE}, {"day": "20240103/20240105", "code": ["0007", "0012"]}, "day IN ('20240103', '20240105') AND code IN ('0007', '0012')")
_asked("feature_range_text", {"day": _DAY, "code": _CODE}, {"day": {"start": "20240103", "end": "20240105"}, "code": "0005/to/0012"}, "day BETWEEN '20240103' AND '20240105' AND code BETWEEN '0005' AND '0012'")
_asked("feature_day_steps", {"day": _DAY, "code": _CODE}, {"day": "20231230/to/20240112/by/3", "code": "0002/to/0020/by/6"}, "day IN ('20231230', '20240102', '20240105', '20240108', '20240111') AND code IN ('0002', '0008', '0014', '0020')")


@_query("coverage_by_executors", """SELECT user_id, count(*)::BIGINT AS points, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first, sum(value)::DECIMAL(18,4)::DOUBLE AS total FROM events
  WHERE user_id BETWEEN 3 AND 12 AND event_type = 'click' GROUP BY user_id""")
def coverage_by_executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeseries of each of ten users as CoverageJSON, read back."""
    cells = _cube(spark, sf_dir, "events", ["ts", "user_id", "event_type"]).retrieve(Request(All("ts"), Span("user_id", 3, 12), Select("event_type", ["click"])))
    made = features.coverages(cells, "PointSeries", {"t": "ts", "x": "user_id"}, ["value"])
    read = F.from_json("coverage", "domain struct<axes: struct<t: struct<values: array<string>>, x: struct<values: array<bigint>>>>, ranges struct<value: struct<values: array<double>>>")
    rows = made.select(read.alias("c")).select(F.col("c.domain.axes.x.values")[0].alias("user_id"), F.col("c.domain.axes.t.values").alias("t"), F.col("c.ranges.value.values").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("decimal(18,4)").cast("double")
    return rows.select("user_id", F.size("t").cast("bigint").alias("points"), F.substring(F.array_min("t"), 1, 19).alias("first"), total.alias("total"))


@_query("cyclic_thousand_laps", "SELECT lon, p_partkey FROM (SELECT p_partkey, p_size % 8 / 8e0 AS lon FROM part) WHERE lon BETWEEN 0.25 - 1e-12 AND 0.75 + 1e-12")
def cyclic_thousand_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of a thousand ranges, one in each lap: an axis of a period of one is in them or isn't, whatever the lap."""
    rows = _table(spark, sf_dir, "part").select((F.col("p_size") % 8 / 8).alias("lon"), "p_partkey")
    return Cube(rows, [Axis("lon", period=(0.0, 1.0))], ["p_partkey"]).retrieve(Request(Union(["lon"], *[Box(["lon"], [k + 0.25], [k + 0.75]) for k in range(1000)])))


# --- what composition with Spark gives ------------------------------------------------------------------------


@_query("aggregate_cut", f"SELECT {FLAG}, {STATUS}, count(*)::BIGINT AS cells, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE {_SHIP} GROUP BY {FLAG}, {STATUS}")
def aggregate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Cube(_table(spark, sf_dir, "lineitem"), [FLAG, STATUS, QTY, DISC], ["l_extendedprice"]).retrieve(Request(All(FLAG), All(STATUS), *_CELLS.shapes))
    return cells.groupBy(FLAG, STATUS).agg(F.count("*").alias("cells"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk of quantity and discount on returned goods of two years."""
    request = Request(Select(FLAG, ["R"]), Disk([DISC, QTY], [0.05, 15], [0.03, 6]), Span(DATE, Y97, Y98))
    return _cube(spark, sf_dir, "lineitem", [FLAG, DISC, QTY, DATE]).retrieve(request)


_query("flagship", f"""SELECT {FLAG}, {DISC}, {QTY}, {DATE}, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {FLAG} = 'R' AND {YEARS}
  AND {_gon(DISC, QTY, 0.05, 15, 0.03, 6)}""")(flagship)
