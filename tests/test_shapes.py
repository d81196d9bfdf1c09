import datetime as dt
import math
import random

import numpy as np
import pytest

import lattisect as L
from lattisect import geometry
from lattisect.errors import AxisNotFound, AxisOverdefined, AxisUnderdefined, BadRequest, MissingValue, Unsliceable
from lattisect.operators.results import leaf_count
from lattisect.shapes import BoxSweep
from lattisect.sources.cubes import dense, mock

DAYS = [dt.datetime(2000, 1, d) for d in (1, 2, 3)]
SL, LS = ["step", "level"], ["level", "step"]
DAY, LAST = L.Select("date", ["2000-01-01"]), L.Select("date", [DAYS[2]])


def day(shape):
    return L.Select("date", [DAYS[0]]) if shape is None else shape


@pytest.fixture(scope="module")
def cube3(spark):
    c = dense(spark, {"date": DAYS, "step": list(range(0, 18, 3)), "level": list(range(1, 130))})
    return L.Cube(c.df.cache(), ["date", "step", "level"], ["value"])


@pytest.fixture(scope="module")
def cube4(spark):
    lats = [round(i * 0.1, 15) for i in range(100)]
    c = dense(spark, {"date": DAYS, "step": list(range(0, 21, 3)), "level": list(range(1, 130)), "lat": lats})
    return L.Cube(c.df.cache(), ["date", "step", "level", "lat"], ["value"])


BOX = L.Box(SL, [3, 3], [6, 5])
FOUR = [
    (37, L.Disk(SL, [9, 10], [6, 6]), ("lat", 5.2)),
    (45, L.Union(SL, L.Disk(SL, [6, 10], [5.9, 6]), L.Disk(SL, [15, 10], [2.9, 3])), ("lat", 5.1)),
    (24, L.Union(["step", "lat"], L.Disk(["step", "lat"], [6, 4.0], [6.99, 0.1]), L.Disk(["step", "lat"], [15, 2.0], [4.99, 0.3])), ("level", 10)),
    (101, L.Union(["step", "lat"], L.Disk(["step", "lat"], [6, 4.0], [3, 1.9]), L.Disk(["step", "lat"], [15, 2.0], [3, 2.1])), ("level", 10)),
    (7, L.PathSegment(SL, L.Box(SL, [3, 0], [6, 1]), [3, 1], [6, 2]), ("lat", 4.0)),
    (12, L.PathSegment(SL, BOX, [3, 3], [6, 6]), ("lat", 4.1)),
    (14, L.PathSegment(SL, L.Disk(SL, [6, 3], [3, 2]), [3, 3], [6, 6]), ("lat", 5.5)),
    (12, L.Path(SL, BOX, [3, 3], [6, 6]), ("lat", 4.3)),
    (18, L.Path(SL, BOX, [3, 3], [6, 6], [9, 9]), ("lat", 4.3)),
    (6, L.Polygon(SL, [[3, 3], [3, 5], [6, 5], [6, 7]]), ("lat", 4.3)),
    (0, L.Disk(SL, [5, 3.4], [0.5, 0.2]), ("lat", 5.1)),
    (1, L.PathSegment(SL, L.Box(SL, [2.4, 3.1], [2.5, 3.4]), [3, 3], [6, 6]), ("lat", 4.0)),
    (0, L.PathSegment(SL, L.Box(SL, [2.4, 3.1], [2.5, 3.4]), [1.1, 3.3], [2.7, 3.6]), ("lat", 4.0)),
    (0, L.Disk(LS, [4, 5], [4, 0]), ("lat", 6)),
    (8, L.Disk(LS, [4, 6], [4, 0]), ("lat", 6)),
    (3, L.Disk(LS, [4, 6], [0, 3]), ("lat", 6)),
    (0, L.Disk(LS, [4, 5], [0, 0.5]), ("lat", 6)),
    (1, L.Disk(LS, [4, 6], [0, 0]), ("lat", 6)),
    (4, L.Polygon(SL, [[3, 3], [3, 6], [3, 3], [3, 3]]), ("lat", 4.3)),
    (1, L.Polygon(SL, [[3, 3]] * 4), ("lat", 4.3)),
    (0, L.Polygon(SL, [[2, 3.1]]), ("lat", 4.3)),
]


@pytest.mark.parametrize("count, shape, other", FOUR)
def test_goldens_on_four_axes(cube4, count, shape, other):
    assert cube4.retrieve(L.Request(shape, L.Select(other[0], [other[1]]), L.Select("date", [DAYS[0]]))).count() == count


def test_ellipsoids(cube4):
    axes = ["step", "level", "lat"]
    first = L.Select("date", [DAYS[0]])
    cells = cube4.retrieve(L.Request(L.Ellipsoid(axes, [6, 3, 2.1], [3, 1, 0.1]), first))
    assert cells.count() == 7 and leaf_count(cells, list(cube4.axes), []) == 5
    assert cube4.retrieve(L.Request(L.Ellipsoid(axes, [6, 3, 2.1], [0, 0, 0]), first)).count() == 1
    assert cube4.retrieve(L.Request(L.Ellipsoid(axes, [5, 3, 2.1], [0, 0, 0]), first)).count() == 0
    assert len(geometry.half_spaces(geometry.ellipsoid_vertices((0, 0, 0), (1, 1, 1))).normals) == 20


THREE = [
    (15, L.Segment(LS, L.Box(LS, [1, 0], [2, 3]), L.Box(LS, [1, 9], [3, 15]))),
    (21, L.Segment(LS, L.Box(LS, [1, 0], [2, 3]), L.Box(LS, [1, 12], [5, 15]))),
    (40, L.Segment(LS, L.Box(LS, [1, 0], [2, 3]), L.Box(LS, [1, 12], [10, 15]))),
    (15, L.ShapePath(LS, L.Box(LS, [1, 0], [2, 3]), L.Box(LS, [1, 9], [3, 15]))),
    (30, L.ShapePath(LS, L.Box(LS, [1, 0], [2, 3]), L.Box(LS, [1, 6], [5, 12]), L.Box(LS, [1, 12], [7, 15]))),
    (9, L.Disk(LS, [6, 6], [3, 3])),
    (8, L.Polygon(LS, [[1, 0], [3, 0], [2, 3], [3, 6], [1, 6]])),
    (4, L.ConvexHull(SL, [[0, 1], [3, 1], [3, 2], [0, 2]])),
    (12, L.PathSegment(LS, L.Polygon(LS, [(1, 0), (3, 0), (3, 6), (2, 6), (2, 3), (1, 3)]), [0, 0], [1, 3])),
    (1, L.Box(SL, [4, 10], [7, 10])),
    (4, L.Box(SL, [3, 10], [6, 11])),
]


@pytest.mark.parametrize("count, shape", THREE)
def test_goldens_on_three_axes(cube3, count, shape):
    cells = cube3.retrieve(L.Request(shape, L.Select("date", [DAYS[2]])))
    assert cells.count() == count
    assert {r.value for r in cells.collect()} == {float((2 * 6 + r.step // 3) * 129 + r.level - 1) for r in cells.collect()}


def test_disk_touches_its_polygon(cube3):
    r1 = math.cos(math.pi / 12) * (8 - 4 * math.sqrt(3)) + 2.3e-16
    r2 = 3 * math.cos(math.pi / 12) * (math.sqrt(3) - 2) * (8 - 4 * math.sqrt(3)) / (4 * math.sqrt(3) - 7)
    cells = cube3.retrieve(L.Request(L.Disk(LS, [0, 0], [r1, r2]), L.Select("date", [DAYS[0]])))
    assert cells.where("level = 1 and step = 3").count() == 1


def test_selections_spans_and_missing_values(cube3):
    base = (L.Select("level", [100]), L.Select("step", [3, 3]))
    assert cube3.retrieve(L.Request(L.Select("date", [DAYS[2], dt.datetime(2000, 1, 4)]), *base)).count() == 1
    assert cube3.retrieve(L.Request(L.Select("date", []), *base)).count() == 0
    levels = cube3.retrieve(L.Request(L.Span("level", 100, 98), L.Select("step", [3]), L.All("date"))).select("level").distinct().collect()
    assert sorted(r.level for r in levels) == [98, 99, 100]
    assert cube3.retrieve(L.Request(L.Span("level", 128), L.Point(["date", "step"], [[DAYS[0], 3]]))).count() == 2
    with pytest.raises(ValueError):
        L.Point(["step"], [[1], [2]])
    many = cube3.retrieve(L.Request(L.Select("level", list(range(1, 120, 2))), L.Product(L.Select("step", [3]), L.Span("date", DAYS[1], DAYS[1]))))
    assert many.count() == 60
    assert cube3.index(L.Request(L.Select("step", [3]), L.All("date"), L.Box(["level"], [3], [5]))).count() == 9


def test_errors(cube3, spark):
    step, level, date = L.Select("step", [3]), L.Select("level", [1]), L.All("date")
    with pytest.raises(AxisOverdefined):
        L.Request(step, L.Box(SL, [0, 0], [1, 1]))
    with pytest.raises(AxisUnderdefined):
        cube3.retrieve(L.Request(step, level))
    with pytest.raises(AxisNotFound):
        cube3.retrieve(L.Request(step, level, date, L.Select("depth", [1])))
    with pytest.raises(AxisNotFound):
        L.Cube(cube3.df, ["depth"])
    with pytest.raises(BadRequest):
        L.Cube(cube3.df, [])
    texts = dense(spark, {"date": DAYS, "variable": ["a", "c"], "level": [1, 2]})
    assert texts.retrieve(L.Request(L.Select("variable", ["a"]), L.All("date"), L.All("level"))).count() == 6
    with pytest.raises(MissingValue):
        texts.retrieve(L.Request(L.Select("variable", ["a", "b"]), L.All("date"), L.All("level")))
    with pytest.raises(Unsliceable):
        texts.retrieve(L.Request(L.Box(["variable", "level"], [0, 0], [1, 1]), L.All("date")))
    with pytest.raises(ValueError):
        dense(spark, {"flag": [True, False]})


def test_mock_cubes(spark):
    cube = mock(spark, {"x": 100, "y": 100})
    assert cube.retrieve(L.Request(L.ConvexHull(["x", "y"], [[0, 0], [3, 0], [0, 3]]))).count() == 10
    cells = mock(spark, {a: 20 for a in "xyzq"}).retrieve(L.Request(L.Box(list("xyzq"), [3] * 4, [6] * 4)))
    assert cells.count() == 4**4 and {r.value for r in cells.collect()} == {float(((r.x * 20 + r.y) * 20 + r.z) * 20 + r.q) for r in cells.collect()}


def test_hulls_against_brute_force():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 4):
        for flat in range(d + 1):
            basis = rng.normal(size=(flat, d))
            corners = rng.random((flat + 4, flat)) @ basis * [10.0**i for i in range(d)] + 5
            hull = geometry.half_spaces(corners)
            weights = rng.dirichlet(np.ones(len(corners)), 200)
            assert hull.contains(weights @ corners, 1e-8).all() and hull.contains(corners, 1e-8).all()
            spread = np.maximum(np.ptp(corners, axis=0), 1)
            assert not hull.contains(corners.max(axis=0) + spread).any()
    box = np.array([0.0, 0, 0]), np.array([1.0, 2, 3])
    start, end = np.array([0.0, 0, 0]), np.array([4.0, -1, 2])
    names = ["a", "b", "c"]
    axes = {n: L.Axis(n) for n in names}
    import duckdb

    points = rng.uniform(-2, 7, (3000, 3))
    con = duckdb.connect()
    con.register("p", __import__("pandas").DataFrame(points, columns=names).assign(i=range(3000)))
    both = [BoxSweep(names, L.Box(names, *box), start, end), L.ConvexHull(names, np.concatenate([geometry.box_corners(*box) + s for s in (start, end)]).tolist())]
    got = [{r[0] for r in con.execute(f"select i from p where {s.sql(axes, 'duckdb')}").fetchall()} for s in both]
    assert got[0] == got[1] and len(got[0]) > 50


def test_bounds_reach_the_scan(spark, tmp_path):
    mock(spark, {"x": 50, "y": 50}).df.selectExpr("cast(x as double) x", "cast(y as double) y", "value").write.parquet(str(tmp_path / "c"))
    cube = L.Cube.from_parquet(spark, str(tmp_path / "c"), ["x", "y"], ["value"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = cube.retrieve(L.Request(L.Disk(["x", "y"], [20, 20], [5, 5])))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan and "LessThanOrEqual(y" in plan and "Exchange" not in plan


@pytest.mark.parametrize("both", [False, True])
def test_unions_of_many_laps_are_brought_into_the_period(spark, both):
    """A cell is compared with the members of a union once, not at every lap; ends of a stored period are still one place."""
    xs = [i / 8 for i in range(0, 80 if not both else 81)]  # a period of ten, with or without its upper end
    cells = spark.createDataFrame([(x, float(y)) for x in xs for y in range(3)], "x double, y double")
    cube = L.Cube(cells, [L.Axis("x", period=(0.0, 10.0)), "y"], [])
    rng = random.Random(5)

    def inside(x, y, boxes):
        for (a, b), (c, d) in boxes:
            for k in range(math.floor((a - x) / 10) - 1, math.ceil((b - x) / 10) + 2):
                seam = both and ((k != 0 and x >= 10) or (k == 1 and x <= 0))
                if not seam and a - 1e-12 <= round(x + 10 * k, 12) <= b + 1e-12 and c <= y <= d:
                    return True
        return False

    for boxes in (
        [((10.0 * k + 2.5, 10.0 * k + 2.75), (1, 1)) for k in range(-100, 150)],
        [(((a := rng.randrange(-8000, 8000) / 8), a + rng.choice([0, 0, 0.1, 12.5])), (0, rng.randrange(2))) for _ in range(12)],
        [((10.0, 10.0), (0, 0)), ((-990.0, -990.0), (1, 1)), ((1000.0, 1000.0), (2, 2)), ((0.0, 0.0), (2, 2))],
        [((-500.1, 499.9), (2, 2)), ((1003.3, 1003.5), (0, 0))],
    ):
        found = cube.retrieve(L.Request(L.Union(["x", "y"], *[L.Box(["x", "y"], [a, c], [b, d]) for (a, b), (c, d) in boxes])))
        assert sorted(map(tuple, found.collect())) == [(x, float(y)) for x in xs for y in range(3) if inside(x, y, boxes)]
        assert "ceil" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    line = L.Cube(cells.select("x").distinct(), [L.Axis("x", period=(0.0, 10.0))], [])
    values = [10.0 * k + 2.5 for k in range(-200, 200)] + [773.375]
    found = line.retrieve(L.Request(L.Select("x", values)))
    assert sorted(r[0] for r in found.collect()) == [2.5, 3.375]
    assert "exists" not in found._jdf.queryExecution().optimizedPlan().toString()
    boxes = line.retrieve(L.Request(L.Union(["x"], *[L.Box(["x"], [10 * k + 2], [10 * k + 3]) for k in range(1000)])))
    assert sorted(r[0] for r in boxes.collect()) == [x for x in xs if 2 <= x <= 3]
    assert "exists" not in boxes._jdf.queryExecution().optimizedPlan().toString()
