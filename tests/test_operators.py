import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import lattisect as L
from lattisect.axes import Axis, number
from lattisect.cube import wrap
from lattisect.errors import BadGrid, BadRequest
from lattisect.functions import registry
from lattisect.operators import points, results, transforms
from lattisect.plans import features
from lattisect.plans.request import Branch, alternatives, group, prune_branches
from lattisect.sources import cubes, grids
from lattisect.streaming.extract import extracted, windowed

TENTHS = [round(i / 10, 1) for i in range(11)]


def unwrapped(cube, lo, hi, axis="long"):
    return sorted(r[f"{axis}_unwrapped"] for r in cube.retrieve(L.Request(L.Span(axis, lo, hi)), distinct=False).collect())


def test_cyclic_goldens(spark):
    cube = L.Cube(cubes.dense(spark, {"long": TENTHS}).df, [Axis("long", period=(0.0, 1.0))], ["value"])
    for lo, hi, n in ((0.8, 1.7, 10), (0, 1, 11), (0, 2, 21), (0, 0.7, 8), (1.3, 1.7, 5), (0.3, 2.7, 25), (-0.7, -0.3, 5), (-0.7, 0.3, 11)):
        got = unwrapped(cube, lo, hi)
        assert len(got) == n and np.allclose(np.diff(got), 0.1) and math.isclose(got[0], lo, abs_tol=1e-9)
    assert sorted(r.long for r in cube.retrieve(L.Request(L.Span("long", 0.8, 1.2))).collect()) == [0.1, 0.2, 0.8, 0.9, 1.0]
    snap = L.Cube(cubes.dense(spark, {"long": [0.0, 0.5, 1.0]}).df, [Axis("long", period=(0.0, 1.0))], ["value"])
    assert sorted(r.value for r in snap.retrieve(L.Request(L.Select("long", [-0.7], method="surrounding"))).collect()) == [0.0, 1.0]
    half = L.Cube(cubes.dense(spark, {"long": TENTHS[:-1]}).df, [Axis("long", period=(0.0, 1.0))], ["value"])
    assert len(unwrapped(half, 0, 2)) == 21 and len(unwrapped(half, 0.8, 1.7)) == 10  # the missing end is the other end
    below = L.Cube(cubes.dense(spark, {"long": [round(-1.1 + i / 10, 1) for i in range(11)]}).df, [Axis("long", period=(-1.1, -0.1))], ["value"])
    assert len(unwrapped(below, 0.0, 0.5)) == 6
    with pytest.raises(BadRequest):
        cube.retrieve(L.Request(L.Span("long", 0, 1e7)))
    assert [wrap(v, 0, 1) for v in (0.5, 1.0, 2.0, -0.25, 1.75)] == [0.5, 1.0, 0.0, 0.75, 0.75]
    moved = spark.range(1).select(*[transforms.wrapped(F.lit(v), 0.0, 1.0).alias(f"c{i}") for i, v in enumerate((0.5, 1.0, 2.0, -0.25, 1.75))]).first()
    assert list(moved) == [0.5, 1.0, 0.0, 0.75, 0.75]
    assert transforms.seams(4, 7, 1, 3) == [(4, 5), (5, 7), (7, 7)]


def test_surrounding(spark):
    cube = cubes.dense(spark, {"level": [1, 3, 5], "step": [1, 3, 5]})
    at = lambda **v: {(r.level, r.step) for r in cube.retrieve(L.Request(*[L.Select(a, [x], method="surrounding") for a, x in v.items()])).collect()}
    assert at(level=2, step=4) == {(a, b) for a in (1, 3) for b in (3, 5)}
    assert at(level=0, step=3) == {(1, b) for b in (1, 3, 5)} and at(level=7, step=1) == {(5, 1), (5, 3)}
    near = cube.retrieve(L.Request(L.Point(["level", "step"], [[3.9, 2]], method="nearest"))).collect()
    assert [(r.level, r.step) for r in near] == [(3, 1)]


def test_branches_and_groups():
    rule = Branch("levtype", ("sfc",), ("levelist",))
    request = L.Request(L.Select("levtype", ["sfc"]), L.Select("levelist", [1]), L.Select("step", [0]))
    kept, axes = prune_branches(request, ["levtype", "levelist", "step"], [rule])
    assert kept.axes == ["levtype", "step"] == axes and len(request.shapes) == 3
    with pytest.raises(ValueError):
        rule.dropped(L.Request(L.Select("levtype", ["sfc", "pl"])))
    boxes = [L.Box(["a", "b"], [0, 0], [1, 1]), L.Box(["b", "a"], [2, 2], [3, 3]), L.Span("c", 0, 1)]
    assert {k: len(v) for k, v in group(boxes).items()} == {("a", "b"): 2, ("c",): 1}
    assert alternatives(boxes, {n: Axis(n) for n in "abc"}).count(" OR ") == 1


def test_transformations(spark):
    steps = spark.createDataFrame([("70m", 4200), ("1h15m", 4500), ("26h30m15s", 95415), ("3", 10800), ("0", 0)], "s string, n long")
    out = transforms.retyped(steps.withColumn("t", F.col("s")), "t", "subhourly_step")
    assert all(r.t == r.n for r in out.collect())
    assert [r.t for r in transforms.stored(out, "t", "subhourly_step").collect()] == ["1h10m", "1h15m", "26h30m15s", "3", "0"]
    assert transforms.retyped(spark.createDataFrame([("1",), ("x",)], "t string"), "t", "int").dtypes == [("t", "string")]
    merged = transforms.merged(spark.createDataFrame([("20000101", "0600", 1)], "date string, time string, v int"), "date", "time")
    assert merged.first().date == dt.datetime(2000, 1, 1, 6)
    back = transforms.unmerged(merged, "date", "d", "t").first()
    assert (back.d, back.t) == ("20000101", "0600")
    assert number(dt.timedelta(minutes=2)) == 120.0 and number(np.datetime64("1970-01-02T00:00:00.5")) == 86400.5


def test_row_grids(spark):
    lats = grids.gaussian_latitudes(1280)
    assert np.allclose(lats[:5], [89.94618771566562, 89.87647835333229, 89.80635731954224, 89.73614327160958, 89.6658939412157], atol=1e-9)
    assert np.allclose(grids.gaussian_latitudes(640)[:3], [89.89239644559007, 89.75300494317403, 89.61279025859908], atol=1e-9)
    big = grids.octahedral(1280)
    assert big.size == 6599680 and [big.number(r, 0) for r in (0, 1, 2, 1280)] == [0, 20, 44, 3299840]
    assert [c.lon for c in big.cells(spark, (89.94, 89.95), (0, 90)).orderBy("lon").collect()] == [0, 18, 36, 54, 72, 90]
    for grid in (grids.octahedral(8), grids.healpix(4), grids.regular(4), grids.reduced_ll([4, 8, 4])):
        cells = [r.cell for r in grid.cells(spark).collect()]
        assert sorted(cells) == list(range(grid.size))
        found = grid.locate(grid.cells(spark).withColumnRenamed("cell", "c"))
        assert found.where("c <> cell or cell is null").isEmpty()
    assert grids.octahedral(8).size == 544
    for bad in (lambda: grids.reduced_ll([4, 0, 4]), lambda: grids.reduced_gaussian(2, [4]), lambda: grids.healpix(1).require_hash("x")):
        with pytest.raises(BadGrid):
            bad()
    local = grids.local_regular([-40, 40, 0, 60], 80)
    assert local.size == 81 * 81


def test_nested_order_is_a_bijection(spark):
    for n in (1, 2, 8):
        assert sorted(r.cell for r in grids.Nested(n).cells(spark).collect()) == list(range(12 * n * n))
    with pytest.raises(BadGrid):
        grids.Nested(3)


def test_lambert(spark):
    grid = grids.Lambert(5, 4, 100_000, 100_000, 30.0, 350.0, 45.0, 10.0, 40.0, 50.0)
    for g in (grid, grids.Lambert(5, 4, 100_000, 100_000, 30.0, 350.0, 45.0, 10.0, 40.0, 50.0, major=6378137.0, minor=6356752.3)):
        first = g.cells(spark).orderBy("cell").first()
        assert math.isclose(first.lat, 30.0, abs_tol=1e-6) and math.isclose(first.lon, 350.0, abs_tol=1e-6)
        assert g.cells(spark).count() == 20


def test_points(spark):
    rng = np.random.default_rng(3)
    cloud = [(i, float(a), float(o)) for i, (a, o) in enumerate(np.round(rng.uniform(-50, 50, (400, 2)), 1))]
    df = spark.createDataFrame(cloud, "idx long, lat double, lon double")
    near = points.nearest_points(df, [(0.0, 0.0), (60.0, -70.0)], k=3).collect()
    for q, (a, o) in enumerate([(0.0, 0.0), (60.0, -70.0)]):
        want = sorted(((x - a) ** 2 + (y - o) ** 2, i) for i, x, y in cloud)[:3]
        assert [(r.dist2, r.idx) for r in sorted(near, key=lambda r: r["rank"]) if r.query == q] == want
    asked = df.where("idx < 20").select(F.col("idx").alias("query"), "lat", "lon")
    got = {(r.query, r["rank"]): r.idx for r in points.nearest_to_each(df, asked, 8.0, k=2).collect()}
    for q, a, o in cloud[:20]:
        want = sorted((d, i) for d, i in (((x - a) ** 2 + (y - o) ** 2, i) for i, x, y in cloud) if d <= 64)[:2]
        assert [got.get((q, r)) for r in range(1, len(want) + 1)] == [i for _, i in want]
    square = L.Polygon(["lat", "lon"], [[-5, -5], [5, -5], [5, 5], [-5, 5]])
    edge = spark.createDataFrame([(0, 5.0, 0.0), (1, 0.0, 0.0), (2, 5.0, 5.0)], "idx long, lat double, lon double")
    assert points.points_in(edge, square).count() == 3 and points.points_in(edge, square, "point_in_polygon").count() == 1
    assert points.points_in(edge, L.ConvexHull(["lat", "lon"], [[0, 0], [1, 1]]), "point_in_polygon").count() == 0
    far = spark.range(1).select(points.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first()
    assert math.isclose(far.d, math.pi * 6371.0, rel_tol=1e-9)


def test_results(spark, tmp_path):
    cells = spark.createDataFrame([(c,) for c in [0, 1, 2, 5, 6, 6, 9, (1 << 20) - 1, 1 << 20, (1 << 20) + 1]], "cell long")
    want = {(0, 3, 3), (5, 7, 2), (9, 10, 1), ((1 << 20) - 1, (1 << 20) + 2, 3)}
    ranges = results.index_ranges(cells)
    assert {(r.start, r.stop, r.cells) for r in ranges.collect()} == want
    assert results.in_ranges(spark.range(20).withColumnRenamed("id", "cell"), ranges).count() == 6
    rows = spark.createDataFrame([(1, 'a"', 1.5, 7.0), (1, "b", 2.5, 8.0), (2, "b", 0.5, None)], "x int, y string, z double, v double")
    tree = json.loads(results.nested(rows, ["x", "y", "z"], ["v"]).first().tree)
    assert tree == {"1": {'a"': {"1.5": {"v": 7.0}}, "b": {"2.5": {"v": 8.0}}}, "2": {"b": {"0.5": {}}}}
    assert len(results.flatten_tree(tree, ["x", "y", "z"])) == 3 and "2.5" in results.pretty(tree)
    leaves = results.compressed(rows, ["x"], ["y"]).orderBy("x").collect()
    assert [(r.x, r.y, r.cells) for r in leaves] == [(1, ['a"', "b"], 2), (2, ["b"], 1)]
    assert results.without(rows, rows.where("x = 1"), ["x"]).count() == 1 and results.merged_rows(rows, rows).count() == 3
    results.encode(rows, str(tmp_path / "r"))
    assert results.decode(spark, str(tmp_path / "r")).count() == 3


def test_options(spark):
    rows = spark.createDataFrame([(f"{c}", "20000101", "0600", s, float(c)) for c in range(4) for s in ("0", "1")], "cell string, date string, time string, step string, v double")
    options = cubes.Options.parse({
        "axis_config": [
            {"axis_name": "date", "transformations": [{"name": "merge", "with_axis": "time", "linkers": ["T", "00"]}]},
            {"axis_name": "step", "transformations": [{"name": "type_change", "type": "int"}]},
            {"axis_name": "cell", "transformations": [
                {"name": "type_change", "type": "int"},
                {"name": "mapper", "type": "unstructured", "axes": ["lat", "lon"], "points": [[10, 10], [20, 10], [-5, 5], [5, 20]]}]},
        ],
        "pre_path": {"v": [0.0, 1.0, 2.0]},
    })
    cube = cubes.configured(rows, ["date", "time", "step", "cell"], ["v"], options)
    assert list(cube.axes) == ["date", "step", "lat", "lon"]
    got = cube.retrieve(L.Request(L.Select("date", [dt.datetime(2000, 1, 1, 6)]), L.Select("step", [1]), L.Box(["lat", "lon"], [-10, 0], [10, 15])))
    assert sorted(r.v for r in got.collect()) == [0.0, 2.0]
    for bad in ({"x": 1}, {"axis_config": [{"axis_name": "a", "transformations": [{"name": "turn"}]}]}, {"axis_config": [{"axis_name": "a", "transformations": [{"name": "cyclic", "lap": 1}]}]}):
        with pytest.raises(BadRequest):
            cubes.Options.parse(bad)
    dynamic = cubes.Options.parse({"dynamic_grid": True, "axis_config": [{"axis_name": "cell", "transformations": [{"name": "mapper", "type": "regular", "resolution": 4}]}]})
    assert dynamic.with_grid(lambda: {"type": "octahedral", "resolution": 8}).axis_config[0].find(cubes.Mapper).grid().size == 544
    assert dynamic.with_grid(lambda: {"kind": 1}) is dynamic
    assert cubes.discovered_axes(rows, ["step"]) == {"step": ["0", "1"]}
    with pytest.raises(BadRequest):
        cubes.discovered_axes(rows.limit(0), ["step"])


def test_features():
    assert features.expand_range("0/to/10/by/5") == [0, 5, 10] and features.expand_range("1/2/3") == [1, 2, 3]
    assert features.expand_range({"start": 1, "end": 4}) == (1, 4)
    assert features.expand_range("20200130/to/20200202/by/1") == ["20200130", "20200131", "20200201", "20200202"]
    assert features.expand_range("20200130/to/20200202/by/2") == features.expand_range({"start": "20200130", "end": "20200202", "interval": 2}) == ["20200130", "20200201"]
    for bad in ("20200130/to/soon/by/1", "0/to/10/by/0", "0/to/10/by/x"):
        with pytest.raises((BadRequest, TypeError)):
            features.expand_range(bad)
    with pytest.raises(BadRequest):
        features.feature_request({"type": "timeseries", "points": [[0, 0]], "time_axis": "step", "range": [1]}, {"step": [1]})
    for bad in ({"type": "frame"}, {"type": "circle", "center": [0, 0]}, {"type": "position", "points": [[0, 0]], "colour": 1}):
        with pytest.raises(BadRequest):
            features.feature_request(bad, {})
    ring = features.feature_request({"type": "trajectory", "points": [[0, 0], [1, 1]], "inflation": 0.5}, {"step": "0/to/3"})
    assert ring.axes == ["lat", "lon", "step"]
    rows = [{"t": dt.datetime(2000, 1, d), "lat": 1.0, "lon": 2.0, "v": float(d)} for d in (2, 1)]
    made = json.loads(features.coverage_json(rows, "PointSeries", {"t": "t", "x": "lat", "y": "lon"}, ["v"]))
    assert made["coverages"][0]["ranges"]["v"]["values"] == [1.0, 2.0]
    assert json.loads(features.coverage_json(rows, "MultiPoint", {"x": "lat", "y": "lon"}, ["v"]))["coverages"][0]["ranges"]["v"]["shape"] == [2]


def test_streams_and_views(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2000, 1, 1, 0, m), m, float(m)) for m in range(30)], "ts timestamp, level int, v double")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    cells = extracted(stream, ["level"], ["v", "ts"], L.Request(L.Span("level", 5, 14)))
    query = windowed(cells, "ts", "v", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("cut").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.cells, r.total) for r in spark.sql("select * from cut").collect()) == [(5, 35.0), (5, 60.0)]
    registry.view(cubes.mock(spark, {"x": 5}), L.Request(registry.shape("span", "x", 1, 3)), "some_cells")
    assert spark.sql("select count(*) n from some_cells").first().n == 3
    with pytest.raises(ValueError):
        registry.shape("blob")


def test_ranges_are_read_by_their_axis(spark):
    days = [dt.datetime(2024, 1, d) for d in range(1, 10)]
    rows = spark.createDataFrame([(d, f"{d:%Y%m%d}", f"{100 * d.day:04d}", d.day, str(d.day)) for d in days], "t timestamp, day string, code string, n int, short string")
    cube = L.Cube(rows, ["t", "day", "code", "n", "short"])

    def got(axis, value):
        rest = [L.All(a) for a in cube.axes if a != axis]
        return sorted(r.n for r in cube.retrieve(L.Request(features.axis_shape(axis, value), *rest)).collect())

    ends = {"start": "20240103", "end": "20240105"}
    for value, want in (
        ("20240103/to/20240105", [3, 4, 5]), (ends, [3, 4, 5]), ("20240103/to/20240105/by/1", [3, 4, 5]), ({**ends, "interval": 2}, [3, 5]), ("20240103", [3]), (["20240103", "20240107"], [3, 7]), ("20240105/to/20240103", [3, 4, 5]),
    ):
        assert got("t", value) == got("day", value) == want, value
    assert got("t", "2024-01-03/to/2024-01-05") == got("t", "2024-01-03T00:00:00Z/to/2024-01-05T01:00+01:00") == [3, 4, 5]
    assert got("t", "2024-01-03/to/2024-01-05/by/12h") == [3, 4, 5] and got("t", 20240103) == got("t", dt.datetime(2024, 1, 3)) == got("t", dt.datetime(2024, 1, 3).replace(tzinfo=dt.timezone.utc).timestamp()) == [3]
    assert got("code", "0200/0600") == got("code", "0200/to/0600/by/400") == [2, 6] and got("code", "0200/to/0400") == [2, 3, 4] and got("code", "0350/to/0800/by/50") == [4, 5, 6, 7, 8]
    assert got("short", "2/to/10") == list(range(2, 10)) and got("short", 3) == got("short", 3.0) == [3] and got("short", "7/to/9/by/2") == [7, 9] and got("short", "a/to/z") == []
    assert got("n", "2/to/6/by/2") == [2, 4, 6] and got("n", "3/5") == got("n", [3, "5"]) == [3, 5] and got("n", "2.5/to/4.5") == [3, 4] and got("n", "5/to/2/by/1") == []
    with pytest.raises(ValueError, match="no value"):
        got("code", "200")  # a code as it is written, not its number
    for axis, bad in (("n", "soon"), ("t", "soon"), ("day", "a/to/b/by/1"), ("n", "0/to/9/by/x"), ("n", "0/to/1e9/by/1"), ("t", "20240103/to/20240105/by/0")):
        with pytest.raises(BadRequest):
            got(axis, bad)
    text = features.axis_shape("code", "it's/to/x\\y").sql({"code": Axis("code", "category")})
    assert rows.where(text).count() == 0
