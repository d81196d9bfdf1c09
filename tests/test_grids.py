"""Cubes whose cells a grid numbers: arithmetic, ranges that reach the scan, neighbours; and what planning costs."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import lattisect as L
from lattisect.axes import Axis
from lattisect.errors import BadGrid, BadRequest, MissingValue
from lattisect.sources import cubes, grids

GRIDS = {
    "octahedral": lambda: grids.octahedral(12),
    "regular": lambda: grids.regular(6),
    "local": lambda: grids.local_regular([-20, 30, 10, 50], (10, 8)),
    "reduced": lambda: grids.reduced_ll([2, 6, 12, 18, 20, 18, 12, 6, 2]),
    "gaussian": lambda: grids.reduced_gaussian(4, [9, 14, 14, 20]),
    "healpix": lambda: grids.healpix(8),
    "nested": lambda: grids.Nested(8),
    "lambert": lambda: grids.Lambert(30, 20, 100_000, 100_000, 30.0, 350.0, 45.0, 10.0, 40.0, 50.0, major=6378137.0, minor=6356752.3),
}


def plain(grid):
    """(lat, lon) by number, without the grid's own formulas for numbers."""
    if isinstance(grid, grids.Lambert):
        i, j = np.meshgrid(np.arange(grid.nx), np.arange(grid.ny))
        return np.stack(grid.back(i.ravel().astype(float), j.ravel().astype(float)), axis=1)
    ring = grid.ring if isinstance(grid, grids.Nested) else grid
    return np.array([(lat, first + k * step) for lat, n, first, step in zip(ring.lats, ring.points, ring.first_lons, ring.steps) for k in range(n)])


@pytest.mark.parametrize("name", list(GRIDS))
def test_places_ranges_and_neighbours(spark, name):
    grid = GRIDS[name]()
    lat, lon = grid.places("id")
    rows = spark.range(-2, grid.size + 2).select("id", F.expr(lat).alias("lat"), F.expr(lon).alias("lon")).orderBy("id").collect()
    assert all(r.lat is None and r.lon is None for r in [*rows[:2], *rows[-2:]])
    got = np.array([(r.lat, r.lon) for r in rows[2:-2]])
    want = plain(grid)
    if name == "nested":
        cells = {(round(r.lat, 9), round(r.lon, 9)): r.cell for r in grid.cells(spark).collect()}
        assert [cells[round(a, 9), round(o, 9)] for a, o in got] == list(range(grid.size))
    else:
        assert np.allclose(got, want, atol=1e-9)
    rng = np.random.default_rng(5)
    for most in (1, 7, 64):
        for _ in range(12):
            a, o = np.sort(rng.uniform(-90, 90, 2)), np.sort(rng.uniform(-180, 400, 2))
            boxes = [(tuple(a), tuple(o)), ((10.0, 10.5), (20.0, 25.0))]
            ranges = grid.cell_ranges(boxes, most)
            assert len(ranges) <= most and all(x < y for x, y in ranges) and all(p[1] < q[0] for p, q in zip(ranges, ranges[1:]))
            if name in ("local", "lambert"):
                around = lambda w, e: (got[:, 1] >= w) & (got[:, 1] <= e) if name == "local" else (got[:, 1] - w) % 360 <= e - w
            else:
                around = lambda w, e: (got[:, 1] - w) % 360 <= e - w
            inside = np.zeros(len(got), bool)
            for (s, n), (w, e) in boxes:
                inside |= (got[:, 0] >= s) & (got[:, 0] <= n) & ((e - w >= 360) | around(w, e))
            covered = np.zeros(len(got), bool)
            for x, y in ranges:
                covered[x:y] = True
            assert not (inside & ~covered).any()
            if most == 64 and name not in ("nested", "lambert"):
                assert covered.sum() <= inside.sum() + 0.2 * len(got)
    for _ in range(30):
        a, o = (got[rng.integers(len(got))] + rng.uniform(-0.3, 0.3, 2)).tolist()
        aside = got[:, 1] - o if name == "local" else (got[:, 1] - o + 180) % 360 - 180
        far = (got[:, 0] - a) ** 2 + aside**2
        (found,) = grid.nearest(a, o)
        assert math.isclose((found[0] - a) ** 2 + (found[1] - o if name == "local" else (found[1] - o + 180) % 360 - 180) ** 2, far.min(), abs_tol=1e-9)
        assert found in [(pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9)) for x, y in got[far <= far.min() + 1e-9]]


def test_published_nested_numbers(spark):
    ring = grids.healpix(16).cells(spark).where("cell = 1504").first()
    at = lambda n, cell: grids.healpix(n).cells(spark).where(f"cell = {cell}").select(grids.nested_number(F.col("lat"), F.col("lon"), n).alias("c")).first().c
    assert ring.cell == 1504 and at(16, 1504) == 1130
    assert [at(n, 11) for n in (1, 2, 4, 8, 16)] == [11, 13, 61, 253, 1021]


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_region_is_ranges_to_the_scan(spark, tmp_path):
    grid = grids.octahedral(64)
    spark.range(grid.size).select(F.col("id").alias("values"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "f"))
    options = cubes.Options.parse({"axis_config": [{"axis_name": "values", "transformations": [{"name": "mapper", "type": "octahedral", "resolution": 64, "axes": ["lat", "lon"]}]}]})
    cube = cubes.configured(spark.read.parquet(str(tmp_path / "f")), ["values"], ["v"], options)
    for shape in (L.Box(["lat", "lon"], [10, 20], [12, 25]), L.Disk(["lat", "lon"], [10, 20], [1, 3])):
        cells = cube.retrieve(L.Request(shape))
        plan = plan_of(cells)
        assert "GreaterThanOrEqual(values," in plan and "LessThan(values," in plan and "Exchange" not in plan and "Join" not in plan
    box = cube.retrieve(L.Request(L.Box(["lat", "lon"], [10, 20], [40, 60])))
    assert box.count() == grid.cells(spark, (10, 40), (20, 60)).count() > 100
    both = cube.retrieve(L.Request(L.Union(["lat", "lon"], L.Box(["lat", "lon"], [10, 20], [12, 25]), L.Box(["lat", "lon"], [-60, 300], [-58, 310]))))
    assert both.count() == sum(grid.cells(spark, a, o).count() for a, o in (((10, 12), (20, 25)), ((-60, -58), (300, 310))))


def test_nearest_goldens(spark):
    grid = grids.octahedral(1280)
    assert math.isclose(grid.nearest(39, -76.45)[0][1], 283.561643835616, abs_tol=1e-9) == math.isclose(grid.nearest(39, 283.55)[0][1], 283.561643835616, abs_tol=1e-9) is True
    cloud = spark.createDataFrame([(0, 10.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 10.0), (3, 10.0, 10.0), (4, 5.0, 5.0)], "v int, lat double, lon double")
    cube = L.Cube(cloud, ["lat", "lon"], ["v"], engines={"lat": "quadtree", "lon": "quadtree"})
    at = lambda p, **more: sorted(r.v for r in cube.retrieve(L.Request(L.Point(["lat", "lon"], [p], method="nearest", **more))).collect())
    assert [at(p) for p in ([1, 1], [11, 11], [5.1, 5.1], [10, 0])] == [[1], [3], [4], [0]]
    assert at([4, 4], k=2) == [1, 4] and at([4, 4], k=9) == [0, 1, 2, 3, 4]
    points = {"name": "mapper", "type": "unstructured", "axes": ["lat", "lon"], "points": [[10, 10], [20, 10], [-5, 5], [5, 20]]}
    field = cubes.configured(spark.range(4).select(F.col("id").alias("cell"), F.col("id").alias("v")), ["cell"], ["v"], cubes.Options.parse({"axis_config": [{"axis_name": "cell", "transformations": [points]}]}))
    assert [sorted(r.v for r in field.retrieve(L.Request(L.Point(["lat", "lon"], [[11, 9]], "nearest", k))).collect()) for k in (1, 2, 3)] == [[0], [0, 1], [0, 1, 3]]
    nested = cubes.configured(spark.range(12 * 64).select(F.col("id").alias("cell"), F.col("id").alias("v")), ["cell"], ["v"],
                              cubes.Options.parse({"axis_config": [{"axis_name": "cell", "transformations": [{"name": "mapper", "type": "healpix_nested", "resolution": 8}]}]}))
    assert nested.retrieve(L.Request(L.Point(["lat", "lon"], [[12, 34]], method="nearest", k=3))).count() == 1  # one on a structured grid
    assert nested.retrieve(L.Request(L.Point(["lat", "lon"], [[12, 34]], method="surrounding"))).count() == 4
    for bad in ({"method": "next"}, {"k": 0}):
        with pytest.raises(ValueError):
            L.Point(["lat", "lon"], [[0, 0]], **bad)


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_cyclic_planning_looks_once(spark):
    rows = spark.range(360).select(F.col("id").cast("double").alias("lon"), F.col("id").alias("v"))
    ask = lambda cube, lo, hi: jobs(spark, lambda: cube.retrieve(L.Request(L.Span("lon", lo, hi))))
    cube = L.Cube(rows, [Axis("lon", period=(0.0, 360.0))], ["v"])
    one = ask(cube, -10, 3600)
    assert one <= 2 and [ask(cube, *span) for span in ((-10, 3600), (100, 36000), (5, 10))] == [0, 0, 0]
    assert ask(L.Cube(rows, [Axis("lon", period=(0.0, 360.0))], ["v"]), 5, 10) == 0
    known = L.Cube(rows, [Axis("lon", period=(0.0, 360.0))], ["v"], known={"lon": list(range(360))})
    assert ask(known, -10, 3600) == 0 and known.nearest("lon", [359.7]) == [359.0] and known.around("lon", [359.7]) == [0.0, 359.0]


def test_known_axes(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "kind string, level int, v double")
    options = cubes.Options.parse({"alternative_axes": [{"axis_name": "kind", "values": ["a", "b"]}, {"axis_name": "level", "values": [1, 2]}]})
    cube = cubes.configured(rows, ["kind", "level"], ["v"], options)
    request = L.Request(L.Select("kind", ["a"]), L.Select("level", [1.2], method="nearest"))
    assert jobs(spark, lambda: cube.retrieve(request)) == 0 and [r.v for r in cube.retrieve(request).collect()] == [1.0]
    with pytest.raises(MissingValue):
        cube.retrieve(L.Request(L.Select("kind", ["c"]), L.All("level")))
    for bad in ({"alternative_axes": [{"axis_name": "depth", "values": [1]}]}, {"alternative_axes": [{"axis": "level"}]}):
        with pytest.raises((BadRequest, TypeError)):
            cubes.configured(rows, ["kind", "level"], ["v"], cubes.Options.parse(bad))


def test_selections_of_any_size_have_one_tolerance(spark):
    rows = spark.createDataFrame([(0.1,), (0.1 + 4e-13,), (0.1 + 4e-12,), (0.30000000000000004,)], "x double")
    cube = L.Cube(rows, ["x"])
    for more in (0, 20, 5000):
        asked = L.Select("x", [0.1, 0.3, *[1 + i / 7 for i in range(more)]])
        assert sorted(r.x for r in cube.retrieve(L.Request(asked)).collect()) == [0.1, 0.1 + 4e-13, 0.30000000000000004]
    rng = np.random.default_rng(2)
    boxes = [L.Box(["x", "y"], p, p + rng.uniform(0, 0.1, 2)) for p in rng.uniform(0, 1, (300, 2))]
    points = rng.uniform(0, 1.1, (2000, 2))
    plane = L.Cube(spark.createDataFrame(points.tolist(), "x double, y double"), ["x", "y"])
    want = {tuple(p) for p in points.tolist() if any((b.low <= p).all() and (p <= b.high).all() for b in boxes)}
    assert {(r.x, r.y) for r in plane.retrieve(L.Request(L.Union(["x", "y"], *boxes))).collect()} == want and len(want) > 100


def test_known_reduced_grids():
    """Published sizes, the first rows and the last one."""
    for n, size, most in ((1441, 2612294, 2880), (3601, 16323354, 7200)):
        grid = grids.reduced_ll(n)
        assert grid.size == size and max(grid.points) == most and grid.points[:6] == (2, 6, 14, 20, 26, 32)
        assert grid.lats[-1] < -77.9 and len(grid.lats) == grids.REDUCED_LL[n][0]
    assert cubes.Mapper("reduced_ll", resolution=1441).grid() == grids.reduced_ll(1441)
    with pytest.raises(BadGrid):
        grids.reduced_ll(721)


def test_rows_without_a_pattern_are_found_in_bins(spark):
    grid = grids.reduced_ll(1441)
    rng = np.random.default_rng(2)
    cells = np.unique(np.concatenate([rng.integers(0, grid.size, 3000), grid.bases, grid.bases[1:] - 1, [grid.size - 1]]))
    rows = spark.createDataFrame([(int(c),) for c in [*cells, -1, grid.size, 10**12]], "cell bigint")
    lat, lon = grid.places("cell")
    found = {r.cell: (r.lat, r.lon) for r in rows.select("cell", F.expr(lat).alias("lat"), F.expr(lon).alias("lon")).collect()}
    row = np.searchsorted(grid.bases, cells, "right") - 1
    for c, r in zip(cells.tolist(), row.tolist()):
        assert found[c][0] == grid.lats[r] and math.isclose(found[c][1], (c - grid.bases[r]) * grid.steps[r], abs_tol=1e-9)
    assert found[-1] == found[grid.size] == found[10**12] == (None, None)


def test_catalogue(spark):
    rows = spark.createDataFrame([("a", "2", "x"), ("a", "1", "x"), ("a", "1", "x"), ("b", "z", "y"), ("b", None, "y"), (None, "q", "y")], "axis string, value string, p string")
    rows.createOrReplaceTempView("listed")
    assert cubes.catalogue_axes(spark, "listed") == {"a": ["1", "2"], "b": ["z"]}
    assert sorted((r.p, r.axis, r["values"], r.size) for r in cubes.catalogue(rows, path=["p"]).collect()) == [("x", "a", ["1", "2"], 2), ("y", "b", ["z"], 1)]
    for bad in (lambda: cubes.catalogue_axes(spark, "listed", most=2), lambda: (rows.limit(0).createOrReplaceTempView("none"), cubes.catalogue_axes(spark, "none"))):
        with pytest.raises(BadRequest):
            bad()
