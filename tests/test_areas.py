"""Points and areas as tables, against brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import lattisect as L
from lattisect.axes import Axis
from lattisect.errors import BadRequest
from lattisect.operators import areas, neighbours
from lattisect.store import written


def knn(points, queries, k, size=None):
    out = []
    for q, a, o in queries:
        far = []
        for i, x, y in points:
            dy = abs(y - o) % size if size else abs(y - o)
            far.append((round((x - a) ** 2 + (min(dy, size - dy) if size else dy) ** 2, 9), i))
        out += [(q, i, d, r) for r, (d, i) in enumerate(sorted(far)[:k], 1)]
    return sorted(out)


def cloud(n, seed):
    """Uneven: a dense spot, copies, and a few far away."""
    rng = random.Random(seed)
    spot = [(i, rng.gauss(40, 0.01), rng.gauss(100, 0.01)) for i in range(n // 2)]
    wide = [(i, rng.uniform(-80, 80), rng.uniform(0, 360)) for i in range(n // 2, n)]
    return [*spot, *wide, (n, 12.5, 7.0), (n + 1, 12.5, 7.0), (n + 2, 89.0, 359.9)]


@pytest.mark.parametrize(("k", "period", "block"), [(1, None, 20_000), (4, (0.0, 360.0), 50), (7, None, 30)])
def test_nearest_join(spark, k, period, block):
    points = cloud(300, k)
    rng = random.Random(k)
    asked = [(i, rng.uniform(-90, 90), rng.uniform(0, 360)) for i in range(25)] + [(30, 40.0, 100.0), (31, 12.5, 7.0), (32, 500.0, 9000.0 if not period else 9000.0), (33, -1e4, 0.05)]
    p = spark.createDataFrame([*points, (None, None, 3.0), (998, math.nan, 1.0), (999, math.inf, 1.0)], "idx int, lat double, lon double").repartition(3)
    q = spark.createDataFrame([*asked, asked[0], (50, None, 1.0)], "query int, lat double, lon double")
    plain = neighbours.nearest_join(p, q, k, period=period, block=block)
    got = neighbours.nearest_join(p, q, k, period=period, block=block, few=0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.collect()))
    assert sorted((r.query, r.idx, round(r.dist2, 9), r["rank"]) for r in got.collect()) == knn(points, asked, k, period and 360.0)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_tasks_of_a_nearest_join_follow_its_pairs(spark, monkeypatch):
    """A task sorts its pairs, which are many where the tables that they come from are small."""
    monkeypatch.setattr(neighbours, "PAIRS", 500)
    points, rng = cloud(97, 3), random.Random(4)
    asked = [(i, rng.uniform(-90, 90), rng.uniform(0, 360)) for i in range(40)]
    p, q = spark.createDataFrame(points, "idx int, lat double, lon double"), spark.createDataFrame(asked, "query int, lat double, lon double")
    got = neighbours.nearest_join(p, q, 2, block=7)  # 15 blocks of points meet 6 of queries
    assert sorted((r.query, r.idx, round(r.dist2, 9), r["rank"]) for r in got.collect()) == knn(points, asked, 2, None)
    assert "), REPARTITION_BY_NUM" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 8), REPARTITION_BY_NUM" in plan  # 4000 pairs


def test_nearest_join_of_few_points(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0)], "idx int, lat double, lon double")
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "query int, lat double, lon double")
    assert sorted((r.query, r.idx, r["rank"]) for r in neighbours.nearest_join(p, q, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert neighbours.nearest_join(p.limit(0), q, 2).count() == 0 == neighbours.nearest_join(p, q.limit(0), 2).count()


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_points_of_a_request_are_looked_up_together(spark, tmp_path):
    rng = random.Random(5)
    points = [(i, round(rng.uniform(-80, 80), 3), round(rng.uniform(0, 360), 3)) for i in range(2000)]
    spark.createDataFrame(points, "idx int, lat double, lon double").coalesce(1).write.parquet(str(tmp_path / "p"))
    cube = L.Cube(spark.read.parquet(str(tmp_path / "p")), ["lat", Axis("lon", period=(0.0, 360.0))], ["idx"], engines={"lat": "quadtree", "lon": "quadtree"})
    at = [(rng.uniform(-90, 90), rng.uniform(0, 360)) for _ in range(200)]
    request = lambda n, k: L.Request(L.Union(["lat", "lon"], *[L.Point(["lat", "lon"], [p], "nearest", k) for p in at[:n]]))
    for n, k in ((20, 1), (20, 3), (200, 1), (200, 2)):
        want = {i for _, i, _, _ in knn(points, [(0, *p) for p in at[:n]], k, 360.0)}
        began = time.time()
        assert {r.idx for r in cube.retrieve(request(n, k)).collect()} == want
        assert time.time() - began < 60
    few = [jobs(spark, f"few{n}", lambda n=n: cube.plan(request(n, 1))) for n in (2, 8, 32)]
    many = [jobs(spark, f"many{n}", lambda n=n: cube.plan(request(n, 1))) for n in (100, 200)]
    assert len(set(few)) == 1 and few[0] <= 2 and max(many) <= 40 and len(set(many)) == 1
    plain = L.Cube(spark.read.parquet(str(tmp_path / "p")), ["lat", "lon"], ["idx"])
    with pytest.raises(BadRequest, match="pairs"):
        plain.retrieve(L.Request(L.Point(["lat", "lon"], [[1, 2]], "nearest", 3)))


def rings(n, seed):
    """Stars, boxes, ones that cross themselves, holes, flat ones, one over all of the others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, r = rng.uniform(0, 50), rng.uniform(0, 50), rng.choice([0.01, 1, 8])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 5, 30])))
        star = [[x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)] for t in turns]
        if i % 7 == 0:
            rng.shuffle(star)
        out.append([star] if i % 5 else [star, [[x + 0.2 * (a - x), y + 0.2 * (b - y)] for a, b in star]])
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    return [*out, [box(-100, -100, 150, 150)], [box(10, 10, 20, 20)], [[[3, 3], [9, 9]]], [[[4, 4]]], [box(0, 0, 40, 40), box(10, 10, 30, 30)], []]


@pytest.mark.parametrize("border", [True, False])
def test_areas_as_a_table(spark, border):
    made = rings(60, 3)
    rng = np.random.default_rng(4)
    points = [(i, *p) for i, p in enumerate([*rng.uniform(-5, 55, (800, 2)).tolist(), *[(a, b) for a in (10.0, 15.0, 20.0, 4.0, 30.0) for b in (10.0, 13.0, 20.0, 4.0)], (6.0, 6.0), (None, 1.0), (200.0, 2.0), *[c for r in made[:20] for c in r[0][:2]]])]
    p = spark.createDataFrame([(i, None if a is None else float(a), float(b), "x") for i, a, b in points], "idx int, lat double, lon double, area_name string")
    a = spark.createDataFrame([(i, [[[float(v) for v in c] for c in r] for r in rs]) for i, rs in enumerate(made)] + [(900, None), (901, [[[1.0, None]]])], "area int, ring array<array<array<double>>>").repartition(3)
    for cells in (128, 8):
        got = areas.in_areas(p, a, border=border, cells=cells)
        assert got.columns == [*p.columns, "area"]
        found = {}
        for r in got.collect():
            assert r.idx not in found.setdefault(r.area, set())
            found[r.area].add(r.idx)
        flat = p.where("lat is not null").select("idx", "lat", "lon")
        for i, rs in enumerate(made):
            if len(rs) == 1:
                axes = {n: Axis(n) for n in ("lat", "lon")}
                want = {r.idx for r in flat.where(L.Polygon(["lat", "lon"], rs[0], border).sql(axes)).collect()}
                assert found.get(i, set()) == want, (i, cells)
        square = lambda low, high: {i for i, x, y in points if x is not None and low <= x <= high and low <= y <= high}
        inner = {i for i, x, y in points if x is not None and 10 < x < 30 and 10 < y < 30}
        edge = {i for i, x, y in points if x is not None and (x, y) in {(10.0, 13.0), (10.0, 10.0), (10.0, 20.0), (15.0, 10.0), (20.0, 10.0), (30.0, 10.0), (30.0, 13.0), (30.0, 20.0)}}
        assert found[64] == (square(0, 40) - inner if border else square(0, 40) - inner - edge)
    assert areas.in_areas(p, a.limit(0)).count() == 0 == areas.in_areas(p.limit(0), a).count()
    single = areas.in_areas(p, a.where("area = 61").select("area", F.col("ring")[0].alias("ring")), border=border)
    assert {r.idx for r in single.collect()} == found[61]


def test_ten_thousand_areas(spark):
    """Rhombi over a lattice of points: what they hold is known by arithmetic."""
    points = spark.range(90_000).select("id", (F.col("id") % 300).cast("double").alias("lat"), F.floor(F.col("id") / 300).cast("double").alias("lon"))
    made = spark.range(10_000).select(F.col("id").alias("area"), (F.col("id") % 100 * 3 + 0.25).alias("x"), (F.floor(F.col("id") / 100) * 3 + 0.25).alias("y"), (F.col("id") % 7 * 0.5 + 0.5).alias("r"))
    corner = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    made = made.withColumn("ring", F.array(corner(F.col("r"), F.lit(0)), corner(F.lit(0), F.col("r")), corner(-F.col("r"), F.lit(0)), corner(F.lit(0), -F.col("r"))))
    began = time.time()
    got = areas.in_areas(points, made)
    n = got.count()
    took = time.time() - began
    lat, lon = np.meshgrid(np.arange(300.0), np.arange(300.0), indexing="ij")
    want = 0
    for i in range(10_000):
        x, y, r = i % 100 * 3 + 0.25, i // 100 * 3 + 0.25, i % 7 * 0.5 + 0.5
        a, b = slice(max(0, int(x - r) - 1), int(x + r) + 2), slice(max(0, int(y - r) - 1), int(y + r) + 2)
        want += int((np.abs(lat[a, b] - x) + np.abs(lon[a, b] - y) <= r + 1e-9).sum())
    assert n == want and took < 120
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_unions_of_many_convex_shapes(spark):
    """The members' bins give what an OR of all members gives, for hulls, boxes, points, sweeps and in three axes."""
    rng = random.Random(8)
    n = 3000
    rows = spark.createDataFrame([(rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 5)) for _ in range(n)] + [(3.0, 4.0, 1.0), (5.5, 5.5, 2.0)], "a double, b double, c double").coalesce(2)
    axes = {x: Axis(x) for x in "abc"}
    corner = lambda d: [rng.uniform(0, 20) for _ in range(d)]
    two = [L.Box(["a", "b"], p := corner(2), [v + rng.random() for v in p]) for _ in range(15)]
    two += [L.Box(["b", "a"], p := corner(2), [v + rng.random() for v in p]) for _ in range(5)]
    two += [L.Disk(["a", "b"], corner(2), [0.6, 0.3]) for _ in range(15)] + [L.ConvexHull(["b", "a"], [corner(2) for _ in range(2)]) for _ in range(3)]
    two += [L.Point(["a", "b"], [[3.0, 4.0]]), L.Polygon(["a", "b"], [[1, 1], [2, 5], [3, 1], [2, 2]])]
    two += L.Path(["a", "b"], L.Box(["a", "b"], [-0.2, -0.2], [0.2, 0.2]), *[corner(2) for _ in range(9)], [5, 5], [6, 5]).shapes
    three = list(L.Path(["c", "a", "b"], L.Box(["c", "a", "b"], [-0.4] * 3, [0.4] * 3), *[[rng.uniform(0, 5), *corner(2)] for _ in range(30)]).shapes)
    three += [L.Ellipsoid(["a", "b", "c"], [*corner(2), 2], [1, 2, 1]) for _ in range(4)]
    one = [L.Box(["a"], [v], [v + 0.1]) for v in (x * 0.7 for x in range(25))]
    for names, members in ((["a", "b"], two), (["a", "b", "c"], three), (["a"], one)):
        text = L.Union(names, *members).sql(axes)
        want = " OR ".join(m.sql(axes) for m in members)
        assert text.count(" OR ") < 40
        got, plain = (sorted(tuple(r) for r in rows.where(t).collect()) for t in (text, want))
        assert got == plain and 10 < len(got) < n


def test_a_path_of_a_thousand_segments(spark):
    rows = spark.range(200_000).select((F.col("id") % 1000 / 10).alias("a"), (F.floor(F.col("id") / 1000) / 10).alias("b"))
    way = [[i / 10, 10 + 8 * math.sin(i / 40)] for i in range(1001)]
    path = L.Path(["a", "b"], L.Box(["a", "b"], [-0.05, -0.35], [0.05, 0.35]), *way)
    began = time.time()
    found = L.Cube(rows, ["a", "b"]).retrieve(L.Request(path)).collect()
    assert time.time() - began < 30
    assert 4000 < len(found) < 12_000 and all(abs(r.b - 10 - 8 * math.sin(r.a * 10 / 40)) < 0.6 for r in found)


def test_areas_with_the_same_rings_are_covered_once(spark, monkeypatch):
    """Every copy of an area has its points, and only different areas are cut into cells."""
    tables = {}

    def spied(df, name, *more):
        tables[name] = written(df, name, *more)
        return tables[name]

    monkeypatch.setattr(areas, "written", spied)
    points = spark.createDataFrame([(i, i % 9 + 0.5, i // 9 + 0.5) for i in range(81)], "idx int, lat double, lon double")
    rings = [[[float(k), 0.0], [k + 3.0, 0.0], [k + 3.0, 5.0], [float(k), 5.0]] for k in range(4)]
    table = spark.createDataFrame([(i, rings[i % 4]) for i in range(40)], "area int, ring array<array<double>>")
    got = sorted((r["idx"], r["area"]) for r in areas.in_areas(points, table).collect())
    assert got == sorted((i, a) for i in range(81) for a in range(40) if a % 4 < i % 9 + 0.5 < a % 4 + 3 and i // 9 + 0.5 < 5)
    assert tables["covers"].select("area").distinct().count() == 4
