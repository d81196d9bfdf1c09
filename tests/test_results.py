"""Value blocks, trees for the wire, stores for ranges, facts pruned by points, laps by arithmetic, coverages by executors."""

import datetime as dt
import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import lattisect as L
from lattisect import cube as cubes_of
from lattisect.axes import Axis
from lattisect.operators import results
from lattisect.plans import features
from lattisect.sources import cubes, grids


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_value_blocks(spark, block):
    rng = random.Random(block)
    cells = {(rng.choice(["a", None, "it's"]), rng.randrange(6), rng.choice([0.5, 1.5, -2.0]), rng.choice("xyz")): float(i) for i in range(90)}
    rows = [(*c, v, int(v)) for c, v in cells.items()]
    twice = [(*list(cells)[0], 1000.0, 7), (*list(cells)[0], -5.0, None), (*list(cells)[3], None, 3)]
    df = spark.createDataFrame([*rows, *twice, ("a", None, 0.5, "x", 1.0, 1)], "p string, i int, d double, s string, v double, start int")
    made = results.value_blocks(df, ["p"], ["i", "d", "s"], ["v"], block)
    keys = {}
    for r in made.collect():
        own = {c: v for c, v in cells.items() if c[0] == r.p}
        axes = [sorted({c[n] for c in own}) for n in (1, 2, 3)]
        assert [r.i, r.d, r.s] == axes and r["shape"] == [len(a) for a in axes]
        flat = [(r.p, a, b, c) for a in axes[0] for b in axes[1] for c in axes[2]]
        at = flat[r.start : r.start + block]
        assert r.start % block == 0 and len(r.v) == len(at)
        for c, v in zip(at, r.v):
            assert v == cells.get(c) or c in (list(cells)[0], list(cells)[3])
        keys.setdefault(r.p, []).append(r.start)
    assert all(len(set(v)) == len(v) for v in keys.values())
    back = sorted(map(repr, (tuple(r) for r in results.unblocked(made, ["p"], ["i", "d", "s"], ["v"]).collect())))
    assert back == sorted(repr(tuple(r[:5])) for r in [*rows, *twice] if r[4] is not None)
    with pytest.raises(L.cube.BadRequest):
        results.value_blocks(df, ["p"], ["i"], ["start"])
    alone = results.value_blocks(df.where("p = 'a'").drop("p").withColumnRenamed("start", "w"), [], ["i", "s"], ["v", "w"], block)
    assert alone.agg(F.sum(F.size("again"))).first()[0] > 0
    assert results.unblocked(alone, [], ["i", "s"], ["v", "w"]).count() == df.where("p = 'a' and i is not null and (v is not null or start is not null)").count()
    assert results.value_blocks(df.limit(0), ["p"], ["i"], ["v"]).count() == 0


def test_wire_trees(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.randrange(60), rng.random()) for _ in range(400)] + [("a", 1, 5, None), ("z", 0, 3, 1.0)]
    df = spark.createDataFrame(rows, "param string, step int, cell bigint, v double")
    for root in ([], ["param"]):
        trees = results.wired(df, ["param", "step"], "cell", ["v"], root)
        results.encode(trees, str(tmp_path / f"t{len(root)}"))
        read = results.decode(spark, str(tmp_path / f"t{len(root)}"))
        back = results.unwired(read, ["param", "step"], "cell", ["v"], root)
        assert back.columns == df.columns and sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
        assert read.count() == (4 if root else 1)
    tree = {t.value: t.below for t in results.wired(df, ["param", "step"], "cell", ["v"]).first().tree}
    assert [tuple(r) for r in tree["z"][0].below.runs] == [(3, 1)]
    n = [len(set(r[2] for r in rows if r[0] == "a" and r[1] == 1)), sum(r.size for b in tree["a"] if b.value == 1 for r in b.below.runs)]
    assert n[1] == sum(r[0] == "a" and r[1] == 1 for r in rows) >= n[0]
    grid = grids.octahedral(8)
    placed = results.unwired(results.wired(df.where("cell < 50"), ["param", "step"], "cell", ["v"]), ["param", "step"], "cell", ["v"], grid=grid)
    assert placed.columns == ["param", "step", "lat", "lon", "cell", "v"]
    where = {r.cell: (r.lat, r.lon) for r in grid.cells(spark).collect()}
    assert all(math.isclose(r.lat, where[r.cell][0]) and math.isclose(r.lon, where[r.cell][1], abs_tol=1e-9) for r in placed.collect())


def groups_read(spark, path, test):
    """(row groups of a store, those that a scan with ``test`` reads): by the statistics that the scan prunes with."""
    import glob

    import pyarrow.dataset as ds

    files = ds.dataset(glob.glob(f"{path}/*.parquet"), format="parquet")
    fragments = list(files.get_fragments())
    every = sum(f.num_row_groups for f in fragments)
    return every, sum(len(f.subset(filter=test).row_groups) for f in fragments)


def test_store_for_ranges(spark, tmp_path):
    import pyarrow.dataset as ds

    rows = spark.range(400_000).select((F.hash("id") % 1000 / 10.0).alias("lat"), (F.xxhash64("id") % 3600 / 10.0).alias("lon"), F.col("id").alias("v"), F.when(F.col("id") % 1000 > 0, F.col("id")).alias("cell"))
    results.store(rows, f"file://{tmp_path}/z", ["lat", "lon"], files=8, row_group=32 << 10)
    results.store(rows, f"file://{tmp_path}/cell", ["cell"], files=8, row_group=32 << 10)
    box = (ds.field("lat") >= 10) & (ds.field("lat") <= 20) & (ds.field("lon") >= 30) & (ds.field("lon") <= 60)
    every, read = groups_read(spark, tmp_path / "z", box)
    assert every >= 40 and read < 0.1 * every
    every, read = groups_read(spark, tmp_path / "cell", (ds.field("cell") >= 5000) & (ds.field("cell") <= 9000))
    assert every >= 40 and read < 0.1 * every
    for name in ("z", "cell"):
        back = spark.read.parquet(str(tmp_path / name))
        assert back.columns == rows.columns and back.agg(F.sum("v"), F.count("*"), F.count("cell")).first() == rows.agg(F.sum("v"), F.count("*"), F.count("cell")).first()
    found = L.Cube.from_parquet(spark, str(tmp_path / "z"), ["lat", "lon"], ["v"]).retrieve(L.Request(L.Box(["lat", "lon"], [10, 30], [20, 60])))
    assert found.count() == rows.where("lat between 10 and 20 and lon between 30 and 60").count()
    results.store(rows.limit(0), f"file://{tmp_path}/none", ["lat", "lon"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_facts_get_the_ranges_of_points(spark, tmp_path):
    points = spark.range(10_000).select(F.col("id").alias("cell"), (90 - F.floor(F.col("id") / 100) * 1.8).alias("lat"), (F.col("id") % 100 * 3.6).alias("lon"))
    points.write.parquet(str(tmp_path / "points"))
    facts = spark.range(30_000).select((F.col("id") % 10_000).alias("values"), F.floor(F.col("id") / 10_000).cast("int").alias("step"), F.col("id").alias("v"))
    facts.repartitionByRange(4, "values").sortWithinPartitions("values").write.parquet(str(tmp_path / "facts"))
    for given in (str(tmp_path / "points"), spark.read.parquet(str(tmp_path / "points"))):
        options = cubes.Options.parse({"axis_config": [
            {"axis_name": "values", "transformations": [{"name": "mapper", "type": "unstructured", "axes": ["lat", "lon"], "points": given}]}, {"axis_name": "lon", "transformations": [{"name": "cyclic", "range": [0, 360]}]},
        ]})
        cube = cubes.configured(spark.read.parquet(str(tmp_path / "facts")), ["step", "values"], ["v"], options)
        places = points.collect()
        for shape, want in (
            (L.Box(["lat", "lon"], [10, -20], [30, 20]), {p.cell for p in places if 10 <= p.lat <= 30 and (p.lon >= 340 - 1e-9 or p.lon <= 20)}),
            (L.Point(["lat", "lon"], [[37, 91.2]], "nearest"), {min(places, key=lambda p: ((p.lat - 37) ** 2 + (p.lon - 91.2) ** 2, p.lat, p.lon)).cell}),
            (L.Box(["lat", "lon"], [200, 0], [201, 1]), set()),
            (L.Polygon(["lat", "lon"], [[0, 10], [20, 10], [0, 40]]), {p.cell for p in places if 0 <= p.lat and p.lon >= 10 - 1e-9 and p.lat / 20 + (p.lon - 10) / 30 <= 1 + 1e-9}),
        ):
            found = cube.retrieve(L.Request(L.Select("step", [1]), shape))
            got = found.collect()
            assert {r.v - 10_000 for r in got} == want and len(got) == len(want)
            if len(want) > 1:
                scans = re.findall(r"PushedFilters: \[(.*?)\]\n", found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
                assert any("GreaterThanOrEqual(values" in s and "EqualTo(step,1)" in s or "GreaterThanOrEqual(values" in s and "step" in s for s in scans)


def laps_of(spark, monkeypatch, cube, request):
    monkeypatch.setattr(cubes_of, "WRITTEN", 10**9)
    plain = sorted(tuple(r) for r in cube.retrieve(request).collect())
    monkeypatch.setattr(cubes_of, "WRITTEN", 0)
    counted = sorted(tuple(r) for r in cube.retrieve(request).collect())
    assert counted == plain
    return counted


def test_laps_by_arithmetic(spark, monkeypatch):
    tenths = [round(i / 10, 1) for i in range(11)]
    for values in (tenths, tenths[:-1]):
        rows = cubes.dense(spark, {"long": values, "b": [0.0, 90.0, 180.0, 270.0]}).df
        cube = L.Cube(rows, [Axis("long", period=(0.0, 1.0)), Axis("b", period=(0.0, 360.0))], ["value"])
        for lo, hi in ((0.8, 1.7), (0, 1), (1, 2), (1, 1), (0, 0), (2, 2), (-1, -1), (0.3, 2.7), (-0.7, -0.3), (1.0, 1.0), (-3, -2.5), (0.95, 0.97), (5, 9)):
            laps_of(spark, monkeypatch, cube, L.Request(L.Span("long", lo, hi), L.All("b")))
        assert laps_of(spark, monkeypatch, cube, L.Request(L.Span("long", -0.25, 0.25), L.Span("b", 350, 1000)))
        assert laps_of(spark, monkeypatch, cube, L.Request(L.Disk(["long", "b"], [1.0, 0.0], [0.35, 100.0])))
        assert laps_of(spark, monkeypatch, cube, L.Request(L.Union(["long"], L.Span("long", 3.05, 3.25), L.Span("long", -1.0, -0.9)), L.Select("b", [450, -90])))
        assert laps_of(spark, monkeypatch, cube, L.Request(L.Span("long", 0.75, math.inf), L.Span("b", -30, 100)))
    began = time.time()
    found = cube.retrieve(L.Request(L.Span("long", 0.35, 9000.0), L.Span("b", 80, 100)))
    assert time.time() - began < 1 and found.count() == 10
    began = time.time()
    many = cube.retrieve(L.Request(L.Union(["long"], L.Span("long", 0.35, 0.45), L.Span("long", 9000.15, 9000.25)), L.All("b")))
    assert time.time() - began < 1 and sorted({r.long for r in many.collect()}) == [0.2, 0.4]


def test_coverages_by_executors(spark):
    rng = random.Random(2)
    rows = [(dt.datetime(2000, 1, d, 0, 0, 0, m), lat, lon, lev, rng.choice([rng.random(), None, math.nan]), rng.randrange(9)) for d in (1, 2, 3) for m in (0, 250_000) for lat in (1.5, -2.0) for lon in (2.0,) for lev in (850, 500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, 't timestamp, lat double, lon double, lev int, v double, `it"s` int')
    axes = {"t": "t", "x": "lat", "y": "lon", "z": "lev"}
    for kind in ("PointSeries", "VerticalProfile", "Trajectory", "MultiPoint"):
        got = [json.loads(r.coverage) for r in features.coverages(df, kind, axes, ["v", 'it"s']).collect()]
        ordered = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["t"], r["lat"], r["lon"], r["lev"]))
        plain = [{**r, "v": None if r["v"] is None or math.isnan(r["v"]) else r["v"]} for r in ordered]
        want = json.loads(features.coverage_json(plain, kind, axes, ["v", 'it"s']))["coverages"]
        key = lambda c: json.dumps(c, sort_keys=True)
        assert sorted(map(key, got)) == sorted(map(key, want)), kind
    by = features.coverages(df, "Trajectory", axes, ["v"], by=["lev"])
    assert by.columns == ["lev", "coverage"] and by.count() == 2
    with pytest.raises(L.cube.BadRequest):
        features.coverages(df, "Grid", axes, ["v"])
