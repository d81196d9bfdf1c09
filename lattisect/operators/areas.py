"""A table of areas against points: each different area is covered by cells of a quadtree, and cells are joined by their numbers.

Cells that an area fills take their points without a test. Those on its border keep the few sides that a ray from inside them can meet, and
points are tested against these alone. An area has at most ``CELLS`` cells, of whatever sizes suit it, so a point
meets only areas nearby, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..geometry import EPSILON
from ..store import written

#: Cells of an area's cover, about; levels of the quadtree; how far outside its sides' ranges a point of a border may be.
CELLS, LEVELS, TOLERANCE = 128, 28, 1e-12
#: Areas that are covered at once, and by a task.
STEP, TASK = 64, 256
_SIDE = "struct<x1:double,y1:double,x2:double,y2:double,slope:double,nx:double,ny:double>"


def _sides(rings: list[np.ndarray]) -> np.ndarray:
    """(x1, y1, x2, y2) of the sides of closed rings; a ring of one point is one side."""
    out = []
    for ring in rings:
        ends = np.roll(ring, -1, axis=0)
        apart = (ring != ends).any(axis=1)
        own = np.concatenate([ring, ends], axis=1)
        out.append(own[apart] if apart.any() else own[:1])
    return np.concatenate(out) if out else np.empty((0, 4))


def inside(sides: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether points that are on no side are inside: an odd number of sides lies ahead of them."""
    x1, y1, x2, y2 = sides.T
    x, y = points[:, :1], points[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(y1 != y2, (x2 - x1) / np.where(y1 != y2, y2 - y1, 1), 0) * (y - y1) + x1
    return (((y1 > y) != (y2 > y)) & (x < at)).sum(axis=1) % 2 == 1


def cover(sides: np.ndarray, low: np.ndarray, extent: float, cells: int = CELLS) -> list[tuple[int, int, int, bool, np.ndarray]]:
    """(level, i, j, whether the area fills it, sides) for the cells that cover an area: leaves of a quadtree over the square at ``low``."""
    if not len(sides):
        return []
    ends = sides.reshape(-1, 2)
    first, last = ends.min(axis=0), ends.max(axis=0)
    size = float((last - first).max())
    level = int(np.clip(np.floor(np.log2(extent / size)) if size > 0 else LEVELS, 0, LEVELS))
    middle, half = (sides[:, :2] + sides[:, 2:]) / 2, np.abs(sides[:, 2:] - sides[:, :2]) / 2
    way = (sides[:, 2:] - sides[:, :2]) / 2
    wide = max(1e-9 * size, 4 * TOLERANCE) + 1e-15 * np.abs(ends).max()

    def met(at: np.ndarray, level: int) -> np.ndarray:
        """Which sides come near which cells."""
        side = extent / 2**level
        reach = side / 2 * (1 + 1e-9) + wide
        apart = middle[None] - (low + (at + 0.5) * side)[:, None]
        near = (np.abs(apart) <= reach + half[None]).all(axis=2)
        return near & (np.abs(way[:, 0] * apart[:, :, 1] - way[:, 1] * apart[:, :, 0]) <= reach * (half[:, 0] + half[:, 1]))

    side = extent / 2**level
    a, b = (np.clip(np.floor((v - low) / side), 0, 2**level - 1).astype(int) for v in (first - wide, last + wide))
    todo = np.array([(i, j) for i in range(a[0], b[0] + 1) for j in range(a[1], b[1] + 1)])
    out: list[tuple[int, int, int, bool, np.ndarray]] = []
    while True:
        crossed = met(todo, level).any(axis=1)
        rest = todo[~crossed]
        for i, j in rest[inside(sides, low + (rest + 0.5) * (extent / 2**level))] if len(rest) else rest:
            out.append((level, int(i), int(j), True, sides[:0]))
        todo = todo[crossed]
        if level == LEVELS or len(out) + 4 * len(todo) > cells or not len(todo):
            break
        level += 1
        todo = (2 * todo[:, None] + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])[None]).reshape(-1, 2)
    side = extent / 2**level
    x, y = (low + todo * side).T[:, :, None]
    ahead = (np.maximum(sides[:, 0], sides[:, 2]) >= x - wide - 1e-9 * side) & (np.minimum(sides[:, 1], sides[:, 3]) <= y + side * (1 + 1e-9) + wide) & (np.maximum(sides[:, 1], sides[:, 3]) >= y - 1e-9 * side - wide)
    out += [(level, i, j, False, sides[own]) for (i, j), own in zip(todo.tolist(), ahead)]
    return out


def _number(level: int, i: int, j: int) -> int:
    return level << 56 | i << 28 | j


def covers(areas: DataFrame, area: str, ring: str, low: tuple[float, float], extent: float, cells: int = CELLS) -> DataFrame:
    """(area, cell, level, filled, sides) for every cell of every area."""
    id_type = areas.schema[area].dataType.simpleString()
    corner = np.array(low)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides_type = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2", "slope", "nx", "ny")])
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            found, spans = [], []
            for row, rings in enumerate(batch.column(1).to_pylist()):
                sides = _sides([np.array([p for p in r], float).reshape(-1, 2) for r in rings if r])
                own = [(row, *c) for c in cover(sides, corner, extent, cells)]
                found += own
                spans += [np.maximum(np.ptp(sides.reshape(-1, 2), axis=0), 1e-300) if len(sides) else np.ones(2)] * len(own)
            counts = [len(c[-1]) for c in found]
            own, span = np.concatenate([np.empty((0, 4)), *[c[-1] for c in found]]), np.repeat(np.array(spans).reshape(-1, 2), counts, axis=0)
            d = own[:, 2:] - own[:, :2]
            unit = d / span
            length = np.hypot(unit[:, 0], unit[:, 1])
            unit = unit / np.where(length > 0, length, 1)[:, None] / span[:, ::-1]
            slope = np.where(d[:, 1] != 0, d[:, 0] / np.where(d[:, 1] != 0, d[:, 1], 1), 0)
            flat = pa.StructArray.from_arrays([pa.array(v) for v in np.column_stack([own, slope, unit[:, 1], unit[:, 0]]).T.copy()], fields=list(sides_type))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat)
            take = lambda i, kind: pa.array([c[i] for c in found], kind)  # noqa: B023, E731
            numbers = pa.array([_number(*c[1:4]) for c in found], pa.int64())
            arrays = [batch.column(0).take(take(0, pa.int64())), numbers, take(1, pa.int32()), take(4, pa.bool_()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["area", "cell", "level", "filled", "sides"])

    return areas.select(F.col(area).alias("area"), F.col(ring).alias("rings")).mapInArrow(of, f"area {id_type}, cell bigint, level int, filled boolean, sides array<{_SIDE}>")


def in_areas(points: DataFrame, areas: DataFrame, x: str = "lat", y: str = "lon", area: str = "area", ring: str = "ring", border: bool = True, cells: int = CELLS) -> DataFrame:
    """``points`` in each of ``areas``: a row of a point's columns and ``area`` for every row of either that go together.

    ``ring`` is a list of corners (each a list of two numbers), or a list of such rings: inside is what an odd number of sides is crossed
    from, so rings in rings are holes and rings may cross themselves. Their border belongs to them, to a billionth of their size, unless ``border``
    says otherwise. Points with null coordinates and areas that are null or have no corners or a corner that is null are in nothing.
    """
    kind = areas.schema[ring].dataType.simpleString()
    rings = F.col(ring) if kind.count("array") == 3 else F.array(F.col(ring))
    whole = F.forall(F.flatten(rings), lambda p: p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    known = areas.select(F.col(area).alias("area"), rings.cast("array<array<array<double>>>").alias("rings")).where(F.col(ring).isNotNull() & F.forall(rings, lambda r: r.isNotNull()) & whole)
    of = lambda i: F.transform(F.flatten("rings"), lambda p: p[i])
    ends = [f(of(i)) for i in (0, 1) for f in (F.array_min, F.array_max)]
    box = known.agg(F.min(ends[0]), F.max(ends[1]), F.min(ends[2]), F.max(ends[3])).first()
    out = [F.col(f"`{c}`") for c in points.columns]
    if box[0] is None:
        return points.select(*out, F.lit(None).cast(areas.schema[area].dataType).alias("area")).where("false")
    wide = 1e-9 * max(box[1] - box[0], box[3] - box[2], 1e-3)
    low, extent = (box[0] - wide, box[2] - wide), max(box[1] - box[0], box[3] - box[2]) + 4 * wide
    # areas with the same rings are covered and met once
    known = known.withColumn("digest", F.sha2(F.col("rings").cast("string"), 256))
    alike = written(known.groupBy("digest").agg(F.first("rings").alias("rings")).withColumn("shape", F.monotonically_increasing_id()), "shapes")
    owners = written(known.select("area", "digest"), "owners").join(alike.select("digest", "shape"), "digest").select("shape", "area")
    cover_of = written(covers(alike.repartition(alike.count() // TASK + 1), "shape", "rings", low, extent, cells), "covers")
    levels = sorted(r["level"] for r in cover_of.select("level").distinct().collect())  # as many as the quadtree has
    px, py = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    at = lambda v, start, level: F.floor((v - start) / (extent / 2**level))
    keys = [F.lit(level << 56) + at(px, low[0], level) * (1 << 28) + at(py, low[1], level) for level in levels]
    some = points.where((px >= box[0] - wide) & (px <= box[1] + wide) & (py >= box[2] - wide) & (py <= box[3] + wide))
    rows = some.select(F.struct(*out).alias("row"), px.alias("x"), py.alias("y"), F.explode(F.array(*keys) if keys else F.array().cast("array<bigint>")).alias("cell"))
    X, Y = F.col("x"), F.col("y")
    odd = F.aggregate("sides", F.lit(0), lambda n, s: n + F.when(((s["y1"] > Y) != (s["y2"] > Y)) & (X < s["slope"] * (Y - s["y1"]) + s["x1"]), 1).otherwise(0)) % 2 == 1
    reached = lambda v, a, b: (v >= F.least(a, b) - TOLERANCE) & (v <= F.greatest(a, b) + TOLERANCE)
    touched = F.exists("sides", lambda s: reached(X, s["x1"], s["x2"]) & reached(Y, s["y1"], s["y2"]) & (F.abs((X - s["x1"]) * s["nx"] - (Y - s["y1"]) * s["ny"]) <= EPSILON))
    test = (odd | touched) if border else (odd & ~touched)
    met = rows.join(cover_of.select(F.col("area").alias("shape"), "cell", "filled", "sides"), "cell").where(F.col("filled") | test)
    found = met.select("row", "shape").join(owners, "shape")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in points.columns], "area")
