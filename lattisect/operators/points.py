"""Points in a plane: in a shape, with or without its border, and the nearest ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..plans.request import ENGINES
from ..shapes import Shape, opened


def points_in(points: DataFrame, shape: Shape, engine: str = "hull") -> DataFrame:
    """Points in a shape over two of their columns; the engine decides whether its border belongs to it.

    The bounding box is compared by columns and reaches the scan; there is no index to build.
    """
    axes = {a: Axis.of(a, points.schema[a].dataType) for a in shape.axes}
    return points.where((shape if ENGINES[engine]["border"] else opened(shape)).sql(axes))


def haversine(lat1: F.Column, lon1: F.Column, lat2: F.Column, lon2: F.Column, radius: float = 6371.0) -> F.Column:
    """Kilometres along the sphere between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def nearest_points(
    points: DataFrame, queries: Sequence[tuple[float, float]], k: int = 1, idx: str = "idx", lat: str = "lat", lon: str = "lon", sphere: bool = False
) -> DataFrame:
    """For each query point of a stated list, its k nearest: (query, idx, lat, lon, dist2, rank); ties by idx.

    Every point meets every query in one scan. Tasks keep k rows for each query before anything is exchanged, so
    what is shuffled doesn't grow with the points. Distances are squared planar degrees, or kilometres on a ``sphere``.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("query"), F.lit(float(a)).alias("qa"), F.lit(float(o)).alias("qo")) for i, (a, o) in enumerate(queries)])
    rows = points.select(F.col(idx), F.col(lat), F.col(lon), F.explode(listed).alias("q"))
    a, o = F.col(lat) - F.col("q.qa"), F.col(lon) - F.col("q.qo")
    dist = haversine(F.col(lat), F.col(lon), F.col("q.qa"), F.col("q.qo")) if sphere else a * a + o * o
    rows = rows.select(F.col("q.query").alias("query"), F.col(idx), F.col(lat), F.col(lon), dist.alias("dist2"))
    order = Window.partitionBy("query").orderBy("dist2", idx)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_to_each(points: DataFrame, queries: DataFrame, radius: float, k: int = 1, idx: str = "idx", lat: str = "lat", lon: str = "lon", query: str = "query") -> DataFrame:
    """For each row of a table of queries, its k nearest points within ``radius`` degrees: a join on cells of that size.

    A query looks into the nine cells around it, so it meets only points that may be near enough.
    """
    cell = lambda c: F.floor(c / radius).cast("bigint")
    by_cell = points.select(F.col(idx), F.col(lat), F.col(lon), cell(F.col(lat)).alias("ca"), cell(F.col(lon)).alias("co"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = queries.select(F.col(query), F.col(lat).alias("qa"), F.col(lon).alias("qo"), around.alias("d"))
    asked = asked.select(query, "qa", "qo", (cell(F.col("qa")) + F.col("d.i")).alias("ca"), (cell(F.col("qo")) + F.col("d.j")).alias("co"))
    a, o = F.col(lat) - F.col("qa"), F.col(lon) - F.col("qo")
    met = by_cell.join(asked, ["ca", "co"]).withColumn("dist2", a * a + o * o).where(F.col("dist2") <= radius * radius * (1 + 1e-12))
    order = Window.partitionBy(query).orderBy("dist2", idx)
    return met.select(query, idx, lat, lon, "dist2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

