"""The k nearest points of each row of a table of queries: a join on grids whose cells double until a query is sure.

A round looks at the nine cells around each query, which have all points up to the side of a cell away. A query is done once its
k-th distance is less than what it hasn't seen can be; the others go on to cells of twice the side. Only points of cells that are still
asked for are joined, points and queries of a dense cell in blocks, and each task keeps k rows for a query and block before anything is exchanged.
To keep them it sorts its pairs, so tasks follow the count of pairs and not the small tables that these come from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

#: Points of an average cell of the finest grid, for each of the k that are asked for; points, and queries, of a block of a cell.
POINTS, BLOCK = 4, 1000
#: Pairs of points and queries that a task sorts, about.
PAIRS = 1_000_000
#: Pairs of points and queries that are compared without grids.
FEW = 20_000_000
#: What rounding may take from the side of a cell.
SLACK = 1 - 1e-9
#: Levels at most: the finest cells are a part of the extent that a whole number of 30 bits can count.
LEVELS = 30


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group by dist2 and then idx; tasks leave out all others before the exchange."""
    order = Window.partitionBy(*by).orderBy("dist2", "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_join(
    points: DataFrame, queries: DataFrame, k: int = 1, idx: str | Column = "idx", lat: str = "lat", lon: str = "lon", query: str = "query",
    period: tuple[float, float] | None = None, block: int = BLOCK, few: int = FEW,
) -> DataFrame:
    """For each row of ``queries``, its k nearest points: (query, idx, lat, lon, dist2, rank), without a radius and exact.

    Distances are squared degrees in the plane, or with a ``period`` of longitudes, the short way round it. Ties go by ``idx``. Where there are
    fewer than k points a query has all of them. Points and queries with a null coordinate, or one that isn't finite, are left out;
    a query that stands there twice has its rows once, if its coordinates are the same. The number of jobs follows that of the
    rounds, which is the logarithm of the unevenness of the points at most, and not the number of queries; where points times queries
    are ``few``, one round compares them all, in blocks.
    """
    size = (period[1] - period[0]) if period else None
    own = idx if isinstance(idx, Column) else F.col(idx)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    turned = lambda c: F.pmod(c - period[0], F.lit(size)) if period else c
    a, o = F.col(lat).cast("double"), F.col(lon).cast("double")
    some = points.where(finite(a) & finite(o)).select(own.alias("idx"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), a.alias("x"), turned(o).alias("y"))
    asked = queries.where(finite(a) & finite(o)).select(F.col(query).alias("query"), a.alias("qx"), turned(o).alias("qy")).distinct()
    seen = some.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    schema = some.select(F.lit(None).cast(queries.schema[query].dataType).alias("query"), "idx", "lat", "lon", F.lit(0.0).alias("dist2"), F.lit(0).alias("rank"))
    if not seen["n"]:
        return schema.where("false")
    low_x, high_x = seen["lowx"], seen["highx"]
    low_y, high_y = (0.0, size) if period else (seen["lowy"], seen["highy"])
    extent = max(high_x - low_x, high_y - low_y, 1e-9)
    if period:
        extent = size * 2 ** max(0, math.ceil(math.log2(max(extent / size, 1))))
    parts = max(1.0, seen["n"] / (POINTS * k))
    area = max(high_x - low_x, 1e-9 * extent) * max(high_y - low_y, 1e-9 * extent)
    levels = 0 if seen["n"] * asked.count() <= few else max(0, min(LEVELS - 1, round(math.log2(extent / math.sqrt(area / parts)))))
    # a query off the extent is looked for from the point of it that is nearest; its way there adds to all distances
    clamp = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    px, py = clamp(F.col("qx"), low_x, high_x), F.col("qy") if period else clamp(F.col("qy"), low_y, high_y)
    left = asked.select("query", "qx", "qy", px.alias("px"), py.alias("py")).withColumn("off", F.pow(F.col("qx") - F.col("px"), 2) + F.pow(F.col("qy") - F.col("py"), 2))
    out: DataFrame | None = None
    for level in range(levels, -1, -1):
        side = extent / 2**level
        around = round(size / side) if period and side < size else 1 if period else None  # cells of a circle

        def cell(x: Column, y: Column) -> tuple[Column, Column]:
            i, j = F.floor((x - low_x) / side), F.floor((y - low_y) / side)
            return i, (F.least(j, F.lit(around - 1)) if around else j)  # noqa: B023

        i, j = cell(F.col("px"), F.col("py"))
        sides = F.array(*[j + d if around is None else F.pmod(j + d, F.lit(around)) for d in (-1, 0, 1)])
        cells = F.explode(F.transform(F.array_distinct(sides), lambda c: c)).alias("cj")
        near = left.select("query", "qx", "qy", i.alias("i"), cells).select("query", "qx", "qy", F.explode(F.array(*[F.col("i") + d for d in (-1, 0, 1)])).alias("ci"), "cj")
        near = written(near, "asked")
        ci, cj = cell(F.col("x"), F.col("y"))
        there = written(some.withColumns({"ci": ci, "cj": cj}).join(near.select("ci", "cj").distinct(), ["ci", "cj"], "left_semi"), "there")
        counts = there.groupBy("ci", "cj").agg(F.count("*").alias("n")).join(near.groupBy("ci", "cj").agg(F.count("*").alias("q")), ["ci", "cj"])
        counts = written(counts, "cells")
        tasks = max(1, math.ceil((counts.agg(F.sum(F.col("n").cast("double") * F.col("q"))).first()[0] or 0) / PAIRS))
        # a cell's points and queries go to as many blocks as they fill, and each block of points meets each of queries
        blocks = counts.select("ci", "cj", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("q") / block).cast("int").alias("lots"))
        each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        own_of = lambda many, *of: F.pmod(F.xxhash64(*of), F.col(many)).cast("int")
        spread = there.join(blocks, ["ci", "cj"]).withColumn("block", own_of("blocks", "idx", "x", "y")).withColumn("lot", each("lots")).drop("blocks", "lots")
        copied = near.join(blocks, ["ci", "cj"]).withColumn("lot", own_of("lots", "query", "qx", "qy")).withColumn("block", each("blocks")).drop("blocks", "lots")
        keys = ["ci", "cj", "block", "lot"]
        dx, dy = F.col("x") - F.col("qx"), F.abs(F.col("y") - F.col("qy"))
        dy = F.least(dy, F.lit(size) - dy) if period else dy
        met = spread.repartition(tasks, *keys).join(copied.repartition(tasks, *keys), keys).select("query", "qx", "qy", "idx", "lat", "lon", (dx * dx + dy * dy).alias("dist2"))
        best = _top(met, ["query", "qx", "qy"], k)
        if level == 0:  # all points have been seen
            done = best.drop("qx", "qy")
            return done if out is None else out.unionByName(done)
        best = written(best, "best")
        bound = F.col("off") + (side * SLACK) ** 2
        sure = best.where(F.col("rank") == k).select("query", "qx", "qy", F.col("dist2").alias("far"))
        judged = left.join(sure, ["query", "qx", "qy"], "left").withColumn("done", F.coalesce(F.col("far") < bound, F.lit(False)))
        judged = written(judged.drop("far"), "judged")
        done = best.join(judged.where("done").select("query", "qx", "qy"), ["query", "qx", "qy"], "left_semi").drop("qx", "qy")
        out = done if out is None else out.unionByName(done)
        left = judged.where(~F.col("done")).drop("done")
        if left.isEmpty():
            return out
    raise AssertionError("the coarsest grid has one cell")
