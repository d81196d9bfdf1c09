"""Geographic grids: cells numbered along rows of latitude, generated on demand and never as a table of points.

A grid of rows is a small table (row, latitude, points, first longitude, step, first cell number). A request's
bounds select rows by latitude and a range of places in each row by arithmetic; only those cells are made.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadGrid

Box = tuple[tuple[float, float], tuple[float, float]]
#: Ranges of cell numbers that a scan is asked for at most; degrees within which a place is one of a grid's.
RANGES, NEAR = 64, 1e-9
#: Runs of rows with a pattern in their counts that are told apart by comparisons; more are looked up in bins.
BRANCHES = 32
ROW_SCHEMA = "row int, lat double, points bigint, first_lon double, step double, base bigint"


@functools.lru_cache(maxsize=32)
def gaussian_latitudes(n: int) -> np.ndarray:
    """The 2n Gaussian latitudes from north to south: arcsines of the roots of a Legendre polynomial."""
    size = 2 * n
    x = np.cos(np.pi * (np.arange(1, size + 1) - 0.25) / (size + 0.5))
    for _ in range(8):  # Newton's steps, for all roots at once
        low, high = np.ones_like(x), x
        for k in range(2, size + 1):
            low, high = high, ((2 * k - 1) * x * high - (k - 1) * low) / k
        move = high * (x * x - 1) / (size * (x * high - low))
        x = x - move
        if np.abs(move).max() < 1e-15:
            break
    return np.degrees(np.arcsin(x))


@dataclass(frozen=True)
class RowGrid:
    """Rows of equally spaced points, numbered from 0 row by row."""

    lats: tuple[float, ...]
    points: tuple[int, ...]
    first_lons: tuple[float, ...]
    steps: tuple[float, ...]
    whole_circle: bool = True
    name: str = field(default="rows", compare=False)

    def __post_init__(self) -> None:
        if not len(self.lats) == len(self.points) == len(self.first_lons) == len(self.steps):
            raise BadGrid("rows of different lengths")
        if any(n <= 0 for n in self.points):
            raise BadGrid("a row without points")

    @property
    def bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.points)[:-1]])

    @property
    def size(self) -> int:
        return int(sum(self.points))

    @property
    def hash(self) -> str:
        return hashlib.md5(repr((self.lats, self.points, self.first_lons, self.steps)).encode()).hexdigest()

    def require_hash(self, expected: str | None) -> RowGrid:
        if expected is not None and expected != self.hash:
            raise BadGrid(f"the grid's hash is {self.hash}, not {expected}")
        return self

    def rows(self, spark: SparkSession, lat: tuple[float, float] | None = None) -> DataFrame:
        """The row table: a few thousand rows at most."""
        low, high = (-math.inf, math.inf) if lat is None else lat
        data = [
            (i, float(a), int(n), float(f), float(s), int(b))
            for i, (a, n, f, s, b) in enumerate(zip(self.lats, self.points, self.first_lons, self.steps, self.bases))
            if low - 1e-12 <= a <= high + 1e-12
        ]
        return spark.createDataFrame(data, ROW_SCHEMA)

    def cells(self, spark: SparkSession, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
        """(cell, row, place, lat, lon) of the cells in a box; each cell once, at its own longitude.

        A range of longitudes may lie outside the grid's circle: it is taken around it.
        """
        rows = self.rows(spark, lat)
        if lon is None or (self.whole_circle and lon[1] - lon[0] >= 360):
            places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("points") - 1))
            out = rows.select("*", places.alias("place"))
        else:
            laps = range(math.floor((lon[0] - 360) / 360), math.ceil(lon[1] / 360) + 1) if self.whole_circle else range(1)
            parts = []
            for k in laps:
                first = F.greatest(F.ceil((F.lit(lon[0] - 360.0 * k) - F.col("first_lon")) / F.col("step") - 1e-9), F.lit(0)).cast("bigint")
                last = F.least(F.floor((F.lit(lon[1] - 360.0 * k) - F.col("first_lon")) / F.col("step") + 1e-9), F.col("points") - 1).cast("bigint")
                parts.append(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
            out = rows.select("*", F.explode(F.array_distinct(F.concat(*parts))).alias("place"))
        return out.select(
            (F.col("base") + F.col("place")).alias("cell"), "row", F.col("place"), "lat", (F.col("first_lon") + F.col("place") * F.col("step")).alias("lon")
        )

    def locate(self, points: DataFrame, lat_col: str = "lat", lon_col: str = "lon", tolerance: float = 1e-6) -> DataFrame:
        """``points`` and the number of the cell that each is (``cell``; null if it is none of the grid's).

        Rows are found by a join on latitude rounded to the tolerance, and the place in a row by arithmetic.
        """
        spark = points.sparkSession
        key = lambda c: F.round(c / tolerance).cast("bigint")
        rows = self.rows(spark).select(F.explode(F.array(*[key(F.col("lat")) + d for d in (-1, 0, 1)])).alias("__key"), F.col("lat").alias("__lat"), "points", "first_lon", "step", "base")
        joined = points.withColumn("__key", key(F.col(lat_col))).join(F.broadcast(rows), "__key", "left")  # three entries for each row of the grid
        place = (F.col(lon_col) - F.col("first_lon")) / F.col("step")
        nearest = F.round(place).cast("bigint")
        turned = F.pmod(nearest, F.col("points")) if self.whole_circle else nearest
        ok = (F.abs(place - nearest) * F.col("step") <= tolerance) & (turned >= 0) & (turned < F.col("points")) & (F.abs(F.col("__lat") - F.col(lat_col)) <= tolerance)
        return joined.withColumn("cell", F.when(ok, F.col("base") + turned)).drop("__key", "__lat", "points", "first_lon", "step", "base")

    def number(self, row: int, place: int) -> int:
        return int(self.bases[row]) + place

    # --- from numbers of cells -----------------------------------------------------------------------------

    def row_sql(self, cell: str) -> str:
        """The row of a cell by its number, as SQL: rows whose counts go up or down by one amount are inverted together."""
        counts, bases, branches, at = self.points, self.bases.tolist(), [], 0
        while at < len(counts):
            more = counts[at + 1] - counts[at] if at + 1 < len(counts) else 0
            to = at + 1
            while to < len(counts) and counts[to] - counts[to - 1] == more:
                to += 1
            k = f"(CAST({cell} AS BIGINT) - {bases[at]})"
            if more == 0:
                row = f"{at} + {k} div {counts[at]}"
            else:  # the sum of the counts before a row is a square in its number
                twice = 2 * counts[at] - more
                row = f"{at} + CAST(floor((sqrt({twice}e0 * {twice}e0 + {8 * more}e0 * {k}) - {twice}e0) / {2 * more}e0) AS BIGINT)"
            branches.append((bases[to - 1] + counts[to - 1], row))
            at = to
        if len(branches) == 1:
            return f"({branches[0][1]})"
        if len(branches) > BRANCHES:
            return self._row_in_bins(cell)
        return "(CASE " + " ".join(f"WHEN {cell} < {stop} THEN {row}" for stop, row in branches[:-1]) + f" ELSE {branches[-1][1]} END)"

    def _row_in_bins(self, cell: str) -> str:
        """As ``row_sql`` where rows follow no pattern: a bin of numbers has its first and last row, and those between are counted."""
        bases, width = self.bases, -(-self.size // (2 * len(self.points)))
        cuts = np.arange(0, self.size, width)
        firsts, lasts = (np.searchsorted(bases, c, "right") - 1 for c in (cuts, np.minimum(cuts + width, self.size) - 1))
        listed = lambda values: f"cast(split('{','.join(map(str, values.tolist()))}', ',') as array<int>)"
        at = lambda values: f"try_element_at({listed(values)}, bin)"
        between = f"slice(rows, {at(firsts)} + 2, {at(lasts)} - {at(firsts)})"
        inner = f"{at(firsts)} + size(filter({between}, b -> b <= {cell}))"
        by_bin = f"transform(array(CAST(least(greatest(CAST({cell} AS BIGINT) div {width}, 0), {len(cuts) - 1}) AS INT) + 1), bin -> {inner})[0]"
        return f"transform(array({numbers(bases.tolist())}), rows -> {by_bin})[0]"

    def places(self, cell: str) -> tuple[str, str]:
        """Latitude and longitude of a cell by its number, as SQL; null for a number that is none of the grid's."""
        here = f"CASE WHEN {cell} >= 0 AND {cell} < {self.size} THEN CAST({self.row_sql(cell)} AS INT) + 1 END"
        of = lambda values: f"element_at({numbers(values)}, r)"
        lat = f"element_at({numbers(self.lats)}, {here})"
        lon = f"{of(self.first_lons)} + (CAST({cell} AS BIGINT) - CAST({of(self.bases.tolist())} AS BIGINT)) * {of(self.steps)}"
        return lat, f"transform(array({here}), r -> {lon})[0]"

    def axis_values(self, which: int) -> Sequence[float] | None:
        """All values of the first or the second axis, if they are those of a regular grid's rows."""
        if which == 0:
            return self.lats
        same = len(set(zip(self.points, self.first_lons, self.steps))) == 1
        return [self.first_lons[0] + i * self.steps[0] for i in range(self.points[0])] if same else None

    def cell_ranges(self, boxes: Sequence[Box], most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges (start, stop) of numbers with all cells of some boxes ((lat, lat), (lon, lon)) in them, ``most`` at most.

        A box has a range in each row, and a whole circle's rows are one range; where there are more, those with
        the smallest gaps between them are joined.
        """
        lats, points, firsts, steps = (np.array(x, float) for x in (self.lats, self.points, self.first_lons, self.steps))
        bases, found = self.bases, [np.empty((0, 2), np.int64)]
        for (low, high), (west, east) in boxes:
            rows = np.flatnonzero((lats >= low - NEAR) & (lats <= high + NEAR))
            b, n, f, s = bases[rows], points[rows], firsts[rows], steps[rows]
            if (self.whole_circle and not east - west < 360) or math.isinf(west) and math.isinf(east):
                found.append(np.stack([b, b + n.astype(np.int64)], axis=1))
                continue
            for k in range(math.floor((west - 360) / 360), math.ceil(east / 360) + 1) if self.whole_circle else range(1):
                first = np.maximum(np.ceil((max(west, -1e9) - 360.0 * k - f - NEAR) / s - 1e-9), 0)
                last = np.minimum(np.floor((min(east, 1e9) - 360.0 * k - f + NEAR) / s + 1e-9), n - 1)
                ok = first <= last
                found.append(np.stack([b[ok] + first[ok].astype(np.int64), b[ok] + last[ok].astype(np.int64) + 1], axis=1))
        return coalesced(np.concatenate(found), most)

    def nearest(self, lat: float, lon: float) -> list[tuple[float, float]]:
        """The point next to another in squared degrees, around the circle if the grid has one; of two as near, that with
        the least coordinates."""
        lats, points, firsts, steps = (np.array(x, float) for x in (self.lats, self.points, self.first_lons, self.steps))
        place = np.rint((lon - firsts) / steps)
        place = place % points if self.whole_circle else np.clip(place, 0, points - 1)
        lons = firsts + place * steps
        aside = (lons - lon + 180) % 360 - 180 if self.whole_circle else lons - lon
        far = (lats - lat) ** 2 + aside**2
        best = min(np.flatnonzero(far <= far.min() + 1e-15), key=lambda i: (lats[i], lons[i]))
        return [(float(lats[best]), float(lons[best]))]

    def around(self, lat: float, lon: float) -> list[tuple[float, float]]:
        """The points around another: in its row and those below and above it, the place itself and those beside it."""
        lats, out = np.array(self.lats), []
        rows = [*np.flatnonzero(np.abs(lats - lat) <= NEAR)]
        for side in (lats[lats < lat - NEAR].max(initial=-math.inf), lats[lats > lat + NEAR].min(initial=math.inf)):
            rows += [*np.flatnonzero(lats == side)]
        for r in rows:
            at = (lon - self.first_lons[r]) / self.steps[r]
            sides = {round(at) - 1, round(at), round(at) + 1} if abs(at - round(at)) < 1e-9 else {math.floor(at), math.ceil(at)}
            for place in sides:
                if self.whole_circle:
                    place %= self.points[r]
                if 0 <= place < self.points[r]:
                    out.append((self.lats[r], self.first_lons[r] + place * self.steps[r]))
        return sorted(set(out))


def numbers(values: Sequence[float]) -> str:
    """A literal array of numbers: one text, which is folded into a constant before anything runs."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)"


def coalesced(ranges: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Half-open ranges, overlapping and adjacent ones joined, and then those with the least gaps until there are ``most``."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(ranges[:, 1])
    gaps = ranges[1:, 0] - ends[:-1]
    least = 0 if (gaps > 0).sum() < most else np.sort(gaps)[::-1][most - 1]
    cuts = np.flatnonzero(gaps > least)
    firsts, lasts = ranges[np.append(0, cuts + 1), 0], ends[np.append(cuts, len(ends) - 1)]
    return [(int(a), int(b)) for a, b in zip(firsts, lasts)]


def regular(n: int, ascending: bool = False) -> RowGrid:
    """2n rows of 4n points, 90/n degrees apart; the far pole has no row."""
    step = 90 / n
    lats = tuple(-90 + i * step if ascending else 90 - i * step for i in range(2 * n))
    return RowGrid(lats, (4 * n,) * (2 * n), (0.0,) * (2 * n), (step,) * (2 * n), name="regular")


def local_regular(area: Sequence[float], n: int | Sequence[int], descending: bool = False) -> RowGrid:
    """A box (lat, lat, lon, lon) with n steps (or so many along each axis), both borders included."""
    low, high, west, east = area
    n1, n2 = (n, n) if isinstance(n, int) else n
    lats = [low + i * (high - low) / n1 for i in range(n1 + 1)]
    if descending:
        lats = [high - i * (high - low) / n1 for i in range(n1 + 1)]
    rows = n1 + 1
    return RowGrid(tuple(lats), (n2 + 1,) * rows, (float(west),) * rows, ((east - west) / n2,) * rows, whole_circle=False, name="local_regular")


def octahedral(n: int) -> RowGrid:
    """Gaussian latitudes; the row next to a pole has 20 points, and each further one four more."""
    counts = [4 * (min(i, 2 * n - 1 - i) + 1) + 16 for i in range(2 * n)]
    return _around(gaussian_latitudes(n).tolist(), counts, "octahedral")


def reduced_gaussian(n: int, counts: Sequence[int]) -> RowGrid:
    """Gaussian latitudes with the points of each row as given (all 2n rows, or the northern n)."""
    own = [*counts, *reversed(counts)] if len(counts) == n else list(counts)
    if len(own) != 2 * n:
        raise BadGrid(f"{len(counts)} counts for {2 * n} rows")
    return _around(gaussian_latitudes(n).tolist(), own, "reduced_gaussian")


#: Fixed values of the reduced grids of latitudes and longitudes that are known by their number of rows: how many of these have points, and
#: the first latitude. The rows south of the seas have none.
REDUCED_LL = {1441: (1345, 90.0), 3601: (3361, 89.973092)}


def reduced_ll(counts: Sequence[int] | int, start: float = 90.0) -> RowGrid:
    """Equally spaced latitudes from ``start`` to the other pole with the points of each row as given.

    A number of rows in place of the counts names a known grid: there a row has as many points as keep them as far apart as
    rows are, in pairs, a quarter of a pair being left out.
    """
    if isinstance(counts, int):
        if counts not in REDUCED_LL:
            raise BadGrid(f"the points of each row of a grid of {counts} rows aren't known")
        (rows, start), n = REDUCED_LL[counts], counts
        counts = [max(2, 2 * math.ceil((n - 1) * math.sin(math.radians(i * 180 / (n - 1))) - 0.25)) for i in range(rows)]
    else:
        n = len(counts)
    return _around([round(start - i * 180 / (n - 1), 12) for i in range(len(counts))], list(counts), "reduced_ll")


def _around(lats: Sequence[float], counts: Sequence[int], name: str) -> RowGrid:
    if any(c <= 0 for c in counts):
        raise BadGrid("a row without points")
    return RowGrid(tuple(lats), tuple(counts), (0.0,) * len(lats), tuple(360 / c for c in counts), name=name)


def healpix(n: int) -> RowGrid:
    """4n - 1 rings of equal-area cells in ring order."""
    lats, counts, firsts = [], [], []
    for i in range(4 * n - 1):
        r = min(i + 1, 4 * n - 1 - i)
        lat = 90 - math.degrees(math.acos(1 - r * r / (3 * n * n))) if r < n else 90 - math.degrees(math.acos((4 * n - 2 * r) / (3 * n)))
        count = 4 * min(r, n)
        counts.append(count)
        lats.append(0.0 if r == 2 * n else lat if i < 2 * n else -lat)
        shifted = i < n or i > 3 * n - 1 or (i + n) % 2 == 1
        firsts.append(180 / count if shifted else 0.0)
    return RowGrid(tuple(lats), tuple(counts), tuple(firsts), tuple(360 / c for c in counts), name="healpix")


#: Fixed values of the numbering: for each of the twelve faces, how many quarter turns its lowest corner is from the
#: first meridian, in eighths of the circle.
FACE_PLACES = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _order(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise BadGrid("nested order needs a power of two")
    return n.bit_length() - 1


def _spread(bits: int) -> list[float]:
    """For each number of so many bits, these bits with a zero before each."""
    return [float(sum((x >> i & 1) << 2 * i for i in range(bits))) for x in range(1 << bits)]


def nested_number(lat: Column, lon: Column, n: int) -> Column:
    """The number in nested order of the HEALPix cell that a place is in.

    A place is put on a plane where faces are squares: between the caps by its height, in a cap by its distance from the pole
    within its quarter; the two diagonal coordinates name the face and the column and row on it, whose bits alternate.
    """
    k = _order(n)
    z, quarter = F.sin(F.radians(lat)), F.pmod(lon, F.lit(360.0)) / 90
    whole = lambda c: F.floor(c).cast("bigint")

    def of(p: Column) -> Column:
        up, down = whole(n * (0.5 + p["q"] - 0.75 * p["z"])), whole(n * (0.5 + p["q"] + 0.75 * p["z"]))
        fu, fd = F.floor(up / n), F.floor(down / n)
        face = F.when(fu == fd, F.pmod(fu, F.lit(4)) + 4).when(fu < fd, fu).otherwise(fd + 8)
        belt = F.struct(face.cast("bigint").alias("f"), F.pmod(down, F.lit(n)).alias("x"), (n - 1 - F.pmod(up, F.lit(n))).alias("y"))
        turn = F.least(F.floor(p["q"]), F.lit(3))
        far = n * F.sqrt(3 * (1 - F.abs(p["z"])))
        a, b = F.least(whole((p["q"] - turn) * far), F.lit(n - 1)), F.least(whole((1 - p["q"] + turn) * far), F.lit(n - 1))
        north = F.struct(turn.cast("bigint").alias("f"), (n - 1 - b).alias("x"), (n - 1 - a).alias("y"))
        south = F.struct((turn + 8).cast("bigint").alias("f"), a.alias("x"), b.alias("y"))
        return F.when(F.abs(p["z"]) <= 2 / 3, belt).when(p["z"] > 0, north).otherwise(south)

    table = F.expr(numbers(_spread(8)))
    spread = lambda c: sum((F.shiftleft(table[F.shiftright(c, 8 * i).bitwiseAND(F.lit(255)).cast("int")].cast("bigint"), 16 * i) for i in range(-(-max(k, 1) // 8))), F.lit(0).cast("bigint"))
    once = lambda value, body: F.transform(F.array(value), body)[0]
    return once(F.struct(z.alias("z"), quarter.alias("q")), lambda p: once(of(p), lambda c: c["f"] * (n * n) + spread(c["x"]) + 2 * spread(c["y"])))


def healpix_nested_cells(spark: SparkSession, n: int, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
    """As ``healpix(n).cells`` with ``cell`` in nested order."""
    cells = healpix(n).cells(spark, lat, lon)
    return cells.withColumn("cell", nested_number(F.col("lat"), F.col("lon"), n)).select(*cells.columns)


@dataclass(frozen=True)
class Nested:
    """HEALPix cells numbered in nested order: a cell's number at a coarser order is that of the cell around it."""

    n: int

    def __post_init__(self) -> None:
        _order(self.n)

    @property
    def ring(self) -> RowGrid:
        return healpix(self.n)

    @property
    def size(self) -> int:
        return 12 * self.n * self.n

    @property
    def hash(self) -> str:
        return hashlib.md5(f"nested {self.n}".encode()).hexdigest()

    def require_hash(self, expected: str | None) -> Nested:
        if expected is not None and expected != self.hash:
            raise BadGrid(f"the grid's hash is {self.hash}, not {expected}")
        return self

    def cells(self, spark: SparkSession, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
        return healpix_nested_cells(spark, self.n, lat, lon)

    def _row_in_bins(self, cell: str) -> str:
        """As ``row_sql`` where rows follow no pattern: a bin of numbers has its first and last row, and those between are counted."""
        bases, width = self.bases, -(-self.size // (2 * len(self.points)))
        cuts = np.arange(0, self.size, width)
        firsts, lasts = (np.searchsorted(bases, c, "right") - 1 for c in (cuts, np.minimum(cuts + width, self.size) - 1))
        listed = lambda values: f"cast(split('{','.join(map(str, values.tolist()))}', ',') as array<int>)"
        at = lambda values: f"try_element_at({listed(values)}, bin)"
        between = f"slice(rows, {at(firsts)} + 2, {at(lasts)} - {at(firsts)})"
        inner = f"{at(firsts)} + size(filter({between}, b -> b <= {cell}))"
        by_bin = f"transform(array(CAST(least(greatest(CAST({cell} AS BIGINT) div {width}, 0), {len(cuts) - 1}) AS INT) + 1), bin -> {inner})[0]"
        return f"transform(array({numbers(bases.tolist())}), rows -> {by_bin})[0]"

    def places(self, cell: str) -> tuple[str, str]:
        """Latitude and longitude of a cell by its number, as SQL; null for a number that is none of the grid's."""
        n, ring = self.n, self.ring
        inside = f"CASE WHEN {cell} >= 0 AND {cell} < {self.size} THEN CAST({cell} AS BIGINT) END"
        # two bits of either coordinate in each four of the number
        pick = [float((b & 1) | (b >> 1 & 2) | ((b >> 1 & 1) | (b >> 2 & 2)) << 4) for b in range(16)]
        of = lambda i: f"CAST({numbers(pick)}[CAST(shiftright(c, {4 * i}) & 15 AS INT)] AS BIGINT)"
        steps = range(max(1, -(-_order(n) // 2)))
        x = " + ".join(f"shiftleft({of(i)} & 15, {2 * i})" for i in steps)
        y = " + ".join(f"shiftleft(shiftright({of(i)}, 4), {2 * i})" for i in steps)
        parts = f"transform(array(pmod(c, {n * n})), c -> named_struct('x', {x}, 'y', {y}))[0]"
        face = f"transform(array({inside}), c -> named_struct('f', c div {n * n}, 'p', {parts}))[0]"
        down = f"((s.f div 4) + 2) * {n} - s.p.x - s.p.y - 1"  # rings from the north pole
        along = f"{numbers([float(p) for p in FACE_PLACES])}[CAST(s.f AS INT)]"
        lat = f"element_at({numbers(ring.lats)}, CAST({down} AS INT))"
        wide = f"least({down}, {n}, {4 * n} - ({down}))"
        lon = f"pmod(({along} + (s.p.x - s.p.y) / ({wide} * 1e0)) * 45e0 + 360e0, 360e0)"
        return tuple(f"transform(array({face}), s -> {c})[0]" for c in (lat, lon))  # type: ignore[return-value]

    def axis_values(self, which: int) -> Sequence[float] | None:
        return self.ring.lats if which == 0 else None

    def cell_ranges(self, boxes: Sequence[Box], most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges of numbers with all cells of some boxes in them: cells of a coarser order that reach into one."""
        n = min(self.n, 32)
        f, q = np.divmod(np.arange(12 * n * n), n * n)
        x, y = (sum((q >> 2 * i + side & 1) << i for i in range(_order(n))) for side in (0, 1))
        ring = healpix(n)
        down = (f // 4 + 2) * n - x - y - 1
        wide = np.minimum(np.minimum(down, n), 4 * n - down)
        lat = np.array(ring.lats)[down - 1]
        lon = ((np.array(FACE_PLACES)[f] + (x - y) / wide) * 45 + 360) % 360
        reach = 60.0 / n  # degrees from a cell's middle to its corners: less than this at any order
        over = np.where(np.abs(lat) + reach < 89, reach / np.cos(np.radians(np.minimum(np.abs(lat) + reach, 89))), 360.0)
        hit = np.zeros(len(f), bool)
        for (low, high), (west, east) in boxes:
            inside = (lat >= low - reach - NEAR) & (lat <= high + reach + NEAR)
            if east - west < 360:
                inside &= (np.abs((lon - (west + east) / 2 + 180) % 360 - 180) <= (east - west) / 2 + over + NEAR)
            hit |= inside
        size = (self.n // n) ** 2
        at = np.flatnonzero(hit)
        return coalesced(np.stack([at * size, (at + 1) * size], axis=1), most)

    def nearest(self, lat: float, lon: float) -> list[tuple[float, float]]:
        return self.ring.nearest(lat, lon)

    def around(self, lat: float, lon: float) -> list[tuple[float, float]]:
        return self.ring.around(lat, lon)


@dataclass(frozen=True)
class Lambert:
    """A Lambert conformal conic grid of nx by ny points, ``dx`` and ``dy`` metres apart; angles in degrees.

    On a sphere of ``radius``, or on a spheroid with axes ``major`` and ``minor``.
    """

    nx: int
    ny: int
    dx: float
    dy: float
    first_lat: float
    first_lon: float
    lad: float
    lov: float
    latin1: float
    latin2: float
    radius: float = 6371229.0
    major: float | None = None
    minor: float | None = None

    def _constants(self) -> tuple[float, float, float, float, float]:
        """(radius, eccentricity, cone constant, scale, radius of the parallel of origin)."""
        a = self.major or self.radius
        e = math.sqrt(1 - (self.minor / a) ** 2) if self.minor else 0.0
        p1, p2 = math.radians(self.latin1), math.radians(self.latin2)
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        if abs(p1 - p2) < 1e-9:
            n = math.sin(p1)
        else:
            n = math.log(m(p1) / m(p2)) / math.log(self._t(p1, e) / self._t(p2, e))
        f = m(p1) / (n * self._t(p1, e) ** n)
        return a, e, n, f, a * f * self._t(math.radians(self.lad), e) ** n

    @staticmethod
    def _t(p: float, e: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, i, j, lat, lon), longitudes from 0 to 360: trigonometry over a range of numbers."""
        lat, lon = self.places("id")
        return spark.range(self.size).select(
            F.col("id").alias("cell"), (F.col("id") % self.nx).alias("i"), F.floor(F.col("id") / self.nx).alias("j"), F.expr(lat).alias("lat"), F.expr(lon).alias("lon")
        )

    # --- from numbers of cells -----------------------------------------------------------------------------

    @property
    def size(self) -> int:
        return self.nx * self.ny

    def _plane(self) -> tuple[float, float, float]:
        """(x of the first point, y of it, radius of the parallel of origin)."""
        a, e, n, f, rho0 = self._constants()
        rho = a * f * self._t(math.radians(self.first_lat), e) ** n
        turn = math.radians((self.first_lon - self.lov + 180) % 360 - 180)
        return rho * math.sin(n * turn), rho0 - rho * math.cos(n * turn), rho0

    def _row_in_bins(self, cell: str) -> str:
        """As ``row_sql`` where rows follow no pattern: a bin of numbers has its first and last row, and those between are counted."""
        bases, width = self.bases, -(-self.size // (2 * len(self.points)))
        cuts = np.arange(0, self.size, width)
        firsts, lasts = (np.searchsorted(bases, c, "right") - 1 for c in (cuts, np.minimum(cuts + width, self.size) - 1))
        listed = lambda values: f"cast(split('{','.join(map(str, values.tolist()))}', ',') as array<int>)"
        at = lambda values: f"try_element_at({listed(values)}, bin)"
        between = f"slice(rows, {at(firsts)} + 2, {at(lasts)} - {at(firsts)})"
        inner = f"{at(firsts)} + size(filter({between}, b -> b <= {cell}))"
        by_bin = f"transform(array(CAST(least(greatest(CAST({cell} AS BIGINT) div {width}, 0), {len(cuts) - 1}) AS INT) + 1), bin -> {inner})[0]"
        return f"transform(array({numbers(bases.tolist())}), rows -> {by_bin})[0]"

    def places(self, cell: str) -> tuple[str, str]:
        """Latitude and longitude of a cell by its number, as SQL; null for a number that is none of the grid's."""
        a, e, n, f, _ = self._constants()
        x0, y0, rho0 = self._plane()
        sign = 1.0 if n > 0 else -1.0
        inside = f"CASE WHEN {cell} >= 0 AND {cell} < {self.size} THEN CAST({cell} AS BIGINT) END"
        x = f"({x0!r} + pmod(c, {self.nx}) * {float(self.dx)!r}) * {sign!r}"
        y = f"({rho0 - y0!r} - (c div {self.nx}) * {float(self.dy)!r}) * {sign!r}"
        point = f"transform(array({inside}), c -> named_struct('x', {x}, 'y', {y}))[0]"
        chi = f"(pi() / 2 - 2 * atan(pow(sqrt(p.x * p.x + p.y * p.y) * {sign / (a * f)!r}, {1 / n!r})))"
        series = " + ".join([chi, *(f"{w!r} * sin({chi} * {k})" for k, w in _series(e))])
        lon = f"pmod(degrees(atan2(p.x, p.y) / {n!r}) + {float(self.lov)!r}, 360e0)"
        return tuple(f"transform(array({point}), p -> {c})[0]" for c in (f"degrees({series})", lon))  # type: ignore[return-value]

    def forward(self, lat: float, lon: float) -> tuple[float, float]:
        """Where a place lies on the grid, as (column, row) with fractions."""
        a, e, n, f, rho0 = self._constants()
        x0, y0, _ = self._plane()
        rho = a * f * self._t(math.radians(max(min(lat, 89.999999), -89.999999)), e) ** n
        turn = n * math.radians((lon - self.lov + 180) % 360 - 180)
        return (rho * math.sin(turn) - x0) / self.dx, (rho0 - rho * math.cos(turn) - y0) / self.dy

    def back(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latitudes and longitudes of columns and rows."""
        a, e, n, f, _ = self._constants()
        x0, y0, rho0 = self._plane()
        sign = 1.0 if n > 0 else -1.0
        x, y = (x0 + i * self.dx) * sign, (rho0 - y0 - j * self.dy) * sign
        chi = math.pi / 2 - 2 * np.arctan((np.sqrt(x * x + y * y) * (sign / (a * f))) ** (1 / n))
        lat = chi + sum(w * np.sin(chi * k) for k, w in _series(e))
        return np.degrees(lat), (np.degrees(np.arctan2(x, y) / n) + self.lov) % 360

    def axis_values(self, which: int) -> Sequence[float] | None:
        return None

    def cell_ranges(self, boxes: Sequence[Box], most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges of numbers with all cells of some boxes in them: the rows that a box may reach, by its radii and turns."""
        a, e, n, f, rho0 = self._constants()
        _, y0, _ = self._plane()
        found = [np.empty((0, 2), np.int64)]
        for (low, high), (west, east) in boxes:
            low, high = max(low, -89.999999), min(high, 89.999999)
            if low > high:
                continue
            radii = sorted(a * f * self._t(math.radians(v), e) ** n for v in (low, high))
            half = min((east - west) / 2, 180.0) if math.isfinite(east - west) else 180.0
            middle = ((west + east) / 2 - self.lov + 180) % 360 - 180 if half < 180 else 0.0
            ends = [n * math.radians(min(max(v, -180.0), 180.0)) for v in (middle - half, middle + half)]
            if half >= 180 or middle - half < -180 or middle + half > 180:
                ends = [-abs(n) * math.pi, abs(n) * math.pi]
            ends.sort()
            cosines = [math.cos(v) for v in ends] + ([1.0] if ends[0] <= 0 <= ends[1] else [])
            heights = [r * c for r in radii for c in (min(cosines), max(cosines))]
            first, last = (rho0 - max(heights) - y0) / self.dy, (rho0 - min(heights) - y0) / self.dy
            j0, j1 = max(0, math.ceil(first - 1e-6)), min(self.ny - 1, math.floor(last + 1e-6))
            if j0 <= j1:
                found.append(np.array([[j0 * self.nx, (j1 + 1) * self.nx]], np.int64))
        return coalesced(np.concatenate(found), most)

    def _beside(self, lat: float, lon: float, reach: int) -> list[tuple[float, float, float]]:
        """(squared degrees, latitude, longitude) of the points in so many columns and rows around a place."""
        i, j = self.forward(lat, lon)
        columns = np.unique(np.clip(np.arange(math.floor(i) - reach + 1, math.floor(i) + reach + 1), 0, self.nx - 1))
        rows = np.unique(np.clip(np.arange(math.floor(j) - reach + 1, math.floor(j) + reach + 1), 0, self.ny - 1))
        lats, lons = self.back(*(g.ravel().astype(float) for g in np.meshgrid(columns, rows)))
        return sorted(zip(((lats - lat) ** 2 + ((lons - lon + 180) % 360 - 180) ** 2).tolist(), lats.tolist(), lons.tolist()))

    def nearest(self, lat: float, lon: float) -> list[tuple[float, float]]:
        """The point next to another in squared degrees, of those in the columns and rows around it."""
        return [self._beside(lat, lon, 4)[0][1:]]

    def around(self, lat: float, lon: float) -> list[tuple[float, float]]:
        """The corners of the mesh that a place is in."""
        return [p[1:] for p in self._beside(lat, lon, 1)]


def _series(e: float) -> list[tuple[int, float]]:
    """The series for the latitude of a spheroid: (multiple of the angle, weight)."""
    e2 = e * e
    weights = (
        (2, e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360),
        (4, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520),
        (6, 7 * e2**3 / 120 + 81 * e2**4 / 1120),
        (8, 4279 * e2**4 / 161280),
    )
    return list(weights) if e else []


def unstructured(spark: SparkSession, points: Sequence[tuple[float, float]] | str | DataFrame) -> DataFrame:
    """(cell, lat, lon) of given points: a table (of an external grid, say) that has these columns, the path of one as Parquet, or a list, whose
    places are the numbers. A list goes through the driver, so it is for small grids."""
    if isinstance(points, str):
        points = spark.read.parquet(points)
    if isinstance(points, DataFrame):
        return points.select(F.col("cell").cast("bigint").alias("cell"), "lat", "lon")
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "cell bigint, lat double, lon double")


#: Grids by the names that options use.
GRIDS = {
    "regular": regular, "local_regular": local_regular, "octahedral": octahedral, "reduced_gaussian": reduced_gaussian,
    "reduced_ll": reduced_ll, "healpix": healpix, "healpix_nested": Nested, "lambert_conformal": Lambert, "unstructured": unstructured, "icon": unstructured,
}
