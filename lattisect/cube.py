"""A cube is a DataFrame with a row for each cell, a column for each axis, and value columns.

A request becomes one filter: bounding ranges that reach the scan, and the inequalities of the shapes. Nothing is
shuffled unless the caller asks for distinct coordinates or an order. Axes that a grid makes of numbers of cells are
computed from these, so a region is a few ranges of numbers to the scan and no join.
"""

from __future__ import annotations

import dataclasses
import itertools
import logging
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .axes import SPARK, Axis, double, number, quoted
from .errors import AxisNotFound, BadRequest, MissingValue
from .operators.neighbours import nearest_join
from .plans.ranges import Ranged
from .plans.request import ENGINES, Branch, Request, prune_branches
from .shapes import All, Bounds, Point, Product, Select, Shape, Span, Union, members, merged, opened, shifted
from .sources.grids import RANGES, coalesced

log = logging.getLogger(__name__)

#: A period is repeated at most so often on one side before a request is refused.
LAPS = 10_000
#: Combinations of laps that are written out, each as comparisons of columns; more are counted by arithmetic.
WRITTEN = 8
#: Places that are looked up in a table of points by one scan; more are joined with it.
FEW = 32
#: Blocks of cell numbers that a table of points is asked for.
CELLS = 4096
EVERYWHERE = (-math.inf, math.inf)


@dataclass(frozen=True)
class Mapped:
    """Two axes that come of the numbers of cells in the column ``cell``.

    Either a ``grid`` computes them and knows its neighbours, or ``points`` is a table of them.
    """

    cell: str
    axes: tuple[str, str]
    grid: Any = None
    points: DataFrame | None = None


class Cube:
    """An immutable cube. ``axes`` are names or ``Axis`` objects; ``values`` are the columns that are read.

    ``known`` has all values of some axes; these are then looked up without a look into the store.
    """

    def __init__(
        self,
        df: DataFrame,
        axes: Sequence[str | Axis],
        values: Sequence[str] = (),
        branches: Sequence[Branch] = (),
        fixed: Mapping[str, str | float] | None = None,
        engines: Mapping[str, str] | None = None,
        mapped: Sequence[Mapped] = (),
        known: Mapping[str, Sequence[object]] | None = None,
    ) -> None:
        types = {f.name: f.dataType for f in df.schema.fields}
        own = {}
        for a in axes:
            name = a if isinstance(a, str) else a.name
            if name not in types:
                raise AxisNotFound(name)
            typed = Axis.of(name, types[name])
            if not isinstance(a, str):
                typed = dataclasses.replace(typed, period=a.period, reverse=a.reverse, tolerance=a.tolerance if typed.kind == "number" else typed.tolerance)
            own[name] = typed
        if not own:
            raise BadRequest("a cube needs an axis")
        self.axes: dict[str, Axis] = own
        self.values, self.branches, self.engines, self.mapped = tuple(values), tuple(branches), dict(engines or {}), tuple(mapped)
        self.known = {a: tuple(number(v) for v in vs) for a, vs in (known or {}).items()}
        for e in self.engines.values():
            if e not in ENGINES:
                raise BadRequest(f"no engine: {e}")
        self.df = df if not fixed else df.where(" AND ".join(f"`{k}` = {quoted(v) if isinstance(v, str) else double(v)}" for k, v in fixed.items()))
        self._ends: dict[str, bool] = {}

    @staticmethod
    def from_parquet(spark: SparkSession, path: str, axes: Sequence[str | Axis], values: Sequence[str] = (), **more: object) -> Cube:
        return Cube(spark.read.parquet(path), axes, values, **more)  # type: ignore[arg-type]

    @staticmethod
    def from_table(spark: SparkSession, name: str, axes: Sequence[str | Axis], values: Sequence[str] = (), **more: object) -> Cube:
        return Cube(spark.table(name), axes, values, **more)  # type: ignore[arg-type]

    def _with(self, df: DataFrame, axes: Sequence[Axis]) -> Cube:
        return Cube(df, axes, self.values, self.branches, engines=self.engines, mapped=self.mapped, known=self.known)

    def without_empty_axes(self) -> Cube:
        """Without the categorical axes whose only value is the empty text."""
        texts = [a for a in self.axes.values() if a.kind == "category"]
        if not texts:
            return self
        row = self.df.agg(*[F.max(F.col(a.name)).alias(a.name) for a in texts]).first()
        return self._with(self.df, [a for a in self.axes.values() if a not in texts or row[a.name] != ""])

    def dims(self, axis: str) -> DataFrame:
        """The distinct values of an axis."""
        return self.df.select(axis).distinct()

    def indices(self, axis: str, lower: object, upper: object) -> DataFrame:
        """The distinct values of an axis between two."""
        return self.df.where(Span(axis, lower, upper).sql(self.axes)).select(axis).distinct()

    def has_index(self, axis: str, value: object) -> bool:
        return not self.df.where(Select(axis, [value]).sql(self.axes)).select(axis).isEmpty()

    # --- planning -----------------------------------------------------------------------------------------

    def plan(self, request: Request, check_values: bool = True) -> tuple[Request, dict[str, Axis]]:
        """The request as it is filtered by: its ranges read by the kinds of their axes, pruned to its branch, validated, snapped."""
        request = Request(*[s.bound(self.axes[s.axes[0]]) if isinstance(s, Ranged) and s.axes[0] in self.axes else s for s in request.shapes])
        request, names = prune_branches(request, list(self.axes), self.branches)
        request.validate(names)
        axes = {a: self.axes[a] for a in names}
        for s in request.shapes:
            if check_values and isinstance(s, Select) and s.checked and axes[s.axes[0]].kind == "category":
                self._check_values(s)
        snapped: dict[tuple, list] = {**self._looked_up([w for s in request.shapes for w in self._wanted(s)]), **self._paired([p for s in request.shapes for p in self._planar(s)])}
        return Request(*[self._bordered(self._snapped(s, snapped)) for s in request.shapes]), axes

    def _bordered(self, shape: Shape) -> Shape:
        """Without its border if the engine of its two axes tests points strictly."""
        own = {self.engines.get(a, "hull") for a in shape.axes}
        if len(shape.axes) != 2 or isinstance(shape, (Point, Product)) or any(ENGINES[e]["border"] for e in own):
            return shape
        return opened(shape)

    def _check_values(self, select: Select) -> None:
        axis = select.axes[0]
        if axis in self.known:
            found = set(self.known[axis])
        else:
            found = {r[0] for r in self.df.where(F.col(axis).isin(*select.values)).select(axis).distinct().collect()}  # as many as asked for
        for v in select.values:
            if v not in found:
                raise MissingValue(f"axis {axis} has no value {v}")

    # --- snapping -----------------------------------------------------------------------------------------

    def _plane(self, shape: Shape) -> Mapped | None:
        """Where the points of a shape are looked for as pairs: a grid, a table of points, or the cube under an engine of points."""
        for m in self.mapped:
            if set(m.axes) == set(shape.axes):
                return m
        if len(shape.axes) == 2 and all(self.engines.get(a, "hull") != "hull" for a in shape.axes):
            return Mapped("", tuple(shape.axes), points=self.df)  # type: ignore[arg-type]
        return None

    def _wanted(self, shape: Shape) -> list[tuple[str, str, float]]:
        """(method, axis, value) of what is snapped one axis at a time."""
        if isinstance(shape, (Union, Product)):
            return [w for s in shape.shapes for w in self._wanted(s)]
        if shape.method is None or not isinstance(shape, (Select, Point)) or self._plane(shape):
            return []
        if shape.k != 1:
            raise BadRequest(f"the {shape.k} nearest are looked for as pairs only: of two axes under an engine of points, or of a list of points")
        pairs = [(shape.axes[0], v) for v in shape.values] if isinstance(shape, Select) else list(zip(shape.axes, shape.point))
        return [(shape.method, a, float(v)) for a, v in pairs]  # type: ignore[arg-type]

    def _planar(self, shape: Shape) -> list[tuple[tuple[str, str], tuple[float, float], int]]:
        """(axes, place, k) of what is looked for in tables of points."""
        if isinstance(shape, (Union, Product)):
            return [p for s in shape.shapes for p in self._planar(s)]
        if shape.method is None or not isinstance(shape, Point) or (plane := self._plane(shape)) is None or plane.grid is not None:
            return []
        return [(plane.axes, self._at(plane, shape), shape.k)]

    def _at(self, plane: Mapped, point: Point) -> tuple[float, float]:
        return tuple(self._wrapped(self.axes[a], float(point.point[point.axes.index(a)])) for a in plane.axes)  # type: ignore[arg-type,return-value]

    def _snapped(self, shape: Shape, found: Mapping[tuple, list]) -> Shape:
        """Shapes with ``surrounding`` or ``nearest`` as selections of the values that those are."""
        if isinstance(shape, (Union, Product)):
            parts = [self._snapped(s, found) for s in shape.shapes]
            if isinstance(shape, Product):
                return Product(*parts)
            # the members that were one point each stay so, however many pairs they became
            flat = [m for p, s in zip(parts, shape.shapes) for m in (p.shapes if isinstance(p, Union) and not isinstance(s, Union) else (p,))]
            return Union(shape.axes, *flat)
        if shape.method is None or not isinstance(shape, (Select, Point)):
            return shape
        plane = self._plane(shape)
        if plane and isinstance(shape, Point):
            at = self._at(plane, shape)
            pairs = found[plane.axes, at, shape.k] if plane.grid is None else self._around_point(plane, at, shape.method, shape.k)
            return Union(plane.axes, *[Point(plane.axes, [p]) for p in pairs])
        by_axis: dict[str, list[float]] = {}
        for want in self._wanted(shape):
            by_axis.setdefault(want[1], []).extend(found[want])
        parts = [Select(a, sorted(set(vs))) for a, vs in by_axis.items()]
        return parts[0] if len(parts) == 1 else Product(*parts)

    @staticmethod
    def _around_point(plane: Mapped, at: tuple[float, float], method: str, k: int) -> list[tuple[float, float]]:
        """The pairs of a structured grid that a point is snapped to, by arithmetic; ``k`` counts as one."""
        if method == "surrounding":
            return plane.grid.around(*at)
        if k != 1:
            log.warning("the %d nearest points aren't supported on a structured grid: the nearest is taken", k)
        return plane.grid.nearest(*at)

    def _paired(self, wanted: Iterable[tuple[tuple[str, str], tuple[float, float], int]]) -> dict[tuple, list[tuple[float, float]]]:
        """For each (axes, place, k) the k nearest pairs in a table of points, in squared degrees; of those as near, the ones with the least
        coordinates first.

        All places with the same k are looked up together: a few in one scan, where each task keeps k pairs for each place, and more by
        the join of ``nearest_join``. So the number of jobs doesn't follow that of the places.
        """
        out: dict[tuple, list[tuple[float, float]]] = {w: [] for w in wanted}
        groups: dict[tuple, list[tuple[float, float]]] = {}
        for axes, at, k in out:
            groups.setdefault((axes, k), []).append(at)
        for (axes, k), places in groups.items():
            plane = next((m for m in self.mapped if m.axes == axes), None)
            x, y = (F.expr(self.axes[a].numeric()) for a in axes)
            rows = (plane.points if plane else self.df).select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
            period = self.axes[axes[1]].period
            if len(places) > FEW:
                asked = rows.sparkSession.createDataFrame([(i, *at) for i, at in enumerate(places)], "query int, x double, y double")
                best = nearest_join(rows.distinct(), asked, k, F.struct("x", "y"), "x", "y", period=period).select("query", F.col("idx.x").alias("x"), F.col("idx.y").alias("y"), "dist2")
            else:
                each = F.explode(F.array(*[F.struct(F.lit(i).alias("query"), F.lit(a).alias("a"), F.lit(o).alias("o")) for i, (a, o) in enumerate(places)])).alias("q")
                dx, dy = F.col("x") - F.col("q.a"), F.abs(F.col("y") - F.col("q.o"))
                if period:  # the short way round
                    dy = F.least(dy, F.lit(period[1] - period[0]) - dy)
                met = (rows if k == 1 else rows.distinct()).select("x", "y", each).select(F.col("q.query").alias("query"), "x", "y", (dx * dx + dy * dy).alias("dist2"))
                if k == 1:
                    best = met.groupBy("query").agg(F.min(F.struct("dist2", "x", "y")).alias("m")).select("query", "m.x", "m.y", "m.dist2")
                else:
                    order = Window.partitionBy("query").orderBy("dist2", "x", "y")
                    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            for r in sorted(best.collect(), key=lambda r: (r["query"], r["dist2"], r["x"], r["y"])):  # k for each place that was asked for
                out[axes, places[r["query"]], k].append((r["x"], r["y"]))
        return out

    def _looked_up(self, wanted: Iterable[tuple[str, str, float]]) -> dict[tuple[str, str, float], list[float]]:
        """For each (method, axis, value) the stored values it stands for: one aggregate for all of them.

        ``nearest`` is the value next to it, of two as near the lower; ``surrounding`` are the equal, the last one below
        and the first one above. On a cyclic axis the values before the first and after the last are those of the
        neighbouring laps, wrapped. Axes with known values and axes of grids are looked up in those.
        """
        todo = list(dict.fromkeys(wanted))
        listed = {a: sorted(float(v) for v in self._values_of(a)) for _, a, _ in todo if self._values_of(a) is not None}
        out = {w: self._beside(self.axes[w[1]], listed[w[1]], w[0], w[2]) for w in todo if w[1] in listed}
        rest = [w for w in todo if w not in out]
        if not rest:
            return out
        calls = []
        for method, axis, value in rest:
            a = self.axes[axis]
            x, v, wide = F.expr(a.numeric()), self._wrapped(a, value), a.tolerance
            if method == "nearest":
                near = F.when(x.isNotNull(), F.struct(F.abs(x - v).alias("d"), x.alias("x")))
                calls += [F.min(near)["x"]] + [F.lit(None)] * 4
            else:
                calls += [F.min(x), F.max(x), F.max(F.when(x < v - wide, x)), F.min(F.when(x > v + wide, x)), F.max(F.when(F.abs(x - v) <= wide, x))]
        row = self.df.agg(*[c.alias(f"c{i}") for i, c in enumerate(calls)]).first()
        for i, want in enumerate(rest):
            first, last, below, above, same = row[5 * i : 5 * i + 5]
            if want[0] == "nearest":
                found = [first]
            else:
                below, above = (last if below is None else below, first if above is None else above) if self.axes[want[1]].period else (below, above)
                found = [below, same, above]
            out[want] = sorted({float(z) for z in found if z is not None})
        return out

    def _values_of(self, axis: str) -> Sequence[float] | None:
        if axis in self.known:
            return self.known[axis]  # type: ignore[return-value]
        for m in self.mapped:
            if axis in m.axes and m.grid is not None and m.grid.axis_values(m.axes.index(axis)) is not None:
                return m.grid.axis_values(m.axes.index(axis))
        return None

    def _beside(self, a: Axis, values: Sequence[float], method: str, value: float) -> list[float]:
        v = self._wrapped(a, value)
        if not values:
            return []
        if method == "nearest":
            return [min(values, key=lambda x: (abs(x - v), x))]
        below = [x for x in values if x < v - a.tolerance] or ([values[-1]] if a.period else [])
        above = [x for x in values if x > v + a.tolerance] or ([values[0]] if a.period else [])
        return sorted({*below[-1:], *[x for x in values if abs(x - v) <= a.tolerance], *above[:1]})

    def around(self, axis: str, values: Sequence[float]) -> list[float]:
        """For each value the stored ones that are equal, the last one below and the first one above."""
        return sorted({x for found in self._looked_up(("surrounding", axis, float(v)) for v in values).values() for x in found})

    def nearest(self, axis: str, values: Sequence[float]) -> list[float]:
        """For each value the stored one next to it; of two as near, the lower."""
        return sorted({x for found in self._looked_up(("nearest", axis, float(v)) for v in values).values() for x in found})

    @staticmethod
    def _wrapped(axis: Axis, value: float) -> float:
        return wrap(value, *axis.period) if axis.period else value

    def predicate(self, request: Request, dialect: str = SPARK) -> str:
        """What the request filters by, as SQL, for cubes without a cyclic axis in the request's ranges."""
        planned, axes = self.plan(request)
        return planned.sql(axes, dialect)

    # --- queries ------------------------------------------------------------------------------------------

    def retrieve(self, request: Request, distinct: bool = True, check_values: bool = True) -> DataFrame:
        """The cells of a request: axes and values.

        On cyclic axes a range may lie outside the period or be longer than it. With ``distinct`` a cell comes once,
        however many laps select it; without, once for each lap, with its place in ``<axis>_unwrapped``.
        """
        planned, axes = self.plan(request, check_values)
        cyclic = [a for a in axes.values() if a.period and a.name in planned.bounds()]
        names, rows = [*axes, *self.values], self._narrowed(planned)
        if not cyclic:
            return rows.where(planned.sql(axes)).select(*names)
        for a in cyclic:
            rows = self._lapped(rows, a, planned.bounds()[a.name], distinct)
        unwrapped = {n: dataclasses.replace(a, name=f"{n}_unwrapped") if a in cyclic else a for n, a in axes.items()}
        if not distinct:
            return rows.where(planned.sql(unwrapped)).select(*names, *[f"{a.name}_unwrapped" for a in cyclic])
        # a cell is in the request if any lap's copy is: an OR over the laps, no explode and no exchange
        laps = [self._laps(a, planned.bounds()[a.name]) for a in cyclic]
        if math.prod(map(len, laps)) > WRITTEN:
            planned, tests = self._folded(planned, axes, cyclic)
            for test in tests:
                rows = rows.where(test)
            if cyclic := [a for a in cyclic if a.name in planned.bounds()]:
                laps = [self._laps(a, planned.bounds()[a.name]) for a in cyclic]
                return rows.where(self._any_lap(planned, unwrapped, cyclic, laps)).select(*names)
            return rows.where(planned.sql(axes)).select(*names) if planned.shapes else rows.select(*names)
        text, parts = planned.sql(unwrapped), []
        for each in itertools.product(*laps):
            moved = text
            for a, k in zip(cyclic, each):
                low, high = a.period  # type: ignore[misc]
                place = f"`{a.name}`" if k == 0 else f"round(`{a.name}` + {double(k * (high - low))}, 12)"
                moved = moved.replace(f"`{a.name}_unwrapped`", place)
                moved = f"({self._lap_holds(a, k)} AND {moved})"
            parts.append(moved)
        return rows.where(" OR ".join(parts) or "false").select(*names)

    def _folded(self, planned: Request, axes: Mapping[str, Axis], cyclic: Sequence[Axis]) -> tuple[Request, list[str]]:
        """(what is left of a request, tests of the cells themselves): many values, boxes and hulls over one cyclic axis are brought into its
        period, each by the laps that it lies away, so a cell is compared once and not at every lap. Shapes with members of other kinds are left.
        """
        rest, tests = [], []
        for s in [part for s in planned.shapes for part in (s.shapes if isinstance(s, Product) else (s,))]:
            own = [a for a in cyclic if a.name in s.axes]
            test = self._in_period(s, own[0], axes) if len(own) == 1 and isinstance(s, (Union, Select)) else None
            if test is None:
                rest.append(s)
            else:
                tests.append(test)
        return Request(*rest), tests

    def _in_period(self, shape: Shape, a: Axis, axes: Mapping[str, Axis]) -> str | None:
        low, high = a.period  # type: ignore[misc]
        both = self._both_ends(a)
        by_lap: dict[int, dict[tuple, Shape]] = {}  # laps 0 and 1 treat the ends of a stored period unlike all others
        for m in members(shape):
            bounds = m.bounds().get(a.name, EVERYWHERE)
            if not all(map(math.isfinite, bounds)):
                return None
            laps: Sequence[int] = self._laps(a, bounds)
            if len(laps) > WRITTEN:  # those between the ends have all of the period
                laps = sorted({*laps[:2], *laps[-2:], *(k for k in (0, 1) if k in laps)})
            for k in laps:
                moved = shifted(m, a.name, -k * (high - low))
                if moved is None:
                    return None
                by_lap.setdefault(k if both and k in (0, 1) else 2, {}).setdefault(*moved)
        x = a.numeric()
        inner = {0: [], 1: [f"{x} < {double(high - a.tolerance)}", f"{x} > {double(low + a.tolerance)}"], 2: [f"{x} < {double(high - a.tolerance)}"] if both else []}
        parts = [" AND ".join([*inner[k], Union(shape.axes, *merged(list(own.values()))).sql(axes)]) for k, own in by_lap.items()]
        return " OR ".join(f"({p})" for p in parts) or "false"

    def _any_lap(self, planned: Request, unwrapped: Mapping[str, Axis], cyclic: Sequence[Axis], laps: Sequence[range]) -> str:
        """Whether any of many laps' copies of a cell is in the request, in a text whose size doesn't follow the laps.

        For a span of one axis the laps that bring a cell into it are counted by arithmetic; other shapes are asked at these laps.
        """
        rest, tests = list(planned.shapes), []
        shaped = []
        for i, (a, own) in enumerate(zip(cyclic, laps)):
            low, high = a.period  # type: ignore[misc]
            (first, last), size, x = planned.bounds()[a.name], high - low, a.numeric()
            slack = max(a.tolerance, 1e-12 * max(abs(first), abs(last), size)) / size
            begin = f"CAST(least(greatest(ceil(({double(first)} - {x}) / {double(size)} - {double(slack)}), {own.start}), {own.stop}) AS INT)"
            end = f"CAST(least(greatest(floor(({double(last)} - {x}) / {double(size)} + {double(slack)}), {own.start - 1}), {own.stop - 1}) AS INT)"
            span = next((s for s in rest if isinstance(s, Span) and s.axes == (a.name,)), None)
            if math.isinf(first) or math.isinf(last):
                shaped.append((f"lap{i}", a, "array(0)"))
                continue
            if span is None:
                shaped.append((f"lap{i}", a, f"if({begin} <= {end}, sequence({begin}, {end}), cast(array() as array<int>))"))
                continue
            rest.remove(span)
            tests.append(f"{begin} <= {end}")
            if self._both_ends(a):  # seams come from the lower end, but for the end of the period itself
                tests.append(f"CASE WHEN {x} >= {double(high - a.tolerance)} THEN {begin} <= 0 AND {end} >= 0 WHEN {x} <= {double(low + a.tolerance)} THEN NOT ({begin} = 1 AND {end} = 1) ELSE true END")
        text = Request(*rest).sql(unwrapped)
        for lap, a, among in shaped:
            low, high = a.period  # type: ignore[misc]
            text = text.replace(f"`{a.name}_unwrapped`", f"round(`{a.name}` + {lap} * {double(high - low)}, 12)")
            if self._both_ends(a):
                x = a.numeric()
                text = f"({lap} = 0 OR {x} < {double(high - a.tolerance)} AND ({lap} <> 1 OR {x} > {double(low + a.tolerance)})) AND {text}"
            text = f"exists({among}, {lap} -> {text})"
        return " AND ".join([*tests, f"({text})"])

    def _narrowed(self, planned: Request) -> DataFrame:
        """The rows of the cells that mapped axes may be asked for, as ranges of cell numbers that reach the scan."""
        rows = self.df
        for m in self.mapped:
            if m.grid is None:
                rows = self._among_points(rows, m, planned)
                continue
            asked = [regions(s) for s in planned.shapes if set(s.axes) & set(m.axes)]
            boxes = [tuple(next((b[a] for b in own if a in b), EVERYWHERE) for a in m.axes) for own in itertools.product(*asked)]
            ranges = m.grid.cell_ranges(boxes)
            if ranges is not None:
                test = " OR ".join(f"(`{m.cell}` >= {first} AND `{m.cell}` < {stop})" for first, stop in ranges)
                rows = rows.where(test or "false")
        return rows

    def _among_points(self, rows: DataFrame, m: Mapped, planned: Request) -> DataFrame:
        """``rows`` in ranges of numbers with all cells whose points are in the request: these reach the scan of the facts before they are joined.

        The points are asked first, by the same cut as the cube; ``CELLS`` blocks of their numbers are counted, not
        the numbers themselves. Cells that are numbered along space make few ranges, others wide ones.
        """
        shapes: list[Shape] = []
        for s in planned.shapes:
            if set(s.axes) <= set(m.axes):
                shapes.append(s)
            elif set(s.axes) & set(m.axes):
                shapes += [Span(a, *s.bounds().get(a, EVERYWHERE)) for a in s.axes if a in m.axes]
        if all(isinstance(s, All) for s in shapes):
            return rows
        cells = Cube(m.points, [self.axes[a] for a in m.axes], [m.cell]).retrieve(Request(*shapes)).select(F.col(m.cell).cast("bigint").alias("cell"))
        first, last = cells.agg(F.min("cell"), F.max("cell")).first()
        if first is None:
            return rows.where("false")
        width = (last - first) // CELLS + 1
        blocks = cells.groupBy(F.expr(f"(cell - {first}) div {width}").alias("block")).agg(F.min("cell").alias("first"), (F.max("cell") + 1).alias("stop"))
        found = np.array([(r["first"], r["stop"]) for r in blocks.collect()], np.int64)
        return rows.where(" OR ".join(f"(`{m.cell}` >= {a} AND `{m.cell}` < {b})" for a, b in coalesced(found, RANGES)))

    def _laps(self, a: Axis, bounds: tuple[float, float]) -> range:
        low, high = a.period  # type: ignore[misc]
        if math.isinf(bounds[0]) or math.isinf(bounds[1]):
            return range(1)
        first, last = math.floor((bounds[0] - high) / (high - low)), math.ceil((bounds[1] - low) / (high - low))
        if last - first > LAPS:
            raise BadRequest(f"a range of {last - first} laps on axis {a.name}")
        # a lap counts if it has more of the range than its seam
        inside = [k for k in range(first, last + 1) if bounds[0] <= high + k * (high - low) + a.tolerance and bounds[1] >= low + k * (high - low) - a.tolerance]
        return range(inside[0], inside[-1] + 1) if inside else range(0)

    def _both_ends(self, a: Axis) -> bool:
        """Whether both ends of a period are stored: looked up once for an axis."""
        if a.name not in self._ends:
            low, high = a.period  # type: ignore[misc]
            values = self._values_of(a.name)
            if values is None and any(a.name in m.axes and m.grid is not None for m in self.mapped):
                ends = (low, low)  # a circle of a grid has its first point once
            elif values is not None:
                ends = (min(values, default=None), max(values, default=None))
            else:
                x = F.expr(a.numeric())
                ends = tuple(self.df.agg(F.min(x), F.max(x)).first())
            self._ends[a.name] = ends[0] is not None and ends[0] <= low + a.tolerance and ends[1] >= high - a.tolerance
        return self._ends[a.name]

    def _lap_holds(self, a: Axis, k: int) -> str:
        """Which cells lap ``k`` has: with both ends stored, a seam is one point, and it is taken from the lower end
        except at the end of the period itself."""
        if k == 0 or not self._both_ends(a):
            return "(1 = 1)"
        low, high = a.period  # type: ignore[misc]
        c = a.column()
        upper = f"({c} < {double(high - a.tolerance)})"
        return f"({upper} AND {c} > {double(low + a.tolerance)})" if k == 1 else upper

    def _lapped(self, rows: DataFrame, a: Axis, bounds: tuple[float, float], distinct: bool) -> DataFrame:
        if distinct:
            return rows
        low, high = a.period  # type: ignore[misc]
        laps = self._laps(a, bounds)
        if not laps:
            return rows.where("false").withColumn(f"{a.name}_unwrapped", F.col(a.name).cast("double"))
        rows = rows.withColumn("__lap", F.explode(F.sequence(F.lit(laps[0]), F.lit(laps[-1]))))
        if laps != range(1) and self._both_ends(a):
            x = F.col(a.name)
            rows = rows.where((F.col("__lap") == 0) | ((x < high - a.tolerance) & ((F.col("__lap") != 1) | (x > low + a.tolerance))))
        return rows.withColumn(f"{a.name}_unwrapped", F.round(F.col(a.name) + F.col("__lap") * F.lit(float(high - low)), 12)).drop("__lap")

    def index(self, request: Request) -> DataFrame:
        """The coordinates of a request, without values, each once."""
        planned_axes = self.plan(request)[1]
        return self.retrieve(request).select(*planned_axes).distinct()

    def select(self, **values: object) -> Cube:
        """The sub-cube at some values, without their axes."""
        test = " AND ".join(Select(a, [v]).sql(self.axes) for a, v in values.items())
        return self._with(self.df.where(test), [x for n, x in self.axes.items() if n not in values])


def regions(shape: Shape, most: int = 10_000) -> list[Bounds]:
    """Boxes with the shape in their union: those of a union's members, else the one around it."""
    if isinstance(shape, Union) and len(shape.shapes) <= most:
        return [b for s in shape.shapes for b in regions(s, most)]
    if isinstance(shape, Product):
        return [shape.bounds()]
    if isinstance(shape, Select) and shape.bounds() and len(shape.values) <= 100:
        return [{shape.axes[0]: (float(v), float(v))} for v in shape.values]  # type: ignore[arg-type]
    return [shape.bounds()]


def wrap(value: float, low: float, high: float, tolerance: float = 1e-12) -> float:
    """A value in the period from ``low`` to ``high``; both ends stay as they are."""
    size = high - low
    if value < low - tolerance:
        return value + (math.trunc((low - value - tolerance) / size) + 1) * size
    if value > high + tolerance:
        return value - (math.trunc((value - high) / size) + 1) * size
    return value
