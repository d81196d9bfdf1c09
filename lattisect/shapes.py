"""Shapes of a request. Each is a set of points over its axes and compiles to one SQL predicate.

Coordinates of time axes may be datetimes. All shapes are closed and immutable.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np

from . import geometry
from .axes import SPARK, Axis, double, number, quoted
from .errors import Unsliceable

Bounds = dict[str, tuple[float, float]]
METHODS = (None, "surrounding", "nearest")
#: Alternatives of one axis or box that are written out; more are looked up in a literal table.
FEW = 16


def _table(lists: Sequence[Sequence[Sequence[float]]]) -> str:
    """A literal of lists of rows of numbers, as Spark's SQL has it; it is folded into one constant."""
    rows = [", ".join(f"array({', '.join(double(x) for x in row)})" for row in rows) for rows in lists]
    return "array(" + ", ".join(f"array({r})" if r else "cast(array() as array<array<double>>)" for r in rows) + ")"


def _binned(lows: np.ndarray, highs: np.ndarray, most: int = 512) -> tuple[float, float, list[np.ndarray]]:
    """(first, width, members by bin): bins of one width over some intervals, and which of these reach into each."""
    first, last = float(lows.min()), float(highs.max())
    count = int(min(most, 2 * len(lows)))
    width = max((last - first) / count, 1e-300, abs(last) * 1e-15)
    at = np.clip(np.floor((lows - first) / width - 1e-6), 0, count - 1).astype(int)
    to = np.clip(np.floor((highs - first) / width + 1e-6), 0, count - 1).astype(int)
    return first, width, [np.flatnonzero((at <= i) & (to >= i)) for i in range(count)]


def _in_bin(x: str, first: float, width: float, count: int, table: str, test: str) -> str:
    """Whether any row ``b`` of the bin that ``x`` is in passes a test."""
    at = f"CAST(least(greatest(floor(({x} - {double(first)}) / {double(width)}), 0), {count - 1}) AS INT)"
    return f"exists(try_element_at({table}, {at} + 1), b -> {test})"


def _met(axis: Axis, values: Sequence[float]) -> str:
    """Whether an axis has one of many values, within its tolerance."""
    lows, highs = np.array(values) - axis.tolerance, np.array(values) + axis.tolerance
    first, width, bins = _binned(lows, highs)
    table = _table([[(lows[i], highs[i]) for i in own] for own in bins])
    return _in_bin(axis.numeric(), first, width, len(bins), table, f"{axis.numeric()} >= b[0] AND {axis.numeric()} <= b[1]")


class Shape:
    """Base of all shapes."""

    axes: tuple[str, ...] = ()
    method: str | None = None
    k: int = 1

    def bounds(self) -> Bounds:
        """The least box around the shape; a categorical axis isn't in it."""
        raise NotImplementedError

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        raise NotImplementedError

    def _ordered(self, axes: Mapping[str, Axis]) -> None:
        for a in self.axes:
            if axes[a].kind == "category":
                raise Unsliceable(a)

    def _within(self, axes: Mapping[str, Axis], dialect: str) -> list[str]:
        """The bounding box as comparisons of columns, which a scan can use."""
        return [axes[a].between(*b, dialect=dialect) for a, b in self.bounds().items()]


def _axes(axes: Sequence[str] | str) -> tuple[str, ...]:
    return (axes,) if isinstance(axes, str) else tuple(axes)


def _point(values: Sequence[object]) -> tuple[float, ...]:
    return tuple(float(number(v)) for v in values)  # type: ignore[arg-type]


class ConvexHull(Shape):
    """The convex hull of points; they need not be extreme and may lie in a plane, on a line or be one point."""

    def __init__(self, axes: Sequence[str], points: Sequence[Sequence[object]]) -> None:
        self.axes = _axes(axes)
        self.points = np.array([_point(p) for p in points], float).reshape(-1, len(self.axes))

    def extents(self, axis: str) -> tuple[float, float]:
        own = self.points[:, self.axes.index(axis)]
        return float(own.min()), float(own.max())

    def bounds(self) -> Bounds:
        return {a: self.extents(a) for a in self.axes} if len(self.points) else {}

    def is_box(self) -> bool:
        """Whether the hull is the box around it: that box has all its corners among the points."""
        low, high = self.points.min(axis=0), self.points.max(axis=0)
        if 2 ** int((low < high).sum()) > len(self.points):
            return False
        corners = {tuple(p) for p in geometry.box_corners(low, high)}
        return corners <= {tuple(p) for p in self.points}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        self._ordered(axes)
        if not len(self.points):
            return "(1 = 0)"
        parts = self._within(axes, dialect)
        if not self.is_box():
            h = geometry.half_spaces(self.points)
            scaled = [f"(({axes[a].numeric(dialect)} - {double(c)}) / {double(s)})" for a, c, s in zip(self.axes, h.centre, h.scale)]
            dot = lambda n: " + ".join(f"{double(x)} * {y}" for x, y in zip(n, scaled) if abs(x) > 1e-15)
            for n, b in zip(h.normals, h.offsets):
                if (np.abs(n) > 1e-12).sum() > 1:  # the others are in the box
                    parts.append(f"({dot(n)} <= {double(b + geometry.EPSILON)})")
            for n in h.flat:
                if (np.abs(n) > 1e-12).sum() > 1:
                    parts.append(f"(abs({dot(n)}) <= {double(geometry.EPSILON)})")
        return "(" + " AND ".join(parts) + ")"

    def contains(self, points: np.ndarray) -> np.ndarray:
        return geometry.half_spaces(self.points).contains(points) if len(self.points) else np.zeros(len(points), bool)


class Select(Shape):
    """Some values of one axis, a categorical one too; with ``checked``, texts that aren't stored are an error."""

    def __init__(self, axis: str, values: Sequence[object], method: str | None = None, k: int = 1, checked: bool = True) -> None:
        if method not in METHODS:
            raise ValueError(f"no method: {method}")
        self.axes, self.method, self.k, self.checked = (axis,), method, k, checked
        self.values = tuple(dict.fromkeys(number(v) for v in values))

    def bounds(self) -> Bounds:
        if not self.values or any(isinstance(v, str) for v in self.values):
            return {}
        return {self.axes[0]: (min(self.values), max(self.values))}  # type: ignore[type-var,return-value]

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        axis = axes[self.axes[0]]
        if not self.values:
            return "(1 = 0)"
        if axis.kind == "category":
            write = quoted if dialect == SPARK else lambda t: "'" + t.replace("'", "''") + "'"
            return f"({axis.column(dialect)} IN ({', '.join(write(str(v)) for v in self.values)}))"
        values = sorted(float(v) for v in self.values)
        if axis.tolerance == 0:
            return f"({axis.column(dialect)} IN ({', '.join(axis.literal(v, dialect) for v in values)}))"
        exact = [axis.between(v, v, dialect) for v in values]
        if len(values) <= FEW or dialect != SPARK:
            return "(" + " OR ".join(exact) + ")"
        # the same test, one set look-up and a comparison with the value that it finds: as many values as there are
        return f"({axis.between(values[0], values[-1], dialect)} AND {_met(axis, values)})"


class Point(Shape):
    """One point; the values of its axes are matched one by one."""

    def __init__(self, axes: Sequence[str], points: Sequence[Sequence[object]], method: str | None = None, k: int = 1) -> None:
        if len(points) != 1:
            raise ValueError("a point shape has one point")
        if method not in METHODS or k < 1:
            raise ValueError(f"no method: {method}, or no {k} points")
        self.axes, self.method, self.k = _axes(axes), method, k
        self.point = tuple(number(v) for v in points[0])

    def bounds(self) -> Bounds:
        return {a: (v, v) for a, v in zip(self.axes, self.point) if not isinstance(v, str)}  # type: ignore[misc]

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        return "(" + " AND ".join(Select(a, [v]).sql(axes, dialect) for a, v in zip(self.axes, self.point)) + ")"


class Span(Shape):
    """All values of an axis between two, both included, in whichever order they are given."""

    def __init__(self, axis: str, lower: object = -math.inf, upper: object = math.inf) -> None:
        low, high = _point([lower, upper])
        self.axes, self.low, self.high = (axis,), min(low, high), max(low, high)

    def bounds(self) -> Bounds:
        return {self.axes[0]: (self.low, self.high)}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        self._ordered(axes)
        return self._within(axes, dialect)[0]


class All(Shape):
    """The whole of an axis."""

    def __init__(self, axis: str) -> None:
        self.axes = (axis,)

    def bounds(self) -> Bounds:
        return {}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        return f"({axes[self.axes[0]].column(dialect)} IS NOT NULL)"


class Box(Shape):
    """All points between two corners."""

    def __init__(self, axes: Sequence[str], lower: Sequence[object], upper: Sequence[object]) -> None:
        self.axes = _axes(axes)
        a, b = np.array(_point(lower)), np.array(_point(upper))
        if len(a) != len(self.axes) or len(b) != len(self.axes):
            raise ValueError("a corner has a coordinate for each axis")
        self.low, self.high = np.minimum(a, b), np.maximum(a, b)

    @property
    def points(self) -> np.ndarray:
        return geometry.box_corners(self.low, self.high)

    def bounds(self) -> Bounds:
        return {a: (float(l), float(h)) for a, l, h in zip(self.axes, self.low, self.high)}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        self._ordered(axes)
        return "(" + " AND ".join(self._within(axes, dialect)) + ")"


class Disk(ConvexHull):
    """The 12-sided polygon around an ellipse; with ``exact``, the ellipse itself."""

    def __init__(self, axes: Sequence[str], centre: Sequence[object], radius: Sequence[object], exact: bool = False) -> None:
        self.centre, self.radius, self.exact = _point(centre), _point(radius), exact
        super().__init__(axes, geometry.disk_vertices(self.centre, self.radius).tolist())  # type: ignore[arg-type]

    def bounds(self) -> Bounds:
        if not self.exact:
            return super().bounds()
        return {a: (c - r, c + r) for a, c, r in zip(self.axes, self.centre, self.radius)}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        if not self.exact or not all(self.radius):
            return super().sql(axes, dialect)
        self._ordered(axes)
        terms = [f"(({axes[a].numeric(dialect)} - {double(c)}) / {double(r)})" for a, c, r in zip(self.axes, self.centre, self.radius)]
        inside = " + ".join(f"{t} * {t}" for t in terms)
        return "(" + " AND ".join([*self._within(axes, dialect), f"({inside} <= {double(1 + geometry.EPSILON)})"]) + ")"


class Ellipsoid(ConvexHull):
    """The icosahedron around an ellipsoid."""

    def __init__(self, axes: Sequence[str], centre: Sequence[object], radius: Sequence[object]) -> None:
        super().__init__(axes, geometry.ellipsoid_vertices(_point(centre), _point(radius)).tolist())


class Union(Shape):
    """Points in any of some shapes over the same axes."""

    def __init__(self, axes: Sequence[str], *shapes: Shape) -> None:
        self.axes, self.shapes = _axes(axes), shapes
        for s in shapes:
            if set(s.axes) != set(self.axes):
                raise ValueError("the shapes of a union have the same axes")

    def bounds(self) -> Bounds:
        parts = [s.bounds() for s in self.shapes]
        shared = [a for a in self.axes if parts and all(a in p for p in parts)]
        return {a: (min(p[a][0] for p in parts), max(p[a][1] for p in parts)) for a in shared}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        if not self.shapes:
            return "(1 = 0)"
        convex = [s for s in self.shapes if dialect == SPARK and _is_convex(s)]
        if len(convex) > FEW:
            rest = [s for s in self.shapes if not _is_convex(s)]
            members = " OR ".join([self._any_convex(convex, axes), *dict.fromkeys(s.sql(axes, dialect) for s in rest)])
        else:
            members = " OR ".join(dict.fromkeys(s.sql(axes, dialect) for s in self.shapes))
        return "(" + " AND ".join([*self._within(axes, dialect), f"({members})"]) + ")"

    def _any_convex(self, members: Sequence[Shape], axes: Mapping[str, Axis]) -> str:
        """Many boxes, hulls and sweeps of boxes: only those in the bin of the first two axes that a row is in are compared with it.

        The text has each member's half-spaces once, and their numbers for each bin. Coordinates are taken from the corner of the bins.
        """
        self._ordered(axes)
        wide = np.array([axes[a].tolerance for a in self.axes])
        boxes = [s.bounds() for s in members]
        lows = np.array([[b[a][0] for a in self.axes] for b in boxes]) - wide
        highs = np.array([[b[a][1] for a in self.axes] for b in boxes]) + wide
        origin = lows.min(axis=0)
        spaces = [_inequalities(s, self.axes, low, high, origin) for s, low, high in zip(members, lows, highs)]
        flat, starts = np.concatenate(spaces), np.cumsum([0, *map(len, spaces)])
        used = min(2, len(self.axes))
        count = int(min(512, 2 * len(members))) if used == 1 else int(min(64, 2 * math.isqrt(len(members))))
        sides = np.maximum((highs.max(axis=0) - origin) / count, np.maximum(1e-300, np.abs(origin) * 1e-15))[:used]
        first, last = (np.clip(np.floor((v[:, :used] - origin[:used]) / sides + d), 0, count - 1).astype(int) for v, d in ((lows, -1e-6), (highs, 1e-6)))
        bins: list[list[int]] = [[] for _ in range(count**used)]
        for m, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            for i in range(a[0], b[0] + 1):
                for k in range(a[-1], b[-1] + 1) if used == 2 else (0,):
                    bins[i * (count if used == 2 else 1) + k].append(m)
        x = [f"({axes[a].numeric()} - {double(o)})" for a, o in zip(self.axes, origin)]
        at = [f"CAST(least(greatest(floor({c} / {double(w)}), 0), {count - 1}) AS INT)" for c, w in zip(x, sides)]
        number = f"{at[0]} * {count} + {at[1]}" if used == 2 else at[0]
        d = len(self.axes) + 1
        own, from_to, spans = _listed([m for b in bins for m in b], "int"), _listed(np.cumsum([0, *map(len, bins)]), "int"), _listed(starts, "int")
        between = lambda bounds, i: (f"element_at({bounds}, {i} + 1)", f"element_at({bounds}, {i} + 2)")
        (start, stop), (begin, end) = between(from_to, f"({number})"), between(spans, "m")
        met = f"slice({own}, {start} + 1, {stop} - {start})"
        holds = f"{' + '.join(f'r[h * {d} + {i}] * {c}' for i, c in enumerate(x))} <= r[h * {d} + {d - 1}]"
        test = f"exists({met}, m -> forall(sequence({begin}, {end} - 1), h -> {holds}))"
        return f"exists(array({_listed(flat.ravel(), 'double')}), r -> {test})"  # the numbers stand in the text once


def _listed(values: Sequence[float], kind: str) -> str:
    """A literal array as one text, which is folded into a constant before anything runs."""
    write = (lambda v: repr(float(v))) if kind == "double" else (lambda v: str(int(v)))
    return f"cast(split('{','.join(map(write, values))}', ',') as array<{kind}>)" if len(values) else f"cast(array() as array<{kind}>)"


def _is_convex(shape: Shape) -> bool:
    """Whether a shape is an intersection of half-spaces of bounded size over numbers."""
    if isinstance(shape, Disk) and shape.exact and all(shape.radius):
        return False
    if isinstance(shape, Point):
        return shape.method is None and not any(isinstance(v, str) for v in shape.point)
    if not isinstance(shape, (Box, BoxSweep, ConvexHull)):
        return False
    bounds = shape.bounds()
    return bool(bounds) and all(math.isfinite(v) for b in bounds.values() for v in b)


def _inequalities(shape: Shape, axes: Sequence[str], low: np.ndarray, high: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Rows (n, b) with n @ (x - origin) <= b for all points of a convex shape between two corners, in the order of ``axes``."""
    unit = np.eye(len(axes))
    rows = [np.column_stack([unit, high - origin]), np.column_stack([-unit, origin - low])]
    at = [shape.axes.index(a) for a in axes]
    if isinstance(shape, BoxSweep):  # some moment suits each two axes that move
        way = (shape.end - shape.start)[at]
        near = np.where(way > 0, shape.high[at], shape.low[at]) + shape.start[at]
        far = np.where(way > 0, shape.low[at], shape.high[at]) + shape.start[at]
        moving = np.flatnonzero(way)
        for i in moving:  # (x_i - near_i) / way_i <= (x_j - far_j) / way_j, where the moment is between 0 and 1
            rows.append(np.append(unit[i] / way[i], (near[i] - origin[i]) / way[i] + 1 + geometry.EPSILON)[None])
            rows.append(np.append(-unit[i] / way[i], -(far[i] - origin[i]) / way[i] + geometry.EPSILON)[None])
            for j in moving:
                if i != j:
                    rows.append(np.append(unit[i] / way[i] - unit[j] / way[j], (near[i] - origin[i]) / way[i] - (far[j] - origin[j]) / way[j] + geometry.EPSILON)[None])
    elif isinstance(shape, ConvexHull) and not shape.is_box():
        h = geometry.half_spaces(shape.points[:, at])
        for n, b in [*zip(h.normals, h.offsets), *[(s * n, 0.0) for n in h.flat for s in (1, -1)]]:
            if (np.abs(n) > 1e-12).sum() > 1:  # the others are in the box
                rows.append(np.append(n / h.scale, b + geometry.EPSILON + n @ ((h.centre - origin) / h.scale))[None])
    return np.concatenate(rows)


class Product(Shape):
    """Points whose parts are in each of some shapes over different axes."""

    def __init__(self, *shapes: Shape) -> None:
        self.shapes = shapes
        self.axes = tuple(a for s in shapes for a in s.axes)
        if len(set(self.axes)) < len(self.axes):
            raise ValueError("the shapes of a product have different axes")

    def bounds(self) -> Bounds:
        return {a: b for s in self.shapes for a, b in s.bounds().items()}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        return "(" + " AND ".join(s.sql(axes, dialect) for s in self.shapes) + ")"


class BoxSweep(Shape):
    """What a box passes on its way from one shift to another, without a hull: some moment must suit all axes."""

    def __init__(self, axes: Sequence[str], box: Box, start: Sequence[object], end: Sequence[object]) -> None:
        self.axes = _axes(axes)
        at = [box.axes.index(a) for a in self.axes]
        self.low, self.high = box.low[at], box.high[at]
        self.start, self.end = np.array(_point(start)), np.array(_point(end))

    def bounds(self) -> Bounds:
        low = self.low + np.minimum(self.start, self.end)
        high = self.high + np.maximum(self.start, self.end)
        return {a: (float(l), float(h)) for a, l, h in zip(self.axes, low, high)}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        self._ordered(axes)
        first, last = ["0e0"], ["1e0"]
        for a, lo, hi, s, e in zip(self.axes, self.low, self.high, self.start, self.end):
            way = e - s
            if way == 0:
                continue
            x = axes[a].numeric(dialect)
            near, far = (hi, lo) if way > 0 else (lo, hi)
            first.append(f"(({x} - {double(near + s)}) / {double(way)})")
            last.append(f"(({x} - {double(far + s)}) / {double(way)})")
        parts = self._within(axes, dialect)
        if len(first) > 1:
            parts.append(f"(greatest({', '.join(first)}) <= least({', '.join(last)}) + {double(geometry.EPSILON)})")
        return "(" + " AND ".join(parts) + ")"


def PathSegment(axes: Sequence[str], shape: Shape, start: Sequence[object], end: Sequence[object]) -> Shape:  # noqa: N802
    """What a shape passes when it is moved from ``start`` to ``end``, both added to its own coordinates."""
    if isinstance(shape, Box):
        return BoxSweep(axes, shape, start, end)
    if isinstance(shape, (Union, Polygon)):
        members = shape.shapes if isinstance(shape, Union) else shape.triangles()
        return Union(axes, *[PathSegment(axes, s, start, end) for s in members])
    own = _corners(shape, _axes(axes))
    return ConvexHull(axes, np.concatenate([own + np.array(_point(start)), own + np.array(_point(end))]).tolist())


def Path(axes: Sequence[str], shape: Shape, *points: Sequence[object], closed: bool = False) -> Union:  # noqa: N802
    """What a shape passes along a line of points; ``closed`` returns to the first."""
    stops = [*points, points[0]] if closed else list(points)
    return Union(axes, *[PathSegment(axes, shape, a, b) for a, b in zip(stops, stops[1:])])


def Segment(axes: Sequence[str], first: Shape, second: Shape) -> ConvexHull:  # noqa: N802
    """The hull of two shapes."""
    names = _axes(axes)
    return ConvexHull(names, np.concatenate([_corners(first, names), _corners(second, names)]).tolist())


def ShapePath(axes: Sequence[str], *shapes: Shape) -> Union:  # noqa: N802
    """The hulls of each two shapes that follow each other."""
    return Union(axes, *[Segment(axes, a, b) for a, b in zip(shapes, shapes[1:])])


def _corners(shape: Shape, axes: tuple[str, ...]) -> np.ndarray:
    points = np.array([shape.point]) if isinstance(shape, Point) else shape.points  # type: ignore[attr-defined]
    return points[:, [shape.axes.index(a) for a in axes]]


class Polygon(Shape):
    """A ring of points in a plane: the even-odd inside, concave or crossing itself as it may be, and its border.

    ``border=False`` leaves the border out, as engines do that test points strictly. A ring without an area is
    the hull of its points.
    """

    def __init__(self, axes: Sequence[str], points: Sequence[Sequence[object]], border: bool = True) -> None:
        self.axes, self.border = _axes(axes), border
        ring = [_point(p) for p in points]
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        self.points = np.array(ring, float).reshape(-1, 2)
        self.flat = len(ring) < 3 or np.linalg.matrix_rank(self.points - self.points[0], tol=1e-12) < 2

    def bounds(self) -> Bounds:
        return {a: (float(v.min()), float(v.max())) for a, v in zip(self.axes, self.points.T)} if len(self.points) else {}

    def edges(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(a, b) for a, b in zip(self.points, np.roll(self.points, -1, axis=0)) if (a != b).any()]

    def triangles(self) -> list[ConvexHull]:
        """Triangles with the polygon as their union, for rings that don't cross themselves."""
        if self.flat:
            return [ConvexHull(self.axes, self.points.tolist())]
        ring = [tuple(p) for p in self.points]
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) < 0:
            ring.reverse()
        out = []
        while len(ring) > 3:
            for i in range(len(ring)):
                a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
                if turn(a, b, c) <= 1e-12:
                    if abs(turn(a, b, c)) <= 1e-12:
                        del ring[i]
                        break
                    continue
                if any(p not in (a, b, c) and min(turn(a, b, p), turn(b, c, p), turn(c, a, p)) >= 0 for p in ring):
                    continue
                out.append(ConvexHull(self.axes, [a, b, c]))
                del ring[i]
                break
            else:
                raise ValueError("the polygon crosses itself and can't be swept")
        return [*out, ConvexHull(self.axes, ring)]

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        self._ordered(axes)
        if self.flat:
            return ConvexHull(self.axes, self.points.tolist()).sql(axes, dialect) if self.border else "(1 = 0)"
        x, y = (axes[a].numeric(dialect) for a in self.axes)
        crossed, touched = [], []
        span = np.maximum(self.points.max(axis=0) - self.points.min(axis=0), 1e-300)
        for (x1, y1), (x2, y2) in self.edges():
            if y1 != y2:
                at = f"({double((x2 - x1) / (y2 - y1))} * ({y} - {double(y1)}) + {double(x1)})"
                crossed.append(f"CASE WHEN ({double(y1)} > {y}) <> ({double(y2)} > {y}) AND {x} < {at} THEN 1 ELSE 0 END")
            u, v = (x2 - x1) / span[0], (y2 - y1) / span[1]
            size = math.hypot(u, v)
            across = f"abs((({x} - {double(x1)}) / {double(span[0])}) * {double(v / size)} - (({y} - {double(y1)}) / {double(span[1])}) * {double(u / size)})"
            near = [axes[a].between(p, q, dialect) for a, p, q in zip(self.axes, (x1, y1), (x2, y2))]
            touched.append("(" + " AND ".join([*near, f"{across} <= {double(geometry.EPSILON)}"]) + ")")
        inside, edge = f"({' + '.join(crossed)}) % 2 = 1", " OR ".join(touched)
        test = f"({inside} OR {edge})" if self.border else f"({inside} AND NOT ({edge}))"
        return "(" + " AND ".join([*self._within(axes, dialect), test]) + ")"


def opened(shape: Shape) -> Shape:
    """A shape in a plane without its border; flat ones are empty then."""
    if isinstance(shape, Polygon):
        return Polygon(shape.axes, shape.points.tolist(), border=False)
    if isinstance(shape, Union):
        return Union(shape.axes, *[opened(s) for s in shape.shapes])
    if len(shape.axes) != 2 or not isinstance(shape, (ConvexHull, Box)):
        raise ValueError("only hulls, boxes and polygons in a plane have a border that can be left out")
    if geometry.half_spaces(shape.points).flat.size:
        return Polygon(shape.axes, [], border=False)
    return Polygon(shape.axes, geometry.convex_ring(shape.points).tolist(), border=False)


def members(shape: Shape) -> list[Shape]:
    """The members of a union, also of unions in it; values as one box each."""
    if isinstance(shape, Union):
        return [m for s in shape.shapes for m in members(s)]
    if isinstance(shape, Select) and not any(isinstance(v, str) for v in shape.values):
        return [Box(shape.axes, [v], [v]) for v in shape.values]
    return [shape]


def shifted(shape: Shape, axis: str, by: float) -> tuple[tuple, Shape] | None:
    """(what tells it, the shape moved along an axis), or None for a shape that isn't a point, box, hull or sweep of a box.

    Boxes are as much wider as the place that they come from was rounded, if that is more than the twelfth decimal.
    """
    i = shape.axes.index(axis)
    way = by * np.eye(len(shape.axes))[i]
    if isinstance(shape, Point) and shape.method is None and not any(isinstance(v, str) for v in shape.point):
        shape = Box(shape.axes, shape.point, shape.point)
    if isinstance(shape, Box):
        low, high = shape.low.copy(), shape.high.copy()
        ulp = math.ulp(max(abs(low[i]), abs(high[i])))
        wide = ulp if by and ulp > 4e-13 else 0.0
        if by:
            low[i], high[i] = round(low[i] + by, 12) - wide, round(high[i] + by, 12) + wide
        return ("box", *low, *high), Box(shape.axes, low, high)
    if isinstance(shape, BoxSweep):
        moved = BoxSweep(shape.axes, Box(shape.axes, shape.low, shape.high), shape.start + way, shape.end + way)
        return ("sweep", *shape.low, *shape.high, *np.round([*moved.start, *moved.end], 12)), moved
    if isinstance(shape, Disk) and shape.exact:
        centre = np.array(shape.centre) + way
        return ("disk", *np.round(centre, 12), *shape.radius), Disk(shape.axes, centre, shape.radius, exact=True)
    if isinstance(shape, ConvexHull) and len(shape.points):
        return ("hull", *np.round(shape.points + way, 12).ravel()), ConvexHull(shape.axes, (shape.points + way).tolist())
    return None


def merged(shapes: Sequence[Shape]) -> list[Shape]:
    """The same points, of one axis in as few boxes as there can be if all are boxes."""
    if not all(isinstance(s, Box) and len(s.axes) == 1 for s in shapes):
        return list(shapes)
    out: list[list[float]] = []
    for low, high in sorted((float(s.low[0]), float(s.high[0])) for s in shapes):  # type: ignore[attr-defined]
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [Box(shapes[0].axes, [low], [high]) for low, high in out]


#: Shapes by name, for requests that come as data.
SHAPES: dict[str, Callable[..., Shape]] = {
    "hull": ConvexHull, "select": Select, "point": Point, "span": Span, "all": All, "box": Box, "disk": Disk,
    "ellipsoid": Ellipsoid, "path_segment": PathSegment, "path": Path, "segment": Segment, "shape_path": ShapePath,
    "union": Union, "polygon": Polygon, "product": Product,
}
