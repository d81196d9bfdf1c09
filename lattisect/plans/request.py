"""Requests: shapes whose axes together are the cube's, each axis once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from ..axes import SPARK, Axis
from ..errors import AxisNotFound, AxisOverdefined, AxisUnderdefined
from ..shapes import Bounds, Product, Select, Shape


class Request:
    """Shapes over different axes; a row is selected if it is in all of them."""

    def __init__(self, *shapes: Shape) -> None:
        seen: set[str] = set()
        for s in shapes:
            for a in s.axes:
                if a in seen:
                    raise AxisOverdefined(a)
                seen.add(a)
        self.shapes = shapes

    @property
    def axes(self) -> list[str]:
        return [a for s in self.shapes for a in s.axes]

    def bounds(self) -> Bounds:
        return {a: b for s in self.shapes for a, b in s.bounds().items()}

    def validate(self, axes: Iterable[str]) -> None:
        """Every axis of the cube is in one shape, and no other is."""
        have, want = list(axes), self.axes
        for a in have:
            if a not in want:
                raise AxisUnderdefined(a)
        for a in want:
            if a not in have:
                raise AxisNotFound(a)

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        """One predicate: all groups must hold, and in a group any member. No product of combinations is made."""
        parts = [p for s in self.shapes for p in (s.shapes if isinstance(s, Product) else (s,))]
        return " AND ".join(p.sql(axes, dialect) for p in parts) or "(1 = 1)"


def group(shapes: Sequence[Shape]) -> dict[tuple[str, ...], list[Shape]]:
    """Shapes by the set of their axes: alternatives for the same axes."""
    out: dict[tuple[str, ...], list[Shape]] = {}
    for s in shapes:
        out.setdefault(tuple(sorted(s.axes)), []).append(s)
    return out


def alternatives(shapes: Sequence[Shape], axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
    """A predicate of low-level shapes: any of those with the same axes, and all groups."""
    return " AND ".join("(" + " OR ".join(s.sql(axes, dialect) for s in own) + ")" for own in group(shapes).values())


@dataclass(frozen=True)
class Branch:
    """An axis that is there on some branches only: ``drops`` go where ``axis`` has one of ``values`` (``among``), or none.

    A selection on both sides of the condition can't be answered by one set of axes.
    """

    axis: str
    values: tuple[str, ...]
    drops: tuple[str, ...]
    among: bool = True

    def dropped(self, request: Request) -> tuple[str, ...]:
        for s in request.shapes:
            if isinstance(s, Select) and s.axes == (self.axis,):
                hits = {(v in self.values) == self.among for v in s.values}
                if len(hits) > 1:
                    raise ValueError(f"values of {self.axis} on different branches in one request")
                return self.drops if hits == {True} else ()
        return ()


def prune_branches(request: Request, axes: Sequence[str], rules: Sequence[Branch], always: Sequence[str] = ()) -> tuple[Request, list[str]]:
    """The request and the axes without those that its branch doesn't have. Nothing is changed in place."""
    gone = set(always)
    for rule in rules:
        gone |= set(rule.dropped(request))
    kept = Request(*[s for s in request.shapes if not set(s.axes) <= gone])
    return kept, [a for a in axes if a not in gone]


#: Engines by name, for what a 2-D shape over points means: whether the border belongs to it.
ENGINES: dict[str, dict[str, bool]] = {
    "hull": {"border": True},
    "quadtree": {"border": True},
    "quadtree_bbox": {"border": True},
    "point_in_polygon": {"border": False},
    "point_in_polygon_bbox": {"border": False},
}
