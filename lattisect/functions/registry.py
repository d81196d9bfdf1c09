"""Shapes in SQL text: a request by name, as a view that any query can use."""

from __future__ import annotations

from ..cube import Cube
from ..plans.request import Request
from ..shapes import SHAPES, Shape


def shape(kind: str, *args: object, **more: object) -> Shape:
    """A shape by its name: ``shape("box", ["lat", "lon"], [0, 0], [10, 10])``."""
    if kind not in SHAPES:
        raise ValueError(f"no shape: {kind}")
    return SHAPES[kind](*args, **more)


def register(name: str, make: type[Shape]) -> None:
    """Makes a shape of one's own known by a name; it needs axes, bounds and a predicate."""
    SHAPES[name] = make


def view(cube: Cube, request: Request, name: str) -> None:
    """The cells of a request as a temporary view."""
    cube.retrieve(request).createOrReplaceTempView(name)
