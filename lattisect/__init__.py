"""lattisect: geometric cuts through labelled n-dimensional cubes, planned by Catalyst."""

from .axes import Axis
from .cube import Cube
from .plans.request import Branch, Request
from .shapes import (
    All,
    Box,
    ConvexHull,
    Disk,
    Ellipsoid,
    Path,
    PathSegment,
    Point,
    Polygon,
    Product,
    Segment,
    Select,
    Shape,
    ShapePath,
    Span,
    Union,
)

__all__ = [
    "All", "Axis", "Box", "Branch", "ConvexHull", "Cube", "Disk", "Ellipsoid", "Path", "PathSegment", "Point", "Polygon",
    "Product", "Request", "Segment", "Select", "Shape", "ShapePath", "Span", "Union",
]
