"""Features by name, each a request over the axes of a cube, and results as CoverageJSON."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..shapes import All, Box, Disk, Ellipsoid, Path, Point, Polygon, Shape, Union
from .ranges import Ranged, is_day, parts, stepped
from .request import Request

GEO = ("lat", "lon")
#: Kinds of coverages, and the axes that tell one coverage of a kind from another.
PLACES: dict[str, tuple[str, ...]] = {"PointSeries": ("x", "y", "z"), "VerticalProfile": ("x", "y", "t"), "Trajectory": (), "MultiPoint": ()}


def expand_range(value: Any) -> Any:
    """A range as a list or as (start, end), its texts read by how they look: what ``Ranged`` does once it knows its axis, for none."""
    made = parts(value)
    if isinstance(made, list):
        return [_scalar(v) if isinstance(value, str) else v for v in made]
    start, end, by = made
    if isinstance(value, str) and not (by is not None and is_day(start) and is_day(end)):
        start, end = _scalar(start), _scalar(end)
    by = _scalar(by) if isinstance(by, str) else by
    if by is None:
        return (start, end)
    if isinstance(start, str):
        return stepped("category", start, end, by)
    return stepped("number", start, end, by)


def _scalar(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def axis_shape(axis: str, value: Any) -> Shape:
    """A range of an axis in a request's own words."""
    return Ranged(axis, value)


def _need(feature: Mapping[str, Any], required: Sequence[str], allowed: Sequence[str] = ()) -> None:
    missing = [k for k in required if k not in feature]
    extra = [k for k in feature if k not in required and k not in allowed and k != "type"]
    if missing or extra:
        raise BadRequest(f"feature {feature.get('type')}: missing {missing}, unknown {extra}")


def _points(axes: Sequence[str], points: Sequence[Sequence[float]], method: str | None) -> Shape:
    shapes = [Point(axes, [p], method=method) for p in points]
    return shapes[0] if len(shapes) == 1 else Union(axes, *shapes)


def _along(feature: Mapping[str, Any], body: Mapping[str, Any], axis: str) -> Shape:
    """The shape of a feature's own axis, from its range or from the body of the request, never both."""
    if "range" in feature and axis in body:
        raise BadRequest(f"axis {axis} is in the feature's range and in the request's body")
    if "range" in feature:
        return axis_shape(axis, feature["range"])
    return axis_shape(axis, body[axis]) if axis in body else All(axis)


def feature_request(feature: Mapping[str, Any], body: Mapping[str, Any], geo: Sequence[str] = GEO) -> Request:
    """The request of a feature; ``body`` has the values of all other axes.

    Points of a timeseries, a profile or a position are those of the cube that are nearest, unless ``method`` says otherwise.
    """
    kind = feature.get("type")
    method, used = "nearest", set()
    if kind == "timeseries":
        _need(feature, ["points", "time_axis"], ["range", "method"])
        shapes = [_points(geo, feature["points"], feature.get("method", method)), _along(feature, body, feature["time_axis"])]
        used = {feature["time_axis"]}
    elif kind == "verticalprofile":
        _need(feature, ["points"], ["axes", "range", "method"])
        axis = feature.get("axes", "levelist")
        shapes = [_points(geo, feature["points"], feature.get("method", method)), _along(feature, body, axis)]
        used = {axis}
    elif kind == "polygon":
        _need(feature, ["shape"])
        rings = feature["shape"]
        rings = rings if isinstance(rings[0][0], (list, tuple)) else [rings]
        made = [Polygon(geo, r) for r in rings]
        shapes = [made[0] if len(made) == 1 else Union(geo, *made)]
    elif kind == "boundingbox":
        _need(feature, ["points"], ["axes"])
        axes = tuple(feature.get("axes", geo))
        shapes, used = [Box(axes, *feature["points"])], set(axes) - set(geo)
    elif kind == "circle":
        _need(feature, ["center", "radius"])
        centre = feature["center"][0] if isinstance(feature["center"][0], (list, tuple)) else feature["center"]
        shapes = [Disk(geo, centre, [feature["radius"]] * 2)]
    elif kind == "position":
        _need(feature, ["points"], ["method"])
        shapes = [_points(geo, feature["points"], feature.get("method", method))]
    elif kind == "trajectory":
        _need(feature, ["points", "inflation"], ["axes", "inflate"])
        axes = tuple(feature.get("axes", geo))
        size = feature["inflation"]
        radius = list(size) if isinstance(size, (list, tuple)) else [size] * len(axes)
        zero = [0.0] * len(axes)
        if feature.get("inflate", "round") == "box":
            body_shape: Shape = Box(axes, [-r for r in radius], radius)
        elif len(axes) == 2:
            body_shape = Disk(axes, zero, radius)
        elif len(axes) == 3:
            body_shape = Ellipsoid(axes, zero, radius)
        else:
            raise BadRequest("a round trajectory has two or three axes")
        if len(feature["points"]) < 2:
            raise BadRequest("a trajectory has two points or more")
        shapes, used = [Path(axes, body_shape, *feature["points"])], set(axes) - set(geo)
    else:
        raise BadRequest(f"no feature: {kind}")
    rest = [axis_shape(a, v) for a, v in body.items() if a not in used]
    return Request(*shapes, *rest)


def coverage_json(rows: Sequence[Mapping[str, Any]], kind: str, axes: Mapping[str, str], values: Sequence[str]) -> str:
    """Rows of one feature as a CoverageJSON document; ``axes`` maps its axes (t, x, y, z) to columns.

    For the answer to one request, as a service sends it. A timeseries or profile has one coverage for each place.
    """
    if kind not in PLACES:
        raise BadRequest(f"no kind of coverage: {kind}")
    place = PLACES[kind]
    show = lambda v: v.isoformat() + "Z" if isinstance(v, dt.datetime) else v
    groups: dict[tuple, list] = {}
    for r in rows:
        key = tuple(show(r[axes[a]]) for a in place if a in axes) if place else ()
        groups.setdefault(key, []).append(r)
    coverages = []
    for key in sorted(groups, key=repr):
        own = groups[key]
        if place:
            free = "t" if kind == "PointSeries" else "z"
            own = sorted(own, key=lambda r: r[axes[free]])
            domain = {a: {"values": [v]} for a, v in zip([a for a in place if a in axes], key)} | {free: {"values": [show(r[axes[free]]) for r in own]}}
            along = [free]
        else:
            names = [a for a in ("t", "x", "y", "z") if a in axes]
            domain = {"composite": {"dataType": "tuple", "coordinates": names, "values": [[show(r[axes[a]]) for a in names] for r in own]}}
            along = ["composite"]
        ranges = {v: {"type": "NdArray", "dataType": "float", "axisNames": along, "shape": [len(own)], "values": [r[v] for r in own]} for v in values}
        coverages.append({"type": "Coverage", "domain": {"type": "Domain", "axes": domain}, "ranges": ranges})
    parameters = {v: {"type": "Parameter", "observedProperty": {"label": {"en": v}}} for v in values}
    return json.dumps({"type": "CoverageCollection", "domainType": kind, "parameters": parameters, "coverages": coverages})


def _json(value: Column, kind: T.DataType) -> Column:
    """A value as JSON text: times as ``coverage_json`` shows them, what is missing or isn't finite as null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "SSSSSS") == "000000"
        value = F.when(whole, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    text = F.to_json(F.array(value))
    return F.substring(text, 2, F.length(text) - 2)


def coverages(rows: DataFrame, kind: str, axes: Mapping[str, str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """CoverageJSON by the executors: a row for each coverage with ``by`` and ``coverage``, its JSON text.

    As ``coverage_json``: a timeseries or profile has a coverage for each place (and each of ``by``), along its own axis in order; a trajectory or
    points have one for each of ``by``, in the order of their coordinates. The driver sees no row; texts can be written as they are.
    """
    if kind not in PLACES:
        raise BadRequest(f"no kind of coverage: {kind}")
    place = [a for a in PLACES[kind] if a in axes]
    free = {"PointSeries": ["t"], "VerticalProfile": ["z"]}.get(kind) or [a for a in ("t", "x", "y", "z") if a in axes]
    types = {f.name: f.dataType for f in rows.schema.fields}
    shown = lambda name: _json(F.col(f"`{name}`"), types[name])
    entry = F.struct(*[F.col(f"`{axes[a]}`").alias(f"o{i}") for i, a in enumerate(free)], *[shown(axes[a]).alias(f"a{i}") for i, a in enumerate(free)], *[shown(v).alias(f"v{i}") for i, v in enumerate(values)])
    groups = rows.groupBy(*[F.col(f"`{b}`") for b in by], *[F.col(f"`{axes[a]}`").alias(f"__{a}") for a in place]).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    listed = lambda of: F.concat(F.lit("["), F.array_join(F.transform("__all", of), ","), F.lit("]"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = lambda n: json.dumps(n)
    if place:
        own = [text(name(a), ':{"values":[', _json(F.col(f"__{a}"), types[axes[a]]), "]}") for a in place]
        domain, along = F.concat_ws(",", *own, text(name(free[0]), ':{"values":', listed(lambda e: e["a0"]), "}")), free[0]
    else:
        tuples = listed(lambda e: F.concat(F.lit("["), F.concat_ws(",", *[e[f"a{i}"] for i in range(len(free))]), F.lit("]")))
        domain, along = text('"composite":{"dataType":"tuple","coordinates":', json.dumps(free), ',"values":', tuples, "}"), "composite"
    size = F.size("__all").cast("string")
    ranges = [text(name(v), ':{"type":"NdArray","dataType":"float","axisNames":[', name(along), '],"shape":[', size, '],"values":', listed(_nth(i)), "}") for i, v in enumerate(values)]
    coverage = text('{"type":"Coverage","domain":{"type":"Domain","axes":{', domain, '}},"ranges":{', F.concat_ws(",", *ranges), "}}")
    return groups.select(*[F.col(f"`{b}`") for b in by], coverage.alias("coverage"))


def _nth(i: int) -> Callable[[Column], Column]:
    return lambda e: e[f"v{i}"]
