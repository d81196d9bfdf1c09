"""Ranges as requests write them, read by the kind of the axis that they meet: the same text is a number, a time or a code."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping
from typing import Any

from ..axes import SPARK, Axis, number, quoted
from ..errors import BadRequest
from ..shapes import Bounds, Select, Shape, Span

#: Values that a range with an interval may have.
STEPS = 1_000_000
_UNITS = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}


def parts(value: Any) -> list[Any] | tuple[Any, Any, Any]:
    """The values of a list, or (start, end, interval) of a range: ``{start, end, interval}``, ``a/to/b``, ``a/to/b/by/c``, ``a/b/c``, a list or one value."""
    if isinstance(value, Mapping):
        if set(value) - {"start", "end", "interval"} or not {"start", "end"} <= set(value):
            raise BadRequest(f"a range has a start, an end and perhaps an interval, not {sorted(value)}")
        return value["start"], value["end"], value.get("interval")
    if isinstance(value, str):
        own = value.split("/")
        words = [w.lower() for w in own[1::2]]
        if (len(own), words) in ((3, ["to"]), (5, ["to", "by"])):
            return own[0], own[2], own[4] if len(own) == 5 else None
        return own
    return list(value) if isinstance(value, (list, tuple)) else [value]


def is_day(text: Any) -> bool:
    """Whether a text is a day as eight digits."""
    try:
        return isinstance(text, str) and len(text) == 8 and text.isdigit() and dt.datetime.strptime(text, "%Y%m%d").year >= 1000
    except ValueError:
        return False


def _interval(by: Any) -> float:
    try:
        size = float(by)
    except (TypeError, ValueError):
        size = 0.0
    if not (size > 0 and math.isfinite(size)):
        raise BadRequest("an interval is a number above zero")
    return size


def _counted(span: float, by: float) -> range:
    count = int(span / by + 1e-9) + 1 if span >= 0 else 0
    if count > STEPS:
        raise BadRequest(f"a range of {count} values")
    return range(count)


def stepped(kind: str, start: Any, end: Any, by: Any) -> list[Any]:
    """The values from ``start`` to ``end``, both read already, ``by`` apart.

    Times go by days, or by what the interval's letter says (``6h``, ``30m``, ``15s``, ``2d``). Codes that are days as eight digits go through
    the calendar, other codes of digits by their numbers, as wide as they were.
    """
    if kind == "time":
        unit = re.fullmatch(r"([0-9.]+)([dhms])", by) if isinstance(by, str) else None
        step = dt.timedelta(**{_UNITS[unit[2]]: _interval(unit[1])}) if unit else dt.timedelta(days=_interval(by))
        return [start + i * step for i in _counted((end - start) / step, 1)]
    size = _interval(by)
    if kind == "number":
        return [start + i * (int(size) if isinstance(start, int) and size == int(size) else size) for i in _counted(end - start, size)]
    if is_day(start) and is_day(end):
        first, last = (dt.datetime.strptime(t, "%Y%m%d") for t in (start, end))
        return [f"{first + i * dt.timedelta(days=int(size)):%Y%m%d}" for i in _counted((last - first).days, max(1, int(size)))]
    if not (start.isdigit() and end.isdigit()) or size != int(size):
        raise BadRequest(f"{start} and {end} are no days and no codes of digits: there are no steps between them")
    return [str(int(start) + i * int(size)).zfill(len(start) if len(start) == len(end) else 0) for i in _counted(int(end) - int(start), size)]


def read(kind: str, value: Any) -> Any:
    """A value of an axis: a number, a time (eight digits, an ISO date or time, with a zone or in UTC) or a text as it is."""
    if kind == "category":
        return value if isinstance(value, str) else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    if kind == "number":
        try:
            return int(value) if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]+", value.strip()) else float(value) if isinstance(value, str) else value
        except ValueError:
            raise BadRequest(f"{value} is no number") from None
    if isinstance(value, int) and is_day(str(value)):
        value = str(value)
    if not isinstance(value, str):
        return value if isinstance(value, dt.datetime) else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=float(number(value)))  # type: ignore[arg-type]
    try:
        made = dt.datetime.fromisoformat(value.strip())
    except ValueError:
        raise BadRequest(f"{value} is no time") from None
    return made if made.tzinfo is None else made.astimezone(dt.timezone.utc).replace(tzinfo=None)


class Codes(Shape):
    """The texts of an axis between two: codes of digits by their numbers (of one width, if both ends have it), others by their bytes."""

    def __init__(self, axis: str, low: str, high: str) -> None:
        self.axes, self.digits = (axis,), low.isdigit() and high.isdigit()
        self.low, self.high = sorted((low, high), key=int if self.digits else str.encode)  # type: ignore[type-var,arg-type]

    def bounds(self) -> Bounds:
        return {}

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        c = axes[self.axes[0]].column(dialect)
        write = quoted if dialect == SPARK else lambda t: "'" + t.replace("'", "''") + "'"
        between = f"{c} >= {write(self.low)} AND {c} <= {write(self.high)}"
        if not self.digits:
            return f"({between})"
        digits = f"{c} RLIKE '^[0-9]+$'" if dialect == SPARK else f"regexp_full_match({c}, '[0-9]+')"
        if len(self.low) == len(self.high):
            return f"({between} AND length({c}) = {len(self.low)} AND {digits})"
        kind = "DECIMAL(38,0)" if dialect == SPARK else "HUGEINT"
        return f"({digits} AND TRY_CAST({c} AS {kind}) BETWEEN {int(self.low)} AND {int(self.high)})"


class Ranged(Shape):
    """A range of an axis as a request writes it. Nothing of it is read before a cube tells the axis's kind, so texts stay what they
    are: days, codes with leading zeros, numbers.

    On an axis of texts ``a/to/b`` are all texts between two, and values with an interval need not all be stored; those of a list must be.
    """

    def __init__(self, axis: str, value: Any) -> None:
        self.axes, self.value = (axis,), value
        made = parts(value)
        if isinstance(made, tuple) and made[2] is not None and not (isinstance(made[2], str) and re.fullmatch(r"[0-9.]+[dhms]", made[2])):
            _interval(made[2])

    def bounds(self) -> Bounds:
        raise BadRequest(f"the range of {self.axes[0]} isn't bound to an axis yet")

    def sql(self, axes: Mapping[str, Axis], dialect: str = SPARK) -> str:
        return self.bound(axes[self.axes[0]]).sql(axes, dialect)

    def bound(self, axis: Axis) -> Shape:
        name, made = self.axes[0], parts(self.value)
        if isinstance(made, list):
            return Select(name, [read(axis.kind, v) for v in made])
        start, end = (read(axis.kind, v) for v in made[:2])
        if made[2] is not None:
            return Select(name, stepped(axis.kind, start, end, made[2]), checked=False)
        return Codes(name, start, end) if axis.kind == "category" else Span(name, start, end)
