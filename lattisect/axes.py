"""Axes of a cube: how the values of a column become numbers, and how they are written in SQL.

One text of a predicate serves Spark and, for comparison, DuckDB; an axis knows the few words that differ.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

TOLERANCE = 1e-12
EPOCH = dt.datetime(1970, 1, 1)
SPARK, DUCKDB = "spark", "duckdb"


def number(value: object) -> object:
    """A coordinate as a float: seconds since the epoch for dates and times, seconds for durations. Strings stay."""
    if isinstance(value, str):
        return value
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    elif type(value).__name__ == "datetime64":
        value = value.astype("datetime64[us]").item()
    elif type(value).__name__ == "timedelta64":
        value = value.astype("timedelta64[us]").item()
    if isinstance(value, dt.datetime):
        value = value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return (value - EPOCH) / dt.timedelta(microseconds=1) / 1e6
    if isinstance(value, dt.date):
        return float((dt.datetime(value.year, value.month, value.day) - EPOCH).total_seconds())
    if isinstance(value, dt.timedelta):
        return value / dt.timedelta(microseconds=1) / 1e6
    return float(value)  # type: ignore[arg-type]


def double(x: float) -> str:
    """A literal that is a double in Spark and in DuckDB alike."""
    if math.isinf(x):
        return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)"
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Axis:
    """A column with an order (``number``, ``time``) or without one (``category``).

    ``period`` makes it cyclic between its two values; ``reverse`` only tells how it is to be shown.
    """

    name: str
    kind: str = "number"
    tolerance: float = TOLERANCE
    period: tuple[float, float] | None = None
    reverse: bool = False
    zoned: bool = field(default=False, compare=False)  # a time with a zone, as Spark's TIMESTAMP

    def __post_init__(self) -> None:
        if self.kind not in ("number", "time", "category"):
            raise ValueError(f"no kind of axis: {self.kind}")
        if self.period is not None and not self.period[0] < self.period[1]:
            raise ValueError("a period needs a lower and a higher bound")

    @staticmethod
    def of(name: str, type_: T.DataType, **more: object) -> Axis:
        """The axis for a column of a type; no other types than these have an order or can be selected from."""
        if isinstance(type_, (T.NumericType, T.DayTimeIntervalType)):
            return Axis(name, "number", **more)  # type: ignore[arg-type]
        if isinstance(type_, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Axis(name, "time", tolerance=0.0, zoned=isinstance(type_, T.TimestampType), **more)  # type: ignore[arg-type]
        if isinstance(type_, T.StringType):
            return Axis(name, "category", **more)  # type: ignore[arg-type]
        raise ValueError(f"a column of type {type_.simpleString()} can't be an axis")

    def column(self, dialect: str = SPARK) -> str:
        return f"`{self.name}`" if dialect == SPARK else '"' + self.name + '"'

    def numeric(self, dialect: str = SPARK) -> str:
        """The column as a double."""
        c = self.column(dialect)
        if self.kind != "time":
            return f"CAST({c} AS DOUBLE)"
        if dialect == DUCKDB:
            return f"(epoch_us(CAST({c} AS TIMESTAMP)) / 1e6)"
        if self.zoned:
            return f"(unix_micros({c}) / 1e6)"
        return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ)) / 1e6)"

    def literal(self, value: float, dialect: str = SPARK) -> str:
        """A coordinate to compare the column itself with, so that comparisons reach the scan."""
        if self.kind != "time":
            return double(value)
        at = EPOCH + dt.timedelta(microseconds=round(value * 1e6))
        word = "TIMESTAMP" if dialect == DUCKDB or self.zoned else "TIMESTAMP_NTZ"
        return f"{word} '{at:%Y-%m-%d %H:%M:%S.%f}'"

    def between(self, low: float, high: float, dialect: str = SPARK, strict: bool = False) -> str:
        """low <= column <= high, widened by the tolerance; an infinite side is left out."""
        c, parts = self.column(dialect), []
        low, high = min(low, high), max(low, high)
        wide = 0.0 if strict else self.tolerance
        if not math.isinf(low):
            parts.append(f"{c} {'>' if strict else '>='} {self.literal(low - wide, dialect)}")
        if not math.isinf(high):
            parts.append(f"{c} {'<' if strict else '<='} {self.literal(high + wide, dialect)}")
        return "(" + " AND ".join(parts or [f"{c} IS NOT NULL"]) + ")"
