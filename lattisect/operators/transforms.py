"""Axis transformations: pairs of column expressions, from what is stored to what is asked for and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TypeChange:
    """Stored texts as another type; ``back`` writes the value as it was stored."""

    name: str
    to: Callable[[Column], Column]
    back: Callable[[Column], Column]


def _seconds_of_steps(text: Column) -> Column:
    """``70m``, ``1h15m``, ``26h30m15s``, or digits alone for hours; null if it is none of these."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    units = part("h") * 3600 + part("m") * 60 + part("s")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long") * 3600).when(text.rlike("^(?=.)([0-9]+h)?([0-9]+m)?([0-9]+s)?$"), units)


def _steps_of_seconds(s: Column) -> Column:
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    piece = lambda v, unit: F.when(v > 0, F.concat(v.cast("long").cast("string"), F.lit(unit))).otherwise("")
    whole = F.concat(piece(hours, "h"), piece(minutes, "m"), piece(seconds, "s"))
    return F.when(s % 3600 == 0, hours.cast("long").cast("string")).otherwise(whole)


TYPES = {
    "int": TypeChange("int", lambda c: c.try_cast("long"), lambda c: c.cast("string")),
    "float": TypeChange(
        "float", lambda c: c.try_cast("double"), lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    ),
    "date": TypeChange("date", lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("timestamp_ntz"), lambda c: F.date_format(c, "yyyyMMdd")),
    "time": TypeChange(
        "time",
        lambda c: F.when(c.rlike("^[0-9]{1,4}$"), F.substring(F.lpad(c, 4, "0"), 1, 2).try_cast("long") * 3600 + F.substring(F.lpad(c, 4, "0"), 3, 2).try_cast("long") * 60),
        lambda c: F.format_string("%02d%02d", F.floor(c / 3600), F.floor(c % 3600 / 60)),
    ),
    "subhourly_step": TypeChange("subhourly_step", _seconds_of_steps, _steps_of_seconds),
    "subhourly_step_compact": TypeChange(
        "subhourly_step_compact", _seconds_of_steps,
        lambda c: F.when(c % 3600 == 0, F.floor(c / 3600).cast("long").cast("string")).otherwise(F.concat(F.floor(c / 60).cast("long").cast("string"), F.lit("m"))),
    ),
}


def retyped(df: DataFrame, axis: str, type_name: str, strict: bool = True) -> DataFrame:
    """``df`` with a text axis as another type.

    With ``strict`` (one pass over the axis) a value that can't be converted leaves the whole axis as text; without, such
    values become null.
    """
    made = TYPES[type_name].to(F.col(axis))
    if strict and not df.where(F.col(axis).isNotNull() & made.isNull()).isEmpty():
        return df
    return df.withColumn(axis, made)


def stored(df: DataFrame, axis: str, type_name: str) -> DataFrame:
    """``retyped`` undone, row by row."""
    return df.withColumn(axis, TYPES[type_name].back(F.col(axis)))


def merged(df: DataFrame, first: str, second: str, linkers: tuple[str, str] = ("T", "00"), into: str | None = None) -> DataFrame:
    """Two text axes as one of times: first, a linker, second, a linker (``20000101`` ``T`` ``0600`` ``00``)."""
    out = into or first
    text = F.regexp_replace(F.concat(F.col(first), F.lit(linkers[0]), F.col(second), F.lit(linkers[1])), "[-:]", "")
    made = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmm")))
    return df.withColumn("__at", made.cast("timestamp_ntz")).drop(first, second).withColumnRenamed("__at", out)


def unmerged(df: DataFrame, axis: str, first: str, second: str) -> DataFrame:
    """``merged`` undone: a date as ``yyyyMMdd`` and a time as ``HHmm``."""
    made = df.withColumns({"__date": F.date_format(axis, "yyyyMMdd"), "__time": F.date_format(axis, "HHmm")})
    return made.drop(axis).withColumnsRenamed({"__date": first, "__time": second})


def in_axis_order(df: DataFrame, axes: dict) -> DataFrame:
    """Rows in the order of the axes, reversed ones downwards: for presentation only, as it sorts everything."""
    return df.orderBy(*[F.desc(n) if a.reverse else F.asc(n) for n, a in axes.items() if n in df.columns])


def wrapped(value: Column, low: float, high: float, tolerance: float = 1e-12) -> Column:
    """A value in the period from ``low`` to ``high``; both ends stay as they are."""
    size = high - low
    toward = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return (
        F.when(value < low - tolerance, value + (toward((low - value - tolerance) / size) + 1) * size)
        .when(value > high + tolerance, value - (toward((value - high) / size) + 1) * size)
        .otherwise(value)
    )


def seams(lower: float, upper: float, low: float, high: float) -> list[tuple[float, float]]:
    """A range cut where the period ends: [4, 7] on [1, 3] is [4, 5], [5, 7], [7, 7]."""
    size, out, at = high - low, [], lower
    while True:
        steps = int((at - low) // size + 1e-12)
        end = low + (steps + 1) * size
        if end > upper:
            break
        out.append((at, end))
        at = end
    return [*out, (at, upper)]
