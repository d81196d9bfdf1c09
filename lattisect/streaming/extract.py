"""Requests over streams: an extraction keeps no state, so the filter that serves a table serves a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..axes import Axis
from ..cube import Cube
from ..plans.request import Request


def extracted(stream: DataFrame, axes: Sequence[str | Axis], values: Sequence[str], request: Request) -> DataFrame:
    """The cells of a request as they arrive.

    What needs the values that an axis has (snapping, the check of categories, periods) would need the whole stream and
    is refused by Spark; plain shapes need nothing but the row.
    """
    return Cube(stream, axes, values).retrieve(request, check_values=False)


def windowed(cells: DataFrame, time: str, value: str, size: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of extracted values by windows of time; cells later than ``late`` are dropped."""
    grouped = cells.withWatermark(time, late).groupBy(F.window(time, size), *by)
    return grouped.agg(F.count("*").alias("cells"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "cells", "total")
