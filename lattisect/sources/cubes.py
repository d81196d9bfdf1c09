"""Where cubes come from: numbers, tables, a directory of partitions, options given as data."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import Axis
from ..cube import Cube, Mapped
from ..errors import BadRequest
from ..operators import transforms
from . import grids

log = logging.getLogger(__name__)


def mock(spark: SparkSession, shape: Mapping[str, int], value: str = "value") -> Cube:
    """Axes of whole numbers from zero; the value is the number of the cell, the last axis running fastest."""
    size = 1
    columns = []
    for axis, n in reversed(list(shape.items())):
        columns.append((F.floor(F.col("id") / size) % n).cast("long").alias(axis))
        size *= n
    rows = spark.range(size).select(*reversed(columns), F.col("id").cast("double").alias(value))
    return Cube(rows, list(shape), [value])


def dense(spark: SparkSession, axes: Mapping[str, Sequence[object]], value: str = "value") -> Cube:
    """All combinations of the given values of axes; the value is the number of the cell. An axis of one value is a scalar's."""
    names = list(axes)
    listed = mock(spark, {a: len(v) for a, v in axes.items()}, value).df
    # the n-th value of an axis is looked up in a literal array: no join
    picked = [F.element_at(F.array(*[F.lit(v) for v in axes[a]]), (F.col(a) + 1).cast("int")).alias(a) for a in names]
    return Cube(listed.select(*picked, value), names, [value])


def discovered_axes(df: DataFrame, axes: Sequence[str], most: int = 100_000) -> dict[str, list[object]]:
    """The values of each axis, for the small categorical axes of a store; none for some axis is an error.

    An axis of more than ``most`` values is refused before they are sent: such an axis is asked by ranges.
    """
    sizes = df.agg(*[F.approx_count_distinct(a).alias(a) for a in axes]).first()
    for a in axes:
        if sizes[a] > most:
            raise BadRequest(f"axis {a} has about {sizes[a]} values, more than {most}")
    row = df.agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in axes]).first()
    out = {a: list(row[a]) for a in axes}
    if not all(out.values()):
        raise BadRequest(f"nothing is stored under {', '.join(a for a, v in out.items() if not v)}")
    return out


def catalogue(rows: DataFrame, axis: str = "axis", value: str = "value", path: Sequence[str] = ()) -> DataFrame:
    """What the table of a catalogue lists: a row for each combination of ``path`` and each axis, with its sorted ``values`` and how many these are.

    Rows without an axis or a value list nothing.
    """
    some = rows.where(F.col(axis).isNotNull() & F.col(value).isNotNull())
    return some.groupBy(*path, F.col(axis).alias("axis")).agg(F.sort_array(F.collect_set(value)).alias("values")).withColumn("size", F.size("values").cast("bigint"))


def catalogue_axes(spark: SparkSession, table: str, axis: str = "axis", value: str = "value", most: int = 100_000) -> dict[str, list[object]]:
    """Axes and their values as a table of the catalogue lists them; more than ``most`` values together are refused before they are sent."""
    rows = spark.table(table).where(F.col(axis).isNotNull() & F.col(value).isNotNull()).select(axis, value).distinct()
    n = rows.count()
    if not n:
        raise BadRequest(f"{table} lists no axes")
    if n > most:
        raise BadRequest(f"{table} lists {n} values, more than {most}")
    return {r["axis"]: list(r["values"]) for r in catalogue(rows, axis, value).collect()}


# --- options --------------------------------------------------------------------------------------------------


def _strict(kind: type, data: Mapping[str, Any]) -> Any:
    known = {f.name for f in fields(kind)}
    for k in data:
        if k not in known:
            raise BadRequest(f"no option {k} for {kind.__name__}")
    return kind(**data)


@dataclass(frozen=True)
class Cyclic:
    range: tuple[float, float]


@dataclass(frozen=True)
class Mapper:
    type: str
    axes: tuple[str, str] = ("lat", "lon")
    resolution: int | tuple[int, int] = 0
    local: tuple[float, float, float, float] | None = None
    counts: tuple[int, ...] = ()
    points: tuple[tuple[float, float], ...] | str | DataFrame = ()
    parameters: Mapping[str, float] = field(default_factory=dict)
    ascending: bool = False
    hash: str | None = None

    def grid(self) -> Any:
        """The grid that the options name."""
        if self.type not in grids.GRIDS:
            raise BadRequest(f"no grid: {self.type}")
        if self.type == "regular":
            made = grids.regular(int(self.resolution), self.ascending)  # type: ignore[call-overload]
        elif self.type == "local_regular":
            made = grids.local_regular(self.local or (), self.resolution)
        elif self.type == "reduced_gaussian":
            made = grids.reduced_gaussian(int(self.resolution), self.counts)  # type: ignore[call-overload]
        elif self.type == "reduced_ll":
            made = grids.reduced_ll(self.counts or int(self.resolution))  # type: ignore[call-overload]
        elif self.type == "lambert_conformal":
            return grids.Lambert(**self.parameters)  # type: ignore[arg-type]
        elif self.type in ("unstructured", "icon"):
            return self.points
        else:
            made = grids.GRIDS[self.type](int(self.resolution))  # type: ignore[operator,call-overload]
        return made.require_hash(self.hash)


@dataclass(frozen=True)
class Merge:
    with_axis: str
    linkers: tuple[str, str] = ("T", "00")


@dataclass(frozen=True)
class TypeChange:
    type: str


@dataclass(frozen=True)
class Reverse:
    is_reverse: bool = True


TRANSFORMATIONS = {"merge": Merge, "reverse": Reverse, "cyclic": Cyclic, "mapper": Mapper, "type_change": TypeChange}


@dataclass(frozen=True)
class AxisOptions:
    axis_name: str
    transformations: tuple[Any, ...] = ()

    @staticmethod
    def parse(data: Mapping[str, Any]) -> AxisOptions:
        made = []
        for t in data.get("transformations", ()):
            name = t.get("name")
            if name not in TRANSFORMATIONS:
                raise BadRequest(f"no transformation: {name}")
            made.append(_strict(TRANSFORMATIONS[name], {k: tuple(v) if isinstance(v, list) else v for k, v in t.items() if k != "name"}))
        kinds = [type(m) for m in made]
        if len(set(kinds)) < len(kinds):
            raise BadRequest(f"a transformation comes twice on {data.get('axis_name')}")
        return _strict(AxisOptions, {**data, "transformations": tuple(made)})

    def find(self, kind: type) -> Any:
        return next((t for t in self.transformations if isinstance(t, kind)), None)


@dataclass(frozen=True)
class KnownAxis:
    """All values of an axis, given in place of those that the store would be asked for."""

    axis_name: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Options:
    axis_config: tuple[AxisOptions, ...] = ()
    compressed_axes_config: tuple[str, ...] = ()
    pre_path: Mapping[str, Any] = field(default_factory=dict)
    engine_options: Mapping[str, str] = field(default_factory=dict)
    dynamic_grid: bool = False
    alternative_axes: tuple[KnownAxis, ...] = ()

    @staticmethod
    def parse(data: Mapping[str, Any]) -> Options:
        made = dict(data)
        made["axis_config"] = tuple(AxisOptions.parse(a) for a in data.get("axis_config", ()))
        made["alternative_axes"] = tuple(_strict(KnownAxis, {k: tuple(v) if isinstance(v, list) else v for k, v in a.items()}) for a in data.get("alternative_axes", ()))
        made["compressed_axes_config"] = tuple(data.get("compressed_axes_config", ()))
        return _strict(Options, made)

    def with_grid(self, discover: Callable[[], Mapping[str, Any]]) -> Options:
        """With the first mapper replaced by a discovered one; what can't be discovered leaves the options as they are."""
        if not self.dynamic_grid:
            return self
        try:
            found = _strict(Mapper, dict(discover()))
        except Exception as problem:  # noqa: BLE001  whatever is wrong with the source of grids
            log.warning("grid not discovered, the configured one stays: %s", problem)
            return self
        axes, done = [], False
        for a in self.axis_config:
            swap = not done and a.find(Mapper) is not None
            done = done or swap
            axes.append(AxisOptions(a.axis_name, tuple(found if swap and isinstance(t, Mapper) else t for t in a.transformations)))
        return Options(tuple(axes), self.compressed_axes_config, self.pre_path, self.engine_options, self.dynamic_grid, self.alternative_axes)


def configured(df: DataFrame, axes: Sequence[str], values: Sequence[str], options: Options) -> Cube:
    """A cube of stored columns under options. Transformations apply in one order: merge, type change, mapper, reverse, cyclic."""
    names = list(axes)
    more: dict[str, dict[str, Any]] = {}
    mapped: list[Mapped] = []
    known = {o.axis_name for o in options.axis_config}
    for k, v in options.pre_path.items():
        df = df.where(F.col(k).isin(list(v) if isinstance(v, (list, tuple)) else [v]))
    made_axes = {a for o in options.axis_config if (g := o.find(Mapper)) is not None for a in g.axes}
    for name in known:
        if name not in names and name not in made_axes:
            raise BadRequest(f"options for axis {name}, which the cube doesn't have")
    for o in options.axis_config:
        if (m := o.find(Merge)) is not None:
            df = transforms.merged(df, o.axis_name, m.with_axis, m.linkers)
            names.remove(m.with_axis)
    for o in options.axis_config:
        if (t := o.find(TypeChange)) is not None:
            df = transforms.retyped(df, o.axis_name, t.type)
    for o in options.axis_config:
        if (g := o.find(Mapper)) is not None:
            made, (first, second) = g.grid(), g.axes
            if isinstance(made, (grids.RowGrid, grids.Nested, grids.Lambert)):
                lat, lon = made.places(f"`{o.axis_name}`")
                df = df.select("*", F.expr(lat).alias(first), F.expr(lon).alias(second)).where(F.col(first).isNotNull())
                mapped.append(Mapped(o.axis_name, (first, second), made))
            else:  # a request's points are looked for first, and ranges of their cells reach the scan of the facts
                cells = grids.unstructured(df.sparkSession, made).select(F.col("cell").alias(o.axis_name), F.col("lat").alias(first), F.col("lon").alias(second))
                df = df.join(cells, o.axis_name)
                mapped.append(Mapped(o.axis_name, (first, second), points=cells))
            at = names.index(o.axis_name)
            names[at : at + 1] = [first, second]
    for o in options.axis_config:
        if (r := o.find(Reverse)) is not None and r.is_reverse:
            more.setdefault(o.axis_name, {})["reverse"] = True
        if (c := o.find(Cyclic)) is not None:
            more.setdefault(o.axis_name, {})["period"] = tuple(float(x) for x in c.range)
    types = {f.name: f.dataType for f in df.schema.fields}
    listed = {a.axis_name: a.values for a in options.alternative_axes}
    for a in listed:
        if a not in names:
            raise BadRequest(f"values for axis {a}, which the cube doesn't have")
    return Cube(df, [Axis.of(n, types[n], **more.get(n, {})) for n in names], values, engines=options.engine_options, mapped=mapped, known=listed)
