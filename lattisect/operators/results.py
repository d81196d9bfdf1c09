"""What can be done with the rows of a request: trees, compressed leaves, index ranges, planned against found cells."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadRequest


def index_ranges(cells: DataFrame, idx: str = "cell", path: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive cell numbers for each path, as half-open ranges (start, stop), with the cells in them.

    Numbers that come twice on a path count once.
    """
    once = cells.select(*path, idx).where(F.col(idx).isNotNull()).distinct()
    if path:
        order = Window.partitionBy(*path).orderBy(idx)
        runs = once.withColumn("__run", F.col(idx) - F.row_number().over(order))
        return runs.groupBy(*path, "__run").agg(F.min(idx).alias("start"), (F.max(idx) + 1).alias("stop"), F.count("*").alias("cells")).drop("__run")
    # without a path one sorted run of all numbers would be one task's work: runs are made in blocks, then joined at the
    # seams of these, then of blocks of a million blocks
    cut = once.withColumn("__block", F.floor(F.col(idx) / BLOCKS[0]))
    order = Window.partitionBy("__block").orderBy(idx)
    parts = cut.withColumn("__run", F.col(idx) - F.row_number().over(order)).groupBy("__block", "__run").agg(
        F.min(idx).alias("start"), (F.max(idx) + 1).alias("stop"), F.count("*").alias("cells")
    )
    runs = parts.select("start", "stop", "cells")
    for block, wider in zip(BLOCKS, [*BLOCKS[1:], None]):
        seam = (F.col("start") % block == 0) | (F.col("stop") % block == 0)
        runs = runs.where(~seam).unionByName(_joined(runs.where(seam), wider))
    return runs


#: Numbers in a block of each level; the last one has a block or a few for any store.
BLOCKS = (1 << 20, 1 << 40)


def _joined(edge: DataFrame, block: int | None) -> DataFrame:
    """Runs that follow each other joined, in each block (all runs, of which there are two for each block before, without one)."""
    edge = edge.withColumn("__block", F.floor(F.col("start") / block) if block else F.lit(0))
    along = Window.partitionBy("__block").orderBy("start")
    fresh = F.when(F.col("start") == F.lag("stop").over(along), 0).otherwise(1)
    joined = edge.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(along))
    return joined.groupBy("__block", "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("cells").alias("cells")).select("start", "stop", "cells")


def in_ranges(facts: DataFrame, ranges: DataFrame, idx: str = "cell", path: Sequence[str] = (), width: int = 4096) -> DataFrame:
    """Rows whose number is in one of the ranges: an equi-join on blocks of numbers, then the exact test."""
    blocks = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)))
    asked = ranges.select(*[F.col(p).alias(f"__{p}") for p in path], "start", "stop", blocks.alias("__block"))
    test = (F.floor(F.col(idx) / width) == F.col("__block")) & (F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("stop"))
    for p in path:
        test = test & (F.col(p) == F.col(f"__{p}"))
    return facts.join(asked, test, "left_semi")


def planned_and_found(planned: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """All planned cells with their values, null where the store has none."""
    return planned.dropDuplicates(list(on)).join(facts, list(on), "left")


def compressed(rows: DataFrame, path: Sequence[str], leaf: Sequence[str]) -> DataFrame:
    """One row for each path: the sorted distinct values of each compressed axis."""
    return rows.groupBy(*path).agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in leaf], F.count("*").alias("cells"))


#: Cells of a block of values, and bits of each coordinate in the key that rows are stored by.
BLOCK, BITS = 4096, 21


def value_blocks(rows: DataFrame, path: Sequence[str], leaf: Sequence[str], values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Compressed leaves with their values: dense arrays in row-major order, null where nothing is stored, cut into blocks.

    A row for each path and block with a stored cell: the sorted values of each ``leaf`` axis, ``shape`` (how many these are), ``start`` (the
    place of the block's first cell) and an array for each of ``values``. A cell that is stored again keeps its first value there, and the
    others are in ``again`` with their places, so no row is lost. Rows with a null on a leaf axis have no place and are left out.
    """
    if taken := {"shape", "start", "again"} & {*path, *leaf, *values}:
        raise BadRequest(f"{sorted(taken)} are names of the result's own columns")
    rows = rows.where(" AND ".join(f"`{a}` IS NOT NULL" for a in leaf)).select(*path, *leaf, *values)
    keys = [F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(path)]
    same = lambda table: [F.col(f"`{p}`").eqNullSafe(table[f"__p{i}"]) for i, p in enumerate(path)]
    placed, axes = rows, None
    for n, a in enumerate(leaf):
        once = rows.select(*keys, F.col(f"`{a}`").alias("__v")).distinct()
        order = Window.partitionBy(*[f"__p{i}" for i in range(len(path))]).orderBy("__v")
        place = once.withColumn("__i", F.row_number().over(order) - 1)
        test = [*same(place), F.col(f"`{a}`") == place["__v"]]
        placed = placed.join(place, test).withColumn(f"__i{n}", F.col("__i").cast("bigint")).drop("__v", "__i", *[f"__p{i}" for i in range(len(path))])
    lists = rows.groupBy(*keys).agg(*[F.sort_array(F.collect_set(F.col(f"`{a}`"))).alias(f"__a{n}") for n, a in enumerate(leaf)])
    axes = lists.withColumn("__shape", F.array(*[F.size(f"__a{n}") for n in range(len(leaf))]))
    joined = placed.join(axes, same(axes)) if path else placed.crossJoin(F.broadcast(axes))  # without a path, one row
    at = F.lit(0).cast("bigint")
    for n in range(len(leaf)):
        at = at * F.col("__shape")[n] + F.col(f"__i{n}")
    lists_of = [f"__a{n}" for n in range(len(leaf))]
    found = joined.select(*path, *lists_of, "__shape", at.alias("__at"), *values).withColumn("__block", F.expr(f"__at div {block}"))
    entry = F.struct("__at", *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    groups = found.groupBy(*path, "__block").agg(*[F.first(c).alias(c) for c in [*lists_of, "__shape"]], F.array_sort(F.collect_list(entry)).alias("__all"))
    all_, start = F.col("__all"), F.col("__block") * block
    first = F.filter(all_, lambda e, i: F.when(i > 0, e["__at"] != F.get(all_, i - 1)["__at"]).otherwise(True))
    again = F.filter(all_, lambda e, i: F.when(i > 0, e["__at"] == F.get(all_, i - 1)["__at"]).otherwise(False))
    size = F.aggregate("__shape", F.lit(1).cast("bigint"), lambda x, n: x * n)
    groups = groups.select(*path, *lists_of, "__shape", start.alias("start"), F.least(size - start, F.lit(block)).cast("int").alias("__size"), first.alias("__first"), again.alias("__again"))
    once_, out = F.col("__first"), []
    for i, v in enumerate(values):
        none = F.lit(None).cast(rows.schema[v].dataType)
        # what stands before each value, and after the last one, is empty
        before = lambda e, n: (e["__at"] - F.when(n > 0, F.get(once_, n - 1)["__at"]).otherwise(F.col("start") - 1) - 1).cast("int")
        parts = F.transform(once_, _part(i, none, before))
        after = (F.col("start") + F.col("__size") - 1 - F.element_at(once_, -1)["__at"]).cast("int")
        out.append(F.concat(F.flatten(parts), F.array_repeat(none, after)).alias(v))
    rest = F.transform("__again", lambda e: F.struct(e["__at"].alias("place"), *[e[f"v{i}"].alias(v) for i, v in enumerate(values)]))
    return groups.select(*path, *[F.col(f"__a{n}").alias(a) for n, a in enumerate(leaf)], F.col("__shape").alias("shape"), "start", *out, rest.alias("again"))


def _part(i: int, none: Column, before: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda e, n: F.concat(F.array_repeat(none, before(e, n)), F.array(e[f"v{i}"]))


def unblocked(blocks: DataFrame, path: Sequence[str], leaf: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows that ``value_blocks`` was given, but for those without any value: they can't be told from empty cells."""
    places = F.transform(F.col(values[0]), lambda _, i: F.col("start") + i)
    cells = F.arrays_zip(places.alias("place"), *[F.col(f"`{v}`") for v in values])
    rows = blocks.select(*path, *leaf, "shape", F.explode(F.concat(F.transform(cells, lambda c: F.struct(c["place"].alias("place"), *[c[v].alias(v) for v in values])), "again")).alias("cell"))
    rest, out = F.col("cell.place"), []
    for n in reversed(range(len(leaf))):
        out.insert(0, F.get(F.col(f"`{leaf[n]}`"), (rest % F.col("shape")[n]).cast("int")).alias(leaf[n]))
        rest = F.floor(rest / F.col("shape")[n])
    return rows.where(" OR ".join(f"cell.`{v}` IS NOT NULL" for v in values)).select(*path, *out, *[F.col(f"cell.`{v}`").alias(v) for v in values])


def wired(rows: DataFrame, axes: Sequence[str], cell: str, values: Sequence[str], root: Sequence[str] = ()) -> DataFrame:
    """Trees for the wire: a row for each combination of the ``root`` axes with ``tree``, nested arrays of (value, below) along the others.

    The last level has, in place of coordinates, ``runs`` of cell numbers (start, size) and an array of each of ``values`` in their order. Cells
    stored twice are runs of their own, so nothing is lost. Rows without a cell are left out.
    """
    inner = [a for a in axes if a not in root]
    entry = F.struct(F.col(f"`{cell}`").cast("bigint").alias("cell"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    out = rows.where(F.col(f"`{cell}`").isNotNull()).groupBy(*root, *inner).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    own = F.col("all")
    starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.when(i > 0, F.get(own, i)["cell"] != F.get(own, i - 1)["cell"] + 1).otherwise(True))
    out = out.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, j: F.struct(F.get(own, s)["cell"].alias("start"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size(own)) - s).alias("size")))
    leaf = F.struct(runs.alias("runs"), *[F.transform(own, _field(f"v{i}")).alias(v) for i, v in enumerate(values)])
    out = out.select(*root, *inner, leaf.alias("tree"))
    for i in range(len(inner) - 1, -1, -1):
        below = F.struct(F.col(f"`{inner[i]}`").alias("value"), F.col("tree").alias("below"))
        by_value = lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).when(a["value"].isNull() & b["value"].isNotNull(), -1).when(b["value"].isNull() & a["value"].isNotNull(), 1).otherwise(0)
        out = out.groupBy(*root, *inner[:i]).agg(F.array_sort(F.collect_list(below), by_value).alias("tree"))
    return out


def _field(name: str) -> Callable[[Column], Column]:
    return lambda e: e[name]


def unwired(trees: DataFrame, axes: Sequence[str], cell: str, values: Sequence[str], root: Sequence[str] = (), grid: object = None, coordinates: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """The rows of ``wired``; with a ``grid``, the coordinates of each cell by its arithmetic."""
    inner = [a for a in axes if a not in root]
    rows = trees.select(*root, "tree")
    for i, a in enumerate(inner):
        rows = rows.select(*root, *inner[:i], F.explode("tree").alias("t")).select(*root, *inner[:i], F.col("t.value").alias(a), F.col("t.below").alias("tree"))
    cells = F.flatten(F.transform(F.col("tree.runs"), lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    each = F.explode(F.arrays_zip(cells.alias("cell"), *[F.col(f"tree.`{v}`").alias(f"v{i}") for i, v in enumerate(values)])).alias("c")
    rows = rows.select(*root, *inner, each).select(*root, *inner, F.col("c.cell").alias(cell), *[F.col(f"c.v{i}").alias(v) for i, v in enumerate(values)])
    if grid is None:
        return rows
    lat, lon = grid.places(f"`{cell}`")  # type: ignore[attr-defined]
    return rows.select(*root, *inner, F.expr(lat).alias(coordinates[0]), F.expr(lon).alias(coordinates[1]), cell, *values)


def store(rows: DataFrame, path: str, by: Sequence[str], files: int | None = None, row_group: int = 8 << 20) -> None:
    """Writes a cube for requests: rows near each other on the axes ``by`` are in the same files and row groups.

    One axis, a cell's number say, is sorted by. More are sorted by a key that interleaves the bits of their places between their least and greatest
    values, so a box on any of them reads a part of the row groups. Ranges are dealt by samples of the key, and equal keys may
    be split, so no value can fill a task.
    """
    if len(by) == 1:
        key = F.col(f"`{by[0]}`")
    else:
        ends = rows.agg(*[f(F.col(f"`{a}`").cast("double")).alias(f"{n}{i}") for i, a in enumerate(by) for n, f in (("low", F.min), ("high", F.max))]).first()
        bits = min(BITS, 62 // len(by))
        key = F.lit(0).cast("bigint")
        for i, a in enumerate(by):
            low, high = ends[f"low{i}"], ends[f"high{i}"]
            share = F.lit(0.0) if low is None or high <= low else (F.col(f"`{a}`").cast("double") - low) / (high - low)
            place = F.floor(F.coalesce(share, F.lit(0.0)) * ((1 << bits) - 1)).cast("bigint")
            for b in range(bits):
                bit = F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)), b * len(by) + i)
                key = key.bitwiseOR(bit)
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.withColumns({"__key": key, "__salt": salt})
    dealt = keyed.repartitionByRange(files, "__key", "__salt") if files else keyed.repartitionByRange("__key", "__salt")
    dealt.sortWithinPartitions("__key").drop("__key", "__salt").write.option("parquet.block.size", row_group).parquet(path)


def decompressed(leaves: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """All combinations of the values that compressed leaves hold: one exact request for each row. Repeated ones come once."""
    for a in leaf:
        leaves = leaves.withColumn(a, F.explode(a))
    return leaves.distinct()


def leaf_count(rows: DataFrame, axes: Sequence[str], squeezed: Sequence[str]) -> int:
    """How many leaves a tree of these rows has when some axes are compressed (the last one always is)."""
    path = [a for a in axes if a not in squeezed and a != axes[-1]]
    if rows.isEmpty():
        return 0
    return rows.select(*path).distinct().count() if path else 1


def merged_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two results, each row once."""
    return first.unionByName(second).distinct()


def without(rows: DataFrame, pruned: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows off the pruned branches."""
    return rows.join(pruned.select(*on).distinct(), list(on), "left_anti")


def nested(rows: DataFrame, axes: Sequence[str], values: Sequence[str] = (), root: Sequence[str] = ()) -> DataFrame:
    """A tree for each combination of the ``root`` axes, as a JSON text: an object of the next axis's values, down to the values.

    Inner levels are built by one aggregation each. Keys are in the order of the axis.
    """
    inner = [a for a in axes if a not in root]
    leaf = F.to_json(F.struct(*[F.col(v) for v in values])) if values else F.lit("null")
    key = lambda a: F.to_json(F.struct(F.col(a).cast("string").alias("k")))
    name = lambda a: F.regexp_extract(key(a), r'^\{"k":(.*)\}$', 1)
    out = rows.select(*axes, leaf.alias("__tree"))
    for i in range(len(inner) - 1, -1, -1):
        a, above = inner[i], [*root, *inner[:i]]
        entry = F.struct(F.col(a).alias("o"), F.concat(name(a), F.lit(":"), F.col("__tree")).alias("t"))
        out = out.groupBy(*above).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
        out = out.select(*above, F.concat(F.lit("{"), F.array_join(F.transform("__all", lambda e: e["t"]), ","), F.lit("}")).alias("__tree"))
    return out.withColumnRenamed("__tree", "tree")


def tree_leaves(trees: DataFrame, axes: Sequence[str], values: Sequence[str] = (), root: Sequence[str] = ()) -> DataFrame:
    """The leaves of trees of ``nested`` as rows, by the executors: a text for each axis that isn't a root's, and for each value."""
    inner, rows = [a for a in axes if a not in root], trees.select(*root, F.col("tree").alias("__tree"))
    for i, a in enumerate(inner):
        level = F.explode(F.from_json("__tree", "map<string,string>")).alias("__key", "__below")
        rows = rows.select(*root, *inner[:i], level).select(*root, *inner[:i], F.col("__key").alias(a), F.col("__below").alias("__tree"))
    read = F.from_json("__tree", "map<string,string>")
    return rows.select(*root, *inner, *[F.get(F.map_values(F.map_filter(read, _is_key(v))), 0).alias(v) for v in values])


def _is_key(name: str) -> Callable[[Column, Column], Column]:
    return lambda k, _: k == name


def encode(rows: DataFrame, path: str) -> None:
    """Writes a result; ``decode`` gives the same rows."""
    rows.write.parquet(path)


def decode(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_tree(tree: Mapping, axes: Sequence[str]) -> list[dict]:
    """The leaves of one nested tree as paths."""
    if not axes:
        return [{"value": tree}]
    return [{axes[0]: k, **rest} for k, sub in tree.items() for rest in flatten_tree(sub, axes[1:])]


def pretty(tree: Mapping | str, indent: int = 0) -> str:
    """An indented text of one nested tree."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    lines = []
    for k, v in tree.items():
        if isinstance(v, Mapping) and v and all(isinstance(x, Mapping) for x in v.values()):
            lines += [" " * indent + str(k), pretty(v, indent + 2)]
        else:
            lines.append(" " * indent + f"{k}: {v}")
    return "\n".join(lines)
