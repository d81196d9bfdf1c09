"""Near-duplicates by SimHash: fingerprints, links between them, and connected components.

A fingerprint is mapped to the bit counts of its 2-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join in that space, on a
grid, loses no link; candidates are then verified exactly.

The grid: two vectors at a distance of at most 4 are, in one of their two halves, at most 2 apart, and
two points of a lattice at most 2 apart have a point between them at most 1 from each. So a fingerprint
is put, for either half, in the cell of its half vector and in the 32 neighbouring cells, and all pairs
that may be linked meet in a cell. The number of cells a fingerprint is put in is fixed, and a cell
holds about one of 60,000 unrelated fingerprints.

Fingerprints are made distinct first, so copies cost nothing here. Cells do not emit their pairs: a task
joins what it verifies in a union-find structure and emits a spanning forest. A cell with more than
``BLOCK`` fingerprints is cut into pairs of blocks that go to tasks of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = 16  # of two bits, in each half
#: Fingerprints of one cell that a task compares with each other; larger cells are cut.
BLOCK = 8192
#: Rows of cells that a task holds, about.
TASK_ROWS = 1_000_000
_FIELDS, _ALL = 0x55555555, 0x5555555555555555


@functools.cache
def _spread() -> np.ndarray:
    """For each byte, its bits as the bytes of a 64-bit integer: adding these counts all bits at once."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.view(np.uint64).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned; zero for a text without words or a null."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)  # over half of one
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    spread, count = _spread(), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # a byte holds a count of 255
        lanes = spread[hashes[at : at + 255].view(np.uint8).reshape(-1, 8)].sum(axis=0, dtype=np.uint64)
        count += lanes.view(np.uint8)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed 64-bit integer) for every row, repeated ones included."""
    id_type = docs.schema[id_col].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(of, f"`{id_col}` {id_type.simpleString()}, fp bigint")


def _homes(fps: DataFrame) -> DataFrame:
    """(fp, half, home): the two half vectors of each fingerprint, packed with two bits to a count."""
    halves = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    counts = [h - F.shiftright(h, 1).bitwiseAND(F.lit(_FIELDS)) for h in halves]
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("half"), c.alias("home")) for i, c in enumerate(counts)]))
    return fps.select("fp", both.alias("h")).select("fp", "h.half", "h.home")


def _cells(fps: DataFrame) -> DataFrame:
    """(half, cell, fp): the cells of the grid that each distinct fingerprint is put in."""
    around = [F.col("home")]
    for i in range(SEGMENTS):
        count = F.shiftright("home", 2 * i).bitwiseAND(F.lit(3))
        around += [F.when(count < 2, F.col("home") + (1 << 2 * i)), F.when(count > 0, F.col("home") - (1 << 2 * i))]
    return _homes(fps).select("half", F.explode(F.array(*around)).alias("cell"), "fp").where(F.col("cell").isNotNull())


def _dealt(fps: DataFrame, block: int) -> DataFrame:
    """(half, cell, fp, i, j): a cell of n fingerprints is cut into ceil(n / block) blocks, and a row goes to
    each pair of blocks that its own is in.

    Whether any cell can be that large is told by the largest number of fingerprints with one half vector, of
    which a cell gathers 33 at most; where none can, nothing more is counted.
    """
    cells = _cells(fps)
    most = _homes(fps).groupBy("half", "home").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most * (2 * SEGMENTS + 1) <= block:
        return cells.withColumns({"i": F.lit(0), "j": F.lit(0)})
    large = cells.groupBy("half", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = written(large.select(F.col("half").alias("lh"), F.col("cell").alias("lc"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    joined = cells.join(large, (F.col("half") == F.col("lh")) & (F.col("cell") == F.col("lc")), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = joined.select("half", "cell", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"), other.alias("other"))
    return dealt.select("half", "cell", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


class _Forest:
    """Union-find over fingerprints, by arrays: the root of a class is its least member."""

    def __init__(self) -> None:
        self.a = np.empty(0, np.int64)
        self.b = np.empty(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.pending.append((a, b))
            self.waiting += len(a)
            if self.waiting > 1_000_000:
                self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is no root, and its root."""
        a = np.concatenate([self.a, *[x for x, _ in self.pending]])
        b = np.concatenate([self.b, *[y for _, y in self.pending]])
        self.pending, self.waiting = [], 0
        names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = both[: len(a)], both[len(a) :]
        root = np.arange(len(names))
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        moved = np.flatnonzero(root != np.arange(len(names)))
        self.a, self.b = names[moved], names[root[moved]]
        return self.a, self.b


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the cells that two half vectors at most 2 apart share, the one where their pair is taken."""
    differ = a ^ b
    mask = (differ | (differ >> 1)) & _FIELDS
    low = mask & -mask
    field = low * 3
    two = (mask & (mask - 1)) != 0
    first, second = (a & ~field) | (b & field), (b & ~field) | (a & field)
    middle = (a & ~field) | low  # counts 0 and 2 of one segment
    far = ~two & (((differ >> 1) & mask) != 0) & ((differ & mask) == 0)
    return np.where(two, np.minimum(first, second), np.where(far, middle, np.minimum(a, b)))


def _counts(bits: np.ndarray, fields: int = _FIELDS) -> np.ndarray:
    return bits - ((bits >> 1) & fields)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number, those of its absolute value would count


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the bit counts of the 32 segments of two fingerprints."""
    differ = _counts(a, _ALL) ^ _counts(b, _ALL)
    # counts 0-1 and 1-2 are one apart, 0-2 two; as xor these are 1, 3 and 2
    low, high = differ & _ALL, (differ >> 1) & _ALL
    return _bits(low | high) + _bits(high & ~low)


def _linked(key: np.ndarray, half: np.ndarray, cell: np.ndarray, fp: np.ndarray, forest: _Forest, radius: int) -> None:
    """Adds the verified links of rows sorted by key; a pair is taken in one cell of those it shares."""
    at = np.flatnonzero(key[:-1] == key[1:])
    step = 1
    while len(at):
        for part in np.array_split(at, max(1, len(at) // 500_000)):
            a, b = fp[part], fp[part + step]
            ok = (half[part] == half[part + step]) & (cell[part] == cell[part + step])
            ok &= _manhattan(a, b) <= radius  # the lower bound
            a, b, where = a[ok], b[ok], part[ok]
            ok = _bits(a ^ b) <= radius  # exactly
            a, b, where = a[ok], b[ok], where[ok]
            shift = 32 * half[where]
            forest_cell = _between(_counts((a >> shift) & 0xFFFFFFFF), _counts((b >> shift) & 0xFFFFFFFF))
            ok = forest_cell == cell[where]
            forest.add(a[ok], b[ok])
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the graph in which distinct fingerprints ``fp`` within ``radius`` bits are linked.

    Every component of that graph is one of these edges' too; each edge joins a member with the least member known
    to its task, and may come from several tasks.
    """
    if radius > 4:
        raise ValueError("the grid holds for a radius of at most 4")
    rows = _dealt(fps, block)
    key = F.xxhash64("half", "cell", "i", "j")
    # a task holds its rows, so their number follows that of the fingerprints
    count = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * 2 * (2 * SEGMENTS + 1) // TASK_ROWS))
    dealt = rows.select(key.alias("key"), "half", "cell", "fp").repartition(count, F.col("key"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches]
        if parts:
            key, half, cell, fp = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.argsort(key, kind="stable")
            forest = _Forest()
            _linked(key[order], half[order].astype(np.int64), cell[order], fp[order], forest, radius)
            a, b = forest.edges()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(of, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of ``edges`` (a, b).

    Every round hooks the roots of each edge's ends together and then points every node to its root's root.
    A round is a written table, so a lost executor costs a part of one round. Only counts reach the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
    least = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    roots = roots.unionByName(least).groupBy("node").agg(F.min("root").alias("root"))
    roots = written(_jumped(roots), "roots")
    for _ in range(rounds):
        ends = (
            edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select("a", "b", "ra", "rb")
        )
        edges = written(ends.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return _settled(roots, rounds)
        hooks = edges.groupBy("a").agg(F.min("b").alias("to"))
        moved = _jumped(roots.join(hooks, roots["root"] == hooks["a"], "left").select("node", F.coalesce("to", "root").alias("root")))
        roots = written(moved, "roots")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _jumped(roots: DataFrame) -> DataFrame:
    """Each node pointed to its root's root."""
    up = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
    return roots.join(up, roots["root"] == up["up"], "left").select("node", F.coalesce("top", "root").alias("root"))


def _settled(roots: DataFrame, rounds: int) -> DataFrame:
    """``roots`` with every node pointed to its last root."""
    for _ in range(rounds):
        up = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
        if roots.join(up, roots["root"] == up["up"]).where("root <> top").isEmpty():
            return roots
        roots = written(_jumped(roots), "roots")
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the least id reachable by links, its own included) for every row.

    Null, empty and blank texts have the fingerprint zero and are linked as any other. Repeated rows come out
    as often as they went in; a null id never becomes a component's id unless all its ids are null. Other
    columns are left out, whatever their names.
    """
    prints = written(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), radius))
    top = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = written(top, "classes")
    # written, for Spark splits a hot root's rows only where nothing but the join wants them together
    ids = written(top.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_print = top.select("fp", "root").join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    joined = prints.join(by_print, prints["fp"] == by_print["__fp"])
    return joined.select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
