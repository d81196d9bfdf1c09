"""Near-duplicates by the sets of their word shingles: all pairs with a Jaccard similarity of 0.8, none missed.

The shingles of all texts have one order. Two sets that are similar enough share one of their first
n - ceil(0.8 n) + 1 shingles in it (n is the size of the set), so all pairs that may be linked meet at such a shingle,
and are then verified exactly by their whole sets. Any order will do: it is that of the hashes, but those whose cell of
a sketch counts far more than most come last, so that a common passage brings few texts together.

Equal sets are made one first, so copies cost nothing here. Where up to ``SMALL`` sets meet, all pairs are candidates.
Where more do, first each with the least; only if that leaves them in several components, all with all, in blocks.
Where more than ``HOT`` do, a join brings the least to each, so no task holds all that meet at a shingle.
A sketch of each set, a count for each of a few classes of hashes, bounds from above what two sets share; it leaves few
pairs that can't be similar, and only the texts of the others are brought together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .simhash import SEED, _Forest, components, fingerprint
from .simhash import links as print_links

SHINGLE = 5
#: Cells of the sketch; sets that meet at a shingle and are paired at once; sets in a block; shingles of a step.
CELLS, SMALL, BLOCK, STEP = 1 << 17, 64, 512, 1024
#: Shingles of sets that a task holds, about; sets at a shingle from which no task holds them together.
TASK_ROWS, HOT = 1_000_000, 250_000
#: Counts of sketches that are compared at once.
HELD = 2_000_000
#: Words whose hashes a task keeps.
KEPT = 100_000
#: Places of rows that are sent to every task at most, 24 bytes each; more are joined by an exchange.
SENT = 1_000_000


_words: dict[bytes, int] = {}
#: Odd numbers that the hashes of a shingle's words are multiplied by, and two that mix their sum.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _forgotten() -> None:
    """Gives a task's memory back: a worker goes on to other tasks, of other operators too."""
    _words.clear()
    pa.default_memory_pool().release_unused()


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; those of short ones are kept, up to KEPT of them."""
    get = _words.get
    found = [get(w) for w in words]
    if None in found:
        digest = xxhash.xxh64_intdigest
        if len(_words) > KEPT:
            _forgotten()
        for i, h in enumerate(found):
            if h is None:
                found[i] = h = digest(words[i], SEED)
                if len(words[i]) <= 32:
                    _words[words[i]] = h
    return np.array(found, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles in order, signed; of a shorter text, of all its words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    one, last = _hashes(words), max(n - SHINGLE + 1, 1)
    out = np.full(last, n if n < SHINGLE else 0, np.uint64)  # a short text isn't a part of a longer one
    for i, place in enumerate(_PLACES[: min(n, SHINGLE)]):
        out += one[i : i + last] * place
    for by in _MIX:
        out ^= out >> np.uint64(32)
        out *= by
    return np.unique((out ^ out >> np.uint64(29)).view(np.int64))


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members, ``shared`` of them in both, have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _crowded(docs: DataFrame, text_col: str) -> tuple[np.ndarray, DataFrame]:
    """(whether each cell of the sketch counts more than twice the mean and 64, the counts (cell, n))."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, shingles(text.as_py()) & (CELLS - 1), 1)
        _forgotten()
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    counts = written(docs.select(text_col).mapInArrow(of, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(CELLS, bool)
    out[[r["cell"] for r in counts.where(F.col("n") > 2 * total / CELLS + 64).collect()]] = True
    return out, counts


def sketched(found: np.ndarray) -> bytes:
    """How many members of a set are in each class of hashes, four bits a class: about four in each, of a power of two of classes."""
    classes = 1 << max(4, (len(found) // 4).bit_length())
    counts = np.minimum(np.bincount(found & (classes - 1), minlength=classes), 15).astype(np.uint8)
    return (counts[: classes // 2] | counts[classes // 2 :] << 4).tobytes()


def bounded(a: bytes, b: bytes) -> int:
    """An upper bound of the members that two sets share, from their sketches; a count of 15 may be any."""
    sides = []
    for packed in (a, b):
        both = np.frombuffer(packed, np.uint8)
        counts = np.concatenate([both & 15, both >> 4]).astype(np.int64)
        counts[counts == 15] = 1 << 40
        sides.append(counts)
    short = min(map(len, sides))
    x, y = (c.reshape(-1, short).sum(axis=0) for c in sides)
    return int(np.minimum(x, y).sum())


def _sets(docs: DataFrame, place: str, text_col: str, id_col: str, crowded: np.ndarray) -> DataFrame:
    """(key, node, size, first, sketch, fp) for every row of ``_placed``: its id and place; its set's name, size, shingles of which a
    similar one has some, and sketch; its text's SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(crowded)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                nodes, sizes, firsts, sketches, prints = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = shingles(text)
                    prints.append(fingerprint(text))
                    last = late[found & (CELLS - 1)]
                    nodes.append(_node(found))
                    sizes.append(len(found))
                    firsts.append(np.concatenate([found[~last], found[last]])[: len(found) - -(-4 * len(found) // 5) + 1])
                    sketches.append(sketched(found))
                made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "node", "size", "first", "sketch", "fp"])
        _forgotten()

    own = F.col(f"`{id_col}`")
    rows = docs.select(F.struct(own.isNull().alias("none"), own.alias("id"), F.col(f"{place}.file").alias("file"), F.col(f"{place}.row").alias("row")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("node bigint, size int, first array<bigint>, sketch binary, fp bigint").fields])
    return rows.mapInArrow(of, schema)


def _bare(docs: DataFrame) -> bool:
    """Whether a plan is projections and filters over a scan of files and nothing else, no file being named twice: then each row is one
    row of a file, and the same one whenever it is read."""
    try:
        plan = docs._jdf.queryExecution().analyzed()
        if not plan.deterministic():
            return False
        while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
            plan = plan.children().head()
        if plan.nodeName() != "LogicalRelation":
            return False
        roots = plan.relation().location().rootPaths()
        names = [roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size())]
    except Py4JError:  # a relation without files
        return False
    return not any(i != j and a.startswith(b) for i, a in enumerate(names) for j, b in enumerate(names))


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(``docs`` with one more column, its name): a struct (file, row) that no other row has and that is the same whenever the row is read.

    Rows of a bare scan are told apart by where they stand: the hash of their file's name, and their number there. All else may make
    several rows of one (joins, explodes, a file read twice), so it is written with a number for each row first.
    """
    names, own = [F.col(f"`{c}`") for c in docs.columns], "__place"
    while own in docs.columns:
        own += "_"
    if _bare(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            return docs.select(*names, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")).alias(own)), own
        except AnalysisException:  # files without numbers of rows
            pass
    number = F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row"))
    return written(docs.select(*names, number.alias(own)), "docs"), own


def _hot(entries: DataFrame, cells: DataFrame, hot: int) -> DataFrame | None:
    """(shingle, least), where more than ``hot`` of ``entries`` meet: the least of them. None if no cell counts so many.

    Only shingles of cells that count so many are counted themselves.
    """
    full = written(cells.where(F.col("n") > hot).select("cell"), "full")  # of CELLS at most
    if full.isEmpty():
        return None
    some = entries.withColumn("cell", F.col("shingle").bitwiseAND(F.lit(CELLS - 1)).cast("int")).join(F.broadcast(full), "cell")
    met = some.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct("node", "size", "at")).alias("least")).where(F.col("n") > hot)
    found = written(met.select("shingle", "least"), "hot")
    return None if found.isEmpty() else found


def _with_least(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """As ``_pairs`` for the shingles of ``hot``: each with the least that it meets, by a join whose large keys Spark splits."""
    met = entries.join(hot, "shingle")
    rest = lambda c: F.col(f"{c}size") - F.col(f"{c}at")
    ok = (F.col("node") != F.col("least.node")) & (9 * F.least(rest(""), rest("least.")) >= 4 * (F.col("size") + F.col("least.size")))
    both = F.array(F.struct(F.col("least.node").alias("a"), F.when(ok, F.col("node")).alias("b"), F.lit(None).cast("bigint").alias("shingle")), F.struct(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("shingle").alias("shingle")))
    return met.select(F.explode(both).alias("p")).select("p.a", "p.b", "p.shingle").where("b is not null or shingle is not null")


def _pairs(entries: DataFrame, small: int) -> DataFrame:
    """(a, b, shingle), more than once: pairs of ``entries`` (shingle, node, size, at), those at one shingle that can be similar.

    If it is the first that they share, what follows it bounds what they share; a similar pair passes there.
    Where more than ``small`` meet, only the pairs with the least of them, and (node, null, shingle) for each besides."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches]
        if not parts:
            return
        key, node, size, place = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order].astype(np.int64)
        rest = size - place[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(starts, len(key)))
        large = np.repeat(count > small, count)
        found = []

        def add(a: np.ndarray, b: np.ndarray) -> None:
            ok = (a != b) & similar(np.minimum(rest[a], rest[b]), size[a], size[b])
            found.append(np.stack([node[a[ok]], node[b[ok]]], axis=1))

        add(np.repeat(starts, count)[large], np.flatnonzero(large))
        at, step = np.flatnonzero(~large[:-1] & (key[:-1] == key[1:])), 1
        while len(at):
            add(at, at + step)
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
        both = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["a", "b", "shingle"])
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(key[large])], names=["a", "b", "shingle"])

    # a task holds its rows, so their number follows that of the entries
    count = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // TASK_ROWS))
    return entries.repartition(count, F.col("shingle")).mapInArrow(of, "a bigint, b bigint, shingle bigint")


def _all_pairs(entries: DataFrame, cells: DataFrame, small: int, hot: int) -> DataFrame:
    """As ``_pairs``, with what meets at hot shingles brought together by a join."""
    many = _hot(entries, cells, hot)
    if many is None:
        return _pairs(entries, small)
    sent = _sent(many)
    return _pairs(entries.join(sent.select("shingle"), "shingle", "left_anti"), small).unionByName(_with_least(entries, sent))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets can be similar by their sketches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            columns = [whole.column(c).to_pylist() for c in ("of_a", "of_b", "size_a", "size_b")]
            ok = [bool(similar(bounded(x, y), n, m)) for x, y, n, m in zip(*columns)]
            yield whole.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("sketch").alias(f"of_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b", "size_a", "size_b").mapInArrow(of, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = functools.lru_cache(maxsize=64)(shingles)
        for whole in batches:
            ok = []
            for x, y in zip(whole.column(2), whole.column(3)):
                p, q = members(x.as_py()), members(y.as_py())
                ok.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield whole.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"of_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(of, "a bigint, b bigint")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    sizes = [len(x) for x in sets]
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    kept = counts[at] > 1  # what only one has is shared by none
    number = np.cumsum(counts > 1) - 1
    row, column = row[kept], number[at[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, STEP):
        a, b = np.searchsorted(column, [first, first + STEP])
        has = np.zeros((len(sets), STEP), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _dealt(entries: DataFrame, block: int) -> DataFrame:
    """``entries`` (shingle, node, n, ...), where n sets meet at a shingle, in each pair (i, j) of blocks that its own is in."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = [c for c in entries.columns if c != "n"]
    dealt = entries.select(*rest, F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return dealt.select(*rest, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _counted(entries: DataFrame) -> DataFrame:
    """``entries`` with ``n``, how many sets meet at each shingle, of those shingles where they are in several components."""
    met = entries.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"), F.bit_xor(F.xxhash64("node")).alias("who")).where("x <> y")
    # of the shingles of a passage that meet the same sets, one
    apart = written(met.groupBy("who", "n").agg(F.min("shingle").alias("shingle")).select("shingle", "n"), "apart")
    return entries.join(apart, "shingle")


def partnered(sketches: list[bytes], sizes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which sets can be similar to one of another root, by their sketches."""
    out, counts = np.zeros(len(sizes), bool), {}
    for i, packed in enumerate(sketches):
        both = np.frombuffer(packed, np.uint8)
        counts.setdefault(2 * len(both), ([], []))
        counts[2 * len(both)][0].append(i)
        counts[2 * len(both)][1].append(np.concatenate([both & 15, both >> 4]))
    table = {c: (np.array(at), np.where((x := np.array(rows, np.uint16)) == 15, np.uint16(5000), x)) for c, (at, rows) in counts.items()}
    for c, (at, rows) in table.items():
        others = [(at, rows)]
        if 2 * c in table:  # sets of sizes that can be similar are at most one doubling apart
            more, wide = table[2 * c]
            others.append((more, wide[:, :c] + wide[:, c:]))
        for to, columns in others:
            step = max(1, HELD // (len(to) * c))
            for first in range(0, len(at), step):
                own = at[first : first + step]
                shared = np.minimum(rows[first : first + step, None, :], columns[None, :, :]).sum(axis=2, dtype=np.int32).astype(np.int64)
                ok = similar(np.minimum(shared, np.minimum(sizes[own][:, None], sizes[to][None, :])), sizes[own][:, None], sizes[to][None, :]) & (roots[own][:, None] != roots[to][None, :])
                out[own] |= ok.any(axis=1)
                out[to] |= ok.any(axis=0)
    return out


def _among(entries: DataFrame, roots: DataFrame, sets: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(a, b): a forest of the links among the sets at each shingle of ``entries`` (shingle, node) that are in several components.

    Blocks of sets are compared by their sketches first; the texts are brought only of those that can be similar to a set of another
    component.
    """
    placed = entries.join(roots, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root"))
    counted = _counted(written(placed, "placed"))

    def possible(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy() for c in ("node", "size", "root")]
        ok = partnered(group.column("sketch").to_pylist(), columns[1].astype(np.int64), columns[2])
        return group.select(["shingle", "node", "root"]).filter(pa.array(ok))

    dealt = _dealt(counted.join(sets.select("node", "size", "sketch"), "node"), block)
    some = written(dealt.groupBy("shingle", "i", "j").applyInArrow(possible, "shingle bigint, node bigint, root bigint").distinct(), "partnered")
    left = _dealt(_counted(some).drop("root"), block).join(texts, "node")

    def of(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        members = [shingles(x.as_py()) for x in group.column("text")]
        _forgotten()
        sizes = np.array([len(x) for x in members])
        a, b = np.nonzero(np.triu(similar(_overlaps(members), sizes[:, None], sizes[None, :]), 1))
        forest = _Forest()
        forest.add(nodes[a], nodes[b])
        a, b = forest.edges()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return left.groupBy("shingle", "i", "j").applyInArrow(of, "a bigint, b bigint")


def _printed(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between sets of which some texts have SimHashes within ``bits`` of each other, as a forest of these."""
    marks = written(prints.select("node", "fp").distinct(), "marks")
    named = written(marks.groupBy("fp").agg(F.min("node").alias("rep")), "named")
    same = marks.join(named, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    ends = [named.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    near = written(print_links(named.select("fp"), bits), "near").join(ends[0], "a").join(ends[1], "b").where("rep_a <> rep_b")
    return same.unionByName(near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def _classes(docs: DataFrame, place: str, id_col: str, text_col: str, small: int, block: int, hot: int, bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(``_sets``, (node, least): the least key of each set's component) of rows with their places."""
    crowded, cells = _crowded(docs, text_col)
    prints = written(_sets(docs, place, text_col, id_col, crowded), "prints")
    distinct = written(prints.groupBy("node").agg(F.min("key").alias("least"), F.first("size").alias("size"), F.first("first").alias("first"), F.first("sketch").alias("sketch")), "distinct")
    entries = distinct.select(F.posexplode("first").alias("at", "shingle"), "node", "size").select("shingle", "node", "size", "at")
    found = written(_all_pairs(entries, cells, small, hot), "pairs")
    pairs, crowded = found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("shingle", F.col("a").alias("node"))
    pairs = written(_possible(pairs, distinct), "possible")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    one = _sent(written(distinct.select("node", F.col("least.file").alias("file"), F.col("least.row").alias("row")).join(asked, "node", "left_semi"), "asked"))
    texts = docs.select(f"{place}.file", f"{place}.row", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(one, ["file", "row"]).select("node", "text")
    texts = written(texts, "texts")
    links = _verified(pairs, texts)
    if bits is not None:
        links = links.unionByName(_printed(prints, bits))
    links = written(links, "links")
    roots = components(links)
    if not crowded.isEmpty():
        more = written(_among(crowded, roots, distinct, texts, block), "more")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    top = written(distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "classes")
    # written, for Spark splits a hot root's rows only where nothing but the join wants them together
    ids = written(top.groupBy("root").agg(F.min("least").alias("least")), "ids")
    return prints, written(top.select("node", "root").join(ids, "root").select("node", "least"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """``id_col`` and ``component_id`` (the least id reachable by links, its own included) for every row.

    With ``bits``, texts whose SimHashes differ in so many bits at most are linked too, by the grid of ``simhash``. Texts without words are copies of each other. Repeated rows come out as often as they went in; a null id never
    becomes a component's id unless all its ids are null.
    """
    prints, named = _classes(*_placed(docs), id_col, text_col, small, block, hot, bits)
    return prints.select("key", "node").join(named, "node").select(F.col("key.id").alias(id_col), F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``, that of the least id (a null id comes last; of rows with one id, any).

    Rows are told apart by their places in their files or, unless ``docs`` is a bare scan, by numbers that they are written with
    first; so it does no harm if an id stands for several texts or one stored row became several. All columns
    stay, whatever their names. Rows without words are copies of each other, and one of them stays.
    """
    placed, place = _placed(docs)
    prints, named = _classes(placed, place, id_col, text_col, small, block, hot, bits)
    again = prints.select("key", "node").join(named, "node").where("key <> least").select(F.col("key.file").alias("file"), F.col("key.row").alias("row"))
    again = _sent(written(again, "again"))
    kept = placed.join(again, (F.col(f"{place}.file") == again["file"]) & (F.col(f"{place}.row") == again["row"]), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent to every task of a join if there are SENT of them at most."""
    return F.broadcast(rows) if rows.count() <= SENT else rows
