"""Collocations: phrases by how much more often their words meet than chance would have it, from indices of suffixes.

Texts become shards of one language each, numbered words with separators between pieces. The index of a shard is the Burrows-Wheeler transform of its
words read backwards: its rows are the places of the text in the order of the words that end there, each with the word that follows. The places of a phrase
are an interval of rows, and an interval in the order of the words that start there too; both are carried on when a phrase gets one
more word to its right, by counting the words that follow in its rows. An extension to the right of a phrase's beginning is one to the left of its end, and
the interval of that end is the one around it. So all phrases of k words come from those of k - 1, each with both phrases it extends.

Counts are added up across shards after each length, and only phrases that are frequent everywhere together are extended, on either side: no frequent
phrase has a part that isn't. What is exchanged are numbers: a shard's words once, and for each length its intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import discarded
from .common import written

WORDS, LEAST, TOP = 5, 100, 2000
#: Words of a shard, about; bytes of a text that are cut into words at once; words that a task holds in unfinished shards.
SHARD, STEP, HELD = 500_000, 1_000_000, 1_000_000
#: Shards of a row group: what a task that reads or writes shards holds of them in the JVM.
ROWS = 4
#: Bytes of frequent phrases that are sent to every task at most; more are joined by an exchange.
SENT = 8_000_000
#: What parts pieces (it becomes a full stop, which no word has), and what parts words.
_CUT = bytes(ord(".") if chr(b) in ".,;:!?\n\v\f\r" else ord(" ") if chr(b) == "\t" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b for b in range(256))


class _Numbers(dict):
    """Words and their numbers, in the order in which they come; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    def __init__(self) -> None:
        self.numbers, self.parts, self.size = _Numbers({b".": 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.numbers))[1:].astype(np.int64)
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words, pa.array(counts), pa.array(seq))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), *lists], names=["shard", "lang", "words", "counts", "seq"])


def _stretches(text: str) -> Iterator[list[bytes]]:
    """A text's words, with full stops between its pieces and at its end, in lists of bounded length, each of whole pieces."""
    data = text.encode("utf-8", "replace").translate(_CUT) + b"."
    at = 0
    while at < len(data):
        end = data.find(b".", at + STEP) + 1 or len(data)
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def shards(docs: DataFrame, lang_col: str, text_col: str, size: int = SHARD) -> DataFrame:
    """(shard, lang, words, counts, seq): texts of a language as numbers of their words, 0 between pieces. No exchange."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, base = {}, 0, TaskContext.get().partitionId() << 32

        def flushed(lang: str) -> pa.RecordBatch:
            nonlocal base
            base += 1
            return made.pop(lang).row(base, lang)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = lang.as_py()
                for words in _stretches(text.as_py()):
                    shard = made.setdefault(own, _Shard())
                    shard.add(words)
                    held += len(words)
                    if shard.size >= size:
                        held -= shard.size
                        yield flushed(own)
                if held > max(size, HELD):
                    yield from [flushed(x) for x in list(made)]
                    held = 0
        yield from [flushed(x) for x in list(made)]

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "shard bigint, lang string, words array<string>, counts array<bigint>, seq array<int>")


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
    return out


def transformed(seq: np.ndarray, depth: int = WORDS - 1) -> np.ndarray:
    """The word after each place of ``seq`` (cyclic), the places in the order of the ``depth`` words that end there, last word first.

    That order is enough to extend phrases of up to ``depth`` words.
    """
    rank, known = seq.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        rank = _ranks(rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, step))
        known += step
    return np.roll(seq, -1)[np.argsort(rank, kind="stable")]


class Index:
    """A shard's transform with what extends intervals: where each row's next word stands as a last word."""

    def __init__(self, after: np.ndarray) -> None:
        self.after = after
        order = np.argsort(after, kind="stable")
        self.to = np.empty(len(after), np.int64)
        self.to[order] = np.arange(len(after))
        #: Where the rows of each word begin; the order by first words has the same.
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(after))))

    def extended(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, first, last, size) for every word that follows each of some phrases, whose intervals start at ``first`` in the order
        by first words and at ``last`` in that by last words. Separators extend nothing."""
        phrase = np.repeat(np.arange(len(size)), size)
        rows = np.arange(int(size.sum())) + np.repeat(last - (np.cumsum(size) - size), size)
        key = phrase * len(self.starts) + self.after[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(begins, len(key)))
        of = key[begins] // len(self.starts)
        before = begins - (np.cumsum(size) - size)[of]  # followed by lesser words
        some = self.after[rows[begins]] > 0
        return of[some], (first[of] + before)[some], self.to[rows[begins]][some], count[some]


def _first(index: Index, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of single words."""
    return index.starts[words], index.starts[words], index.starts[words + 1] - index.starts[words]


def _around(last: np.ndarray, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the known intervals (their starts ascend) each place lies in, or -1."""
    at = np.searchsorted(known, last, "right") - 1
    return np.where((at >= 0) & (last < (known + size)[at]), at, -1) if len(known) else np.full(len(last), -1)


_FOUND = "shard bigint, first int, last int, size int, p bigint, s bigint"


def _grown(index: Index, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, size, p, s) of the phrases one word longer than those of some intervals, whose ``last`` ascend: p and s are the places among
    these of the phrase that each begins with and of the one that it ends with."""
    of, more_first, more_last, count = index.extended(first, last, size)
    ends = _around(more_last, last, size)
    some = ends >= 0
    return more_first[some], more_last[some], count[some], of[some], ends[some]


def _rows(shard: int, first: np.ndarray, last: np.ndarray, size: np.ndarray, p: np.ndarray, s: np.ndarray) -> pa.Table:
    numbers = [pa.array(v.astype(np.int32)) for v in (first, last, size)]
    return pa.table([pa.array(np.full(len(p), shard, np.int64)), *numbers, pa.array(p), pa.array(s)], names=["shard", "first", "last", "size", "p", "s"])


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


_INDEX = "shard bigint, after array<int>, names array<bigint>"


def _index_of(shard: int, seq: np.ndarray, at: np.ndarray, names: np.ndarray) -> pa.Table:
    """The index of a shard over its words at the places ``at`` of its list, renumbered in that order; all others are separators."""
    number = np.zeros(int(max(seq.max(initial=0), at.max(initial=0) + 1)) + 1, np.int32)
    number[at + 1] = np.arange(1, len(at) + 1)
    seq = np.append(np.int32(0), number[seq])
    seq = seq[np.append(True, (seq[1:] != 0) | (seq[:-1] != 0))]  # one separator is as good as many
    return pa.table({"shard": pa.array([shard], pa.int64()), "after": pa.array([transformed(seq)], pa.list_(pa.int32())), "names": pa.array([names], pa.list_(pa.int64()))})


def _indexed(made: DataFrame, frequent: DataFrame) -> DataFrame:
    """(shard, after, names): the index of each shard of ``made`` over its words in ``frequent`` (lang, phrase, name).

    The words are sent to every task if they have SENT bytes at most, and else joined by an exchange."""
    own = frequent.select("lang", "phrase", "name")
    if _bytes(own) <= SENT:
        known: dict[str, dict[str, int]] = {}
        for r in own.collect():
            known.setdefault(r["lang"], {})[r["phrase"]] = r["name"]
        shared = made.sparkSession.sparkContext.broadcast(known)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    get = shared.value.get(batch.column(1)[i].as_py(), {}).get
                    names = np.array([-1 if n is None else n for n in map(get, batch.column(2)[i].as_py())], np.int64)
                    at = np.flatnonzero(names >= 0)
                    yield from _index_of(batch.column(0)[i].as_py(), batch.column(3)[i].values.to_numpy(), at, names[at]).to_batches()
                    pa.default_memory_pool().release_unused()

        return made.select("shard", "lang", "words", "seq").mapInArrow(of, _INDEX)
    words = made.select("shard", "lang", F.posexplode("words").alias("at", "word"))
    met = words.join(own.withColumnRenamed("lang", "of"), (F.col("lang") == F.col("of")) & (F.col("word") == F.col("phrase")))

    def both(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows or not found.num_rows:
            return _index_of(0, np.zeros(1, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)).slice(0, 0)
        return _index_of(texts.column("shard")[0].as_py(), texts.column("seq").combine_chunks().flatten().to_numpy(), *_numpy(found, "at", "name"))

    return made.select("shard", "seq").groupBy("shard").cogroup(met.select(F.col("shard").alias("to"), "at", "name").groupBy("to")).applyInArrow(both, _INDEX)


def _enumerated(indexed: DataFrame, tables: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The intervals of phrases of ``len(tables) + 1`` words in every shard; p and s are places in the last of ``tables``, which has for each length
    the names of its frequent phrases and, in their order, what tells them: the places of the two phrases that each extends, as one number."""
    shared = indexed.sparkSession.sparkContext.broadcast(tables)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                index = Index(batch.column(1)[i].values.to_numpy())
                place = np.searchsorted(known[0][0], batch.column(2)[i].values.to_numpy())
                spans = _first(index, np.arange(1, len(place) + 1))
                for (names, _), (_, keys) in zip(known, known[1:]):
                    *spans, p, s = _grown(index, *spans)
                    key = place[p] * len(names) + place[s]
                    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                    some = np.flatnonzero(keys[at] == key) if len(keys) else np.empty(0, np.int64)
                    some = some[np.argsort(spans[1][some])]
                    place, spans = at[some], [v[some] for v in spans]
                *spans, p, s = _grown(index, *spans)
                yield from _rows(batch.column(0)[i].as_py(), *spans, place[p], place[s]).to_batches()
                pa.default_memory_pool().release_unused()

    return indexed.select("shard", "after", "names").mapInArrow(of, _FOUND)


def _singles(indexed: DataFrame) -> DataFrame:
    """(shard, first, last, size, name): the intervals of single words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column(2)[i].values.to_numpy()
                spans = _first(Index(batch.column(1)[i].values.to_numpy()), np.arange(1, len(names) + 1))
                yield from _rows(batch.column(0)[i].as_py(), *spans, names, names).to_batches()

    return indexed.select("shard", "after", "names").mapInArrow(of, _FOUND).select("shard", "first", "last", "size", F.col("p").alias("name"))


def _longer(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """As ``_enumerated``, one word longer than the phrases of ``known`` (shard, first, last, size, name), which come to their shards by an exchange."""

    def of(shard: pa.Table, own: pa.Table) -> pa.Table:
        if not shard.num_rows or not own.num_rows:
            return _rows(0, *[np.empty(0, np.int64)] * 5)
        index = Index(shard.column("after").combine_chunks().flatten().to_numpy())
        first, last, size, name = _numpy(own, "first", "last", "size", "name")
        order = np.argsort(last)
        *spans, p, s = _grown(index, first[order], last[order], size[order])
        return _rows(shard.column("shard")[0].as_py(), *spans, name[order][p], name[order][s])

    return indexed.select("shard", "after").groupBy("shard").cogroup(known.select(F.col("shard").alias("to"), "first", "last", "size", "name").groupBy("to")).applyInArrow(of, _FOUND)


def _bytes(rows: DataFrame) -> int:
    """About how many bytes a table of numbers and texts has."""
    texts = [F.octet_length(f.name) for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    return rows.agg(F.sum(sum(texts, F.lit(8 * (len(rows.columns) - len(texts)))))).first()[0] or 0


def _table(level: DataFrame, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The frequent phrases of a length as ``_enumerated`` takes them, where ``names`` are those of the phrases a word shorter, in order.
    None if they have more than SENT bytes."""
    own = level.select("name", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("s", F.lit(0)).alias("s"))
    if _bytes(own) > SENT:
        return None
    name, p, s = np.array(own.collect(), np.int64).reshape(-1, 3).T
    if names is None:
        return np.sort(name), np.empty(0, np.int64)
    by_name = np.argsort(names)
    p, s = (by_name[np.searchsorted(names, v, sorter=by_name)] for v in (p, s)) if len(p) else (p, s)
    key = p * len(names) + s
    order = np.argsort(key)
    return name[order], key[order]


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST, size: int = SHARD) -> tuple[list[DataFrame], DataFrame]:
    """([(name, lang, phrase, last, f, starts, ends, p, s) for phrases of 1, 2, ... ``words`` words], (lang, n)).

    ``f`` is how often a phrase stands in the pieces of its language, ``least`` times or more; ``starts`` and ``ends`` are how often its first and
    its last 1, 2, ... words do, ``p`` and ``s`` the names of the phrases without its last and without its first word. Texts and
    languages that are null count as empty and as ``und``. Other columns don't matter.

    While the frequent phrases have SENT bytes at most, each length's pass goes through a shard's index anew, told which phrases are frequent, and only
    sums are exchanged. Beyond that the intervals of frequent phrases are joined, written and brought to their shards.
    """
    made = written(shards(docs, lang_col, text_col, size), "shards", ROWS)
    totals = made.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    counts = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f"))
    name, nothing = F.monotonically_increasing_id().alias("name"), F.lit(None).cast("bigint")
    single = counts.where(F.col("f") >= least).select(name, "lang", "phrase", F.col("phrase").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"), nothing.alias("p"), nothing.alias("s"))
    levels, totals = [written(single, "frequent")], written(totals, "totals")
    indexed = written(_indexed(made, levels[0]), "index", ROWS)
    discarded(made)
    table = _table(levels[0], None)
    tables = [table] if table else []
    found: DataFrame | None = None
    for k in range(2, words + 1):
        if told := len(tables) == k - 1:
            found, names = _enumerated(indexed, tables), tables[-1][0]
            sums = found.groupBy((F.col("p") * len(names) + F.col("s")).alias("key")).agg(F.sum("size").alias("f")).where(F.col("f") >= least)
            numbered = docs.sparkSession.createDataFrame(list(enumerate(names.tolist())), "place bigint, name bigint")  # as many as are told
            p, s = (numbered.select(F.col("place").alias(f"at_{c}"), F.col("name").alias(c)) for c in "ps")
            sums = sums.select("f", F.expr(f"key div {max(1, len(names))}").alias("at_p"), F.expr(f"key % {max(1, len(names))}").alias("at_s")).join(p, "at_p").join(s, "at_s").select("p", "s", "f")
        else:
            found = _longer(indexed, written(_singles(indexed) if found is None else found.join(frequent, ["p", "s"]).select("shard", "first", "last", "size", "name"), "known"))
            sums = found.groupBy("p", "s").agg(F.sum("size").alias("f")).where(F.col("f") >= least)
        left = levels[-1].select(F.col("name").alias("p"), "lang", "phrase", "starts")
        right = levels[-1].select(F.col("name").alias("s"), "last", "ends")
        both = written(sums, "sums").join(left, "p").join(right, "s")
        made_of = [F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"), "p", "s"]
        levels.append(written(both.select(name, "lang", *made_of), "frequent"))
        frequent = levels[-1].select("p", "s", "name")
        if told and k < words:
            if table := _table(levels[-1], names):
                tables.append(table)
            else:  # what is joined next has places in place of names
                frequent = frequent.join(p, "p").join(s, "s").select(F.col("at_p").alias("p"), F.col("at_s").alias("s"), "name")
    return levels, totals


def scored(levels: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one with the same count has in it.

    If a longer one has, so has one a word longer: counts don't rise with words. The lowest of the scores 1000 a n / (l r) over all cuts counts,
    rounded down; of equal ones that with the shortest first part. All arithmetic is on whole numbers of up to 38 digits.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    out = []
    for k, level in enumerate(levels[1:], 2):
        row = level
        if k < len(levels):
            up = levels[k].select(F.explode(F.array("p", "s")).alias("of"), "f").groupBy("of").agg(F.max("f").alias("most"))
            row = level.join(up, F.col("name") == F.col("of"), "left").where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("f")))
        row = row.select("lang", "phrase", F.col("f").alias("a"), "starts", "ends").join(totals, "lang")
        cuts = []
        for i in range(1, k):
            l, r = F.col("starts")[i - 1], F.col("ends")[k - i - 1]
            share = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), whole(l) * whole(r))
            cuts.append(F.struct(share.alias("score"), F.lit(i).alias("part"), l.alias("l"), r.alias("r")))
        out.append(row.select("lang", "phrase", "a", "n", (F.array_min(F.array(*cuts)) if k > 2 else cuts[0]).alias("cut")))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, then count, then the bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = scored(*phrases(docs, lang_col, text_col, words, least, size)).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return rows.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
