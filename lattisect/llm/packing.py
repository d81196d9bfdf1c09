"""Best-fit packing of tokenized documents into sequences, with certified bounds.

Pieces are dealt over partitions of a bounded size and each is packed by best-fit decreasing. Dual-feasible
functions bound from below how many sequences a partition, and the whole, must have. A partition that meets its bound is
certified and stays as it is. While the whole has more than its bound, those with a gap give up their unfilled sequences, and
as many of certified ones join them as it takes to fill these; their pieces are exchanged (dealt anew) and packed again.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Pieces that one task packs.
GROUP = 40_000
#: A sequence gives up its pieces if at least one in so many of its tokens is free.
FREE_PART = 128
#: Parts of texts, and words, that a worker keeps encoded in each of two generations; the length from which one isn't kept.
PARTS, CACHED, LONG = 300_000, 150_000, 100
#: New words that are learned together.
STEP = 10_000
_MARK = "\x01"
#: Words of these characters are cut by TOKENS once they are in lower case, as the tokenizer does.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u024f"
TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")

_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def tokenizer_file(name: str) -> str:
    """The path of a tokenizer's file: ``name`` itself, or where this machine keeps the public one of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """What was made of words, in two generations: when ``now`` is full it becomes the elder one, and the words of that which are
    asked for again come back. Frequent words stay, and rare ones, without end in a large table, go."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.now: dict = {}
        self.elder: dict = {}

    def lacking(self, words: set) -> list:
        """Those of ``words`` that must be made; the others are in ``now``."""
        new = []
        for word in words.difference(self.now):
            made = self.elder.get(word)
            if made is None:
                new.append(word)
            else:
                self.now[word] = made
        return new

    def aged(self) -> None:
        """To be called once what was asked for has been used."""
        if len(self.now) > self.most:
            self.now, self.elder = {}, self.now


def encoded(texts: list[str], cut: Callable[[str], list[str]], known: Recent, learn: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
    """The ids of texts that ``cut`` takes apart: what ``known`` lacks is learned at once, and kept unless it is long.

    Texts are cut twice, so that the parts of one text live at a time and what is kept doesn't lie scattered between them.
    """
    asked: set[str] = set()
    for text in texts:
        asked.update(cut(text))
    new = known.lacking(asked)
    if new:
        known.now.update(learn(new))
    of_part = known.now.__getitem__
    out = [b"".join(map(of_part, cut(text))) for text in texts]
    for part in new:
        if len(part) > LONG:
            del known.now[part]
    known.aged()
    return out


def word_encoder(name: str = TOKENIZER) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, each as little-endian unsigned 32-bit integers.

    For a tokenizer that drops white space and never joins what stands on either side of it, as this one:
    then the ids of a text are those of the parts between its spaces and line ends, and each distinct part is
    encoded once. Plain parts are cut further, into the words that the tokenizer encodes on their own, and what is new is
    encoded together: the last id of a word tells that it ends. Other new parts are encoded with a mark between them.
    """
    if name in _encoders:
        return _encoders[name]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(name))
    tok.no_truncation()
    tok.no_padding()
    known, words = Recent(PARTS), Recent(CACHED)
    encode = lambda text: np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    mark = encode(_MARK)
    last = np.zeros(tok.get_vocab_size() + 1, bool)
    last[[i for t, i in tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
    if len(mark) != 1 or not np.array_equal(encode("a b"), np.concatenate([encode("a"), encode("b")])):
        raise ValueError("the tokenizer doesn't encode the parts between spaces on their own")

    def learn(parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(parts), STEP):  # few lists of words live at once: collections of garbage stay short
            some = parts[at : at + STEP]
            cut = {p: TOKENS.findall(p.lower()) for p in some if len(p) <= LONG and PLAIN.fullmatch(p) and "<|" not in p}
            need = set().union(*cut.values())
            words.now.update(plain(words.lacking(need)))
            of_word = words.now
            out.update({p: of_word[ws[0]] if len(ws) == 1 else b"".join(map(of_word.__getitem__, ws)) for p, ws in cut.items()})
            words.aged()
            out.update(whole([p for p in some if p not in cut]))
        return out

    def plain(new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            ids = encode(" ".join(some))
            cuts = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(cuts) != len(some):  # the file's words don't end in this way
                out |= whole(some)
                continue
            data = ids.tobytes()
            out |= {p: data[4 * a : 4 * b] for p, a, b in zip(some, [0, *cuts], cuts)}
        return out

    def whole(parts: list[str]) -> dict[str, bytes]:
        out = {p: encode(p).tobytes() for p in parts if _MARK in p or len(p) > LONG}
        rest = [p for p in parts if p not in out]
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            ids = encode(f" {_MARK} ".join(some))
            cuts = np.flatnonzero(ids == mark[0]).tolist()
            if len(cuts) != len(some) - 1:  # the mark's id came from a word: one by one
                out |= {p: encode(p).tobytes() for p in some}
                continue
            data = ids.tobytes()
            out |= {p: data[4 * a : 4 * b] for p, a, b in zip(some, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)])}
        return out

    def of(texts: list[str]) -> list[bytes]:
        return encoded(texts, lambda t: t.replace("\n", " ").split(" "), known, learn)

    _encoders[name] = of
    return of


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``id_col``, piece, start, length and ids_crc32 of each piece of each row.

    A document is its text's ids and an end; a null text counts as empty, so every row has a piece. Only documents
    of more than ``capacity`` ids are cut. Other columns are left out, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end, step = END_ID.to_bytes(4, "little"), 4 * capacity

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                rows, numbers, lengths, sums = [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    for number, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append(row)
                        numbers.append(number)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                number = np.array(numbers, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(of, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def bound(counts: np.ndarray) -> int:
    """A lower bound on the sequences that ``counts[x]`` pieces of each length x need; the capacity is its last index.

    The best of two families of dual-feasible functions: those that drop the small and round up the large
    pieces, and those that round to multiples of a k-th.
    """
    capacity = len(counts) - 1
    x = np.arange(capacity + 1)
    size = (counts * x).astype(np.int64)
    best = -(-int(size.sum()) // capacity)
    number_to, size_to = np.cumsum(counts), np.cumsum(size)
    small = np.arange(1, capacity // 2 + 1)
    large = number_to[-1] - number_to[capacity - small]
    middle = size_to[capacity - small] - size_to[small - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, free by bin) for lengths in decreasing order: each goes where it leaves least room.

    Bins are kept by what is free in them, with a bit for each amount that some bin has.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, free = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        fit = some >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            own = by_free[room].pop()
            if not by_free[room]:
                some ^= 1 << room
        else:
            room, own = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = own, capacity - room
        room -= need
        free[own] = room
        if room:
            if not by_free[room]:
                some |= 1 << room
            by_free[room].append(own)
    return bins, offsets, np.array(free, np.int64)


def _histogram(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return np.bincount(lengths, minlength=capacity + 1)


def _round(rows: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """Packs ``rows`` in ``groups`` groups; adds sequence_id, offset, free (of the sequence), group, bins and bound of the group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable").drop(columns="group")
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, free = best_fit(lengths, capacity)
        return group.assign(
            sequence_id=(number << 56) + (int(key[0]) << 24) + bins, offset=offsets, free=free[bins],
            group=int(key[0]), bins=len(free), bound=bound(_histogram(lengths, capacity)),
        )

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(of, f"{schema}, sequence_id bigint, offset bigint, free bigint, group bigint, bins bigint, bound bigint")


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> tuple[DataFrame, dict[str, int]]:
    """(``rows`` with sequence_id and offset, {"sequences", "bound"}) for rows with a column ``length`` of 1 to ``capacity``.

    Repeated rows are packed as often as they stand there; equal lengths go in the order of their rows. An empty
    table gives an empty table, and no sequence. ``bound`` certifies the count: no packing has fewer.
    """
    names = rows.columns
    inner = {c: f"c{i}" for i, c in enumerate(names) if c != "length"}  # the names of others may clash
    left = rows.select(*[F.col(c).alias(inner.get(c, c)) for c in names], F.monotonically_increasing_id().alias("row"))
    left = written(left, "pieces")
    hist = left.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["n"]
    total, least = int(counts.sum()), bound(counts)
    done, used, before, previous = [], 0, 0, None
    room = max(1, capacity // FREE_PART)
    for number in itertools.count():  # a round that saves no sequence is the last
        groups = max(1, -(-total // group))
        packed = written(_round(left.select(*inner.values(), "length", "row"), number, groups, capacity), "packed")
        # a row for each group of so many pieces
        made = packed.groupBy("group").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).agg(F.sum("bins").alias("bins"), F.sum(F.when(F.col("bins") > F.col("bound"), 1).otherwise(0)).alias("gaps")).first()
        count, gaps = made["bins"] or 0, made["gaps"] or 0
        if previous is not None and count >= before:  # nothing saved: the last packing stands
            done.append(previous)
            used += before
            break
        if used + count <= least or (groups == 1 and number):
            done.append(packed)
            used += count
            break
        # unfilled sequences of groups with a gap; where all groups are certified, what each has left over is the gap of the whole
        given = F.col("free") >= room
        if gaps:
            given = given & ((F.col("bins") > F.col("bound")) | (F.col("free") >= capacity // 2))
        stay, previous = packed.where(~given), packed.where(given)
        kept = stay.agg(F.count_distinct("sequence_id")).first()[0]
        done.append(stay)
        used, before, left = used + kept, count - kept, previous
        total = left.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    back = [F.col(inner.get(c, c)).alias(c) for c in names]
    return out.select(*back, "sequence_id", "offset"), {"sequences": used, "bound": least}


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows with the sequence and the offset where each lies."""
    return pack(pieces(docs, id_col, text_col, tokenizer, capacity), capacity)[0]
