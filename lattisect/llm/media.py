"""Media columns: recordings found again by fingerprints of their pitch classes.

Frames of a recording become the energies of the twelve pitch classes; sums over rectangles of these, taken from an
integral image, are compared by a bank of filters, and each filter gives two bits of the packed integer of a
position. Positions whose integers agree in three quarters of the filters vote for the offset between them. A histogram
of all offsets of all recordings tells where two may lie over each other, and the share of differing bits in the whole overlap
whether they match there. No vote is left out, however common its sound.
"""

from __future__ import annotations

import functools
import io
import itertools
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Seconds of a frame and between frames; the band that is heard.
FRAME, HOP, BAND = 0.256, 0.064, (100.0, 1900.0)
#: Samples a second that a recording may have.
RATES = (1_000, 400_000)
#: (kind, first pitch class, pitch classes, frames): halves one above the other, halves in turn, or the middle against the sides.
FILTERS = (
    (0, 0, 12, 4), (0, 0, 6, 4), (0, 6, 6, 4), (0, 3, 6, 4), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 0, 12, 8),
    (2, 0, 12, 6), (2, 0, 6, 6), (2, 6, 6, 6), (0, 2, 4, 8), (0, 5, 4, 8), (0, 8, 4, 8), (1, 2, 2, 4), (1, 7, 2, 4),
)
WIDTH = max(f[3] for f in FILTERS)
#: A filter's two bits tell which of the four ranges between these its logarithmic ratio is in, in Gray code.
#: The middle one is just above what equal sums give, whatever their rounding.
CUTS = (-0.25, 1e-6, 0.25)
#: Positions that overlap, at least; differing bits, at most. The best of all offsets is often good by chance where few
#: positions overlap, so the bits may differ only in those beyond the first OVERLAP: ERRORS * 32 * (overlap - OVERLAP).
OVERLAP, ERRORS = 16, 0.25
#: Marks: the integers without every fourth filter, which agree if all differing bits are in one of four groups of filters, and two of
#: the groups at two positions LAG apart, which agree if some filters differ throughout. So many marks that agree at one offset make it one to verify.
GROUPS = tuple(sum(3 << 2 * (len(FILTERS) - 1 - f) for f in range(k, len(FILTERS), 4)) for k in range(4))
MARKS = tuple((sum(g), 0) for g in itertools.combinations(GROUPS, 3)) + tuple((sum(g), 1) for g in itertools.combinations(GROUPS, 2))
LAG, VOTES = 8, 6
#: Integers of the recordings that are sent together to be compared; numbers that a step of comparing holds at once.
PACK, HELD = 250_000, 1_000_000


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) and rate of a 16-bit PCM file; none for a null or what is no such file.

    A file that is cut off, or whose header promises more than there is, gives the whole samples that it has.
    """
    none = np.empty(0), 8000
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            rate, channels = f.getframerate(), f.getnchannels()
            if f.getsampwidth() != 2 or channels < 1 or not RATES[0] <= rate <= RATES[1]:
                return none
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError, ZeroDivisionError, OverflowError, MemoryError):
        return none
    whole = len(raw) // (2 * channels) * 2 * channels
    return np.frombuffer(raw[:whole], "<i2").reshape(-1, channels).mean(axis=1) / 32768, rate


@functools.lru_cache(maxsize=16)
def _bins(rate: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    size, hop = int(FRAME * rate), int(HOP * rate)
    hertz = np.fft.rfftfreq(size, 1 / rate)
    heard = np.flatnonzero((hertz >= BAND[0]) & (hertz <= min(BAND[1], rate / 2)))
    classes = np.zeros((len(heard), 12))
    classes[np.arange(len(heard)), np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return size, hop, heard, classes


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energies of the twelve pitch classes by frame, each frame's sum 1 (an even spread in silence)."""
    size, hop, heard, classes = _bins(rate)
    if len(samples) < size:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    out = np.empty((len(frames), 12))
    for at in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[at : at + 512] * np.hanning(size), axis=1)[:, heard]) ** 2
        out[at : at + 512] = power @ classes
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1 / 12)


def packed(energies: np.ndarray) -> np.ndarray:
    """One 32-bit integer, two bits of each filter, for each position that all filters fit at."""
    n = len(energies) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(energies) + 1, 13))
    image[1:, 1:] = energies.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, first, pitches, frames in FILTERS:
        last, half, mid = first + pitches, first + pitches // 2, frames // 2
        if kind == 0:
            a, b = area(0, frames, first, half), area(0, frames, half, last)
        elif kind == 1:
            a, b = area(0, mid, first, last), area(mid, frames, first, last)
            if pitches == 12:  # all energies of a frame sum to one: its upper and lower halves are crossed instead
                a, b = area(0, mid, first, half) + area(mid, frames, half, last), area(0, mid, half, last) + area(mid, frames, first, half)
        else:
            third = frames // 3
            a = area(third, 2 * third, first, half) + area(0, third, half, last)
            b = area(0, third, first, half) + area(third, 2 * third, half, last)
        step = np.searchsorted(CUTS, np.log((a + 0.01) / (b + 0.01))).astype(np.uint32)
        out = out << np.uint32(2) | (step ^ step >> np.uint32(1))
    return out


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    return packed(chroma(samples, rate))


def fingerprints(rows: DataFrame, id_col: str, media_col: str, decode: Callable = read_wav) -> DataFrame:
    """``id_col`` and codes (array<int>, the bits of unsigned integers) for every row.

    ``decode`` makes samples and a rate of a value of ``media_col``. Nulls, what can't be read and what is shorter
    than the filters have no codes. Other columns are left out, whatever their names.
    """
    id_type = rows.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                batch = whole.slice(first, 200)
                codes = [fingerprint(*decode(v.as_py())).view(np.int32) for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32()))], names=[id_col, "codes"])

    return rows.select(F.col(id_col), F.col(media_col)).mapInArrow(of, f"`{id_col}` {id_type}, codes array<int>")


def allowed(overlap: np.ndarray) -> np.ndarray:
    """Differing bits of a match, at most, by the positions that overlap; below none for fewer than OVERLAP."""
    return np.floor(ERRORS * 32 * (np.asarray(overlap) - OVERLAP)).astype(np.int64)


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours in runs whose sizes sum to ``most`` or less; a larger one is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one start after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _marks(codes: np.ndarray, at: np.ndarray, mask: int, lagged: int) -> np.ndarray:
    own = codes[at] & np.uint32(mask)
    return own.astype(np.uint64) << np.uint64(32) | codes[at + LAG] & np.uint32(mask) if lagged else own


class _Index:
    """Recordings laid end to end, and for each mask their positions in the order of the masked integers."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        self.flat = np.concatenate(codes).astype(np.uint32)
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.own = np.repeat(np.arange(len(codes)), self.lengths)
        room = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(len(self.flat))
        self.sorted = []
        for mask, lagged in MARKS:
            at = np.flatnonzero(room > LAG * lagged)
            marks = _marks(self.flat, at, mask, lagged)
            order = np.argsort(marks, kind="stable")
            self.sorted.append((marks[order], at[order]))
        self.at = np.concatenate([at for _, at in self.sorted])
        self.based = (-1, self.at)

    def base(self, n: int) -> np.ndarray:
        """For each mark in order, the first of its bins with a query of ``n`` positions."""
        if self.based[0] != n:
            self.based = n, self.at + n * self.own[self.at]
        return self.based[1]

    def offsets(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(recording, shift) where at least VOTES marks of both agree: a histogram of all offsets of all recordings."""
        n, bins = len(query), len(self.flat) + len(self.lengths) * len(query)  # n bins more than positions for each
        low, count, back, done = [], [], [], 0
        for (mask, lagged), (marks, _) in zip(MARKS, self.sorted):
            own = np.arange(n - LAG * lagged)
            asked = _marks(query, own, mask, lagged)
            first = np.searchsorted(marks, asked, "left")
            count.append(np.searchsorted(marks, asked, "right") - first)
            low.append(first + done)
            back.append(n - 1 - own)
            done += len(marks)
        low, count, back = np.concatenate(low), np.concatenate(count), np.concatenate(back)
        votes = np.zeros(0, np.int64)
        for run in _runs(count, HELD):
            more = np.bincount(self.base(n)[_flat(low[run], count[run])] + np.repeat(back[run], count[run]), minlength=bins)
            votes = votes + more if len(votes) else more
        bins = np.flatnonzero(votes >= VOTES)
        firsts = self.starts + n * np.arange(len(self.lengths))
        found = np.searchsorted(firsts, bins, "right") - 1
        return found, bins - firsts[found] - (n - 1)

    def verified(self, query: np.ndarray, found: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
        """(recording, shift, overlap, bits) of those offsets at which the differing bits allow a match."""
        first = np.maximum(-shift, 0)
        overlap = np.minimum(len(query), self.lengths[found] - shift) - first
        out = []
        enough = np.flatnonzero(overlap >= OVERLAP)
        for run in _runs(overlap[enough], HELD):
            some = enough[run]
            over = overlap[some]
            ours, theirs = _flat(first[some], over), _flat(self.starts[found[some]] + first[some] + shift[some], over)
            bits = np.add.reduceat(np.bitwise_count(query[ours] ^ self.flat[theirs]), np.cumsum(over) - over, dtype=np.int64)
            good = bits <= allowed(over)
            out.append((found[some][good], shift[some][good], over[good], bits[good]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def aligned(first: list[np.ndarray], second: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(i, j, shift, overlap, bits) of the pairs that match at some offset, at the one of the least share of bits (then the least).

    Each of ``first`` votes for offsets of all ``second``, and every offset with VOTES votes is verified by all its bits.
    """
    asked = [i for i, c in enumerate(first) if len(c) >= OVERLAP]
    others = np.array([j for j, c in enumerate(second) if len(c) >= OVERLAP], np.int64)
    longest = max((len(first[i]) for i in asked), default=0)
    found: list[tuple[np.ndarray, ...]] = []
    for run in _runs(np.array([len(second[j]) + longest for j in others], np.int64), HELD) if asked else ():
        to = others[run]
        index = _Index([second[j] for j in to])
        for i in asked:
            query = first[i].astype(np.uint32)
            j, shift, over, bits = index.verified(query, *index.offsets(query))
            found.append((np.full(len(j), i), to[j], shift, over, bits))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    i, j, shift, over, bits = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((shift, bits / np.maximum(over, 1), j, i))
    i, j, shift, over, bits = (x[order] for x in (i, j, shift, over, bits))
    top = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)])
    return i[top], j[top], shift[top], over[top], bits[top]


def _packs(prints: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(number, recordings): the rows of ``prints`` (rep, codes) in packs of about PACK integers."""
    total = prints.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    number = F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-total // PACK))))
    return prints.groupBy(number.alias(names[0])).agg(F.collect_list(F.struct("rep", "codes")).alias(names[1]))


def _matches(named: DataFrame) -> DataFrame:
    """(q, rep, shift, errors): each recording with ``asks`` and each other one that it matches."""
    id_type = named.schema["rep"].dataType.simpleString()
    asked = written(_packs(named.where("asks").select("rep", "codes"), ("a", "asked")), "asked")
    others = written(_packs(named.select("rep", "codes"), ("b", "others")), "others")

    def of(pair: pa.Table) -> pa.Table:
        sides = [pair.column(c).combine_chunks().flatten() for c in ("asked", "others")]
        ids = [side.field("rep") for side in sides]
        codes = []
        for side in sides:
            lists = side.field("codes")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint32)
            codes.append([flat[x:y] for x, y in zip(ends[:-1], ends[1:])])
        i, j, shift, overlap, bits = aligned(*codes)
        return pa.table([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(shift.astype(np.int32)), pa.array(bits / (32 * np.maximum(overlap, 1)))], names=["q", "rep", "shift", "errors"])

    pairs = asked.crossJoin(others).groupBy("a", "b").applyInArrow(of, f"q {id_type}, rep {id_type}, shift int, errors double")
    return pairs.where("q <> rep")


def search(prints: DataFrame, id_col: str, is_query: Column) -> DataFrame:
    """One row for each row of ``prints`` (id, codes): its class and, for queries, what they match.

    Recordings with the same codes are a class, named by the least id; those without codes are classes of their own
    and match nothing. The representatives of the queries' classes vote for offsets of all representatives: n_matches other
    classes match, best_match (least differing bits; then the least id) at best_offset, with best_errors. Repeated
    rows come out as often as they went in. A null id stays in its class and is no query, and a class that has no other id isn't searched for.
    """
    rows = written(prints.select(F.col(id_col).alias("id"), "codes", F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256).alias("same"), F.coalesce(is_query, F.lit(False)).alias("asks")), "prints")
    some = F.size("codes") > 0
    classes = written(rows.where(some).groupBy("same").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"), F.first("codes").alias("codes")), "classes")
    named = classes.where("rep is not null")
    hits = _matches(named)
    top = hits.groupBy("q").agg(F.count("*").alias("n_matches"), F.min(F.struct("errors", "rep", "shift")).alias("best"))
    of_class = classes.join(top, classes["rep"] == top["q"], "left").select(F.col("same").alias("of"), "rep", "n_matches", "best")
    out = rows.where(some).join(of_class, rows["same"] == of_class["of"])
    plain = rows.where(~some).select("id", "codes", "asks", F.col("id").alias("class_id"), F.lit(None).cast("bigint").alias("n_matches"), F.lit(None).cast(top.schema["best"].dataType).alias("best"))
    both = out.select("id", "codes", "asks", F.col("rep").alias("class_id"), "n_matches", "best").unionByName(plain)
    asks = F.col("asks")
    return both.select(
        F.col("id").alias(id_col),
        F.size("codes").cast("bigint").alias("n_codes"),
        F.crc32(F.array_join(F.col("codes").cast("array<string>"), ",").cast("binary")).alias("codes_crc32"),
        "class_id",
        asks.alias("is_query"),
        F.when(asks, F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        F.when(asks, F.col("best.rep")).alias("best_match"),
        F.when(asks, F.col("best.shift")).alias("best_offset"),
        F.when(asks, F.col("best.errors")).alias("best_errors"),
    )


def tune(values: list[float] | None) -> bytes | None:
    """A vector as a recording, for want of others: a note for each value, two frames long, higher for larger ones."""
    if not values:
        return None
    rate, length = 4000, 512
    steps = np.clip(np.nan_to_num(np.array(values, float)) * 40 + 12, 0, 23).astype(int)
    phase = np.cumsum(np.repeat(2 * np.pi * 220 * 2 ** (steps / 12) / rate, length))
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.sin(phase) * 20000).astype("<i2").tobytes())
    return data.getvalue()


def read_tune(values: list[float] | None) -> tuple[np.ndarray, int]:
    return read_wav(tune(values))
