"""Scores of texts by a log-bilinear language model, and by smoothed word counts.

Words of the training text are counted. The most frequent get states of their own; each other word belongs to a state
of words with its last two bytes, or, where that ending is uncommon, to one of all others, and is scored as that state
and then by its share in it. States are dealt into classes of equal size by frequency, so a token's probability is its
class's and its own in the class: both are normalised by matrix products over a batch.

The model is trained by the exact gradient of the log probability, on all training text. Each task takes its text through
minibatches, starting from the parameters of the round before; the changes, weighted by how often a task used a row of
parameters, are averaged by an aggregate over rows.

Counts of the ``HEAD`` most frequent words go to every worker, a bounded table. The rest, which no text holds
often, is joined: one row for each different rare word of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: States of the model, those of endings among them; words of context; length of vectors.
VOCABULARY, ENDINGS, CONTEXT, SIZE = 16_384, 255, 3, 16
#: Tokens of a minibatch, at least and at most: a task has ``STEPS`` of them or more if it can. The rate of learning.
LEAST_BATCH, BATCH, STEPS, RATE = 1024, 32_768, 128, 0.1
#: The training text is dealt into rounds, with an average after each, and goes through them so many times. A task takes
#: about so many tokens.
ROUNDS, PASSES, TASK_TOKENS = 2, 1, 4_000_000
#: Words whose counts every worker has.
HEAD = 150_000
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: The token that ends a text, as a word: no word is empty.
END_WORD = ""


def held_out(id_: Column) -> Column:
    """Whether a row isn't trained on: the CRC-32 of its id as text leaves 2 modulo 7. A null id is trained on."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``, END_WORD once for each row. Counted in each task before they are exchanged."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            counts[b""] += batch.num_rows
            for text in batch.column(0):
                counts.update(_words(text.as_py()))
                if len(counts) > COUNTED:
                    yield out()
        if counts:
            yield out()

    return texts.select("text").mapInArrow(of, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """Words and counts by decreasing count: all words above a count that so leaves ``most`` of them or fewer.

    How many words have each count (rounded, above 4096) tells which; so no task sends more than is kept.
    """
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n") / 4096) * 64)).cast("bigint")
    left, least = most, 1 << 62
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        left -= row["words"]
        if left < 0:
            break
        least = row["step"]
    top = counts.where(step >= least).select("word", "n").toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], np.array([n[i] for i in order], np.int64)


@dataclass
class States:
    """The states of the model by number, most frequent first, and how a word finds its own.

    ``tokens`` counts the training tokens of a state; ``weight`` is the mass of a state of several words: tokens, words, and
    one for what was never seen. It is 0 for a state of one word.
    """

    names: dict[bytes, int]
    endings: dict[bytes, int]
    end: int
    other: int
    tokens: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(names: list[tuple[str, int]], endings: list[tuple[bytes, int, int]], other: tuple[int, int], ends: int) -> States:
        """From words and counts; from endings with their tokens and words; tokens and words of all others; texts."""
        found = [(-ends, 0, b"", 0), (-other[0], 1, b"", other[0] + other[1] + 1)]
        found += [(-n, 2, e, n + v + 1) for e, n, v in endings]
        found += [(-n, 3, w.encode(), 0) for w, n in names]
        found.sort()
        by_kind: list[dict[bytes, int]] = [{}, {}, {}, {}]
        for number, (_, kind, word, _) in enumerate(found):
            by_kind[kind][word] = number
        return States(
            by_kind[3], by_kind[2], by_kind[0][b""], by_kind[1][b""],
            np.array([-f[0] for f in found], np.float64), np.array([f[3] for f in found], np.float64),
        )

    def numbers(self, words: list[bytes]) -> list[int]:
        return self.array(words).tolist()

    def array(self, words: list[bytes]) -> np.ndarray:
        found, ending = np.fromiter(map(self.names.get, words, repeat(-1)), np.int64, len(words)), self.endings.get
        left = np.flatnonzero(found < 0)
        found[left] = [ending(words[k][-2:], self.other) for k in left.tolist()]
        return found


class LogBilinear:
    """Vectors of words before a token, turned by a matrix for each place, meet the vectors of classes and of states.

    All parameters are rows of one matrix, so that rows can be averaged: contexts, states, classes, then the matrices of the places.
    The column after the vector is the row's bias, the last one the sum of squared slopes that slows its learning.
    """

    PART = 1024

    def __init__(self, tokens: np.ndarray, context: int = CONTEXT, size: int = SIZE, seed: int = 5):
        n, self.context, self.size = len(tokens), context, size
        self.width = max(2, int(np.ceil(np.sqrt(n))))
        self.classes = -(-n // self.width)
        v = self.width * self.classes
        self.first_state, self.first_class, self.first_place = v, 2 * v, 2 * v + self.classes
        mass = np.zeros((self.classes, self.width))
        mass.ravel()[:n] = tokens + 1.0
        self.class_share = mass.sum(axis=1) / mass.sum()
        self.share = (mass / mass.sum(axis=1, keepdims=True)).ravel()
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.rows = np.zeros((self.first_place + context * size, size + 2), np.float32)
        self.rows[:v, :size] = rng.normal(0, 0.3, (v, size))
        self.rows[self.first_state : self.first_class, size] = log(self.share)
        self.rows[self.first_class : self.first_place, size] = log(self.class_share)
        for j in range(context):
            self.rows[self.first_place + j * size :][:size, :size] = np.eye(size) / (j + 1)
        self.log_share, self.log_class_share = log(self.share), log(self.class_share)

    def places(self) -> np.ndarray:
        return self.rows[self.first_place :, : self.size].reshape(self.context, self.size, self.size)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The context's vector for each row of the numbers of the words before, nearest first."""
        return sum(self.rows.take(before[:, j], axis=0)[:, : self.size] @ m for j, m in enumerate(self.places()))

    def log10(self, before: np.ndarray, state: np.ndarray, block: int = 65_536) -> np.ndarray:
        """log10 P(state | before), normalised over all classes and over the states of the class.

        A block is sorted by class, so that the tokens of one meet its states together; products are made for ``PART`` tokens at most.
        """
        out = np.empty(len(state))
        classes, states = self.rows[self.first_class : self.first_place], self.rows[self.first_state : self.first_class]
        size, width = self.size, self.width

        largest = [np.sqrt(np.square(x[:, :size]).sum(axis=1).max()) for x in (classes, states)]
        biases = [np.abs(x[x[:, size] > -1e3, size]).max() for x in (classes, states)]
        turned = [np.ascontiguousarray(x[:, : size + 1].T) for x in (classes, *np.split(states, self.classes))]
        room = np.empty((self.PART, max(self.classes, width)), np.float32)
        ones, flat = np.ones(room.shape[1], np.float32), room.ravel()

        def chosen(q: np.ndarray, among: np.ndarray, which: np.ndarray, safe: bool, into: np.ndarray, sums: np.ndarray) -> None:
            n = among.shape[1]
            for at in range(0, len(q), self.PART):
                some = q[at : at + self.PART]
                scores = np.matmul(some, among, out=flat[: len(some) * n].reshape(len(some), n))
                if not safe:
                    scores -= scores.max(axis=1, keepdims=True)
                into[at : at + self.PART] += scores[line[: len(some)], which[at : at + self.PART]]
                sums[at : at + self.PART] *= np.exp(scores, out=scores) @ ones[:n]

        line = np.arange(self.PART)
        for at in range(0, len(state), block):
            here = state[at : at + block]
            order = np.argsort((here // width).astype(np.int16 if self.classes < 1 << 15 else np.int64), kind="stable")
            here = here[order]
            q, group, within = np.ones((len(here), size + 1), np.float32), here // width, here % width  # the one is for the bias
            q[:, :size] = self.predicted(before[at : at + block][order])
            longest = np.sqrt(np.square(q[:, :size]).sum(axis=1).max())
            safe = [longest * r + b < 80 for r, b in zip(largest, biases)]  # no exponential can leave the numbers' range
            picked, sums = np.zeros(len(here)), np.ones(len(here))
            chosen(q, turned[0], group, safe[0], picked, sums)
            for c, start, stop in _runs(group):
                chosen(q[start:stop], turned[1 + c], within[start:stop], safe[1], picked[start:stop], sums[start:stop])
            out[at + order] = picked - np.log(sums)
        return out / np.log(10)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of each run of a sorted array."""
    starts = _starts(values)
    yield from zip(values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)])


class Trainer:
    """Gradient ascent on the log probability, minibatch by minibatch, on a copy of a model; ``used`` counts the uses of each row.

    Slopes are exact: a token's class is told from all classes, and its state from all states of the class. A minibatch is
    sorted by state, so that the tokens of a class meet its states together; products are made for ``part`` tokens at most.
    Each row learns the slower the steeper it has been.
    """

    def __init__(self, model: LogBilinear, part: int = 512):
        self.model, self.part = copy(model), part
        self.model.rows = model.rows.copy()
        self.used = np.zeros(len(model.rows), np.int64)
        self.ones = np.ones(max(model.classes, model.width), np.float32)

    def step(self, before: np.ndarray, state: np.ndarray) -> None:
        """Learns states from those before them, nearest first."""
        flat = np.concatenate([before[:, ::-1], state[:, None]], axis=1)
        self.learn(flat.ravel(), np.arange(1, len(state) + 1) * flat.shape[1] - 1)

    def learn(self, flat: np.ndarray, at: np.ndarray) -> None:
        """Learns the states at the places ``at`` of ``flat``, each from those just before it.

        Slopes have a row's columns, the last one being 0. Those of the tokens after a place are added up before they go to its row.
        """
        m, rows, size, far, length = self.model, self.model.rows, self.model.size, self.model.context, len(flat)
        at = at[self._order(flat[at])]
        state = flat[at]
        group, n = state // m.width, len(at)
        near, places = np.arange(1, far + 1), np.zeros((far, size + 2, size + 2), np.float32)
        places[:, :size, :size] = m.places()
        words = rows.take(flat[at[:, None] - near], axis=0).reshape(n, -1)
        q = words @ places.reshape(-1, size + 2)
        q[:, size] = 1  # for the bias

        classes, states = rows[m.first_class : m.first_place], rows[m.first_state : m.first_class]
        of_classes, of_states, of_places = np.zeros_like(classes), np.zeros_like(states), np.zeros_like(rows[m.first_place :])
        slope_q = classes.take(group, axis=0)
        slope_q += states.take(state, axis=0)
        first = _starts(state)
        here, sums = state[first], np.add.reduceat(q, first)
        of_states[here] = sums
        first = _starts(here // m.width)
        of_classes[here[first] // m.width] = np.add.reduceat(sums, first)
        with np.errstate(over="ignore"):
            self._less_expected(q, classes, slope_q, of_classes)
            for c, start, stop in _runs(group):
                of = slice(c * m.width, (c + 1) * m.width)
                self._less_expected(q[start:stop], states[of], slope_q[start:stop], of_states[of])

        of_places.reshape(far, size, -1)[:, :, :size] = (words.T @ slope_q).reshape(places.shape)[:, :size, :size]
        steep, aims, order = np.zeros((length + far, size + 2), np.float32), np.zeros(length + far, np.int64), self._order(flat)
        steep[at], aims[at] = slope_q, 1
        uses = sum(aims[j : j + length] for j in near)
        of_words = steep.take(order[:, None] + near, axis=0).reshape(length, -1) @ places.transpose(0, 2, 1).reshape(-1, size + 2)
        sorted_flat = flat[order]
        first = _starts(sorted_flat)
        word, sums = sorted_flat[first], np.add.reduceat(of_words, first)
        self.used[: m.first_state] += np.bincount(flat, uses, m.first_state).astype(np.int64)
        self.used[m.first_state : m.first_class] += np.bincount(state, minlength=len(states)) + np.repeat(np.bincount(group, minlength=m.classes) > 0, m.width)
        self.used[m.first_class :] += n
        rows[word] = self._moved(rows.take(word, axis=0), sums)
        for mine, slopes in ((states, of_states), (classes, of_classes), (rows[m.first_place :], of_places)):
            mine[:] = self._moved(mine, slopes)

    def _order(self, states: np.ndarray) -> np.ndarray:
        return np.argsort(states.astype(np.uint16) if self.model.first_state <= 1 << 16 else states, kind="stable")  # by digits where they are few

    def _less_expected(self, q: np.ndarray, among: np.ndarray, slope_q: np.ndarray, slopes: np.ndarray) -> None:
        """Takes what is expected by the probabilities of all rows from the slopes of the contexts and of the rows."""
        for at in range(0, len(q), self.part):
            some = q[at : at + self.part]
            p = some @ among.T
            np.exp(p, out=p)
            sums = p @ self.ones[: len(among)]
            if not (sums.min() > 1e-30 and sums.max() < 1e30):  # an exponential has left the numbers' range
                p = some @ among.T
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                sums = p @ self.ones[: len(among)]
            share = (1 / sums)[:, None]
            slope_q[at : at + self.part] -= (p @ among) * share
            slopes -= p.T @ (some * share)

    @staticmethod
    def _moved(rows: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """The rows moved along their slopes, which it uses up."""
        steep = np.einsum("rc,rc->r", slopes, slopes) / (slopes.shape[1] - 1)
        slopes *= (RATE / np.sqrt(rows[:, -1] + steep + 1e-6))[:, None]
        slopes[:, -1] = steep
        slopes += rows
        return slopes


class _Tokens:
    """Gathers texts as states; gives for all tokens gathered the states before them, nearest first, and their own."""

    def __init__(self, end: int, context: int):
        self.end, self.context = end, context
        self.clear()

    def clear(self) -> None:
        self.flat: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.held = 0

    def add(self, states: list[int] | np.ndarray, lengths: np.ndarray | None = None) -> None:
        """The states of a text, or of texts of these numbers of words, end to end."""
        self.flat.append(np.array(states, np.int64))
        self.lengths.append(np.array([len(states)]) if lengths is None else lengths)
        self.held += len(states) + len(self.lengths[-1])

    def gathered(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.flat), np.concatenate(self.lengths)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.of(*self.gathered())

    def placed(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of these numbers of words, end to end, with ends before and after each; and the places of their tokens."""
        texts = np.arange(len(lengths))
        flat = np.full(len(states) + (self.context + 1) * len(lengths), self.end, np.int64)
        flat[np.arange(len(states)) + np.repeat(self.context + (self.context + 1) * texts, lengths)] = states
        return flat, np.arange(len(states) + len(lengths)) + np.repeat(self.context * (texts + 1), lengths + 1)

    def of(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as of texts gathered for texts of these numbers of words, end to end."""
        flat, at = self.placed(states, lengths)
        before = np.empty((len(at), self.context), np.int64)
        for j in range(self.context):
            before[:, j] = flat[at - (j + 1)]
        return before, flat[at]


def found_states(counts: DataFrame, frequent: list[str], number: np.ndarray, ends: int, vocabulary: int = VOCABULARY, endings: int = ENDINGS) -> States:
    """The states of a model: the most frequent words, the endings that most of the other tokens have, the end, and all others."""
    kept = max(vocabulary - endings - 2, 0)
    names = list(zip(frequent[:kept], number[:kept].tolist()))
    named = counts.sparkSession.createDataFrame([(w,) for w, _ in names], "named string")
    others = counts.where(F.col("word") != END_WORD).join(F.broadcast(named), F.col("word") == F.col("named"), "left_anti")
    tail = F.substring(F.col("word").cast("binary"), -2, 2).alias("ending")
    # two bytes: no more than 65,536 + 256 rows
    rows = others.groupBy(tail).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    rows = sorted(((bytes(r["ending"]), int(r["n"]), int(r["words"])) for r in rows), key=lambda r: (-r[1], r[0]))
    rest = rows[endings:]
    return States.of(names, rows[:endings], (sum(r[1] for r in rest), sum(r[2] for r in rest)), ends)


def trained(texts: DataFrame, states: States, tokens: int, passes: int = PASSES, rounds: int = ROUNDS) -> LogBilinear:
    """A model of the column ``text``, which holds about so many tokens: every text is in one of the rounds.

    A round's tasks start from the same parameters. A row moves by the mean of its changes, each weighted by its uses in the task;
    the sums are Spark's, made in each task before they are exchanged, and the driver gets one line for a row of parameters.
    Without any text the model is the smoothed frequencies.
    """
    context = texts.sparkSession.sparkContext
    model = LogBilinear(states.tokens)
    fields = [f"d{i}" for i in range(model.rows.shape[1])]
    schema = "row int, uses bigint, " + ", ".join(f"{f} float" for f in fields)
    parts = max(1, round(tokens / TASK_TOKENS / rounds))
    size = min(max(tokens // (rounds * parts * STEPS), LEAST_BATCH), BATCH)
    for turn in range(passes * rounds):
        shared = context.broadcast((states, model))

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numbers, start = shared.value
            trainer = Trainer(start)
            held = _Tokens(numbers.end, start.context)

            def learn() -> None:
                flat, places = held.placed(*held.gathered())
                held.clear()
                for at in np.array_split(places, -(-len(places) // size)):
                    first = at[0] - start.context
                    trainer.learn(flat[first : at[-1] + 1], at - first)

            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    lists = [_words(text) for text in batch.column(0).slice(i, 100).to_pylist()]
                    held.add(numbers.array(list(chain.from_iterable(lists))), np.array([len(words) for words in lists], np.int64))
                    if held.held > 200_000:
                        learn()
            if held.held:
                learn()
            at = np.flatnonzero(trainer.used)
            moved = trainer.model.rows[at] - start.rows[at]
            for i in range(0, len(at), 4096):
                columns = [pa.array(c) for c in np.ascontiguousarray(moved[i : i + 4096].T)]
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 4096].astype(np.int32)), pa.array(trainer.used[at[i : i + 4096]]), *columns], names=["row", "uses", *fields])

        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn % rounds) if rounds > 1 else texts
        means = [(F.sum(F.col(f) * F.col("uses")) / F.sum("uses")).cast("float").alias(f) for f in fields]
        found = mine.select("text").coalesce(parts).mapInArrow(of, schema).groupBy("row").agg(*means).toArrow()
        shared.unpersist()
        if found.num_rows:
            model.rows[found.column("row").to_numpy()] += np.stack([found.column(f).to_numpy() for f in fields], axis=1)
    return model


@dataclass
class _Scorer:
    """What a worker needs: frequent words by frequency, their counts, the states and the model."""

    words: list[bytes]
    counts: np.ndarray
    all_tokens: int
    all_words: int
    states: States
    model: LogBilinear

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.all_tokens + self.all_words + 1))

    def ready(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of words, and by number: base score, score of the word in its state, and state. The number after the last
        is that of rare words. Last, by state: what a rare word's score loses to the state's mass."""
        ids = {w: i for i, w in enumerate(self.words)}
        mass = np.log10(np.maximum(self.states.weight, 1))
        state = self.states.array(self.words)
        several = self.states.weight[state] > 0
        own = np.where(several, np.log10(self.counts + 1) - mass[state], 0.0)
        return ids, np.append(self.base(self.counts), 0.0), np.append(own, 0.0), np.append(state, 0), mass


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, head: int = HEAD, endings: int = ENDINGS, passes: int = PASSES) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Tokens are the words, A-Z in lower case, and one end. A null text counts as empty and has the end alone.
    Repeated rows count as often as they stand there, and each gets its scores. With no training text all words
    are unknown. Other columns are left out, whatever their names. A small corpus may need more ``passes``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = texts.where(~F.col("out"))
    counts = written(count_words(training), "counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(totals[0]), int(totals[1])
    frequent, number = most_frequent(counts.where(F.col("word") != END_WORD), head)
    ends = counts.where(F.col("word") == END_WORD).first()
    ends = int(ends["n"]) if ends else 0
    states = found_states(counts, frequent, number, ends, vocabulary, endings)
    scorer = _Scorer([w.encode() for w in frequent], number, n, v, states, trained(training, states, n, passes))
    shared = spark.sparkContext.broadcast(scorer)
    id_type = docs.schema[id_col].dataType.simpleString()
    end_base, end_known = float(scorer.base(np.array(ends))), int(ends > 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids, base, share, state, mass = own.ready()
        rare = len(own.words)
        held = _Tokens(own.states.end, own.model.context)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                lists = [_words(text) for text in batch.column(2).to_pylist()]
                lengths = np.array([len(words) for words in lists], np.int64)
                flat = list(chain.from_iterable(lists))
                at = np.fromiter(map(ids.get, flat, repeat(rare)), np.int64, len(flat))
                row, last = np.repeat(np.arange(len(lists)), lengths), np.flatnonzero(at == rare)
                tail = [flat[k] for k in last.tolist()]
                numbers, of_tail = own.states.array(tail), row[last]
                mine = state[at]
                mine[last] = numbers
                sums = lambda which, x: np.bincount(which, x, len(lists))  # noqa: B023, E731
                outside = sums(row, share[at]) - sums(of_tail, mass[numbers])
                few = np.bincount(of_tail, minlength=len(lists))
                ends_ = np.cumsum(few).tolist()
                left = [Counter(tail[b - n : b]) for b, n in zip(ends_, few.tolist())]
                made = [lengths + 1, lengths - few + end_known, sums(row, base[at]) + end_base, [[w.decode() for w in c] for c in left], [list(c.values()) for c in left]]
                inside = np.add.reduceat(own.model.log10(*held.of(mine, lengths)), np.cumsum(lengths + 1) - lengths - 1)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
                arrays = [pa.array(m, t) for m, t in zip(made, types)]
                arrays.insert(3, pa.array(inside + outside))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "out", "tokens", "known", "base", "score", "rare", "times"])

    schema = f"id {id_type}, out boolean, tokens bigint, known bigint, base double, score double, rare array<string>, times array<bigint>"
    found = texts.mapInArrow(of, schema).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "scored")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("rare"), F.col("r.times").alias("times"))
    joined = rare.join(counts, rare["rare"] == counts["word"], "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    sums = joined.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_score"),
    )
    return found.join(sums, found["row"] == sums["of"], "left").select(
        F.col("id").alias(id_col),
        F.col("out").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
