"""Quality rules as a cascade: the rule that rejects most per unit of cost is asked first.

Cost and selectivity of every rule are estimated on a bounded sample; the order decides only how much
work is done, never the verdict, since a text is kept if no rule rejects it. Spark functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: The sample on which rules are ordered has at most so many rows, of at most so many bytes each; each is judged REPEATS times.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 20_000
REPEATS = 10
#: Of so large a part of the first rows that hold the sample, it is drawn.
SAMPLE_SHARE = 0.05
WINDOW = 8


class Measures:
    """What rules are written in, as columns: of a text and its words, or by ``bound``, of columns that are there already."""

    def __init__(self, text: Column, all_words: Column) -> None:
        self.text, self.words = F.coalesce(text, F.lit("")), all_words

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(r"[#*$%&|<>]")).cast("long")

    @property
    def lines(self) -> Column:
        """Lines with a word (``all``), and how many of them differ (``own``)."""
        count = lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own"))
        return let(F.filter(F.split(self.text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), count)

    @property
    def n_repeat_words(self) -> Column:
        return _repeated_words(self.words)

    def count(self, pattern: str) -> Column:
        return F.regexp_count(self.text, F.lit(pattern))


class Bound(Measures):
    """The measures as the columns of ``measured``."""

    def __init__(self) -> None:
        super().__init__(F.col("__text"), F.col("__words"))

    n_words = property(lambda self: F.col("n_words"))
    word_chars = property(lambda self: F.col("word_chars"))
    n_symbols = property(lambda self: F.col("n_symbols"))
    lines = property(lambda self: F.col("__lines"))
    n_repeat_words = property(lambda self: F.col("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``rejects`` is true."""

    name: str
    rejects: Callable[[Measures], Column]


def _repeated_words(all_words: Column) -> Column:
    """How many words stand in an 8-word window that is found twice or more in the text, first included.

    Windows are compared by a 64-bit hash of the hashes of their words. A hash set tells whether any
    are equal; only then are they sorted with their places, and the words under them counted.
    """

    def of_windows(hashes: Column) -> Column:
        none = F.lit(0).cast("long")
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_covered(hashes))

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        firsts = F.sequence(F.lit(1), n - (WINDOW - 1))
        return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(firsts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), of_windows))

    return let(F.transform(all_words, lambda w: F.xxhash64(w)), of_hashes)


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs at least twice."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k, j: x["h"] == s[j]["h"]
        twice = F.filter(s, lambda x, k: F.when(k > 0, same(x, k, k - 1)).otherwise(False) | F.when(k < last, same(x, k, k + 1)).otherwise(False))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return (F.aggregate(steps, F.lit(0), lambda a, x: a + x) + WINDOW).cast("long")

    return let(let(placed, starts), count)


def measured(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the text as ``__text``, its words as ``__words`` and what the rules are written in, for every row.

    Null texts count as empty: no words, no lines. Columns of ``docs`` that are not in ``keep`` are
    left out, so their names cannot clash.
    """
    base = docs.select(*keep, F.col(text_col).alias("__text"), words(F.col(text_col)).alias("__words"))
    m = Measures(F.col("__text"), F.col("__words"))
    return base.select(
        *keep,
        "__text",
        "__words",
        m.n_words.alias("n_words"),
        m.word_chars.alias("word_chars"),
        m.n_symbols.alias("n_symbols"),
        m.lines.alias("__lines"),
        m.n_repeat_words.alias("n_repeat_words"),
    ).withColumn("n_dup_lines", F.col("__lines.all") - F.col("__lines.own"))


#: The base rules: the contract has them fail whatever the others say.
BASE = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
#: Asked beside the base rules. Each is about junk that runs through a text: tables and symbol noise,
#: shouting, text without letters, boilerplate lines, words said again and again.
RULES = (
    Rule("symbols", lambda m: 100 * m.n_symbols > 25 * m.n_words),
    Rule("word_length", lambda m: (m.word_chars > 20 * m.n_words) | (m.word_chars < 2 * m.n_words)),
    Rule("lines", lambda m: let(m.lines, lambda x: (x["all"] >= 4) & (100 * (x["all"] - x["own"]) > 50 * x["all"]))),
    Rule("stutter", lambda m: 100 * F.size(F.filter(F.zip_with(F.slice(m.words, 2, F.size(m.words)), m.words, lambda b, a: a == b), lambda x: x)) > 30 * m.n_words),
    Rule("shouting", lambda m: 100 * m.count("[A-Z]") > 50 * m.word_chars),
    Rule("exclaims", lambda m: 100 * m.count("[!?]") > 30 * m.n_words),
    Rule("letters", lambda m: 100 * m.count(r"[\p{L}]") < 50 * m.word_chars),
)


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules``, by rejections per second on at most ``sample_rows`` sampled rows of ``docs``, best first.

    Each rule is timed alone on the words and texts of the sample, with all that it measures, less what a constant takes.
    Only the sample reaches the driver, SAMPLE_ROWS * SAMPLE_BYTES bytes at most, and only as many partitions are read as hold it:
    texts longer than SAMPLE_BYTES aren't timed, which changes no verdict. Ties and an empty sample keep the order given.
    """
    if len(rules) < 2:
        return list(rules)
    text = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_BYTES))
    texts = text.sample(SAMPLE_SHARE, seed=1).limit(sample_rows).collect() or text.limit(sample_rows).collect()
    if not texts:
        return list(rules)
    some = docs.sparkSession.createDataFrame(texts, "text string").select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    sample = some.select("text", words(F.col("text")).alias("words")).persist()
    m = Measures(F.col("text"), F.col("words"))
    try:

        def timed(test: Column) -> tuple[float, int]:
            took, n = [], 0
            for _ in range(2):
                began = time.perf_counter()
                n = sample.agg(F.count(F.when(test, 1))).first()[0]
                took.append(time.perf_counter() - began)
            return took[-1], n  # the first run compiles the code

        idle, _ = timed(F.size("words") < -1)
        figures = [timed(r.rejects(m)) for r in rules]
    finally:
        sample.unpersist()
    rate = [-n / max(took - idle, 1e-3) for took, n in figures]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (rate[i], i))]


def cascade(rules: Sequence[Rule], m: Measures) -> Column:
    """The first rule that rejects, or null: one CASE, of which no later branch is evaluated once one holds."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(m), rule.name) if out is None else out.when(rule.rejects(m), rule.name)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``measured`` and ``base_failed``, ``rejected_by`` (``base``, or the first rule that rejects, or null) and ``kept``.

    All measures are results here, so the order of the rules saves what they need beside them. ``passed`` measures no
    more than it takes to reject.
    """
    rows = measured(docs, text_col, keep)
    m = Bound()
    failed = BASE[0].rejects(m)
    for rule in BASE[1:]:
        failed = failed | rule.rejects(m)
    verdict = cascade(order_rules(docs, rules, text_col, sample_rows), m)
    return (
        rows.withColumn("base_failed", failed)
        .withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(verdict))
        .withColumn("kept", F.col("rejected_by").isNull())
    )


def passed(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = (*BASE, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that a rule rejects; all columns stay, whatever their names, and null texts count as empty.

    A text is cut into words once, and the cascade is one expression over it: what a rule measures isn't measured for
    texts that an earlier one rejects.
    """
    order = order_rules(docs, rules, text_col, sample_rows)
    text = F.col(f"`{text_col}`")
    return docs.where(let(words(text), lambda w: cascade(order, Measures(text, w))).isNull())
