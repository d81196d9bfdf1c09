"""URL filters: rules by host and path, and for the rest a ratio of two character models.

Two smoothed variable-order Markov models are fitted, on all different URLs that the rules accept and on all those they reject.
A URL that no rule fits is judged by the difference of its log-likelihoods under the two, divided by its length,
against a threshold calibrated on a fifth of these URLs that the models have not seen.

A gram is a byte, or the end, with the bytes before it, as a whole number to the base 257. Grams are counted by Spark, and the ratio for each
gram that is asked for is found in groups of two last bytes of context: all longer contexts of these are in the group, and the
shorter ones are a table of bounded size. URLs meet the ratios by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: For ``fitted``: so many different URLs of each class at most, so many of their bytes, and none with more bytes than the last.
SAMPLE_URLS, SAMPLE_BYTES, LONGEST = 4000, 400_000, 8192
ORDER = 4
#: Every so-manieth URL, by hash, is kept for calibration.
HELD_OUT = 5
#: Symbols and one: the base of the numbers of grams, and the end's symbol.
BASE, END = 257, 256
#: Scores that the threshold isn't looked for between: two that round to the same multiple.
SAME = 1e-4
#: Ratios that every worker has, at most.
SENT = 500_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and all its subdomains, where the path starts with the rule's: ``example.com/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


class CharModel:
    """Bytes given the ``order`` bytes before them; each order is smoothed by the next lower one (Witten-Bell), the lowest by
    an even chance for 256 bytes and the end."""

    def __init__(self, urls: Sequence[bytes], order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}
        for url in urls:
            for at in range(len(url) + 1):
                symbol = url[at] if at < len(url) else 256
                for k in range(min(order, at) + 1):
                    own = self.counts.setdefault(url[at - k : at], {})
                    own[symbol] = own.get(symbol, 0) + 1
        self.totals = {c: sum(own.values()) for c, own in self.counts.items()}

    def chance(self, context: bytes, symbol: int) -> float:
        p = 1 / 257
        for k in range(len(context) + 1):
            own = self.counts.get(context[len(context) - k :] if k else b"")
            if own is None:
                break
            p = (own.get(symbol, 0) + len(own) * p) / (self.totals[context[len(context) - k :] if k else b""] + len(own))
        return p


class RatioModel:
    """The length-normalised difference of log-likelihoods of a URL under two models, and the threshold below which it is blocked."""

    def __init__(self, allowed: Sequence[bytes], blocked: Sequence[bytes], order: int = ORDER) -> None:
        split = lambda urls, held: [u for i, u in enumerate(urls) if (i % HELD_OUT == 0) == held]
        self.order = order
        self.seen: dict[bytes, float] = {}
        self.models = (CharModel(split(allowed, False) or allowed, order), CharModel(split(blocked, False) or blocked, order))
        self.threshold = self._calibrated([self.score(u) for u in split(allowed, True)], [self.score(u) for u in split(blocked, True)])

    def _step(self, gram: bytes, symbol: int) -> float:
        return math.log(self.models[0].chance(gram, symbol)) - math.log(self.models[1].chance(gram, symbol))

    def score(self, url: bytes) -> float:
        total, order, seen = 0.0, self.order, self.seen
        if len(seen) > 300_000:
            seen.clear()
        for at in range(len(url)):
            gram = url[max(0, at - order) : at + 1] if at >= order else b"^" + url[: at + 1]
            step = seen.get(gram)
            if step is None:
                step = seen[gram] = self._step(url[max(0, at - order) : at], url[at])
            total += step
        total += self._step(url[max(0, len(url) - order) :], 256)
        return total / (len(url) + 1)

    @staticmethod
    def _calibrated(allowed: list[float], blocked: list[float]) -> float:
        """The threshold with the most right verdicts, classes weighted alike; of equal ones the lowest."""
        if not allowed or not blocked:
            return 0.0
        marks = sorted([(s, 1 / len(blocked)) for s in blocked] + [(s, -1 / len(allowed)) for s in allowed])
        best, at, sum_ = 0.0, marks[0][0], 0.0
        for i, (score, gain) in enumerate(marks):
            sum_ += gain
            after = marks[i + 1][0] if i + 1 < len(marks) else score + 1.0
            if after > score and sum_ > best + 1e-12:
                best, at = sum_, (score + after) / 2
        return at


def parted(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def by_rules(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, or null) and rule_verdict, in place of columns of these names."""
    host, path = parted(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def fitted(judged: DataFrame, url_col: str = "url") -> RatioModel | None:
    """The models in one process, for a look at them; ``filtered`` learns from all URLs. On a sample of those that rules have judged: the first of the different ones in order of their hashes.

    URLs of more than LONGEST bytes aren't sampled. None if either class is empty. Hashes are even, so only a share of a class is made distinct and
    sorted, which grows while repeated URLs leave it short of the sample.
    """
    some = judged.where(F.col("rule_verdict").isNotNull() & (F.octet_length(url_col) <= LONGEST)).select("rule_verdict", F.xxhash64(url_col).alias("h"), F.col(url_col).alias("u"))
    sizes = dict(some.groupBy("rule_verdict").count().collect())
    samples = []
    for verdict in ("allow", "block"):
        own, share = some.where(F.col("rule_verdict") == verdict), min(1.0, 4 * SAMPLE_URLS / max(1, sizes.get(verdict, 0)))
        while True:
            rows = own.where(F.col("h") <= int(share * 2**64) - 2**63 - 1).select("h", "u").distinct().orderBy("h", "u").limit(SAMPLE_URLS).collect()
            if len(rows) == SAMPLE_URLS or share == 1.0:
                break
            share = min(1.0, 8 * share)
        sample, left = [], SAMPLE_BYTES
        for r in rows:
            u = r["u"].encode("utf-8", "replace")
            if len(u) <= left:
                sample.append(u)
                left -= len(u)
        samples.append(sample)
    return RatioModel(*samples) if all(samples) else None


def grams_of(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the grams of all URLs end to end, symbols of each URL): each byte and then the end, after up to ``order`` bytes."""
    lengths = np.array([len(u) for u in urls], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbol = np.full(int(lengths.sum()) + len(urls), END, np.int64)
    inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(urls)), lengths)
    symbol[inside] = np.frombuffer(b"".join(urls), np.uint8)
    at = np.arange(len(symbol)) - np.repeat(starts, lengths + 1)
    gram = symbol.copy()
    for j in range(1, order + 1):
        before = np.zeros_like(symbol)
        before[j:] = symbol[:-j] + 1
        gram += np.where(at >= j, before, 0) * BASE**j
    return gram, lengths + 1


class Orders:
    """Counts of symbols after contexts of some lengths, by sorted numbers, made of the counts of grams; as ``CharModel`` has them."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, orders: range = range(ORDER + 1)):
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for k in orders:
            long = grams // BASE**k > 0 if k else np.ones(len(grams), bool)
            self.add(k, *_summed(grams[long] % BASE ** (k + 1), n[long]))

    def add(self, k: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """The counts of all symbols after contexts of ``k`` bytes."""
        contexts, total = _summed(keys // BASE, counts)
        self.tables[k] = keys, counts, contexts, total, _summed(keys // BASE, np.ones(len(keys), np.int64))[1]

    def chances(self, grams: np.ndarray) -> np.ndarray:
        p, known = np.full(len(grams), 1 / BASE), np.ones(len(grams), bool)
        for k in range(ORDER + 1):
            keys, counts, contexts, total, kinds = self.tables[k]
            long = grams // BASE**k > 0 if k else known
            own, found = _places(contexts, grams // BASE % BASE**k)
            known = known & long & found
            if not known.any():
                break
            where, seen = _places(keys, grams % BASE ** (k + 1))
            c = np.where(seen, counts[where], 0)
            p = np.where(known, (c + kinds[own] * p) / (total[own] + kinds[own]), p)
        return p


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grams(rows: DataFrame, keys: str) -> DataFrame:
    """(the first columns, named by the schema ``keys``; gram, times) of ``rows`` whose last column is a URL: a row for each different gram of a row's."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                gram, lengths = grams_of([u.encode("utf-8", "replace") for u in batch.column(batch.num_columns - 1).to_pylist()])
                row = np.repeat(np.arange(batch.num_rows), lengths)
                order = np.lexsort((gram, row))
                gram, row = gram[order], row[order]
                at = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                owners = [c.take(pa.array(row[at])) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*owners, pa.array(gram[at]), pa.array(np.diff(at, append=len(gram)))], names=[*batch.schema.names[:-1], "gram", "times"])

    return rows.mapInArrow(of, f"{keys}, gram bigint, times bigint")


def numbered(judged: DataFrame, url_col: str = "url") -> DataFrame:
    """(verdict, u, number, urls) for each different URL that rules have judged: its number by hash among the ``urls`` of its class, from 0."""
    some = judged.where(F.col("rule_verdict").isNotNull()).select(F.col("rule_verdict").alias("verdict"), F.col(url_col).alias("u")).distinct()
    some = written(some.withColumn("h", F.xxhash64("u")).withColumn("part", F.shiftright("h", 52)), "judged")
    sizes = some.groupBy("verdict", "part").agg(F.count("*").alias("n"))  # 4,096 parts of a class at most
    before = Window.partitionBy("verdict").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("verdict", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("verdict")).alias("urls"))
    inside = F.row_number().over(Window.partitionBy("verdict", "part").orderBy("h", "u")) - 1
    return some.withColumn("inside", inside).join(F.broadcast(sizes), ["verdict", "part"]).select("verdict", "u", (F.col("inside") + F.col("before")).alias("number"), "urls")


def ratios(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, rows, step) for each gram of (gram, rows): the difference of its log chances under the models of (verdict, gram, n)."""
    short: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {"allow": {}, "block": {}}
    for k in (0, 1):  # contexts of a byte at most: 66,049 rows of a class
        rows = counts.where(F.col("gram") >= BASE**k) if k else counts
        table = rows.groupBy("verdict", F.pmod("gram", F.lit(BASE ** (k + 1))).alias("key")).agg(F.sum("n").alias("n")).toPandas()
        for v in short:
            own = table[table["verdict"] == v]
            short[v][k] = _summed(own["key"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
    shared = counts.sparkSession.sparkContext.broadcast(short)

    def of(wanted: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        grams = wanted["gram"].to_numpy(np.int64)
        logs = []
        for v in ("allow", "block"):
            own = known[known["verdict"] == v]
            model = Orders(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64), range(2, ORDER + 1))
            for k, table in shared.value[v].items():
                model.add(k, *table)
            logs.append(np.log(model.chances(grams)))
        return wanted[["gram", "rows"]].assign(step=logs[0] - logs[1])

    group = F.floor(F.col("gram") / BASE) % BASE**2
    pair = lambda df: df.withColumn("pair", group.cast("bigint")).groupBy("pair")
    return pair(asked).cogroup(pair(counts)).applyInPandas(lambda a, b: of(a, b), "gram bigint, rows bigint, step double")


def with_steps(grams: DataFrame, steps: DataFrame) -> DataFrame:
    """``grams`` with their steps: workers have those of the grams that most rows hold, and the others, which few do, are joined by an exchange."""
    size = steps.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if size["n"] <= SENT:
        return grams.join(F.broadcast(steps.drop("rows")), "gram")
    often = F.col("rows") * SENT > size["rows"]  # fewer than SENT
    most = steps.where(often).drop("rows")
    rest = grams.join(F.broadcast(most.select("gram")), "gram", "left_anti")
    return grams.join(F.broadcast(most), "gram").unionByName(rest.join(steps.where(~often).drop("rows"), "gram"))


def threshold(scores: DataFrame) -> float:
    """The score below which most of (verdict, score) are rightly blocked, classes weighted alike; of equal ones the lowest. 0 without both classes."""
    bins = scores.groupBy(F.round(F.col("score") / SAME).alias("bin"), "verdict").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    rows = bins.toPandas()  # as many as there are multiples of SAME between the scores, at most
    sizes = rows.groupby("verdict")["n"].sum()
    if len(sizes) < 2:
        return 0.0
    rows["gain"] = rows["n"] / rows["verdict"].map(sizes) * np.where(rows["verdict"] == "block", 1.0, -1.0)
    merged = rows.groupby("bin").agg(gain=("gain", "sum"), low=("low", "min"), high=("high", "max")).sort_index()
    low, high = merged["low"].tolist(), merged["high"].tolist()
    best, at = 0.0, low[0]
    for i, gain in enumerate(merged["gain"].cumsum().tolist()):
        if gain > best + 1e-12:
            best, at = gain, (high[i] + low[i + 1]) / 2 if i + 1 < len(low) else high[i] + 0.5
    return at


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict and score (null where a rule has decided) for every row.

    Null and odd URLs have an empty host and path; no rule fits them, and the models judge the text as it is (a null
    as an empty text). If the rules leave a class without examples, what no rule fits is allowed. Repeated
    rows come out as often as they went in; other columns are left out, whatever their names.
    """
    judged = by_rules(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url", rules)
    labelled = written(numbered(judged, "__url"), "numbered")
    if labelled.select("verdict").distinct().count() < 2:
        score, verdict = F.lit(None).cast("double"), F.coalesce("rule_verdict", F.lit("allow"))
        return judged.withColumn("score", score).select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
    held = F.col("number") % HELD_OUT == 0
    counts = _grams(labelled.where(~held | (F.col("urls") == 1)).select("verdict", "u"), "verdict string")
    counts = written(counts.groupBy("verdict", "gram").agg(F.sum("times").alias("n")), "grams")
    # what is asked for are the rows that no rule fits, and the URLs kept for calibration; each by a number, so that no URL is a key
    none = lambda c: F.lit(None).cast(judged.schema[c].dataType).alias(c)
    open_ = judged.where(F.col("rule").isNull()).select("__id", "host", "path", F.lit(None).cast("string").alias("verdict"), F.coalesce("__url", F.lit("")).alias("u"))
    asked = open_.unionByName(labelled.where(held).select(none("__id"), none("host"), none("path"), "verdict", "u"))
    asked = written(asked.withColumn("url", F.monotonically_increasing_id()), "asked")
    grams = _grams(asked.select("url", "u"), "url bigint")
    steps = written(ratios(counts, grams.groupBy("gram").agg(F.count("*").alias("rows"))), "ratios")
    sums = with_steps(grams, steps).groupBy("url").agg((F.sum(F.col("step") * F.col("times")) / F.sum("times")).alias("score"))
    scored = written(asked.drop("u").join(sums, "url"), "scores")
    least = threshold(scored.where("verdict is not null").select("verdict", "score"))
    found = scored.where("verdict is null").select(F.col("__id").alias(id_col), "host", "path", none("rule"), F.when(F.col("score") < least, "block").otherwise("allow").alias("verdict"), "score")
    decided = judged.where(F.col("rule").isNotNull())
    return decided.select(F.col("__id").alias(id_col), "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(found)
