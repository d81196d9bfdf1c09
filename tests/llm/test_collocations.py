import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattisect import store
from lattisect.llm import collocations


def brute(rows, least, top, longest=5):
    """The rows of ``ranked``, in plain Python."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    some = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    hidden = set()
    for p, b in some.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i : i + k])
                if 100 * b >= 100 * some[inner]:
                    hidden.add(inner)
    out = []
    for lang in total:
        scores = []
        for p, a in some.items():
            if p[0] == lang and p not in hidden:
                score, _, l, r = min((1000 * a * total[lang] // (counts[p[: k + 1]] * counts[(lang, *p[k + 1 :])]), k, counts[p[: k + 1]], counts[(lang, *p[k + 1 :])]) for k in range(1, len(p) - 1))
                scores.append((-score, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, i, s[2].decode(), -s[1], s[3], s[4], total[lang], -s[0]) for i, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def sentences(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "été", "É", "x'y", "😀", "d-e"]
    common = ["new york city", "a b c d e f g", "to be", "la la la la la la la"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", ".", "\n", ",\t", " ", "!?"]) for _ in range(n))


@pytest.mark.parametrize("size", [40, 1000, 10**6])
def test_against_plain_counts(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), sentences(rng.randrange(40), i)) for i in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({"shard": F.lit(1), "words": F.lit("x"), "name": F.lit(2), "n": F.lit(3)})
    got = sorted(tuple(r) for r in collocations.ranked(df, least=5, top=30, size=size).collect())
    assert got == brute(rows, 5, 30)
    assert len(got) > 60


def test_odd_rows(spark):
    long = "of the " * 3000
    rows = [("en", None), ("en", ""), ("en", " \t.,"), (None, "A a. A a! a A\x0ba a"), ("en", long), ("en", "x" * 100_000 + " y"), ("\x00", "p\x00 q"), ("de", "to be"), ("de", "to be")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.ranked(df, least=2).collect()) == brute(rows, 2, 2000)
    assert collocations.ranked(df.limit(0)).count() == 0 == collocations.ranked(df, least=10**6).count()


def test_texts_are_cut_between_pieces(monkeypatch):
    text = "one two. three\nfour five six, seven" * 9
    monkeypatch.setattr(collocations, "STEP", 10)
    parts = list(collocations._stretches(text))
    assert len(parts) > 9 and all(p[-1] == b"." for p in parts)
    flat = [w for p in parts for w in p]
    monkeypatch.setattr(collocations, "STEP", 10**6)
    assert [flat] == list(collocations._stretches(text))


def test_exchanges_where_phrases_are_too_many_to_send(spark, monkeypatch):
    rows = [("en", sentences(30, i)) for i in range(40)]
    monkeypatch.setattr(collocations, "SENT", 0)
    got = sorted(tuple(r) for r in collocations.ranked(spark.createDataFrame(rows, "lang string, text string"), least=4, size=100).collect())
    assert got == brute(rows, 4, 2000)


def test_changes_to_exchanges_at_any_length(spark, monkeypatch):
    """The first lengths are told to the tasks, and from the one on that has too many phrases they are joined."""
    rows = [("en", sentences(30, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    sizes = [level.count() for level in collocations.phrases(df, least=4, size=100)[0]]
    assert sizes[0] < sizes[1] < sizes[2] or sizes[1] > max(sizes[0], sizes[2])
    told = []
    monkeypatch.setattr(collocations, "_enumerated", lambda indexed, tables, f=collocations._enumerated: (told.append(len(tables)), f(indexed, tables))[1])
    for sent in {24 * sizes[0], 24 * max(sizes[:2])} - ({24 * max(sizes)}):
        monkeypatch.setattr(collocations, "SENT", sent)
        told.clear()
        assert sorted(tuple(r) for r in collocations.ranked(df, least=4, size=100).collect()) == brute(rows, 4, 2000)
        assert told == ([1] if sent < 24 * sizes[1] else [1, 2])


def test_scores_beyond_64_bits(spark):
    n = 10**13
    level = spark.createDataFrame([(1, "en", "a", "a", 3 * 10**11, [3 * 10**11], [3 * 10**11], None, None)], "name bigint, lang string, phrase string, last string, f bigint, starts array<bigint>, ends array<bigint>, p bigint, s bigint")
    pair = spark.createDataFrame([(2, "en", "a b", "b", 10**11, [3 * 10**11, 10**11], [7 * 10**11, 10**11], 1, 1)], level.schema)
    row = collocations.scored([level, pair], spark.createDataFrame([("en", n)], "lang string, n bigint")).first()
    assert row.score == 1000 * 10**11 * n // (3 * 10**11 * 7 * 10**11) and dict(zip(row.__fields__, row))["l"] == 3 * 10**11


def test_intervals_in_both_orders():
    """Each phrase's intervals hold its places, in the order by first words and in that by last words."""
    rng = np.random.default_rng(3)
    seq = np.append(0, rng.integers(0, 5, 400)).astype(np.int32)
    after = collocations.transformed(seq)
    index = collocations.Index(after)
    n, k = len(seq), 1
    ring = np.concatenate([seq, seq, seq]).tolist()
    by_first = sorted(ring[i : i + 6] for i in range(n))
    by_last = sorted(ring[n + i : n + i - 4 : -1] for i in range(n))
    known = {(w,): v for w, *v in zip(range(1, 5), *[x.tolist() for x in collocations._first(index, np.arange(1, 5))])}
    while True:
        for p, (first, last, size) in known.items():
            assert [i for i, x in enumerate(by_first) if tuple(x[:k]) == p] == list(range(first, first + size))
            if k <= 4:
                assert [i for i, x in enumerate(by_last) if tuple(x[k - 1 :: -1]) == p] == list(range(last, last + size))
        if k == 5:
            break
        phrases = sorted(known)
        of, first, last, size = index.extended(*(np.array([known[p][i] for p in phrases]) for i in range(3)))
        word = [by_first[f][k] for f in first]
        known = {(*phrases[o], w): (f, l, s) for o, w, f, l, s in zip(of, word, first, last, size)}
        k += 1
        assert {p for p in known} == {tuple(ring[i : i + k]) for i in range(n) if 0 not in ring[i : i + k]}


def test_row_groups_hold_few_shards(spark, monkeypatch):
    """A reader's batch is as long as a row group: a file of many shards isn't read, or buffered by its writer, at once."""
    groups: dict[str, list[int]] = {}

    def spied(df, name, *more):
        table = store.written(df, name, *more)
        for file in table.inputFiles():
            made = pq.ParquetFile(file.removeprefix("file://")).metadata
            groups.setdefault(name, []).extend(made.row_group(i).num_rows for i in range(made.num_row_groups))
        return table

    monkeypatch.setattr(collocations, "written", spied)
    docs = spark.createDataFrame([(f"x{i % 3} y z. y z w{i % 5}", "de") for i in range(400)], "text string, lang string").coalesce(1)
    collocations.phrases(docs, least=20, size=100)
    for name in ("shards", "index"):
        assert sum(groups[name]) > 3 * collocations.ROWS and max(groups[name]) <= collocations.ROWS
