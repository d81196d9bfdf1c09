"""Positions of regular-expression matches, by Spark functions alone.

Spark returns the matches of a pattern and the pieces between them, and both come from the same
left-to-right search; the positions are running sums of their lengths. All positions are in code
points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, running_sums

#: One span while it is being judged: its rank orders kinds that start together.
SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>> of all leftmost non-overlapping matches of ``pattern``.

    The pattern must not match the empty string.
    """

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
            return let(
                running_sums(steps),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (before[i] + F.length(gaps[i])).alias("start"),
                        (before[i] + F.length(gaps[i]) + F.length(m)).alias("stop"),
                        m.alias("found"),
                    ),
                ),
            )

        empty = F.array().cast("array<struct<start:bigint,stop:bigint,found:string>>")
        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans(
    text: Column,
    kind: str,
    rank: int,
    pattern: str,
    keep: Callable[[Column], Column] | None = None,
    score: Callable[[Column], Column] | None = None,
    guard: Column | None = None,
) -> Column:
    """The matches of one kind as SPAN; ``keep`` sees a match's struct, ``guard`` is a cheap necessary condition."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, keep)
    made = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            m["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            (score(m) if score else F.lit(1.0)).cast("double").alias("score"),
        ),
    ).cast(SPAN)
    return made if guard is None else F.when(guard, made).otherwise(no_spans())


def in_order(parts: Sequence[Column]) -> Column:
    """Spans of several kinds in one array, by start and then by rank."""
    return F.array_sort(F.concat(*parts))


def as_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, found: Column) -> Column:
    """``text`` with each span (in order, as of ``in_order``) replaced by ``[KIND]``; an overlap is cut out once.

    One pass: the pieces kept are cut between the furthest end so far and the next start.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["out"], ""), rest)

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, finish))
