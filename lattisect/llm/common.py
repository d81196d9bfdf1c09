"""What the text operators share: the folder for intermediate tables, and small column helpers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..store import shared_folder, written

__all__ = ["SPACE", "SPACES", "ascii_lower", "cleaned", "let", "running_sums", "sha256_hex", "shared_folder", "words", "written"]

#: ASCII white space, the separator of words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cleaned(spark: SparkSession) -> None:
    """Removes all that this application has written under ``shared_folder``: once its results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_folder(spark)))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is (``lower`` would change other alphabets too)."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def running_sums(lengths: Column, block: int = 256) -> Column:
    """For an array of numbers, the array of the sums of what stands before each.

    Arrays have no running sum of their own. Appending to an array copies it, so the sums are made
    in blocks, which keeps n entries at about n * (block + n / block**2) steps.
    """
    append = lambda start: lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        firsts = F.aggregate(sums, F.array(F.lit(0).cast("long")), append(0))
        return let(
            firsts,
            lambda at: F.flatten(
                F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(at[i]), append(0)), 1, F.size(b)))
            ),
        )

    def of(items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(items) / F.lit(block)).cast("int") - 1)
        return let(F.transform(starts, lambda c: F.slice(items, c * block + 1, block)), of_blocks)

    return let(
        lengths,
        lambda items: F.when(F.size(items) == 0, F.array().cast("array<bigint>")).otherwise(of(items)),
    )
