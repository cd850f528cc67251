"""Shingles of words as expressions of the DataFrame API, for operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words: ASCII white space, or whatever is neither letter nor digit.
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value worked out once, even where body uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, between: str = SPACES) -> Column:
    """The lower-cased words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), between), "")


def hashes(found: Column, width: int = 5) -> Column:
    """64-bit hashes of all shingles of width words, repeats included. Fewer words make one shingle; none make none."""

    def body(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) >= width, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), body)


def strings(found: Column, width: int = 5) -> Column:
    """The shingles themselves, words joined by spaces."""

    def body(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, each).when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))

    return let(found, body)
