"""Vector clocks as map columns: node to counter. A missing node reads as zero; a null clock compares as concurrent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causalframe.schema import AFTER, BEFORE, CONCURRENT, EQUAL

CLOCK = "map<string,bigint>"
#: Times in JSON keep their microseconds.
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def new_clock() -> Column:
    return F.create_map().cast(CLOCK)


def counter(clock: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, node), F.lit(0).cast("long"))


def increment(clock: Column, node: Column | str) -> Column:
    """The clock with one more for node."""
    node = F.lit(node) if isinstance(node, str) else node
    return F.map_zip_with(clock, F.create_map(node, F.lit(1).cast("long")), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def exceeds(a: Column, b: Column) -> Column:
    """Whether some node counts more in a than in b."""
    return F.exists(F.map_entries(a), lambda e: e["value"] > counter(b, e["key"]))


def compare(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent."""
    more, less = exceeds(a, b), exceeds(b, a)
    known = F.when(more & less, CONCURRENT).when(more, AFTER).when(less, BEFORE).otherwise(EQUAL)
    return F.when(a.isNull() | b.isNull(), CONCURRENT).otherwise(known)


def dominates(a: Column, b: Column) -> Column:
    """Whether b is strictly before a; false where either is null."""
    return F.coalesce(exceeds(a, b) & ~exceeds(b, a), F.lit(False))


def covers(a: Column, b: Column) -> Column:
    """Whether a is after b or equal to it; false where either is null."""
    return F.coalesce(~exceeds(b, a), F.lit(False))


def merge(a: Column, b: Column) -> Column:
    """The greater counter of each node; the other clock where one is null."""
    return F.coalesce(F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y)), a, b)


def merge_all(clocks: Column) -> Column:
    """The merge of an array of clocks."""
    return F.aggregate(clocks, new_clock(), merge)


def prune(clock: Column, size: int) -> Column:
    """The size largest counters; of equal ones, those of the larger node ids."""
    order = lambda x, y: F.when((x["value"] > y["value"]) | (x["value"] == y["value"]) & (x["key"] > y["key"]), -1).otherwise(1)
    ranked = F.array_sort(F.map_entries(clock), order)
    return F.when(F.size(clock) <= size, clock).otherwise(F.map_from_entries(F.slice(ranked, 1, size)))


def equals(a: Column, b: Column) -> Column:
    """As many entries, and each the same; a missing one reads as zero."""
    same = F.forall(F.map_entries(a), lambda e: e["value"] == counter(b, e["key"]))
    return F.coalesce((F.size(a) == F.size(b)) & same, F.lit(False))


def total(clock: Column) -> Column:
    """The sum of all counters: larger in a clock than in any that it dominates."""
    return F.aggregate(F.map_values(clock), F.lit(0).cast("long"), lambda s, x: s + x)


def render(clock: Column) -> Column:
    """node=counter, by node: one text for one clock."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(clock)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def to_json(clock: Column, ts: Column) -> Column:
    return F.to_json(F.struct(clock.alias("versions"), ts.alias("timestamp")), JSON_TIME)


def from_json(text: Column) -> Column:
    return F.from_json(text, f"versions {CLOCK}, timestamp timestamp", JSON_TIME)
