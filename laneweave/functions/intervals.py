"""Half-open intervals ``[start, end)`` as structs, and sorted sets of them as arrays.

An interval with ``end <= start`` is empty. A *set* is sorted and merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL = "struct<start: bigint, end: bigint>"
SET = f"array<{INTERVAL}>"


def interval(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def length(i: Column) -> Column:
    return F.greatest(i["end"] - i["start"], F.lit(0))


def is_empty(i: Column) -> Column:
    return i["end"] <= i["start"]


def contains(i: Column, point: Column) -> Column:
    return (i["start"] <= point) & (point < i["end"])


def contains_interval(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` lies in ``outer``; an empty one does where its start does, or at the end."""
    empty = (outer["start"] <= inner["start"]) & (inner["start"] <= outer["end"])
    return F.when(is_empty(inner), empty).otherwise((outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"]))


def intersects(a: Column, b: Column) -> Column:
    return ~is_empty(a) & ~is_empty(b) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    """The common interval, null if there is none."""
    return F.when(intersects(a, b), interval(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))


def envelope(a: Column, b: Column) -> Column:
    return interval(F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))


def touches(a: Column, b: Column) -> Column:
    """Whether two intervals overlap or abut."""
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def one_based(i: Column) -> Column:
    """The inclusive interval from 1; an empty one is its first base."""
    return F.struct((i["start"] + 1).alias("start"), F.when(is_empty(i), i["start"] + 1).otherwise(i["end"]).alias("end"))


def midpoint(i: Column) -> Column:
    return i["start"] + F.floor((i["end"] - i["start"]) / 2).cast("long")



def merged(intervals: Column) -> Column:
    """The set of the intervals of an array: empty ones dropped, overlapping and abutting ones joined."""
    first = F.array_sort(F.filter(intervals, lambda i: ~is_empty(i)))
    none = F.array().cast(SET)

    def add(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(interval(last["start"], F.greatest(last["end"], i["end"]))))
        return F.when((F.size(done) > 0) & (i["start"] <= F.get(done, F.size(done) - 1)["end"]), joined).otherwise(F.concat(done, F.array(i)))

    return F.aggregate(first, none, add)


def total_length(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda n, i: n + length(i))


def set_overlap(a: Column, b: Column) -> Column:
    """Common positions of two sets."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.aggregate(b, F.lit(0).cast("long"), lambda m, y: m + overlap(x, y)))


def set_contains_all(outer: Column, inner: Column) -> Column:
    """Whether each non-empty interval of ``inner`` lies in one interval of ``outer``."""
    return F.forall(inner, lambda i: is_empty(i) | F.exists(outer, lambda o: (o["start"] <= i["start"]) & (i["end"] <= o["end"])))


def set_contains_point(intervals: Column, point: Column) -> Column:
    return F.exists(intervals, lambda i: contains(i, point))


def bounds(intervals: Column) -> Column:
    """From the least start to the greatest end, null without intervals."""
    return F.when(F.size(intervals) > 0, interval(F.array_min(F.transform(intervals, lambda i: i["start"])), F.array_max(F.transform(intervals, lambda i: i["end"]))))
