"""CIGAR geometry over ``array<struct<len: bigint, op: int>>``.

Operations are numbered as in the text ``MIDNSHP=X``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import SET, interval

#: Fixed values of the format.
OPERATIONS = "MIDNSHP=X"
CONSUMES_REFERENCE = (0, 2, 3, 7, 8)
CONSUMES_READ = (0, 1, 4, 7, 8)
ALIGNED = (0, 7, 8)
DELETION, SKIP = 2, 3
CIGAR = "array<struct<len: bigint, op: int>>"
#: Largest span of a reference.
MAX_SPAN = 4294967295


def _sum(cigar: Column, operations: tuple[int, ...]) -> Column:
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda n, c: n + F.when(c["op"].isin(*operations), c["len"]).otherwise(0))


def check(cigar: Column) -> Column:
    """The CIGAR; an error for an operation beyond the nine, or a span that doesn't fit 32 bits."""
    bad = F.exists(cigar, lambda c: (c["op"] < 0) | (c["op"] > 8))
    return (
        F.when(bad, F.raise_error(F.lit("unknown CIGAR operation")).cast(CIGAR))
        .when(_sum(cigar, CONSUMES_REFERENCE) > MAX_SPAN, F.raise_error(F.lit("CIGAR span is too long")).cast(CIGAR))
        .otherwise(cigar)
    )


def reference_span(cigar: Column) -> Column:
    """struct(aligned, deleted, skipped, total) of reference bases."""
    return F.struct(
        _sum(cigar, ALIGNED).alias("aligned"),
        _sum(cigar, (DELETION,)).alias("deleted"),
        _sum(cigar, (SKIP,)).alias("skipped"),
        _sum(cigar, CONSUMES_REFERENCE).alias("total"),
    )


def reference_length(cigar: Column) -> Column:
    return _sum(cigar, CONSUMES_REFERENCE)


def read_length(cigar: Column) -> Column:
    return _sum(cigar, CONSUMES_READ)


def reference_interval(start: Column, cigar: Column) -> Column:
    """What an alignment spans; one base at least."""
    return interval(start, start + F.greatest(_sum(cigar, CONSUMES_REFERENCE), F.lit(1)))


def alignment_end(start: Column, cigar: Column) -> Column:
    return start + F.greatest(_sum(cigar, CONSUMES_REFERENCE), F.lit(1))


def aligned_blocks(start: Column, cigar: Column, join_deletions: bool = False, otherwise: Column | None = None) -> Column:
    """Runs of aligned bases as intervals, ``otherwise`` if there are none. Skips end a run; deletions too, unless they are joined.

    A joined deletion at the beginning of a run opens none, and one at its end
    is left out again where a skip or the end follows.
    """
    state = F.struct(start.cast("long").alias("at"), F.lit(False).alias("open"), F.array().cast(SET).alias("runs"))

    def step(s: Column, c: Column) -> Column:
        after = s["at"] + F.when(c["op"].isin(*CONSUMES_REFERENCE), c["len"]).otherwise(0)
        aligned = c["op"].isin(*ALIGNED) & (c["len"] > 0)
        last = F.get(s["runs"], F.size(s["runs"]) - 1)
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1), F.array(interval(last["start"], after)))
        runs = F.when(aligned & s["open"], longer).when(aligned, F.concat(s["runs"], F.array(interval(s["at"], after)))).otherwise(s["runs"])
        closes = c["op"].isin(*((SKIP,) if join_deletions else (SKIP, DELETION))) & (c["len"] > 0)
        return F.struct(after.alias("at"), F.when(closes, F.lit(False)).otherwise(s["open"] | aligned).alias("open"), runs.alias("runs"))

    return F.aggregate(cigar, state, step, lambda s: s["runs"] if otherwise is None else F.when(F.size(s["runs"]) > 0, s["runs"]).otherwise(otherwise))


def geometry(start: Column, cigar: Column, span: bool = False) -> Column:
    """The intervals that region routing looks at: aligned runs, or the whole span; one base where nothing is aligned."""
    whole = F.array(reference_interval(start, cigar))
    if span:
        return whole
    one = ~F.exists(cigar, lambda c: c["op"].isin(DELETION, SKIP))  # nothing parts the run
    return F.when(one, whole).otherwise(aligned_blocks(start, cigar, otherwise=whole))


def text(cigar: Column) -> Column:
    letters = F.array(*[F.lit(o) for o in OPERATIONS])
    parts = F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), F.element_at(letters, c["op"].cast("int") + 1)))
    return F.when(F.size(cigar) == 0, F.lit("*")).otherwise(F.array_join(parts, ""))
