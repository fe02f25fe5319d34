"""Counts of records and outputs, order checks, and conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ManifestError
from .routing import FLAG_DUPLICATE, FLAG_QC_FAIL, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, FLAG_UNMAPPED, has_flag


def record_counters() -> list[Column]:
    """Counts by placement, by kind (secondary before supplementary), duplicates, failed ones, bytes. Columns ref_id, flag, n_bytes."""
    flag = F.col("flag")
    placed = F.col("ref_id") >= 0
    unmapped = has_flag(flag, FLAG_UNMAPPED)
    secondary, supplementary = has_flag(flag, FLAG_SECONDARY), has_flag(flag, FLAG_SUPPLEMENTARY)
    return [
        F.count("*").alias("total"),
        F.count_if(placed & ~unmapped).alias("mapped"),
        F.count_if(placed & unmapped).alias("placed_unmapped"),
        F.count_if(~placed).alias("unplaced"),
        F.count_if(~secondary & ~supplementary).alias("primary"),
        F.count_if(secondary).alias("secondary"),
        F.count_if(~secondary & supplementary).alias("supplementary"),
        F.count_if(has_flag(flag, FLAG_DUPLICATE)).alias("duplicate"),
        F.count_if(has_flag(flag, FLAG_QC_FAIL)).alias("qc_fail"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("n_bytes"),
    ]


def output_stats(emitted: DataFrame) -> DataFrame:
    """Counters of each key. Partial sums are combined before the shuffle, so a large key is no large group."""
    return emitted.groupBy("key").agg(*record_counters())


def coordinate_range(emitted: DataFrame) -> DataFrame:
    """First and last placed coordinate of each key in record order."""
    at = F.struct("ref_id", "pos")
    placed = emitted.filter(F.col("ref_id") >= 0).groupBy("key").agg(F.min_by(at, "ordinal").alias("first"), F.max_by(at, "ordinal").alias("last"))
    return placed.select("key", F.col("first.ref_id").alias("first_ref"), F.col("first.pos").alias("first_pos"), F.col("last.ref_id").alias("last_ref"), F.col("last.pos").alias("last_pos"))


#: Rows of a stretch of ordinals, within which order is checked by a window.
STRETCH = 1 << 16


def order_steps(aln: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records with ``prior`` (the placed coordinate before) and ``after_unplaced``, in record order within ``by``.

    Stretches of ordinals are windows of their own; each begins with the state
    that the stretches before it end in, so that no window grows with a key.
    """
    by = by or []
    at = F.when(F.col("ref_id") >= 0, F.struct("ref_id", "pos"))
    rows = aln.withColumn("_at", at).withColumn("_nowhere", (F.col("ref_id") < 0).cast("int")).withColumn("_stretch", F.expr(f"ordinal div {STRETCH}"))
    ends = rows.groupBy(*by, "_stretch").agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("ordinal"))).alias("_end"), F.max("_nowhere").alias("_gone"))
    across = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    states = ends.select(*by, "_stretch", F.last("_end", ignorenulls=True).over(across).alias("_from"), F.coalesce(F.max("_gone").over(across), F.lit(0)).alias("_was"))
    within = Window.partitionBy(*by, "_stretch").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(states, [*by, "_stretch"])
        .withColumn("prior", F.coalesce(F.last("_at", ignorenulls=True).over(within), F.col("_from")))
        .withColumn("after_unplaced", F.greatest(F.coalesce(F.max("_nowhere").over(within), F.lit(0)), F.col("_was")) == 1)
        .drop("_nowhere", "_stretch", "_from", "_was")
    )


def order_violations(aln: DataFrame) -> DataFrame:
    """Placed records that come after a greater coordinate, or after an unplaced record: ordinal."""
    steps = order_steps(aln)
    back = F.col("_at") < F.col("prior")
    return steps.filter(F.col("_at").isNotNull() & (F.coalesce(back, F.lit(False)) | F.col("after_unplaced"))).select("ordinal")


def coordinate_sorted(emitted: DataFrame) -> DataFrame:
    """For each key whether its placed records are in coordinate order (unplaced ones don't matter)."""
    steps = order_steps(emitted, ["key"])
    return steps.groupBy("key").agg(F.bool_and(F.coalesce(F.col("_at") >= F.col("prior"), F.lit(True))).alias("coordinate_sorted"))


def key_runs(emitted: DataFrame) -> DataFrame:
    """Runs of equal keys in record order, for each key. More than one means that streaming would see a finished key again.

    Neighbours are found by a join on the ordinal's successor where ordinals are
    dense; gaps (dropped records) are closed first by numbering stretch by stretch.
    """
    rows = emitted.select("ordinal", "key").withColumn("_stretch", F.expr(f"ordinal div {STRETCH}"))
    ends = rows.groupBy("_stretch").agg(F.max_by("key", "ordinal").alias("_end"))
    before = ends.select("_stretch", F.lag("_end").over(Window.orderBy("_stretch")).alias("_from"))  # a row for each stretch
    within = Window.partitionBy("_stretch").orderBy("ordinal")
    steps = rows.join(before, "_stretch").withColumn("_prior", F.coalesce(F.lag("key").over(within), F.col("_from")))
    return steps.groupBy("key").agg(F.count_if(F.coalesce(F.col("key") != F.col("_prior"), F.lit(True))).alias("runs"))


def run_counters(routed: DataFrame) -> DataFrame:
    """One row: input, unique_emitted, emissions, dropped, unmatched, duplicates, max_per_record."""
    n = F.size("keys")
    lost = F.col("drop_reason")
    return routed.agg(
        F.count("*").alias("input"),
        F.count_if(n > 0).alias("unique_emitted"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("emissions"),
        F.count_if((n == 0) & (F.coalesce(lost, F.lit("")) != "unmatched")).alias("dropped"),
        F.count_if((n == 0) & (lost == "unmatched")).alias("unmatched"),
        F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_per_record"),
    )


def drop_counts(routed: DataFrame) -> DataFrame:
    return routed.filter(F.size("keys") == 0).groupBy("drop_reason").agg(F.count("*").alias("n"))


def check_conservation(counters: dict, outputs: list[dict], duplicating: bool) -> None:
    """No record may get lost: raise unless all sums agree."""
    if counters["input"] != counters["unique_emitted"] + counters["dropped"] + counters["unmatched"]:
        raise ManifestError("input is not emitted + dropped + unmatched")
    if counters["emissions"] != counters["unique_emitted"] + counters["duplicates"]:
        raise ManifestError("emissions are not unique + duplicates")
    if not duplicating and counters["duplicates"]:
        raise ManifestError("a mode without duplicates made some")
    if sum(o["total"] for o in outputs) != counters["emissions"]:
        raise ManifestError("outputs don't hold all emissions")
    for o in outputs:
        if o["total"] != o["mapped"] + o["placed_unmapped"] + o["unplaced"] or o["total"] != o["primary"] + o["secondary"] + o["supplementary"]:
            raise ManifestError(f"counts of {o['key']!r} don't add up")


def per_reference(aln: DataFrame, references: DataFrame) -> DataFrame:
    """Records of each reference that has any: ref_id, name, n."""
    counts = aln.filter(F.col("ref_id") >= 0).groupBy("ref_id").agg(F.count("*").alias("n"))
    return counts.join(references.select("ref_id", "name"), "ref_id").select("ref_id", "name", "n")


def distinct_values(aln: DataFrame, column: str) -> DataFrame:
    return aln.agg(F.count_distinct(column).alias("distinct_values"), F.count(column).alias("present"))
