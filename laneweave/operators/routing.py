"""Key derivation: by reference, by hash shard, by tag or read-group field.

A router adds ``keys array<string>`` and ``drop_reason string`` to alignments.
Policies of ``error`` are checked by an aggregate before routing, so that the
error is a typed one that names the first record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CardinalityError, ConfigError, RecordError, RoutingError
from ..functions import hashing

FLAG_UNMAPPED, FLAG_SECONDARY, FLAG_QC_FAIL, FLAG_DUPLICATE, FLAG_SUPPLEMENTARY = 0x4, 0x100, 0x200, 0x400, 0x800
UNPLACED_POLICIES = ("keep", "drop", "error")
PLACED_UNMAPPED = ("by-reference", "unmapped")
MISSING_POLICIES = ("file", "drop", "error")
#: Columns of the read-group table by field name.
READ_GROUP_FIELDS = {"read-group": "id", "sample": "sample", "library": "library", "platform-unit": "platform_unit", "platform": "platform", "sequencing-center": "center"}
DROP_REASONS = ("unplaced", "excluded-reference", "missing-tag", "unknown-read-group", "missing-read-group-field", "unmatched")


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_primary(flag: Column) -> Column:
    return ~has_flag(flag, FLAG_SECONDARY | FLAG_SUPPLEMENTARY)


def placement(ref_id: Column, flag: Column) -> Column:
    return F.when(ref_id.isNull() | (ref_id < 0), "unplaced").when(has_flag(flag, FLAG_UNMAPPED), "placed-unmapped").otherwise("mapped")


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ConfigError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


def _first(df: DataFrame, bad: Column) -> int | None:
    """The first record that ``bad`` holds for."""
    return df.filter(bad).agg(F.min("ordinal").alias("at")).first()["at"]


def check_reference_ids(aln: DataFrame, references: int) -> None:
    """Reference and mate reference must be -1 or in the dictionary."""
    out = lambda c: (F.col(c) < -1) | (F.col(c) >= references)
    columns = [c for c in ("ref_id", "next_ref_id") if c in aln.columns]
    bad = out(columns[0])
    for c in columns[1:]:
        bad = bad | (out(c) & (F.col("ref_id") >= 0))
    at = _first(aln, bad)
    if at is not None:
        raise RecordError("reference id is not in the dictionary", at)


def selected_references(references: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, ignore_unknown: bool = False) -> DataFrame:
    """References that are chosen: all or ``include``, without ``exclude``, which wins."""
    named = sorted({*(include or []), *(exclude or [])})
    if named and not ignore_unknown:
        known = {r["name"] for r in references.filter(F.col("name").isin(named)).select("name").collect()}
        if missing := [n for n in named if n not in known]:
            raise ConfigError(f"unknown references: {', '.join(missing[:4])}")
    chosen = references if include is None else references.filter(F.col("name").isin(list(include)))
    chosen = chosen if not exclude else chosen.filter(~F.col("name").isin(list(exclude)))
    if (include is not None or exclude) and not chosen.limit(1).count():
        raise ConfigError("no reference is selected")
    return chosen


def route_chrom(
    aln: DataFrame,
    references: DataFrame,
    unplaced: str = "keep",
    placed_unmapped: str = "by-reference",
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    ignore_unknown: bool = False,
    unmapped_key: str = "unmapped",
) -> DataFrame:
    """One output for each reference. Tests in order: no reference; unmapped flag; selection."""
    _one_of(unplaced, UNPLACED_POLICIES, "unplaced")
    _one_of(placed_unmapped, PLACED_UNMAPPED, "placed-unmapped")
    nowhere = F.col("ref_id") < 0
    if unplaced == "error" and (at := _first(aln, nowhere)) is not None:
        raise RoutingError(f"record {at} has no reference")
    chosen = selected_references(references, include, exclude, ignore_unknown).select("ref_id", F.col("name").alias("_name"))
    joined = aln.join(chosen, "ref_id", "left")
    alone = F.array(F.lit(unmapped_key))
    keys = F.when(nowhere, alone if unplaced == "keep" else F.array().cast("array<string>"))
    reason = F.when(nowhere, F.lit(None if unplaced == "keep" else "unplaced"))
    if placed_unmapped == "unmapped":
        keys = keys.when(has_flag(F.col("flag"), FLAG_UNMAPPED), alone)
        reason = reason.when(has_flag(F.col("flag"), FLAG_UNMAPPED), F.lit(None))
    keys = keys.when(F.col("_name").isNotNull(), F.array("_name")).otherwise(F.array().cast("array<string>"))
    reason = reason.when(F.col("_name").isNull(), F.lit("excluded-reference"))
    return joined.withColumn("keys", keys).withColumn("drop_reason", reason).drop("_name")


def declared_chrom_keys(references: DataFrame, unplaced: str = "keep", placed_unmapped: str = "by-reference", unmapped_key: str = "unmapped", **selection) -> DataFrame:
    """(position, key): selected references in dictionary order, then the unmapped key if anything may go there."""
    chosen = selected_references(references, **selection).select(F.col("ref_id").cast("long").alias("position"), F.col("name").alias("key"))
    if unplaced == "keep" or placed_unmapped == "unmapped":
        spark = references.sparkSession
        chosen = chosen.unionByName(spark.range(1).select(F.lit(1 << 32).cast("long").alias("position"), F.lit(unmapped_key).alias("key")))
    return chosen


def with_read_group(aln: DataFrame, read_groups: DataFrame, field: str) -> DataFrame:
    """Alignments with ``_known`` (is the read group in the header?) and ``_value`` (the field)."""
    if field not in READ_GROUP_FIELDS:
        raise ConfigError(f"unknown read-group field {field!r}")
    dimension = read_groups.select(F.col("id").alias("_id"), F.col(READ_GROUP_FIELDS[field]).alias("_value"))
    return aln.join(dimension, F.col("rg") == F.col("_id"), "left").withColumn("_known", F.col("_id").isNotNull()).drop("_id")


def _applied(df: DataFrame, value: Column, missing: Column, reason: Column, policy: Column, file_key: Column) -> DataFrame:
    """Keys of a value, or what a policy (file or drop) makes of a missing one."""
    none = F.array().cast("array<string>")
    keys = F.when(~missing, F.array(value)).when(policy == "file", F.array(file_key)).otherwise(none)
    return df.withColumn("keys", keys).withColumn("drop_reason", F.when(missing & (policy == "drop"), reason))


def route_tag(
    aln: DataFrame,
    value_col: str,
    missing: str = "file",
    missing_key: str = "no-tag",
    max_outputs: int | None = 1000,
) -> DataFrame:
    """One output for each value of a tag, rendered as text in ``value_col`` (null where the tag is missing)."""
    _one_of(missing, MISSING_POLICIES, "missing")
    value = F.col(value_col)
    if missing == "error" and (at := _first(aln, value.isNull())) is not None:
        raise RoutingError(f"record {at} has no such tag")
    admit(aln, value_col, max_outputs)
    return _applied(aln, value, value.isNull(), F.lit("missing-tag"), F.lit(missing), F.lit(missing_key))


def route_read_group(
    aln: DataFrame,
    read_groups: DataFrame,
    field: str = "sample",
    missing: str = "file",
    unknown: str = "file",
    missing_key: str = "no-tag",
    max_outputs: int | None = 1000,
) -> DataFrame:
    """One output for each value of a read-group field.

    Without a read group, or without the field in it, ``missing`` rules; a read
    group that the header doesn't have is ruled by ``unknown``.
    """
    _one_of(missing, MISSING_POLICIES, "missing")
    _one_of(unknown, MISSING_POLICIES, "unknown read group")
    df = with_read_group(aln, read_groups, field)
    stray = F.col("rg").isNotNull() & ~F.col("_known")
    if unknown == "error" and (at := _first(df, stray)) is not None:
        raise RoutingError(f"record {at} has an unknown read group")
    absent = F.col("_value").isNull() & ~stray
    if missing == "error" and (at := _first(df, absent)) is not None:
        raise RoutingError(f"record {at} has no {field}")
    admit(df, "_value", max_outputs)
    reason = F.when(stray, "unknown-read-group").when(F.col("rg").isNull(), "missing-tag").otherwise("missing-read-group-field")
    policy = F.when(stray, unknown).otherwise(missing)
    return _applied(df, F.col("_value"), F.col("_value").isNull(), reason, policy, F.lit(missing_key)).drop("_value", "_known")


def admit(df: DataFrame, value_col: str, max_outputs: int | None) -> None:
    """Fail before anything is written if there are more values than outputs may be."""
    if max_outputs is None:
        return
    if max_outputs < 1:
        raise ConfigError("there must be at least one output")
    found = df.filter(F.col(value_col).isNotNull()).select(value_col).distinct().limit(max_outputs + 1).count()
    if found > max_outputs:
        raise CardinalityError(f"more than {max_outputs} outputs")


def declared_tag_keys(read_groups: DataFrame, field: str, missing: str = "file", unknown: str = "file", missing_key: str = "no-tag") -> DataFrame:
    values = read_groups.select(F.col(READ_GROUP_FIELDS[field]).alias("key")).filter(F.col("key").isNotNull()).distinct()
    if "file" in (missing, unknown):
        values = values.union(read_groups.sparkSession.range(1).select(F.lit(missing_key).alias("key"))).distinct()
    return values


def route_shard(aln: DataFrame, key: Column, shards: int, seed: int = hashing.DEFAULT_SEED, width: int | None = None, missing: str = "file", missing_key: str = "no-key", reason: str = "missing-tag") -> DataFrame:
    """One of ``shards`` outputs by the hash of a key (bytes or text); null keys are ruled by ``missing``."""
    _one_of(missing, MISSING_POLICIES, "missing")
    df = aln.withColumn("_shard", hashing.shard_number(key, shards, seed))
    if missing == "error" and (at := _first(df, F.col("_shard").isNull())) is not None:
        raise RoutingError(f"record {at} has no shard key")
    name = hashing.shard_name(F.col("_shard"), shards, width)
    return _applied(df, name, F.col("_shard").isNull(), F.lit(reason), F.lit(missing), F.lit(missing_key)).drop("_shard")


def declared_shard_keys(spark, shards: int, width: int | None = None, missing: str = "file", missing_key: str = "no-key") -> DataFrame:
    names = spark.range(shards).select(hashing.shard_name(F.col("id"), shards, width).alias("key"))
    return names.union(spark.range(1).select(F.lit(missing_key).alias("key"))) if missing == "file" else names


def emissions(routed: DataFrame) -> DataFrame:
    """A row for each record and key."""
    return routed.withColumn("key", F.explode("keys")).drop("keys", "drop_reason")


def skipped_keys(declared: DataFrame, emitted: DataFrame) -> DataFrame:
    """Declared keys that got no record."""
    return declared.join(emitted.select("key").distinct(), "key", "left_anti")
