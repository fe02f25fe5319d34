"""Annotation records to regions: feature segments, names, counts.

Records: ordinal, chrom, start, end, name, strand, thick_start, thick_end,
blocks (absolute intervals, null without), extras (map of text). ``gxf`` says
that the records come from GTF or GFF3, where missing blocks are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnnotationError, ConfigError
from ..functions import intervals as iv

FEATURES = ("span", "exon", "intron", "cds", "utr", "five-utr", "three-utr")
ALIASES = {"5utr": "five-utr", "3utr": "three-utr"}
MISSING = ("skip", "empty", "error")
NEEDS_BLOCKS, NEEDS_CODING, NEEDS_STRAND = ("exon", "intron"), ("cds", "utr", "five-utr", "three-utr"), ("five-utr", "three-utr")


def feature_name(text: str) -> str:
    name = ALIASES.get(text, text)
    if name not in FEATURES:
        raise ConfigError(f"feature must be one of {', '.join(FEATURES)}, not {text!r}")
    return name


def _whole() -> Column:
    return F.array(iv.interval(F.col("start"), F.col("end")))


def _exons() -> Column:
    return F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(_whole())


def _gaps(blocks: Column) -> Column:
    """What lies between neighbouring blocks."""
    return F.zip_with(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda a, b: iv.interval(a["end"], b["start"]))


def _before(parts: Column, at: Column) -> Column:
    return F.transform(parts, lambda p: iv.interval(p["start"], F.least(p["end"], at)))


def _after(parts: Column, at: Column) -> Column:
    return F.transform(parts, lambda p: iv.interval(F.greatest(p["start"], at), p["end"]))


def problems(records: DataFrame) -> DataFrame:
    """(ordinal, problem) of records that don't hold together, whatever the feature."""
    blocks = F.col("blocks")
    pairs = F.zip_with(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda a, b: b["start"] < a["end"])
    problem = (
        F.when(F.coalesce(F.length("chrom"), F.lit(0)) == 0, "empty reference name")
        .when(F.col("end") <= F.col("start"), "end is not after start")
        .when(F.exists(blocks, iv.is_empty), "empty block")
        .when(F.exists(pairs, lambda x: x), "blocks overlap or are not in order")
    )
    return records.select("ordinal", problem.alias("problem")).filter(F.col("problem").isNotNull())


def derived(records: DataFrame, feature: str, gxf: bool = False, require_blocks: bool = False) -> DataFrame:
    """Records with segments (a set), missing (the first reason, or null), no_blocks, no_coding, no_strand, fallback."""
    feature = feature_name(feature)
    without = F.coalesce(F.size("blocks"), F.lit(0)) <= 0
    strict = gxf or require_blocks
    no_blocks = (without & F.lit(strict)) if feature in NEEDS_BLOCKS else F.lit(False)
    no_coding = (F.col("thick_start").isNull() | F.col("thick_end").isNull() | (F.col("thick_start") >= F.col("thick_end"))) if feature in NEEDS_CODING else F.lit(False)
    no_strand = ~F.coalesce(F.col("strand"), F.lit(".")).isin("+", "-") if feature in NEEDS_STRAND else F.lit(False)
    exons = F.col("_exons")
    left, right = _before(exons, F.col("thick_start")), _after(exons, F.col("thick_end"))
    segments = {
        "span": _whole(),
        "exon": exons,
        "intron": F.when(without, F.array().cast(iv.SET)).otherwise(_gaps(exons)),
        "cds": F.transform(exons, lambda e: iv.interval(F.greatest(e["start"], F.col("thick_start")), F.least(e["end"], F.col("thick_end")))),
        "utr": F.concat(left, right),
        "five-utr": F.when(F.col("strand") == "-", right).otherwise(left),
        "three-utr": F.when(F.col("strand") == "-", left).otherwise(right),
    }[feature]
    missing = F.when(no_blocks, "blocks").when(no_coding, "coding").when(no_strand, "strand")
    return (
        records.withColumn("_exons", _exons())
        .withColumn("no_blocks", no_blocks)
        .withColumn("no_coding", no_coding)
        .withColumn("no_strand", no_strand)
        .withColumn("missing", missing)
        .withColumn("fallback", (without & F.lit(not strict)) if feature in NEEDS_BLOCKS else F.lit(False))
        .withColumn("segments", F.when(missing.isNotNull(), F.array().cast(iv.SET)).otherwise(iv.merged(segments)))
        .drop("_exons")
    )


def named(records: DataFrame, prefix: str = "region", name_field: str | None = None) -> DataFrame:
    """Records with base_name, generated, key and dup_suffix: equal names are numbered ``name``, ``name.2``, ... in record order.

    A name is the extra ``name_field``, or else the record's, unless empty or
    ``.``; else it is made of prefix, place and ordinal.
    """
    usable = lambda c: F.when((c != "") & (c != "."), c)
    made = F.concat_ws("-", F.lit(prefix), "chrom", "start", "end", "ordinal")
    own = usable(F.col("name"))
    if name_field is not None:
        own = F.coalesce(usable(F.element_at("extras", name_field)), own)
    out = records.withColumn("generated", own.isNull()).withColumn("base_name", F.coalesce(own, made))
    place = F.row_number().over(Window.partitionBy("base_name").orderBy("ordinal"))
    out = out.withColumn("dup_suffix", place)
    return out.withColumn("key", F.when(place > 1, F.concat_ws(".", "base_name", place)).otherwise(F.col("base_name")))


def extract(records: DataFrame, feature: str = "span", missing: str = "skip", gxf: bool = False, require_blocks: bool = False, prefix: str = "region", name_field: str | None = None) -> DataFrame:
    """Regions: ordinal, key, chrom, segments, env_start, env_end, strand, original_name, generated, dup_suffix, fallback.

    Skipped records leave gaps in the ordinals and take no name.
    """
    if missing not in MISSING:
        raise ConfigError(f"missing must be one of {', '.join(MISSING)}, not {missing!r}")
    if bad := problems(records).orderBy("ordinal").limit(1).collect():
        raise AnnotationError(f"record {bad[0]['ordinal']}: {bad[0]['problem']}")
    rows = derived(records, feature, gxf, require_blocks)
    if missing == "error":
        first = rows.filter(F.col("missing").isNotNull()).orderBy("ordinal").select("ordinal", "missing").limit(1).collect()
        if first:
            raise AnnotationError(f"record {first[0]['ordinal']} has no {first[0]['missing']} for {feature}")
    if missing == "skip":
        rows = rows.filter(F.col("missing").isNull())
    rows = named(rows, prefix, name_field).withColumn("_envelope", iv.bounds(F.col("segments")))
    return rows.select(
        "ordinal",
        "key",
        "chrom",
        "segments",
        F.coalesce(F.col("_envelope.start"), F.col("start")).alias("env_start"),
        F.coalesce(F.col("_envelope.end"), F.col("start")).alias("env_end"),
        "strand",
        F.col("name").alias("original_name"),
        "generated",
        "dup_suffix",
        "fallback",
    )


def extraction_counts(records: DataFrame, feature: str, gxf: bool = False, require_blocks: bool = False, prefix: str = "region") -> DataFrame:
    """One row: records, segments, missing, no_blocks, no_coding, no_strand (causes can meet), empty, generated, duplicates, fallback.

    Names and segments are counted over the records that aren't missing.
    """
    rows = derived(records, feature, gxf, require_blocks)
    kept = named(rows.filter(F.col("missing").isNull()), prefix)
    n = lambda c: F.count_if(c)
    causes = rows.agg(F.count("*").alias("records"), n(F.col("missing").isNotNull()).alias("missing"), *[n(F.col(c)).alias(c) for c in ("no_blocks", "no_coding", "no_strand")])
    names = kept.agg(
        F.coalesce(F.sum(F.size("segments")), F.lit(0)).cast("long").alias("segments"),
        n(F.size("segments") == 0).alias("empty"),
        n(F.col("generated")).alias("generated"),
        n(F.col("dup_suffix") > 1).alias("duplicates"),
        n(F.col("fallback")).alias("fallback"),
    )
    return causes.withColumn("_one", F.lit(1)).join(names.withColumn("_one", F.lit(1)), "_one").drop("_one")
