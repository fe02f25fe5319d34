"""Whole runs: read a file, route, write an output for each key, account for all records."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest as mf
from .errors import ConfigError, HeaderError, IndexError_, LaneError
from .functions import hashing, tags
from .functions.keys import Template, assign_names
from .operators import features, regions, routing, stats
from .plans import planner
from .sources import annotation, bam, bam_sink
from .sources import index as ix
from .sources.header import Header

VERSION = "0.1.0"
PROGRAM = "laneweave"


@dataclass
class RunOptions:
    """What all runs share."""

    out_dir: str = "."
    force: bool = False
    compression_level: int = 6
    threads: int = 1
    engine: str = "auto"
    io: str = "auto"
    index: str = "auto"
    emit_empty: bool = False
    append_program: bool = True
    manifest: str | None = None
    manifest_format: str = "json"
    command: str = ""
    max_record: int = bam.MAX_RECORD

    def validate(self) -> None:
        if not 0 <= self.compression_level <= 9:
            raise ConfigError("the compression level is 0 to 9")
        if self.threads < 1:
            raise ConfigError("there must be at least one thread")
        if self.manifest_format not in ("json", "tsv"):
            raise ConfigError("a manifest is json or tsv")
        if not 32 <= self.max_record <= 1 << 31:
            raise ConfigError("the largest record is out of range")

    def with_threads(self, n: int) -> RunOptions:
        return RunOptions(**{**asdict(self), "threads": n})


@dataclass
class SplitReport:
    manifest: dict
    plan: planner.ScanPlan
    notes: list[str] = field(default_factory=list)

    @property
    def created_outputs(self) -> list[dict]:
        return [o for o in self.manifest["outputs"] if not o["skipped"]]


def local_input(path: str) -> tuple[str, str | None]:
    """The path to read, and a temporary copy to remove, for ``-`` (standard input)."""
    if path != "-":
        return path, None
    handle, copy = tempfile.mkstemp(suffix=".bam")
    with os.fdopen(handle, "wb") as out:
        shutil.copyfileobj(sys.stdin.buffer, out)
    return copy, copy


def _prepare(spark: SparkSession, path: str, options: RunOptions, columns: list[str], **read) -> tuple[Header, DataFrame]:
    options.validate()
    header, _ = bam.read_header(path)
    return header, bam.read_bam(spark, path, ["body", *columns], max_record=options.max_record, **read)


def _run(
    spark: SparkSession,
    path: str,
    header: Header,
    routed: DataFrame,
    declared: list[str],
    mode: str,
    plan: planner.ScanPlan,
    options: RunOptions,
    template: str = "{key}.bam",
    duplicating: bool = False,
    described: dict[str, dict] | None = None,
    extra: dict | None = None,
) -> SplitReport:
    """Write under a scratch folder, check, commit, and write the manifest."""
    kind, depth = ix.plan(options.index, header.longest_reference)
    out_header = header.with_program(PROGRAM, VERSION, options.command) if options.append_program else header
    fs, folder = bam.open_file(options.out_dir)
    info = fs.get_file_info(folder)
    if info.is_file:
        raise ConfigError(f"{options.out_dir} is a file")
    fs.create_dir(folder, recursive=True)
    scratch = f"{options.out_dir.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
    notes: list[str] = []
    try:
        counters = stats.run_counters(routed).first().asDict()
        reports = bam_sink.write_outputs(routing.emissions(routed), out_header, scratch, options.compression_level, kind, depth, max(options.threads, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        written = {r["key"] for r in reports}
        missing = [k for k in dict.fromkeys(declared) if k not in written]
        if options.emit_empty:
            reports += [bam_sink.write_empty(out_header, scratch, k, options.compression_level, kind, depth) for k in missing]
            missing = []
        names = {k.decode("utf-8"): n for k, n in assign_names([r["key"].encode("utf-8") for r in reports], Template(template)).items()}
        described = described or {}
        run = {
            "program": PROGRAM, "version": VERSION, "input": path, "header_checksum": header.checksum, "sort_order": header.sort_order, "mode": mode, **plan.told(),
            "index": kind, "command": options.command, **(extra or {}),
        }
        rows = [mf.output_row(r, names[r["key"]], described.get(r["key"])) for r in reports]
        rows += [mf.output_row({"key": k}, None, described.get(k)) for k in missing]
        document = mf.build(run, counters, rows, duplicating)  # raises before anything is in place
        bam_sink.commit(reports, names, options.out_dir, options.force)
        for row, r in zip(rows, reports, strict=False):
            row["file"], row["index_file"] = r["file"], r["index_file"]
            if r["index_note"]:
                notes.append(f"{r['key']}: no index, {r['index_note']}")
    finally:
        if fs.get_file_info(bam.open_file(scratch)[1]).type.name == "Directory":
            fs.delete_dir(bam.open_file(scratch)[1])
    document["notes"] = notes
    if options.manifest:
        _write_atomically(options.manifest, mf.to_json(document) if options.manifest_format == "json" else mf.to_tsv(document))
    return SplitReport(document, plan, notes)


def _write_atomically(path: str, text: str) -> None:
    fs, local = bam.open_file(path)
    own = f"{local}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as f:
        f.write(text.encode("utf-8"))
    fs.move(own, local)


def split_chrom(
    spark: SparkSession,
    path: str,
    options: RunOptions,
    unplaced: str = "keep",
    placed_unmapped: str = "by-reference",
    include: list[str] | None = None,
    reference_list: str | None = None,
    exclude: list[str] | None = None,
    ignore_unknown: bool = False,
    unmapped_key: str = "unmapped",
    template: str = "{key}.bam",
) -> SplitReport:
    header, aln = _prepare(spark, path, options, ["flag", "pos", "next_ref_id"])
    if reference_list is not None:
        include = [*(include or []), *annotation.reference_list(reference_list)]
    routing.check_reference_ids(aln, len(header.references))
    refs = header.references_frame(spark)
    selection = {"include": include, "exclude": exclude, "ignore_unknown": ignore_unknown}
    routed = routing.route_chrom(aln, refs, unplaced, placed_unmapped, unmapped_key=unmapped_key, **selection)
    declared = routing.declared_chrom_keys(refs, unplaced, placed_unmapped, unmapped_key, **selection).orderBy("position")
    return _run(spark, path, header, routed, [r["key"] for r in declared.collect()], "chrom", planner.plan(path, "chrom", options.engine, options.io), options, template)


def _tagged(aln: DataFrame, tag: str, arrays: bool = True) -> DataFrame:
    return aln.withColumn("_tag", tags.tag_value(F.col("aux"), tag, arrays).cast("string"))


def split_tag(
    spark: SparkSession,
    path: str,
    options: RunOptions,
    tag: str | None = None,
    field: str | None = None,
    missing: str = "file",
    unknown: str = "file",
    missing_key: str = "no-tag",
    allow_arrays: bool = False,
    max_outputs: int | None = 1000,
) -> SplitReport:
    if (tag is None) == (field is None):
        raise ConfigError("give a tag or a read-group field, not both")
    header, aln = _prepare(spark, path, options, ["flag", "pos", "aux"])
    if tag is not None:
        routed = routing.route_tag(_tagged(aln, tag, allow_arrays), "_tag", missing, missing_key, max_outputs)
        declared = [missing_key] if missing == "file" else []
    else:
        groups = header.read_groups_frame(spark)
        with_rg = _tagged(aln, "RG", False).withColumnRenamed("_tag", "rg")
        routed = routing.route_read_group(with_rg, groups, field, missing, unknown, missing_key, max_outputs)
        declared = [r["key"] for r in routing.declared_tag_keys(groups, field, missing, unknown, missing_key).orderBy("key").collect()]
    return _run(spark, path, header, routed, declared, "tag", planner.plan(path, "tag", options.engine, options.io), options)


def split_shard(
    spark: SparkSession,
    path: str,
    options: RunOptions,
    shards: int,
    key: str = "qname",
    seed: int = hashing.DEFAULT_SEED,
    width: int | None = None,
    missing: str = "file",
    missing_key: str = "no-key",
) -> SplitReport:
    """``key``: qname, record, tag:XX, or a read-group field."""
    header, aln = _prepare(spark, path, options, ["flag", "pos", "qname", "aux"])
    reason = "missing-tag"
    if key in ("qname", "record"):
        value = F.col("qname" if key == "qname" else "body")
    elif key.startswith("tag:"):
        aln, value = _tagged(aln, key[4:]), F.col("_tag")
    elif key in routing.READ_GROUP_FIELDS:
        with_rg = _tagged(aln, "RG", False).withColumnRenamed("_tag", "rg")
        aln, value, reason = routing.with_read_group(with_rg, header.read_groups_frame(spark), key), F.col("_value"), "unknown-read-group"
    else:
        raise ConfigError(f"unknown shard key {key!r}")
    routed = routing.route_shard(aln, value, shards, seed, width, missing, missing_key, reason)
    declared = [r["key"] for r in routing.declared_shard_keys(spark, shards, width, missing, missing_key).orderBy("key").collect()]
    return _run(spark, path, header, routed, declared, "shard", planner.plan(path, "shard", options.engine, options.io), options)


def split_region(
    spark: SparkSession,
    path: str,
    options: RunOptions,
    regions_file: str | None = None,
    window: str | None = None,
    feature: str = "span",
    assignment: str = "start",
    geometry: str = "blocks",
    missing: str = "skip",
    require_blocks: bool = False,
    prefix: str = "region",
    name_field: str | None = None,
    format: str | None = None,
    bed_width: int | None = None,
    unmatched: str = "drop",
    unmatched_key: str = "unmatched",
) -> SplitReport:
    if (regions_file is None) == (window is None):
        raise ConfigError("give a regions file or a window size, not both")
    if unmatched not in ("drop", "file"):
        raise ConfigError("unmatched records are dropped or filed")
    header, _ = bam.read_header(path)
    refs = header.references_frame(spark)
    if window is not None:
        places = regions.windows(refs, regions.parse_window_size(window)).select("*", F.lit(None).cast("string").alias("strand"))
    else:
        records, found = annotation.load(spark, regions_file, format, bed_width)
        places = features.extract(records, feature, missing, found.gxf, require_blocks, prefix, name_field)
    if not places.limit(1).count():
        raise ConfigError("there are no regions")
    regions.check_shared_names(refs, places)
    listed = places.orderBy("ordinal").select("key", "chrom", "env_start", "env_end", "strand").collect()
    # records that match nothing are counted among those that are read; where they are filed, all have to be
    spots = [(r["chrom"], r["env_start"], r["env_end"]) for r in listed] if unmatched == "drop" else None
    plan = planner.plan(path, "region", options.engine, options.io, spots)
    _, aln = _prepare(spark, path, options, ["flag", "pos", "cigar"], regions=plan.places)
    if aln.filter(F.col("ref_id") >= len(header.references)).limit(1).count():
        raise ConfigError("a reference id is not in the dictionary")
    routed = regions.route_region(aln, places, assignment, geometry == "span")
    if unmatched == "file":
        lost = F.size("keys") == 0
        routed = routed.withColumn("keys", F.when(lost, F.array(F.lit(unmatched_key))).otherwise(F.col("keys"))).withColumn("drop_reason", F.lit(None).cast("string"))
    described = {r["key"]: {"chrom": r["chrom"], "start": r["env_start"], "end": r["env_end"], "strand": r["strand"]} for r in listed}
    pairs = regions.matches(aln, places, assignment, geometry == "span")
    extra = {"regions": len(listed), "assignment": assignment, "geometry": geometry, "routing": regions.routing_counts(aln, pairs, assignment).first().asDict()}
    return _run(spark, path, header, routed, list(described), "region", plan, options, duplicating=assignment == "overlap", described=described, extra=extra)


def inspect(spark: SparkSession, path: str, scan: bool = True, tag: str | None = None, regions_file: str | None = None, feature: str = "span") -> dict:
    """A report of a file (and of an annotation). A broken record ends the scan and sets ``valid`` to false."""
    header, _ = bam.read_header(path)
    out: dict = {
        "input": path, "bytes": bam.file_size(path), "sort_order": header.sort_order, "references": len(header.references), "read_groups": len(header.read_groups), "programs": len(header.lines("PG")),
        "header_checksum": header.checksum, "longest_reference": header.longest_reference, "eof_marker": bam.has_marker(path), "index_file": bam.find_index(path),
        "planned_index": ix.plan("auto", header.longest_reference)[0], "plan": {m: planner.plan(path, m).told() for m in ("chrom", "shard", "tag", "region")},
    }
    if out["index_file"]:
        try:
            bam.load_index(path, header)
            out["index_usable"] = True
        except IndexError_:
            out["index_usable"] = False
    if scan:
        out |= _scan(spark, path, header, tag)
    if regions_file:
        out["annotation"] = inspect_annotation(spark, regions_file, header, feature)
    return out


def _scan(spark: SparkSession, path: str, header: Header, tag: str | None) -> dict:
    aln = bam.read_bam(spark, path, ["flag", "pos", "n_bytes", "aux"] if tag else ["flag", "pos", "n_bytes"], permissive=True)
    refs = header.references_frame(spark)
    counters = aln.agg(*stats.record_counters()).first().asDict()
    out = {
        "valid": True,
        "counters": counters,
        "estimated_temp_bytes": counters["n_bytes"],
        "per_reference": [r.asDict() for r in stats.per_reference(aln, refs).orderBy("ref_id").collect()],
        "order_violations": stats.order_violations(aln).count(),
    }
    out["coordinate_sorted"] = out["order_violations"] == 0
    try:
        bam.read_bam(spark, path, ["voffset"]).agg(F.count("*")).first()
    except Exception as e:  # noqa: BLE001  whatever Spark wraps a record's error in
        if "Record" not in str(e) and "BGZF" not in str(e):
            raise
        out["valid"] = False
    if tag:
        good = tags.tags_valid(F.col("aux"))
        out["malformed_tags"] = aln.filter(~good).count()
        out["tag"] = stats.distinct_values(_tagged(aln.filter(good), tag), "_tag").first().asDict()
    out["predicted_outputs"] = len(out["per_reference"]) + (counters["unplaced"] > 0)
    return out


def inspect_annotation(spark: SparkSession, path: str, header: Header, feature: str) -> dict:
    records, found = annotation.load(spark, path)
    places = features.extract(records, feature, "skip", found.gxf)
    refs = header.references_frame(spark)
    ours, theirs = regions.name_differences(refs, places)
    return {
        "detection": asdict(found),
        "counts": features.extraction_counts(records, feature, found.gxf).first().asDict(),
        "overlapping_pairs": regions.overlapping_pairs(places).count(),
        "coverage": regions.coverage(places, refs).first().asDict(),
        "only_in_header": [r["name"] for r in ours.collect()],
        "only_in_annotation": [r["name"] for r in theirs.collect()],
    }


__all__ = ["HeaderError", "LaneError", "RunOptions", "SplitReport", "inspect", "split_chrom", "split_region", "split_shard", "split_tag"]
