"""Command line: ``python -m laneweave.cli chrom|shard|tag|region|inspect INPUT ...``; exit codes as in :mod:`errors`."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys

from . import api
from .errors import Interrupted, LaneError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="laneweave")
    commands = p.add_subparsers(dest="command", required=True)
    run = argparse.ArgumentParser(add_help=False)
    run.add_argument("input", help="a BAM file, or - for standard input")
    run.add_argument("-o", "--output-dir", default=".")
    run.add_argument("--force", action="store_true")
    run.add_argument("--threads", type=int, default=1)
    run.add_argument("--compression-level", type=int, default=6)
    run.add_argument("--engine", default="auto")
    run.add_argument("--io", default="auto")
    run.add_argument("--index", default="auto")
    run.add_argument("--emit-empty", action="store_true")
    run.add_argument("--no-pg", action="store_true")
    run.add_argument("--manifest")
    run.add_argument("--manifest-format", default="json")
    run.add_argument("--no-progress", action="store_true")

    c = commands.add_parser("chrom", parents=[run])
    c.add_argument("--unplaced", default="keep")
    c.add_argument("--placed-unmapped", default="by-reference")
    c.add_argument("--include", action="append")
    c.add_argument("--exclude", action="append")
    c.add_argument("--reference-list")
    c.add_argument("--ignore-unknown", action="store_true")
    c.add_argument("--unmapped-name", default="unmapped")
    c.add_argument("--filename-template", default="{key}.bam")

    s = commands.add_parser("shard", parents=[run])
    s.add_argument("--shards", type=int, required=True)
    s.add_argument("--key", default="qname")
    s.add_argument("--seed", type=lambda x: int(x, 0), default=None)
    s.add_argument("--width", type=int)
    s.add_argument("--missing", default="file")
    s.add_argument("--missing-name", default="no-key")

    t = commands.add_parser("tag", parents=[run])
    t.add_argument("--tag")
    t.add_argument("--field")
    t.add_argument("--missing", default="file")
    t.add_argument("--unknown-read-group", default="file")
    t.add_argument("--missing-name", default="no-tag")
    t.add_argument("--allow-arrays", action="store_true")
    t.add_argument("--max-outputs", type=int, default=1000)

    r = commands.add_parser("region", parents=[run])
    r.add_argument("--regions")
    r.add_argument("--window")
    r.add_argument("--format")
    r.add_argument("--type", type=int)
    r.add_argument("--feature", default="span")
    r.add_argument("--assignment", default="start")
    r.add_argument("--geometry", default="blocks", choices=("blocks", "span"))
    r.add_argument("--missing-feature", default="skip")
    r.add_argument("--require-blocks", action="store_true")
    r.add_argument("--name-prefix", default="region")
    r.add_argument("--name-field")
    r.add_argument("--unmatched", default="drop")

    i = commands.add_parser("inspect")
    i.add_argument("input")
    i.add_argument("--header-only", action="store_true")
    i.add_argument("--tag")
    i.add_argument("--regions")
    i.add_argument("--feature", default="span")
    i.add_argument("--output", default="text", choices=("text", "json"))
    return p


def _rendered(report: dict, indent: str = "") -> str:
    lines = []
    for k, v in report.items():
        if isinstance(v, dict):
            lines += [f"{indent}{k}:", _rendered(v, indent + "  ")]
        elif isinstance(v, list):
            lines.append(f"{indent}{k}: {len(v)}")
            lines += [f"{indent}  {x if not isinstance(x, dict) else ', '.join(f'{a}={b}' for a, b in x.items())}" for x in v]
        else:
            lines.append(f"{indent}{k}: {('yes' if v else 'no') if isinstance(v, bool) else '-' if v is None else v}")
    return "\n".join(lines)


def run(argv: list[str], spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("laneweave").getOrCreate()
        spark.sparkContext.setLogLevel(os.environ.get("LANEWEAVE_LOG", "ERROR").upper())
    copy = None
    try:
        path, copy = api.local_input(a.input)
        if a.command == "inspect":
            report = api.inspect(spark, path, not a.header_only, a.tag, a.regions, a.feature)
            print(json.dumps(report, indent=2) if a.output == "json" else _rendered(report))
            return 0
        options = api.RunOptions(
            a.output_dir, a.force, a.compression_level, a.threads, a.engine, a.io, a.index, a.emit_empty, not a.no_pg, a.manifest, a.manifest_format, shlex.join(["laneweave", *argv])
        )
        if a.command == "chrom":
            report = api.split_chrom(spark, path, options, a.unplaced, a.placed_unmapped, a.include, a.reference_list, a.exclude, a.ignore_unknown, a.unmapped_name, a.filename_template)
        elif a.command == "shard":
            seed = {} if a.seed is None else {"seed": a.seed}
            report = api.split_shard(spark, path, options, a.shards, a.key, width=a.width, missing=a.missing, missing_key=a.missing_name, **seed)
        elif a.command == "tag":
            report = api.split_tag(spark, path, options, a.tag, a.field, a.missing, a.unknown_read_group, a.missing_name, a.allow_arrays, a.max_outputs)
        else:
            report = api.split_region(
                spark, path, options, a.regions, a.window, a.feature, a.assignment, a.geometry, a.missing_feature, a.require_blocks, a.name_prefix, a.name_field, a.format, a.type, a.unmatched
            )
        print(f"{len(report.created_outputs)} outputs, {report.plan.scan} scan ({report.plan.reason})")
        for note in report.notes:
            print(f"note: {note}", file=sys.stderr)
        return 0
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        print("interrupted", file=sys.stderr)
        return Interrupted.exit_code
    except LaneError as e:
        print(f"error: {e.chain()}", file=sys.stderr)
        return e.exit_code
    except Exception as e:  # noqa: BLE001  errors of tasks come wrapped; their class is in the text
        text = str(e)
        for kind in ("RecordError", "TagError", "CigarError"):
            if kind in text:
                print(f"error: {next((line for line in text.splitlines() if kind in line), text)[:400]}", file=sys.stderr)
                return 3
        raise
    finally:
        if copy:
            os.unlink(copy)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
