"""The account of a run: one document, and a table with a row for each output."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from .operators.stats import check_conservation

TSV_COLUMNS = (
    "key", "resolved_key", "key_hex", "file", "index_file", "skipped", "total", "mapped", "placed_unmapped", "unplaced", "primary", "secondary", "supplementary",
    "n_bytes", "file_bytes", "coordinate_sorted", "digest",
)


def timestamp(at: datetime | None = None) -> str:
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def output_row(report: dict, name: str | None, region: dict | None = None) -> dict:
    """A row of an output, written or skipped."""
    row = {k: report.get(k) for k in ("total", "mapped", "placed_unmapped", "unplaced", "primary", "secondary", "supplementary", "duplicate", "qc_fail", "n_bytes", "file_bytes", "coordinate_sorted", "digest", "index_note")}
    key = report["key"]
    first = [report.get("first_ref"), report.get("first_pos")]
    last = [report.get("last_ref"), report.get("last_pos")]
    return {
        "key": key,
        "key_hex": key.encode("utf-8").hex(),
        "resolved_key": None if name is None else name.removesuffix(".bam"),
        "file": report.get("file"),
        "index_file": report.get("index_file"),
        "skipped": name is None,
        "first": first if first[0] is not None else None,
        "last": last if last[0] is not None else None,
        **row,
        **({"region": region} if region else {}),
    }


def build(run: dict, counters: dict, outputs: list[dict], duplicating: bool) -> dict:
    """A checked manifest; counts that don't add up raise."""
    check_conservation(counters, [o for o in outputs if not o["skipped"]], duplicating)
    return {**run, "created": timestamp(), "counters": counters, "outputs": outputs}


def to_json(manifest: dict) -> str:
    return json.dumps(manifest, indent=2, sort_keys=False)


def to_tsv(manifest: dict) -> str:
    def cell(v) -> str:
        return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v).replace("\t", " ").replace("\n", " ")

    lines = ["\t".join(TSV_COLUMNS)]
    lines += ["\t".join(cell(o.get(c)) for c in TSV_COLUMNS) for o in manifest["outputs"]]
    return "\n".join(lines) + "\n"
