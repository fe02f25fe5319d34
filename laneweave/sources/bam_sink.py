"""One BAM file for each key, in record order, with indexes and counters.

Emissions are dealt to partitions by key and sorted by (key, ordinal); a task
writes its keys one after the other, so it has one output open at a time.
Files go to a folder of the run under the output folder, under names of the
attempt; the driver checks the reports and then renames, indexes before files.
Nothing is in place unless all tasks succeeded.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutputError, RecordError
from ..functions.keys import encode_key
from ..operators.routing import FLAG_DUPLICATE, FLAG_QC_FAIL, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, FLAG_UNMAPPED
from . import index as ix
from .bam import Record, open_file
from .bgzf import BgzfWriter
from .header import Header

REPORT = (
    "key string, file string, index_file string, first_ordinal bigint, total bigint, mapped bigint, placed_unmapped bigint, unplaced bigint, primary bigint, secondary bigint, "
    "supplementary bigint, duplicate bigint, qc_fail bigint, n_bytes bigint, file_bytes bigint, coordinate_sorted boolean, digest string, index_note string, "
    "first_ref int, first_pos bigint, last_ref int, last_pos bigint"
)
_FIELDS = [part.rsplit(" ", 1)[0] for part in REPORT.split(", ")]


class RecordWriter:
    """One output: header, bodies as they are, end marker; counts, digest and index along the way."""

    def __init__(self, fs: pafs.FileSystem, path: str, header: Header, level: int, index_kind: str | None, depth: int):
        self.fs, self.path, self.kind = fs, path, index_kind
        self.out = fs.open_output_stream(path)
        self.bgzf = BgzfWriter(self.out, level)
        self.bgzf.write(header.to_bytes())
        self.builder = ix.Builder(len(header.references), depth) if index_kind else None
        self.counts = dict.fromkeys(("total", "mapped", "placed_unmapped", "unplaced", "primary", "secondary", "supplementary", "duplicate", "qc_fail", "n_bytes"), 0)
        self.digest = xxhash.xxh3_64()
        self.first: tuple[int, int] | None = None
        self.last: tuple[int, int] | None = None
        self.sorted = True

    def write(self, body: bytes) -> None:
        record = Record(body)
        begin = self.bgzf.tell()
        self.bgzf.write(struct.pack("<i", len(body)) + body)
        flag, placed, unmapped = record.flag, record.ref_id >= 0, bool(record.flag & FLAG_UNMAPPED)
        c = self.counts
        c["total"] += 1
        c["mapped" if placed and not unmapped else "placed_unmapped" if placed else "unplaced"] += 1
        c["secondary" if flag & FLAG_SECONDARY else "supplementary" if flag & FLAG_SUPPLEMENTARY else "primary"] += 1
        c["duplicate"] += bool(flag & FLAG_DUPLICATE)
        c["qc_fail"] += bool(flag & FLAG_QC_FAIL)
        c["n_bytes"] += len(body)
        self.digest.update(struct.pack("<Q", len(body)) + body)
        if placed:
            at = (record.ref_id, record.pos)
            if self.last is not None and at < self.last:
                self.sorted = False
            self.first = self.first or at
            self.last = at
        if self.builder and not self.builder.abandoned:
            end = record.pos + (1 if unmapped else record.span())
            self.builder.add(record.ref_id, record.pos, end, not unmapped, begin, self.bgzf.tell())

    def finish(self) -> dict:
        size = self.bgzf.finish()
        self.out.close()
        index_file = note = None
        if self.builder:
            note = self.builder.abandoned
            if note is None:
                index_file = f"{self.path}.{self.kind}"
                with self.fs.open_output_stream(index_file) as f:
                    f.write(self.builder.index.to_bytes(self.kind))
        first, last = self.first or (None, None), self.last or (None, None)
        return {
            "file": self.path, "index_file": index_file, "file_bytes": size, "coordinate_sorted": self.sorted, "digest": self.digest.hexdigest(), "index_note": note,
            "first_ref": first[0], "first_pos": first[1], "last_ref": last[0], "last_pos": last[1], **self.counts,
        }


def write_outputs(emitted: DataFrame, header: Header, scratch: str, level: int = 6, index_kind: str | None = None, depth: int = 0, partitions: int | None = None) -> list[dict]:
    """Write all keys of (key, ordinal, body) under ``scratch``; a report for each, in order of first records.

    Reports are as many as outputs, which a run bounds beforehand.
    """
    spark = emitted.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = emitted.select("key", "ordinal", "body").repartition(n, "key").sortWithinPartitions("key", "ordinal")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_file(scratch)
        fs.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex
        writer, key, first, reports = None, None, None, []

        def done() -> None:
            if writer is not None:
                reports.append(writer.finish() | {"key": key, "first_ordinal": first})

        for batch in batches:
            for k, ordinal, body in zip(*(batch.column(c).to_pylist() for c in ("key", "ordinal", "body")), strict=True):
                if writer is None or k != key:
                    done()
                    key, first = k, ordinal
                    writer = RecordWriter(fs, f"{folder}/{encode_key(k.encode('utf-8'))}.{attempt}.part", header, level, index_kind, depth)
                try:
                    writer.write(body)
                except RecordError as e:
                    raise RecordError(str(e), ordinal) from e
        done()
        if reports:
            types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
            kinds = [types[part.rsplit(" ", 1)[1]] for part in REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in reports], t) for f, t in zip(_FIELDS, kinds, strict=True)], names=_FIELDS)

    rows = dealt.mapInArrow(stored, REPORT).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["first_ordinal"])


def write_empty(header: Header, scratch: str, key: str, level: int, index_kind: str | None, depth: int) -> dict:
    """A file with a header alone."""
    fs, folder = open_file(scratch)
    fs.create_dir(folder, recursive=True)
    writer = RecordWriter(fs, f"{folder}/{encode_key(key.encode('utf-8'))}.{uuid.uuid4().hex}.part", header, level, index_kind, depth)
    return writer.finish() | {"key": key, "first_ordinal": None}


def commit(reports: list[dict], names: dict[str, str], out_dir: str, force: bool = False) -> None:
    """Rename all outputs into place, each index before its file; roll back what was moved if one fails."""
    fs, folder = open_file(out_dir)
    targets = {r["key"]: f"{folder}/{names[r['key']]}" for r in reports}
    if not force:
        there = [t for t in targets.values() if fs.get_file_info(t).type != pafs.FileType.NotFound]
        if there:
            raise OutputError(f"{there[0]} exists; use force to replace it")
    moved = []
    try:
        for r in reports:
            target = targets[r["key"]]
            if r["index_file"]:
                own = f"{target}.{r['index_file'].rsplit('.', 1)[1]}"
                fs.move(r["index_file"], own)
                moved.append(own)
                r["index_file"] = own
            fs.move(r["file"], target)
            moved.append(target)
            r["file"] = target
    except OSError as e:
        for m in moved:
            fs.delete_file(m)
        raise OutputError(f"outputs can't be put in place: {e}") from e


def lossless_digest(df: DataFrame) -> DataFrame:
    """One row that equals that of any other order and split of the same records: n, and sums of hash halves."""
    h = F.conv(F.substring(F.md5("body"), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("sum_hash"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n_bytes"))
