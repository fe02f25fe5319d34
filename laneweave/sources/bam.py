"""BAM as a DataFrame: record codec and a Python data source.

A file is split at virtual offsets where its index says that records begin;
without an index it is one partition (many files are many partitions). Rows
come as Arrow batches; ``columns`` leaves out what isn't asked for, and
``regions`` reads only the chunks that an index gives for places.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CigarError, ConfigError, HeaderError, IndexError_, RecordError
from .bgzf import BgzfReader, has_eof_marker
from .header import Header
from .index import Index, candidates, merged

#: Fixed values of the format.
CORE = struct.Struct("<iiBBHHHiiii")
CORE_SIZE = 32
MAX_RECORD = 64 << 20
BATCH_ROWS = 4096
#: Compressed bytes that a partition reads, about.
SPLIT_BYTES = 32 << 20

SCHEMA = (
    "path string, voffset bigint, ordinal bigint, ref_id int, pos bigint, mapq smallint, bin int, flag int, l_seq int, next_ref_id int, next_pos bigint, tlen int, "
    "qname binary, cigar array<struct<len: bigint, op: int>>, aux binary, body binary, n_bytes bigint"
)
_CIGAR = pa.list_(pa.struct([("len", pa.int64()), ("op", pa.int32())]))
_TYPES = {
    "path": pa.string(), "voffset": pa.int64(), "ordinal": pa.int64(), "ref_id": pa.int32(), "pos": pa.int64(), "mapq": pa.int16(), "bin": pa.int32(), "flag": pa.int32(), "l_seq": pa.int32(),
    "next_ref_id": pa.int32(), "next_pos": pa.int64(), "tlen": pa.int32(), "qname": pa.binary(), "cigar": _CIGAR, "aux": pa.binary(), "body": pa.binary(), "n_bytes": pa.int64(),
}


# ---------------------------------------------------------------- records


class Record:
    """A record's body, with its parts found but not decoded."""

    __slots__ = ("body", "core", "cigar_at", "seq_at", "aux_at")

    def __init__(self, body: bytes):
        if len(body) < CORE_SIZE:
            raise RecordError(f"a record of {len(body)} bytes")
        self.body = body
        self.core = CORE.unpack_from(body)
        name, ops, l_seq = self.core[2], self.core[5], self.core[7]
        if name < 1:
            raise RecordError("an empty read name")
        if l_seq < 0:
            raise RecordError("a negative sequence length")
        self.cigar_at = CORE_SIZE + name
        self.seq_at = self.cigar_at + 4 * ops
        self.aux_at = self.seq_at + (l_seq + 1) // 2 + l_seq
        if self.aux_at > len(body):
            raise RecordError("a record's parts reach beyond its end")
        if body[self.cigar_at - 1] != 0:
            raise RecordError("a read name doesn't end with NUL")

    @property
    def ref_id(self) -> int:
        return self.core[0]

    @property
    def pos(self) -> int:
        return self.core[1]

    @property
    def flag(self) -> int:
        return self.core[6]

    @property
    def qname(self) -> bytes:
        return self.body[CORE_SIZE : self.cigar_at - 1]

    @property
    def aux(self) -> bytes:
        return self.body[self.aux_at :]

    def cigar(self) -> list[tuple[int, int]]:
        """(length, operation); a CIGAR too long for its field is taken from the CG tag."""
        n = self.core[5]
        packed = struct.unpack_from(f"<{n}I", self.body, self.cigar_at)
        ops = [(v >> 4, v & 15) for v in packed]
        if n == 2 and ops[0] == (self.core[7], 4) and ops[1][1] == 3 and self.core[7] > 0:
            from ..functions.tags import find

            held = find(self.aux, "CG")
            if held is not None:
                if held[0] != "BI":
                    raise CigarError("the CG tag is no array of 32-bit numbers")
                ops = [(int(v) >> 4, int(v) & 15) for v in held[1]]
            else:
                raise CigarError("a long CIGAR is announced, but there is no CG tag")
        if any(op > 8 for _, op in ops):
            raise CigarError("unknown CIGAR operation")
        return ops

    def span(self) -> int:
        """Reference bases, one at least."""
        return max(1, sum(n for n, op in self.cigar() if op in (0, 2, 3, 7, 8)))

    def row(self, names: list[str], path: str, voffset: int, base: int = 0) -> tuple:
        c = self.core
        got = {
            "path": path, "voffset": voffset, "ordinal": base + voffset, "ref_id": c[0], "pos": c[1], "mapq": c[3], "bin": c[4], "flag": c[6], "l_seq": c[7],
            "next_ref_id": c[8], "next_pos": c[9], "tlen": c[10], "n_bytes": len(self.body),
        }
        for n in names:
            if n == "qname":
                got[n] = self.qname
            elif n == "cigar":
                got[n] = [{"len": k, "op": op} for k, op in self.cigar()]
            elif n == "aux":
                got[n] = self.aux
            elif n == "body":
                got[n] = self.body
        return tuple(got[n] for n in names)


def encode_record(ref_id: int, pos: int, flag: int, qname: bytes, cigar: list[tuple[int, int]], seq: bytes = b"", qual: bytes = b"", aux: bytes = b"", mapq: int = 60, next_ref_id: int = -1, next_pos: int = -1, tlen: int = 0, bin_: int = 4680) -> bytes:
    """A record's body; ``seq`` is packed already, two bases a byte, ``qual`` one byte a base."""
    core = CORE.pack(ref_id, pos, len(qname) + 1, mapq, bin_, len(cigar), flag, len(qual), next_ref_id, next_pos, tlen)
    return core + qname + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + seq + qual + aux


def records(source: BgzfReader, end: int | None = None, limit: int = MAX_RECORD) -> Iterator[tuple[int, Record]]:
    """(virtual offset, record) until ``end`` or the end of the data; errors name the record's number from here."""
    number = 0
    while end is None or source.tell() < end:
        at = source.tell()
        head = source.read(4)
        if not head:
            return
        number += 1
        if len(head) < 4:
            raise RecordError("the file ends in a record's length", number)
        size = struct.unpack("<i", head)[0]
        if size < CORE_SIZE or size > limit:
            raise RecordError(f"implausible record length {size}", number)
        body = source.read(size)
        if len(body) < size:
            raise RecordError("the file ends in a record", number)
        try:
            yield at, Record(body)
        except RecordError as e:
            raise RecordError(str(e), number) from e


# ---------------------------------------------------------------- files


def open_file(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def file_size(uri: str) -> int:
    fs, path = open_file(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise ConfigError(f"{uri} is missing")
    if info.type != pafs.FileType.File:
        raise ConfigError(f"{uri} is a folder")
    return info.size


def read_header(uri: str) -> tuple[Header, int]:
    """The header and the virtual offset after it."""
    fs, path = open_file(uri)
    file_size(uri)
    with fs.open_input_file(path) as f:
        source = BgzfReader(f)
        return Header.read(source), source.tell()


def has_marker(uri: str) -> bool:
    fs, path = open_file(uri)
    with fs.open_input_file(path) as f:
        return has_eof_marker(f, file_size(uri))


def find_index(uri: str) -> str | None:
    fs, path = open_file(uri)
    for c in candidates(path):
        if fs.get_file_info(c).type == pafs.FileType.File:
            return c
    return None


def load_index(uri: str, header: Header) -> Index | None:
    found = find_index(uri)
    if found is None:
        return None
    fs, _ = open_file(uri)
    with fs.open_input_file(found) as f:
        index = Index.parse(f.read())
    if len(index.references) != len(header.references):
        raise IndexError_(f"{found} is of another file: {len(index.references)} references, the header has {len(header.references)}")
    return index


# ---------------------------------------------------------------- data source


@dataclass
class Stretch(InputPartition):
    """Virtual offsets of a file; ``base`` is that of the file's begin where all files are read as one."""

    path: str
    start: int
    end: int | None
    base: int = 0


def _bases(paths: list[str]) -> list[int]:
    sizes = [file_size(p) for p in paths]
    return [sum(sizes[:i]) << 16 for i in range(len(sizes))]


def stretches(paths: list[str], split: int) -> list[Stretch]:
    """Files whole, cut where their indexes say that records begin."""
    return [s for p, base in zip(paths, _bases(paths), strict=True) for s in _stretches(p, base, split)]


def targeted(paths: list[str], regions: list[tuple[str, int, int]], unplaced: bool) -> list[Stretch]:
    """The chunks that indexes give for regions."""
    return [s for p, base in zip(paths, _bases(paths), strict=True) for s in _targeted(p, base, regions, unplaced)]


def _stretches(path: str, base: int, split: int) -> list[Stretch]:
    header, first = read_header(path)
    index = load_index(path, header)
    cuts = [first]
    if index is not None:
        for at in index.starts():
            if at > cuts[-1] and (at >> 16) - (cuts[-1] >> 16) >= split:
                cuts.append(at)
    return [Stretch(path, a, b, base) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def _targeted(path: str, base: int, regions: list[tuple[str, int, int]], unplaced: bool) -> list[Stretch]:
    header, first = read_header(path)
    index = load_index(path, header)
    if index is None:
        raise ConfigError(f"{path} has no index to look up regions in")
    names = {name.decode("utf-8", "surrogateescape"): i for i, (name, _) in enumerate(header.references)}
    chunks = [c for name, start, end in regions if name in names for c in index.chunks(names[name], start, end)]
    out = [Stretch(path, a, b, base) for a, b in merged(chunks)]
    if unplaced and index.unplaced != 0:
        tail = max((r.last for r in index.references), default=0) or first
        out.append(Stretch(path, tail, None, base))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.names = names
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.limit = int(options.get("max_record", MAX_RECORD))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.unplaced = options.get("unplaced", "false").lower() == "true"
        self.regions = None
        if options.get("regions"):
            self.regions = [(n, int(a), int(b)) for n, a, b in (r.rsplit("\t", 2) for r in options["regions"].split("\n"))]

    def partitions(self) -> list[Stretch]:
        if self.regions is not None:
            return targeted(self.paths, self.regions, self.unplaced)
        return stretches(self.paths, self.split)

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        fs, path = open_file(part.path)
        schema = pa.schema([(n, _TYPES[n]) for n in self.names])
        with fs.open_input_file(path) as f:
            rows: list[tuple] = []
            try:
                for at, record in records(BgzfReader(f, part.start), part.end, self.limit):
                    rows.append(record.row(self.names, part.path, at, part.base))
                    if len(rows) >= BATCH_ROWS:
                        yield self._batch(rows, schema)
                        rows = []
            except RecordError:
                if not self.permissive:
                    raise
            if rows:
                yield self._batch(rows, schema)

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class BamDataSource(DataSource):
    """``spark.read.format("bam").option("columns", "ref_id,pos").load(path)``; paths are joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _names(self) -> list[str]:
        asked = self.options.get("columns")
        names = [c.strip() for c in asked.split(",")] if asked else list(_TYPES)
        if unknown := [n for n in names if n not in _TYPES]:
            raise ConfigError(f"unknown columns: {', '.join(unknown)}")
        return names

    def schema(self) -> str:
        kinds = dict(part.split(" ", 1) for part in SCHEMA.replace("struct<len: bigint, op: int>", "struct<len:bigint;op:int>").split(", "))
        return ", ".join(f"{n} {kinds[n].replace(';', ', ')}" for n in self._names())

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options), self._names())


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None, regions: list[tuple[str, int, int]] | None = None, permissive: bool = False, **options) -> DataFrame:
    """Alignments of a file, or of several with one dictionary, with their ``chrom`` (null where unplaced).

    ``ordinal`` is the virtual offset, counted on from file to file: it orders as the files do, and no two records share one.
    """
    from pyspark.sql import functions as F

    spark.dataSource.register(BamDataSource)
    reader = spark.read.format("bam")
    wanted = columns or list(_TYPES)
    for needed in ("voffset", "ordinal", "ref_id"):
        if needed not in wanted:
            wanted = [*wanted, needed]
    reader = reader.option("columns", ",".join(wanted))
    if regions is not None:
        reader = reader.option("regions", "\n".join(f"{n}\t{a}\t{b}" for n, a, b in regions) or "\t0\t0")
    if permissive:
        reader = reader.option("mode", "permissive")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    df = reader.load(path)
    first, *others = [p for p in path.split(",") if p]
    header, _ = read_header(first)
    for other in others:
        if read_header(other)[0].references != header.references:
            raise HeaderError(f"{other} has another reference dictionary than {first}")
    names = header.references_frame(spark).select("ref_id", F.col("name").alias("chrom"))
    return df.join(names, "ref_id", "left")
