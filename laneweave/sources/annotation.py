"""Annotation files: what they are, and their records as DataFrames.

Format, compression and BED width are told by content; the extension only
decides where the content doesn't. BED columns beyond the width become extras
``field4``, ... by their column number. GTF and GFF3 lines are joined to
transcripts: by ``transcript_id``, or by ``Parent`` (of exons and coding
parts), named so, in order of first lines, thick from coding parts.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnnotationError
from ..functions import intervals as iv
from .bam import open_file

WIDTHS = (3, 4, 5, 6, 8, 9, 12)
COLUMNS = ("chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts")
HEAD, ROWS = 64 << 10, 4096
_WHOLE = re.compile(r"[0-9]+")
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"BZh", "bzip2"))
_SUFFIX = {"gzip": ".gz", "bgzf": ".gz", "zstd": ".zst", "bzip2": ".bz2"}


@dataclass(frozen=True)
class Detection:
    format: str  # bed, gtf or gff
    compression: str  # none, gzip, bgzf, zstd or bzip2
    width: int | None = None
    extras: int = 0

    @property
    def gxf(self) -> bool:
        return self.format != "bed"


def compression_of(head: bytes) -> str:
    for magic, name in _MAGIC:
        if head.startswith(magic):
            return "bgzf" if name == "gzip" and head[3:4] == b"\x04" and head[12:14] == b"BC" else name
    return "none"


def _inflated(head: bytes, kind: str) -> bytes:
    """As much of a head as can be read; a cut end is no error."""
    if kind == "none":
        return head
    if kind == "zstd":
        import zstandard

        source = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(head), read_across_frames=True)
    else:
        source = bz2.BZ2File(io.BytesIO(head)) if kind == "bzip2" else gzip.GzipFile(fileobj=io.BytesIO(head))
    out = b""
    try:
        while len(out) < HEAD and (part := source.read(8192)):
            out += part
    except (EOFError, OSError, ValueError, Exception) as e:  # noqa: BLE001  the head ends anywhere
        if not out:
            raise AnnotationError(f"unreadable {kind} data") from e
    return out


def data_rows(text: str, whole: bool) -> list[str]:
    """Lines that are no comments, tracks or blanks; a last line that may be cut is left out."""
    lines = text.split("\n")
    if not whole and lines:
        lines.pop()
    rows = [line.rstrip("\r") for line in lines]
    return [r for r in rows if r and not r.startswith(("#", "track", "browser"))]


def _kind_of(row: str) -> str | None:
    parts = row.split("\t")
    if len(parts) == 9 and _WHOLE.fullmatch(parts[3]) and _WHOLE.fullmatch(parts[4]):
        return "gtf" if re.search(r'\b\w+ "[^"]*"', parts[8]) else "gff"
    if len(parts) >= 3 and _WHOLE.fullmatch(parts[1]) and _WHOLE.fullmatch(parts[2]):
        return "bed"
    return None


def _fits(parts: list[str], width: int) -> bool:
    number = lambda i: bool(_WHOLE.fullmatch(parts[i]))
    if len(parts) < width or not (number(1) and number(2)):
        return False
    if width >= 5 and not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?|\.", parts[4]):
        return False
    if width >= 6 and parts[5] not in ("+", "-", "."):
        return False
    if width >= 8 and not (number(6) and number(7)):
        return False
    return width < 12 or number(9) and all(re.fullmatch(r"[0-9]+(,[0-9]+)*,?", parts[i]) for i in (10, 11))


def detect(path: str, format: str | None = None, width: int | None = None) -> Detection:
    fs, local = open_file(path)
    with fs.open_input_stream(local, compression=None) as f:
        head = f.read(HEAD)
    kind = compression_of(head)
    text = _inflated(head, kind).decode("utf-8", "replace")
    rows = data_rows(text, kind == "none" and len(head) < HEAD)[:ROWS] or data_rows(text, True)[:ROWS]
    if not rows:
        raise AnnotationError(f"{path} has no records")
    if format is None:
        format = _kind_of(rows[0])
        if format is None:
            named = re.search(r"\.(bed|gtf|gff3?|gff2)(\.(gz|bgz|zst|bz2))?$", path)
            if named is None:
                raise AnnotationError(f"{path} is neither BED nor GTF nor GFF")
            format = {"bed": "bed", "gtf": "gtf", "gff2": "gtf"}.get(named[1], "gff")
    if format != "bed":
        return Detection(format, kind)
    split = [r.split("\t") for r in rows]
    n = len(split[0])
    if any(len(p) != n for p in split):
        raise AnnotationError(f"{path} has rows of different widths")
    if width is not None:
        if width not in WIDTHS or n < width:
            raise AnnotationError(f"{path} has {n} columns, BED{width} needs more")
        return Detection("bed", kind, width, n - width)
    for w in reversed(WIDTHS):
        if all(_fits(p, w) for p in split):
            return Detection("bed", kind, w, n - w)
    raise AnnotationError(f"{path} has no BED columns")


def _readable(path: str, kind: str) -> str:
    """The path, or a copy whose suffix tells the compression, as Spark's text source goes by the suffix."""
    suffix = _SUFFIX.get(kind, "")
    usual = path.endswith(suffix) if suffix else not path.endswith((".gz", ".zst", ".bz2"))
    if usual:
        return path
    fs, local = open_file(path)
    copy = f"{local}.{kind}-copy{suffix or '.txt'}"
    with fs.open_input_stream(local, compression=None) as f, fs.open_output_stream(copy, compression=None) as out:
        while part := f.read(1 << 20):
            out.write(part)
    return copy


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(ordinal, parts) of data lines, ordinals dense and in file order.

    Lines get their place in their partition's stretch, and stretches their
    start from the counts of those before: one row for each partition.
    """
    text = spark.read.text(_readable(path, kind)).filter(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    placed = text.withColumn("_id", F.monotonically_increasing_id())
    from pyspark.sql import Window

    placed = placed.withColumn("_part", F.expr("shiftright(_id, 33)"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_id")) - 1
    rows = placed.withColumn("_within", within).join(starts.select("_part", "_before"), "_part")
    return rows.select((F.col("_before") + F.col("_within")).cast("long").alias("ordinal"), F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("parts"))


def load(spark: SparkSession, path: str, format: str | None = None, width: int | None = None) -> tuple[DataFrame, Detection]:
    """Annotation records (see :mod:`..operators.features`) in file order, and what the file is."""
    found = detect(path, format, width)
    lines = _lines(spark, path, found.compression)
    return (_bed(lines, found) if found.format == "bed" else _gxf(lines, found)), found


def _bed(lines: DataFrame, found: Detection) -> DataFrame:
    w = found.width
    at = lambda i: F.get("parts", i)
    long = lambda i: at(i).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    blocks = none(iv.SET)
    if w == 12:
        sizes = F.transform(F.filter(F.split(at(10), ","), lambda x: x != ""), lambda x: x.cast("long"))
        starts = F.transform(F.filter(F.split(at(11), ","), lambda x: x != ""), lambda x: x.cast("long"))
        whole = F.zip_with(sizes, starts, lambda n, s: iv.interval(long(1) + s, long(1) + s + n))
        wrong = (F.size(sizes) != long(9)) | (F.size(starts) != long(9))
        blocks = F.when(wrong, F.raise_error(F.concat(F.lit("block counts differ in record "), F.col("ordinal"))).cast(iv.SET)).otherwise(whole)
    extras = F.map_from_entries(F.array(*[F.struct(F.lit(f"field{w + i + 1}").alias("key"), at(w + i).alias("value")) for i in range(found.extras)])) if found.extras else F.create_map().cast("map<string,string>")
    return lines.select(
        "ordinal",
        at(0).alias("chrom"),
        long(1).alias("start"),
        long(2).alias("end"),
        (at(3) if w >= 4 else none("string")).alias("name"),
        (at(5) if w >= 6 else none("string")).alias("strand"),
        (long(6) if w >= 8 else none("long")).alias("thick_start"),
        (long(7) if w >= 8 else none("long")).alias("thick_end"),
        blocks.alias("blocks"),
        extras.alias("extras"),
    )


def _gxf(lines: DataFrame, found: Detection) -> DataFrame:
    at = lambda i: F.get("parts", i)
    pattern = r'(?:^|;)\s*transcript_id\s+"([^"]*)"' if found.format == "gtf" else r"(?:^|;)\s*Parent=([^;]*)"
    own = F.regexp_extract(at(8), pattern, 1)
    rows = lines.select(
        "ordinal", at(0).alias("chrom"), at(2).alias("kind"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"), at(6).alias("strand"), own.alias("name")
    ).filter((F.col("name") != "") & F.col("kind").isin("exon", "CDS", "transcript", "mRNA"))
    exon, coding = F.col("kind") == "exon", F.col("kind") == "CDS"
    grouped = rows.groupBy("chrom", "name").agg(
        F.min("ordinal").alias("first"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("strand", "ordinal").alias("strand"),
        F.min(F.when(coding, F.col("start"))).alias("thick_start"),
        F.max(F.when(coding, F.col("end"))).alias("thick_end"),
        F.array_sort(F.collect_list(F.when(exon, F.struct("start", "end")))).alias("exons"),  # as many as a transcript has
    )
    from pyspark.sql import Window

    numbered = grouped.withColumn("ordinal", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))  # a row for each transcript
    return numbered.select(
        "ordinal", "chrom", "start", "end", "name", "strand", "thick_start", "thick_end",
        F.when(F.size("exons") > 0, F.col("exons").cast(iv.SET)).alias("blocks"), F.create_map().cast("map<string,string>").alias("extras"),
    )


def reference_list(path: str) -> list[str]:
    """Names of a list file, one a line; blank lines and those from # on are left out."""
    fs, local = open_file(path)
    with fs.open_input_stream(local) as f:
        lines = f.read().decode("utf-8").split("\n")
    names = [line.rstrip("\r").strip() for line in lines]
    return [n for n in names if n and not n.startswith("#")]
