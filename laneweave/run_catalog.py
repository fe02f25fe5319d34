"""Queries of whole runs over alignment and annotation files, with their SQL counterparts.

Each query writes a file from the views of :mod:`lens` under a scratch folder,
runs over it, and tells what came out; :mod:`catalog` registers them.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, lens
from .catalog import _CHROM_KEY, _query, _with
from .errors import CardinalityError
from .functions import cigar as cg
from .functions import hashing, keys, tags
from .operators import regions, routing
from .scratch import fresh_folder
from .sources import annotation, bam, bam_sink
from .sources.header import Header

WINDOW = 7000
#: Places of the lookup query: name, begin, end.
PLACE = ("chr1", 2000, 9000)


# ---------------------------------------------------------------- files


def _header(spark: SparkSession, sf_dir: str) -> Header:
    lines = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:chr{i}\tLN:{lens.LENGTH}" for i in range(lens.REFERENCES)]]
    for g in lens.read_groups(spark, sf_dir).orderBy("id").collect():  # as many as nations
        lines.append(f"@RG\tID:{g['id']}\tLB:{g['library']}" + (f"\tSM:{g['sample']}" if g["sample"] else ""))
    lines.append("@PG\tID:aligner\tPN:aligner")
    return Header("".join(f"{x}\n" for x in lines), [(f"chr{i}".encode(), lens.LENGTH) for i in range(lens.REFERENCES)])


def _alignment_file(spark: SparkSession, sf_dir: str) -> str:
    """The view's records in one indexed file by coordinate; read group in RG, ordinal in XO."""

    @F.arrow_udf("binary")
    def body(own: pa.Array, ref_id: pa.Array, pos: pa.Array, flag: pa.Array, qname: pa.Array, cigar: pa.Array, rg: pa.Array) -> pa.Array:
        out = []
        for o, r, p, f, q, ops, g in zip(*(c.to_pylist() for c in (own, ref_id, pos, flag, qname, cigar, rg)), strict=True):
            aux = (b"" if g is None else b"RGZ" + g.encode() + b"\0") + b"XOi" + struct.pack("<i", o)
            out.append(bam.encode_record(r, p, f, q.encode(), [(c["len"], c["op"]) for c in ops], aux=aux))
        return pa.array(out, pa.binary())

    aln = lens.alignments(spark, sf_dir)
    place = F.when(F.col("ref_id") < 0, lens.REFERENCES).otherwise(F.col("ref_id")).cast("long") * (2 * lens.LENGTH) + F.greatest(F.col("pos"), F.lit(0))
    ordered = aln.select(F.lit("all").alias("key"), F.struct(place.alias("place"), "ordinal").alias("at"), body("ordinal", "ref_id", "pos", "flag", "qname", "cigar", "rg").alias("body"))
    # the writer takes a number: place and ordinal in one
    numbered = ordered.select("key", (F.col("at.place") * F.lit(1 << 40) + F.col("at.ordinal")).alias("ordinal"), "body")
    folder = fresh_folder(spark, "run-input")
    reports = bam_sink.write_outputs(numbered, _header(spark, sf_dir), folder, 1, "bai", 5)
    bam_sink.commit(reports, {"all": "all.bam"}, folder)
    return f"{folder}/all.bam"


def _options(spark: SparkSession, **more) -> api.RunOptions:
    return api.RunOptions(out_dir=fresh_folder(spark, "run-output"), compression_level=1, command="queries", **more)


def _uri(options: api.RunOptions, output: dict) -> str:
    return f"{options.out_dir}/{output['file'].rsplit('/', 1)[1]}"


def _records(spark: SparkSession, options: api.RunOptions, report: api.SplitReport) -> DataFrame:
    """Key and ordinal of all records in a run's outputs, read back."""
    made = [(o["key"], o["file"].rsplit("/", 1)[1]) for o in report.created_outputs]
    back = bam.read_bam(spark, ",".join(_uri(options, o) for o in report.created_outputs), ["path", "aux"])
    own = back.select(F.element_at(F.split("path", "/"), -1).alias("name"), tags.tag_value(F.col("aux"), "XO").cast("string").cast("long").alias("own"))
    names = F.broadcast(spark.createDataFrame(made, "key string, name string"))  # as many as outputs, which a run bounds
    return own.join(names, "name").select("key", F.col("own").alias("ordinal"))


# ---------------------------------------------------------------- runs


@_query("run_chrom", _with(f"SELECT {_CHROM_KEY} AS key, ordinal FROM aln"))
def run_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _options(spark)
    return _records(spark, options, api.split_chrom(spark, _alignment_file(spark, sf_dir), options))


_MANIFEST = ("key", "resolved_key", "skipped", "total", "mapped", "placed_unmapped", "unplaced", "primary", "secondary", "supplementary", "duplicate", "qc_fail", "coordinate_sorted")


@_query(
    "run_manifest",
    _with(
        f"""SELECT k.key, k.key AS resolved_key, false AS skipped, count(ordinal) AS total, count(ordinal) FILTER (ref_id >= 0 AND flag & 4 = 0) AS mapped,
count(ordinal) FILTER (ref_id >= 0 AND flag & 4 <> 0) AS placed_unmapped, count(ordinal) FILTER (ref_id < 0) AS unplaced, count(ordinal) FILTER (flag & 2304 = 0) AS "primary",
count(ordinal) FILTER (flag & 256 <> 0) AS secondary, count(ordinal) FILTER (flag & 256 = 0 AND flag & 2048 <> 0) AS supplementary,
count(ordinal) FILTER (flag & 1024 <> 0) AS duplicate, count(ordinal) FILTER (flag & 512 <> 0) AS qc_fail, true AS coordinate_sorted
FROM (SELECT name AS key FROM refs UNION ALL SELECT 'unmapped') k LEFT JOIN (SELECT *, {_CHROM_KEY} AS key FROM aln) a ON a.key = k.key GROUP BY k.key"""
    ),
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts of a run's outputs, empty ones among them."""
    report = api.split_chrom(spark, _alignment_file(spark, sf_dir), _options(spark, emit_empty=True))
    kinds = ", ".join(f"{c} {'string' if 'key' in c else 'boolean' if c in ('skipped', 'coordinate_sorted') else 'bigint'}" for c in _MANIFEST)
    return spark.createDataFrame([tuple(o[c] for c in _MANIFEST) for o in report.manifest["outputs"]], kinds)


@_query(
    "run_skipped",
    _with("SELECT concat('chr', i) AS key, i = 5 AS skipped, CASE WHEN i <> 5 THEN concat('00_chr', i, '.bam') END AS name FROM range(4, 6) t(i) WHERE i = 5 OR EXISTS (SELECT 1 FROM aln WHERE ref_id = i)"),
)
def run_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with a template name; a declared key without records is named, not made."""
    report = api.split_chrom(spark, _alignment_file(spark, sf_dir), _options(spark), unplaced="drop", include=["chr4", "chr5"], template="0{index}_{key}.bam")
    rows = [(o["key"], o["skipped"], None if o["skipped"] else o["file"].rsplit("/", 1)[1]) for o in report.manifest["outputs"]]
    return spark.createDataFrame(rows, "key string, skipped boolean, name string")


@_query("run_headers", _with(f"SELECT DISTINCT {_CHROM_KEY} AS key, {lens.REFERENCES} AS n_references, (SELECT CAST(count(*) AS INT) FROM rgs) AS n_groups, 'coordinate' AS sort_order, 'aligner,laneweave' AS programs, 'aligner' AS follows, true AS marker FROM aln"))
def run_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What outputs' headers hold: all references and groups, and one more program that follows the last."""
    options = _options(spark)
    report = api.split_chrom(spark, _alignment_file(spark, sf_dir), options)
    rows = []
    for o in report.created_outputs:
        header, _ = bam.read_header(_uri(options, o))
        header.validate()
        programs = header.lines("PG")
        rows.append((o["key"], len(header.references), len(header.read_groups), header.sort_order, ",".join(p["ID"] for p in programs), programs[-1]["PP"], bam.has_marker(_uri(options, o))))
    return spark.createDataFrame(rows, "key string, n_references int, n_groups int, sort_order string, programs string, follows string, marker boolean")


@_query("run_tag", _with("SELECT rg AS key, ordinal FROM aln WHERE rg IS NOT NULL"))
def run_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _options(spark)
    return _records(spark, options, api.split_tag(spark, _alignment_file(spark, sf_dir), options, tag="RG", missing="drop"))


@_query("run_tag_field", _with("SELECT coalesce(sample, 'no-tag') AS key, ordinal FROM aln LEFT JOIN rgs ON aln.rg = rgs.id"))
def run_tag_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _options(spark)
    return _records(spark, options, api.split_tag(spark, _alignment_file(spark, sf_dir), options, field="sample"))


@_query("run_region_windows", _with(f"SELECT concat(chrom, ':', pos // {WINDOW} * {WINDOW} + 1, '-', least((pos // {WINDOW} + 1) * {WINDOW}, {lens.LENGTH})) AS key, ordinal FROM aln WHERE ref_id >= 0"))
def run_region_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _options(spark)
    return _records(spark, options, api.split_region(spark, _alignment_file(spark, sf_dir), options, window=str(WINDOW)))


@_query("tag_guard", _with("SELECT CAST(m AS INT) AS most, (SELECT count(DISTINCT rg) FROM aln) <= m AS passes FROM (VALUES (1), (29), (30), (31), (1000)) t(m)"))
def tag_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which limits of outputs the tag's values keep to."""
    aln = lens.alignments(spark, sf_dir)

    def passes(most: int) -> bool:
        try:
            routing.admit(aln, "rg", most)
        except CardinalityError:
            return False
        return True

    return spark.createDataFrame([(m, passes(m)) for m in (1, 29, 30, 31, 1000)], "most int, passes boolean")


# ---------------------------------------------------------------- shards

# Fixed values of the public XXH3 algorithm (64 bits, inputs of 1 to 8 bytes): the secret's first 24 bytes, and multipliers.
_SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db")
_MIX, _PRIME2, _PRIME3 = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_WORD = 1 << 64


def _shard_sql(key: str, rows: str, shards: int) -> str:
    """WITH items ending in ``sharded``: rows with a column ``shard`` for a text column of 1 to 8 ASCII characters."""
    seed = hashing.DEFAULT_SEED
    low = seed & 0xFFFFFFFF
    turned = seed ^ int.from_bytes(low.to_bytes(4, "little"), "big") << 32
    secret = lambda at, n: int.from_bytes(_SECRET[at : at + n], "little")
    long_flip = ((secret(8, 8) ^ secret(16, 8)) - turned) % _WORD
    short_flip = ((secret(0, 4) ^ secret(4, 4)) + seed) % _WORD
    u = lambda v: f"{v}::UHUGEINT"
    byte = lambda at: f"ascii(substr(k, {at}, 1))::UHUGEINT"
    four = lambda at: "(" + " + ".join(f"{byte(f'{at} + {i}')} * {256**i}" for i in range(4)) + ")"
    turn = lambda n: f"(h * {u(1 << n)} % {u(_WORD)} + h // {u(1 << 64 - n)})"
    shifted = lambda n: f"xor(h, h // {u(1 << n)})"
    times = lambda x, m: f"{x} * {u(m)} % {u(_WORD)}"
    return f"""x0 AS (SELECT *, {key} AS k, length({key}) AS n FROM {rows}),
x1 AS (SELECT *, CASE WHEN n >= 4 THEN xor({four('n - 3')} + {four('1')} * {u(1 << 32)}, {u(long_flip)})
  ELSE xor({byte('1')} * 65536 + {byte('n // 2 + 1')} * 16777216 + {byte('n')} + n::UHUGEINT * 256, {u(short_flip)}) END AS h FROM x0),
x2 AS (SELECT * REPLACE (CASE WHEN n >= 4 THEN {times(f'xor(xor(h, {turn(49)}), {turn(24)})', _MIX)} ELSE {times(shifted(33), _PRIME2)} END AS h) FROM x1),
x3 AS (SELECT * REPLACE (CASE WHEN n >= 4 THEN {times(f'xor(h, h // {u(1 << 35)} + n::UHUGEINT)', _MIX)} ELSE {times(shifted(29), _PRIME3)} END AS h) FROM x2),
sharded AS (SELECT *, CAST(CASE WHEN n >= 4 THEN {shifted(28)} ELSE {shifted(32)} END % {shards} AS INT) AS shard FROM x3)"""


_SHARD_KEY = "CASE WHEN k IS NULL THEN 'no-key' ELSE concat('shard-', lpad(CAST(shard AS VARCHAR), 4, '0')) END AS key"


@_query("shard_numbers", _with(f"SELECT {_SHARD_KEY}, count(*) AS n FROM sharded GROUP BY 1", more=_shard_sql("qname", "aln", 16)))
def shard_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.emissions(routing.route_shard(lens.alignments(spark, sf_dir), F.col("qname"), 16))
    return routed.groupBy("key").agg(F.count("*").alias("n"))


def _shard_run(name: str, key: str, column: str, rows: str = "aln") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = _options(spark)
        return _records(spark, options, api.split_shard(spark, _alignment_file(spark, sf_dir), options, 5, key))

    _query(name, _with(f"SELECT {_SHARD_KEY}, ordinal FROM sharded", more=_shard_sql(column, rows, 5)))(run)


_shard_run("run_shard_qname", "qname", "qname")
_shard_run("run_shard_tag", "tag:RG", "rg")
_shard_run("run_shard_field", "sample", "sample", "(SELECT ordinal, sample FROM aln LEFT JOIN rgs ON aln.rg = rgs.id)")


# ---------------------------------------------------------------- looking into files

_INSPECTED = """SELECT unnest([
  {'metric': 'references', 'value': (SELECT count(*) FROM refs)}, {'metric': 'read_groups', 'value': (SELECT count(*) FROM rgs)}, {'metric': 'programs', 'value': 1},
  {'metric': 'longest_reference', 'value': (SELECT max(length) FROM refs)}, {'metric': 'order_violations', 'value': 0}, {'metric': 'malformed_tags', 'value': 0},
  {'metric': 'predicted_outputs', 'value': (SELECT count(DISTINCT ref_id) FROM aln)}, {'metric': 'valid', 'value': 1}, {'metric': 'coordinate_sorted', 'value': 1},
  {'metric': 'eof_marker', 'value': 1}, {'metric': 'index_usable', 'value': 1}, {'metric': 'total', 'value': (SELECT count(*) FROM aln)},
  {'metric': 'mapped', 'value': (SELECT count(*) FROM aln WHERE ref_id >= 0 AND flag & 4 = 0)}, {'metric': 'unplaced', 'value': (SELECT count(*) FROM aln WHERE ref_id < 0)},
  {'metric': 'secondary', 'value': (SELECT count(*) FROM aln WHERE flag & 256 <> 0)}, {'metric': 'duplicate', 'value': (SELECT count(*) FROM aln WHERE flag & 1024 <> 0)}], recursive := true)"""


@_query("inspect_file", _with(_INSPECTED))
def inspect_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look into a file tells, as numbers."""
    told = api.inspect(spark, _alignment_file(spark, sf_dir), tag="RG")
    names = ("references", "read_groups", "programs", "longest_reference", "order_violations", "malformed_tags", "predicted_outputs", "valid", "coordinate_sorted", "eof_marker", "index_usable")
    rows = [(n, int(told[n])) for n in names] + [(n, int(told["counters"][n])) for n in ("total", "mapped", "unplaced", "secondary", "duplicate")]
    return spark.createDataFrame(rows, "metric string, value bigint")

@_query(
    "indexed_lookup",
    _with(f"SELECT ordinal, true AS fewer FROM aln WHERE chrom = '{PLACE[0]}' AND flag & 4 = 0 AND pos < {PLACE[2]} AND (blocks[-1])['end'] > {PLACE[1]}"),
)
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at a place by index lookup; ``fewer`` tells that the scan left out other records of the file."""
    path = _alignment_file(spark, sf_dir)
    found = bam.read_bam(spark, path, ["flag", "pos", "cigar", "aux"], regions=[PLACE])
    fewer = found.count() < bam.read_bam(spark, path, ["voffset"]).count()
    here = (F.col("chrom") == PLACE[0]) & (F.col("flag").bitwiseAND(4) == 0) & (F.col("pos") < PLACE[2]) & (cg.alignment_end(F.col("pos"), F.col("cigar")) > PLACE[1])
    return found.filter(here).select(tags.tag_value(F.col("aux"), "XO").cast("string").cast("long").alias("ordinal"), F.lit(fewer).alias("fewer"))


@_query("unplaced_tail", _with("SELECT ordinal FROM aln WHERE ref_id < 0"))
def unplaced_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a place, read from where the index knows that placed ones end."""
    tail = bam.read_bam(spark, _alignment_file(spark, sf_dir), ["aux"], regions=[], unplaced=True)
    return tail.filter("ref_id < 0").select(tags.tag_value(F.col("aux"), "XO").cast("string").cast("long").alias("ordinal"))


# ---------------------------------------------------------------- annotation files


def _text_file(rows: DataFrame, label: str, compression: str) -> str:
    """Rows (at, line) as one text file in the order of ``at``; its path. One file is one task's."""
    spark = rows.sparkSession
    folder = f"{fresh_folder(spark, label)}/lines"
    rows.repartition(1).sortWithinPartitions("at").select("line").write.option("compression", compression).text(folder)
    return spark.read.text(folder).select(F.input_file_name()).first()[0]


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.annotation(spark, sf_dir).withColumn("exons", F.coalesce("blocks", F.array(F.struct("start", "end"))))


_BLOCK_TEXT = "list_aggregate(list_transform({}, lambda b: concat(b.start, '-', b.\"end\")), 'string_agg', ',')"


@_query(
    "annotation_bed",
    _with(
        f"""SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, chrom, start, "end", coalesce(name, '.') AS name, strand, coalesce(thick_start, start) AS thick_start,
greatest(coalesce(thick_end, start), start) AS thick_end, {_BLOCK_TEXT.format("exons")} AS blocks, concat('x', ordinal) AS extra, 'bed 12 gzip' AS found FROM ann"""
    ),
)
def annotation_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed BED file of twelve columns and one more, told by its content and read."""
    c = F.col
    sizes = F.array_join(F.transform("exons", lambda b: b["end"] - b["start"]), ",")
    starts = F.array_join(F.transform("exons", lambda b: b["start"] - c("start")), ",")
    thick_end = F.greatest(F.coalesce("thick_end", "start"), c("start"))
    line = F.concat_ws("\t", "chrom", "start", "end", F.coalesce("name", F.lit(".")), F.lit("0"), "strand", F.coalesce("thick_start", "start"), thick_end, F.lit("0"), F.size("exons"), sizes, starts, F.concat(F.lit("x"), c("ordinal")))
    path = _text_file(_exons(spark, sf_dir).select(c("ordinal").alias("at"), line.alias("line")), "bed", "gzip")
    rows, found = annotation.load(spark, path)
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws("-", b["start"], b["end"])), ",")
    told = f"{found.format} {found.width} {found.compression}"
    return rows.select("ordinal", "chrom", "start", "end", "name", "strand", "thick_start", "thick_end", text.alias("blocks"), c("extras")["field13"].alias("extra"), F.lit(told).alias("found"))


_CODING = "thick_end > thick_start"


def _gxf_sql(found: str) -> str:
    return _with(
        f"""SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, chrom, start, "end", concat('tx', ordinal) AS name, strand, CASE WHEN {_CODING} THEN thick_start END AS thick_start,
CASE WHEN {_CODING} THEN thick_end END AS thick_end, {_BLOCK_TEXT.format("exons")} AS blocks, '{found} none' AS found FROM ann"""
    )


def _gxf_query(name: str, form: str, attribute: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col
        own = F.format_string(attribute, c("ordinal"))
        part = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        exons = F.transform("exons", lambda b: part("exon", b["start"], b["end"]))
        coding = F.when(F.expr(_CODING), F.array(part("CDS", c("thick_start"), c("thick_end")))).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
        lines = _exons(spark, sf_dir).select("ordinal", "chrom", "strand", own.alias("own"), F.posexplode(F.concat(exons, coding)).alias("nth", "part"))
        line = F.concat_ws("\t", "chrom", F.lit("view"), "part.kind", c("part.start") + 1, "part.end", F.lit("."), "strand", F.lit("."), "own")
        path = _text_file(lines.select(F.struct("ordinal", "nth").alias("at"), line.alias("line")), form, "none")
        rows, found = annotation.load(spark, path)
        text = F.array_join(F.transform("blocks", lambda b: F.concat_ws("-", b["start"], b["end"])), ",")
        told = F.lit(f"{found.format} {found.compression}")
        return rows.select("ordinal", "chrom", "start", "end", "name", "strand", "thick_start", "thick_end", text.alias("blocks"), told.alias("found"))

    _query(name, _gxf_sql(form))(run)


_gxf_query("annotation_gtf", "gtf", 'gene_id "g"; transcript_id "tx%d";')
_gxf_query("annotation_gff", "gff", "ID=part;Parent=tx%d")


# ---------------------------------------------------------------- names and sizes


@_query(
    "filename_decode",
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN 'CON' WHEN p_partkey % 11 = 2 THEN concat('a/b ', p_partkey, '.') ELSE concat('chr', p_partkey, '*ok~é') END AS key, "
    "CASE WHEN p_partkey % 3 = 0 THEN concat('a/', p_partkey) END AS other FROM part",
)
def filename_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys through their names and back; a name with a broken escape has no key."""

    @F.arrow_udf("string")
    def decoded(names: pa.Array) -> pa.Array:
        found = (keys.decode_key(n) for n in names.to_pylist())
        return pa.array([None if k is None else k.decode("utf-8") for k in found], pa.string())

    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS k",
        "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN 'CON' WHEN p_partkey % 11 = 2 THEN concat('a/b ', p_partkey, '.') ELSE concat('chr', p_partkey, '*ok~é') END AS key",
        "CASE p_partkey % 3 WHEN 0 THEN concat('a%2f', p_partkey) WHEN 1 THEN concat('a%2', chr(103), p_partkey) ELSE 'a%' END AS name",
    )
    return part.select("k", decoded(keys.encoded(F.col("key"))).alias("key"), decoded("name").alias("other"))


_COMPONENTS = "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN concat('a/', p_partkey) WHEN 3 THEN 'nul.bam' WHEN 4 THEN concat(p_partkey, '.') WHEN 5 THEN concat('a', chr(10), 'b') WHEN 6 THEN 'COM1' ELSE concat('n', p_partkey, '.bam') END"


@_query("safe_components", "SELECT p_partkey AS k, p_partkey % 9 >= 7 AS safe FROM part")
def safe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("boolean")
    def safe(names: pa.Array) -> pa.Array:
        return pa.array([keys.is_safe_component(n) for n in names.to_pylist()])

    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), safe(F.expr(_COMPONENTS)).alias("safe"))


@_query("template_names", "SELECT p_brand AS key, concat('{', row_number() OVER (ORDER BY p_brand) - 1, '}-', replace(p_brand, '#', '%23'), '.bam') AS name FROM (SELECT DISTINCT p_brand FROM part)")
def template_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs by a template, in output order (brands are few)."""
    brands = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().orderBy("p_brand").collect()]
    names = keys.assign_names([b.encode() for b in brands], keys.Template("{{{index}}}-{key}.bam"))
    return spark.createDataFrame([(k.decode(), n) for k, n in names.items()], "key string, name string")


_SIZES = "SELECT DISTINCT concat(p_size, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'M' ELSE 'g' END) AS text, {} AS size FROM part"


@_query("window_sizes", _SIZES.format("CAST(p_size AS BIGINT) * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END"))
def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sizes as text and as bases (the sizes of parts are few)."""
    part = spark.sql(_SIZES.format("0").replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    texts = [r["text"] for r in part.collect()]
    return spark.createDataFrame([(t, regions.parse_window_size(t)) for t in texts], "text string, size bigint")
