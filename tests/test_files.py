import gzip
import json
import os
from pathlib import Path

import pytest
from alignments import GROUPS, bam_bytes, header, record, sorted_header, sorted_records

from laneweave import api, cli
from laneweave.errors import ConfigError, HeaderError, IndexError_, RecordError
from laneweave.plans import planner
from laneweave.sources import annotation, bam
from laneweave.sources.bgzf import BgzfReader
from laneweave.sources.header import Header


@pytest.fixture
def sorted_bam(tmp_path):
    path = tmp_path / "sorted.bam"
    path.write_bytes(bam_bytes(sorted_header(), sorted_records()))
    return str(path)


def bodies(path):
    with open(path, "rb") as f:
        source = BgzfReader(f)
        Header.read(source)
        return [r.body for _, r in bam.records(source)]


def outputs(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_scan(spark, sorted_bam):
    rows = bam.read_bam(spark, sorted_bam).orderBy("ordinal").collect()
    assert [bytes(r["body"]) for r in rows] == sorted_records()
    assert [r["chrom"] for r in rows] == ["chr1"] * 5 + ["chr2"] * 3 + ["chrX"] * 2 + [None] * 2
    assert bytes(rows[2]["qname"]) == b"spliced" and [tuple(c) for c in rows[2]["cigar"]] == [(5, 0), (100, 3), (5, 0)]
    assert set(bam.read_bam(spark, sorted_bam, ["pos"]).columns) == {"ref_id", "pos", "voffset", "ordinal", "chrom"}


def test_chrom_split(spark, sorted_bam, tmp_path):
    out = str(tmp_path / "out")
    report = api.split_chrom(spark, sorted_bam, api.RunOptions(out, manifest=str(tmp_path / "m.json")))
    assert outputs(out) == ["chr1.bam", "chr1.bam.bai", "chr2.bam", "chr2.bam.bai", "chrX.bam", "chrX.bam.bai", "unmapped.bam", "unmapped.bam.bai"]
    got = [b for n in ("chr1", "chr2", "chrX", "unmapped") for b in bodies(f"{out}/{n}.bam")]
    assert got == sorted_records()
    counts = {o["key"]: o["total"] for o in report.created_outputs}
    assert counts == {"chr1": 5, "chr2": 3, "chrX": 2, "unmapped": 2}
    first = bam.load_index(f"{out}/chr1.bam", Header("", [(b"a", 1)] * 3)).references[0]
    assert (first.mapped, first.unmapped) == (4, 1)
    assert json.loads((tmp_path / "m.json").read_text())["counters"]["input"] == 12
    assert bam.read_header(f"{out}/chr1.bam")[0].lines("PG")[-1]["PP"] == "aligner"
    with pytest.raises(api.LaneError):
        api.split_chrom(spark, sorted_bam, api.RunOptions(out))
    assert not [n for n in outputs(out) if n.startswith("_temporary")]
    api.split_chrom(spark, sorted_bam, api.RunOptions(out, force=True))


def test_partitions_do_not_matter(spark, sorted_bam, tmp_path):
    digests = []
    for n in ("1", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        report = api.split_chrom(spark, sorted_bam, api.RunOptions(str(tmp_path / n)))
        digests.append({o["key"]: (o["digest"], Path(o["file"]).read_bytes()) for o in report.created_outputs})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert digests[0] == digests[1]


def test_exclude_and_empty(spark, sorted_bam, tmp_path):
    report = api.split_chrom(spark, sorted_bam, api.RunOptions(str(tmp_path / "a"), emit_empty=True), unplaced="drop", exclude=["chrX"])
    assert report.manifest["counters"]["dropped"] == 4
    only = api.split_chrom(spark, sorted_bam, api.RunOptions(str(tmp_path / "b"), emit_empty=True), include=["chr1"], placed_unmapped="unmapped")
    assert {o["key"]: o["total"] for o in only.created_outputs} == {"chr1": 4, "unmapped": 3}
    with pytest.raises(ConfigError):
        api.split_chrom(spark, sorted_bam, api.RunOptions(str(tmp_path / "c")), include=["nope"])


def test_tag_and_shard(spark, sorted_bam, tmp_path):
    report = api.split_tag(spark, sorted_bam, api.RunOptions(str(tmp_path / "t")), field="sample")
    assert {o["key"]: o["total"] for o in report.created_outputs} == {"sample0": 6, "sample1": 3, "no-tag": 3}
    report = api.split_tag(spark, sorted_bam, api.RunOptions(str(tmp_path / "v")), tag="RG", missing="drop")
    assert {o["key"] for o in report.created_outputs} == {"rg0", "rg1", "unknown-group"}
    report = api.split_shard(spark, sorted_bam, api.RunOptions(str(tmp_path / "s"), emit_empty=True), 3)
    assert sum(o["total"] for o in report.created_outputs) == 12
    assert len(report.created_outputs) == 4
    by_name = {}
    for o in report.created_outputs:
        for b in bodies(o["file"]):
            by_name.setdefault(bam.Record(b).qname, set()).add(o["key"])
    assert all(len(v) == 1 for v in by_name.values())


BED12 = "chr1\t1000\t5000\tENST01\t0\t+\t1200\t4800\t0\t3\t200,300,400,\t0,1500,3600,\nchr1\t1000\t5000\tENST02\t0\t-\t1200\t4800\t0\t3\t200,300,400,\t0,1500,3600,\nchr2\t6000\t6500\tSINGLE\t0\t+\t6000\t6500\t0\t1\t500,\t0,\n"


@pytest.fixture
def region_bam(tmp_path):
    reads = [("exon1", 0, 1050, "100M"), ("spliced", 0, 1150, "50M1300N50M"), ("intronic", 0, 1500, "100M"), ("utr3", 0, 4850, "100M"), ("nowhere", 0, 9000, "100M"), ("single", 1, 6100, "100M")]
    path = tmp_path / "r.bam"
    path.write_bytes(bam_bytes(header([("chr1", 20000), ("chr2", 20000)]), [record(n, r, p, 0, c, n=100) for n, r, p, c in reads]))
    return str(path)


def test_regions(spark, region_bam, tmp_path):
    bed = tmp_path / "t.bed"
    bed.write_text(BED12)
    run = lambda name, **k: api.split_region(spark, region_bam, api.RunOptions(str(tmp_path / name)), str(bed), **k)
    report = run("a")
    assert {o["key"]: o["total"] for o in report.created_outputs} == {"ENST01": 4, "SINGLE": 1}
    assert report.manifest["counters"]["unmatched"] == 1
    assert [o["key"] for o in report.manifest["outputs"] if o["skipped"]] == ["ENST02"]
    fan = run("b", feature="exon", assignment="overlap")
    assert fan.manifest["counters"]["unmatched"] == 2 and fan.manifest["counters"]["duplicates"] > 0
    held = run("c", feature="exon", assignment="contained", unmatched="file")
    names = {o["key"]: {bam.Record(b).qname for b in bodies(o["file"])} for o in held.created_outputs}
    assert b"spliced" in names["ENST01"] and b"intronic" in names["unmatched"]
    tiles = api.split_region(spark, region_bam, api.RunOptions(str(tmp_path / "w"), emit_empty=True), window="5k")
    assert len(tiles.created_outputs) == 8 and os.path.exists(tmp_path / "w" / "chr1%3A1-5000.bam")


def test_index_reads_less_and_the_same(spark, tmp_path):
    rows = [record(f"r{i}", 0, i * 3000, 0, "100M", n=100) for i in range(3000)]
    path = tmp_path / "big.bam"
    path.write_bytes(bam_bytes(header([("chr1", 20_000_000)]), rows))
    report = api.split_chrom(spark, str(path), api.RunOptions(str(tmp_path / "out"), append_program=False))
    copy = report.created_outputs[0]["file"]
    few = bam.read_bam(spark, copy, ["pos"], regions=[("chr1", 1000, 9000)])
    pos = sorted(r["pos"] for r in few.collect())
    assert {3000, 6000} <= set(pos) and len(pos) < 750
    assert bam.read_bam(spark, copy, ["pos"], split_bytes=1).count() == 3000
    assert len(bam.BamReader({"path": copy, "split_bytes": "1"}, ["pos"]).partitions()) > 1
    with pytest.raises(IndexError_):
        bam.load_index(copy, header([("a", 1), ("b", 1)]))


def test_region_runs_read_what_the_index_names(spark, tmp_path):
    rows = [record(f"r{i}", 0, i * 3000, 0, "100M", n=100) for i in range(3000)]
    path = tmp_path / "big.bam"
    path.write_bytes(bam_bytes(header([("chr1", 20_000_000)]), rows))
    copy = api.split_chrom(spark, str(path), api.RunOptions(str(tmp_path / "out"), append_program=False, compression_level=0)).created_outputs[0]["file"]
    bed = tmp_path / "few.bed"
    bed.write_text("chr1\t3000\t9050\ta\nchr1\t4500000\t4506050\tb\n")
    got = {}
    for engine in ("auto", "spool"):
        report = api.split_region(spark, copy, api.RunOptions(str(tmp_path / engine), engine=engine), str(bed))
        got[engine] = {o["key"]: (o["digest"], o["total"]) for o in report.created_outputs}, report.manifest
    assert got["auto"][0] == got["spool"][0] and {k: n for k, (_, n) in got["auto"][0].items()} == {"a": 3, "b": 3}
    looked, whole = got["auto"][1], got["spool"][1]
    assert (looked["scan"], whole["scan"]) == ("lookup", "whole") and looked["scan_bytes"] < whole["scan_bytes"]
    assert looked["counters"]["input"] < 0.6 * whole["counters"]["input"] == 0.6 * 3000
    filed = api.split_region(spark, copy, api.RunOptions(str(tmp_path / "f")), str(bed), unmatched="file")
    assert filed.plan.scan == "whole" and sum(o["total"] for o in filed.created_outputs) == 3000
    for mode, engine in (("shard", "stream"), ("tag", "indexed"), ("chrom", "odd")):
        with pytest.raises(ConfigError):
            planner.plan(copy, mode, engine)
    with pytest.raises(ConfigError):
        planner.plan(str(path), "chrom", "indexed")


def test_several_files(spark, tmp_path):
    """Records of different files never share an ordinal, and files must have one dictionary."""
    from laneweave.operators import regions

    paths = []
    for i, at in enumerate((100, 900)):
        path = tmp_path / f"{i}.bam"
        path.write_bytes(bam_bytes(header([("chr1", 5000)]), [record(f"r{i}", 0, at, 0, "50M", n=50)]))
        paths.append(str(path))
    aln = bam.read_bam(spark, ",".join(paths), ["path", "pos", "flag", "cigar"])
    assert [r["pos"] for r in aln.orderBy("ordinal").collect()] == [100, 900] and aln.select("ordinal").distinct().count() == 2
    place = spark.createDataFrame([(0, "a", "chr1", [(90, 200)], 90, 200)], "ordinal long, key string, chrom string, segments array<struct<start: long, end: long>>, env_start long, env_end long")
    assert {r["pos"]: r["keys"] for r in regions.route_region(aln, place).collect()} == {100: ["a"], 900: []}
    other = tmp_path / "other.bam"
    other.write_bytes(bam_bytes(header([("chr2", 5000)]), [record("x", 0, 1, 0, "50M", n=50)]))
    with pytest.raises(HeaderError):
        bam.read_bam(spark, f"{paths[0]},{other}")


def test_csi(spark, tmp_path):
    path = tmp_path / "huge.bam"
    path.write_bytes(bam_bytes(header([("chrHuge", 600_000_000)]), [record("x", 0, 550_000_000)]))
    report = api.split_chrom(spark, str(path), api.RunOptions(str(tmp_path / "o")))
    assert report.created_outputs[0]["index_file"].endswith(".csi")
    back = bam.read_bam(spark, report.created_outputs[0]["file"], ["pos"], regions=[("chrHuge", 549_999_000, 550_000_100)])
    assert back.count() == 1
    with pytest.raises(ConfigError):
        api.split_chrom(spark, str(path), api.RunOptions(str(tmp_path / "p"), index="bai"))


def test_damage(spark, tmp_path, sorted_bam):
    whole = bam_bytes(sorted_header(), sorted_records())
    head = sorted_header()
    for name, data in (("eof", whole[:-28]), ("cut", bam_bytes(head, [*sorted_records()[:3], b"\0" * 10])), ("ref", bam_bytes(head, [record(ref=99)])), ("mate", bam_bytes(head, [record(mate=(99, 1))]))):
        path = tmp_path / f"{name}.bam"
        path.write_bytes(data)
        out = tmp_path / f"{name}-out"
        code = cli.run(["chrom", str(path), "-o", str(out)], spark)
        assert code == (0 if name == "eof" else 3), name
        if code:
            assert not out.exists() or not outputs(out)
    assert cli.run(["chrom", str(tmp_path / "missing.bam")], spark) == 2
    assert cli.run(["nope"], spark) == 2
    assert api.inspect(spark, str(tmp_path / "cut.bam"))["valid"] is False


def test_long_cigar():
    ops = [(1, 0)] * 70000
    import struct

    aux = b"CGBI" + struct.pack("<I", len(ops)) + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    body = bam.encode_record(0, 5, 0, b"long", [(70000, 4), (70000, 3)], b"\0" * 35000, b"\xff" * 70000, aux)
    assert bam.Record(body).cigar() == ops and bam.Record(body).span() == 70000
    with pytest.raises(RecordError):
        bam.Record(bam.encode_record(0, 5, 0, b"long", [(70000, 4), (70000, 3)], b"\0" * 35000, b"\xff" * 70000)).cigar()


def test_headers():
    assert sorted_header().sort_order == "coordinate" and sorted_header().read_groups[1]["sample"] == "sample1"
    for bad in (header([("a", 1), ("a", 2)]), header([("a\tb", 1)]), header([("a", 0)]), header([("a", 5)], order="odd"), header([("a", 5)], groups=[GROUPS[0], GROUPS[0]]), header([("a", 5)], programs=["@PG\tID:x\tPP:y"])):
        with pytest.raises(HeaderError):
            bad.validate()
    twice = sorted_header().with_program("p", "1", "c").with_program("p", "1", "c")
    assert [p["ID"] for p in twice.lines("PG")] == ["aligner", "p", "p.1"] and twice.lines("PG")[-1]["PP"] == "p"


def test_inspect(spark, sorted_bam, capsys):
    assert cli.run(["inspect", sorted_bam, "--tag", "RG", "--output", "json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["counters"]["total"] == 12 and got["tag"]["distinct_values"] == 3 and got["malformed_tags"] == 0
    assert [r["n"] for r in got["per_reference"]] == [5, 3, 2] and got["coordinate_sorted"] and got["valid"]


GTF = """chr1\tx\ttranscript\t1001\t5000\t.\t+\t.\tgene_id "G"; transcript_id "T1";
chr1\tx\texon\t1001\t1200\t.\t+\t.\tgene_id "G"; transcript_id "T1";
chr1\tx\texon\t2501\t2800\t.\t+\t.\tgene_id "G"; transcript_id "T1";
chr1\tx\tCDS\t1101\t2600\t.\t+\t.\tgene_id "G"; transcript_id "T1";
chr2\tx\texon\t6001\t6500\t.\t+\t.\tgene_id "H"; transcript_id "T2";
"""


def test_annotations(spark, tmp_path):
    def put(name, text, packed=None):
        path = tmp_path / name
        path.write_bytes(packed(text.encode()) if packed else text.encode())
        return str(path)

    rows, found = annotation.load(spark, put("a.bed", "# c\ntrack x\n" + BED12))
    assert (found.format, found.width, found.extras) == ("bed", 12, 0)
    assert [tuple(b) for b in rows.orderBy("ordinal").first()["blocks"]] == [(1000, 1200), (2500, 2800), (4600, 5000)]
    assert annotation.load(spark, put("b.bed.gz", BED12, gzip.compress))[0].count() == 3
    assert annotation.load(spark, put("c.bed", BED12, gzip.compress))[0].count() == 3
    got = annotation.load(spark, put("d.bed", GTF))[0].orderBy("ordinal").collect()
    assert [(r["name"], r["start"], r["end"], r["thick_start"]) for r in got] == [("T1", 1000, 5000, 1100), ("T2", 6000, 6500, None)]
    assert annotation.detect(put("e.bed", "chr1\t1\t2\n")).width == 3
    wide = annotation.load(spark, put("f.bed", "chr1\t1\t2\tn\t0\t+\tBRCA1\tpc\n"))
    assert (wide[1].width, wide[1].extras) == (6, 2) and wide[0].first()["extras"] == {"field7": "BRCA1", "field8": "pc"}
    for name, text in (("mixed.bed", "chr1\t1\t2\tn\t0\t+\nchr1\t1\t2\n"), ("mystery.dat", "a\tb\tc\n"), ("empty.bed", "# x\ntrack y\n")):
        with pytest.raises(api.LaneError):
            annotation.detect(put(name, text))
    with pytest.raises(Exception, match="block counts differ"):
        annotation.load(spark, put("bad.bed", BED12.replace("\t3\t", "\t5\t")))[0].collect()


def test_arrivals(spark, sorted_bam, tmp_path):
    from laneweave.operators import routing
    from laneweave.streaming import arrivals

    folder = tmp_path / "names"
    folder.mkdir()
    (folder / "one.txt").write_text(sorted_bam + "\n")
    refs = sorted_header().references_frame(spark)
    route = lambda df: routing.route_chrom(df, refs)
    out = str(tmp_path / "table")
    for _ in range(2):  # the second run finds nothing new
        arrivals.route_arrivals(arrivals.names(spark, str(folder)), route, out, str(tmp_path / "cp")).awaitTermination()
    assert {r["key"]: r["total"] for r in arrivals.running_stats(spark, out).collect()} == {"chr1": 5, "chr2": 3, "chrX": 2, "unmapped": 2}


