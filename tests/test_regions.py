import random

import pytest

from laneweave.errors import AnnotationError
from laneweave.operators import features, regions, routing, stats

ALN = "ordinal long, chrom string, ref_id int, pos long, cigar array<struct<len: bigint, op: int>>"
REG = "ordinal long, key string, chrom string, segments array<struct<start: bigint, end: bigint>>, env_start long, env_end long"
OPS = "MIDNSHP=X"


def ops(text):
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), OPS.index(c)))
            n = ""
    return out


def reads(spark, *items):
    return spark.createDataFrame([(i, "c", 0, p, ops(c)) for i, (p, c) in enumerate(items)], ALN)


def places(spark, *items):
    rows = []
    for i, (key, *segments) in enumerate(items):
        rows.append((i, key, "c", list(segments), segments[0][0], segments[-1][1]))
    return spark.createDataFrame(rows, REG)


CASES = [
    ("start", False, (90, "100M"), [("a", (100, 200)), ("b", (300, 400))], []),
    ("start", False, (150, "10M"), [("wide", (0, 1000)), ("narrow", (100, 200)), ("same", (100, 200))], ["narrow"]),
    ("midpoint", False, (500, "100M1000N100M"), [("m", (1000, 2000))], ["m"]),
    ("contained", False, (1050, "50M900N50M"), [("two", (1000, 1100), (2000, 2100))], ["two"]),
    ("contained", False, (1050, "100M"), [("two", (1000, 1100), (2000, 2100))], []),
    ("contained", False, (1050, "1000M"), [("two", (1000, 1100), (2000, 2100))], []),
    ("best-overlap", False, (1000, "100M"), [("small", (1000, 1020)), ("large", (1000, 1200))], ["large"]),
    ("best-overlap", False, (1000, "100M"), [("wide", (0, 10000)), ("narrow", (1000, 1100))], ["narrow"]),
    ("overlap", False, (1040, "100M"), [("a", (1000, 1100)), ("b", (1050, 1200)), ("c", (5000, 5100))], ["a", "b"]),
    ("overlap", False, (1000, "100M800N100M"), [("intron", (1100, 1900))], []),
    ("overlap", True, (1000, "100M800N100M"), [("intron", (1100, 1900))], ["intron"]),
    ("overlap", False, (1000, "100M50D100M"), [("gap", (1100, 1120))], []),
    ("start", False, (1500, "10I"), [("i", (1000, 2000))], ["i"]),
]


@pytest.mark.parametrize("mode,span,read,where,expected", CASES)
def test_assignment(spark, mode, span, read, where, expected):
    routed = regions.route_region(reads(spark, read), places(spark, *where), mode, span).first()
    assert routed["keys"] == expected
    assert routed["drop_reason"] == (None if expected else "unmatched")


def test_counts_of_a_tie(spark):
    aln, where = reads(spark, (150, "10M"), (5000, "10M")), places(spark, ("wide", (0, 1000)), ("narrow", (100, 200)))
    got = regions.routing_counts(aln, regions.matches(aln, where, "start"), "start").first().asDict()
    assert got == {"matched": 1, "unmatched": 1, "ambiguous": 1, "duplicates": 0, "max_matches": 1}


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            s = rng.randrange(1 << 22)
            out.append((i, rng.choice("xy"), s, s + rng.choice([0, 1, 100, 20_000, 300_000, 4_000_000])))
        return out

    a, b = some(250), some(250)
    left = spark.createDataFrame(a, "a long, chrom string, start long, end long")
    right = spark.createDataFrame(b, "b long, chrom string, env_start long, env_end long")
    got = sorted((r["a"], r["b"]) for r in regions.interval_join(left, right).select("a", "b").collect())
    assert got == sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and e > s and f > t and s < f and t < e)


def crowd(rng, n):
    """Reads and regions, many of them at the same places, a few of them very long."""
    cigars = ["10M", "40M", "10M20N30M", "5M100N5M3000N20M", "8M2D9M", "3I", "2S4D", "4D6M", "10M400000N10M", "6M5000000N6M"]
    aln = [(i, rng.choice("xy"), 0 if i % 9 else -1, rng.randrange(2000) if i % 7 else rng.randrange(500_000), ops(rng.choice(cigars))) for i in range(n)]
    regs = []
    for i in range(n):
        at, segments = rng.randrange(2000) if i % 5 else rng.randrange(500_000), []
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 7])):
            end = at + rng.choice([1, 10, 60, 60, 3000, 700_000])
            segments.append((at, end))
            at = end + rng.choice([1, 15, 120])
        regs.append((3 * i, f"k{i}", rng.choice("xyz"), segments, segments[0][0] if segments else at, segments[-1][1] if segments else at))
    return aln, regs


@pytest.mark.parametrize("mode,span", [(m, s) for m in regions.MODES for s in (False, True)])
def test_placed_without_pairs_equals_pairs(spark, mode, span):
    aln, regs = crowd(random.Random(11), 300)
    aln, where = spark.createDataFrame(aln, ALN), spark.createDataFrame(regs, REG)
    pairs = regions.matches(aln, where, mode, span).cache()
    got = {r["ordinal"]: r for r in regions.placed(aln, where, mode, span, keep=("pos",)).collect()}
    many = {r["ordinal"]: r["count"] for r in pairs.groupBy("ordinal").count().collect()}
    assert len(many) > 30
    assert {o: r["candidates"] for o, r in got.items() if r["candidates"]} == many
    assert {o: r["pos"] for o, r in got.items()} == {r["ordinal"]: r["pos"] for r in aln.filter("ref_id >= 0").collect()}
    if mode != "overlap":
        best = regions.assigned(pairs, mode)
        assert sorted(map(tuple, regions.chosen(aln, where, mode, span).collect())) == sorted(map(tuple, best.collect()))
    assert sorted(r[0] for r in regions.not_matched(aln, where, mode, span).collect()) == sorted(r[0] for r in regions.unmatched(aln, pairs).select("ordinal").collect())
    counts = regions.routing_counts(aln, pairs, mode).first()
    assert regions.match_counts(aln, where, mode, span).first() == counts
    if mode == "overlap":
        counters = stats.run_counters(regions.route_region(aln, where, mode, span)).first().asDict()
        assert regions.fan_out_counters(aln, where, span).first().asDict() == counters


@pytest.mark.parametrize("mode", regions.MODES)
def test_placing_in_small_pieces(monkeypatch, mode):
    """Batches, blocks of reads and matrices may end anywhere."""
    import pyarrow as pa
    from laneweave.operators import placing

    rng, rows = random.Random(3), []
    for chrom, bin_ in (("x", 0), ("x", 1), ("y", 1), ("z", 0)):
        at = lambda: (s := rng.randrange(bin_ << 11, bin_ + 1 << 11), s + rng.choice([1, 30, 30]))  # noqa: B023, E731
        rows += [(chrom, 11, bin_, 0, i, f"k{i}", [at()]) for i in range(90) if chrom != "z"]
        rows += [(chrom, 11, bin_, 1, i, None, [at()]) for i in range(150)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spans = [[{"start": a, "end": b} for a, b in r[6]] for r in rows]
    columns = {n: [r[i] for r in rows] for i, n in enumerate(("chrom", "width", "bin", "side", "ordinal", "key"))}
    table = pa.table({**columns, "spans": pa.array(spans, kind)}, schema=pa.schema([("chrom", pa.string()), ("width", pa.int32()), ("bin", pa.int64()), ("side", pa.int32()), ("ordinal", pa.int64()), ("key", pa.string()), ("spans", kind)]))
    run = lambda size: pa.Table.from_batches(placing.placer(mode, [])(iter(table.to_batches(max_chunksize=size)))).to_pylist()
    whole = run(10_000)
    assert len(whole) == 600 and any(r["candidates"] > 1 for r in whole)
    monkeypatch.setattr(placing, "READS", 40)
    monkeypatch.setattr(placing, "SHAPES", 3)
    monkeypatch.setattr(placing, "COLUMNS", 2)
    assert run(17) == whole


def test_units_of_pairs_are_small(monkeypatch):
    """Many equal reads among others: a bin's pairs come in units of few reads and regions."""
    import numpy as np
    import pyarrow as pa
    from laneweave.operators import placing

    rng = random.Random(4)
    where = [[(s := rng.randrange(900), s + 40), (s + 60, s + 300)] for _ in range(50)]
    aln = [[(s := rng.choice([5, 5, rng.randrange(900)]), s + 30), (s + 45, s + 50)][: rng.choice([1, 2])] for _ in range(120)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spans = lambda x: pa.array([[{"start": a, "end": b} for a, b in y] for y in x], kind)
    side = lambda n, x: pa.table({"chrom": ["x"] * len(x), "width": [11] * len(x), "bin": [0] * len(x), "side": [n] * len(x), "ordinal": range(len(x)), "key": [f"k{i}" if n == 0 else None for i in range(len(x))], "spans": spans(x)}, schema=pa.schema([("chrom", pa.string()), ("width", pa.int32()), ("bin", pa.int64()), ("side", pa.int32()), ("ordinal", pa.int64()), ("key", pa.string()), ("spans", kind)]))
    table = pa.concat_tables([side(0, where), side(1, aln)])
    expected = [(i, f"k{j}", j) for i, r in enumerate(aln) for j, g in enumerate(where) if any(a < d and c < b for a, b in r for c, d in g)]
    assert len(expected) > 500 and np.unique([r[0] for r in expected]).size > 60
    for name, n in {"READS": 40, "SHAPES": 7, "COLUMNS": 11, "UNIT_READS": 9, "CELLS": 30, "UNITS": 5, "ROWS": 4}.items():
        monkeypatch.setattr(placing, name, n)
    units = pa.Table.from_batches(placing.unit_maker()(iter(table.to_batches(max_chunksize=17))))
    sizes = [(len(u["ordinals"]), len(u["places"])) for u in units.to_pylist()]
    assert max(a for a, _ in sizes) == 9 and max(a * b for a, b in sizes) <= 30
    assert max(units["part"].to_pylist()) > 5
    got = pa.Table.from_batches(placing.expander()(iter(units.to_batches(max_chunksize=13))))
    assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(expected)


def test_overlapping_pairs_with_a_wide_region(spark):
    """A wide region beside narrow ones is not cut into the bins of these."""
    rng = random.Random(5)
    spans = [(0, 1 << 40), *((s := rng.randrange(900), s + rng.choice([1, 5, 90, 400])) for _ in range(80)), (40, 40)]
    where = places(spark, *[(f"k{i}", x) for i, x in enumerate(spans)])
    got = sorted(map(tuple, regions.overlapping_pairs(where).collect()))
    assert got == [(i, j) for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i < j and a < d and c < b and a < b and c < d]


#: Queries whose answer has a row for each read, or less.
UNPAIRED = ["conservation_fanout", "region_contained", "region_output_stats", "region_start", "region_unmatched", "region_ambiguity", "region_best_overlap", "region_duplicates", "region_midpoint", "region_span_geometry"]


@pytest.mark.parametrize("name", UNPAIRED)
def test_no_pairs_are_made(spark, name):
    from laneweave import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_bin" not in plan


@pytest.mark.parametrize("span", [False, True])
def test_fan_out_equals_joined_pairs(spark, span):
    aln, regs = crowd(random.Random(12), 300)
    aln, where = spark.createDataFrame(aln, ALN), spark.createDataFrame(regs, REG)
    expected = sorted(map(tuple, regions.assigned(regions.matches(aln, where, "overlap", span), "overlap").collect()))
    assert len(expected) > 300
    assert sorted(map(tuple, regions.fan_out(aln, where, span).collect())) == expected


def test_fan_out_without_reads_or_regions(spark):
    aln, where = reads(spark, (5, "10M")), places(spark, ("a", (0, 9)))
    assert regions.fan_out(aln.limit(0), where).count() == regions.fan_out(aln, where.limit(0)).count() == 0
    assert [tuple(r) for r in regions.fan_out(aln, where).collect()] == [(0, "a", 0)]


def test_fan_out_joins_nothing(spark):
    """Its pairs come from sorted bins: a join by bin takes every candidate through rows of arrays."""
    from laneweave import catalog

    plan = catalog.queries()["region_overlap_fanout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_fan_out_of_one_bin_is_written_by_many_tasks(spark):
    """All reads, of many shapes, and all regions in one bin: their pairs are dealt out."""
    from pyspark.sql import functions as F

    aln = spark.range(20_000).selectExpr("id as ordinal", "'c' as chrom", "0 as ref_id", "id % 1000 as pos", "array(named_struct('len', 60L + id div 1000, 'op', 0)) as cigar")
    where = spark.range(120).selectExpr("id as ordinal", "concat('k', id) as key", "'c' as chrom", "array(named_struct('start', 10L, 'end', 1900 + id)) as segments", "10L as env_start", "1900 + id as env_end")
    with_task = regions.fan_out(aln, where).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in with_task) == 20_000 * 120
    assert len(with_task) > 1


RECORDS = "ordinal long, chrom string, start long, end long, name string, strand string, thick_start long, thick_end long, blocks array<struct<start: bigint, end: bigint>>, extras map<string,string>"
ENST = [(1000, 1200), (2500, 2800), (4600, 5000)]


def transcript(ordinal=0, name="ENST01", strand="+", thick=(1200, 4800), blocks=ENST):
    return (ordinal, "chr1", 1000, 5000, name, strand, *thick, blocks, {})


def segments(spark, feature, row, **more):
    found = features.extract(spark.createDataFrame([row], RECORDS), feature, **more).collect()
    return [tuple(s) for s in found[0]["segments"]] if found else None


def test_features(spark):
    row = transcript()
    assert segments(spark, "span", row) == [(1000, 5000)]
    assert segments(spark, "exon", row) == ENST
    assert segments(spark, "intron", row) == [(1200, 2500), (2800, 4600)]
    assert segments(spark, "cds", row) == [(2500, 2800), (4600, 4800)]
    assert segments(spark, "utr", row) == [(1000, 1200), (4800, 5000)]
    assert segments(spark, "5utr", row) == [(1000, 1200)]
    assert segments(spark, "five-utr", transcript(strand="-")) == [(4800, 5000)]
    assert segments(spark, "three-utr", transcript(strand="-")) == [(1000, 1200)]
    assert segments(spark, "cds", transcript(thick=(1000, 1000))) is None
    assert segments(spark, "five-utr", transcript(strand=".")) is None
    assert segments(spark, "cds", transcript(thick=(1000, 1000)), missing="empty") == []
    assert segments(spark, "exon", transcript(blocks=None)) == [(1000, 5000)]
    assert segments(spark, "exon", transcript(blocks=None), gxf=True) is None
    assert segments(spark, "intron", transcript(blocks=None)) == []
    with pytest.raises(AnnotationError):
        segments(spark, "cds", transcript(thick=(1000, 1000)), missing="error")
    with pytest.raises(AnnotationError, match="blocks overlap"):
        segments(spark, "span", transcript(blocks=[(1000, 1200), (1100, 1300)]))


def test_names_are_numbered_over_kept_records(spark):
    rows = [transcript(0, "gene", thick=(1, 1)), transcript(1, "gene"), transcript(2, "gene"), transcript(3, "."), transcript(4, None)]
    got = features.extract(spark.createDataFrame(rows, RECORDS), "cds").orderBy("ordinal").collect()
    assert [r["key"] for r in got] == ["gene", "gene.2", "region-chr1-1000-5000-3", "region-chr1-1000-5000-4"]


def test_shared_names(spark):
    refs = spark.createDataFrame([(0, "1", 10)], "ref_id int, name string, length long")
    with pytest.raises(AnnotationError):
        regions.check_shared_names(refs, places(spark, ("a", (1, 2))))


def test_order_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(stats, "STRETCH", 3)
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 1, -1] if i > 30 else [0, 0, 1]), rng.randrange(20), rng.choice("ab")) for i in range(60)]
    df = spark.createDataFrame(rows, "ordinal long, ref_id int, pos long, key string")
    prior, gone, bad = (-1, -1), False, []
    for i, ref, pos, _ in rows:
        if ref >= 0:
            if gone or (ref, pos) < prior:
                bad.append(i)
            prior = (ref, pos)
        else:
            gone = True
    assert sorted(r[0] for r in stats.order_violations(df).collect()) == bad
    runs, last = {}, None
    for _, _, _, k in rows:
        runs[k] = runs.get(k, 0) + (k != last)
        last = k
    assert {r["key"]: r["runs"] for r in stats.key_runs(df).collect()} == runs


def test_cardinality_guard(spark):
    from laneweave.errors import CardinalityError

    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "ordinal long, v string")
    with pytest.raises(CardinalityError):
        routing.route_tag(df, "v", max_outputs=4)
    assert routing.route_tag(df, "v", max_outputs=5).count() == 5
