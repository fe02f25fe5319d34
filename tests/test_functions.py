import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneweave.errors import ConfigError, TagError
from laneweave.functions import cigar as cg
from laneweave.functions import hashing, keys, tags
from laneweave.functions import intervals as iv
from laneweave.operators.regions import parse_window_size
from laneweave.sources import index as ix


def merge(parts):
    out = []
    for s, e in sorted(p for p in parts if p[1] > p[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_sets_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a, b = ([(s := rng.randrange(60), s + rng.randrange(-3, 20)) for _ in range(rng.randrange(7))] for _ in range(2))
        rows.append((i, a, b))
    kind = f"id int, a array<{iv.INTERVAL}>, b array<{iv.INTERVAL}>"
    df = spark.createDataFrame(rows, kind).withColumn("a", iv.merged(F.col("a"))).withColumn("b", iv.merged(F.col("b")))
    got = df.select("id", "a", "b", iv.total_length(F.col("a")).alias("n"), iv.set_overlap(F.col("a"), F.col("b")).alias("o"), iv.set_contains_all(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        a, b = merge(rows[r["id"]][1]), merge(rows[r["id"]][2])
        assert [tuple(x) for x in r["a"]] == a
        points = {p for s, e in a for p in range(s, e)}
        assert r["n"] == len(points)
        assert r["o"] == len(points & {p for s, e in b for p in range(s, e)})
        assert r["c"] == all(any(s <= x and y <= e for s, e in a) for x, y in b)


def blocks(pos, ops, join=False):
    out, at, fresh = [], pos, True
    for n, op in ops:
        if op in (0, 7, 8) and n:
            if fresh or not out:
                out.append([at, at + n])
            else:
                out[-1][1] = at + n
            fresh = False
        if op in (0, 2, 3, 7, 8):
            at += n
        if op == 3 and n or op == 2 and n and not join:
            fresh = True
    return [tuple(b) for b in out]


def test_blocks_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(100), [(rng.randrange(0, 9), rng.randrange(9)) for _ in range(rng.randrange(8))]) for i in range(300)]
    df = spark.createDataFrame(rows, f"id int, pos long, cigar {cg.CIGAR}")
    got = df.select("id", cg.aligned_blocks(F.col("pos"), F.col("cigar")).alias("x"), cg.aligned_blocks(F.col("pos"), F.col("cigar"), True).alias("y")).collect()
    for r in got:
        _, pos, ops = rows[r["id"]]
        assert [tuple(b) for b in r["x"]] == blocks(pos, ops)
        assert [tuple(b) for b in r["y"]] == blocks(pos, ops, True)


def test_cigar_text_and_errors(spark):
    df = spark.createDataFrame([([(5, 0), (2, 8)],), ([],)], f"cigar {cg.CIGAR}")
    assert [r[0] for r in df.select(cg.text(F.col("cigar"))).collect()] == ["5M2X", "*"]
    bad = spark.createDataFrame([([(5, 9)],)], f"cigar {cg.CIGAR}")
    with pytest.raises(Exception, match="unknown CIGAR operation"):
        bad.select(cg.check(F.col("cigar"))).collect()


def test_number_text():
    single = [(1.0, "1"), (0.5, "0.5"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (-0.0, "-0"), (float("nan"), "NaN"), (float("inf"), "inf"), (float("-inf"), "-inf"), (0.1, "0.1")]
    for v, text in single:
        assert tags.number_text(v, True) == text
    assert tags.number_text(float(np.float32(0.1)), False) == "0.10000000149011612"


EVERY = b"AaA*" + b"Ccc\xff" + b"CuC\xff" + b"Sis\xfe\xff" + b"SuS\xff\xff" + b"Iii\xfd\xff\xff\xff" + b"IuI\x00\x28\x6b\xee" + b"Flf\x00\x00\x00\x3f" + b"ZzZhello\0" + b"HxHDEADBEEF\0" + b"BaBi\x02\0\0\0\x01\0\0\0\xff\xff\xff\xff"


def test_every_tag_type():
    got = {t: tags.rendered(k, v).decode() for t, k, v in tags.scan(EVERY)}
    assert got == {"Aa": "*", "Cc": "-1", "Cu": "255", "Si": "-2", "Su": "65535", "Ii": "-3", "Iu": "4000000000", "Fl": "0.5", "Zz": "hello", "Hx": "DEADBEEF", "Ba": "i,1,-1"}
    assert tags.find(EVERY, "Zz") == ("Z", b"hello")
    assert tags.find(b"AAA*" + b"XXq\0", "AA") == ("A", b"*")
    with pytest.raises(TagError):
        list(tags.scan(b"XXq\0"))
    assert not tags.validate(b"AAA*AAA*", unique=True)
    assert tags.validate(b"AAA*AAA*")


@given(st.binary(max_size=59))
@settings(max_examples=200, deadline=None)
def test_names_come_back(key):
    name = keys.encode_key(key)
    assert keys.decode_key(name) == key
    assert keys.is_safe_component(name)


@given(st.binary(max_size=300))
@settings(max_examples=100, deadline=None)
def test_names_are_plain_and_short(key):
    assert len(keys.encode_key(key)) <= keys.LONGEST
    assert keys.is_safe_component(keys.encode_key(key))


def test_column_names_equal_the_plain_ones(spark):
    samples = ["", "..", ".", "CON", "con.txt", "a.", "chr1/alternate", "HLA-A*01:01", "100%", "pipe|name", "é~", "x" * 40]
    df = spark.createDataFrame([(s,) for s in samples], "k string")
    assert [r[0] for r in df.select(keys.encoded(F.col("k"))).collect()] == [keys.encode_key(s.encode()) for s in samples]
    assert keys.decode_key("%4") is None


def test_templates():
    assert keys.Template("{{x}}-{index}-{key}.bam").render("a", 3) == "{x}-3-a.bam"
    for bad in ("x.bam", "{nope}{key}", "{key"):
        with pytest.raises(ConfigError):
            keys.Template(bad)


def test_shards(spark):
    df = spark.createDataFrame([(b"a",), (b"",), (None,)], "k binary")
    got = [r[0] for r in df.select(hashing.shard_number(F.col("k"), 7)).collect()]
    assert got == [xxhash.xxh3_64_intdigest(b"a", hashing.DEFAULT_SEED) % 7, xxhash.xxh3_64_intdigest(b"", hashing.DEFAULT_SEED) % 7, None]
    assert hashing.shard_width(10001) == 5
    with pytest.raises(ConfigError):
        hashing.shard_width(10001, 4)


def test_window_sizes():
    assert [parse_window_size(x) for x in ("5", "2k", "3M", "1G")] == [5, 2000, 3_000_000, 10**9]
    for bad in ("0", "1.5k", "x", "", "99999999999G"):
        with pytest.raises(ConfigError):
            parse_window_size(bad)


def test_index_plan_and_bins():
    assert ix.plan("auto", 1000) == ("bai", 5)
    assert ix.plan("auto", 600_000_000)[0] == "csi"
    with pytest.raises(ConfigError):
        ix.plan("bai", 600_000_000)
    rng = random.Random(5)
    for _ in range(500):
        s = rng.randrange(1 << 28)
        e = s + 1 + rng.randrange(1 << rng.randrange(1, 25))
        assert ix.bin_of(s, e) in ix.bins_over(s, e)
        q = max(0, s - 100)
        assert ix.bin_of(s, e) in ix.bins_over(q, s + 1)
