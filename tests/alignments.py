"""Alignment files built byte by byte, with headers and records by rule."""

import io
import struct

from laneweave.sources.bam import encode_record
from laneweave.sources.bgzf import BgzfWriter
from laneweave.sources.header import Header

OPS = "MIDNSHP=X"


def cigar(text):
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), OPS.index(c)))
            n = ""
    return out


def z(tag, value):
    return tag.encode() + b"Z" + value.encode() + b"\0"


def record(name="read", ref=0, pos=0, flag=0, ops="10M", mate=(-1, -1), aux=b"", n=10):
    return encode_record(ref, pos, flag, name.encode(), cigar(ops), b"\0" * ((n + 1) // 2), b"\xff" * n, aux, 60, *mate)


def bam_bytes(header, bodies, eof=True):
    out = io.BytesIO()
    w = BgzfWriter(out)
    w.write(header.to_bytes())
    for b in bodies:
        w.write(struct.pack("<i", len(b)) + b)
    w.finish()
    data = out.getvalue()
    return data if eof else data[:-28]


def header(references, order="coordinate", groups=(), programs=()):
    lines = [f"@HD\tVN:1.6\tSO:{order}"]
    lines += [f"@SQ\tSN:{n}\tLN:{length}" for n, length in references]
    lines += [f"@RG\tID:{g}\t" + "\t".join(f"{k}:{v}" for k, v in fields.items()) if fields else f"@RG\tID:{g}" for g, fields in groups]
    lines += list(programs)
    return Header("".join(f"{x}\n" for x in lines), [(n.encode(), length) for n, length in references])


REFS = [("chr1", 10000), ("chr2", 20000), ("chrX", 5000)]
GROUPS = [("rg0", {"SM": "sample0", "LB": "lib0", "PU": "unit0", "PL": "ILLUMINA", "CN": "centre"}), ("rg1", {"SM": "sample1", "LB": "lib1"})]


def sorted_header():
    return header(REFS, groups=GROUPS, programs=["@PG\tID:aligner\tPN:aligner"])


def sorted_records():
    rg0, rg1 = z("RG", "rg0"), z("RG", "rg1")
    return [
        record("pair1", 0, 100, 0x43, mate=(0, 200), aux=rg0 + b"NMC\0"),
        record("pair1", 0, 200, 0x83, mate=(0, 100), aux=rg0),
        record("spliced", 0, 300, 0, "5M100N5M", aux=rg1),
        record("nogroup", 0, 400),
        record("halfmapped", 0, 400, 0x5, "", aux=rg0),
        record("crossmate", 1, 100, 0x41, mate=(2, 50), aux=rg0),
        record("secondary", 1, 150, 0x100, aux=rg1),
        record("supplementary", 1, 160, 0x800, "5M5S", aux=rg0),
        record("duplicate", 2, 50, 0x400, aux=rg1),
        record("qcfail", 2, 60, 0x200, aux=z("RG", "unknown-group")),
        record("unplaced1", -1, -1, 0x4, "", aux=rg0),
        record("unplaced2", -1, -1, 0xD, ""),
    ]
