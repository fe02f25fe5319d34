"""The alignment header: text, reference dictionary, read groups, programs."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import xxhash

from ..errors import HeaderError

#: Fixed values of the format, and limits of what is plausible.
MAGIC = b"BAM\1"
MAX_TEXT, MAX_REFERENCES, MAX_NAME = 1 << 30, 1 << 26, 1 << 20
#: Rows of a dictionary that are broadcast with a join (a few MB at most).
BROADCAST_ROWS = 50_000
SORT_ORDERS = ("unknown", "unsorted", "queryname", "coordinate")
_FIELDS = {"SM": "sample", "LB": "library", "PU": "platform_unit", "PL": "platform", "CN": "center"}


@dataclass
class Header:
    text: str = ""
    references: list[tuple[bytes, int]] = field(default_factory=list)

    # ------------------------------------------------------------ reading

    @classmethod
    def read(cls, source) -> Header:
        """From the inflated bytes of a file."""

        def number() -> int:
            raw = source.read(4)
            if len(raw) < 4:
                raise HeaderError("the header ends early")
            return struct.unpack("<i", raw)[0]

        def exactly(n: int) -> bytes:
            raw = source.read(n)
            if len(raw) < n:
                raise HeaderError("the header ends early")
            return raw

        if source.read(4) != MAGIC:
            raise HeaderError("not an alignment file")
        size = number()
        if not 0 <= size <= MAX_TEXT:
            raise HeaderError(f"implausible header text of {size} bytes")
        text = exactly(size).rstrip(b"\0").decode("utf-8", "surrogateescape")
        count = number()
        if not 0 <= count <= MAX_REFERENCES:
            raise HeaderError(f"implausible number of references {count}")
        references = []
        for _ in range(count):
            n = number()
            if not 1 <= n <= MAX_NAME:
                raise HeaderError(f"implausible reference name of {n} bytes")
            name = exactly(n)
            if name[-1:] != b"\0":
                raise HeaderError("a reference name doesn't end with NUL")
            references.append((name[:-1], number()))
        header = cls(text, references)
        header.validate()
        return header

    # ------------------------------------------------------------ text

    def lines(self, kind: str) -> list[dict[str, str]]:
        out = []
        for line in self.text.splitlines():
            parts = line.split("\t")
            if parts[0] == f"@{kind}":
                out.append(dict(p.split(":", 1) for p in parts[1:] if ":" in p))
        return out

    @property
    def sort_order(self) -> str:
        found = self.lines("HD")
        return found[0].get("SO", "unknown") if found else "unknown"

    @property
    def read_groups(self) -> list[dict[str, str | None]]:
        return [{"id": g.get("ID"), **{name: g.get(code) for code, name in _FIELDS.items()}} for g in self.lines("RG")]

    def validate(self) -> None:
        for line in self.text.splitlines():
            if line and not re.match(r"@[A-Za-z]{2}(\t|$)", line):
                raise HeaderError(f"bad header line {line[:40]!r}")
        seen = set()
        for name, length in self.references:
            if not name or re.search(rb"[\t\r\n\0]", name):
                raise HeaderError(f"bad reference name {name!r}")
            if name in seen:
                raise HeaderError(f"reference {name!r} is there twice")
            if length <= 0:
                raise HeaderError(f"reference {name!r} has length {length}")
            seen.add(name)
        told = [(s.get("SN", "").encode("utf-8", "surrogateescape"), s.get("LN")) for s in self.lines("SQ")]
        if told and told != [(n, str(length)) for n, length in self.references]:
            raise HeaderError("header text and reference dictionary differ")
        if self.sort_order not in SORT_ORDERS:
            raise HeaderError(f"unknown sort order {self.sort_order!r}")
        for kind in ("RG", "PG"):
            ids = [x.get("ID") for x in self.lines(kind)]
            if None in ids or len(set(ids)) < len(ids):
                raise HeaderError(f"@{kind} ids are missing or not unique")
        ids = {x["ID"] for x in self.lines("PG")}
        for p in self.lines("PG"):
            if p.get("PP") is not None and p["PP"] not in ids:
                raise HeaderError(f"@PG {p['ID']} follows the unknown {p['PP']}")

    # ------------------------------------------------------------ changes and writing

    def leaf_program(self) -> str | None:
        """The last program that no other follows."""
        programs = self.lines("PG")
        followed = {p.get("PP") for p in programs}
        return next((p["ID"] for p in reversed(programs) if p["ID"] not in followed), None)

    def with_program(self, name: str, version: str, command: str) -> Header:
        ids = {p["ID"] for p in self.lines("PG")}
        own, n = name, 0
        while own in ids:
            n += 1
            own = f"{name}.{n}"
        parts = ["@PG", f"ID:{own}", f"PN:{name}", f"VN:{version}"]
        if (leaf := self.leaf_program()) is not None:
            parts.append(f"PP:{leaf}")
        clean = re.sub(r"[\t\r\n]", " ", command)
        return Header(self._text() + "\t".join([*parts, f"CL:{clean}"]) + "\n", self.references)

    def _text(self) -> str:
        """The lines in the usual order of groups: HD, SQ, RG, PG, CO, others."""
        order = {"@HD": 0, "@SQ": 1, "@RG": 2, "@PG": 3, "@CO": 4}
        lines = [line for line in self.text.splitlines() if line]
        lines.sort(key=lambda line: order.get(line[:3], 5))
        return "".join(f"{line}\n" for line in lines)

    def to_bytes(self) -> bytes:
        text = self._text().encode("utf-8", "surrogateescape")
        parts = [MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(self.references))]
        for name, length in self.references:
            parts += [struct.pack("<i", len(name) + 1), name, b"\0", struct.pack("<i", length)]
        return b"".join(parts)

    @property
    def checksum(self) -> str:
        """Digest of the text as read and of the dictionary."""
        h = xxhash.xxh3_64(self.text.encode("utf-8", "surrogateescape"))
        for name, length in self.references:
            h.update(name + b"\0" + struct.pack("<I", length))
        return h.hexdigest()

    @property
    def longest_reference(self) -> int:
        return max((length for _, length in self.references), default=0)

    # ------------------------------------------------------------ tables

    def references_frame(self, spark):
        rows = [(i, name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), length) for i, (name, length) in enumerate(self.references)]
        return _sized(spark.createDataFrame(rows, "ref_id int, name string, length long"), len(rows))

    def read_groups_frame(self, spark):
        names = ("id", *_FIELDS.values())
        rows = [tuple(g[n] for n in names) for g in self.read_groups]
        return _sized(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), len(rows))


def _sized(df, rows: int):
    """A dimension table of known size: broadcast while it is small, else left to the planner."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
