"""Which parts of a file a run scans, told from the file and its index.

How records are routed, dealt and written is Spark's plan and the same for
every run. What a run can choose is the scan: ``whole`` reads the file in
stretches that begin where an index knows of a record (one stretch without an
index); ``lookup`` reads the chunks alone that the index names for some places.
A lookup is possible where all that a run writes is at those places.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ConfigError
from ..sources import bam

#: What a run may ask for: how outputs come about elsewhere; here only ``indexed`` and ``auto`` allow a lookup.
ENGINES = ("auto", "stream", "indexed", "spool")
IO_BACKENDS = ("auto", "buffered", "mmap")
#: Places that one lookup takes.
LOOKUP_PLACES = 10_000
#: Share of the file's bytes beyond which a lookup saves too little.
LOOKUP_SHARE = 0.5

Place = tuple[str, int, int]


@dataclass(frozen=True)
class ScanPlan:
    scan: str
    reason: str
    partitions: int
    scan_bytes: int
    places: tuple[Place, ...] | None = None

    def told(self) -> dict:
        return {"engine": "spark", "scan": self.scan, "scan_reason": self.reason, "partitions": self.partitions, "scan_bytes": self.scan_bytes}


def joined(places: list[Place]) -> list[Place]:
    """Places without overlaps, by name and begin."""
    out: list[Place] = []
    for name, start, end in sorted(p for p in places if p[1] < p[2]):
        if out and out[-1][0] == name and start <= out[-1][2]:
            out[-1] = name, out[-1][1], max(out[-1][2], end)
        else:
            out.append((name, start, end))
    return out


def plan(path: str, mode: str, engine: str = "auto", io: str = "auto", places: list[Place] | None = None) -> ScanPlan:
    """The scan of a run. ``places``: all that it writes from, where that is known; None means any record."""
    for value, known, what in ((engine, ENGINES, "engine"), (io, IO_BACKENDS, "io")):
        if value not in known:
            raise ConfigError(f"{what} must be one of {', '.join(known)}, not {value!r}")
    if mode in ("shard", "tag") and engine in ("stream", "indexed"):
        raise ConfigError(f"keys of {mode} runs come in any order: the engine can't be {engine}")
    if io == "mmap" and "://" in path and not path.startswith("file:"):
        raise ConfigError("a file of this store can't be mapped")
    size = bam.file_size(path)
    indexed = bam.find_index(path) is not None
    if engine == "indexed" and not indexed:
        raise ConfigError(f"{path} has no index")
    whole = bam.stretches([path], bam.SPLIT_BYTES)
    if engine in ("stream", "spool") or not indexed or places is None:
        why = "all records may be written" if places is None else "there is no index" if not indexed else f"{engine} was asked for"
        return ScanPlan("whole", why, len(whole), size)
    merged = joined(places)
    if len(merged) > LOOKUP_PLACES:
        return ScanPlan("whole", "there are too many places to look up", len(whole), size)
    chunks = bam.targeted([path], merged, False)
    held = sum(((c.end >> 16) - (c.start >> 16)) + 1 for c in chunks)
    if engine == "auto" and held > LOOKUP_SHARE * size:
        return ScanPlan("whole", "the places are in most of the file", len(whole), size)
    return ScanPlan("lookup", "the index names the chunks of the places", len(chunks), held, tuple(merged))
