"""BGZF: gzip members of at most 64 KiB with their size in an extra field."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from ..errors import RecordError

#: Fixed values of the format.
EOF_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAYLOAD = 0xFF00


def virtual_offset(block: int, inside: int) -> int:
    """Block offset in the file and offset in the block, as one number (held below 2^64)."""
    return min(block, (1 << 48) - 1) << 16 | inside


def encode_block(data: bytes, level: int = 6) -> bytes:
    """One block; stored if deflate doesn't make it smaller."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    if len(body) > len(data) + 5 or level == 0:
        body = b"\x01" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
    size = len(body) + 25
    return struct.pack("<4BI2BH2sHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, b"BC", 2, size) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BgzfWriter:
    """Blocks of a fixed payload, so that equal contents give equal bytes."""

    def __init__(self, out, level: int = 6):
        self.out, self.level = out, level
        self.buffer = bytearray()
        self.offset = 0

    def tell(self) -> int:
        return virtual_offset(self.offset, len(self.buffer))

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= PAYLOAD:
            self._flush(PAYLOAD)

    def _flush(self, n: int) -> None:
        block = encode_block(bytes(self.buffer[:n]), self.level)
        self.out.write(block)
        self.offset += len(block)
        del self.buffer[:n]

    def finish(self) -> int:
        """Write what is left and the end marker; the size of the file."""
        if self.buffer:
            self._flush(len(self.buffer))
        self.out.write(EOF_MARKER)
        self.offset += len(EOF_MARKER)
        return self.offset


def block_size(head: bytes) -> int:
    """The size of the block whose first 18 bytes or more are given."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        raise RecordError("no BGZF block")
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= 12 + extra and at + 4 <= len(head):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    raise RecordError("a gzip member without a block size")


class BgzfReader:
    """The inflated bytes from a virtual offset on, with the virtual offset of each place."""

    def __init__(self, source, start: int = 0):
        self.source = source
        self.block = start >> 16
        self.next = self.block
        self.data, self.at = b"", 0
        source.seek(self.block)
        if start & 0xFFFF:
            self._load()
            self.at = start & 0xFFFF

    def _load(self) -> bool:
        self.block = self.next
        head = self.source.read(18)
        if not head:
            self.data, self.at = b"", 0
            return False
        size = block_size(head)
        body = self.source.read(size - len(head))
        if len(body) < size - len(head):
            raise RecordError("a truncated BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        raw = head + body
        self.data = zlib.decompress(raw[12 + extra : -8], -15)
        crc, length = struct.unpack("<II", raw[-8:])
        if length != len(self.data) or crc != zlib.crc32(self.data):
            raise RecordError("a BGZF block with a wrong checksum")
        self.next, self.at = self.block + size, 0
        return True

    def tell(self) -> int:
        if self.at >= len(self.data):
            return virtual_offset(self.next, 0)
        return virtual_offset(self.block, self.at)

    def read(self, n: int) -> bytes:
        """n bytes, or less at the end."""
        if self.at + n <= len(self.data):
            out = self.data[self.at : self.at + n]
            self.at += n
            return out
        parts = [self.data[self.at :]]
        have = len(parts[0])
        self.at = len(self.data)
        while have < n and self._load():
            part = self.data[: n - have]
            self.at = len(part)
            have += len(part)
            parts.append(part)
        return b"".join(parts)


def has_eof_marker(source, size: int) -> bool:
    if size < len(EOF_MARKER):
        return False
    source.seek(size - len(EOF_MARKER))
    return source.read(len(EOF_MARKER)) == EOF_MARKER


def blocks(source) -> Iterator[tuple[int, int]]:
    """(offset, size) of each block, by reading heads only."""
    at = 0
    while True:
        source.seek(at)
        head = source.read(18)
        if not head:
            return
        size = block_size(head)
        yield at, size
        at += size
