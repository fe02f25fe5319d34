"""Media columns as progressive JPEG.

The decoder reads progressive (and extended sequential) Huffman JPEG: it
adds up spectral-selection and successive-approximation scans in coefficient
arrays, dequantises, inverse-transforms in numpy, upsamples chroma and gives
an RGB tensor of full resolution. Where all tokens of a scan have one width
(the tables say so), it reads the scan in one numpy step; else it walks the
bits.

The encoder stores bytes without loss, 64 to a block, as quantised
coefficients: byte b is the coefficient b - 255 if b < 128, else b; these 256
values are those that take eight extra bits, and they are never 0. An image
has 4:2:0 sampling; its scans are DC and AC without their low bit (luma's AC in
two bands), then the low bits. The number of payload blocks is kept in an APP9 segment; blocks
that fill up the image hold byte 0.

A null or empty payload is one block of bytes 0 (the caller pads).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64
#: Natural index of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
_MARK = b"LWPAY\0"
_BASIS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)], np.float32)

# ---------------------------------------------------------------- payloads as coefficients


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _to_coefficients(payload: np.ndarray) -> np.ndarray:
    wide = payload.astype(np.int16)
    return np.where(wide < 128, wide - 255, wide)


def _to_bytes(coefficients: np.ndarray) -> np.ndarray:
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8)


# ---------------------------------------------------------------- encoder


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbols_by_length: dict[int, list[int]]) -> bytes:
    lengths = bytes(len(symbols_by_length.get(i, [])) for i in range(1, 17))
    return bytes([kind << 4 | number]) + lengths + bytes(s for i in range(1, 17) for s in symbols_by_length.get(i, []))


def _scan(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data


def _flush(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled with ones, 0xFF followed by 0."""
    fill = -len(bits) % 8
    raw = np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


def _numbers(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The low ``widths`` bits of each value, most significant first."""
    shifts = np.arange(widths.max() - 1 if len(widths) else 0, -1, -1)
    return ((values[:, None] >> shifts) & 1)[shifts < widths[:, None]].astype(np.uint8)


#: DC categories 0 to 8 as codes of four bits, for differences of seven-bit values.
_DC_TABLE = _table(0, 0, {4: list(range(9))})
#: AC first scan: category 7 alone, the code 0; with it a token is a byte below 0x80.
_AC_TABLE = _table(1, 0, {1: [0x07]})
#: AC refinement: end-of-band runs of 2^0 to 2^14 blocks as codes of four bits.
_EOB_TABLE = _table(1, 1, {4: [i << 4 for i in range(15)]})


def _geometry(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units that hold so many blocks, six in each."""
    units = -(-blocks // 6)
    columns = min(max(1, int(np.ceil(np.sqrt(units)))), 4095)
    return columns, -(-units // columns)


def _planes(blocks: np.ndarray, columns: int, rows: int) -> list[np.ndarray]:
    """Units of six blocks as the component arrays (rows, columns, 64) of Y, Cb, Cr."""
    units = blocks.reshape(rows, columns, 6, BLOCK)
    y = units[:, :, :4].reshape(rows, columns, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(rows * 2, columns * 2, BLOCK)
    return [y, units[:, :, 4], units[:, :, 5]]


def _units(planes: list[np.ndarray]) -> np.ndarray:
    rows, columns = planes[1].shape[:2]
    out = np.empty((rows, columns, 6, BLOCK), planes[0].dtype)
    out[:, :, :4] = planes[0].reshape(rows, 2, columns, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, BLOCK)
    out[:, :, 4], out[:, :, 5] = planes[1], planes[2]
    return out.reshape(-1, BLOCK)


def _dc_bits(diffs: np.ndarray) -> np.ndarray:
    category = np.zeros(len(diffs), np.int64)
    size = np.abs(diffs)
    for i in range(9):
        category += size >= 1 << i
    extra = np.where(diffs < 0, diffs + (1 << category) - 1, diffs)
    return _numbers(category << category | extra, category + 4)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload (a positive multiple of 64 bytes)."""
    count = len(payload) // BLOCK
    columns, rows = _geometry(count)
    raw = np.zeros((columns * rows * 6, BLOCK), np.uint8)
    raw[:count] = np.frombuffer(payload, np.uint8).reshape(count, BLOCK)
    planes = _planes(raw, columns, rows)
    out = [
        b"\xff\xd8",
        _segment(0xE9, _MARK + struct.pack(">Q", count)),
        _segment(0xDB, b"\0" + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, _DC_TABLE + _AC_TABLE + _EOB_TABLE),
    ]
    dc = _to_coefficients(raw[:, 0])
    high = (dc >> 1).astype(np.int64)
    owner = np.tile(np.array([0, 0, 0, 0, 1, 2]), columns * rows)
    diffs = high.copy()
    for c in range(3):
        own = np.flatnonzero(owner == c)
        diffs[own[1:]] -= high[own[:-1]]
    everyone = [(1, 0), (2, 0), (3, 0)]
    out.append(_scan(everyone, 0, 0, 0, 1, _flush(_dc_bits(diffs))))
    for c, plane in enumerate(planes):
        half = plane >> 1
        for ss, se in ((1, 5), (6, 63)) if c == 0 else ((1, 63),):
            out.append(_scan([(c + 1, 0)], ss, se, 0, 1, half[:, :, ss : se + 1].tobytes()))
    out.append(_scan(everyone, 0, 0, 1, 0, _flush((dc & 1).astype(np.uint8))))
    for c, plane in enumerate(planes):
        low = plane[:, :, 1:].reshape(-1, BLOCK - 1)
        low = np.where(low < 128, ~low, low) & 1  # of the magnitude
        parts, at = [], 0
        while at < len(low):
            run = min(14, int(len(low) - at).bit_length() - 1)
            parts += [_numbers(np.array([run]), np.array([4])), np.zeros(run, np.uint8), low[at : at + (1 << run)].ravel()]
            at += 1 << run
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, _flush(np.concatenate(parts))))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- decoder


class _Huffman:
    """A table: by the next 16 bits, the code's length and symbol."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.length = np.zeros(65536, np.uint8)
        self.symbol = np.zeros(65536, np.uint8)
        code = at = 0
        for size, n in enumerate(lengths, 1):
            for s in symbols[at : at + n]:
                span = 1 << (16 - size)
                self.length[code * span : (code + 1) * span] = size
                self.symbol[code * span : (code + 1) * span] = s
                code += 1
            at += n
            code <<= 1
        self.length, self.symbol = self.length.tobytes(), self.symbol.tobytes()
        self.only = (next(i for i, n in enumerate(lengths, 1) if n), symbols[0]) if sum(lengths) == 1 else None


@lru_cache(64)
def _huffman(lengths: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(lengths, symbols)


class _Bits:
    """The bits of one stretch of entropy-coded data."""

    def __init__(self, data: bytes):
        self.size = len(data) * 8
        self.value = data + b"\xff" * 8  # as filled
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        at, self.at = self.at, self.at + n
        if self.at > self.size:
            raise ValueError("JPEG data ends early")
        word = int.from_bytes(self.value[at >> 3 : (at >> 3) + 5], "big")
        return word >> (40 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: _Huffman) -> int:
        word = int.from_bytes(self.value[self.at >> 3 : (self.at >> 3) + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF
        n = table.length[word]
        if not n:
            raise ValueError("JPEG data has no such code")
        self.at += n
        if self.at > self.size:
            raise ValueError("JPEG data ends early")
        return table.symbol[word]

    def number(self, table: _Huffman) -> int:
        """A symbol that is a size of at most 16, and the signed number in so many bits after it."""
        at = self.at
        word = int.from_bytes(self.value[at >> 3 : (at >> 3) + 5], "big") & (1 << 40 - (at & 7)) - 1
        left = 40 - (at & 7)
        code = word >> left - 16
        n, size = table.length[code], table.symbol[code]
        self.at = at + n + size
        if not n or self.at > self.size:
            raise ValueError("JPEG data has no such code, or ends early")
        value = word >> left - n - size & (1 << size) - 1
        return value if not size or value >> size - 1 else value - (1 << size) + 1

    def many(self, n: int) -> np.ndarray:
        """The next n bits, one in each entry."""
        at, self.at = self.at, self.at + n
        if self.at > self.size:
            raise ValueError("JPEG data ends early")
        return np.unpackbits(np.frombuffer(self.value, np.uint8, (self.at + 7 >> 3) - (at >> 3), at >> 3))[at & 7 : (at & 7) + n]


def _extended(value: int, bits: int) -> int:
    return value if not bits or value >> (bits - 1) else value - (1 << bits) + 1


class _Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.quantiser = number, h, v, table


class Decoded:
    """Coefficients of the components, (block rows, block columns, 64) in zigzag order, and what is needed for pixels."""

    def __init__(self):
        self.width = self.height = 0
        self.components: list[_Component] = []
        self.planes: list[np.ndarray] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.payload_blocks: int | None = None

    def payload(self) -> bytes:
        if self.payload_blocks is None:
            raise ValueError("the JPEG holds no payload")
        return _to_bytes(_units(self.planes)[: self.payload_blocks]).tobytes()

    def rgb(self) -> np.ndarray:
        """The picture, (height, width, 3) uint8."""
        tallest, widest = max(c.v for c in self.components), max(c.h for c in self.components)
        samples = []
        for c, plane in zip(self.components, self.planes, strict=True):
            rows, columns = plane.shape[:2]
            natural = np.zeros((rows * columns, 64), np.float32)
            natural[:, ZIGZAG] = plane.reshape(-1, 64) * self.quantisers[c.quantiser].astype(np.float32)
            half = natural.reshape(-1, 8) @ _BASIS.T  # along rows
            pixels = np.matmul(_BASIS, half.reshape(-1, 8, 8)) + 128
            pixels = pixels.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
            if (c.v, c.h) != (tallest, widest):
                pixels = pixels.repeat(tallest // c.v, axis=0).repeat(widest // c.h, axis=1)
            samples.append(pixels[: self.height, : self.width])
        if len(samples) == 1:
            y = samples[0]
            out = np.stack([y, y, y], axis=-1)
        else:
            y, cb, cr = samples[0], samples[1] - 128, samples[2] - 128
            out = np.empty((*y.shape, 3), np.float32)
            out[..., 0] = y + 1.402 * cr
            out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
            out[..., 2] = y + 1.772 * cb
        return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


#: The next marker that is no restart; 0xFF before 0 is data.
_NEXT = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Decoded:
    """Read all scans of a JPEG into coefficients."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, huffman, interval, at = Decoded(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, number = body[i] >> 4, body[i] & 15
                out.quantisers[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int32)
                i += 65 + 64 * wide
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                lengths = body[i + 1 : i + 17]
                huffman[body[i]] = _huffman(lengths, body[i + 17 : i + 17 + sum(lengths)])
                i += 17 + sum(lengths)
        elif marker in (0xC0, 0xC1, 0xC2):
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            tallest, widest = max(c.v for c in out.components), max(c.h for c in out.components)
            rows, columns = -(-out.height // (8 * tallest)), -(-out.width // (8 * widest))
            out.planes = [np.zeros((rows * c.v, columns * c.h, 64), np.int32) for c in out.components]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xE9 and body.startswith(_MARK):
            out.payload_blocks = struct.unpack_from(">Q", body, len(_MARK))[0]
        elif marker == 0xDA:
            found = _NEXT.search(data, at)
            if not found:
                raise ValueError("JPEG data ends early")
            _read_scan(out, body, data[at : found.start()], huffman, interval)
            at = found.start()
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError(f"JPEG process {marker:#x} isn't handled")
    return out


def _stretches(data: bytes) -> list[bytes]:
    """The data between restart markers, without stuffing."""
    return [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data)]


@lru_cache(256)
def _interleaved(rows: int, columns: int, v: int, h: int) -> np.ndarray:
    """For each unit of a scan over several components, the blocks of one component."""
    across = columns // h
    unit = np.arange(across * (rows // v))
    top, left = unit // across * v, unit % across * h
    return ((top[:, None, None] + np.arange(v)[:, None]) * columns + left[:, None, None] + np.arange(h)).reshape(len(unit), -1)


def _read_scan(out: Decoded, body: bytes, data: bytes, huffman: dict[int, _Huffman], interval: int) -> None:
    n = body[0]
    numbers = [c.number for c in out.components]
    chosen = [(numbers.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1:  # the blocks that the picture needs, row by row
        i, tables = chosen[0]
        c = out.components[i]
        tallest, widest = max(c.v for c in out.components), max(c.h for c in out.components)
        rows = -(-(-(-out.height * c.v // tallest)) // 8)
        columns = -(-(-(-out.width * c.h // widest)) // 8)
        units = rows * columns
        if (rows, columns) == out.planes[i].shape[:2]:
            index = np.arange(units)
        else:
            index = (np.arange(rows)[:, None] * out.planes[i].shape[1] + np.arange(columns)).ravel()
        order = [(i, tables, index)]
    else:
        order, units = [], 0
        for i, tables in chosen:
            c, (rows, columns) = out.components[i], out.planes[i].shape[:2]
            index = _interleaved(rows, columns, c.v, c.h)
            units = len(index)
            order.append((i, tables, index))
    flat = [p.reshape(-1, 64) for p in out.planes]
    stretches = _stretches(data)
    step = interval or units
    for k, part in enumerate(stretches):
        first, last = k * step, min(units, (k + 1) * step)
        if first >= last:
            break
        bits = _Bits(part)
        if ss == 0:
            _read_dc(flat, [(i, t, x.reshape(units, -1)[first:last]) for i, t, x in order], huffman, bits, ah, al, se)
        else:
            i, tables, index = order[0]
            own = huffman[0x10 | tables & 15]
            (_refine_ac if ah else _read_ac)(flat[i], index[first:last], own, bits, ss, se, al)


def _read_dc(flat: list[np.ndarray], order: list, huffman: dict[int, _Huffman], bits: _Bits, ah: int, al: int, se: int) -> None:
    """DC of a scan, and in sequential JPEG the AC after each."""
    total = [x.shape[1] for _, _, x in order]
    if ah:
        got = bits.many(sum(total) * len(order[0][2])).reshape(-1, sum(total)).astype(np.int32)
        at = 0
        for (i, _, index), n in zip(order, total, strict=True):
            # the added bit raises the two's complement value that the first scan shifted
            flat[i][index, 0] |= got[:, at : at + n] << al
            at += n
        return
    before = [0] * len(order)
    rows = [x.tolist() for _, _, x in order]
    tables = [huffman[t >> 4] for _, t, _ in order]
    values: list[list[int]] = [[] for _ in order]
    for u in range(len(rows[0])):
        for k in range(len(order)):
            for block in rows[k][u]:
                before[k] += bits.number(tables[k])
                values[k].append(before[k])
                if se:
                    _sequential(flat[order[k][0]][block], huffman[0x10 | order[k][1] & 15], bits)
    for k, (i, _, index) in enumerate(order):
        flat[i][index.ravel(), 0] = np.array(values[k], np.int32) << al


def _sequential(block: np.ndarray, table: _Huffman, bits: _Bits) -> None:
    k = 1
    while k < 64:
        s = bits.symbol(table)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                return
            k += 16
            continue
        k += run
        block[k] = _extended(bits.take(size), size)
        k += 1


def _read_ac(plane: np.ndarray, index: np.ndarray, table: _Huffman, bits: _Bits, ss: int, se: int, al: int) -> None:
    """First scan of a band."""
    if table.only and not table.only[1] >> 4 and table.only[1] & 15:  # each token the same width, each coefficient there
        width, size = table.only[0] + (table.only[1] & 15), table.only[1] & 15
        n = len(index) * (se - ss + 1)
        if width == 8:
            value = np.frombuffer(bits.value, np.uint8, n, bits.at >> 3).astype(np.int32)
            bits.at += n * 8
        else:
            value = bits.many(n * width).reshape(n, width).astype(np.int32) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int32))
        if bits.at > bits.size or (value >> size).any():
            raise ValueError("JPEG data has no such code")
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        _put_band(plane, index, ss, se, (value * (1 << al)).reshape(len(index), -1))
        return
    run_left = 0
    for b in index.tolist():
        if run_left:
            run_left -= 1
            continue
        block, k = plane[b], ss
        while k <= se:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            if size:
                k += run
                block[k] = _extended(bits.take(size), size) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                run_left = (1 << run) - 1 + bits.take(run)
                break


def _put_band(plane: np.ndarray, index: np.ndarray, ss: int, se: int, values: np.ndarray) -> None:
    if len(index) == len(plane):
        plane[:, ss : se + 1] = values
    else:
        plane[index, ss : se + 1] = values


def _refine_ac(plane: np.ndarray, index: np.ndarray, table: _Huffman, bits: _Bits, ss: int, se: int, al: int) -> None:
    """Later scan of a band: a bit for each coefficient that is there, and new ones of magnitude one."""
    step, at = 1 << al, 0
    while at < len(index):
        b = index[at]
        block, k, left = plane[b], ss, 0
        while k <= se:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif run < 15:
                left = (1 << run) + bits.take(run)  # with this block
                break
            while k <= se:
                if block[k]:
                    if bits.take(1) and not block[k] & step:
                        block[k] += step if block[k] > 0 else -step
                elif run == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
            else:
                continue
        if left:  # the rest of this block and whole blocks: only correction bits, in order
            rows = slice(at, at + left) if len(index) == len(plane) else index[at : at + left]
            band = plane[rows, ss : se + 1]
            there = band != 0
            there[0, : k - ss] = False
            if there.all():
                got = bits.many(there.size).reshape(band.shape).astype(np.int32)
            else:
                got = np.zeros(band.shape, np.int32)
                got[there] = bits.many(int(there.sum()))
            plane[rows, ss : se + 1] = np.where(band < 0, band - got * step, band + got * step)
            at += left
        else:
            at += 1


# ---------------------------------------------------------------- columns


def store(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with a binary column ``out``: the text's UTF-8 bytes, padded, as a progressive JPEG."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    from .common import free_name

    @arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([encode(padded((t or "").encode("utf-8", "surrogatepass"))) for t in texts.to_pylist()], pa.binary())

    return docs.withColumn(free_name(docs, out), stored.asNondeterministic()(F.col(text_col)))


READ = "struct<payload: binary, height: int, width: int, rgb: binary>"


def load(docs: DataFrame, media_col: str = "media", out: str = "picture") -> DataFrame:
    """``docs`` with a struct column ``out``: payload read back (null if the JPEG holds none), height, width, rgb bytes.

    A null media value gives a null struct.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    from .common import free_name

    kind = pa.struct([("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    @arrow_udf(READ)
    def loaded(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in media:
            rows = []
            for data in batch:
                if not data.is_valid:
                    rows.append(None)
                    continue
                got = decode(data.as_py())
                picture = got.rgb()
                rows.append({"payload": None if got.payload_blocks is None else got.payload(), "height": picture.shape[0], "width": picture.shape[1], "rgb": picture.tobytes()})
            yield pa.array(rows, kind)

    return docs.withColumn(free_name(docs, out), loaded.asNondeterministic()(F.col(media_col)))
