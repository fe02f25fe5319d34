"""The regions of each read, from sorted bins, in numpy: a reduction without a row for each pair, or the pairs themselves.

Rows of both sides come sorted by (chrom, width, bin), regions of a bin before
its reads. Equal shapes of reads are looked at once; a shape's shared bases with
the regions are counted in small matrices, of which only the number of
qualifying regions and the best one are kept. So the time, but neither memory
nor what is shuffled or written, grows with the pairs of shapes and regions.
Pairs, where they are wanted, leave as units: some reads, some regions and a bit
for each shape and region. Units are dealt out anew before they become rows, so
a bin with most pairs is not one task's to write.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Reads that are looked at together, and shapes and regions of one matrix.
READS, SHAPES, COLUMNS = 1 << 17, 64, 1 << 13
#: Reads of a unit, reads times regions of it, units of a bin that stay together, and pairs of one batch.
UNIT_READS, CELLS, UNITS, ROWS = 1 << 10, 1 << 19, 64, 1 << 15


def _flat(spans: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and ends of lists of intervals."""
    if isinstance(spans, pa.ChunkedArray):
        spans = spans.combine_chunks()
    spans = pa.concat_arrays(spans.chunks) if isinstance(spans, pa.ChunkedArray) else spans
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = spans.flatten()
    starts, ends = (parts.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), starts, ends


class Regions:
    """Regions of a bin, the shortest and first ones first. Places count from the bin's begin and are cut where no read of the bin can lie."""

    def __init__(self, table: pa.Table, width: int, bin_: int) -> None:
        offsets, starts, ends = _flat(table["spans"])
        counts = np.diff(offsets)
        ordinals = table["ordinal"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(np.maximum(ends - starts, 0))])
        order = np.lexsort((ordinals, sums[offsets[1:]] - sums[offsets[:-1]]))
        order = order[counts[order] > 0]
        self.kind = np.int16 if width <= 13 else np.int32 if width <= 29 else np.int64
        self.base = bin_ << width
        room = 1 << min(width + 1, 62)
        self.starts, self.ends = (np.clip(x - self.base, 0, room).astype(self.kind) for x in (starts, ends))
        self.ordinals, self.keys = ordinals[order], table["key"].combine_chunks().take(pa.array(order))
        self.first, self.counts = offsets[:-1][order], counts[order]
        self.low, self.high = self.starts[self.first], self.ends[self.first + self.counts - 1]

    def shared(self, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Common positions of each shape with each of the regions ``which``."""
        out = np.zeros((len(starts), len(which)), self.kind)
        counts, first = self.counts[which], self.first[which]
        for j in range(counts.max()):
            has = np.nonzero(counts > j)[0]
            at = first[has] + j
            s, e = self.starts[at], self.ends[at]
            part = out if len(has) == len(which) else np.zeros((len(starts), len(has)), self.kind)
            for b in range(starts.shape[1]):
                x = np.minimum(ends[:, b, None], e)
                x -= np.maximum(starts[:, b, None], s)
                part += np.maximum(x, 0, out=x)
            if part is not out:
                out[:, has] += part
        return out

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Which shapes, their lengths, the places of regions that can meet them, and the common positions. Shapes are sorted by their first start."""
        starts, ends = ((x - self.base).astype(self.kind) for x in (starts, ends))
        for i in range(0, len(starts), SHAPES):
            s, e = starts[i : i + SHAPES], ends[i : i + SHAPES]
            near = np.nonzero((self.low < e.max()) & (self.high > s.min()))[0]
            whole = (e - s).sum(axis=1, dtype=self.kind)[:, None]
            for c in range(0, len(near), COLUMNS):
                which = near[c : c + COLUMNS]
                yield slice(i, i + len(s)), whole, which, self.shared(s, e, which)

    def find(self, starts: np.ndarray, ends: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """For each shape the place of its best region (-1: none) and how many qualify."""
        best, many = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        top = np.zeros(len(starts), self.kind)
        for at, whole, which, shared in self.pieces(starts, ends):
            fit = shared == whole if mode == "contained" else shared > 0
            many[at] += np.count_nonzero(fit, axis=1)
            if mode == "overlap":
                continue
            value = shared if mode == "best-overlap" else fit.view(np.int8)
            first = value.argmax(axis=1)  # the first of the greatest
            got = value[np.arange(len(value)), first]
            better = got > top[at]
            best[at][better] = which[first[better]]
            top[at][better] = got[better]
        return best, many


def _shapes(reads: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By the number of intervals: rows, sorted by shape; the place of each row's shape; starts and ends of the shapes."""
    offsets, starts, ends = _flat(reads["spans"])
    counts = np.diff(offsets)
    for k in np.unique(counts[counts > 0]):
        rows = np.nonzero(counts == k)[0]
        at = offsets[rows][:, None] + np.arange(k)
        shapes = np.concatenate([starts[at], ends[at]], axis=1)
        order = np.lexsort(shapes.T[::-1])
        rows, shapes = rows[order], shapes[order]
        new = np.concatenate([[True], (shapes[1:] != shapes[:-1]).any(axis=1)])
        yield rows, np.cumsum(new) - 1, shapes[new][:, :k], shapes[new][:, k:]


def _place(reads: pa.Table, regions: Regions | None, mode: str) -> tuple[np.ndarray, np.ndarray]:
    best, many = np.full(len(reads), -1), np.zeros(len(reads), np.int64)
    if regions is None:
        return best, many
    for rows, shape, starts, ends in _shapes(reads):
        b, n = regions.find(starts, ends, mode)
        best[rows], many[rows] = b[shape], n[shape]
    return best, many


def _units(reads: pa.Table, regions: Regions) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs that share positions, in units: rows of reads, how many of them each shape has, places of regions, and whether (region, shape) is a pair."""
    for rows, shape, starts, ends in _shapes(reads):
        for at, _, which, shared in regions.pieces(starts, ends):
            a, b = np.searchsorted(shape, (at.start, at.stop))
            fit = shared > 0
            for i in range(a, b, UNIT_READS):
                mine, of = rows[i : min(b, i + UNIT_READS)], shape[i : min(b, i + UNIT_READS)]
                some = fit[of[0] - at.start : of[-1] + 1 - at.start]
                near = np.nonzero(some.any(axis=0))[0]
                step = max(1, CELLS // len(mine))
                for c in range(0, len(near), step):
                    yield mine, np.bincount(of - of[0]), which[near[c : c + step]], some[:, near[c : c + step]].T


def _expanded(many: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a unit of the reads and regions of its pairs. Pairs of a region stand together."""
    hit = fit.take(np.repeat(np.arange(len(many)), many), axis=1)
    found = np.count_nonzero(hit, axis=1)
    return np.flatnonzero(hit) - np.repeat(np.arange(len(hit)) * hit.shape[1], found), np.repeat(np.arange(len(hit)), found)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], pa.Table, Regions | None]]:
    """The bin, reads of it, so many at once, with its regions (None: it has none), of rows chrom, width, bin, side (0: region), ordinal, key, spans and more."""
    now, pending, regions = None, [], None
    reads: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        names = table["chrom"].combine_chunks().dictionary_encode()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        parts = [names.indices.to_numpy(zero_copy_only=False), *(table[c].to_numpy() for c in ("width", "bin", "side"))]
        cuts = np.nonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, len(table)], strict=True):
            key = (names.dictionary[int(parts[0][a])].as_py(), int(parts[1][a]), int(parts[2][a]))
            if key != now:
                if reads:
                    yield now, pa.concat_tables(reads), regions
                now, pending, regions, reads = key, [], None, []
            piece = table.slice(a, b - a)
            if parts[3][a] == 0:
                pending.append(piece)
                continue
            if pending:
                regions, pending = Regions(pa.concat_tables(pending), now[1], now[2]), []
            reads.append(piece)
            if sum(map(len, reads)) >= READS:
                yield now, pa.concat_tables(reads), regions
                reads = []
    if reads:
        yield now, pa.concat_tables(reads), regions


def placer(mode: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the rows of :func:`_runs` with ``keep``: ordinal, keep, region_ordinal, key, candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, regions in _runs(batches):
            best, many = _place(table, regions, mode)
            none = best < 0
            if regions is None or not len(regions.ordinals):
                places, keys = pa.nulls(len(table), pa.int64()), pa.nulls(len(table), pa.string())
            else:
                at = pa.array(best, mask=none)
                places, keys = pa.array(regions.ordinals).take(at), regions.keys.take(at)
            out = table.select(["ordinal", *keep]).append_column("region_ordinal", places).append_column("key", keys.cast(pa.string())).append_column("candidates", pa.array(many))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def unit_maker() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the rows of :func:`_runs`: chrom, width, bin, part (as units are numbered in their bin), ordinals, many, keys, places, fit.

    Reads must come in one order, whatever the run: a unit is not to hold others when its task is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for bin_, table, regions in _runs(batches):
            if regions is None:
                continue
            if bin_ != now:
                now, n = bin_, 0
            ordinals = _plain(table["ordinal"])
            for read, many, place, fit in _units(table, regions):
                lists = (ordinals.take(pa.array(read)), pa.array(many, pa.int32()), regions.keys.take(pa.array(place)).cast(pa.string()), pa.array(regions.ordinals[place], pa.int64()))
                values = [*(pa.array([x], t) for x, t in zip((*bin_, n // UNITS), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)]
                yield pa.RecordBatch.from_arrays([*values, pa.array([np.packbits(fit).tobytes()])], ["chrom", "width", "bin", "part", "ordinals", "many", "keys", "places", "fit"])
                n += 1

    return run


def expander() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over units: ordinal, key, region_ordinal of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ordinals, many, keys, places = (batch.column(c)[i].values for c in ("ordinals", "many", "keys", "places"))
                bits = np.frombuffer(batch.column("fit")[i].as_py(), np.uint8)
                fit = np.unpackbits(bits, count=len(places) * len(many)).view(np.bool_).reshape(len(places), len(many))
                read, place = _expanded(many.to_numpy(), fit)
                for c in range(0, len(read), ROWS):
                    r, p = pa.array(read[c : c + ROWS]), pa.array(place[c : c + ROWS])
                    yield pa.RecordBatch.from_arrays([ordinals.take(r), keys.take(p), places.take(p)], ["ordinal", "key", "region_ordinal"])

    return run
