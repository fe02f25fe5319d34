"""Near-duplicate classes by Order MinHash.

A text is the sequence of its words (A-Z folded to a-z; runs of letters,
digits and code points above 0x7F). Its k-mers of ``K`` words are labelled
with their occurrence number. Each of ``SKETCHES`` hash functions picks the
``PICKED`` k-mers of least hash and keeps their order in the text; texts with
an equal sketch are candidates. Texts of up to ``SHORT`` words, of which few
k-mers outlive an edit, have ``SHORT_SKETCHES`` more, of single words; two
texts as alike as ``SIMILARITY`` have at least one kind in common, whatever
their lengths, and it is dense enough for edits at that bound, also where they
are spread evenly. A candidate pair is a link if a banded
alignment of the two word sequences finds an edit similarity
``1 - distance / longer length`` of at least ``SIMILARITY``.

Equal texts are one node from the start, whatever their number. In a bucket of
equal sketches every node is aligned with the bucket's least node, its hub:
as many pairs as rows. Links to hubs give components. A bucket whose other rows
are all in one component is done; in any other, rows of different components
are compared with one another, exactly: lengths and word counts rule most pairs
out, the rest are aligned where they are compared, and what comes back is one
link for each two components that it joins. So neither a large group of copies
nor a passage that many unlike texts share makes rows for all its pairs.

Classes are the connected components of links; their id is the least document
id in them. Null texts count as empty, and texts without words are linked to
equal texts only. Null ids are never a class id unless a class has no other.
Repeated rows stay rows of the result; a task sketches a text once, so that
copies add few rows to a bucket. Nodes are named by a 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import files_beside, free_name, staged
from .decontaminate import words_of

K = 2
SKETCHES = 64
PICKED = 3
SIMILARITY = 0.8
#: Words up to which a text also has sketches of single words, and their number.
SHORT = 40
SHORT_SKETCHES = 32
#: Edits up to which the narrow band is tried.
NARROW = 12
#: Rows that are compared with one copy of their hub.
STAR_ROWS = 2000
#: Bins of the word counts that tell unlike texts apart before they are aligned.
BAG = 512
#: Bytes of a row in a comparison, besides its words.
ROW_BYTES = 2 * BAG + 200
#: Bytes of a bucket's rows that are compared as one block, and of what a task compares at once, about.
BLOCK_BYTES = 2 << 20
CELL_BYTES = 16 << 20

_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2)
_WORD = _rng.integers(0, 1 << 63, max(K, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: k-mers hashed by all functions at once.
_AT_ONCE = 512

# ---------------------------------------------------------------- sketches


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def word_codes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def sketch(codes: np.ndarray, k: int = K, sketches: int = SKETCHES) -> np.ndarray | None:
    """The sketches of a word sequence, or None if it has no word."""
    n = len(codes)
    if not n:
        return None
    k = min(k, n)
    wide = codes.astype(np.uint64)
    kmers = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        kmers = _mixed(kmers + wide[i : n - k + 1 + i] * _WORD[i])
    order = np.argsort(kmers, kind="stable")
    same = np.concatenate(([False], kmers[order][1:] == kmers[order][:-1]))
    at = np.arange(len(kmers))
    first = np.maximum.accumulate(np.where(same, 0, at))
    number = np.empty(len(kmers), np.uint64)  # of the occurrence, in text order
    number[order] = (at - first).astype(np.uint64)
    kmers = _mixed(kmers + number * _WORD[0])
    odd, add, rows = _ODD[:sketches], _ADD[:sketches], np.arange(sketches)
    least, places = [], []
    for start in range(0, len(kmers), _AT_ONCE):
        hashed = odd[:, None] * kmers[start : start + _AT_ONCE]
        hashed += add[:, None]
        hashed ^= hashed >> np.uint64(32)
        for _ in range(min(PICKED, hashed.shape[1])):
            at_least = hashed.argmin(axis=1)
            places.append(at_least + start)
            least.append(hashed[rows, at_least])
            hashed[rows, at_least] = _NONE
    places = np.stack(places, axis=1)
    if places.shape[1] > PICKED:
        picked = np.argpartition(np.stack(least, axis=1), PICKED - 1, axis=1)[:, :PICKED]
        places = np.take_along_axis(places, picked, 1)
    found = add.copy()
    for place in np.sort(places, axis=1).T:
        found = _mixed(found * _WORD[1] + kmers[place])
    return found


def all_sketches(codes: np.ndarray) -> np.ndarray | None:
    """Sketches of K-mers, and of single words behind them where the text is short."""
    found = sketch(codes)
    if found is None or len(codes) > SHORT:
        return found
    return np.concatenate([found, sketch(codes, 1, SHORT_SKETCHES)])


# ---------------------------------------------------------------- alignment


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Equal words from word i of a and word j of b on, at most ``most``; words are four bytes."""
    done, step = 0, 4
    while done < most:
        step = min(step, most - done)
        if a[4 * (i + done) : 4 * (i + done + step)] == b[4 * (j + done) : 4 * (j + done + step)]:
            done += step
            step *= 4
        elif step == 1:
            break
        else:
            most, step = done + step - 1, max(1, step // 2) if step > 2 else 1
    return done


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two word sequences, or None if it is above ``limit``.

    Equal ends are cut off and word counts compared; then a narrow band of
    diagonals is tried, and beyond it whole columns as bits.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    least = min(len(a), len(b))
    off = np.flatnonzero(a[:least] != b[:least])
    head = int(off[0]) if len(off) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    off = np.flatnonzero(a[::-1][:least] != b[::-1][:least]) if least else off[:0]
    tail = int(off[0]) if len(off) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= limit else None
    words_a, counts_a = np.unique(a, return_counts=True)
    words_b, counts_b = np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(words_a, words_b, assume_unique=True, return_indices=True)
    if max(n, m) - int(np.minimum(counts_a[at_a], counts_b[at_b]).sum()) > limit:
        return None
    band = min(limit, NARROW)
    found = _by_diagonals(a, b, band)
    if found is None and band < limit:
        found = _by_bits(a.tolist(), b.tolist(), limit)
    return found


def _by_bits(a: list[int], b: list[int], limit: int) -> int | None:
    """Distance column by column, a column's steps up and down as the bits of two numbers.

    Rows further than ``limit`` from the diagonal can't be on a path that counts;
    the value at the column's end tells early that the limit can't be kept.
    """
    at: dict[int, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    every = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    up, down, value = every, 0, len(a)
    left = len(b)
    for word in b:
        left -= 1
        equal = at.get(word, 0)
        level = ((equal & up) + up ^ up) | equal | down
        right = down | every & ~(level | up)
        back = level & up
        if right & last:
            value += 1
        elif back & last:
            value -= 1
        if value - left > limit:
            return None
        right = (right << 1 | 1) & every
        up = (back << 1 & every) | every & ~(level | right)
        down = right & level
    return value if value <= limit else None


def _by_diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Distance by a band of diagonals around the main one, widened edit by edit; on each only the furthest point is kept."""
    n, m = len(a), len(b)
    raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
    goal = m - n
    if abs(goal) > limit:
        return None
    reach = {0: _common(raw_a, 0, raw_b, 0, min(n, m))}  # diagonal j - i: furthest i
    if goal == 0 and reach[0] == n:
        return 0
    for d in range(1, limit + 1):
        new = {}
        for k in range(max(-d, -n, goal - (limit - d)), min(d, m, goal + (limit - d)) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if k - 1 not in reach and k + 1 not in reach and k not in reach:
                continue
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            i += _common(raw_a, i, raw_b, i + k, min(n - i, m - i - k))
            new[k] = i
        if new.get(goal) == n:
            return d
        reach = new
    return None


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    return longest > 0 and distance_within(a, b, int(longest * (1 - similarity) + 1e-9)) is not None


# ---------------------------------------------------------------- stages


def node_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def bags(codes: list[np.ndarray]) -> np.ndarray:
    """Words counted in BAG bins: what of one text's bag is not in another's is a lower bound of their edit distance."""
    out = np.zeros((len(codes), BAG), np.uint16)
    for row, words in zip(out, codes, strict=True):
        row[:] = np.minimum(np.bincount(words % BAG, minlength=BAG), 65535)
    return out


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[np.ndarray], np.ndarray | None] | None = None) -> DataFrame:
    """(id, node, n_words, codes, sketches) of all rows; where a task meets a text again, the last two are null, as they are in texts without words."""
    find = find or all_sketches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            codes, sketches, n_words = [], [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = None if node in seen else word_codes(text)
                seen.add(node)
                found = None if own is None else find(own)
                n_words.append(None if own is None else len(own))
                codes.append(None if found is None else own.astype("<u4").tobytes())
                sketches.append(None if found is None else found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("node"), pa.array(n_words, pa.int32()), pa.array(codes, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                ["id", "node", "n_words", "codes", "sketches"],
            )

    rows = docs.select(F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    more = [T.StructField("n_words", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("sketches", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *more]))


def _read(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u4")


def star_places(pairs: DataFrame) -> DataFrame:
    """(node, place) of pairs (a, b), ``a`` a hub: its pairs are dealt to parts of about STAR_ROWS, each with the hub at its head."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    rows = pairs.join(parts, "a").select(F.col("b").alias("node"), "a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.lit(False).alias("head"))
    heads = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"))
    return rows.union(heads).select("node", F.struct("a", "part", "head").alias("place"))


def star_links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of hubs ``a`` from texts (node, codes, places): a part's rows are sorted behind its hub, so that a task holds one hub and a batch of rows."""
    places = texts.select("node", "codes", F.explode("places").alias("at"))
    both = places.select("at.a", "at.part", F.when(~F.col("at.head"), F.col("node")).alias("b"), "codes")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint32)
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for i, codes in enumerate(batch.column("codes")):
                if b[i].is_valid:
                    if alike(hub, _read(codes), similarity):
                        keep.append(i)
                else:
                    hub = _read(codes).copy()
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])

    both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.select("a", "b", "codes").mapInArrow(linked, "a long, b long")


def _length_class(n_words: str, similarity: float) -> str:
    """Lengths of texts that may be alike are in one class or in neighbouring ones."""
    return f"cast(floor(ln({n_words}) / {math.log(1.04 / similarity)!r}) as int)"


def tiles(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """What is compared with what: (cell, tile, node, label) of the rows (key, hub, node, n_words, label) of buckets with several labels.

    A bucket's rows are split by length class; a class is compared with itself
    and with the class below. Where that is more than BLOCK_BYTES it is dealt
    to blocks, and each two blocks are a tile, so that no task grows with a
    bucket. Buckets of one hub share rows, and so a cell. The last bits of ``tile`` say: 4, one block with itself; 2, of the
    second block; 1, of the class below.
    """
    rows = rows.withColumn("class", F.expr(_length_class("n_words", similarity)))
    spread = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("class").alias("top"), F.count("*").alias("n"))
    mixed = rows.join(spread.filter("least < most").select("key", "top"), "key")
    dealt = mixed.select("key", "hub", "node", "label", "n_words", "class", F.explode(F.expr("if(class < top, array(class, class + 1), array(class))")).alias("at"))
    weight = F.sum(F.col("n_words") * 4 + ROW_BYTES)
    sides = dealt.groupBy("key", "at").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("class").alias("own"), F.ceil(weight / BLOCK_BYTES).cast("int").alias("blocks"))
    sides = sides.filter("least < most and own = at").select("key", "at", "blocks")
    block = dealt.join(sides, ["key", "at"]).withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    pair = block.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pair = pair.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    marks = F.expr("if(low = high, 4, 0) + if(block > low, 2, 0) + if(class < at, 1, 0)").cast("long")
    return pair.select(
        F.xxhash64("hub", "at", "low", "high").alias("cell"),
        F.xxhash64("key", "at", "low", "high").bitwiseAND(F.lit(-8)).bitwiseOR(marks).alias("tile"),
        "node",
        "label",
        "n_words",
    )


def _compared(similarity: float):
    def compared(table: pa.Table) -> pa.Table:
        nodes, label = table["node"].to_numpy(), table["label"].to_numpy()
        codes = [_read(x) for x in table["codes"]]
        n_words = np.array([len(c) for c in codes])
        bag = bags(codes)
        totals = bag.sum(axis=1, dtype=np.int64)
        held = table["tiles"].combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        tile, row = held.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), held.value_lengths().to_numpy())
        order = np.argsort(tile, kind="stable")
        tile, row = tile[order], row[order]
        names, starts = np.unique(tile >> 3, return_index=True)
        root = np.unique(label, return_inverse=True)[1]
        tried, links = set(), []
        for start, end in zip(starts, np.append(starts[1:], len(tile)), strict=True):
            at, marks = row[start:end], tile[start:end] & 7
            if (root[at] == root[at[0]]).all():
                continue
            below = np.zeros(len(nodes), bool)
            below[at] = marks & 1
            alone = bool(marks[0] & 4)
            first = at if alone else at[marks & 2 == 0]
            second = at if alone else at[marks & 2 != 0]
            for k, i in enumerate(first):
                others = second[k + 1 :] if alone else second
                others = others[root[others] != root[i]]
                if below[i]:
                    others = others[~below[others]]
                limit = np.floor(np.maximum(n_words[others], n_words[i]) * (1 - similarity) + 1e-9)
                near = np.abs(n_words[others] - n_words[i]) <= limit
                others, limit = others[near], limit[near]
                if not len(others):
                    continue
                off = np.maximum(totals[others], totals[i]) - np.minimum(bag[others], bag[i]).sum(axis=1, dtype=np.int64)
                for j in others[off <= limit].tolist():
                    pair = (i, j) if i < j else (j, i)
                    if root[j] == root[i] or pair in tried:
                        continue
                    tried.add(pair)
                    if alike(codes[i], codes[j], similarity):
                        links.append((label[i], label[j]))
                        root[root == root[j]] = root[i]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compared


def leftover_links(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, files: int | None = None) -> DataFrame:
    """Links (a, b) between labels that rows (key, hub, node, n_words, label) of one bucket give: enough to join all that are linked."""
    dealt = staged(tiles(rows, similarity), "tiles", files)
    total = dealt.select("cell", "node", "n_words").distinct().agg(F.sum(F.col("n_words") * 4 + ROW_BYTES)).first()[0] or 0
    held = dealt.groupBy(F.expr(f"pmod(cell, {total // CELL_BYTES + 1})").alias("cell"), "node", "label").agg(F.collect_set("tile").alias("tiles"))
    held = held.join(texts.select("node", "codes").hint("merge"), "node").select("cell", "node", "label", "tiles", "codes")
    return held.groupBy("cell").applyInArrow(_compared(similarity), "a long, b long").distinct()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the least node that links lead to. ``files``: of a staged table, at most.

    Every node takes its least neighbour, if less than itself, as its parent;
    parents are followed to the roots, twice as far each round; and the links
    between different roots, few by then, are resolved in the same way.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = staged(links.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "links", files)
    parent = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    alone = links.select(F.col("a").alias("node")).distinct().join(parent, "node", "left_anti").select("node", F.col("node").alias("label"))
    labels = staged(parent.union(alone), "labels", files)
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = staged(labels.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), "labels", files)
        labels = moved.select("node", "label")
        if not moved.filter("moved").limit(1).count():
            break
    ends = [labels.select(F.col("node").alias(n), F.col("label").alias(f"root_{n}")) for n in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").filter("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    between = staged(between, "between", files)
    if not between.limit(1).count():
        return labels
    return relabelled(labels, components(between, files))


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels (node, label) whose label is a node of ``further`` take the label it has there."""
    up = further.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (id, node), one for each document, and (node, label) of the linked nodes."""
    rows = staged(sketched(docs, id_col, text_col, all_sketches), "sketches")
    files = files_beside(rows)
    bands = rows.filter(F.col("sketches").isNotNull()).select("node", "n_words", F.posexplode("sketches").alias("band", "sketch"))
    bands = bands.select(F.xxhash64("band", "sketch").alias("key"), "node", "n_words")
    # all rows go by key once; a key's rows are sorted and summed as a stream that can spill
    mates = Window.partitionBy("key")
    met = bands.withColumn("hub", F.min(F.struct("node", "n_words")).over(mates)).filter(F.col("node") != F.col("hub.node"))
    met = staged(met.select("key", "hub.node", "hub.n_words", "node", "n_words").toDF("key", "hub", "hub_words", "node", "n_words").distinct(), "buckets", files)  # rows of buckets with company, but for the hub
    near = F.abs(F.col("n_words") - F.col("hub_words")) <= F.floor(F.greatest("n_words", "hub_words") * (1 - similarity) + 1e-9)
    places = star_places(staged(met.filter(near).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs", files))
    others = met.select("node").distinct().select("node", F.lit(None).cast(places.schema["place"].dataType).alias("place"))
    wanted = places.union(others).groupBy("node").agg(F.collect_list("place").alias("places"))
    # no side has a known bound, so neither is broadcast; the words go by node once for all stars
    texts = rows.filter(F.col("codes").isNotNull()).select("node", "codes").join(wanted.hint("merge"), "node").dropDuplicates(["node"])
    texts = staged(texts, "texts", files)
    linked = components(star_links(texts, similarity), files)
    left = met.join(linked, "node", "left").select("key", "hub", "node", "n_words", F.coalesce("label", "node").alias("label"))
    more = staged(leftover_links(staged(left, "labelled", files), texts, similarity, files), "links", files)
    if more.limit(1).count():
        joined = components(more, files)
        rest = joined.join(linked, "node", "left_anti")  # nodes that had no link to a hub
        linked = staged(relabelled(linked, joined).union(rest), "labels", files)
    return rows.select("id", "node"), linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, class_id (least id in its class), class_size (rows in it) and class_texts (different texts in it)."""
    rows, linked = classes(docs, id_col, text_col, similarity)
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes = nodes.join(linked, "node", "left").select("node", "id", "n", F.coalesce("label", "node").alias("label"))
    totals = nodes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("class_texts"))
    of_node = nodes.select("node", "label").join(totals, "label").drop("label")
    return rows.join(of_node, "node").select("id", "class_id", "class_size", "class_texts")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (of repeated rows, any one)."""
    rows, linked = classes(docs, id_col, text_col, similarity)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    nodes = rows.groupBy("node").agg(least.alias("first")).select("node", "first.*")
    nodes = nodes.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chosen = nodes.groupBy("label").agg(F.min(F.struct("none", "id", "node")).alias("best")).select("best.id", "best.node")
    counts = rows.groupBy("node", "id").agg(F.count("*").alias("copies"))
    kept = counts.join(chosen, counts["id"].eqNullSafe(chosen["id"]) & (counts["node"] == chosen["node"]), "left_semi")
    kept = staged(kept.select(F.col("id").alias("_kept_id"), F.col("node").alias("_kept_node"), "copies"), "kept", files_beside(rows))
    node = free_name(docs, "_node")
    own = docs.withColumn(node, node_of(F.col(text_col)))

    def joined(which: DataFrame) -> DataFrame:
        return own.join(which, (own[node] == which["_kept_node"]) & own[id_col].eqNullSafe(which["_kept_id"]), "left_semi")

    out = joined(kept.filter("copies = 1"))
    if kept.filter("copies > 1").limit(1).count():
        out = out.union(joined(kept.filter("copies > 1")).dropDuplicates([node, id_col]))
    return out.select(*docs.columns)
