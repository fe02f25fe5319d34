"""Token ids of documents in bit-packed binary files.

A file holds the documents of one stretch of ids, in rising id order:

=========  =====================================================================
bytes      content
=========  =====================================================================
8          magic ``LWTOK1\\0\\0``
4 x 8      bits of an id, documents, tokens, ids in a block (little-endian int64)
docs x 8   document ids (0 where null)
docs x 1   1 where the document id is null
docs x 8   index of each document's first token in this file
blocks x 8 byte offset of each block from the start of the data
data       the ids, each in ``bits`` bits, least significant bit first; each
           block starts on a byte, so that it can be read and unpacked alone
=========  =====================================================================

``bits`` is the least number that the vocabulary needs. Null and empty texts
have the end id alone. Null ids come first; rows with equal ids stay apart
(ordered by text). An empty table gives no file and no row.

Files go to a folder that driver and executors share. A task writes under a
name of its own and then renames, so that a task that runs again, after an
executor is lost, replaces its file with an equal one.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, staged

END_ID = 2
#: Ids in a block: a reader of one document unpacks at most two part blocks.
BLOCK_IDS = 65536
MAGIC = b"LWTOK1\0\0"
#: Input bytes that one file takes, about: the least of them, and the most; between, a MANY-th of the input.
FILE_BYTES, MOST_FILE_BYTES, MANY = 8 << 20, 64 << 20, 10_000
#: Files that one task reads back.
FILES_READ = 4
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 600_000
#: New words that are encoded as one text.
JOINED_WORDS = 1000
#: Signs that end a word and are no part of its tokens.
ENDS = ".,;:!?"

# ---------------------------------------------------------------- bit packing


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, zero-filled to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    size = -(-len(ids) * bits // 8)
    rows = np.zeros((-(-len(ids) // 64), 64), "<u8")  # 64 ids fill as many words as an id has bits
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), "<u8")
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        words[:, at] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.tobytes()[:size]


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    rows = -(-count // 64)
    words = np.frombuffer(data[: rows * bits * 8].ljust(rows * bits * 8, b"\0"), "<u8").reshape(rows, bits)
    ids = np.empty((rows, 64), np.uint32)
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, at + 1] << np.uint64(64 - shift)
        ids[:, i] = value & np.uint64((1 << bits) - 1)
    return ids.reshape(-1)[:count]


class TokenFile:
    """One file, read whole or at random."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if self.data[:8] != MAGIC:
            raise ValueError("no token file")
        self.bits, docs, self.tokens, self.block_ids = struct.unpack_from("<4q", data, 8)
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null_ids = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.firsts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        blocks = -(-self.tokens // self.block_ids)
        self.offsets = np.frombuffer(data, "<i8", blocks, at + 17 * docs)
        self.start = at + 17 * docs + 8 * blocks
        self._unpacked: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self._unpacked[0] != i:
            end = self.offsets[i + 1] if i + 1 < len(self.offsets) else len(self.data) - self.start
            count = min(self.block_ids, self.tokens - i * self.block_ids)
            self._unpacked = i, unpack(bytes(self.data[self.start + self.offsets[i] : self.start + end]), self.bits, count)
        return self._unpacked[1]

    def ids(self, first: int, end: int) -> np.ndarray:
        parts = []
        for i in range(first // self.block_ids, -(-end // self.block_ids)):
            base = i * self.block_ids
            parts.append(self.block(i)[max(0, first - base) : end - base])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]) if i + 1 < len(self.firsts) else self.tokens)


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    return framed(doc_ids, lengths, [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)], bits, block_ids)


def framed(doc_ids: list[int | None], lengths: np.ndarray, blocks: list[bytes], bits: int, block_ids: int) -> bytes:
    """A file of packed blocks."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    head = [
        MAGIC,
        struct.pack("<4q", bits, len(doc_ids), int(lengths.sum()), block_ids),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        (np.cumsum(lengths) - lengths).astype("<i8").tobytes(),
        (np.cumsum(sizes) - sizes).astype("<i8").tobytes(),
    ]
    return b"".join([*head, *blocks])


# ---------------------------------------------------------------- tokenizing


class _Numbered(dict):
    """Words by number, in the order in which they come up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordCachedTokenizer:
    """A tokenizer file of the library; of byte-level BPE files the ids of words are kept.

    Their pattern never joins a space to what stands before it. So a text can be
    cut before each space that follows a non-space, and each piece be encoded
    once, together with the other new ones: the only tokens that begin with a
    space are the pieces' first. Texts beyond plain Latin letters, those with
    the text of a special token, and all texts where the file is of another
    kind, go to the library as they are.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        kind = told.get("pre_tokenizer") or {}
        self.by_word = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and told.get("normalizer") is None
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = "|".join(["[^\t\n\r\x20-\x7e\xa1\xbf-ɏ]", *special])
        self.cut = re.compile(r"(?<=\S) ")
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.begins = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.words: list[str] = []  # by number, as the next two
        self.used = np.empty(0, np.int64)
        self._flat = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.tails: dict[str, list[int]] = {}

    def _forget(self) -> None:
        """Keep the words that were used most, up to half of CACHE_WORDS."""
        least = 2
        while (keep := np.flatnonzero(self.used >= least)).size > CACHE_WORDS // 2:
            least *= 2
        words, used, (flat, lengths, firsts) = self.words, self.used, self._flat
        self._clear()
        self.words = [words[i] for i in keep.tolist()]
        self.known.update(zip(self.words, range(len(keep)), strict=True))
        self.used = used[keep] // 2
        flat, lengths = _picked(flat, lengths, firsts, keep)
        self._flat = flat, lengths, np.cumsum(lengths) - lengths

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, a space before each, and how many each has."""
        joined = [" " + " ".join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        flat = np.concatenate([np.empty(0, np.uint32), *[np.array(ids, np.uint32) for ids in self._encode(joined)]])
        first = np.flatnonzero(self.begins[flat])
        return flat, np.diff(np.append(first, len(flat)))

    def _learn(self) -> None:
        """The ids of the words that were numbered since the last call.

        Signs behind a letter or digit are tokens of their own: such a word's
        ids are those of what stands before them, and theirs.
        """
        new, known = self.known.new, self.known.__getitem__
        plain, blank, ended = [], [], []
        for word in new:  # grows by the words without their ends
            number, core = known(word), word.rstrip(ENDS)
            if core != word and core and core[-1].isalnum():
                ended.append((number, known(core), word[len(core) :]))
            elif not word or " " in word or word[0].isspace() or word[-1].isspace():
                blank.append((number, self._encode([f" {word}"])[0]))
            else:
                plain.append((number, word))
        lengths, start = np.zeros(len(new), np.int64), len(self.words)
        flat, sizes = self._pieces([w for _, w in plain])
        order = [n for n, _ in plain]
        if blank:
            order += [n for n, _ in blank]
            flat, sizes = np.concatenate([flat, *[np.array(ids, np.uint32) for _, ids in blank]]), np.append(sizes, [len(ids) for _, ids in blank])
        held, old, firsts = self._flat
        self._flat = np.concatenate([held, flat]), np.concatenate([old, lengths]), np.concatenate([firsts, lengths])
        at = np.array(order, np.int64)
        self._flat[1][at] = sizes
        self._flat[2][at] = len(held) + np.cumsum(sizes) - sizes
        if ended:
            tails = sorted({tail for _, _, tail in ended} - self.tails.keys())
            self.tails |= zip(tails, self._encode(tails), strict=True)
            held, old, firsts = self._flat
            ids, sizes = _picked(held, old, firsts, np.array([core for _, core, _ in ended], np.int64))
            ends = [self.tails[tail] for _, _, tail in ended]
            more = np.fromiter(map(len, ends), np.int64, len(ends))
            whole = sizes + more
            out = np.empty(int(whole.sum()), np.uint32)
            is_end = np.repeat(np.tile([False, True], len(ends)), np.stack([sizes, more], axis=1).ravel())
            out[~is_end], out[is_end] = ids, [i for e in ends for i in e]
            at = np.array([n for n, _, _ in ended], np.int64)
            old[at], firsts[at] = whole, len(held) + np.cumsum(whole) - whole
            self._flat = np.concatenate([held, out]), old, firsts
        self.words += new
        self.used = np.append(self.used, np.zeros(len(self.words) - start, np.int64))
        self.known.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them with add_special_tokens=False."""
        if not self.by_word:
            return [np.array(ids, np.uint32) for ids in self._encode(texts)]
        if len(self.known) > CACHE_WORDS:
            self._forget()
        get = self.known.__getitem__
        held = pa.array(texts, pa.large_string())
        other = pc.match_substring_regex(held, self.other).to_pylist()
        double = pc.match_substring_regex(held, r"\s ").to_pylist()
        starts: list[str] = []
        cuts: list[np.ndarray | None] = []
        for text, whole, runs in zip(texts, other, double, strict=True):
            if whole:
                starts.append(text)
                cuts.append(None)
                continue
            words = self.cut.split(text) if runs else text.split(" ")
            starts.append(words[0])
            cuts.append(np.fromiter(map(get, words[1:]), np.int64, len(words) - 1) if len(words) > 1 else None)
        self._learn()
        numbers = [at for at in cuts if at is not None]
        if numbers:
            self.used += np.bincount(np.concatenate(numbers), minlength=len(self.used))
        out = []
        for first, at in zip(self._encode(starts), cuts, strict=True):
            head = np.array(first, np.uint32)
            out.append(head if at is None else np.concatenate([head, _picked(*self._flat, at)[0]]))
        return out


def _picked(flat: np.ndarray, lengths: np.ndarray, firsts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of a flat array, one behind the other, and their lengths."""
    size = lengths[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(firsts[at] - (ends - size), size)], size


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """The worker's tokenizer of a file."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = WordCachedTokenizer(path)
    return _tokenizers[path]


# ---------------------------------------------------------------- files


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _put(folder: str, name: str, data: bytes) -> None:
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_size: int | None = None) -> DataFrame:
    """Tokenize and write all documents; one row for each file: file_no, file, n_docs, n_tokens, base.

    ``base`` is the number of ids in all files before. The rows are as many
    as files, and files hold about ``file_size`` bytes of text each
    (by default more of a large input, up to MOST_FILE_BYTES).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    files = max(1, -(-size // (file_size or min(max(FILE_BYTES, size // MANY), MOST_FILE_BYTES))))
    dealt = rows.repartitionByRange(files, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        tok = tokenizer(tokenizer_path)
        bits = bits_for(max(tok.vocabulary, end_id + 1))
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        blocks: list[bytes] = []
        rest = np.empty(0, np.uint32)
        for batch in batches:
            doc_ids += batch.column("id").to_pylist()
            parts = tok.encode([t or "" for t in batch.column("text").to_pylist()])
            lengths += [len(p) + 1 for p in parts]
            ends = np.array([end_id], np.uint32)
            ids = np.concatenate([rest, *[x for p in parts for x in (p, ends)]])
            whole = len(ids) - len(ids) % BLOCK_IDS
            blocks += [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, whole, BLOCK_IDS)]
            rest = ids[whole:]
        if not doc_ids:
            return
        blocks += [pack(rest, bits)] if len(rest) else []
        name = f"tokens-{number:06d}.bin"
        _put(folder, name, framed(doc_ids, np.array(lengths, np.int64), blocks, bits, BLOCK_IDS))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())],
            ["file_no", "file", "n_docs", "n_tokens"],
        )

    index = staged(dealt.mapInArrow(store, "file_no long, file string, n_docs long, n_tokens long"), "token-index")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return index.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}") as f:
                    held = TokenFile(f.read())
                docs = len(held.doc_ids)
                lengths = np.diff(np.append(held.firsts, held.tokens))
                crcs = [zlib.crc32(held.document(i).astype("<u4").tobytes()) for i in range(docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.doc_ids, mask=held.null_ids), pa.array(held.firsts + base), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = index.select("file", "base").repartition(index.count() // FILES_READ + 1, "file")
    return files.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents to new token files in the shared folder, and read these back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer_path, id_col, text_col), folder)
