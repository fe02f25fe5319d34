"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every test item. A document's words
are streamed through it; after each word it knows the longest suffix that is
a run of some item. Where that reaches ``window`` words, a window of an item
ends there, and the words under it are hit. An item of fewer words (but not
none) is a window as a whole.

Null texts have no words; items without words never match. Rows that repeat
an item id are one item, of all their texts; a null id is one more item.
Repeated documents each count on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name

WINDOW = 10
#: Words of test items in one automaton; longer lists are cut into blocks of whole items, each a pass.
BLOCK_WORDS = 500_000
#: Spans of at least so many hit words are cut out of a text.
MAX_SPAN = 10
#: A document with a larger share of hit words goes as a whole.
MAX_COVERAGE = 0.5

#: Word characters stay, A-Z become a-z, all else becomes a space (UTF-8 bytes above 0x7F are parts of word characters).
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items' words."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        numbers: dict[object, int] = {}
        self.number: list[int] = []  # of each run's item
        runs: list[list[int]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                self.number.append(numbers.setdefault(item, len(numbers)))
                runs.append(ids)
                last = 0
                for word in ids:
                    last = self._extend(last, word)
        self.items = list(numbers)
        self.shortest = min([window, *map(len, runs)])
        self._mark(runs)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the runs that end in p's longest one and the word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the run is there from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _mark(self, runs: list[list[int]]) -> None:
        """For each state: the state of its window-long suffix, that one's items, and the short items that end here."""
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window = [-1] * n
        for s in order:
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[self.link[s]] < self.window else self.at_window[self.link[s]]
        owners: list[set[int]] = [set() for _ in range(n)]
        whole: list[dict[int, set[int]]] = [{} for _ in range(n)]
        for i, run in enumerate(runs):
            state, length = 0, 0
            for word in run:
                state, length = self.next[state][word], length + 1
                if length >= self.window:
                    owners[self.at_window[self._suffix(state, length)]].add(self.number[i])
            if length < self.window:
                whole[state].setdefault(length, set()).add(self.number[i])
        # in an automaton of several items a run's state is the one that reading it ends in;
        # what a state has of its own is kept, and the next state up the links that has any
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [tuple((k, tuple(sorted(v))) for k, v in sorted(x.items())) for x in whole]
        self.up = [0] * n
        for s in order:
            above = max(self.link[s], 0)
            self.up[s] = above if self.short[above] else self.up[above]
        self.owners = [tuple(sorted(x)) for x in owners]

    def _suffix(self, state: int, length: int) -> int:
        while length <= self.length[self.link[state]]:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[object]]:
        """The hit spans (first word, end), apart and in order, and the items whose windows occur."""
        if not self.items or len(words) < self.shortest:
            return [], []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        starts, ends = known[::2], known[1::2]
        enough = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        link, length, nexts, window = self.link, self.length, self.next, self.window
        for start, end in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            state, matched = 0, 0
            for i, word in enumerate(ids[start:end].tolist(), start + 1):
                while state and word not in nexts[state]:
                    state = link[state]
                    matched = length[state]
                if word in nexts[state]:
                    state = nexts[state][word]
                    matched += 1
                covered = 0
                if matched >= window:
                    found.update(self.owners[self.at_window[self._suffix(state, matched)]])
                    covered = window
                at = state if self.short[state] else self.up[state]
                while at:
                    for size, own in self.short[at]:
                        if size <= matched:
                            found.update(own)
                            covered = max(covered, size)
                    at = self.up[at]
                if covered:
                    first = i - covered
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return spans, [self.items[i] for i in sorted(found)]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Automaton]:
    """Automata of the test items, in blocks of at most ``block_words`` words (or one item)."""
    blocks: list[Automaton] = []
    block: list[tuple[object, str]] = []
    total = 0
    for item, text in items.select(id_col, text_col).filter(F.col(text_col).isNotNull()).orderBy(id_col).toLocalIterator():
        n = len(words_of(text))
        if block and total + n > block_words:
            blocks.append(Automaton(block, window))
            block, total = [], 0
        block.append((item, text))
        total += n
    if block or not blocks:
        blocks.append(Automaton(block, window))
    return blocks


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_HITS = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
)

_SCHEMA = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<first: bigint, end: bigint>>>"


def _joined(own: dict, more: dict) -> dict:
    spans = _merged([(s["first"], s["end"]) for s in own["spans"] + more["spans"]])
    return {
        "n_words": own["n_words"],
        "n_hit": sum(b - a for a, b in spans),
        "items": own["items"] + [i for i in more["items"] if i not in set(own["items"])],
        "spans": [{"first": a, "end": b} for a, b in spans],
    }


def _of(model: Automaton, text: str | None) -> dict:
    words = words_of(text)
    spans, items = model.match(words)
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": [None if i is None else str(i) for i in items], "spans": [{"first": a, "end": b} for a, b in spans]}


def mark(docs: DataFrame, blocks: list[Automaton], text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (ids as strings), spans of hit words."""
    out = free_name(docs, out)
    for i, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS
        docs = docs.withColumn(out, _marker(shared)(F.col(text_col)) if i == 0 else _further(shared)(F.col(text_col), F.col(out)))
    return docs


def _marker(shared):
    @arrow_udf(_SCHEMA)
    def hits(texts: pa.Array) -> pa.Array:
        return pa.array([_of(shared.value, t) for t in texts.to_pylist()], _HITS)

    return hits.asNondeterministic()


def _further(shared):
    @arrow_udf(_SCHEMA)
    def hits(texts: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([_joined(h, _of(shared.value, t)) for t, h in zip(texts.to_pylist(), before.to_pylist(), strict=True)], _HITS)

    return hits.asNondeterministic()


def _cut(text: str, spans: list[dict], max_span: int) -> str:
    """The text without its hit spans of at least ``max_span`` words (and what stands between their words)."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", "a", text))]
    out, kept = [], 0
    for s in spans:
        if s["end"] - s["first"] >= max_span:
            out.append(text[kept : at[s["first"]][0]])
            kept = at[s["end"] - 1][1]
    return "".join([*out, text[kept:]])


def clean(docs: DataFrame, blocks: list[Automaton], text_col: str = "text", max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without contamination.

    Documents whose share of hit words is above ``max_coverage`` go; from the
    others, hit spans of at least ``max_span`` words are cut out; shorter ones,
    which are whole items of fewer words, stay, as common phrases may be items.
    Untouched texts, nulls among them, stay as they are. Texts are matched and
    cut in one function, as a task has a Python worker for each one in a row.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]  # each bounded by BLOCK_WORDS
    out = free_name(docs, "cleaned")

    @arrow_udf("struct<stays: boolean, text: string>")
    def cleaned(texts: pa.Array) -> pa.Array:
        stays, cut = [], []  # null where nothing is cut
        for text in texts.to_pylist():
            hits = reduce(_joined, (_of(block.value, text) for block in shared))
            stays.append(hits["n_hit"] <= hits["n_words"] * max_coverage)
            cut.append(_cut(text, hits["spans"], max_span) if stays[-1] and hits["spans"] else None)
        return pa.StructArray.from_arrays([pa.array(stays, pa.bool_()), pa.array(cut, pa.string())], ["stays", "text"])

    told = docs.withColumn(out, cleaned.asNondeterministic()(F.col(text_col)))  # evaluated once, whatever reads it
    return told.filter(F.col(f"{out}.stays")).withColumn(text_col, F.coalesce(f"{out}.text", text_col)).select(*docs.columns)
