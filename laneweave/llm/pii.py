"""Personal data by patterns and a skip-chain conditional random field.

Four pattern kinds (``email``, ``ip``, ``card``, ``phone``) give base spans,
which always stay. The field labels the tokens (runs without white space) of
a document that has base spans: a token under a base span is clamped to its
kind, and other tokens with a digit or an ``@`` are free; the rest are outside.
Neighbouring tokens share transition potentials. Tokens of equal core, and
free tokens whose digits end or begin a clamped token's digits, share skip
potentials, however far apart. Loopy belief propagation passes messages along
both; a free token whose marginal for a kind is at least ``CERTAIN`` adds a
span ``crf-<kind>`` (its core). So a number that stands once in full and once
in part is found both times.

Weights: unary ones by logistic regression of base labels on token features,
transition and skip ones from counts, all on a bounded sample of documents;
agreement with a clamped token is SKIP at least. A number that stands twice and
is no base span has only the counts to go by.

Positions are code points, ends exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"crf-{k}" for k in BASE))
CERTAIN = 0.9
ROUNDS = 8
#: Bound of the log-odds of skip links.
SKIP = 6.0
#: Documents that the weights are learned from, about.
TRAIN_DOCS = 3000
OUTSIDE = len(BASE)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: what stands before it back to the last match, then a domain."""
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            free = found.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the base spans, in order."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(b, 0, e) for b, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the field

FEATURES = 16


def _core(token: str) -> tuple[int, int]:
    """Begin and end of a token without outer marks (a leading + or bracket stays)."""
    begin, end = 0, len(token)
    while end > begin and not token[end - 1].isalnum():
        end -= 1
    while begin < end and not (token[begin].isalnum() or token[begin] in "+("):
        begin += 1
    return begin, end


def features(token: str) -> np.ndarray:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    out = np.zeros(FEATURES)
    out[0] = 1
    out[1] = "@" in token
    out[2] = token.count(".") == 3
    out[3] = 0 < token.count(".") < 3
    out[4] = "+" in token
    out[5] = "(" in token or ")" in token
    out[6] = "-" in token
    out[7] = digits > 0 and letters == 0
    out[8] = digits > 0 and letters > 0
    out[9] = 1 <= digits <= 3
    out[10] = 4 <= digits <= 8
    out[11] = 9 <= digits <= 11
    out[12] = 12 <= digits <= 19
    out[13] = digits > 19
    out[14] = letters > 2 * digits
    out[15] = ":" in token or "=" in token or '"' in token
    return out


class Tokens:
    """The tokens that the field is about, with their clamped labels and skip links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int]] = []
        self.cores: list[str] = []
        self.clamped: list[int] = []
        self.whole: list[tuple[str, int]] = []  # digits of each base span, and its last token
        self.near: list[bool] = []  # does the token follow the one before without another between?
        i, last = 0, -2
        for number, m in enumerate(_TOKEN.finditer(text)):
            begin, end = m.span()
            while i < len(base) and base[i][2] <= begin:
                i += 1
            over = next((s for s in base[i : i + 4] if s[0] < end and begin < s[2]), None)
            label = -1 if over is None else over[1]
            token = m.group()
            if label < 0 and "@" not in token and not _DIGIT.search(token):
                continue
            b, e = _core(token)
            self.spans.append((begin + b, begin + e))
            self.cores.append(token[b:e])
            self.clamped.append(label)
            self.near.append(number == last + 1)
            last = number
            if over is not None and over[2] <= end:
                self.whole.append((_NOT_DIGIT.sub("", text[over[0] : over[2]]), len(self.cores) - 1))
        self.digits = [_NOT_DIGIT.sub("", c) for c in self.cores]

    def links(self) -> list[tuple[int, int]]:
        """Skip links: each token to the next of equal core; free ones to a base span that their digits end or begin.

        Affixes of base spans' digits are looked up, so links grow with the tokens.
        """
        out, seen = [], {}
        affixes: dict[str, int] = {}
        for i, core in enumerate(self.cores):
            if core in seen:
                out.append((seen[core], i))
            seen[core] = i
        for d, i in self.whole:
            for n in range(7, min(len(d), 40) + 1):
                affixes.setdefault(d[:n], i)
                affixes.setdefault(d[-n:], i)
        for i, (d, label) in enumerate(zip(self.digits, self.clamped, strict=True)):
            if label < 0 and 7 <= len(d) <= 40 and d in affixes and affixes[d] != i:
                out.append((affixes[d], i))
        return out


class Field:
    """Weights: unary (labels x features), transitions, skip agreement with a clamped token, and of two free ones (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, free: np.ndarray | None = None):
        self.unary, self.chain, self.skip = unary, chain, skip
        self.free = skip if free is None else free

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Label marginals of the tokens by loopy sum-product passing, damped by half."""
        n, labels = len(tokens.cores), len(BASE) + 1
        own = np.array([features(c) for c in tokens.cores]) @ self.unary.T
        for i, label in enumerate(tokens.clamped):
            if label >= 0:
                own[i] = np.where(np.arange(labels) == label, 0, -60.0)
        edges = [(i - 1, i, self.chain) for i in range(1, n) if tokens.near[i]] + [(i, j, self.free if max(tokens.clamped[i], tokens.clamped[j]) < 0 else self.skip) for i, j in tokens.links()]
        if edges:
            a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
            potential = np.stack([e[2] for e in edges])
            right = np.zeros((len(edges), labels))  # from a to b
            left = np.zeros((len(edges), labels))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, b, right)
                np.add.at(belief, a, left)
                new_right = _logsum((belief[a] - left)[:, :, None] + potential, 1)
                new_left = _logsum((belief[b] - right)[:, None, :] + potential, 2)
                right = (right + new_right - new_right.max(axis=1, keepdims=True)) / 2
                left = (left + new_left - new_left.max(axis=1, keepdims=True)) / 2
            np.add.at(own, b, right)
            np.add.at(own, a, left)
        own -= own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the field adds to base spans."""
        if not base:
            return []
        tokens = Tokens(text, base)
        if all(k >= 0 for k in tokens.clamped):
            return []
        p = self.marginals(tokens)
        out = []
        for i, (begin, end) in enumerate(tokens.spans):
            kind = int(p[i, :OUTSIDE].argmax())
            if tokens.clamped[i] < 0 and p[i, kind] >= CERTAIN and end > begin:
                out.append((begin, OUTSIDE + kind, end))
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# ---------------------------------------------------------------- training


def _observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token features with base labels, and label pairs of chain and skip links, of documents that have base spans."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base = base_spans(text)
            if not base:
                continue
            t = Tokens(text, base)
            links = t.links()
            # a free token that is like one under a base span has no label to learn from
            open_ = {i for a, b in links for i, j in ((a, b), (b, a)) if t.clamped[i] < 0 <= t.clamped[j]}
            labels = [k if k >= 0 else OUTSIDE for k in t.clamped]
            rows += [("unary", k, 0, int(features(c) @ (1 << np.arange(FEATURES)))) for i, (c, k) in enumerate(zip(t.cores, labels, strict=True)) if i not in open_]
            rows += [("chain", labels[i - 1], labels[i], 0) for i in range(1, len(labels)) if t.near[i] and not {i - 1, i} & open_]
            rows += [("skip", labels[i], labels[j], 0) for i, j in links if not {i, j} & open_]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "bits"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """Weights from about ``train_docs`` documents (smallest hashes of id and text) that hold a digit or an @."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = marked.count()  # so that the sample is as large where few documents are marked
    grain = 1 << 30
    share = grain if n <= train_docs else max(1, grain * train_docs // n)
    # with the text, as ids may be null or stand many times
    sample = marked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(grain)) < share)
    counts = sample.select("text").mapInPandas(_observed, "kind string, a int, b int, bits int").groupBy("kind", "a", "b", "bits").agg(F.count("*").alias("n"))
    labels = len(BASE) + 1
    chain, skip = np.full((labels, labels), 0.5), np.full((labels, labels), 0.5) + np.eye(labels) * 2
    bits, label, weight = [], [], []
    for r in counts.collect():  # labels x feature patterns: at most 5 x 2^16, in fact a few hundred
        if r["kind"] == "unary":
            bits.append(r["bits"])
            label.append(r["a"])
            weight.append(r["n"])
        else:
            (chain if r["kind"] == "chain" else skip)[r["a"], r["b"]] += r["n"]
            if r["kind"] == "skip":
                skip[r["b"], r["a"]] += r["n"]
    x = (np.array(bits, np.int64).reshape(-1, 1) >> np.arange(FEATURES) & 1).astype(float)
    return Field(_softmax_weights(x, np.array(label, int), np.array(weight, float), labels), _pointwise(chain), _agreement(skip), _pointwise(skip))


def _softmax_weights(x: np.ndarray, label: np.ndarray, weight: np.ndarray, labels: int) -> np.ndarray:
    """Multinomial logistic regression with a ridge, by gradient steps with momentum."""
    beta = np.zeros((labels, FEATURES))
    if not len(x):
        beta[OUTSIDE, 0] = 10
        return beta
    weight = weight / weight.sum()
    target = np.eye(labels)[label]
    speed = np.zeros_like(beta)
    for _ in range(1500):
        score = x @ beta.T
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.5 * (((p - target) * weight[:, None]).T @ x + 1e-4 * beta)
        beta += speed
    return beta


def _pointwise(counts: np.ndarray) -> np.ndarray:
    """log p(a, b) / (p(a) p(b)), bounded."""
    p = counts / counts.sum()
    return np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -4, 4)


def _agreement(counts: np.ndarray) -> np.ndarray:
    """As above; for links to a token under a base span, where agreement of kinds is strong whatever the sample: what is like a known one is one."""
    out = _pointwise(counts)
    kinds = np.arange(len(counts)) < OUTSIDE
    return np.where(np.eye(len(counts), dtype=bool) & kinds, np.maximum(out, SKIP), np.minimum(out, SKIP))


# ---------------------------------------------------------------- columns

SPANS = "array<struct<begin: int, kind: int, end: int>>"


def find(docs: DataFrame, field: Field, text_col: str = "text", out: str = "personal") -> DataFrame:
    """``docs`` with a column ``out``: spans (begin, kind, end), by begin, then kind; kinds index KINDS."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    @arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base = base_spans(text)
            rows.append([{"begin": b, "kind": k, "end": e} for b, k, e in sorted(base + field.spans(text, base))] if base else [])
        return pa.array(rows, kind)

    return docs.withColumn(free_name(docs, out), found.asNondeterministic()(F.col(text_col)))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == BASE.index(kind))).cast("long")
