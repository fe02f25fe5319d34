"""Toxicity by a string-subsequence kernel SVM with Nystroem landmarks.

The kernel of two words counts the subsequences of three characters that both
hold within a window of seven, each occurrence weighted by ``DECAY`` to the
length that it spans; so a word with characters put in between, or with gaps,
stays near the word itself. Landmarks are words; the kernel to them, whitened,
gives the features of a linear SVM with squared hinge loss. The SVM's value of
a word is again a weighted sum over its subsequences, so it is read from one
table of 2^18 weights.

Training: sentences of labelled documents, about ``TRAIN_DOCS`` of each label.
A sentence's value is its highest word's (a latent SVM). Sentences of documents
that aren't toxic are examples of -1; of a toxic document one is an example of
+1, that of the highest value, as the label doesn't say which. The first machine
starts from the words that toxic documents hold far more often than others;
``RETRAININGS`` times, the machine in force picks each sentence's word and each
toxic document's sentence, and a new one is fitted on these, each weighted by
the documents that it stands for. Copies count once (documents are grouped by
their least word hash). A
document's score is a logistic curve of its three highest word values and its length:
two insults in a short text weigh more than in a long one. A long text has the
values of its worst stretch.

Null and empty texts, and texts without words, get the curve's value at the
SVM's offset. Without labels of both classes every score is 0. Very long words
are read in overlapping windows; runs of single letters are joined to a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, staged
from .training import labelled_sample

TRAIN_DOCS = 2500
LANDMARKS = 192
DECAY = 0.7
SPAN = 7
#: Windows of long words, and the step between them.
LONGEST, STRIDE = 20, 10
#: Witness words at most, and other words, for each training round.
WITNESSES, OTHERS = 400, 4000
#: Times that sentences choose their words anew.
RETRAININGS = 2
#: Words whose values a worker keeps.
CACHE_WORDS = 400_000
#: Highest word values that a document's score looks at.
TOP = 3
#: Words of a long text that are looked at together, half of them at each step.
STRETCH = 400
#: What the score's curve takes: those values, and how short the document is.
INPUTS = TOP + 1
REGULARISER = 1e-4

#: Marks of a word's begin and end, characters of their own.
_BEGIN, _END = "\x02", "\x03"
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)} | {"0": 15, "1": 9, "3": 5, "4": 1, "5": 19, "7": 20, "@": 1, "$": 19, _BEGIN: 62, _END: 63}


def _code(c: str) -> int:
    """1 to 63 for characters that count, 0 for others."""
    return _LETTERS.get(c) or (27 + ord(c) % 35 if c.isalpha() else 0)


def _core(word: str) -> str:
    """The word from its first to its last letter or digit."""
    first = next((i for i, c in enumerate(word) if c.isalnum()), len(word))
    last = next((i for i in range(len(word) - 1, first - 1, -1) if word[i].isalnum()), first - 1)
    return word[first : last + 1]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n characters within the window, and their weights."""
    at = [(i, i + j, i + k) for i in range(n) for j, k in combinations(range(1, min(SPAN, n - i)), 2)]
    index = np.array(at, np.int64).reshape(-1, 3)
    return index, (DECAY ** (index[:, 2] - index[:, 0] + 1)).astype(np.float32)


_index = {n: _triples(n) for n in range(3, LONGEST + 1)}
_norm = {n: float(np.sqrt((w.astype(np.float64) ** 2).sum())) for n, (_, w) in _index.items()}


def _windows(word: str) -> list[str]:
    word = f"{_BEGIN}{word}{_END}"
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STRIDE, STRIDE)]


def _occurrences(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes of a word of at most LONGEST - 2 characters and their weights, normalised by length."""
    word = f"{_BEGIN}{word}{_END}"
    chars = np.array([_code(c) for c in word], np.int64)
    index, weight = _index[len(word)]
    picked = chars[index]
    there = (picked > 0).all(axis=1)
    return (picked @ np.array([4096, 64, 1]))[there], weight[there] / _norm[len(word)]


def text_words(text: str | None) -> list[str]:
    """Words as they stand, in small letters; three or more single letters in a row also as one word."""
    words = text.lower().split() if text else []
    run: list[str] = []
    joined = []
    for w in words if any(len(w) == 1 for w in words) else ():
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) >= 3:
            joined.append("".join(run))
        run = []
    if len(run) >= 3:
        joined.append("".join(run))
    return words + joined


class WordScorer:
    """The SVM's value of words, by the table of subsequence weights."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights = weights.astype(np.float32)
        self.offset = offset

    def values(self, words: list[str]) -> np.ndarray:
        """The value of each word; of a long one, its highest window's."""
        out = np.full(len(words), -np.inf, np.float32)
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            for part in _windows(_core(w)):
                if len(part) >= 3:  # more than the marks
                    at, parts = by_length.setdefault(len(part), ([], []))
                    at.append(i)
                    parts.append(part)
        for n, (at, parts) in by_length.items():
            index, weight = _index[n]
            for start in range(0, len(parts), 2000):
                some = parts[start : start + 2000]
                chars = np.array([[_code(c) for c in p] for p in some], np.int64)
                codes = chars[:, index[:, 0]] << 12 | chars[:, index[:, 1]] << 6 | chars[:, index[:, 2]]
                np.maximum.at(out, at[start : start + 2000], self.offset + self.weights[codes] @ weight / _norm[n])
        out[np.isneginf(out)] = self.offset
        return out


def _leading(values: np.ndarray) -> np.ndarray:
    """The highest values in falling order; of a long text, those of the stretch in which they are highest together."""
    if len(values) > STRETCH:
        starts = range(0, len(values) - STRETCH // 2, STRETCH // 2)
        return max((_leading(values[i : i + STRETCH]) for i in starts), key=lambda v: float(v.sum()))
    if len(values) > TOP:
        values = np.partition(values, len(values) - TOP)[-TOP:]
    return np.sort(values)[::-1]


class _Cached(dict):
    def __init__(self, scorer: WordScorer):
        super().__init__()
        self.scorer = scorer

    def learn(self, split: list[list[str]]) -> None:
        """Have the values of all words of some texts."""
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list({w for words in split for w in words if w not in self})
        self.update(zip(new, self.scorer.values(new).tolist(), strict=True))

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The three highest word values of each text, and minus the logarithm of its words."""
        split = [text_words(t) for t in texts]
        self.learn(split)
        low = self.scorer.offset
        out = np.full((len(texts), INPUTS), low)
        out[:, TOP] = [-np.log1p(min(len(words), STRETCH)) for words in split]
        get = self.__getitem__
        for row, words in zip(out, split, strict=True):
            if words:
                values = np.fromiter(map(get, words), np.float64, len(words))
                values = _leading(values)
                row[: len(values)] = np.maximum(values, low)
        return out


# ---------------------------------------------------------------- training


def _sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that the kernel can take whole, each once, in order of the alphabet."""
    split = ({_core(w) for w in text_words(sentence)} for sentence in (text or "").split("."))
    return [words for words in (sorted(w for w in found if 3 <= len(w) <= LONGEST - 2) for found in split) if words]


def _group(sentences: list[list[str]]) -> int:
    """Equal for copies, and for most near ones."""
    return min((zlib.crc32(w.encode()) for words in sentences for w in words if len(w) > 5), default=0)


def _document_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, label, grp) once for each document."""
    for batch in batches:
        rows = []
        for text, label in zip(batch["text"], batch["_label"], strict=True):
            sentences = _sentences(text)
            group = _group(sentences)
            rows += [(w, int(label), group) for w in {w for words in sentences for w in words}]
        yield pd.DataFrame(rows, columns=["word", "label", "grp"])


def _picked(sentences: list[list[str]], label: int, value: Callable[[str], float]) -> set[str]:
    """The words that sentences stand for: each one's highest; of a toxic document, that of its highest sentence."""
    words = [max(s, key=lambda w: (value(w), w)) for s in sentences]
    return {max(words, key=lambda w: (value(w), w))} if label and words else set(words)


def _pick(sample: DataFrame, scorer: WordScorer) -> DataFrame:
    """The words that the sample's sentences stand for: word, label, n (documents, copies once)."""

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Cached(scorer)
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["_label"], strict=True):
                sentences = _sentences(text)
                cache.learn(sentences)
                group = _group(sentences)
                rows += [(w, int(label), group) for w in _picked(sentences, int(label), cache.__getitem__)]
            yield pd.DataFrame(rows, columns=["word", "label", "grp"])

    return sample.mapInPandas(picked, "word string, label int, grp long").groupBy("word", "label").agg(F.count_distinct("grp").alias("n"))


def _features(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of words to landmarks; the landmarks' subsequence codes and their weights (codes x landmarks)."""
    held = [_occurrences(m) for m in landmarks]
    codes = np.unique(np.concatenate([c for c, _ in held]))
    table = np.zeros((len(codes), len(landmarks)))
    for j, (c, w) in enumerate(held):
        np.add.at(table[:, j], np.searchsorted(codes, c), w)
    kernel = np.zeros((len(words), len(landmarks)))
    for i, word in enumerate(words):
        c, w = _occurrences(word)
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        there = codes[at] == c
        kernel[i] = w[there] @ table[at[there]]
    return kernel, codes, table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last is the offset) of least squared hinge loss, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], REGULARISER)
    ridge[-1] = 1e-6

    def loss(b: np.ndarray) -> float:
        return float(weight @ np.maximum(1 - y * (x @ b), 0) ** 2 + ridge @ (b * b))

    beta = np.zeros(x.shape[1])
    for _ in range(50):
        open_ = (y * (x @ beta) < 1) * weight
        step = np.linalg.solve((x * open_[:, None]).T @ x + np.diag(ridge), x.T @ (open_ * y)) - beta
        now, size = loss(beta), 1.0
        while size > 1e-4 and loss(beta + size * step) > now:  # a whole step may overshoot where rows come in
            size /= 2
        beta = beta + size * step
        if np.abs(step).max() < 1e-6 or now - loss(beta) < 1e-10:
            break
    return beta


def _machine(witnesses: list[str], others: list[str], weights: list[float] | None = None) -> tuple[list[str], np.ndarray, float]:
    """Landmarks, their factors and the offset of the SVM; ``weights``: of witnesses, then others (each class has half of all weight)."""
    half = 2 * LANDMARKS // 3
    landmarks = list(dict.fromkeys(witnesses[:half] + others[: LANDMARKS - min(half, len(witnesses))]))
    own, _, _ = _features(landmarks, landmarks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    kernel, _, _ = _features(witnesses + others, landmarks)
    y = np.r_[np.ones(len(witnesses)), -np.ones(len(others))]
    weight = np.ones(len(y)) if weights is None else np.array(weights, float)
    for side in (y > 0, y < 0):
        weight[side] *= 0.5 / weight[side].sum()
    beta = _svm(kernel @ white, y, weight)
    return landmarks, white @ beta[:-1], float(beta[-1])


def _fit_words(witnesses: list[str], others: list[str], weights: list[float] | None = None) -> WordScorer:
    """The SVM as a table of subsequence weights."""
    landmarks, factors, offset = _machine(witnesses, others, weights)
    _, codes, table = _features([], landmarks)
    weights_of = np.zeros(1 << 18)
    weights_of[codes] = table @ factors
    return WordScorer(weights_of, offset)


class Model:
    """Word values and the curve from a text's highest values to its score."""

    def __init__(self, scorer: WordScorer | None, curve: np.ndarray):
        self.scorer = scorer
        self.curve = curve

    def scores(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(highest @ self.curve[:-1] + self.curve[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled documents that ``usable`` (over the labels' id) allows."""
    sample = labelled_sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label_col, usable, TRAIN_DOCS, id_col)
    sample = staged(sample.select("text", "_label"), "toxicity-sample")  # read once for each round
    totals = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(None, np.zeros(INPUTS + 1))
    counts = (
        sample.mapInPandas(_document_words, "word string, label int, grp long")
        .groupBy("word")
        .agg(F.count_distinct(F.when(F.col("label") == 1, F.col("grp"))).alias("toxic"), F.count_distinct(F.when(F.col("label") == 0, F.col("grp"))).alias("clean"))
    )
    counts = staged(counts, "toxicity-words")
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    least = max(4, totals[1] // 100)
    # a rare word says little: its odds are lowered by a standard error and a half
    odds = odds - 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    leading = counts.filter((F.col("toxic") >= least) & (odds > 1.5)).withColumn("odds", odds)
    witnesses = [r["word"] for r in leading.orderBy(F.col("toxic").desc(), "word").limit(WITNESSES).collect()]
    spread = counts.filter(F.col("clean") > 0).orderBy(F.xxhash64("word"), "word").limit(OTHERS)
    others = [r["word"] for r in spread.collect() if r["word"] not in witnesses]
    if not witnesses or not others:
        return Model(None, np.array([*[0.0] * INPUTS, np.log(totals[1] / totals[0])]))
    scorer = _fit_words(witnesses, others)
    for _ in range(RETRAININGS):
        picks = staged(_pick(sample, scorer), "toxicity-picks")
        both = [picks.filter(F.col("label") == side).orderBy(F.col("n").desc(), "word").limit(most).collect() for side, most in ((1, WITNESSES), (0, OTHERS))]
        toxic, clean = ({r["word"]: float(r["n"]) for r in rows} for rows in both)
        clean |= {w: 1.0 for w in others if w not in clean}  # words that no sentence stands for
        scorer = _fit_words(list(toxic), list(clean), [*toxic.values(), *clean.values()])
    judged = _highest(sample, scorer, "text", "_high").select("_label", "_high").toPandas()  # a few numbers for each sampled document
    x = np.array(judged["_high"].tolist(), float).reshape(-1, INPUTS)
    return Model(scorer, _logistic(x, judged["_label"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the values' weights are kept from falling below 0."""
    x = np.column_stack([x, np.ones(len(x))])
    free = list(range(INPUTS + 1))
    while True:
        own, b = x[:, free], np.zeros(len(free))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ b, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + 1e-2 * np.eye(len(free)), own.T @ (y - p) - 1e-2 * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        if (b[:-1] >= 0).all():
            beta = np.zeros(INPUTS + 1)
            beta[free] = b
            return beta
        free = [i for i, v in zip(free, b, strict=True) if i == INPUTS or v > 0]


def _highest(docs: DataFrame, scorer: WordScorer, text_col: str, out: str) -> DataFrame:
    @arrow_udf("array<double>")
    def highest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _Cached(scorer)
        for texts in batches:
            got = cache.highest(texts.to_pylist())
            yield pa.array(list(got), pa.list_(pa.float64()))

    return docs.withColumn(out, highest.asNondeterministic()(F.col(text_col)))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``out``, 0 to 1."""
    out = free_name(docs, out)
    if model.scorer is None:
        flat = 1 / (1 + np.exp(-model.curve[-1])) if model.curve.any() else 0.0
        return docs.withColumn(out, F.lit(float(flat)))

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _Cached(model.scorer)
        for texts in batches:
            yield pa.array(model.scores(cache.highest(texts.to_pylist())))

    return docs.withColumn(out, scored.asNondeterministic()(F.col(text_col)))
