"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted regression trees are grown on statistics of labelled documents; every
path from a root to a node is a rule, a conjunction of comparisons. Logistic
regression with a lasso penalty keeps few rules. The kept rules become Spark
column expressions, so that scoring needs no Python.

Statistics of null and empty texts are 0. Without labels of both classes the
score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .training import labelled_sample

TRAIN_DOCS = 4000
TREES, DEPTH, LEAF, RATE = 40, 3, 20, 0.3
#: Lasso strengths tried, as shares of the strength that leaves no rule.
PENALTIES = (0.3, 0.1, 0.03, 0.01)
MAX_RULES = 60


def statistics(text: Column, words_col: str) -> dict[str, Column]:
    """The named statistics of a text whose words are in ``words_col``. Several are shares of its characters or words."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    held = F.col(words_col)
    w = F.greatest(F.size(held), F.lit(1)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return {
        "words": F.size(held).cast("double"),
        "word_length": F.length(t) / w,
        "upper": left(r"[^\p{Lu}]+") / n,
        "symbols": left(r"[\p{L}\p{N}\s.,]+") / n,
        "digits": left(r"[^0-9]+") / n,
        "distinct": F.size(F.array_distinct(held)) / w,
        "short": F.size(F.filter(held, lambda x: F.length(x) <= 3)) / w,
        "stops": left(r"[^.]+") / w,
        "lines": left(r"[^\n]+") / w,
    }


NAMES = ("words", "word_length", "upper", "symbols", "digits", "distinct", "short", "stops", "lines")


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column for each statistic; their names by statistic."""
    words = free_name(docs, "_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(words, F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    made = statistics(F.col(text_col), words)
    names = {k: free_name(out, f"_stat_{k}") for k in made}
    return out.select("*", *[c.alias(names[k]) for k, c in made.items()]).drop(words), names


# ---------------------------------------------------------------- trees and rules


@dataclass(frozen=True)
class Test:
    feature: int
    threshold: float
    above: bool


Rule = tuple[Test, ...]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float] | None:
    """The best gain, feature and threshold (values at most the threshold go left)."""
    best = None
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], g[order].cumsum(), h[order].cumsum()
        ends = np.flatnonzero((v[1:] > v[:-1]) & (np.arange(1, len(v)) >= LEAF) & (np.arange(1, len(v)) <= len(v) - LEAF))
        if not len(ends):
            continue
        gain = gs[ends] ** 2 / (hs[ends] + 1) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + 1) - total
        i = int(gain.argmax())
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = float(gain[i]), f, float((v[ends[i]] + v[ends[i] + 1]) / 2)
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, rules: list[Rule], value: np.ndarray) -> None:
    found = _split(x[rows], g[rows], h[rows]) if len(path) < DEPTH and len(rows) >= 2 * LEAF else None
    if found is None:
        value[rows] = g[rows].sum() / (h[rows].sum() + 1)
        return
    _, f, at = found
    high = x[rows, f] > at
    for above, part in ((False, rows[~high]), (True, rows[high])):
        longer = (*path, Test(f, at, above))
        rules.append(longer)
        _grow(x, g, h, part, longer, rules, value)


def boosted_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """All node paths of gradient-boosted trees, each once."""
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), (), rules, value)
        score += RATE * value
    return list(dict.fromkeys(rules))


def fired(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for t in rule:
            out[:, j] &= (x[:, t.feature] > t.threshold) == t.above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic weights (the last is the offset, not penalised) by accelerated proximal steps."""
    z = np.column_stack([z, np.ones(len(z))])
    size = 4 / (np.linalg.norm(z, 2) ** 2 / len(y))
    shrink = np.r_[np.full(z.shape[1] - 1, penalty), 0] * size
    beta, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        gradient = z.T @ (1 / (1 + np.exp(-z @ ahead)) - y) / len(y)
        new = ahead - size * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        longer = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / longer * (new - beta)
        beta, t = new, longer
    return beta


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    offset: float

    def expression(self, names: dict[str, str]) -> Column:
        """The score as a column expression over statistic columns."""
        total = F.lit(self.offset)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for t in rule:
                column = F.col(names[NAMES[t.feature]])
                held = held & ((column > t.threshold) if t.above else (column <= t.threshold))
            total = total + F.when(held, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(fired(x, self.rules) @ np.array(self.weights, float) + self.offset)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from a tree ensemble, weighted by the lasso; its strength is chosen on a fifth of the rows."""
    if len(y) == 0 or y.min() == y.max():
        return Model([], [], 30.0 if len(y) and y.max() else -30.0)
    rules = boosted_rules(x, y)
    z = fired(x, rules).astype(float)
    check = np.arange(len(y)) % 5 == 0
    strongest = np.abs(z.T @ (y - y.mean())).max() / len(y)
    best, chosen = np.inf, PENALTIES[0]
    beta = np.zeros(z.shape[1] + 1)
    for share in PENALTIES:
        beta = lasso(z[~check], y[~check], share * strongest, beta)
        if (beta[:-1] != 0).sum() > MAX_RULES:
            break
        margin = z[check] @ beta[:-1] + beta[-1]
        loss = np.logaddexp(0, np.where(y[check] == 1, -margin, margin)).mean()
        if loss < best:
            best, chosen = loss, share
    beta = lasso(z, y, chosen * strongest, np.zeros(z.shape[1] + 1))
    kept = np.flatnonzero(beta[:-1])
    return Model([rules[i] for i in kept], beta[kept].tolist(), float(beta[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on about TRAIN_DOCS labelled documents of each class that ``usable`` (over the labels' id) allows.

    Where a class gives only a part, its rows weigh as the class does: the offset is moved by the log of the shares.
    """
    sample = labelled_sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label_col, usable, TRAIN_DOCS, id_col)
    rows, names = with_statistics(sample.select(F.col(id_col).alias("_order"), "text", "_label"), "text")
    got = rows.select("_order", "_label", *[names[n] for n in NAMES]).toPandas().sort_values(["_order"], kind="stable")  # bounded: numbers of the sample
    x, y = got[[names[n] for n in NAMES]].to_numpy(float), got["_label"].to_numpy(float)
    model = fit(x, y)
    if model.rules:
        all_ = {r[label_col]: r["n"] for r in labels.filter(usable).groupBy(label_col).agg(F.count("*").alias("n")).collect()}
        model.offset += float(np.log((all_[1] / all_[0]) / (y.sum() / (len(y) - y.sum()))))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a double column ``out``, 0 to 1."""
    rows, names = with_statistics(docs, text_col)
    return rows.withColumn(free_name(docs, out), model.expression(names)).drop(*names.values())
