"""Language identification by rank-order n-gram profiles.

A language's profile lists its most frequent letter n-grams (one to three
letters, words padded with a boundary) by falling frequency. A document gets
the same list, and the distance to a profile is the sum over the document's
n-grams of how far each is out of place; an n-gram that the profile lacks
costs the profile's full length.

Null and empty texts, and texts without a letter, are ``und`` with score 0.
Equal distances go to the language that sorts first. With no profiles (an
empty training table) every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name

#: Documents a language's profile is counted on, about (chosen by a hash of the id).
TRAIN_DOCS_PER_LANG = 2000
#: N-grams in a profile, and in a document's list.
PROFILE_SIZE = 400
#: Languages that can be told apart; the profiles' size is this times PROFILE_SIZE at most.
MAX_LANGS = 1000
UNDETERMINED = "und"

_BOUNDARY, _CLASSES = 1, 1022
_letters: np.ndarray | None = None


def _letter_classes() -> np.ndarray:
    """For each code point 0 if it is no letter, else a class from 2 to 1023."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.int32)
        cps = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)
        table[cps] = 2 + cps % _CLASSES
        _letters = table
    return _letters


def gram_codes(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a text, repeats kept; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int32)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _letter_classes()[raw]
    keep = cls > 0
    if not keep.any():
        return np.empty(0, np.int32)
    keep[1:] |= keep[:-1]  # one boundary after each word
    cls = cls[keep]
    seq = np.empty(len(cls) + 2, np.int32)
    seq[0] = seq[-1] = _BOUNDARY
    seq[1:-1] = np.where(cls == 0, _BOUNDARY, cls)
    if seq[-2] == _BOUNDARY:
        seq = seq[:-1]
    a, b, c = seq[:-2], seq[1:-1], seq[2:]
    inner = b != _BOUNDARY
    return np.concatenate([b[inner], seq[:-1] << 10 | seq[1:], (a << 20 | b << 10 | c)[inner]])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equals by code."""
    grams, counts = np.unique(codes, return_counts=True)
    if len(grams) > size:  # those below the size-th count can't rank
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        top = counts >= least
        grams, counts = grams[top], counts[top]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial n-gram counts for each language and batch."""
    for batch in batches:
        parts = []
        for lang, texts in batch.groupby("lang")["text"]:
            grams, counts = np.unique(np.concatenate([gram_codes(t) for t in texts]), return_counts=True)
            parts.append(pd.DataFrame({"lang": lang, "gram": grams, "n": counts.astype(np.int64)}))
        if parts:
            yield pd.concat(parts)


def learn_profiles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = TRAIN_DOCS_PER_LANG,
    size: int = PROFILE_SIZE,
) -> dict[str, list[int]]:
    """Profiles of the languages in ``lang_col`` (rows with a null there, or no text, don't count).

    The profiles are counted on about ``docs_per_lang`` documents a language,
    those with the smallest share of an id hash; languages with fewer give all.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(totals) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not totals:
        return {}
    grain = 1 << 20
    share = F.lit(grain)
    for lang, n in totals.items():
        if n > docs_per_lang:
            share = F.when(F.col("lang") == lang, F.lit(max(1, grain * docs_per_lang // n))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(grain)) < share)
    counts = (
        sample.select("lang", "text")
        .mapInPandas(_counted, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).orderBy("lang", "rank")
    profiles: dict[str, list[int]] = {}
    for row in top.collect():  # languages x size rows at most
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Identifier:
    """Profiles as arrays; picklable, so that a task gets it with its function."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.langs = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int32))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(profiles[lang], np.int32))] = np.arange(len(profiles[lang]))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each profile, 0 to 1."""
        own = ranked(codes, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        off = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own), dtype=np.int32)), self.size))
        return off.sum(axis=1) / (len(own) * self.size)

    def best(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text) if self.langs else ()
        if not len(codes):
            return UNDETERMINED, 0.0
        away = self.distances(codes)
        i = int(np.argmin(away))
        return self.langs[i], float(1.0 - away[i])


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` (lang, score), renamed if ``docs`` has such a column."""
    model = Identifier(profiles)

    @arrow_udf("struct<lang: string, score: double>")
    def told(texts: pa.Array) -> pa.Array:
        found = [model.best(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"]
        )

    return docs.withColumn(free_name(docs, out), told.asNondeterministic()(F.col(text_col)))  # evaluated once, whatever reads it
