"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every training text are summed per partition, then over partitions; the driver gets at most
``languages x BUCKETS`` sums and broadcasts the matrix of log probabilities (8 bytes a cell).  Scoring turns a
batch of texts into one sparse list of (row, bucket) and adds up matrix rows per text in numpy.

Letters are lower-cased, everything else is a word gap.  Null texts and texts without a letter are ``und`` with
score 0 and teach nothing; so are all texts where no language was learned.  Ties go to the first language in
alphabetical order.  How like its language a text is, is the mean log probability of its n-grams less what the language's own
n-grams have: unlike the posterior, it is low for letters that are in no learned language.  Long texts are taken in slices that overlap by an n-gram, so each n-gram counts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
SLICE = 1 << 19  # characters taken at a time
LANGUAGES_HELD = 32  # count vectors a task holds before it hands them on
UNDETERMINED = "und"

_words = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    matrix: np.ndarray  # BUCKETS x languages, log probabilities

    @property
    def typical(self) -> np.ndarray:
        """Expected log probability of an n-gram of each language."""
        return (np.exp(self.matrix) * self.matrix).sum(axis=0)


def _slices(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, code points, number of n-gram starts) of each slice of each text that has letters."""
    over = max(GRAMS) - 1
    for row, text in enumerate(texts):
        words = _words.findall(text.lower()) if text else []
        if not words:
            continue
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), SLICE):
            part = codes[at : at + SLICE + over]
            yield row, part, min(SLICE, len(codes) - at)


def _packs(texts: Iterable[str | None]) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    pack, size = [], 0
    for item in _slices(texts):
        pack.append(item)
        size += len(item[1])
        if size >= SLICE:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def sparse_grams(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per pack and n: the buckets of all n-grams, the rows of the texts, and where each row's n-grams start."""
    for pack in _packs(texts):
        codes = np.concatenate([p[1] for p in pack]).astype(np.uint64)
        sizes = np.array([len(p[1]) for p in pack])
        firsts = np.cumsum(sizes) - sizes
        rows = np.array([p[0] for p in pack])
        place = np.arange(len(codes)) - np.repeat(firsts, sizes)
        starts = np.repeat([p[2] for p in pack], sizes)
        room = np.repeat(sizes, sizes) - place
        hashed = np.zeros(len(codes), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            moved = np.zeros_like(codes)
            moved[: len(codes) - n + 1] = codes[n - 1 :]
            hashed = (hashed * np.uint64(0x9E3779B97F4A7C15)) ^ (moved + np.uint64(n))
            if n not in GRAMS:
                continue
            mixed = hashed * np.uint64(0xC2B2AE3D27D4EB4F)
            buckets = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(48)
            valid = (place < starts) & (room >= n)
            counts = np.add.reduceat(valid, firsts, dtype=np.int64)
            some = counts > 0
            yield (
                buckets[valid].astype(np.int64) & (BUCKETS - 1),
                rows[some],
                (np.cumsum(counts) - counts)[some],
            )


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of the texts and languages of all rows of ``docs``; rows without either are left out."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for name, c in sums.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"lang": name, "bucket": at, "n": c[at]})
            sums.clear()

        for b in batches:
            names = b["lang"].to_numpy()
            for buckets, of, firsts in sparse_grams(b["text"]):
                ends = np.append(firsts[1:], len(buckets))
                here = names[of]
                for name in pd.unique(here):
                    if name not in sums and len(sums) >= LANGUAGES_HELD:
                        yield from rows()
                    picked = np.flatnonzero(here == name)
                    took = np.concatenate([buckets[firsts[i] : ends[i]] for i in picked])
                    got = np.bincount(took, minlength=BUCKETS)
                    sums[name] = sums[name] + got if name in sums else got
            for name, n in b.loc[[bool(t and _words.search(t)) for t in b["text"]], "lang"].value_counts().items():
                yield pd.DataFrame({"lang": [name], "bucket": [-1], "n": [n]})
        yield from rows()

    kept = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = kept.where("text is not null and lang is not null").mapInPandas(
        counted, "lang string, bucket int, n long"
    )
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[sums["bucket"].to_numpy(), [languages.index(x) for x in sums["lang"]]] = sums["n"]
    docs_of, grams = counts[BUCKETS], counts[:BUCKETS]
    with np.errstate(divide="ignore"):
        prior = np.log(docs_of / docs_of.sum()) if len(languages) else docs_of
    matrix = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    return Model(languages, prior, matrix)


def measured(texts: Iterable[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its posterior probability and its likeness (``und``: minus infinity) for each text."""
    texts = list(texts)
    total = np.zeros((len(texts), len(model.languages)))
    grams = np.zeros(len(texts))
    if model.languages:
        for buckets, rows, firsts in sparse_grams(texts):
            np.add.at(total, rows, np.add.reduceat(model.matrix[buckets], firsts, axis=0))
            np.add.at(grams, rows, np.diff(np.append(firsts, len(buckets))))
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    likeness = np.full(len(texts), -np.inf)
    typical = model.typical
    for i in np.flatnonzero(grams):
        posterior = total[i] + model.prior
        best = int(posterior.argmax())
        names[i] = model.languages[best]
        scores[i] = 1 / np.exp(posterior - posterior[best]).sum()
        likeness[i] = total[i, best] / grams[i] - typical[best]
    return names, scores, likeness


def scored(texts: Iterable[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    return measured(texts, model)[:2]


def predicted(docs: DataFrame, text: str, model: Model, likeness: bool = False) -> Column:
    """Struct of ``lang_pred``, ``score`` and, if asked, ``likeness`` for each text; the model is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double" + ", likeness double" * likeness)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores, like = measured(b, held.value)
            out = {"lang_pred": pd.Series(names, dtype=object), "score": scores}
            yield pd.DataFrame(out | ({"likeness": like} if likeness else {}))

    return predict(F.col(text))
