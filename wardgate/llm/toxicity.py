"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features of a text are densities of a fixed lexicon and of one learned from labelled texts, how near its hits are to
the second person, rates of capitals, punctuation and obfuscated words, and the densest stretch of hits.
The learned lexicon holds words and word beginnings that labelled toxic texts use far more often than clean
ones; it is learned from at most ``LEXICON_ROWS`` labelled rows of each class, taken in the order of a hash,
so the set of their ids has a bound and is broadcast.  Trees and calibration use the features of all labelled
training rows: four parts in five grow the trees (Spark ML), the fifth part calibrates their margin.

Null and empty texts have all features zero and are scored like any other.  Without labels of both classes every
score is the class there is (none: 0).  Repeated labels count each time; a label without a document does not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed

#: Insults and abuse in the languages most web text is in.
LEXICON = frozenset(
    """
    idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting dumb
    imbecile fool jerk creep freak pig vermin filth garbage retard bastard bitch whore slut asshole shit fuck
    fucking fucker damn crap coward hate ugly
    idiote imbécile connard connasse salope merde putain débile minable ordure crétin
    idiotin dummkopf arschloch scheiße scheisse hure abschaum versager widerlich blöd
    idiota imbécil estúpido estúpida puta mierda cabrón asqueroso basura payaso perdedor patético
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre
    vos tú ti tus usted ustedes vosotros os vuestro
    """.split()
)
LEET = str.maketrans("0134578@$!€|", "oieastbasiei")
BEGINNINGS = (4, 5, 6)
LEXICON_ROWS = 20_000
LEXICON_SIZE = 512
LEAST_TEXTS = 6  # toxic texts that a learned term occurs in
LEAST_SHARE = 0.004  # of the toxic texts that a learned term occurs in
LEAST_RATIO = 8.0  # of its shares in toxic and clean texts
NEAR = 5  # words
STRETCH = 100  # words
TREES, DEPTH = 20, 3
THRESHOLD = 0.7
WORDS_KEPT = 400_000
FEATURES = 13

HIT, LEARNED, SECOND, OBFUSCATED, HIDDEN = 1, 2, 4, 8, 16

_edges = re.compile(r"^[\W_]+|[\W_]+$")
_letters = re.compile(r"[^\W\d_]+")
_UPPER = np.array([65 <= i <= 90 for i in range(256)], float)
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 192 for i in range(256)], float)
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)], float)


def terms(word: str) -> list[str]:
    """A bare word and its beginnings (marked with a star)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def bare_words(text: str | None) -> set[str]:
    return {w for x in set(text.lower().split()) if (w := _edges.sub("", x))} if text else set()


class Words(dict):
    """What each raw word says, as bits; dropped together once there are too many."""

    def __init__(self, learned: frozenset[str]):
        super().__init__()
        self.learned = learned

    def __missing__(self, raw: str) -> int:
        word = _edges.sub("", raw.lower())
        bits = 0
        if word:
            bits |= HIT * (word in LEXICON) | SECOND * (word in SECOND_PERSON)
            bits |= LEARNED * (not self.learned.isdisjoint(terms(word)))
            if not word.isalpha() and _letters.search(word):
                plain = "".join(_letters.findall(word.translate(LEET)))
                bits |= OBFUSCATED
                if plain != word and (plain in LEXICON or not self.learned.isdisjoint(terms(plain))):
                    bits |= HIDDEN
        if len(raw) <= 48:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[raw] = bits
        return bits


def features(text: str | None, words: Words) -> list[float]:
    """The dense features of a text."""
    if not text or not (raw := text.split()):
        return [0.0] * FEATURES
    bits = np.fromiter([words[w] for w in raw], np.uint8, len(raw))
    n = len(bits)
    hit = (bits & (HIT | LEARNED | HIDDEN)) > 0
    hits = int(hit.sum())
    second = np.flatnonzero(bits & SECOND)
    near = 0.0
    if hits and len(second):
        at = np.flatnonzero(hit)
        right = np.searchsorted(second, at)
        ahead = second[np.minimum(right, len(second) - 1)] - at
        behind = at - second[np.maximum(right - 1, 0)]
        gap = np.minimum(np.where(ahead < 0, n, ahead), np.where(behind < 0, n, behind))
        near = float((gap <= NEAR).mean())
    sums = np.concatenate([[0], np.cumsum(hit)])
    wide = min(STRETCH, n)
    signs = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = signs.sum()
    return [
        np.log1p(n),
        100.0 * np.count_nonzero(bits & HIT) / n,
        100.0 * np.count_nonzero(bits & LEARNED) / n,
        np.log1p(hits),
        100.0 * hits / n,
        near,
        100.0 * len(second) / n,
        float(signs @ _UPPER / max(1.0, signs @ _LETTER)),
        float(signs @ _MARK / total),
        100.0 * signs[33] / total,
        100.0 * np.count_nonzero(bits & OBFUSCATED) / n,
        100.0 * np.count_nonzero(bits & HIDDEN) / n,
        float((sums[wide:] - sums[:-wide]).max()),
    ]


def _table(held: Counter) -> pd.DataFrame:
    return pd.DataFrame({"term": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})


def learned_lexicon(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> frozenset[str]:
    """Terms that mark toxic texts; ``labels`` has (doc_id, toxic)."""

    def some(value: int) -> DataFrame:
        return labels.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICON_ROWS)

    marked = landed(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
            F.broadcast(some(1).union(some(0))),  # at most 2 x LEXICON_ROWS ids
            "doc_id",
        )
        # of texts that are equal but for letter case and white space one counts
        .withColumn("kind", F.sha2(F.regexp_replace(F.lower("text"), r"\s+", " "), 256))
        .groupBy("toxic", "kind")
        .agg(F.min_by("text", "doc_id").alias("text"))
        .select("text", "toxic"),
        "labelled-texts",
    )
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return frozenset()

    def counted(rows: DataFrame, only) -> dict[str, int]:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: Counter = Counter()
            for b in batches:
                for t in b["text"]:
                    found = {x for w in bare_words(t) for x in terms(w)}
                    held.update(found if only is None else found & only.value)
                    if len(held) > WORDS_KEPT:
                        yield _table(held)
                        held = Counter()
            yield _table(held)

        least = LEAST_SHARE * sizes[1] if only is None else 0
        sums = rows.mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r.term: r.n for r in sums.where(F.col("n") >= max(LEAST_TEXTS, least) if only is None else F.lit(True)).collect()}

    toxic = counted(marked.where("toxic = 1").select("text"), None)
    only = docs.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = counted(marked.where("toxic = 0").select("text"), only)
    surely = lambda n: n - 1.5 * n**0.5  # noqa: E731  the low end of what the count may stand for
    share = {t: surely(n) / sizes[1] / ((clean.get(t, 0) + 1) / sizes[0]) for t, n in toxic.items()}
    chosen = sorted((t for t in share if share[t] >= LEAST_RATIO), key=lambda t: (-share[t] * toxic[t], t))
    return frozenset(chosen[:LEXICON_SIZE])


@dataclass(frozen=True)
class Model:
    learned: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def featured(docs: DataFrame, text: str, learned: frozenset[str]) -> Column:
    """``array<double>``: the features of each text."""
    held = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(held.value)
        for b in batches:
            yield pd.Series([features(t, words) for t in b], dtype=object)

    return of(F.col(text))


def _margins(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(rows).withColumn("__margin", vector_to_array("__raw")[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Model of the labelled texts; ``docs`` and ``labels`` hold training rows only."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)"
    )
    learned = learned_lexicon(docs, known, doc_id, text)
    table = landed(docs.select(F.col(doc_id).alias("doc_id"), featured(docs, text, learned).alias("f")), "features")
    return fitted(table, known, learned)


def fitted(table: DataFrame, known: DataFrame, learned: frozenset[str]) -> Model:
    """Trees and calibration from (doc_id, f) and (doc_id, toxic)."""
    rows = landed(
        table.join(known, "doc_id").select(
            array_to_vector("f").alias("__features"),
            F.col("toxic").cast("double").alias("__label"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates"),
        ),
        "labelled",
    )
    n = {(r["calibrates"], r["__label"]): r["count"] for r in rows.groupBy("calibrates", "__label").count().collect()}
    ones = sum(v for (_, y), v in n.items() if y == 1)
    if not ones or ones == sum(n.values()):
        return Model(learned, None, None, float(ones > 0))
    apart = all(n.get((c, y)) for c in (False, True) for y in (0.0, 1.0))
    grower = GBTClassifier(
        featuresCol="__features", labelCol="__label", predictionCol="__class",
        maxIter=TREES, maxDepth=DEPTH, seed=1, minInstancesPerNode=5, maxBins=64,
    )
    grower.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    trees = grower.fit(rows.where("not calibrates") if apart else rows)
    margins = _margins(rows.where("calibrates") if apart else rows, trees).select("__margin", "__label")
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="__label", predictionCol="__score").fit(margins)
    return Model(learned, trees, calibration)


def scored(rows: DataFrame, model: Model, array: str) -> DataFrame:
    """``rows`` with ``score`` and ``predicted`` from the features in ``array``, which is dropped."""
    kept = [c for c in rows.columns if c not in (array, "score", "predicted")]
    if model.trees is None:
        out = rows.withColumn("__score", F.lit(model.constant))
    else:
        vectors = rows.withColumn("__features", array_to_vector(array))
        out = model.calibration.transform(_margins(vectors, model.trees))
    score = F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0))
    return out.select(*kept, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) in place of columns of that name."""
    return scored(docs.withColumn("__f", featured(docs, text, model.learned)), model, "__f")
