"""Language-model scoring with a hidden Markov model.

Counting: every training token is counted, per partition and then over all; the table of counts stays
distributed.  The ``FREQUENT`` commonest words are symbols of the model; every other word belongs to one of
``CLASSES`` classes by its last two bytes, and within a class has the share (c + 0.1) / (C + 0.1 (V + 1)) of its
count among the class's C tokens and V words, with one place for unseen words.  The probability of a text is
thus that of its symbols times these shares, and sums to one over all texts.  Shares and counts of the commonest
words, at most ``LOOKUP``, are broadcast; those of all rarer words come from a join with the whole table.

Training: Baum-Welch over the symbols of all training texts.  Each partition adds up its expected counts, Spark
adds up the partitions, and the driver gets one row per symbol, transition and state.  States start from
clusters of common words that occur in the same documents, which one pass counts.

Scoring: the scaled forward recursion, exact for texts of any length; texts of a batch advance together.

Null and empty texts are the end token alone.  Without training texts each token has its smoothed share.  Rows
are numbered, so repeated or null ids stay apart; a row whose id is null is neither training nor held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed

FREQUENT = 16384
LOOKUP = 131072
CLASSES = 1024
SEEDS = 192  # common words whose company gives the first states
STATES = 6
ITERATIONS = 2
SMOOTHING = 0.1
WORDS_HELD = 400_000  # distinct words a task counts before it hands them on
TOKENS_AT_A_TIME = 1_500_000
STAY = 0.9


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, as UTF-8."""
    return text.encode().lower().split() if text else []


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows; words as binary."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(words_of(t))
                if len(held) > WORDS_HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(counted, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What every task knows of the words."""

    index: dict[bytes, int]  # of the commonest words; the end is the last entry of the arrays
    counts: np.ndarray
    symbols: np.ndarray
    class_mass: np.ndarray  # C + 0.1 (V + 1) of each class
    total: int
    distinct: int

    @property
    def n_symbols(self) -> int:
        return FREQUENT + CLASSES + 1

    def base(self, c):
        return np.log10((c + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))

    def share(self, c, symbols):
        """log10 of the share of a word in its class; 0 for symbols of their own."""
        classes = symbols - FREQUENT
        inside = (classes >= 0) & (classes < CLASSES)
        mass = np.where(inside, self.class_mass[np.where(inside, classes, 0)], c + SMOOTHING)
        return np.log10((c + SMOOTHING) / mass)

    def symbol_masses(self) -> np.ndarray:
        out = np.zeros(self.n_symbols)
        own = (self.symbols < FREQUENT) | (self.symbols == self.n_symbols - 1)
        out[self.symbols[own]] = self.counts[own] + SMOOTHING
        out[FREQUENT : FREQUENT + CLASSES] = self.class_mass
        return out


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    """``counts`` has (word, c); each training text adds one end."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The counts fall into a bounded number of steps; the driver gets the words of the highest steps that fit.
    step = F.floor(F.log2("c") * 64).cast("int")
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, lowest = LOOKUP, None
    for at, n in steps:
        room -= n
        if room < 0:
            break
        lowest = at
    top = counts.where(F.lit(False) if lowest is None else step >= lowest).collect()
    top = sorted(((-r.c, bytes(r.word)) for r in top))
    words = [w for _, w in top]
    c = np.array([-n for n, _ in top], np.int64)
    symbols = np.arange(len(words))
    symbols[FREQUENT:] = [FREQUENT + word_class(w) for w in words[FREQUENT:]]
    tail = (
        counts.groupBy((F.crc32(F.expr("substring(word, -2, 2)")) % CLASSES).cast("int").alias("class"))
        .agg(F.sum("c").alias("c"), F.count("*").alias("v"))
        .toPandas()
    )
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[tail["class"]], kinds[tail["class"]] = tail["c"], tail["v"]
    for w, n in zip(words[:FREQUENT], c[:FREQUENT].tolist(), strict=False):
        mass[word_class(w)] -= n
        kinds[word_class(w)] -= 1
    return Lexicon(
        {w: i for i, w in enumerate(words)},
        np.append(c, n_texts),
        np.append(symbols, FREQUENT + CLASSES).astype(np.int32),
        mass + SMOOTHING * (kinds + 1),
        int(sums[0]) + n_texts,
        int(sums[1]) + (n_texts > 0),
    )


ENCODED = pa.schema(
    [
        ("train", pa.bool_()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("shares", pa.float64()),
        ("symbols", pa.list_(pa.int32())),
        ("rare", pa.list_(pa.binary())),
        ("rare_n", pa.list_(pa.int32())),
    ]
)


def encode(docs: DataFrame, doc_id: str, text: str, lex: Lexicon) -> DataFrame:
    """Each text as symbols with the sums over its looked-up words, and its rarer words with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(lex)
    kind = dict(docs.dtypes)[doc_id]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        base, share = lex.base(lex.counts), lex.share(lex.counts, lex.symbols)
        end, get = len(lex.counts) - 1, lex.index.get
        unknown = -1
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, known, of_base, of_share, sizes, flat = [], [], [], [], [], []
                rare_words, rare_counts, rare_sizes = [], [], []
                for t in part.column("text").to_pylist():
                    words = words_of(t)
                    idx = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
                    idx = np.append(idx, end)
                    seen = idx[idx >= 0]
                    symbols = lex.symbols[idx]
                    rare = Counter()
                    if len(seen) < len(idx):
                        missing = np.flatnonzero(idx < 0).tolist()
                        symbols[missing] = [FREQUENT + word_class(words[i]) for i in missing]
                        rare.update(words[i] for i in missing)
                    n.append(len(idx))
                    known.append(int((lex.counts[seen] > 0).sum()))
                    of_base.append(float(base[seen].sum()))
                    of_share.append(float(share[seen].sum()))
                    sizes.append(len(symbols))
                    flat.append(symbols)
                    rare_words += rare
                    rare_counts += rare.values()
                    rare_sizes.append(len(rare))
                ends = lambda s: pa.array(np.concatenate([[0], np.cumsum(s)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("train"),
                        part.column("held_out"),
                        pa.array(n, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(of_base, pa.float64()),
                        pa.array(of_share, pa.float64()),
                        pa.ListArray.from_arrays(ends(sizes), pa.array(np.concatenate(flat), pa.int32())),
                        pa.ListArray.from_arrays(ends(rare_sizes), pa.array(rare_words, pa.binary())),
                        pa.ListArray.from_arrays(ends(rare_sizes), pa.array(rare_counts, pa.int32())),
                    ],
                    names=["doc_id", *ENCODED.names],
                )

    schema = (
        f"doc_id {kind}, train boolean, held_out boolean, n_tokens long, n_known long, base double, "
        "shares double, symbols array<int>, rare array<binary>, rare_n array<int>"
    )
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "train", "held_out")
    return columns.mapInArrow(encoded, schema).withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # symbols x states


class _Together:
    """Sequences in the order of time: step t holds the symbols of all sequences longer than t."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        firsts = np.cumsum(sizes) - sizes
        flat = np.concatenate([sequences[i] for i in self.order])
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        self.steps = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        time = np.arange(len(flat)) - np.repeat(firsts, sizes)
        place = self.steps[time] + np.repeat(np.arange(len(sizes)), sizes)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[place] = flat


def log_likelihoods(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for some in _bounded(sequences):
        g = _Together([sequences[i] for i in some])
        total = np.zeros(len(some))
        state = None
        for t, n in enumerate(g.active.tolist()):
            emitted = m.emits[g.symbols[g.steps[t] : g.steps[t] + n]]
            state = (np.broadcast_to(m.start, emitted.shape) if t == 0 else state[:n] @ m.moves) * emitted
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        out[np.array(some)[g.order]] = total
    return out


def expected_counts(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected numbers of starts, moves and emissions (forward and backward recursion, scaled)."""
    k = len(m.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emits)
    for some in _bounded(sequences):
        g = _Together([sequences[i] for i in some])
        active, steps = g.active.tolist(), g.steps.tolist()
        forward = np.empty((len(g.symbols), k), np.float32)
        scales = np.empty(len(g.symbols))
        state = None
        for t, n in enumerate(active):
            emitted = m.emits[g.symbols[steps[t] : steps[t] + n]]
            state = (np.broadcast_to(m.start, emitted.shape) if t == 0 else state[:n] @ m.moves) * emitted
            scale = state.sum(axis=1)
            state /= scale[:, None]
            forward[steps[t] : steps[t] + n] = state
            scales[steps[t] : steps[t] + n] = scale
        back = np.ones((active[-1], k))
        turned = m.moves.T.copy()
        for t in range(len(active) - 1, -1, -1):
            n, at = active[t], steps[t]
            if t + 1 < len(active):
                later, there = active[t + 1], steps[t + 1]
                ahead = m.emits[g.symbols[there : there + later]] * back
                ahead /= scales[there : there + later, None]
                moves += forward[at : at + later].T @ ahead
                if n > later:
                    back = np.ones((n, k))
                    back[:later] = ahead @ turned
                else:
                    back = ahead @ turned
            if t + 1 < len(active):
                forward[there : there + later] = held
            held = forward[at : at + n] * back
        forward[: active[0]] = held
        starts += held.sum(axis=0)
        for s in range(k):
            emits[:, s] += np.bincount(g.symbols, weights=forward[:, s], minlength=len(m.emits))
    return starts, moves * m.moves, emits


def _bounded(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences, so many at a time that their tokens stay below a bound (or one)."""
    some, size = [], 0
    for i, s in enumerate(sequences):
        if some and size + len(s) > TOKENS_AT_A_TIME:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(s)
    if some:
        yield some


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("symbols")
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _summed(rows: DataFrame, per_partition, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Adds up (kind, at, values) that ``per_partition`` makes of the symbol sequences of each partition."""
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, values in enumerate(per_partition(_sequences(b) for b in batches)):
            at = np.flatnonzero(values.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32))]
                + [pa.array(values[at, i].astype(np.float64)) for i in range(width)],
                names=["kind", "at", *names],
            )

    schema = "kind int, at int, " + ", ".join(f"{n} double" for n in names)
    sums = rows.select("symbols").mapInArrow(run, schema).groupBy("kind", "at").agg(*[F.sum(n).alias(n) for n in names])
    got = sums.toPandas()
    return dict(zip(zip(got["kind"], got["at"], strict=True), got[names].to_numpy(), strict=True))


def first_model(rows: DataFrame, masses: np.ndarray) -> Model:
    """States from clusters of the common words by the documents they share."""
    seeds = np.sort(np.argsort(-masses[:FREQUENT], kind="stable")[:SEEDS])

    def company(batches) -> Iterator[np.ndarray]:
        total = np.zeros((SEEDS, SEEDS))
        for sequences in batches:
            for at in range(0, len(sequences), 2048):
                part = sequences[at : at + 2048]
                flat = np.concatenate(part) if part else np.zeros(0, np.int32)
                doc = np.repeat(np.arange(len(part)), [len(s) for s in part])
                near = np.searchsorted(seeds, flat)
                near[near == SEEDS] = 0
                hit = seeds[near] == flat
                table = np.bincount(doc[hit] * SEEDS + near[hit], minlength=len(part) * SEEDS)
                table = table.reshape(len(part), SEEDS).astype(float)
                table /= np.maximum(1, np.linalg.norm(table, axis=1))[:, None]
                total += table.T @ table
        yield total

    got = _summed(rows, company, SEEDS)
    shared = np.zeros((SEEDS, SEEDS))
    for (_, i), v in got.items():
        shared[i] = v
    profile = shared / np.maximum(1e-9, np.linalg.norm(shared, axis=1))[:, None]
    centres = profile[:1]
    while len(centres) < STATES:  # the word least like all centres so far
        centres = np.vstack([centres, profile[(profile @ centres.T).max(axis=1).argmin()]])
    for _ in range(20):
        of = (profile @ centres.T).argmax(axis=1)
        for s in range(STATES):
            if (of == s).any():
                mean = profile[of == s].sum(axis=0)
                centres[s] = mean / max(1e-9, np.linalg.norm(mean))
    emits = np.repeat((masses / masses.sum())[:, None], STATES, axis=1)
    emits[seeds] *= 0.1
    emits[seeds, of] *= 50
    emits /= emits.sum(axis=0)
    moves = np.full((STATES, STATES), (1 - STAY) / max(1, STATES - 1))
    np.fill_diagonal(moves, STAY if STATES > 1 else 1.0)
    return Model(np.full(STATES, 1 / STATES), moves, emits)


def train(rows: DataFrame, masses: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the symbol sequences of ``rows``."""
    m = first_model(rows, masses)
    prior = (masses / masses.sum())[:, None]
    for _ in range(iterations):
        held = rows.sparkSession.sparkContext.broadcast(m)

        def counted(batches, held=held) -> Iterator[np.ndarray]:
            m = held.value
            starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(m.emits)
            for sequences in batches:
                s, t, e = expected_counts(sequences, m)
                starts, moves, emits = starts + s, moves + t, emits + e
            yield starts[None, :]
            yield moves
            yield emits

        got = _summed(rows, counted, STATES)
        starts, moves, emits = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.zeros_like(m.emits)
        for (kind, at), v in got.items():
            (starts[None, :], moves, emits)[kind][at] += v
        emits += SMOOTHING * len(masses) * 0.1 * prior
        m = Model(starts / starts.sum(), moves / moves.sum(axis=1)[:, None], emits / emits.sum(axis=0))
    return m


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_where=None, held_where=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``train_where`` and ``held_where`` are conditions on ``docs``: the rows to learn from (default: all) and
    the value of ``held_out`` (default: not training).
    """
    train_where = F.lit(True) if train_where is None else train_where
    marked = docs.withColumn("train", F.coalesce(train_where, F.lit(False)))
    marked = marked.withColumn("held_out", held_where if held_where is not None else ~F.col("train"))
    learned = marked.where("train")
    counts = landed(count_words(learned, text), "word-counts")
    lex = lexicon(counts, learned.count())
    rows = landed(encode(marked, doc_id, text, lex), "symbols")
    m = train(rows.where("train"), lex.symbol_masses())
    held = docs.sparkSession.sparkContext.broadcast(m)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols = log_likelihoods(_sequences(b), held.value)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(symbols)], names=[*kept, "symbols_score"]
            )

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "shares"]
    kinds = dict(rows.dtypes)
    scored = rows.select(*kept, "symbols").mapInArrow(
        forward, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", symbols_score double"
    )
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n")
    )
    classes = docs.sparkSession.createDataFrame(
        [(i, float(x)) for i, x in enumerate(lex.class_mass)], "class int, mass double"
    )
    room = lex.total + SMOOTHING * (lex.distinct + 1)
    smoothed = F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING)
    sums = (
        rare.join(counts, "word", "left")
        .withColumn("class", (F.crc32(F.expr("substring(word, -2, 2)")) % CLASSES).cast("int"))
        .join(F.broadcast(classes), "class")  # CLASSES rows
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more_known"),
            F.sum(F.col("n") * F.log10(smoothed / F.lit(room))).alias("more_base"),
            F.sum(F.col("n") * F.log10(smoothed / F.col("mass"))).alias("more_shares"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("symbols_score") + F.col("shares") + zero("more_shares")).alias("score"),
    )
