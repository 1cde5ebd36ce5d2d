"""Best-fit packing of token pieces into sequences, by the configuration linear program.

Every document becomes pieces: its token ids and an end id, cut only where it is longer than a sequence.  Only
the histogram of piece lengths (one count per possible length) reaches the driver.  There the configuration
linear program, which asks how often to use each way of filling a sequence, is solved by multiplicative weights:
lengths that lag behind in cover weigh more, a knapsack dynamic program prices the best fillings for these
weights, and the best filling of each lagging length is used a step.  Rounding down gives whole fillings that
never use a piece twice; what is left over is put together best-fit decreasing, many equal pieces at a time.

The pieces learn their places without meeting: each gets a number among the pieces of its length (lengths are
salted, so a frequent one is spread), and the number points into a table of fillings, whose size depends on the
sequence length alone.

Null and empty texts are one piece with the end id.  Repeated rows are packed as often as they occur, and
repeated ids are told apart by nothing but their place.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardgate.llm.common import landed

SEQUENCE = 2048
ROUNDS = 96  # knapsack programs solved
FILLINGS_PER_ROUND = 48
STEP = 0.2  # greatest share of a length that one filling covers at a time
SHARPNESS = 8.0
SALTS = 256
ROWS_PER_SALT = 1_000_000
WORDS_KEPT = 500_000
LONGEST_WORD_KEPT = 48
TEXTS_AT_A_TIME = 256
BETWEEN = "♥"

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


# Letters that stay one letter in lower case and when composed; marks at the end of a word are a token apart.
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
STOP = re.compile(r"(?<=[a-zA-ZÀ-ÖØ-öø-ÿ])([.,;:!?#$%&*]+)(?=[ \n])")
# The character that stands for each byte: itself where it is printed, else the next free one from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTER = {b: b if b in _PRINTED else 256 + k for k, b in zip(range(256), sorted(range(256), key=lambda b: (b in _PRINTED, b)), strict=True)}


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, encoded word by word.

    The tokenizer drops white space and never joins across it, so each word between white space is encoded
    once and remembered; the memory is dropped as a whole when it is full.  A new word of letters alone is one word to the
    tokenizer too and goes to its merges at once; others go many at a time, with a sign between them that no word holds.
    """

    def __init__(self, tokenizer_file: str, kept: int | None = None):
        self.kept = kept or WORDS_KEPT
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.between = np.frombuffer(self._alone(BETWEEN), "<u4")
        self.known: dict[str, bytes] = {}
        self.merges = self.tokenizer.model.tokenize

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of all words."""
        found, merges, letters, pack = {}, self.merges, LETTERS.fullmatch, struct.pack
        plain = []
        for w in words:
            if letters(w):
                shown = w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(BYTE_CHARACTER)
                tokens = merges(shown)
                found[w] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            elif BETWEEN in w:
                found[w] = self._alone(w)
            else:
                plain.append(w)
        size = len(self.between)
        for at in range(0, len(plain), 1024):
            some = plain[at : at + 1024]
            joined = f" {BETWEEN} ".join([*some, ""])
            (encoded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            hit = np.lib.stride_tricks.sliding_window_view(ids, size) == self.between
            ends = np.flatnonzero(hit.all(axis=1))
            data, start = ids.tobytes(), 0
            for w, e in zip(some, ends.tolist(), strict=True):
                found[w] = data[4 * start : 4 * e]
                start = e + size
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        words = [_split(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.kept:
            self.known = {}
            new = set().union(*words)
        found = self.learn(list(new))
        known = self.known
        known.update(found)
        for w in words:
            yield b"".join([known[x] for x in w])
        for w in found:
            if len(w) > LONGEST_WORD_KEPT:
                del known[w]


def _split(text: str | None) -> list[str]:
    """Words between white space; the separators U+001C to U+001F, white space to Python alone, stay in words.

    Marks between a letter and white space are a token of their own, so they are split off; plain ASCII is
    lower-cased as the tokenizer does.  Both leave fewer different words to remember.
    """
    if not text:
        return []
    if text.isascii() and "<|" not in text:
        text = text.lower()
    text = STOP.sub(r" \1", text)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split(r"[ \t\n\r\f\v]+", text) if w]
    return text.split()


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def cut(
    docs: DataFrame, doc_id: str, text: str, tokenizer_file: str, size: int, end_id: int, words_kept: int | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece.

    ``words_kept`` bounds the words a task remembers: fewer take less memory and more time, the ids are the same.  A task
    with such a bound leaves nothing to the next task of its worker, neither words nor tokenizer.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_file) if words_kept is None else WordIds(tokenizer_file, words_kept)
        for b in batches:
            rows = []
            for at in range(0, len(b), TEXTS_AT_A_TIME):
                part = b.iloc[at : at + TEXTS_AT_A_TIME]
                for i, ids in zip(part["doc_id"], words.encode(part["text"].tolist()), strict=True):
                    ids += end
                    rows += [
                        (i, p, x // 4, min(len(ids) - x, 4 * size) // 4, zlib.crc32(ids[x : x + 4 * size]))
                        for p, x in enumerate(range(0, len(ids), 4 * size))
                    ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_values(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each room the greatest sum of weights and the last length used.

    ``weights[l]`` is what a piece of length l is worth (none: 0); pieces may repeat.
    """
    size = len(weights) - 1
    value, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    turned = weights[::-1]  # turned[size - l] = weights[l]
    for room in range(1, size + 1):
        sums = value[:room] + turned[size - room : size]  # room - l left, then a piece of length l
        at = int(sums.argmax())
        if sums[at] > value[room - 1]:
            value[room], last[room] = sums[at], room - at
        else:
            value[room], last[room] = value[room - 1], 0
    return value, last


def fill(room: int, last: np.ndarray) -> dict[int, int]:
    """The best filling of ``room`` that the program found."""
    found: dict[int, int] = {}
    while room > 0:
        length = int(last[room])
        if length:
            found[length] = found.get(length, 0) + 1
        room -= length or 1
    return found


def fractions(counts: np.ndarray) -> dict[Filling, float]:
    """How often to use each filling: the linear program by multiplicative weights."""
    size = len(counts) - 1
    lengths = np.flatnonzero(counts)
    cover = np.zeros(size + 1)
    uses: dict[Filling, float] = {}
    for _ in range(ROUNDS):
        weights = np.zeros(size + 1)
        low = cover[lengths].min()
        weights[lengths] = lengths * np.exp(-SHARPNESS * (cover[lengths] - low))
        value, last = best_values(weights)
        order = lengths[np.argsort(cover[lengths], kind="stable")]
        for length in order[:FILLINGS_PER_ROUND].tolist():
            found = fill(size - length, last)
            found[length] = found.get(length, 0) + 1
            step = STEP * min(counts[n] / k for n, k in found.items())
            key = tuple(sorted(found.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + step
            for n, k in found.items():
                cover[n] += k * step / counts[n]
    mean = float((cover * counts * np.arange(size + 1)).sum() / (counts * np.arange(size + 1)).sum())
    return {k: v / mean for k, v in uses.items()}


def best_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: fillings and how often, many equal pieces at a time."""
    size = len(counts) - 1
    open_: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = next((c for c in range(length, size) if open_.get(c)), None)
            if room is None:
                per = size // length
                whole, rest = divmod(left, per)
                for k, n in ((per, whole), (rest, 1)):
                    if k and n:
                        open_.setdefault(size - k * length, []).append(([length] * k, n))
                left = 0
                continue
            items, n = open_[room].pop()
            took = min(n, left)
            if took < n:
                open_[room].append((items, n - took))
            open_.setdefault(room - length, []).append(([*items, length], took))
            left -= took
    return [x for group in open_.values() for x in group]


def plan(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Fillings and whole numbers of uses that take every piece of the histogram once.

    The rounded program with its rest packed best-fit, or best fit alone where that takes fewer sequences.
    """
    left = counts.astype(np.int64).copy()
    if not left.any():
        return []

    def filled(groups: list[tuple[list[int], int]]) -> list[tuple[Filling, int]]:
        return [(tuple((m, items.count(m)) for m in sorted(set(items), reverse=True)), n) for items, n in groups]

    alone = filled(best_fit(left))
    out: list[tuple[Filling, int]] = []
    for filling, use in sorted(fractions(left).items(), key=lambda x: (-x[1], x[0])):
        n = min([int(use), *(int(left[m]) // k for m, k in filling)])
        if n:
            out.append((filling, n))
            for m, k in filling:
                left[m] -= k * n
    out += filled(best_fit(left))
    return min(out, alone, key=lambda way: sum(n for _, n in way))


def _places(fillings: list[tuple[Filling, int]]) -> pd.DataFrame:
    """For each length and run of numbers: first sequence, uses, and the offset of the first copy."""
    rows, taken, sequence = [], {}, 0
    for filling, n in fillings:
        offset = 0
        for length, k in filling:
            rows.append((length, taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + k * n
            offset += k * length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "uses", "offset"]).sort_values(
        ["length", "first"], ignore_index=True
    )


def packed(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` (with a column ``length`` of at most ``size``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(size + 1, np.int64)
    counts[histogram["length"].astype(int)] = histogram["n"]
    places = spark.sparkContext.broadcast(_places(plan(counts)))

    salts = max(SALTS, -(-int(counts.sum()) // ROWS_PER_SALT))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)))
    before = (
        salted.groupBy("length", "__salt")
        .agg(F.count("*").alias("n"))
        .withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*pieces.columns)) - 1
    numbered = salted.withColumn("__within", within).join(before, ["length", "__salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = places.value
        base = int(p["first"].max()) + 1 if len(p) else 1
        keys = p["length"].to_numpy() * base + p["first"].to_numpy()
        for length, number in batches:
            at = np.searchsorted(keys, length.to_numpy() * base + np.minimum(number, base - 1), side="right") - 1
            row = p.iloc[at].reset_index(drop=True)
            inside = number.to_numpy() - row["first"]
            yield pd.DataFrame(
                {
                    "sequence_id": row["sequence"] + inside % row["uses"],
                    "offset": row["offset"] + inside // row["uses"] * row["length"],
                }
            )

    placed = numbered.withColumn("__place", place("length", F.col("__before") + F.col("__within")))
    return placed.select(*pieces.columns, "__place.*")


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE,
    end_id: int = 0,
    words_kept: int | None = None,
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return packed(landed(cut(docs, doc_id, text, tokenizer_file, size, end_id, words_kept), "pieces"), size)
