"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that differ in at most two bits agree
in one segment, and differ in at most two bits in each other one.  A segment, filled up to 23 bits, is decoded
to the codeword of the perfect (23, 12) Golay code nearest to it and to each word one bit away: one codeword or
six.  Segments at most two bits apart share one, since they share a word one bit away from both.  So the keys
(segment, its exact bits, a codeword index of the next segment), at most 18 per fingerprint, bring together
every pair to link; the join verifies the distance.

Equal fingerprints are one node.  Keys with more than ``most`` fingerprints, as tight clusters make them, are not
paired: their fingerprints are linked through the words one bit away instead.  All fingerprints that share such a
word are at most two bits apart and each links to the smallest of them, so the components stay exact and the work
stays proportional to the number of fingerprints.

Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows fall together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed
from wardgate.llm.components import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MOST = 64
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit by bit the majority of the XXH64 of all word shingles."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    shifted = [tokens[i:] for i in range(min(words, len(tokens)))]
    shingles = map(b" ".join, zip(*shifted, strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in b], np.uint64).view(np.int64))

    return of(text)


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word divided by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def _corrections() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2,048 remainders."""
    bits = 1 << np.arange(23)
    one = np.concatenate([[0], bits])
    patterns = np.unique(one[:, None, None] | one[None, :, None] | one[None, None, :])
    table = np.zeros(2048, np.int64)
    table[_remainders(patterns)] = patterns
    return table


CORRECTIONS = _corrections()


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (words ^ CORRECTIONS[_remainders(words)]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: positions in ``prints`` and keys, repeats left out."""
    prints = prints.view(np.uint64)
    segments = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = np.concatenate([[0], 1 << np.arange(23)])
    at, out = [], []
    for s, exact in enumerate(segments):
        words = segments[(s + 1) % 3][:, None] ^ near[None, :]
        index = np.sort(codeword_indices(words), axis=1)
        first = np.concatenate([np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
        row, col = np.nonzero(first)
        at.append(row)
        out.append((s << 34) | (exact[row] << 12) | index[row, col])
    return np.concatenate(at), np.concatenate(out)


def _links(prints: DataFrame, most: int) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` for the exact components."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                at, key = keys(part)
                yield pd.DataFrame({"key": key, "fp": part[at]})

    table = prints.select("fp").mapInPandas(keyed, "key long, fp long")
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = landed(table.join(sizes, "key"), "golay-keys")
    light = shared.where(F.col("n") <= most)
    pairs = light.alias("l").join(
        light.alias("r"),
        F.expr("l.key = r.key and l.fp < r.fp and bit_count(l.fp ^ r.fp) <= 2"),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    tight = shared.where(F.col("n") > most).select("fp").distinct()
    near = tight.select(
        "fp",
        F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"),
    )
    lowest = near.groupBy("word").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    stars = near.join(lowest, "word").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).where("bit_count(a ^ b) <= 2")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most: int = MOST
) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable over links of two bits."""
    prints = landed(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")), "fingerprints"
    )
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(_links(distinct, most)).withColumnRenamed("node", "fp")
    owned = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = owned.groupBy("component").agg(F.min("low").alias("component_id"))
    of_print = landed(owned.join(lowest, "component").select("fp", "component_id"), "print-components")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
