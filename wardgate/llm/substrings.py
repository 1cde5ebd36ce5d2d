"""Exact repeated substrings by per-shard suffix arrays.

Every window of ``MIN_BYTES`` bytes belongs to its anchor, the smallest hash of the 32-byte strings in it, so equal windows
have equal anchors wherever they are.  A text falls into runs of neighbouring windows with one anchor, about one
run per 185 bytes; a run with the bytes of its windows is a context.  An anchor seen once has no repeats: anchors are counted by
themselves, and only the runs of repeated ones move on.  Their contexts are counted by anchor and digest:
all windows of a context that occurs twice are repeats.  What is left are the distinct contexts of anchors that occur with several surroundings, such as the ends of shared passages and the
places where near copies differ.  Their bytes are fetched and dealt to shards by anchor.

Each shard sorts its suffixes (Larsson-Sadakane refinement: groups that agree so far are sorted by the rank
of what follows, doubling the depth), and Kasai's recursion gives the common prefixes of neighbours; windows with
a neighbour of ``MIN_BYTES`` common bytes are repeats.  An anchor with more contexts than a shard holds is split
over shards; these hand on their distinct windows as sorted digests, one value for each range of digests, of which there are as
many as the bytes of the anchor ask for, and each range merges the sorted runs of all shards by binary search.

Digests have 128 bits.  Null and empty texts, and texts shorter than a window, have nothing to remove.  Repeated rows repeat each other.
Long texts are taken in slices for the anchors; a text is held whole by the task that cuts it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import dropped, landed

MIN_BYTES = 400
GRAM = 32
SLICE = 1 << 21
SHARD_BYTES = 1 << 20
TEXTS_AT_A_TIME = 64
RANGE_BYTES = 64 << 20  # of handed digests that meet in one range, about
HANDED_BYTES = 8  # per byte of contexts, about: digest, context and place of each distinct window
KASAI_BLOCKS = 4096

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position on."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = word[:n] * _M[0]
    for i in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += word[8 * i : 8 * i + n]
        h *= _M[i]
    h ^= h >> np.uint64(32)
    h *= _M[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: minima of blocks up to and from each place."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    table = padded.reshape(blocks, width)
    up = np.minimum.accumulate(table, axis=1).ravel()
    down = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def runs(data: bytes, min_bytes: int = MIN_BYTES) -> list[tuple[int, int, int, int]]:
    """(start, windows, anchor, places) of the runs of windows with one anchor.

    ``places`` counts the positions of the anchor's string in the slice; it stands at the first run of an anchor.
    """
    out = []
    width = min_bytes - GRAM + 1
    for base in range(0, len(data) - min_bytes + 1, SLICE):
        part = data[base : base + SLICE + min_bytes - 1]
        h = gram_hashes(part)
        low = sliding_min(h, width)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        size = np.diff(np.append(first, len(low)))
        anchors, at = np.unique(low[first], return_index=True)
        small = h[h <= anchors[-1]]
        found = np.searchsorted(anchors, small)
        counts = np.bincount(found[anchors[found] == small], minlength=len(anchors))
        places = np.zeros(len(first), np.int64)
        places[at] = counts
        signed = low[first].view(np.int64)
        out += zip((first + base).tolist(), size.tolist(), signed.tolist(), places.tolist(), strict=True)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order.  Kasai's recursion needs the whole order, so groups are refined until none is left."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    first = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 8
    last = np.append(new[1:], True)
    slots = np.flatnonzero(~(new & last))
    while len(slots):
        there = order[slots]
        after = there + length
        # a suffix that ends here comes first, the shorter the earlier
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1 + length, n - there)
        key = rank[there] * (n + 1 + length) + follow
        by = np.argsort(key, kind="stable")
        there, key = there[by], key[by]
        order[slots] = there
        new = np.append(True, key[1:] != key[:-1])
        rank[there] = np.maximum.accumulate(np.where(new, slots, 0))
        last = np.append(new[1:], True)
        slots = slots[~(new & last)]
        length *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes each suffix in ``order`` shares with the one before it, up to ``most``.

    Kasai's recursion: going one byte on in the text loses at most one shared byte.  The text is cut into blocks
    that go on together, each with its own recursion.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = -(-n // min(n, KASAI_BLOCKS))
    heads = np.arange(0, n, step)
    shared = np.zeros(len(heads), np.int64)
    by_place = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    word = np.ndarray((n,), "<u8", padded, strides=(1,))
    for t in range(step):
        here = heads + t
        live = np.flatnonzero(here < n)
        live = live[before[here[live]] >= 0]
        dead = np.ones(len(heads), bool)
        dead[live] = False
        shared[dead] = 0
        i, j = here[live], before[here[live]]
        got = np.maximum(shared[live] - 1, 0)
        limit = np.minimum(most, n - np.maximum(i, j))
        more = np.flatnonzero(got < limit)
        while len(more):
            differ = word[i[more] + got[more]] ^ word[j[more] + got[more]]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(lowest, np.uint64(1)).astype(float)) // 8).astype(np.int64))
            got[more] = np.minimum(got[more] + same, limit[more])
            more = more[(same == 8) & (got[more] < limit[more])]
        shared[live] = got
        by_place[i] = got
    out = by_place[order]
    out[:1] = 0
    return out


def window_digests(data: np.ndarray, starts: np.ndarray, min_bytes: int) -> np.ndarray:
    """128 bits of each window as two columns, by joining digests of halves."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    word = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    out = []
    for a, b in ((0, 1), (2, 3)):
        h, length = word * _M[a], 8
        while 2 * length <= min_bytes:
            left, right = h[: len(h) - length], h[length:]
            h = (left ^ (left >> np.uint64(31))) * _M[b] + (right ^ (right >> np.uint64(29))) * _M[4]
            length *= 2
        rest = h[starts + min_bytes - length]
        mixed = (h[starts] ^ (h[starts] >> np.uint64(30))) * _M[b] + (rest ^ (rest >> np.uint64(33))) * _M[a]
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return np.stack(out, axis=1)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def shard_repeats(contexts: list[bytes], min_bytes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the repeated windows of each context, and the shard's text, window starts and their sorted order."""
    sizes = np.array([len(c) - min_bytes + 1 for c in contexts])
    firsts = np.cumsum([0] + [len(c) for c in contexts])[:-1]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(data)
    shared = common_prefixes(data, order, min_bytes)
    is_start = np.zeros(len(data), bool)
    starts = np.concatenate([np.arange(f, f + s) for f, s in zip(firsts, sizes, strict=True)])
    is_start[starts] = True
    at = np.flatnonzero(is_start[order])
    # between two windows stand other suffixes: the least of the common prefixes on the way counts
    with_before = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
    with_before[:1] = 0
    ordered = order[at]
    same = with_before >= min_bytes
    repeated = np.zeros(len(data), bool)
    repeated[ordered[same]] = True
    repeated[ordered[np.append(same[1:], False)]] = True
    fresh = ordered[~same]  # one of each distinct window
    flags = [repeated[f : f + s] for f, s in zip(firsts, sizes, strict=True)]
    return flags, data, fresh, firsts


def merged_repeats(shards: list[np.ndarray]) -> list[np.ndarray]:
    """For the sorted digests of each shard, which of them another shard has too: binary search in the merger."""
    firsts = np.cumsum([0, *map(len, shards)])
    found = np.zeros(firsts[-1], bool)
    merged, place = shards[0], np.arange(len(shards[0]))
    for k, s in enumerate(shards[1:], 1):
        at = np.searchsorted(merged, s)
        inside = np.minimum(at, max(0, len(merged) - 1))
        hit = (merged[inside] == s) if len(merged) else np.zeros(len(s), bool)
        found[firsts[k] + np.flatnonzero(hit)] = True
        found[place[inside[hit]]] = True
        merged = np.insert(merged, at[~hit], s[~hit])
        place = np.insert(place, at[~hit], firsts[k] + np.flatnonzero(~hit))
    return [found[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]


def handed_on(digests: np.ndarray, owner: np.ndarray, at: np.ndarray, n_ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(range, sorted digests, their contexts, their places there) of the distinct windows of a shard."""
    by = np.lexsort((digests[:, 1], digests[:, 0]))
    digests, owner, at = digests[by], owner[by].astype("<u4"), at[by].astype("<u4")
    cell = ((digests[:, 0] >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    edges = np.searchsorted(cell, np.arange(n_ranges + 1, dtype=np.uint64))
    for r, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
        if y > x:
            yield r, digests[x:y].astype(">u8").tobytes(), owner[x:y].tobytes(), at[x:y].tobytes()


def text_key(doc_id: str, text: str) -> Column:
    """16 bytes for a row: rows with one id and one text share it, and have the same result."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))


def repeated_spans(docs: DataFrame, doc_id: str, text: str, min_bytes: int = MIN_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans array<struct<at, n>>): the runs of repeated windows of each row of ``docs`` that has some; landed."""
    keyed = docs.select(text_key(doc_id, text).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "s", "n", "anchor", "digest", "places"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_A_TIME):
                part, rows = b.slice(at, TEXTS_AT_A_TIME), []
                for key, data in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
                    rows += [
                        (key, s, n, anchor, xxhash.xxh3_128_digest(data[s : s + n + min_bytes - 1]), places)
                        for s, n, anchor, places in runs(data, min_bytes)
                    ]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    data = keyed.where(F.octet_length("text") >= min_bytes).withColumn("text", F.col("text").cast("binary"))
    windows = landed(
        data.mapInArrow(cut, "key binary, s long, n long, anchor long, digest binary, places long"),
        "runs",
    )
    counts = windows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("places").alias("p"))
    seen = landed(counts.where("n > 1 OR p > 1").select("anchor"), "anchors")  # landed, so that a hot one's runs can be split
    every, windows = windows, landed(windows.join(seen, "anchor", "left_semi"), "repeated-runs")
    dropped(every, seen)
    contexts = landed(
        windows.groupBy("anchor", "digest").agg(
            F.count("*").alias("copies"), F.sum("places").alias("places"), F.min(F.struct("key", "s", "n")).alias("of")
        ),
        "all-contexts",
    )
    anchors = contexts.groupBy("anchor").agg(
        F.count("*").alias("kinds"),
        F.sum("places").alias("all_places"),
        F.sum(F.col("of.n") + (min_bytes - 1)).alias("bytes"),
    )
    open_ = (F.col("kinds") > 1) | ((F.col("all_places") > 1) & (F.col("copies") == 1))
    sorted_out = landed(
        contexts.join(anchors, "anchor").where((F.col("copies") > 1) | open_).select(
            "anchor", "digest", "copies", "of.*", "bytes", open_.alias("open")
        ),
        "contexts",
    )
    dropped(contexts)
    whole = sorted_out.where("copies > 1").select(
        "anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n"))).alias("ranges")
    )
    opened = sorted_out.where("open")
    total = opened.agg(F.sum(F.col("n") + (min_bytes - 1))).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_bytes))

    wanted = opened.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "s", "n", "bytes", "copies")).alias("c"))
    parts = data.join(wanted.hint("shuffle_hash"), "key").select("key", "text", "c")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["anchor", "digest", "bytes", "copies", "context"], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_A_TIME):
                part, rows = b.slice(at, TEXTS_AT_A_TIME), []
                for t, cs in zip(part["text"].to_pylist(), part["c"].to_pylist(), strict=True):
                    rows += [(c["anchor"], c["digest"], c["bytes"], c["copies"], t[c["s"] : c["s"] + c["n"] + min_bytes - 1]) for c in cs]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # An anchor of more bytes than a shard is split by digest over shards of its own.
    pieces = F.ceil(F.col("bytes") / F.lit(shard_bytes)).cast("long")
    split = F.col("bytes") > shard_bytes
    dealt = (
        parts.mapInArrow(fetch, "anchor long, digest binary, bytes long, copies long, context binary")
        .dropDuplicates(["anchor", "digest"])  # rows of one key bring the same contexts
        .withColumn("split", split)
        .withColumn(
            "shard",
            F.when(split, F.concat_ws(":", F.col("anchor"), F.pmod(F.xxhash64("digest"), pieces))).otherwise(
                F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("string")
            ),
        )
    )

    def sort(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.reset_index(drop=True)
        flags, data, fresh, firsts = shard_repeats(shard["context"].tolist(), min_bytes)
        rows = [
            (a, d, [{"at": x, "n": n} for x, n in _ranges(f)], None, None, None, None, None)
            for a, d, copies, f in zip(shard["anchor"], shard["digest"], shard["copies"], flags, strict=True)
            if copies == 1 and f.any()
        ]
        if shard["split"].iloc[0]:  # distinct windows for the other shards of the anchor
            owner = np.searchsorted(firsts, fresh, side="right") - 1
            n_ranges = max(1, -(-int(shard["bytes"].iloc[0]) * HANDED_BYTES // RANGE_BYTES))
            names = b"".join(shard["digest"])
            anchor = shard["anchor"].iloc[0]
            for r, *parts in handed_on(window_digests(data, fresh, min_bytes), owner, fresh - firsts[owner], n_ranges):
                rows.append((anchor, None, None, r, *parts, names))
        return pd.DataFrame(rows, columns=["anchor", "digest", "ranges", "range", "windows", "owners", "places", "names"])

    schema = (
        "anchor long, digest binary, ranges array<struct<at: long, n: long>>, range long, windows binary, owners binary, places binary, names binary"
    )
    local = landed(dealt.groupBy("shard").applyInPandas(sort, schema), "shard-repeats")

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        """The repeated windows of each context, as runs of places."""
        rows = []
        shards = [np.frombuffer(w, "S16") for w in parts["windows"]]
        for hit, owners, places, names in zip(merged_repeats(shards), parts["owners"], parts["places"], parts["names"], strict=True):
            owner, at = np.frombuffer(owners, "<u4")[hit].astype(np.int64), np.frombuffer(places, "<u4")[hit].astype(np.int64)
            by = np.lexsort((at, owner))
            owner, at = owner[by], at[by]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
            size = np.diff(np.append(new, len(at)))
            found: dict[int, list] = {}
            for o, x, n in zip(owner[new].tolist(), at[new].tolist(), size.tolist(), strict=True):
                found.setdefault(o, []).append({"at": x, "n": n})
            rows += [(parts["anchor"].iloc[0], names[16 * o : 16 * o + 16], r) for o, r in found.items()]
        return pd.DataFrame(rows, columns=["anchor", "digest", "ranges"])

    across = (
        local.where("range IS NOT NULL")
        .groupBy("anchor", "range")
        .applyInPandas(merge, "anchor long, digest binary, ranges array<struct<at: long, n: long>>")
        .groupBy("anchor", "digest")
        .agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    )
    flagged = whole.union(local.where("range IS NULL").select("anchor", "digest", "ranges")).union(across)
    hits = windows.join(flagged, ["anchor", "digest"]).select(
        "key", F.transform("ranges", lambda r: F.struct((F.col("s") + r["at"]).alias("at"), r["n"].alias("n"))).alias("r")
    )
    spans = landed(hits.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("spans")), "spans")
    dropped(windows, sorted_out, local)
    return spans


def covered(spans, min_bytes: int) -> list[tuple[int, int]]:
    """Maximal (start, end) byte runs that the windows of ``spans`` cover."""
    out: list[list[int]] = []
    for at, n in sorted((s["at"], s["n"]) for s in spans):
        end = at + n - 1 + min_bytes
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``cut``, an array of (start, end) byte runs to remove, null where there are none."""
    spans = repeated_spans(docs, doc_id, text, min_bytes, shard_bytes)

    @F.pandas_udf("array<array<long>>")
    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[list(r) for r in covered(s, min_bytes)] for s in b], dtype=object)

    cuts = landed(spans.select(F.col("key").alias("__key"), merged("spans").alias("cut")), "cuts")
    dropped(spans)
    columns = [c for c in docs.columns if c != "cut"]
    marked = docs.select(*columns, text_key(doc_id, text).alias("__key"))
    return marked.join(cuts.hint("shuffle_hash"), "__key", "left").select(*columns, "cut")


def kept_bytes(data: bytes, cuts) -> bytes:
    at, out = 0, []
    for a, b in cuts if cuts is not None else ():
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def summed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, cuts in batches:
            rows = []
            for t, c in zip(texts, cuts, strict=True):
                data = (t or "").encode()
                kept = kept_bytes(data, c)
                rows.append((len(data), len(data) - len(kept), 0 if c is None else len(c), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return removed(narrow, "doc_id", "text", **how).select("doc_id", summed("text", "cut").alias("d")).select("doc_id", "d.*")
