"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards: a cell with more rows than a shard holds takes
pivots, its rows of smallest hash that are not alike, and each row goes to the cells of its ``OVERLAP`` nearest
pivots.  A cell that stays too large, such as one tight cluster, is cut into blocks, and every two blocks form a shard.

In a shard each vector's candidates, its nearest ones and random distant ones, are pruned robustly: a candidate is
dropped where a kept one is closer to it by the factor ``ALPHA``.  Pruned lists and their reverse form a flat
graph; the lists of all shards are united, and every shard searches its part of the united graph for each of its vectors: a
greedy beam from the medoid and the vector's own node, then an expansion over all nodes within a wider range.
What is found is verified in double precision.  A pair found in several shards counts in the first shard both
share, so tasks hand on counts and local components, not pairs.

Recall is audited: vectors picked by hash are compared with all rows of their label, in chunks of ``CHUNK_AUDITED``, until
``AUDITED`` vectors with at most ``FEW`` links and as many with more were seen, or all vectors, or ``AUDIT_CHUNKS`` chunks.  Recall
is the mean share of a vector's links that was found, apart for those with few links and those with more, so that a
tight cluster does not hide scattered pairs.  The build is repeated with more overlap and a wider beam while one of
the two is under ``ENOUGH``; if it is so after ``BUILDS`` builds, every two blocks of a label are compared exactly.

Equal vectors of a label are one node with a number of copies.  Vectors that are null, empty, zero, without label
or with null or non-finite components link with nothing; labels with vectors of several lengths are several labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgate.llm.common import landed
from wardgate.llm.components import components

SHARD = 512  # rows a shard holds
PIVOTS = 1024  # of a cell, at most
OVERLAP = 4
LEVELS = 2
ROWS_PER_SALT = 50_000
NEAREST, DISTANT = 40, 24  # candidates of a vector
KEPT_NEAR, KEPT_FAR = 16, 8  # after pruning
ALPHA = 1.2
BEAM = 32
WIDER = 0.08  # below the threshold, nodes that the search still goes through
AUDITED = 200  # vectors with links, of few and of many
FEW = 8  # links
CHUNK_AUDITED, AUDIT_CHUNKS = 4096, 16
BUILDS = 3
ENOUGH = 0.97
CHUNK = 256


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _pruned(x: np.ndarray, of: np.ndarray, cand: np.ndarray, near: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Robust pruning of the candidates of the rows ``of``; ``near`` holds their similarities, greatest first."""
    alive = (cand >= 0) & (cand != of[:, None])
    rows = np.arange(len(of))
    them = x[np.maximum(cand, 0)]
    owners, others = [], []
    for _ in range(kept):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        best = cand[rows, pick]
        owners.append(of[some])
        others.append(best[some])
        between = np.einsum("nd,ncd->nc", x[np.maximum(best, 0)], them)
        alive &= ~(ALPHA * (1 - between) <= 1 - near)
        alive[rows, pick] = False
    return np.concatenate(owners or [of[:0]]), np.concatenate(others or [of[:0]])


def graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges of the pruned graph over the unit vectors of a shard, with their reverse."""
    n = len(x)
    f = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    owners, others = [], []
    for at in range(0, n, CHUNK):
        of = np.arange(at, min(n, at + CHUNK))
        s = f[of] @ f.T
        s[of - at, of] = -2
        c = min(NEAREST, n - 1)
        if c < 1:
            break
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        far = rng.integers(0, n, (len(of), DISTANT))
        for some, kept in ((cand, KEPT_NEAR), (far, KEPT_FAR)):
            near = np.take_along_axis(s, some, axis=1)
            order = np.argsort(-near, axis=1, kind="stable")
            a, b = _pruned(f, of, np.take_along_axis(some, order, 1), np.take_along_axis(near, order, 1), kept)
            owners.append(a)
            others.append(b)
    a, b = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (owners, others))
    return np.concatenate([a, b]), np.concatenate([b, a])


def adjacency(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of neighbours, filled up with -1."""
    code = np.unique(a * n + b)
    a, b = code // n, code % n
    first = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - first[a]
    out = np.full((n, int(place.max()) + 1 if len(a) else 1), -1, np.int64)
    out[a, place] = b
    return out


def found_links(x: np.ndarray, adj: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Codes i * n + j (i < j) of the pairs with a cosine of at least ``threshold`` that the search finds."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    wide = threshold - WIDER
    codes = []
    for at in range(0, n, CHUNK):
        of = np.arange(at, min(n, at + CHUNK))
        q = len(of)
        seen = np.zeros((q, n), bool)
        score = np.full((q, n), -2.0)
        done = np.zeros((q, n), bool)
        rows = np.concatenate([np.arange(q), np.arange(q)])
        nodes = np.concatenate([of, np.full(q, medoid)])

        def look(rows, nodes, of=of, seen=seen, score=score):
            fresh = ~seen[rows, nodes]
            code = np.unique(rows[fresh] * n + nodes[fresh])
            rows, nodes = code // n, code % n
            seen[rows, nodes] = True
            score[rows, nodes] = np.einsum("ij,ij->i", x[of[rows]], x[nodes])

        def expand(rows, nodes, done=done, look=look):
            done[rows, nodes] = True
            near = adj[nodes]
            ok = near >= 0
            look(np.repeat(rows, ok.sum(axis=1)), near[ok])

        look(rows, nodes)
        width = min(beam, n)
        while True:  # greedy: expand what of the beam is not expanded
            top = np.argpartition(-score, width - 1, axis=1)[:, :width]
            r = np.repeat(np.arange(q), width)
            t = top.ravel()
            open_ = (score[r, t] > -2) & ~done[r, t]
            if not open_.any():
                break
            r, t = r[open_], t[open_]
            best = np.lexsort((-score[r, t], r))  # the four best of each row
            r, t = r[best], t[best]
            turn = np.arange(len(r)) - np.searchsorted(r, r)
            expand(r[turn < 4], t[turn < 4])
        while True:  # range: expand everything near enough
            r, t = np.nonzero((score >= wide) & ~done)
            if not len(r):
                break
            expand(r, t)
        r, t = np.nonzero(score >= threshold)
        i, j = of[r], t
        codes.append(np.unique(np.minimum(i, j) * n + np.maximum(i, j)))
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    return code[code // n != code % n]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    return low


def usable(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, grp, x) of the vectors that can link."""
    x = F.transform(F.col(vector), lambda e: e.cast("double") + F.lit(0.0))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and size(x) > 0").where(finite)
    return rows.where(F.exists("x", lambda e: e != 0)).select(
        "vec_id", F.concat_ws("/", F.size("x"), "label").alias("grp"), "x"
    )


def _apart(p: np.ndarray, most: float) -> np.ndarray:
    """The unit vectors of which no earlier kept one is more similar than ``most``."""
    s, kept = p @ p.T, []
    for i in range(len(p)):
        if not kept or s[i, kept].max() <= most:
            kept.append(i)
    return p[kept]


def _cells(nodes: DataFrame, threshold: float, overlap: int, shard: int, levels: int = LEVELS) -> DataFrame:
    """(id, copies, x, shard): each node once for every shard it is in.  Without levels every two nodes share a shard."""
    rows = nodes.withColumn("cell", F.col("grp")).drop("grp")
    for level in range(levels):
        sizes = rows.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > shard)
        sizes = landed(sizes, "cell-sizes")
        if sizes.isEmpty():
            break
        marked = landed(rows.join(sizes, "cell", "left"), "cells")
        small, large = marked.where("rows is null").drop("rows"), marked.where("rows is not null")
        salts = F.ceil(F.col("rows") / ROWS_PER_SALT).cast("int")
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("rows") * overlap * 2 / shard).cast("int"))
        by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(level)), "id")
        pivots = (
            large.select("cell", "rows", "x", F.row_number().over(by_hash).alias("pivot"))
            .where(F.col("pivot") <= PIVOTS)
            .where(F.col("pivot") <= wanted)
            .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        )

        def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"id": [], "copies": [], "x": [], "cell": []})
            right = right.sort_values("pivot")
            # twice the angle of a link apart, so that a tight cluster is not split over pivots of its own
            p = _apart(_unit(_matrix(right["x"])), 2 * threshold**2 - 1)
            parts = []
            for at in range(0, len(left), 4096):
                part = left.iloc[at : at + 4096]
                k = min(overlap, len(p))
                near = np.argpartition(-(_unit(_matrix(part["x"])) @ p.T), k - 1, axis=1)[:, :k]
                again = np.repeat(np.arange(len(part)), k)
                out = part.iloc[again][["id", "copies", "x"]].reset_index(drop=True)
                out["cell"] = pd.Series([f"{key[0]}.{j}" for j in near.ravel()], dtype=object)
                parts.append(out)
            return pd.concat(parts)

        salted = large.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
        split = salted.groupBy("cell", "salt").cogroup(pivots.select("cell", "salt", "pivot", F.col("x")).groupBy("cell", "salt"))
        split = split.applyInPandas(assign, "id long, copies long, x array<double>, cell string")
        rows = landed(small.select("id", "copies", "x", "cell").union(split), "split")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("rows"))
    blocks = F.when(F.col("rows") <= shard, 1).otherwise(F.ceil(F.col("rows") * 2 / shard)).cast("int")
    marked = rows.join(sizes, "cell").withColumn("blocks", blocks)
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.concat_ws(":", F.col("cell"), F.least(b, mine), F.greatest(b, mine)),
    )
    return marked.withColumn("shard", F.explode(others)).select("id", "copies", "x", "shard")


def exact_links(x: np.ndarray, threshold: float) -> np.ndarray:
    """Codes i * n + j (i < j) of all pairs with a cosine of at least ``threshold``."""
    n = len(x)
    codes = [np.zeros(0, np.int64)]
    for at in range(0, n, CHUNK):
        i, j = np.nonzero(x[at : at + CHUNK] @ x.T >= threshold)
        codes.append((i + at) * n + j)
    code = np.concatenate(codes)
    return code[code // n < code % n] if n else code


def _search(nodes: DataFrame, threshold: float, overlap: int, beam: int, shard: int, exact: bool = False) -> DataFrame:
    """(id, links, low): links of each node in a shard, and the smallest id of its component there."""
    rows = landed(_cells(nodes, threshold, overlap, shard, 0 if exact else LEVELS), "shards")
    shards = rows.groupBy("id").agg(F.sort_array(F.collect_set("shard")).alias("shards"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id"].to_numpy(np.int64)
        a, b = graph(_unit(_matrix(part["x"])))
        code = np.unique(a * len(ids) + b)
        a, b = code // len(ids), code % len(ids)
        owner, first = np.unique(a, return_index=True)
        return pd.DataFrame({"id": ids[owner], "near": pd.Series(np.split(ids[b], first[1:]) if len(a) else [], dtype=object)})

    lists = rows.groupBy("shard").applyInPandas(build, "id long, near array<long>")
    if exact:
        lists = lists.limit(0)
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    full = landed(rows.join(shards, "id").join(united, "id", "left"), "united")

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        ids, copies, n = part["id"].to_numpy(np.int64), part["copies"].to_numpy(np.int64), len(part)
        x = _unit(_matrix(part["x"]))
        near = [np.zeros(0, np.int64) if v is None else np.asarray(v, np.int64) for v in part["near"]]
        a = np.repeat(np.arange(n), [len(v) for v in near])
        b_ids = np.concatenate(near) if n else np.zeros(0, np.int64)
        b = np.minimum(np.searchsorted(ids, b_ids), n - 1)
        here = ids[b] == b_ids  # the part of the united graph in this shard
        code = exact_links(x, threshold) if exact else found_links(x, adjacency(n, a[here], b[here]), threshold, beam)
        i, j = code // n, code % n
        low = local_components(n, i, j)
        # a pair counts in the first shard both are in
        held = [list(s) for s in part["shards"]]
        several = np.array([len(s) > 1 for s in held])
        first = np.ones(len(i), bool)
        both = np.flatnonzero(several[i] & several[j])
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault(tuple(s), len(kinds)) for s in held])
        known = list(kinds)
        pair, back = np.unique(kind[i[both]] * len(known) + kind[j[both]], return_inverse=True)
        lowest = [min(set(known[p // len(known)]) & set(known[p % len(known)])) == key[0] for p in pair.tolist()]
        first[both] = np.array(lowest, bool)[back] if len(both) else first[both]
        i, j = i[first], j[first]
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "low": ids[low]})

    return landed(full.groupBy("shard").applyInPandas(search, "id long, links long, low long"), "links")


def audited(nodes: DataFrame, links: DataFrame, threshold: float, most: int = AUDITED) -> list[tuple[int, float]]:
    """(vectors seen, mean recall) of the linked vectors with few and with more links, compared with all rows of their label."""
    spark = nodes.sparkSession
    sums = landed(links.groupBy("id").agg(F.sum("links").alias("links")), "found")
    parts = max(1, -(-nodes.count() // CHUNK_AUDITED))
    part_of = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(parts))
    seen = []

    for chunk in range(min(parts, AUDIT_CHUNKS)):
        some = nodes.where(part_of == chunk).toPandas()
        if not len(some):
            continue
        held = spark.sparkContext.broadcast((some["id"].to_numpy(), some["grp"].to_numpy(), list(some["x"])))

        def compare(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, groups, vectors = held.value
            for b in batches:
                for g, part in b.groupby("grp"):
                    of = np.flatnonzero(groups == g)
                    rows = _unit(_matrix(part["x"])).T if len(of) else None
                    for at in range(0, len(of), CHUNK):
                        some = of[at : at + CHUNK]
                        q = _unit(np.array([np.asarray(vectors[i], float) for i in some]))
                        hit = (q @ rows >= threshold) & (ids[some][:, None] != part["id"].to_numpy()[None, :])
                        n = hit @ part["copies"].to_numpy()
                        yield pd.DataFrame({"id": ids[some][n > 0], "n": n[n > 0]})

        true = nodes.mapInPandas(compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        seen += true.join(sums, "id", "left").select("n", F.coalesce("links", F.lit(0)).alias("links")).collect()
        held.unpersist()
        few = sum(r.n <= FEW for r in seen)
        if few >= most and len(seen) - few >= most:
            break
    shares = [[min(r.links, r.n) / r.n for r in seen if (r.n <= FEW) == side] for side in (True, False)]
    return [(len(v), float(np.mean(v)) if v else 1.0) for v in shares]


def near_duplicates(
    table: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    shard: int = SHARD, overlap: int = OVERLAP,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table``."""
    rows = landed(usable(table, vec_id, vector, label), "usable")
    nodes = landed(
        rows.groupBy("grp", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "nodes"
    )
    beam = BEAM
    for _ in range(BUILDS):
        links = _search(nodes, threshold, overlap, beam, shard)
        if all(recall >= ENOUGH for _, recall in audited(nodes, links, threshold)):
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        links = _search(nodes, threshold, overlap, beam, shard, exact=True)
    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    together = components(links.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    of_node = (
        nodes.join(sums, "id", "left")
        .join(together.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "grp", "x",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    linked = rows.join(of_node, ["grp", "x"]).select("vec_id", "n_links", "component_id")
    # rows that cannot link stand for themselves
    alone = _without(table, vec_id, vector, label)
    out = linked.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _without(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Ids of the rows that ``usable`` leaves out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double") + F.lit(0.0))
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    none = F.forall("x", lambda e: e == 0)
    return rows.where(
        F.col("vec_id").isNull() | F.col("label").isNull() | F.col("x").isNull() | (F.size("x") == 0) | bad | none
    ).select("vec_id")
