"""Exact top-k search by inner product in three phases with a uniform threshold.

The dimensions are split into ``lists`` blocks. A candidate has one local score in each block's list, and its score
is their sum. Phase 1 gathers, for each query, the best ``k`` entries of every list; the exact scores of
those candidates give a cutoff: the k-th best of them, which is at most the k-th best of all. Phase 2 sends the cutoffs to
all tasks. A candidate whose score reaches the cutoff has at least cutoff / lists in some list, so the entries
from there on are sufficient. Phase 3 drops those candidates whose known entries, with the threshold for each unknown
one, stay under the cutoff, works out the missing local scores of the rest exactly, and ranks them.

Queries go out in waves of at most ``wave`` vectors. With more than one, a wave's result is written to the shared folder and
its broadcasts are destroyed before the next one's are made, so what is broadcast has a fixed bound whatever the number
of queries; candidates stay where they are read. The cutoffs are safe, and of what reaches them a batch hands on each query's
``k`` best by score and id, so equal vectors don't multiply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let_workers_import, shared_checkpoint
from .vectors import matrix_runs

ROWS = 2048
EXACT = 2.0**53


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows: exact in doubles where no sum can pass 2**53, else in Python integers."""
    if not a.size or not b.size or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return whole(a) @ whole(b).T


class Lists:
    """The local scores of one batch of candidates for the queries of a wave with as many dimensions."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, lists: int):
        bounds = np.linspace(0, queries.shape[1], min(lists, queries.shape[1]) + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.queries, self.vectors = queries, vectors

    def local(self, block: slice) -> np.ndarray:
        return products(self.queries[:, block], self.vectors[:, block])


def best_local(q_ids: np.ndarray, ids: np.ndarray, lists: Lists, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phase 1 in one batch: for each list, pairs of query and candidate rows that have its best entries."""
    own = q_ids[:, None] == ids[None, :]
    for block in lists.blocks:
        scores = lists.local(block)
        scores = np.where(own, -np.inf, scores.astype(np.float64))
        if scores.shape[1] > k:
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        else:
            top = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        rows = np.repeat(np.arange(len(q_ids)), top.shape[1])
        columns = np.ascontiguousarray(top).ravel()
        good = ~own[rows, columns]
        yield rows[good], columns[good], scores[rows[good], columns[good]]


def excess(score: int) -> str:
    """Text that orders scores beyond 64 bits, which a long column cannot tell apart; '1' for all others."""
    if -(2**63) <= score < 2**63:
        return "1"
    digits = f"{abs(score):x}"
    text = f"{len(digits):04x}{digits}"
    return "2" + text if score > 0 else "0" + "".join(f"{15 - int(c, 16):x}" for c in text)


def first_of_each(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` highest scores; ties go to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def sufficient(q_ids: np.ndarray, ids: np.ndarray, lists: Lists, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in one batch: rows of query and candidate, and exact scores, of all that reach the cutoff."""
    m = len(lists.blocks)
    with np.errstate(invalid="ignore"):
        threshold = np.where(np.abs(cutoff) < EXACT, cutoff / m, np.where(np.isfinite(cutoff), cutoff / m - np.abs(cutoff) * 1e-12, -np.inf))[:, None]
    known = np.zeros((len(q_ids), len(ids)))
    listed = np.zeros((len(q_ids), len(ids)), dtype=np.int8)
    for block in lists.blocks:
        scores = lists.local(block).astype(np.float64)
        high = scores >= threshold
        known += np.where(high, scores, 0)
        listed += high
    # An unknown entry is below the threshold; the slack covers the rounding of the threshold and of the sums.
    with np.errstate(invalid="ignore"):
        bound = known + np.where(listed < m, (m - listed) * threshold, 0)
    floor = np.where(np.isfinite(cutoff), cutoff - 1 - np.abs(cutoff) * 1e-12, -np.inf)[:, None]
    able = (listed > 0) & (bound >= floor) & (q_ids[:, None] != ids[None, :])
    rows, columns = np.nonzero(able)
    a, b = lists.queries[rows], lists.vectors[columns]
    if not len(rows) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        scores = np.einsum("ij,ij->i", a, b)
    else:
        scores = np.array([sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)], dtype=object)
    reach = np.array([s >= c for s, c in zip(scores, cutoff[rows], strict=True)], dtype=bool) if len(rows) else np.zeros(0, bool)
    return rows[reach], columns[reach], scores[reach]


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024.0,
    lists: int = 4,
    wave: int = 4096,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best candidates.

    Components become floor(scale * x); the score is the inner product of integers, ties go to the smaller id, and
    candidates are all rows but those with the query's own id; with fewer than ``k``, all are returned. Vectors that are
    null or empty, or hold a null or non-finite component, take no part, nor do rows with a null id; vectors
    of different lengths have no score. Repeated candidate rows each count; a query id that repeats counts once for each
    different vector. Scores beyond 64 bits rank by their exact values and are written as the nearest long. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")).where("id is not null and vector is not null")
    queries = df.where(is_query).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    queries = queries.where("id is not null and vector is not null").distinct()
    parts = max(1, math.ceil(2 * queries.count() / wave))
    while True:  # until no part is over the bound; only a repeated id could keep it there
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        most, ids = queries.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).agg(F.max("n"), F.max("ids")).first()
        if (most or 0) <= wave or ids == 1:
            break
        parts *= 2
    results = []
    for number in range(parts):
        chosen = queries.where(part == number).orderBy("id", "vector").toArrow()
        groups = [(ids, quantised(v, scale)) for ids, v in _by_length(chosen)]
        if groups:
            result, sent = _one_wave(spark, rows, groups, k, scale, lists)
            if parts > 1:
                result = shared_checkpoint(result)
                for broadcast in sent:
                    broadcast.destroy()
            results.append(result)
    schema = "query_id long, rank int, vec_id long, score long"
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _by_length(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = batch.column("id").to_numpy() if batch.num_rows else np.zeros(0, np.int64)
    if not batch.num_rows:
        return
    for rows, vectors in matrix_runs(batch.column("vector"), zeros=True):
        if len(rows):
            yield ids[rows], vectors


def _one_wave(spark, rows: DataFrame, groups: list[tuple[np.ndarray, np.ndarray]], k: int, scale: float, lists: int) -> tuple[DataFrame, list]:
    sent = spark.sparkContext.broadcast(groups)

    def batches_of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for ids, vectors in _by_length(part):
                    for group, (q_ids, q_vectors) in enumerate(sent.value):
                        if q_vectors.shape[1] == vectors.shape[1]:
                            for start in range(0, len(q_ids), 512):
                                stop = start + 512
                                yield group, start, q_ids[start:stop], ids, Lists(q_vectors[start:stop], quantised(vectors, scale), lists)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The task's best entries so far, by query group and list.
        best: dict[tuple[int, int, int], tuple] = {}
        for group, start, q_ids, ids, local in batches_of(batches):
            for number, (r, c, s) in enumerate(best_local(q_ids, ids, local, k)):
                exact = np.einsum("ij,ij->i", local.queries[r], local.vectors[c])
                new = (r, s, ids[c], exact)
                old = best.get((group, start, number))
                if old is not None:
                    new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                order = np.lexsort((new[2], -new[1], new[0]))
                row = new[0][order]
                first = np.searchsorted(row, row)
                kept = order[np.arange(len(row)) - first < k]
                best[group, start, number] = tuple(x[kept] for x in new)
        for (group, start, number), (r, s, ids, exact) in best.items():
            n = len(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, group, np.int64)), pa.array(r.astype(np.int64) + start), pa.array(np.full(n, number, np.int32)), pa.array(s), pa.array(ids), pa.array(exact)],
                names=["group", "query", "list", "local", "id", "exact"],
            )

    entries = rows.mapInArrow(gather, "group long, query long, list int, local double, id long, exact double")
    ranked = entries.withColumn("n", F.row_number().over(Window.partitionBy("group", "query", "list").orderBy(F.desc("local"), "id"))).where(F.col("n") <= k)
    # A candidate may head several lists; one entry of it counts.
    ranked = ranked.select("group", "query", "id", "exact").distinct()
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("group", "query").orderBy(F.desc("exact"), "id"))).where(F.col("n") == k)
    cutoffs = [np.full(len(ids), -np.inf) for ids, _ in groups]
    for row in ranked.select("group", "query", "exact").toLocalIterator():  # one row for each query of the wave
        cutoffs[row["group"]][row["query"]] = row["exact"] - (abs(row["exact"]) * 1e-12 if abs(row["exact"]) >= EXACT else 0)
    cut = spark.sparkContext.broadcast(cutoffs)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, start, q_ids, ids, local in batches_of(batches):
            r, c, s = sufficient(q_ids, ids, local, cut.value[group][start : start + len(q_ids)])
            if len(r):
                best = first_of_each(r, s, ids[c], k)
                r, c, s = r[best], c[best], s[best]
                exact = [int(x) for x in s]
                whole = [max(-(2**63), min(2**63 - 1, x)) for x in exact]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), group, np.int64)), pa.array(r.astype(np.int64) + start), pa.array(q_ids[r]), pa.array(ids[c]), pa.array(whole, pa.int64()), pa.array(map(excess, exact), pa.string())],
                    names=["group", "query", "query_id", "vec_id", "score", "excess"],
                )

    found = rows.mapInArrow(collect, "group long, query long, query_id long, vec_id long, score long, excess string")
    order = Window.partitionBy("group", "query").orderBy(F.desc("score"), F.desc("excess"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), [sent, cut]
