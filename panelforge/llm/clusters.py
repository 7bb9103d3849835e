"""Centroid clustering by filtering in kd-trees.

Vectors become integers. Each task packs the vectors that it reads into blocks of :data:`BLOCK` and builds a kd-tree over each;
a node holds the count, the integer sums and the box of its vectors. Trees are written once, to the shared folder, and serve all
rounds. A round sends the centroids, of a fixed number, to the trees. Going down a tree, a node's candidates are the centroids that may
be nearest to one of its vectors: with the one nearest to the middle of the box, every centroid is compared at the corner of the box
that favours it most, and is pruned if it is strictly farther even there. A node with one candidate left is assigned as a whole
by its count and sums; in leaves the distances to the candidates that are left settle each vector. Arithmetic is exact, and
ties, which prune nothing, go to the smaller number; so the result is that of comparing all vectors with all centroids.

A task gives one row for each centroid and dimension, whatever the number of its vectors; these are summed by Spark, and the driver
gets ``k`` times (dimensions + 1) of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_workers_import, shared_checkpoint
from .vectors import matrix_runs

BLOCK = 4096
LEAF = 64
#: Components beyond count as this.
LARGEST = 2.0**60
LONG = (-(2**63), 2**63 - 1)
TREE = ("ids", "points", "lows", "highs", "sums", "spans", "children")


class Tree:
    """A kd-tree over integer vectors in doubles; nodes are numbered by level, children after their parents."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, children, lows, highs = [(0, len(points))], [], [], []
        for start, end in spans:  # grows
            held = points[self.order[start:end]]
            lows.append(held.min(axis=0))
            highs.append(held.max(axis=0))
            width = highs[-1] - lows[-1]
            if end - start <= LEAF or not width.any():
                children.append((-1, -1))
                continue
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(held[:, int(width.argmax())], middle)]
            children.append((len(spans), len(spans) + 1))
            spans += [(start, start + middle), (start + middle, end)]
        self.points = points[self.order]
        self.spans, self.children = np.array(spans), np.array(children)
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.sums = np.array([whole(self.points[a:b]).sum(axis=0) if not small(self.points) else self.points[a:b].sum(axis=0) for a, b in spans], dtype=object)

    @classmethod
    def read(cls, points: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray, spans: np.ndarray, children: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.lows, tree.highs, tree.sums, tree.spans, tree.children = points, lows, highs, sums, spans, children
        return tree


def small(*arrays: np.ndarray) -> bool:
    """Whether no squared distance between rows of the arrays, summed over a block, passes what longs and doubles hold exactly."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return (2 * most + 2) ** 2 * max(a.shape[-1] for a in arrays) * 4 < 2.0**53 and (2 * most + 2) ** 2 * max(a.shape[-1] for a in arrays) * BLOCK < 2.0**62


def whole(array: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which have no bound."""
    return np.array([int(x) for x in array.ravel()], dtype=object).reshape(array.shape)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(node, candidates in ascending order, whether it is a leaf with several) of nodes that together hold each vector once."""
    lows, highs, c = tree.lows, tree.highs, centroids
    norms = (c * c).sum(axis=1)
    nodes, alive = np.array([0]), np.ones((1, len(c)), dtype=bool)
    while len(nodes):
        low, high = lows[nodes], highs[nodes]
        # Four times the squared distance to the middle, less what all have in common.
        middle = 4 * norms - 4 * ((low + high) @ c.T)
        middle = np.where(alive, middle, np.inf)
        best = middle.argmin(axis=1)
        # What the best one is farther than another at the corner that favours the other most.
        away = c[None, :, :] - c[best][:, None, :]
        corner = np.where(away > 0, high[:, None, :], low[:, None, :])
        lead = norms[best][:, None] - norms + 2 * (away * corner).sum(axis=2)
        alive &= ~(lead < 0).astype(bool)
        left = alive.sum(axis=1)
        ends = tree.children[nodes, 0] < 0
        for i in np.flatnonzero((left == 1) | ends):
            yield int(nodes[i]), np.flatnonzero(alive[i]), bool(left[i] > 1)
        deeper = np.flatnonzero((left > 1) & ~ends)
        nodes, alive = tree.children[nodes[deeper]].ravel(), np.repeat(alive[deeper], 2, axis=0)


def exact(tree: Tree, centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """Both in doubles where these are exact, else in Python integers."""
    if small(tree.points, centroids):
        return tree, centroids.astype(np.float64)
    return Tree.read(whole(tree.points), whole(tree.lows), whole(tree.highs), tree.sums, tree.spans, tree.children), whole(centroids)


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums of each centroid's vectors, and how many distances of vectors were worked out."""
    tree, c = exact(tree, centroids)
    counts, sums, worked = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=object), 0
    norms = (c * c).sum(axis=1)
    for node, candidates, several in filtered(tree, c):
        start, end = tree.spans[node]
        if not several:
            counts[candidates[0]] += end - start
            sums[candidates[0]] += tree.sums[node]
            continue
        held = tree.points[start:end]
        worked += len(held) * len(candidates)
        nearest = (norms[candidates] - 2 * (held @ c[candidates].T)).argmin(axis=1)
        for i in np.unique(nearest):
            own = held[nearest == i]
            counts[candidates[i]] += len(own)
            sums[candidates[i]] += whole(own.sum(axis=0))
    return counts, sums, worked


def nearest(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid and squared distance, in the tree's order."""
    tree, c = exact(tree, centroids)
    numbers, distances = np.zeros(len(tree.points), dtype=np.int32), np.zeros(len(tree.points), dtype=tree.points.dtype)
    norms = (c * c).sum(axis=1)
    for node, candidates, several in filtered(tree, c):
        start, end = tree.spans[node]
        held = tree.points[start:end]
        if several:
            numbers[start:end] = candidates[(norms[candidates] - 2 * (held @ c[candidates].T)).argmin(axis=1)]
        else:
            numbers[start:end] = candidates[0]
        away = held - c[numbers[start:end]]
        distances[start:end] = (away * away).sum(axis=1)
    return numbers, distances


def as_long(value: int) -> int:
    return max(LONG[0], min(LONG[1], int(value)))


def quantised_runs(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer vectors by length; a null vector, or one with a null or non-finite component, is not among them."""
    for rows, vectors in matrix_runs(column, zeros=True):
        if len(rows):
            with np.errstate(over="ignore"):
                yield rows, np.clip(np.floor(vectors * scale), -LARGEST, LARGEST)


def build_trees(df: DataFrame, dims: int, scale: float, vec_id: str, vector: str) -> DataFrame:
    """The blocks of ``df`` with their trees, in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def block() -> pa.RecordBatch:
            tree = Tree(np.concatenate(held))
            own = pa.concat_arrays(ids).take(pa.array(tree.order))
            arrays = [tree.points, tree.lows, tree.highs]
            sums = [[str(x) for x in np.vectorize(int, otypes=[object])(tree.sums).ravel()]]
            return pa.RecordBatch.from_arrays(
                [pa.array([own.to_pylist()], pa.list_(pa.int64())), *[pa.array([a.astype("<f8").tobytes()]) for a in arrays], pa.array(sums, pa.list_(pa.string())), *[pa.array([a.astype("<i8").tobytes()]) for a in (tree.spans, tree.children)]],
                names=list(TREE),
            )

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for rows, vectors in quantised_runs(part.column(1), scale):
                    if vectors.shape[1] == dims:
                        if n and n + len(rows) > BLOCK:
                            yield block()
                            ids, held, n = [], [], 0
                        ids.append(part.column(0).take(pa.array(rows)))
                        held.append(vectors)
                        n += len(rows)
        if n:
            yield block()

    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    schema = "ids array<bigint>, points binary, lows binary, highs binary, sums array<string>, spans binary, children binary"
    return shared_checkpoint(rows.mapInArrow(build, schema))


def trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        matrix = lambda name, kind, width: np.frombuffer(batch.column(name)[i].as_py(), dtype=kind).reshape(-1, width)
        sums = np.array([int(x) for x in batch.column("sums")[i].as_py()], dtype=object).reshape(-1, dims)
        yield batch.column("ids")[i].values, Tree.read(matrix("points", "<f8", dims), matrix("lows", "<f8", dims), matrix("highs", "<f8", dims), sums, matrix("spans", "<i8", 2), matrix("children", "<i8", 2))


def first_centroids(df: DataFrame, k: int, dims: int, scale: float, seed: str, vec_id: str, vector: str) -> np.ndarray:
    """The ``k`` usable vectors with the smallest sha256 of ``seed`` and id; of equal hashes the smaller vector first, without an id last."""
    v = F.col(f"`{vector}`")
    good = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = df.where((F.size(v) == dims) & good)
    chosen = usable.select(F.sha2(F.concat(F.lit(seed), F.col(f"`{vec_id}`").cast("long").cast("string")), 256).alias("hash"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    rows = chosen.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()  # k rows at most
    return whole(np.clip(np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dims), -LARGEST, LARGEST))


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each usable vector.

    Usable are vectors of ``dims`` components, none null or non-finite; components become floor(scale * x). The first
    centroids are the ``k`` vectors with the smallest sha256 of ``seed`` and id (all, if fewer); each round assigns every vector to its
    nearest centroid, by squared distance, ties to the smaller number, and replaces every centroid that has vectors by the floor of
    their mean. After the rounds vectors are assigned once more. Repeated rows each count; a null id is carried and comes last
    among the first centroids. Integers are exact however large; components count as 2**60 beyond it, and a distance or
    inertia beyond 64 bits is written as the greatest long. An empty table gives an empty result.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(df, k, dims, scale, seed, vec_id, vector)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = build_trees(df, dims, scale, vec_id, vector)

    def summed(work) -> dict[tuple[int, int], int]:
        """Adds up by centroid and place what ``work`` gives as a table (centroids x places) for each tree."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = None
            for batch in batches:
                for _, tree in trees_of(batch, dims):
                    new = work(tree)
                    table = new if table is None else table + new
            if table is not None:
                rows, places = np.divmod(np.arange(table.size), table.shape[1])
                values = pa.array([Decimal(int(x)) for x in table.ravel()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(places, pa.int32()), values], names=["centroid", "place", "total"])

        added = blocks.mapInArrow(run, "centroid int, place int, total decimal(38,0)").groupBy("centroid", "place").agg(F.sum("total").alias("total"))
        return {(r["centroid"], r["place"]): int(r["total"]) for r in added.collect()}  # k x places rows

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def counted(tree: Tree, sent=sent) -> np.ndarray:
            counts, sums, _ = totals(tree, sent.value)
            return np.column_stack([counts.astype(object), sums])

        found = summed(counted)
        sent.destroy()
        moved = [[found[i, j + 1] // found[i, 0] for j in range(dims)] if found[i, 0] else None for i in range(len(centroids))]
        centroids = np.array([old if new is None else new for old, new in zip(centroids.tolist(), moved, strict=True)], dtype=object)

    final = spark.sparkContext.broadcast(centroids)

    def spread(tree: Tree) -> np.ndarray:
        numbers, distances = nearest(tree, final.value)
        table = np.zeros((len(final.value), 1), dtype=object)
        for i in np.unique(numbers):
            table[i, 0] = sum(int(x) for x in distances[numbers == i])
        return table

    inertias = summed(spread)
    own = [as_long(inertias[i, 0]) for i in range(len(centroids))]
    every = as_long(sum(inertias.values()))
    hashes = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in trees_of(batch, dims):
                numbers, distances = nearest(tree, final.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(numbers), pa.array([as_long(x) for x in distances], pa.int64()), pa.array([own[i] for i in numbers], pa.int64()),
                        pa.array([every] * len(numbers), pa.int64()), pa.array([hashes[i] for i in numbers], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(out, schema)
