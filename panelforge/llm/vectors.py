"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets the signs of random projections as one string of bits, all vectors are ordered by it, and
all that share a prefix of it, the pass's window, are compared with each other, however many they are: a run of one prefix
is never cut, neither by a number of rows nor by a task's border. Pairs count only if their exact cosine in double
precision reaches the threshold. Equal vectors are one class from the start and are never compared with each other.

Passes complete each other. A pair belongs to the first pass whose prefix its vectors share, so every vector carries its
prefixes of all passes, and a pass leaves out what an earlier one has compared. Each pass can therefore add up its links:
it gives for every vector the number of its links and a spanning forest of each run, never the pairs themselves, so
the output grows with the vectors and the passes and not with the square of a group.

The number of passes follows from the prefix: as many as make a pair right at the threshold have different prefixes in all
passes with probability ``miss`` at most, however the vectors are spread. The prefix has log2(n / window) bits, or more
where a sample shows that runs would be so long that more passes over shorter ones cost less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, let_workers_import, shared_checkpoint
from .components import Forest, connected_components

BITS = 64
ROWS = 256
#: For the choice of the prefix: vectors looked at, and comparisons that cost as much as a row of a pass.
SAMPLE = 2000
ROW_COST = 1000


def matrix_runs(column: pa.Array, zeros: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double-precision rows of the usable vectors of a list column, by length.

    Null, empty and (unless ``zeros``) zero vectors and those with a null or non-finite component are not usable.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(lengths)
    for length in np.unique(lengths):
        if length == 0:
            continue
        rows = np.flatnonzero(lengths == length)
        vectors = values[(ends[rows] - length)[:, None] + np.arange(length)]
        good = np.isfinite(vectors).all(axis=1) & (zeros | (vectors != 0).any(axis=1))
        yield rows[good], vectors[good]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def passes_needed(bits: int, threshold: float, miss: float) -> int:
    """Passes after which a pair with that cosine never shared its first ``bits`` bits with probability ``miss`` at most."""
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    once = min(0.999, same**bits)
    return max(8, math.ceil(math.log(miss) / math.log1p(-once)))


def prefix_bits(sample: list[bytes], n: int, threshold: float, window: int, miss: float, seed: int) -> int:
    """Bits of the prefix for ``n`` vectors of which ``sample`` is drawn: from log2(n / window) on, those of least cost.

    The sample decides on the time that passes take, not on what they find.
    """
    least = min(BITS, max(1, math.ceil(math.log2(max(2.0, n / window)))))
    by_length: dict[int, list[bytes]] = {}
    for vector in sample:
        by_length.setdefault(len(vector), []).append(vector)
    sets = 8
    met = np.zeros(BITS + 1)
    for size, members in by_length.items():
        matrix = unit_rows(np.frombuffer(b"".join(members), dtype=np.float64).reshape(len(members), size // 8))
        planes = np.random.default_rng([seed, size // 8, 1]).standard_normal((size // 8, sets * BITS))
        keys = np.ascontiguousarray(np.packbits(matrix @ planes > 0, axis=1)).view(">u8").astype(np.uint64)
        for own in keys.T:
            for bits in range(least, BITS + 1):
                counts = np.unique(own >> np.uint64(BITS - bits), return_counts=True)[1].astype(np.float64)
                met[bits] += (counts * (counts - 1)).sum()
    pairs = max(1, sets * len(sample) * (len(sample) - 1))
    return min(range(least, BITS + 1), key=lambda bits: passes_needed(bits, threshold, miss) * (ROW_COST + n * met[bits] / pairs / 2))


def run_links(units: np.ndarray, raw: np.ndarray, earlier: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a run's rows with cosine >= threshold that share the prefix of no earlier pass (a column of ``earlier`` each)."""
    n = len(units)
    starts = range(0, n, ROWS)
    blocks = [earlier[at : at + ROWS] for at in starts]
    low = np.array([block.min(axis=0) for block in blocks]).reshape(len(blocks), -1)
    same = low == np.array([block.max(axis=0) for block in blocks]).reshape(len(blocks), -1)
    for i, start in enumerate(starts):
        # Blocks whose rows all share one earlier prefix with this one's have been compared.
        left = np.flatnonzero(~((low[i:] == low[i]) & same[i:] & same[i]).any(axis=1)) + i
        for at in (left * ROWS).tolist():
            a, b = np.nonzero(units[start : start + ROWS] @ units[at : at + ROWS].T >= threshold - 1e-9)
            a, b = a + start, b + at
            good = b > a
            a, b = a[good], b[good]
            for column in earlier.T:
                good = column[a] != column[b]
                if not good.all():
                    a, b = a[good], b[good]
                if not len(a):
                    break
            if not len(a):
                continue
            cosine = np.einsum("ij,ij->i", units[a], units[b])
            exact = cosine >= threshold
            close = np.abs(cosine - threshold) < 1e-12
            if close.any():  # by the plain formula, where rounding decides
                x, y = raw[a[close]], raw[b[close]]
                exact[close] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
            if exact.any():
                yield a[exact], b[exact]


def near_duplicate_vectors(
    df: DataFrame,
    threshold: float = 0.9,
    window: int = 64,
    miss: float = 0.001,
    seed: int = 11,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    task_rows: int = 60_000,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each input row.

    ``n_links`` counts the other rows that links join with this one, ``component_id`` is the least id of the rows that links
    reach, the own one included, and ``kept`` says whether it is the own one. Rows with equal vectors are linked
    with each other. Unusable vectors (see :func:`matrix_runs`) have no links and their own id. A null id links with
    nothing and has a null component and kept = false. Ids may be of any type that has an order and may repeat: links join
    rows, whatever their ids. Vectors of different lengths are never linked.
    """
    let_workers_import(df.sparkSession)
    prepared = T.StructType([T.StructField("vec_id", df.schema[vec_id].dataType), T.StructField("key", T.BinaryType()), T.StructField("vector", T.BinaryType())])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            vectors: list[bytes | None] = [None] * batch.num_rows
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, values in matrix_runs(batch.column(1)):
                values = values + 0.0  # -0.0 becomes 0.0
                for row, value in zip(rows.tolist(), values, strict=True):
                    if known[row]:
                        vectors[row] = value.tobytes()
                        keys[row] = hashlib.blake2b(vectors[row], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vector"])

    rows = shared_checkpoint(df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).mapInArrow(prepare, prepared))
    classes = shared_checkpoint(
        rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    counts = classes.agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).first()
    n = counts["n"]
    # Keys are digests, so the first by key are a fair sample.
    bits = prefix_bits([row["vector"] for row in classes.orderBy("key").limit(SAMPLE).select("vector").collect()], n, threshold, window, miss, seed)
    passes = passes_needed(bits, threshold, miss)
    narrow = np.dtype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors = part.column(2).to_pylist()
                by_length: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_length.setdefault(len(v) // 8, []).append(i)
                for length, members in by_length.items():
                    if length not in planes:
                        planes[length] = np.random.default_rng([seed, length]).standard_normal((length, passes * BITS)).astype(np.float32)
                    matrix = np.frombuffer(b"".join([vectors[i] for i in members]), dtype=np.float64).reshape(len(members), length)
                    signs = np.packbits(unit_rows(matrix).astype(np.float32) @ planes[length] > 0, axis=1)
                    keys = np.ascontiguousarray(signs).view(">u8").astype(np.uint64)
                    prefixes = (keys >> np.uint64(BITS - bits)).astype(narrow)
                    keys = (keys ^ np.uint64(1 << 63)).view(np.int64)  # signed integers in the order of the bits
                    chosen = part.take(pa.array(members))
                    packed = pa.array([row.tobytes() for row in prefixes], pa.binary())
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(members), p, np.int32)), pa.array(np.full(len(members), length, np.int32)), pa.array(keys[:, p].copy()), chosen.column(0), chosen.column(1), packed, chosen.column(2)],
                            names=["pass", "length", "order", "key", "copies", "prefixes", "vector"],
                        )

    projected = classes.select("key", "copies", "vector").mapInArrow(project, "pass int, length int, order long, key binary, copies long, prefixes binary, vector binary")
    parts = max(1, math.ceil(n * passes / task_rows))
    # Rows of one prefix go to one task.
    ordered = projected.repartitionByRange(parts, F.col("pass"), F.col("length"), F.shiftright("order", BITS - bits)).sortWithinPartitions("pass", "length", "order", "key")

    def links_of(run: pa.Table) -> pa.RecordBatch | None:
        number, length = run.column("pass")[0].as_py(), run.column("length")[0].as_py()
        raw = np.frombuffer(b"".join(run.column("vector").to_pylist()), dtype=np.float64).reshape(-1, length)
        earlier = np.frombuffer(b"".join(run.column("prefixes").to_pylist()), dtype=narrow).reshape(-1, passes)[:, :number]
        copies = run.column("copies").to_numpy()
        n_links, forest = np.zeros(len(raw), np.int64), Forest(len(raw))
        for a, b in run_links(unit_rows(raw), raw, earlier, threshold):
            np.add.at(n_links, a, copies[b])
            np.add.at(n_links, b, copies[a])
            forest.link(a, b)
        linked = np.flatnonzero(n_links)
        if not len(linked):
            return None
        keys = run.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(linked)), keys.take(pa.array(forest.root[linked])), pa.array(n_links[linked])], names=["key", "root", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        # One run after another: a run ends where the next one's pass, length or prefix begins.
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)] + [batch.column(2).to_numpy() >> (BITS - bits)], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                mark = tuple(marks[start].tolist())
                if held and mark != last:
                    found = links_of(pa.Table.from_batches(held))
                    held.clear()
                    if found:
                        yield found
                held.append(batch.slice(start, end - start))
                last = mark
        if held and (found := links_of(pa.Table.from_batches(held))):
            yield found

    # A row for each vector and pass with links: how many, and the least of its run that they reach.
    found = shared_checkpoint(ordered.mapInArrow(compare, "key binary, root binary, n long"))
    linked = found.groupBy("key").agg(F.sum("n").alias("others"))
    groups = connected_components(found.select("key", "root"), "key", "root").select(F.col("node").alias("key"), "component")
    named = classes.select("key", "vec_id", "copies").join(linked, "key", "left").join(groups, "key", "left")
    named = shared_checkpoint(named.select("key", "vec_id", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component")))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    summary = join_counted(named.drop("vec_id"), least, "component", "n", n).select("key", "n_links", "component_id", "copies")
    usable = join_counted(rows.where("key is not null").select("vec_id", "key"), summary, "key", "copies", counts["rows"] or 0)
    lone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    own = usable.select("vec_id", "n_links", "component_id").unionByName(lone)
    return own.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
