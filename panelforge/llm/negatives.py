"""Hard-negative mining by distributed radix selection.

Vectors become integers, so that scores (inner products with an anchor) are integers, and are packed by the tasks that read
them into blocks of :data:`BLOCK` rows, written once. Anchors are packed into blocks of about :data:`ANCHORS`. What is looked for are the
best ``k`` rows of *windows*: a window has an anchor, a range of scores and a rule for labels. An anchor's positives are those of one window over
all scores and its own label; each positive then has a window of its own, from its share of the positive's score up to that score, over the
other labels.

Selection goes digit by digit. In each pass every block counts its rows' scores by window and by one of :data:`BUCKETS` equal buckets of the
window's range; the counts are added up, and running sums from the top locate the bucket that holds the kth score. Its range is the
window of the next pass, unless it is a single score, or the rows down to its end are so few (:data:`FEW`) that more digits would not pay. No row
leaves a block in these passes. At last the rows from the bucket's lower end on are gathered, at most ``k`` of a window from each
task, the best by score and id, so equal vectors do not multiply, and the best ``k`` of these are the result.

Blocks of anchors meet blocks of candidates in one job for each pass, whatever the number of anchors. Anchors are sent to all tasks if their blocks are
at most ``most_sent`` bytes together; else candidates are dealt into cells and each cell gets all blocks of anchors by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import quantised_runs
from .common import let_workers_import, shared_checkpoint
from .topk import first_of_each, products

BLOCK = 4096
ANCHORS = 128
BUCKETS = 256
FEW = 64
#: Scores beyond count as this.
MOST = 2**60
#: Bytes of anchors that are sent to all tasks, and of the counts or rows that a task holds before it hands them on.
SENT = 16_000_000
HELD = 64_000_000

ROWS = "dims int, ids binary, labels binary, points binary, norm double"


class Candidates(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray


class Anchors(NamedTuple):
    """A block of anchors, and of its windows the number, the anchor's place, the range and the bottom of what is wanted."""

    block: int
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    window: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bytes(self) -> int:
        return sum(x.nbytes for x in self[1:])


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of the usable rows (``id``, ``label``, ``vector``) as they are read, by the length of the vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for chosen, points in quantised_runs(batch.column(2), scale):
                for at in range(0, len(chosen), BLOCK):
                    own, part = chosen[at : at + BLOCK], points[at : at + BLOCK]
                    values = [ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), part.astype("<f8").tobytes()]
                    norm = float(np.sqrt((part * part).sum(axis=1)).max())
                    yield pa.RecordBatch.from_arrays([pa.array([part.shape[1]], pa.int32()), *[pa.array([v], pa.binary()) for v in values], pa.array([norm])], names=["dims", "ids", "labels", "points", "norm"])

    return shared_checkpoint(rows.mapInArrow(pack, ROWS))


def candidates_of(batch: pa.RecordBatch, i: int, at: int = 0) -> Candidates:
    dims, ids, labels, points = (batch.column(at + n)[i].as_py() for n in range(4))
    return Candidates(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(points, "<f8").reshape(-1, dims))


def anchors_of(row: dict) -> Anchors:
    join = lambda name, kind: np.frombuffer(b"".join(a[name] for a in row["anchors"]), kind)
    numbers = lambda rows, name: np.array([r[name] for r in rows], dtype=np.int64)
    windows = row["windows"]
    return Anchors(
        row["block"], numbers(row["anchors"], "id"), numbers(row["anchors"], "label"), join("points", "<f8").reshape(len(row["anchors"]), -1), numbers(windows, "window"), numbers(windows, "anchor"), numbers(windows, "low"), numbers(windows, "high")
    )


def pair_up(blocks: DataFrame, windows: DataFrame, candidates: DataFrame, work: Callable[[Iterable[tuple[Anchors, Candidates]]], Iterator[pa.RecordBatch]], schema: str, most_sent: int) -> DataFrame:
    """What ``work`` gives for all pairs of a block of anchors that has windows and a block of candidates as long."""
    spark = blocks.sparkSession
    state = windows.groupBy("block").agg(F.collect_list(F.struct("window", "anchor", "low", "high")).alias("windows"))
    full = blocks.join(state, "block").select("block", "dims", "anchors", "windows")
    size = full.agg(F.sum(F.size("anchors") * (F.col("dims") * 8 + 16) + F.size("windows") * 32)).first()[0] or 0
    if size <= most_sent:
        sent = spark.sparkContext.broadcast([anchors_of(r) for r in full.toArrow().to_pylist()])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = ((anchors, own) for batch in batches for i in range(batch.num_rows) for own in [candidates_of(batch, i)] for anchors in sent.value)
            yield from work(pair for pair in pairs if pair[0].points.shape[1] == pair[1].points.shape[1])

        return candidates.select("dims", "ids", "labels", "points").mapInArrow(near, schema)
    # A cell has about as many candidates as a task reads, and every block of anchors once for each cell of its length.
    cells = max(1, math.ceil(candidates.count() / 32))
    cell = F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int")
    dealt = candidates.select(cell.alias("cell"), "dims", "ids", "labels", "points")
    spread = full.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    both = dealt.hint("shuffle_merge").join(spread, ["cell", "dims"]).select("dims", "ids", "labels", "points", F.struct("block", "anchors", "windows").alias("own"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work((anchors_of(batch.column(4)[i].as_py()), candidates_of(batch, i)) for batch in batches for i in range(batch.num_rows))

    return both.mapInArrow(far, schema)


def scores_of(anchors: Anchors, own: Candidates, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all anchors and candidates, and which candidates each may take: of its own label, or of others; never its own id."""
    scores = products(anchors.points, own.points)
    if scores.dtype == object:
        scores = np.array([[max(-MOST, min(MOST, int(x))) for x in row] for row in scores], dtype=np.int64)
    else:
        scores = scores.astype(np.int64)
    equal = anchors.labels[:, None] == own.labels[None, :]
    return scores, (equal if same else ~equal) & (anchors.ids[:, None] != own.ids[None, :])


def width_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scores of a bucket: as many as make BUCKETS of them cover the range."""
    return np.maximum(1, -(-(high - low + 1) // BUCKETS))


def histogram(same: bool) -> Callable:
    """Counts by window and bucket, from the top."""

    def work(pairs: Iterable[tuple[Anchors, Candidates]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Anchors, np.ndarray]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for anchors, counts in held.values():
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), anchors.block, np.int64)), pa.array(anchors.window[row]), pa.array(bucket.astype(np.int32)), pa.array(counts[row, bucket])], names=["block", "window", "bucket", "n"]
                )
            held.clear()

        for anchors, own in pairs:
            if anchors.block not in held:
                if size > HELD:
                    yield from hand_on()
                    size = 0
                held[anchors.block] = anchors, np.zeros((len(anchors.window), BUCKETS), dtype=np.int64)
                size += anchors.bytes() + len(anchors.window) * BUCKETS * 8
            counts = held[anchors.block][1]
            scores, able = scores_of(anchors, own, same)
            widths = width_of(anchors.low, anchors.high)
            for i, (place, low, high, width) in enumerate(zip(anchors.anchor, anchors.low, anchors.high, widths, strict=True)):
                found = scores[place]
                found = found[(found >= low) & (found <= high) & able[place]]
                if len(found):
                    counts[i] += np.bincount((high - found) // width, minlength=BUCKETS)
        yield from hand_on()

    return work


def gathered(same: bool, k: int) -> Callable:
    """The best ``k`` rows of each window by score and id, of those that a task meets."""

    def work(pairs: Iterable[tuple[Anchors, Candidates]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for block, (window, score, ids) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int64)), pa.array(window), pa.array(score), pa.array(ids)], names=["block", "window", "score", "id"])
            held.clear()

        for anchors, own in pairs:
            scores, able = scores_of(anchors, own, same)
            parts = [held.get(anchors.block, [np.zeros(0, np.int64)] * 3)]
            for number, place, low, high in zip(anchors.window, anchors.anchor, anchors.low, anchors.high, strict=True):
                found = np.flatnonzero((scores[place] >= low) & (scores[place] <= high) & able[place])
                if len(found):
                    parts.append([np.full(len(found), number), scores[place][found], own.ids[found]])
            if len(parts) > 1:
                window, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                best = first_of_each(window, score, ids, k)
                held[anchors.block] = [window[best], score[best], ids[best]]
                if sum(24 * len(x[0]) for x in held.values()) > HELD:
                    yield from hand_on()
        yield from hand_on()

    return work


def select_top(blocks: DataFrame, windows: DataFrame, candidates: DataFrame, k: int, same: bool, most_sent: int) -> DataFrame:
    """``block``, ``window``, ``score``, ``id`` and ``rank`` of the best ``k`` rows in each window (``block``, ``window``, ``anchor``, ``low``, ``high``).

    Each pass narrows the windows: ``low`` and ``high`` are the range still to be searched for the kth score, ``above`` the rows over it and ``top``
    the end of the whole range.
    """
    state = shared_checkpoint(windows.withColumns({"top": F.col("high"), "above": F.lit(0).cast("long"), "done": F.lit(False)}))
    while not state.where("not done").isEmpty():  # one pass for each digit: 8 at most for 64 bits
        counts = pair_up(blocks, state.where("not done"), candidates, histogram(same), "block long, window long, bucket int, n long", most_sent)
        counts = counts.groupBy("block", "window", "bucket").agg(F.sum("n").alias("n"))
        # A window has BUCKETS rows at most.
        running = F.sum("n").over(Window.partitionBy("block", "window").orderBy("bucket"))
        known = state.select("block", "window", "above")
        located = counts.withColumn("running", running).join(known, ["block", "window"]).where(F.col("running") + F.col("above") >= k)
        located = located.groupBy("block", "window").agg(F.min(F.struct("bucket", "running", "n")).alias("found"))
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1).cast("decimal(20,0)") / BUCKETS).cast("long"))
        new_high = F.col("high") - F.col("found.bucket") * step
        new_low = F.greatest(F.col("low"), new_high - step + 1)
        joined = state.join(located, ["block", "window"], "left")
        # Without a kth row all of the range is wanted.
        few = F.col("found").isNull() | (F.col("above") + F.col("found.running") <= max(FEW, k)) | (new_low == new_high)
        active = ~F.col("done")
        state = shared_checkpoint(
            joined.select(
                "block", "window", "anchor", "top",
                F.when(active & F.col("found").isNotNull(), new_low).otherwise(F.col("low")).alias("low"), F.when(active & F.col("found").isNotNull(), new_high).otherwise(F.col("high")).alias("high"),
                F.when(active & F.col("found").isNotNull(), F.col("above") + F.col("found.running") - F.col("found.n")).otherwise(F.col("above")).alias("above"), (F.col("done") | few).alias("done"),
            )
        )
    wanted = state.select("block", "window", "anchor", "low", F.col("top").alias("high"))
    found = pair_up(blocks, wanted, candidates, gathered(same, k), "block long, window long, score long, id long", most_sent)
    order = Window.partitionBy("block", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    most_sent: int = SENT,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become floor(scale * x) and a score is the integer inner product with the anchor; higher ones come first, ties by the smaller
    id. An anchor's positives are its first ``positives`` other rows with its label, and a positive's negatives the first
    ``negatives`` rows of other labels whose score is at most the positive's and at least ``share`` hundredths of it. Rows with a null id, label or
    vector, or with a null or non-finite component, and empty vectors take no part; vectors of different lengths have no score.
    Rows with the anchor's own id are no other rows. Repeated rows each count as candidates; a repeated anchor counts once for
    each different vector or label. Integers are exact; scores beyond 2**60 count as that. An anchor without positives, or a positive
    without negatives, gives no row; an empty table gives an empty result.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = [F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector")]
    whole = "id is not null and label is not null and vector is not null"
    candidates = packed(df.select(*named).where(whole), scale)
    longest = candidates.groupBy("dims").agg(F.max("norm").alias("longest"))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen, points in quantised_runs(batch.column(2), scale):
                ids, labels = (batch.column(i).take(pa.array(chosen)) for i in (0, 1))
                rows = pa.array([p.astype("<f8").tobytes() for p in points], pa.binary())
                norms = pa.array(np.sqrt((points * points).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([ids, labels, rows, pa.array(np.full(len(chosen), points.shape[1], np.int32)), norms], names=["id", "label", "points", "dims", "norm"])

    anchors = shared_checkpoint(df.where(is_anchor).select(*named).where(whole).mapInArrow(one_by_one, "id long, label long, points binary, dims int, norm double").distinct())
    groups = max(1, math.ceil(anchors.count() / ANCHORS))
    part = F.pmod(F.xxhash64("id", "label", "points"), F.lit(groups))
    # Blocks have about ANCHORS rows, as the hash deals them out.
    grouped = anchors.groupBy("dims", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", "label", "points", "norm"))).alias("anchors"))
    blocks = shared_checkpoint(grouped.withColumn("block", F.col("dims").cast("long") * groups + F.col("part")).drop("part"))
    # No score passes the product of the norms; one more covers rounding.
    each = blocks.join(longest, "dims").select("block", "longest", F.posexplode("anchors").alias("anchor", "own"))
    most = F.col("own.norm") * F.col("longest") * (1 + 1e-9) + 1
    bound = F.when(most < float(MOST), F.ceil(F.least(most, F.lit(float(MOST)))).cast("long")).otherwise(F.lit(MOST))
    windows = each.select("block", F.col("anchor").cast("long").alias("window"), F.col("anchor").cast("long").alias("anchor"), (-bound).alias("low"), bound.alias("high"))
    first = select_top(blocks, windows, candidates, positives, True, most_sent).withColumnRenamed("window", "anchor")
    first = shared_checkpoint(first.select("block", "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("anchor") * positives + F.col("rank") - 1).alias("window")))
    # ceil(share / 100 * score), whole numbers only; a negative score has no range.
    least = -F.floor((-F.col("positive_score").cast("decimal(28,0)") * share) / 100).cast("long")
    ranges = first.select("block", "window", "anchor", least.alias("low"), F.col("positive_score").alias("high")).where("low <= high")
    found = select_top(blocks, ranges, candidates, negatives, False, most_sent)
    ids = blocks.select("block", F.posexplode("anchors").alias("anchor", "own")).select("block", F.col("anchor").cast("long").alias("anchor"), F.col("own.id").alias("anchor_id"))
    out = found.select("block", "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["block", "window"]).join(ids, ["block", "anchor"])
    return out.select([c.split()[0] for c in schema.split(", ")])
