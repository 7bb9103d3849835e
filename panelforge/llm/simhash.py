"""SimHash near-duplicates with BK-trees.

A fingerprint's bit is set if more than half of the XXH64 values (seed 42) of the text's 3-word shingles have it.
Fingerprints that differ in at most ``radius`` bits are linked, and linked documents make a group.

Of ``radius + 1`` blocks of a fingerprint, two linked ones share at least one. The distinct fingerprints are
therefore dealt out by each block's value into shards, and large shards again by blocks of the other bits, so that no shard
grows with the corpus. A shard's own BK-tree finds a fingerprint's neighbours: a
node's children are keyed by their Hamming distance to it, and a search goes down only where that key is
within the radius of the searched fingerprint's distance to the node. A shard's tree meets only the searches of its
own shard, so trees go with their shards to one task and none is broadcast: all trees together grow with the corpus,
and a broadcast of them would have no bound. No pair is left out, and copies are searched for once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, join_counted, let_workers_import, shared_checkpoint, text_bytes
from .components import Forest, connected_components

SHINGLE = 3
SEED = 42
#: Shingles whose bits are counted at once, and pairs of search and node that are looked at together.
STEP = 65_536
FRONTIER = 2_000_000
#: Fingerprints above which a shard is dealt out again.
SHARD_PRINTS = 20_000


def fingerprint(data: bytes) -> int:
    """The 64-bit SimHash of UTF-8 text; zero if it has no word."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = data.lower().split()
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, total, STEP):
        part = words[start : start + STEP + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(part)]
        hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def add_fingerprints(df: DataFrame, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Add ``fingerprint``, a signed 64-bit integer, from whole texts; null, empty and blank texts get zero."""

    def compute():
        def function(columns):
            raw, offsets = text_bytes(columns[0])
            data = raw.tobytes()
            found = [fingerprint(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

        return function

    return add_columns(df, carry, [text], T.StructType([T.StructField("fingerprint", T.LongType())]), compute)


class BKForest:
    """One BK-tree for each shard, built and searched for all shards together."""

    def __init__(self, shards: np.ndarray, prints: np.ndarray):
        """``shards`` in ascending order; ``prints`` are distinct within a shard."""
        self.prints = prints
        n = len(prints)
        new = np.ones(n, dtype=bool)
        new[1:] = shards[1:] != shards[:-1]
        self.roots = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.roots, n))
        self.root_of = np.repeat(self.roots, self.sizes)
        edges, children = [], []
        left = np.flatnonzero(~new)
        parent = self.root_of[left]
        while len(left):
            edge = parent * 65 + np.bitwise_count(prints[left] ^ prints[parent])
            keys, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            children.append(left[first])
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            parent = left[first][which][rest]
            left = left[rest]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge = edge[order]
        self.child = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def neighbours(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of pairs in one shard at most ``radius`` bits apart, each pair once."""
        work = np.cumsum(np.repeat(self.sizes, self.sizes))
        start = 0
        while start < len(work):
            done = work[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(work, done + FRONTIER, side="right")))
            search = np.arange(start, end)
            node = self.root_of[start:end]
            while len(search):
                distance = np.bitwise_count(self.prints[search] ^ self.prints[node]).astype(np.int64)
                hit = (distance <= radius) & (search < node)
                yield search[hit], node[hit]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(0, distance - radius))
                high = np.searchsorted(self.edge, node * 65 + np.minimum(64, distance + radius), side="right")
                counts = high - low
                search = np.repeat(search, counts)
                within = np.arange(len(search)) - np.repeat(np.cumsum(counts) - counts, counts)
                node = self.child[np.repeat(low, counts) + within]
            start = end


def deal_shards(prints: DataFrame, radius: int, most: int) -> DataFrame:
    """``shard`` and ``fingerprint``: fingerprints dealt out so that any two within ``radius`` bits share a shard.

    A shard is a value of one of ``radius + 1`` blocks of the bits. One with more than ``most`` fingerprints is dealt out
    again by as many blocks of the bits outside its own, of which two linked ones share one as well, and so on while
    there are more bits than blocks. Shards go by a hash of their blocks and values; two of one hash become one, which
    loses no pair. Sizes are counted in the cluster.
    """
    spark = prints.sparkSession
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    left = prints.select(F.lit(0).cast("long").alias("free"), F.lit(0).cast("long").alias("shard"), "fingerprint")
    frees = [(1 << 64) - 1]  # the bits that shards of this level have not used
    left = left.withColumn("free", F.lit(signed(frees[0])))
    done = None
    while True:
        masks = []
        for free in frees:
            bits = [bit for bit in range(64) if free >> bit & 1]
            cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                mask = sum(1 << bit for bit in bits[low:high])
                masks.append((signed(free), signed(mask), signed(free & ~mask)))
        table = spark.createDataFrame(masks, "free long, mask long, others long")
        shard = F.xxhash64("shard", "mask", F.col("fingerprint").bitwiseAND(F.col("mask")))
        dealt = left.join(F.broadcast(table), "free").select(F.col("others").alias("free"), shard.alias("shard"), "fingerprint")
        # Shards that may be dealt out again: too large, and with more free bits than blocks.
        large = dealt.groupBy("free", "shard").agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.bit_count("free") > radius + 1))
        large = shared_checkpoint(large.select("free", "shard"))
        frees = [row["free"] % (1 << 64) for row in large.select("free").distinct().collect()]  # a few choices of blocks
        if not frees:
            rest = dealt.select("shard", "fingerprint")
            return rest if done is None else done.unionByName(rest)
        small = dealt.join(large, ["free", "shard"], "left_anti").select("shard", "fingerprint")
        done = small if done is None else done.unionByName(small)
        left = shared_checkpoint(dealt.join(large, ["free", "shard"], "left_semi"))


def link_prints(prints: DataFrame, radius: int, most: int = SHARD_PRINTS) -> DataFrame:
    """Links ``a``, ``b`` that connect what fingerprints at most ``radius`` bits apart connect.

    ``prints`` has distinct ``fingerprint`` values. Each task gives a spanning forest of the links it found, so there are no
    more rows than there are fingerprints in all shards.
    """
    let_workers_import(prints.sparkSession)
    dealt = deal_shards(prints.select("fingerprint"), radius, most)
    dealt = dealt.repartition("shard").distinct().sortWithinPartitions("shard", "fingerprint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(shards: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            trees, forest = BKForest(shards, own.view(np.uint64)), Forest(len(own))
            for a, b in trees.neighbours(radius):
                forest.link(a, b)
            joined = np.flatnonzero(forest.root != np.arange(len(own)))
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(own[joined]), pa.array(own[forest.root[joined]])], names=["a", "b"])

        # Whole shards are searched once enough rows are there; a shard's rows are together.
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            shards, own = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
            cut = int(np.searchsorted(shards, shards[-1]))
            if cut:
                yield from links(shards[:cut], own[:cut])
            held = [pa.RecordBatch.from_arrays([pa.array(shards[cut:]), pa.array(own[cut:])], names=["shard", "fingerprint"])]
            rows = len(shards) - cut
        if rows:
            shards, own = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
            yield from links(shards, own)

    return dealt.mapInArrow(search, "a long, b long")


def near_duplicates(
    df: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id", carry: Iterable[str] | None = None
) -> DataFrame:
    """``carry`` columns (the id alone, if None), ``fingerprint`` (16 lowercase hex digits), ``component_id`` and ``group_print``.

    ``component_id`` is the least id that links of fingerprints reach, the document's own included; ids that are null
    don't count, and a group of null ids alone has a null one. ``group_print`` is the group's least fingerprint, which names it
    even where ids repeat. One row for each input row, repeated rows and
    ids included. Null, empty and blank texts have fingerprint zero and are linked like any other.
    """
    carry = list(dict.fromkeys([doc_id, *(carry or [])]))
    marked = shared_checkpoint(add_fingerprints(df, text, [c for c in carry if c.lower() not in ("component_id", "group_print")]))
    prints = shared_checkpoint(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("least"), F.count("*").alias("copies")))
    groups = connected_components(link_prints(prints.select("fingerprint"), radius))
    groups = prints.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    groups = shared_checkpoint(groups.select("fingerprint", "least", "copies", F.coalesce("component", "fingerprint").alias("component")))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    total = groups.agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).first()
    named = join_counted(groups, least, "component", "n", total["n"]).select("fingerprint", "component_id", F.col("component").alias("group_print"), "copies")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    joined = join_counted(marked, named, "fingerprint", "copies", total["rows"] or 0)
    return joined.select(*[c for c in marked.columns if c != "fingerprint"], hexed.alias("fingerprint"), "component_id", "group_print")
