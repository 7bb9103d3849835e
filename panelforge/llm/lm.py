"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and word pairs over all training documents. The count c of an n-gram is stored as the
quantised level 1 + floor(log2 c): the filter holds the n-gram with each number from 1 to its level. To read
a count, the numbers are probed in turn until one is missing. False positives can only raise a level, and each
step up is that much less likely. Probabilities interpolate a word's share of its predecessor's count with a
smoothed unigram probability, all from the filter.

Dealing out: each task packs the documents that it reads into blocks of about ``block_bytes`` bytes of text, which are
written to the shared checkpoint folder, and n-grams go into buckets by the high bits of their hash. There are as many
buckets as blocks, so a bucket stays small however large the corpus is. A block sends each bucket its distinct n-grams
with their counts as packed arrays; a bucket adds them up, makes its own segment of the filter, and answers each block
with the exact totals of the block's words and with the levels that its segment gives for the block's words and pairs.
So frequent words cost one entry for each block, and neither the words nor the filter are ever in one place. A segment
has ``ENTRY_BITS`` bits for each number that it holds, so the filter grows with the corpus at one rate of false
positives. Text is shuffled once, to meet its answers; copies of a document need not meet at all.

Words are told apart by 64-bit hashes. A text's tokens are its words in lower case (A-Z only) and one end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_workers_import, row_groups, shared_checkpoint, text_bytes

GROUP_BYTES = 1_000_000
#: The filter's least size, and its bits for each n-gram and level: at 16, about 1 in 200 probes is a false positive.
FILTER_BITS = 1 << 28
ENTRY_BITS = 16
BLOCK_BYTES = 8_000_000
PROBES = 3
LEVELS = 40
PAIR_WEIGHT = 0.3
LEAST_BUCKETS = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
END = np.uint64(0x243F6A8885A308D3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and each text's first token."""
    parts, sizes = [], []
    for start, end in row_groups(offsets, GROUP_BYTES):
        own = offsets[start : end + 1]
        data = LOWER[raw[own[0] : own[-1]]]
        own = own - own[0]
        inside = ~SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = own[:-1][np.diff(own) > 0]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        if len(at):
            token = np.cumsum(begins) - 1
            place = np.arange(len(data)) - at[np.maximum(token, 0)]
            place[~inside] = 0
            powers = np.cumprod(np.full(int(place.max()) + 1, BASE))
            values = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
            values[~inside] = 0
            values[: at[0]] = 0
            hashes = mixed(np.add.reduceat(values, at))
        else:
            hashes = np.zeros(0, np.uint64)
        bounds = np.searchsorted(at, own)
        counts = np.diff(bounds)
        # One end after each text's words.
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
        with_ends = np.full(len(hashes) + len(counts), END)
        with_ends[places] = hashes
        parts.append(with_ends)
        sizes.append(counts + 1)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return tokens, np.concatenate(([0], np.cumsum(lengths)))


def pair_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it; an end stands before each text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = END
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def packed_counts(counts: np.ndarray) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def read_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, dtype="<u8", offset=n)
    return counts


def short_ids(hashes: np.ndarray) -> np.ndarray:
    """The high 48 bits, by which pairs are told apart; the filter forgives a clash."""
    return hashes >> np.uint64(16)


def bit_positions(ids: np.ndarray, kind: int, level: int, segment_bits: int) -> list[np.ndarray]:
    """Places of an n-gram at a level within its bucket's segment of the filter."""
    x = mixed(ids + np.uint64(0x9E3779B97F4A7C15 * (level * 2 + kind) % 2**64))
    y = mixed(x) | np.uint64(1)
    return [((x + y * np.uint64(i)) % np.uint64(segment_bits)).astype(np.int64) for i in range(PROBES)]


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + (counts > 0)


def fill_segment(segment: np.ndarray, ids: np.ndarray, counts: np.ndarray, kind: int) -> None:
    levels = levels_of(counts)
    for level in range(1, int(levels.max(initial=0)) + 1):
        chosen = ids[levels >= level]
        for places in bit_positions(chosen, kind, level, len(segment) * 8):
            np.bitwise_or.at(segment, places >> 3, (1 << (places & 7)).astype(np.uint8))


def read_levels(bits: np.ndarray, hashes: np.ndarray, kind: int, n_buckets: int) -> np.ndarray:
    """Levels of n-grams by repeated probes."""
    segment_bits = len(bits) * 8 // n_buckets
    ids = short_ids(hashes)
    base = bucket_of(hashes, n_buckets) * segment_bits
    levels = np.zeros(len(ids), dtype=np.int64)
    left = np.arange(len(ids))
    for level in range(1, LEVELS):
        there = np.ones(len(left), dtype=bool)
        for places in bit_positions(ids[left], kind, level, segment_bits):
            at = places + base[left]
            there &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        left = left[there]
        if not len(left):
            break
        levels[left] = level
    return levels


def packed_levels(levels: np.ndarray) -> bytes:
    return pa.compress(levels.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def unpacked_levels(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n, codec="zstd"), dtype=np.uint8).astype(np.int64)


def expected_counts(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0**levels - 1) / 2, 0.0)


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    bits = n_buckets.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


SENT = "kind string, bucket int, block long, n long, payload binary, counts binary"
ANSWERS = "kind string, bucket int, block long, n long, distinct long, payload binary, levels binary"
SENT_NAMES = ["kind", "bucket", "block", "n", "payload", "counts"]
ANSWER_NAMES = ["kind", "bucket", "block", "n", "distinct", "payload", "levels"]


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``block`` and ``packed``: runs of the rows that a task reads, with about ``block_bytes`` bytes together, each as one compressed Arrow stream.

    A longer text is a block of its own. Texts that are compressed together take about half the room that single ones do.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def stream() -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in held:
                    writer.write_batch(part)
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

        size = 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                # As many rows as the block has room for, one at least if it is empty.
                room = offsets[at] + block_bytes - size
                end = max(at + (not held), int(np.searchsorted(offsets, room, side="right")) - 1)
                if end > at:
                    # A copy, as a slice would keep its whole batch.
                    held.append(batch.slice(at, end - at).take(pa.array(np.arange(end - at))))
                    size += int(offsets[end] - offsets[at])
                    at = end
                if at < batch.num_rows:
                    yield stream()
                    size = 0
        if held:
            yield stream()

    return docs.mapInArrow(pack, "block long, packed binary")


def unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _count_block(n_buckets: int):
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def count(number: int, block: pa.Table) -> pa.Table:
        tokens, first = token_hashes(*text_bytes(block.column("text")))
        learned = np.repeat(block.column("learned").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        rows = []

        def deal(kind: str, hashes: np.ndarray, counts: np.ndarray, width: int) -> None:
            buckets, starts = np.unique(bucket_of(hashes, n_buckets), return_index=True)
            for bucket, a, b in zip(buckets.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True):
                data = np.ascontiguousarray(hashes[a:b] >> np.uint64(64 - 8 * width) if width < 8 else hashes[a:b]).astype("<u8")
                payload = data.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                rows.append((kind, bucket, number, int(b - a), payload, packed_counts(counts[a:b])))

        words, which = np.unique(tokens, return_inverse=True)
        deal("word", words, np.bincount(which[learned], minlength=len(words)), 8)
        del which
        # Pairs keep 48 bits. Those that only other texts have are sent, too, with the count 0: they ask for their level.
        ids, which = np.unique(short_ids(pair_hashes(tokens, first)), return_inverse=True)
        deal("pair", ids << np.uint64(16), np.bincount(which[learned], minlength=len(ids)), 6)
        return _rows(rows, SENT_NAMES, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from count(number, unpacked(packed.as_py())).to_batches()

    return run


def _add_bucket(least_bytes: int):
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def add(sent: pa.Table) -> pa.Table:
        bucket = sent.column("bucket")[0].as_py()
        kinds = np.array(sent.column("kind").to_pylist(), dtype=object)
        added = []
        for kind, name in enumerate(("word", "pair")):
            part = sent.take(pa.array(np.flatnonzero(kinds == name)))
            sizes = part.column("n").to_pylist()
            if not sizes:
                continue
            width = 8 if name == "word" else 6
            data = np.zeros((sum(sizes), 8), dtype=np.uint8)
            data[:, :width] = np.frombuffer(b"".join(part.column("payload").to_pylist()), dtype=np.uint8).reshape(-1, width)
            hashes = data.reshape(-1).view("<u8")
            counts = np.concatenate([read_counts(c, n) for c, n in zip(part.column("counts").to_pylist(), sizes, strict=True)])
            distinct, which = np.unique(hashes, return_inverse=True)
            totals = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
            if name == "pair":
                distinct <<= np.uint64(16)
            added.append((kind, name, part.column("block").to_pylist(), sizes, distinct, which, totals))
        entries = sum(int(levels_of(totals).sum()) for *_, totals in added)
        segment = np.zeros(max(least_bytes, entries * ENTRY_BITS // 8, 8), dtype=np.uint8)
        for kind, _, _, _, distinct, _, totals in added:
            fill_segment(segment, short_ids(distinct), totals, kind)
        rows = []
        for kind, name, blocks, sizes, distinct, which, totals in added:
            cuts = np.cumsum(sizes)[:-1]
            levels = np.split(read_levels(segment, distinct, kind, 1).astype(np.uint8)[which], cuts)
            if name == "word":
                rows.append(("size", bucket, -1, int(totals.sum()), int((totals > 0).sum()), None, None))
                exact = [packed_counts(own) for own in np.split(totals[which], cuts)]
            else:
                exact = [None] * len(blocks)
            rows += [(name, bucket, block, len(own), 0, e, packed_levels(own)) for block, own, e in zip(blocks, levels, exact, strict=True)]
        return _rows(rows, ANSWER_NAMES, types)

    return add


def score_documents(
    df: DataFrame,
    learned: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    filter_bits: int = FILTER_BITS,
    block_bytes: int = BLOCK_BYTES,
    pair_weight: float = PAIR_WEIGHT,
) -> DataFrame:
    """Score whole texts by a model of those for which ``learned`` holds (null counts as false).

    Gives ``doc_id``, ``n_tokens``, ``n_known`` (tokens that training has), ``train_tokens``, ``base_score`` (the sum
    over tokens of log10((c + 1) / (N + V + 1)) with exact counts) and ``score``, the model's log10 probability. One
    row for each input row, repeated rows included, which are also counted as often as they stand. A null or empty
    text has one token, its end. Without training documents every base score is 0 and so is every score.
    ``filter_bits`` is the least size of the filter, which grows with what training counts.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    id_type = df.schema[doc_id].dataType
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    blocks = shared_checkpoint(pack_blocks(docs, block_bytes))
    n_buckets = max(LEAST_BUCKETS, 1 << (blocks.count() - 1).bit_length())
    sent = blocks.mapInArrow(_count_block(n_buckets), SENT)
    answers = shared_checkpoint(sent.groupBy("bucket").applyInArrow(_add_bucket(filter_bits // 8 // n_buckets), ANSWERS))
    sizes = answers.where("kind = 'size'").agg(F.sum("n").alias("n"), F.sum("distinct").alias("v")).first()
    n_train, n_words = sizes["n"] or 0, sizes["v"] or 0

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        kinds = [arrow_id, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        block = unpacked(block.column("packed")[0].as_py())
        tokens, first = token_hashes(*text_bytes(block.column("text")))
        words, which = np.unique(tokens, return_inverse=True)
        kinds_of, lengths = answer.column("kind").to_pylist(), answer.column("n").to_pylist()
        payloads, packed = answer.column("payload"), answer.column("levels")
        order = np.argsort(answer.column("bucket").to_numpy()).tolist()
        exact = np.concatenate([read_counts(payloads[i].as_py(), lengths[i]) for i in order if kinds_of[i] == "word"])

        def levels(kind: str) -> np.ndarray:
            return np.concatenate([unpacked_levels(packed[i].as_py(), lengths[i]) for i in order if kinds_of[i] == kind])

        denominator = n_train + n_words + 1
        sums = lambda values: np.add.reduceat(values, first[:-1])
        base = np.log10((exact + 1) / denominator)[which]
        unigram = expected_counts(levels("word"))
        pair_of = np.unique(short_ids(pair_hashes(tokens, first)), return_inverse=True)[1]
        pair_counts = expected_counts(levels("pair"))
        before = np.empty(len(tokens), dtype=np.int64)
        before[1:] = which[:-1]
        before[first[:-1]] = np.searchsorted(words, END)
        history = unigram[before]
        single = ((unigram + 1) / denominator)[which]
        share = np.minimum(1.0, pair_counts[pair_of] / np.maximum(history, 1))
        smoothed = np.where(history > 0, pair_weight * share + (1 - pair_weight) * single, single)
        columns = [block.column("doc_id"), pa.array(np.diff(first)), pa.array(sums((exact > 0).astype(np.int64)[which])), pa.array(np.full(len(first) - 1, n_train))]
        columns += [pa.array(sums(base)), pa.array(sums(np.log10(np.minimum(1.0, smoothed))))]
        return pa.table(columns, names=names)

    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in names[1:4]), *(T.StructField(n, T.DoubleType()) for n in names[4:])])
    replies = answers.where("kind <> 'size'").select("block", "bucket", "kind", "n", "payload", "levels")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
