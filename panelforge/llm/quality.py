"""Quality classifier: a byte-level convolutional network in numpy.

Each byte of a document's UTF-8 text becomes a vector: ``LEARNED`` learned components, and for each of ``ECHOES`` one that
says whether the bytes from here on stood just before as well, since no linear filter sees that text repeats itself.
Overlapping chunks of ``WIDTH`` bytes begin every ``STRIDE`` bytes and cover the text to its end, where zeros fill up
the last ones. A filter has one weight for each place of a chunk and each component of the vector there, so it answers
to bytes in their order. The filters' rectified answers are max-pooled over the document and a logistic layer makes one
probability of them.

A text of any length takes the same path: its chunks are answered piece by piece and the maxima carried on, so working
memory beside the text and one byte of echoes for each of its bytes does not grow with it.

The network is fitted on the driver on a sample of labelled rows, bounded by ``max_rows`` and by ``max_bytes`` for all its
texts together; scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, text_bytes

STRIDE = 4
WIDTH = 16
SPAN = WIDTH // STRIDE
#: Bytes that must agree, and how far back at most.
ECHOES = ((3, 32), (8, 64))
LEARNED = 6
SIZE = LEARNED + len(ECHOES)
PAD = 256
#: Bytes whose chunks are answered at once.
PIECE_BYTES = 131_072
#: Rows of the fitting sample, and bytes of its texts together.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64_000_000


def echoes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte a bit for each of ``ECHOES``; a document's bytes are compared with its own alone."""
    out = np.zeros(len(raw), dtype=np.uint8)
    most, farthest = max(n for n, _ in ECHOES), max(back for _, back in ECHOES)
    for start in range(0, len(raw), PIECE_BYTES):
        stop = min(len(raw), start + PIECE_BYTES)
        before = min(start, farthest)
        data = np.zeros(before + stop - start + most, dtype=np.uint64)
        part = raw[start - before : stop + most]
        data[: len(part)] = part
        cut = np.diff(np.clip(offsets, start, stop))
        place = np.arange(start, stop) - np.repeat(offsets[:-1], cut)
        room = np.repeat(offsets[1:], cut) - np.arange(start, stop)
        place = np.minimum(place, 255).astype(np.uint8)
        for bit, (n, back) in enumerate(ECHOES):
            grams = np.zeros(before + stop - start, dtype=np.uint64)
            for i in range(n):
                grams |= data[i : i + len(grams)] << np.uint64(8 * i)
            if n <= 4:
                grams = grams.astype(np.uint32)
            found = np.zeros(stop - start, dtype=bool)
            for lag in range(1, min(back + 1, len(grams))):
                low = max(0, lag - before)  # the first block has nothing before it
                same = grams[before + low :] == grams[before + low - lag : len(grams) - lag]
                found[low:] |= same & (place[low:] >= lag)
            out[start:stop] |= (found & (room >= n)).astype(np.uint8) << bit
    return out


def layout(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols laid end to end with pads between, and the first chunk of each part and the one after its last."""
    # What a piece has beyond PIECE_BYTES begins no chunk of its own.
    chunks = np.array([max(1, -(-min(len(p), PIECE_BYTES) // STRIDE)) for p in parts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(chunks + SPAN - 1)))
    padded = np.full(int(begin[-1]) * STRIDE, PAD, dtype=np.int64)
    for part, at in zip(parts, (begin[:-1] * STRIDE).tolist(), strict=True):
        padded[at : at + len(part)] = part  # a gap has room for what goes beyond
    return padded, begin[:-1], begin[:-1] + chunks


def pieces(symbols: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Documents (their numbers, and their symbols) in groups of about ``PIECE_BYTES``; a long one in several groups.

    A piece ends with what its last chunks need of the next piece.
    """
    owners: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for number, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(start, max(start + 1, end), PIECE_BYTES):
            part = symbols[at : min(end, at + PIECE_BYTES + WIDTH - STRIDE)]
            owners.append(number)
            parts.append(part)
            held += len(part)
            if held >= PIECE_BYTES:
                yield owners, parts
                owners, parts, held = [], [], 0
    if owners:
        yield owners, parts


def symbols_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers that stand for a byte and its echoes; ``PAD`` is one more, and they leave a gap for it."""
    found = echoes(raw, offsets).astype(np.uint16)
    return raw + found * np.uint16(PAD + 1)


@dataclass
class ConvNet:
    """Learned ``vectors`` of the bytes and the pad, ``kernels`` (place x component, filter), biases and the logistic layer."""

    vectors: np.ndarray
    kernels: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def table(self) -> np.ndarray:
        """The vector of each symbol."""
        rows = [np.concatenate((self.vectors, np.tile([float(n >> bit & 1) for bit in range(len(ECHOES))], (PAD + 1, 1))), axis=1) for n in range(1 << len(ECHOES))]
        return np.concatenate(rows).astype(np.float32)

    def answers(self, padded: np.ndarray, table: np.ndarray) -> np.ndarray:
        """What each filter says to each chunk, before it is rectified."""
        blocks = table[padded].reshape(-1, STRIDE * SIZE)
        rows = len(blocks) - SPAN + 1
        slabs = self.kernels.reshape(SPAN, STRIDE * SIZE, -1)
        out = blocks[:rows] @ slabs[0] + self.bias
        for place in range(1, SPAN):
            out += blocks[place : place + rows] @ slabs[place]
        return out

    def pooled(self, parts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        padded, first, last = layout(parts)
        out = self.answers(padded, table)
        bounds = np.stack((first, last), axis=1).ravel()
        if bounds[-1] >= len(out):  # reduceat takes no end of the array
            bounds = bounds[:-1]
        return np.maximum(np.maximum.reduceat(out, bounds, axis=0)[::2], 0)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability for each document; each depends on its own bytes alone."""
        best = np.zeros((len(offsets) - 1, len(self.weights)), dtype=np.float32)
        table = self.table()
        for owners, parts in pieces(symbols_of(raw, offsets), offsets):
            np.maximum.at(best, owners, self.pooled(parts, table))
        return 1 / (1 + np.exp(-np.clip((best @ self.weights).astype(np.float64) + self.offset, -30, 30)))


def fit(texts: list[bytes], labels: list[int], n_filters: int = 32, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ConvNet:
    """Fit by Adam on the cross-entropy; the gradient of a max goes to the chunk that has it.

    Chunks are answered batch by batch and long texts in pieces, so memory holds the texts and little more. With one
    class only, or none, the network answers with that class's share (one half for none).
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    vectors = (rng.standard_normal((PAD + 1, LEARNED)) * 0.5).astype(np.float32)
    vectors[PAD] = 0
    kernels = (rng.standard_normal((WIDTH * SIZE, n_filters)) * 0.1).astype(np.float32)
    net = ConvNet(vectors, kernels, np.zeros(n_filters, np.float32), np.zeros(n_filters, np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        return net
    net.weights = (rng.standard_normal(n_filters) * 0.3).astype(np.float32)
    offset = np.array([net.offset], np.float32)
    state = [net.vectors, net.kernels, net.bias, net.weights, offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    data = [symbols_of(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)])) for t in texts]
    step, total = 0, epochs * -(-len(y) // batch)
    within = np.arange(WIDTH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            own = [data[i] for i in docs]
            ends = np.concatenate(([0], np.cumsum([len(t) for t in own])))
            best = np.zeros((len(docs), n_filters), dtype=np.float32)
            seen = np.full((len(docs), n_filters, WIDTH), PAD, dtype=np.int64)  # the symbols of the best chunks
            table = net.table()
            for owners, parts in pieces(np.concatenate(own), ends):
                padded, first, last = layout(parts)
                out = net.answers(padded, table)
                for owner, a, b in zip(owners, first.tolist(), last.tolist(), strict=True):
                    top = out[a:b].argmax(axis=0)
                    values = out[a:b][top, np.arange(n_filters)]
                    new = np.flatnonzero(values > best[owner])
                    best[owner, new] = values[new]
                    seen[owner, new] = padded[((a + top[new]) * STRIDE)[:, None] + within]
            p = 1 / (1 + np.exp(-np.clip(best @ net.weights + offset[0], -30, 30)))
            error = (p - y[docs]) / len(docs)
            back = np.outer(error, net.weights) * (best > 0)
            chosen = table[seen].reshape(len(docs), n_filters, WIDTH * SIZE)
            grad_kernels = np.einsum("bf,bfk->kf", back, chosen)
            grad_vectors = np.zeros_like(net.vectors)
            np.add.at(grad_vectors, seen % (PAD + 1), back[:, :, None, None] * net.kernels.T.reshape(n_filters, WIDTH, SIZE)[:, :, :LEARNED])
            grad_vectors[PAD] = 0
            grads = [grad_vectors, grad_kernels + 1e-4 * net.kernels, back.sum(axis=0), best.T @ error + 1e-3 * net.weights, np.array([error.sum()], np.float32)]
            step += 1
            now = rate * (1 - step / (total + 1))
            for value, g, (m, v) in zip(state, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.offset = float(offset[0])
    return net


def train(
    documents: DataFrame,
    labels: DataFrame,
    usable: str | None = None,
    max_rows: int = SAMPLE_ROWS,
    max_bytes: int = SAMPLE_BYTES,
) -> ConvNet:
    """Fit on at most ``max_rows`` labelled documents whose texts have at most ``max_bytes`` bytes together.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; others, and null, are left out, as are ids with both);
    ``usable``, a SQL predicate on ``doc_id``, says which may be learned from. Ids come in the order of a hash; of
    several texts of one id the least by its hash counts, so that every run has the same sample. Texts are taken in
    that order, whatever their length, until the next one would pass ``max_bytes``. Only the bounded list of ids is
    broadcast, and texts reach the driver one partition of the sample after another.
    """
    rows = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    if usable:
        rows = rows.where(usable)
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = F.coalesce("text", F.lit(""))
    own = documents.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    texts, qualities, total = [], [], 0
    for row in own.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        data = row["text"].encode("utf-8", "surrogatepass")
        total += len(data)
        if total > max_bytes:
            break
        texts.append(data)
        qualities.append(row["quality"])
    return fit(texts, qualities)


OUTPUT = T.StructType([T.StructField("score", T.DoubleType())])


def score_documents(df: DataFrame, net: ConvNet, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Add ``score``, the probability that a document is good, from the whole of ``text``.

    One row for each input row, repeated rows included; the score depends on the text alone. A null text
    counts as the empty one, which gets the network's answer for one chunk of zeros. An empty table stays empty. A
    carried column called ``score`` is replaced.
    """

    def compute():
        return lambda columns: [net.score(*text_bytes(columns[0]))]

    return add_columns(df, carry, [text], OUTPUT, compute)


def classify_documents(
    df: DataFrame, net: ConvNet, threshold: float = 0.3, text: str = "text", carry: Iterable[str] = ("doc_id",)
) -> DataFrame:
    """As :func:`score_documents`, and ``predicted``: 1 where the score reaches ``threshold``, else 0."""
    scored = score_documents(df, net, text, carry)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
