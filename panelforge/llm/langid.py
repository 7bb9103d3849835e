"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; runs of anything but letters become one space. Every document of the training rows adds its
4-grams to its language's counts, which are summed over all tasks. Lower orders use continuation counts, that is, how
many different characters precede an n-gram. A language's n-grams and contexts stand in sorted arrays of 64-bit
hashes (four characters of 16 bits each, so different n-grams of the first 65,536 code points never clash), with
their interpolated probabilities and back-off weights beside them. The language with the lowest cross-entropy per
character wins.

Rejection is calibrated on text that its model has not seen: models of nine tenths of the training documents (by a hash of
their text) score the rest. How far a text lies over its language's own cross-entropy is measured in standard errors of
its length; the limit of a language is what only a share ``reject`` of its calibration texts exceeds, or of all
languages' together where it has too few. A text over its language's limit is marked as rejected.

Every n-gram of every language stays in the model, whose arrays grow with the distinct n-grams of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, let_workers_import, row_groups, shared_checkpoint, text_bytes

ORDER = 4
GROUP_BYTES = 1_000_000
UNKNOWN = "und"
#: One in so many training documents calibrates; a language with fewer of them than FEWEST takes the limit of all together.
PARTS = 10
FEWEST = 20
DEFAULT_LIMIT = 8.0

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, its symbol: 0 unless it is a letter; made once in each process."""
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=np.uint16)
        for code in range(0x110000):
            if chr(code).isalpha():
                table[code] = code & 0xFFFF or 1
        _LETTERS.append(table)
    return _LETTERS[0]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, one for each symbol, and the first of each text; a text without letter has none."""
    lowered = [t.lower() for t in texts]
    # A space before and after each text.
    codes = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 2 for t in lowered], dtype=np.int64)
    symbols = letters()[codes]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    keep = symbols != 0
    keep[1:] |= keep[:-1]  # the space that ends a word stays
    keep[begin[:-1]] = True
    kept = np.cumsum(keep)
    symbols = symbols[keep].astype(np.uint64)
    first = np.concatenate(([0], kept[begin[1:] - 1]))
    # The leading space is context only; before it stands nothing but spaces.
    n = len(symbols)
    owner_start = np.repeat(first[:-1], np.diff(first))
    place = np.arange(n) - owner_start
    grams = symbols.copy()
    for back in range(1, ORDER):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[back:] = symbols[:-back] << np.uint64(16 * back)
        shifted[place < back] = 0
        grams |= shifted
    real = place > 0
    return grams[real], np.concatenate(([0], np.cumsum(np.diff(first) - 1)))


@dataclass
class Model:
    """Sorted hash arrays: for each order the n-grams with log probabilities, and contexts with log back-off weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    mean: float
    spread: float
    limit: float = DEFAULT_LIMIT

    def excess(self, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Standard errors by which texts of so many characters lie over the language's own cross-entropy."""
        return (entropy - self.mean) * np.sqrt(size) / max(self.spread, 1e-9)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms for packed 4-grams: the longest known n-gram, with the weights of the contexts over it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            keys = grams[left] & np.uint64((1 << 16 * order) - 1)
            at, hit = _find(self.grams[order - 1], keys)
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left, keys = left[~hit], keys[~hit] >> np.uint64(16)
            at, hit = _find(self.contexts[order - 1], keys)
            out[left[hit]] += self.weights[order - 1][at[hit]]
        out[left] += self.floor
        return out


def _find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(array):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(array, keys), len(array) - 1)
    return at, array[at] == keys


def kneser_ney(grams: np.ndarray, counts: np.ndarray, symbols: int) -> Model:
    """From a language's distinct packed 4-grams and their counts; ``symbols``: how many there are in all languages."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(np.float64)
    levels = [(grams, counts)]
    for n in range(ORDER - 1, 0, -1):
        shorter, continuation = np.unique(levels[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
        levels.append((shorter, continuation.astype(np.float64)))
    levels.reverse()
    model = Model([], [], [], [], -np.log(symbols + 1), 0.0, 0.0)
    below = None
    for n, (keys, values) in enumerate(levels, 1):
        ones, twos = (values == 1).sum(), (values == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        contexts, first, which = np.unique(keys >> np.uint64(16), return_index=True, return_inverse=True)
        totals = np.add.reduceat(values, first)
        kinds = np.diff(np.append(first, len(keys)))
        weight = discount * kinds / totals
        if below is None:
            lower = np.full(len(keys), np.exp(model.floor))
        else:
            lower = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 16 * (n - 1)) - 1))]
        p = np.maximum(values - discount, 0) / totals[which] + weight[which] * lower
        model.grams.append(keys)
        model.logs.append(np.log(p))
        model.contexts.append(contexts)
        model.weights.append(np.log(weight))
        below = (keys, p)
    share = counts / counts.sum()
    model.mean = float(-(share * model.logs[-1]).sum())
    model.spread = float(np.sqrt((share * (-model.logs[-1] - model.mean) ** 2).sum()))
    return model


def train(df: DataFrame, text: str = "text", lang: str = "lang", reject: float = 0.005) -> dict[str, Model]:
    """A model for each language of ``df``, from all its rows; rows with a null language or text are left out.

    ``reject`` is the share of calibration texts over a language's limit.
    """
    let_workers_import(df.sparkSession)
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    aside = F.pmod(F.xxhash64("text"), F.lit(PARTS)) == 0
    rows = rows.withColumn("aside", aside)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(which, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for (name, apart), parts in held.items():
                grams, counts = merged(parts)
                none = np.zeros(len(grams), np.int64)
                both = (none, counts) if apart else (counts, none)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), *map(pa.array, both)], names=["lang", "gram", "n", "aside"])
            held.clear()

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            _, offsets = text_bytes(batch.column(1))
            for start, end in row_groups(offsets, GROUP_BYTES):
                texts = batch.column(1)[start:end].to_pylist()
                for name in sorted(set(names[start:end])):
                    grams, _ = grams_of([t for t, other in zip(texts, names[start:end], strict=True) if other == name])
                    found = np.unique(grams, return_counts=True)
                    parts = held.setdefault(name, [])
                    parts.append(found)
                    if len(parts) >= 16:
                        held[name] = [merged(parts)]
            if sum(len(g) for parts in held.values() for g, _ in parts) > 3_000_000:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(count, "lang string, gram long, n long, aside long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("aside").alias("aside"))
    counted = shared_checkpoint(counted)
    names = sorted(row["lang"] for row in counted.select("lang").distinct().collect())
    # One language at a time, so that the names never stand beside the n-grams.
    stored = {}
    for name in names:
        own = counted.where(F.col("lang") == name).select("gram", "n", "aside").toArrow()
        stored[name] = own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy(), own.column("aside").to_numpy()
    last = [np.unique(grams & np.uint64(0xFFFF)) for grams, *_ in stored.values()]
    symbols = len(np.unique(np.concatenate(last))) if last else 0
    seen = {name: kneser_ney(grams[n > 0], n[n > 0], symbols) for name, (grams, n, _) in stored.items() if n.any()}
    limits = calibrate(rows.where("aside").select("lang", "text"), seen, reject)
    models = {}
    for name in names:
        grams, n, apart = stored.pop(name)
        models[name] = kneser_ney(grams, n + apart, symbols)
        models[name].limit = limits.get(name, limits.get(None, DEFAULT_LIMIT))
    return models


def calibrate(rows: DataFrame, models: dict[str, Model], reject: float) -> dict[str | None, float]:
    """The limit of each language with enough of ``rows`` (texts that the models have not seen), and under None that of all.

    A limit is the share ``1 - reject`` of the texts' excess, to a thousandth of their number, but no less than none at all.
    """
    if not models:
        return {}
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def compute():
        own: dict[str, Model] = sent.value

        def function(columns):
            names, texts = (c.to_pylist() for c in columns)
            out: list[float | None] = [None] * len(texts)
            for name in sorted(set(names) & set(own)):
                chosen = [i for i, other in enumerate(names) if other == name]
                grams, first = grams_of([texts[i] for i in chosen])
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                sums = np.add.reduceat(own[name].log_probability(grams), first[:-1][full])
                values = own[name].excess(-sums / sizes[full], sizes[full])
                for i, value in zip(full.tolist(), values.tolist(), strict=True):
                    out[chosen[i]] = value
            return [out]

        return function

    scored = add_columns(rows, ["lang"], ["lang", "text"], T.StructType([T.StructField("excess", T.DoubleType())]), compute)
    limit = F.percentile_approx("excess", 1 - reject, 10_000).alias("limit")
    found = scored.where("excess is not null").rollup("lang").agg(F.count("*").alias("n"), limit, F.grouping("lang").alias("all"))
    return {None if row["all"] else row["lang"]: max(0.0, row["limit"]) for row in found.collect() if row["all"] or row["n"] >= FEWEST}


OUTPUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(
    df: DataFrame, models: dict[str, Model], text: str = "text", carry: Iterable[str] = ("doc_id",)
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1: how far the winner is ahead), ``cross_entropy`` and ``rejected``.

    Whole texts count. A text that is null or has no letter gets ``und``, score 0, a null cross-entropy and is
    rejected, as does any text if there is no model. Of equal languages the first by name wins. A text is rejected,
    too, if it is over its language's limit.
    One row for each input row, repeated rows included.
    """
    names = sorted(models)
    sent = df.sparkSession.sparkContext.broadcast([models[name] for name in names])

    def compute():
        own: list[Model] = sent.value

        def function(columns):
            langs, scores, entropies, rejected = [], [], [], []
            _, offsets = text_bytes(columns[0])
            for start, end in row_groups(offsets, GROUP_BYTES):
                grams, first = grams_of([t or "" for t in columns[0][start:end].to_pylist()])
                sizes = np.diff(first)
                sums = np.zeros((max(1, len(own)), len(sizes)))
                if len(grams) and own:
                    known, which = np.unique(grams, return_inverse=True)
                    full = np.flatnonzero(sizes)
                    for i, model in enumerate(own):
                        sums[i, full] = np.add.reduceat(model.log_probability(known)[which], first[:-1][full])
                entropy = -sums / np.maximum(sizes, 1)
                best = entropy.argmin(axis=0)
                lead = np.exp(-(entropy - entropy.min(axis=0)) * np.minimum(sizes, 40)).sum(axis=0)
                for i, size in enumerate(sizes.tolist()):
                    if size and own:
                        model, value = own[best[i]], float(entropy[best[i], i])
                        langs.append(names[best[i]])
                        scores.append(float(1 / lead[i]))
                        entropies.append(value)
                        rejected.append(bool(model.excess(value, size) > model.limit))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        entropies.append(None)
                        rejected.append(True)
            return [langs, scores, entropies, rejected]

        return function

    return add_columns(df, carry, [text], OUTPUT, compute)
