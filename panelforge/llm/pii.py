"""Personal data: patterns, and information-theoretic sanitisation of what else reveals them.

Base entities (e-mail and IP addresses, payment cards, phone numbers) are found by pattern in whole texts. Then
corpus co-occurrence says which other terms reveal them. Protected are each single entity, such as one person's
address wherever it stands, and each kind of them. A term is in the context of an entity if it stands within ``window`` terms
of it. Over all documents, and over the terms outside entities only,

    information(entity) = -log2 P(a term is in the entity's context)
    disclosure(term, entity) = log2 P(in the entity's context | the term) + information(entity),

the pointwise mutual information of the two. A term that occurs in that context alone discloses all of the entity's
information. Terms whose disclosure is at least ``alpha`` times the information exceed the threshold, however rare they
are (unless ``support`` asks for more documents). Where they stand in the context of the entity in a document,
sanitising replaces them: by the kind's general name below full disclosure, by nothing at full disclosure.
Documents without an entity are left alone.

Counting: documents with an entity are written to the shared folder once. Their terms and entities are counted exactly; a
Bloom filter of a fixed size (``filter_bits``), made of the terms with enough support, then says which words of the corpus
need a total count at all; words that pass by chance are counted, too, and change nothing. So what is broadcast has a
fixed bound and every count covers all documents. What discloses stays a table: a document's terms and entities are joined
with it, and what they find goes to the document, whose number is its own.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, in_parts, join_counted, let_workers_import, shared_checkpoint, shared_table

KINDS = ("email", "ip", "card", "phone")
#: An address is four parts of such a run: digits are taken whole, so matches are the fours from its beginning on.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: E-mail addresses are searched from their at sign: from every possible first character, a long word would take
#: time with the square of its length.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\W_]+")
#: Terms on each side of an entity that are its context.
WINDOW = 100


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base entities, sorted; code points, end exclusive."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in four):
                spans.append((at, 1, end))
            at = end + 1
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """The pieces of a text between its entities, each with its start."""
    pieces, done = [], 0
    for start, _, end in spans:
        if start > done:
            pieces.append((done, text[done:start]))
        done = max(done, end)
    pieces.append((done, text[done:]))
    return pieces


def entity_id(text: str, span: tuple[int, int, int]) -> int:
    """A number for the entity itself, however it is written; the numbers of the kinds are 0 to 3."""
    import xxhash

    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else "".join(c for c in text[start:end] if "0" <= c <= "9")
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()) >> 1 | 4  # a positive long


def context_terms(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> list[tuple[int, int, str, int, int]]:
    """(start, end, term, entity, kind number) of the terms within ``window`` terms of an entity, and the same for its kind.

    Terms are the lower-cased runs of letters and digits outside all entities that are not numbers.
    """
    terms = [(at + m.start(), at + m.end(), m.group().lower()) for at, piece in outside(text, spans) for m in TERM.finditer(piece) if not m.group().isdecimal()]
    starts = [a for a, _, _ in terms]
    near: dict[tuple[int, int], set[int]] = {}
    for span in spans:
        start, kind, end = span
        # Terms do not overlap entities: so many begin before this one, and so many before its end.
        low, high = max(0, bisect.bisect_left(starts, start) - window), bisect.bisect_left(starts, end) + window
        for entity in (kind, entity_id(text, span)):
            near.setdefault((entity, kind), set()).update(range(low, min(high, len(terms))))
    return sorted((*terms[i], entity, kind) for (entity, kind), places in near.items() for i in places)


def term_hashes(terms: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t.encode("utf-8", "surrogatepass")) for t in terms], dtype=np.uint64)


def bit_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes >> np.uint64(29))
    return [(x % np.uint64(bits)).astype(np.int64) for x in (hashes, mixed, hashes ^ (mixed >> np.uint64(17)))]


def values_of(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts of a batch's first column, made a part of the batch at a time."""
    return (value for part in in_parts(batch) for value in part.column(0).to_pylist())


def entity_documents(df: DataFrame, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with an entity, each with a number ``uid``, as a table in the shared folder; and the other rows.

    Both have ``text`` and the columns of ``carry`` as ``k0``, ``k1`` and so on.
    """
    named = [f"k{i}" for i in range(len(carry))]
    plain = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carry, named, strict=True)], F.col(f"`{text}`").alias("text"))

    def compute():
        return lambda columns: [[bool(value) and bool(base_spans(value)) for value in columns[0].to_pylist()]]

    marked = add_columns(plain, [*named, "text"], ["text"], T.StructType([T.StructField("has", T.BooleanType())]), compute)
    own, _ = shared_table(marked.where("has").drop("has").withColumn("uid", F.monotonically_increasing_id()))
    return own, marked.where("not has").drop("has")


def disclosing_terms(
    df: DataFrame, window: int = WINDOW, alpha: float = 0.9, support: int = 1, text: str = "text", filter_bits: int = 1 << 23, own: DataFrame | None = None
) -> DataFrame:
    """``term``, ``entity``, ``kind`` (its number), ``disclosure``, ``full`` and ``documents`` of the terms over the threshold.

    ``full`` says that the term stands in the entity's contexts alone, ``documents`` how many have it there. Counts cover all
    documents; ``own`` are those with an entity, if they are known. An empty table, or one without entities, gives an
    empty result.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    texts = df.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    own = entity_documents(df, text, [])[0] if own is None else own

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int, int]] = Counter()
            documents: Counter[tuple[str, int, int]] = Counter()
            for value in values_of(batch):
                found = Counter((term, entity, kind) for _, _, term, entity, kind in context_terms(value, base_spans(value), window))
                counts.update(found)
                documents.update(found.keys())
            if counts:
                terms, entities, kinds = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms), pa.array(entities, pa.int64()), pa.array(kinds, pa.int32()), pa.array(counts.values(), pa.int64()), pa.array([documents[k] for k in counts], pa.int64())],
                    names=["term", "entity", "kind", "n", "documents"],
                )

    near = own.select("text").mapInArrow(contexts, "term string, entity long, kind int, n long, documents long")
    near = shared_checkpoint(near.groupBy("term", "entity", "kind").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    wanted = near.where(F.col("documents") >= support)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(filter_bits // 8, dtype=np.uint8)
        for batch in batches:
            for places in bit_places(term_hashes(batch.column(0).to_pylist()), filter_bits):
                np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(filter_bits // 8, dtype=np.uint8)
    for row in wanted.select("term").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], dtype=np.uint8)
    if not bits.any():  # no term has the support, so none can exceed the threshold
        return spark.createDataFrame([], "term string, entity long, kind int, disclosure double, full boolean, documents long")
    sent = spark.sparkContext.broadcast(bits)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            written_as: Counter[str] = Counter()
            for value in values_of(batch):
                for _, piece in outside(value, base_spans(value)):
                    written_as.update(TERM.findall(piece))
            counts: Counter[str] = Counter()
            for term, n in written_as.items():
                counts[term.lower()] += n
            terms = list(counts)
            good = np.ones(len(terms), dtype=bool)
            if terms:
                for places in bit_places(term_hashes(terms), len(known) * 8):
                    good &= (known[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            kept = [terms[i] for i in np.flatnonzero(good)]
            # The row without a term has the number of all terms.
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *kept], pa.string()), pa.array([counts.total(), *map(counts.__getitem__, kept)], pa.int64())], names=["term", "total"]
            )

    counted = texts.mapInArrow(totals, "term string, total long").groupBy("term").agg(F.sum("total").alias("total"))
    counted = shared_checkpoint(counted)
    row = counted.where("term is null").select("total").first()
    words = max(1, row["total"] if row else 0)
    # A common word is near many entities and a common entity near many words: neither is one task's work.
    rows = wanted.count()
    by_term = counted.join(wanted.groupBy("term").agg(F.count("*").alias("rows")), "term")
    by_entity = near.groupBy("entity").agg(F.sum("n").alias("inside"), F.count_if(F.col("documents") >= support).alias("rows"))
    by_entity = by_entity.select("entity", (-F.log2(F.least(F.lit(1.0), F.col("inside") / words))).alias("information"), "rows")
    scored = join_counted(join_counted(wanted, by_term, "term", "rows", rows), by_entity, "entity", "rows", rows)
    scored = scored.withColumn("disclosure", F.log2(F.least(F.lit(1.0), F.col("n") / F.col("total"))) + F.col("information"))
    scored = scored.where((F.col("disclosure") >= alpha * F.col("information")) & (F.col("information") > 0))
    return shared_checkpoint(scored.select("term", "entity", "kind", "disclosure", (F.col("n") >= F.col("total")).alias("full"), "documents"))


SPANS = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("sanitised", T.StringType())]
)


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def sanitise(text: str, spans: list[tuple[int, int, int]], terms: dict[tuple[int, int], str]) -> str:
    """The text with entities replaced by their kind and disclosing terms by what ``terms`` gives for them."""
    pieces, done = [], 0
    for start, kind, end in sorted([*spans, *((a, 4, b) for a, b in terms)], key=lambda s: (s[0], -s[2])):
        if end <= done:
            continue
        pieces.append(text[done : max(start, done)])
        pieces.append(f"[{KINDS[kind].upper()}]" if kind < 4 else terms[start, end])
        done = end
    pieces.append(text[done:])
    return "".join(pieces)


def find_personal_data(
    df: DataFrame, window: int = WINDOW, alpha: float = 0.9, support: int = 1, text: str = "text", carry: Iterable[str] = ("doc_id",), with_text: bool = True
) -> DataFrame:
    """Add ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_spans``, ``spans`` and ``sanitised`` to each row.

    Spans are written kind:start:end, by start and then kind as in :data:`KINDS` with ``term`` last, joined by commas;
    offsets are code points, ends exclusive. A term that discloses any entity fully is removed, else generalised to the first
    kind that it discloses. ``sanitised`` is left out unless ``with_text``; of a null text it is null.
    Null and empty texts have no spans. One row for each input row, repeated rows included, which count as often
    as they stand in the corpus. Carried columns of these names are replaced. An empty table gives an empty one.
    """
    added = SPANS if with_text else T.StructType(SPANS.fields[:-1])
    names = {f.name.lower() for f in added}
    carry = [c for c in dict.fromkeys(carry) if c.lower() not in names]
    own, others = entity_documents(df, text, carry)
    terms = disclosing_terms(df, window, alpha, support, text, own=own)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                uids, found, entities = [], [], []
                for uid, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for term, entity in {(term, entity) for _, _, term, entity, _ in context_terms(value, base_spans(value), window)}:
                        uids.append(uid)
                        found.append(term)
                        entities.append(entity)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(found, pa.string()), pa.array(entities, pa.int64())], names=["uid", "term", "entity"])

    # The rows of a pair are as many as the documents that have it.
    rows = terms.agg(F.sum("documents")).first()[0] or 0
    held = own.select("uid", "text").mapInArrow(entries, "uid long, term string, entity long")
    chosen = join_counted(held, terms.select("term", "entity", "full", "documents"), ["term", "entity"], "documents", rows)
    chosen = chosen.groupBy("uid").agg(F.collect_list(F.struct("term", "entity", "full")).alias("terms"))
    named = [f"k{i}" for i in range(len(carry))]
    marked = add_columns(own.join(chosen, "uid", "left"), named, ["text", "terms"], added, _marker(window, with_text))
    plain = others.select(
        *named, *[F.lit(0).cast("long").alias(f"n_{kind}") for kind in KINDS], F.lit("").alias("base_spans"), F.lit("").alias("spans"), *([F.col("text").alias("sanitised")] if with_text else [])
    )
    both = marked.unionByName(plain)
    return both.select(*[F.col(k).alias(c) for k, c in zip(named, carry, strict=True)], *[f.name for f in added])


def _marker(window: int, with_text: bool):
    def compute():
        def function(columns):
            counts: list[list[int]] = [[] for _ in KINDS]
            base, every, clean = [], [], []
            for value, own in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                spans = base_spans(value)
                known = {(t["term"], t["entity"]): t["full"] for t in own or ()}
                terms: dict[tuple[int, int], str] = {}
                for a, b, term, entity, kind in sorted(context_terms(value, spans, window), key=lambda t: (t[0], t[4])) if known else ():
                    full = known.get((term, entity))
                    if full is not None:
                        terms[a, b] = "" if full or terms.get((a, b)) == "" else terms.get((a, b), f"[{KINDS[kind].upper()} CONTEXT]")
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in spans))
                base.append(written(spans))
                every.append(written([*spans, *((a, 4, b) for a, b in terms)]))
                if with_text:
                    clean.append(sanitise(value, spans, terms))
            return [*counts, base, every, clean] if with_text else [*counts, base, every]

        return function

    return compute
