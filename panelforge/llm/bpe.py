"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of the prefix's BPE encoding. The
encoder stores that token for each prefix length, so

* an encoding is read off backwards from the last prefix,
* bytes are appended without touching what is stored (:meth:`PieceEncoder.append`),
* after an edit only prefixes from the edit on are computed anew, and as soon as enough of them agree
  with the old ones the rest is taken over (:meth:`PieceEncoder.splice`).

A token is the valid last one of a prefix if it ends the prefix and is compatible with the valid last
token of what stands before it; two tokens are compatible if merging their joined bytes gives them back.

Ranks come from a file in the tiktoken format; its path is a parameter and it is read on the driver. Text is
split by a pattern first, and a piece that is itself a token is taken whole, as tiktoken does.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, row_groups, text_bytes

#: Distinct pieces and segments whose encoding a worker remembers from one group of texts to the next, and the bytes of
#: these and of their encodings.
CACHE_PIECES = 300_000
CACHE_BYTES = 64_000_000
#: Bytes of text that are encoded together.
GROUP_BYTES = 2_000_000
#: Token pairs whose compatibility a worker remembers.
CACHE_PAIRS = 1_500_000
#: Patterns under which a blank with no white space beside it always begins a piece.
BLANK_BEGINS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)


class Vocabulary:
    """Ranks of byte strings with what the encoder derives from them."""

    def __init__(self, ranks: dict[bytes, int], cache_pairs: int = CACHE_PAIRS):
        import ahocorasick

        self.cache_pairs = cache_pairs

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        automaton = ahocorasick.Automaton()
        for token in sorted(ranks, key=ranks.__getitem__):
            rank = ranks[token]
            if len(token) == 1:
                self.parts[rank] = None
            else:
                pieces = merge(token, ranks, below=rank)
                if len(pieces) != 2:
                    continue  # merging never makes this token, so only a whole piece can be it
                self.parts[rank] = (ranks[pieces[0]], ranks[pieces[1]])
            automaton.add_word(token.decode("latin-1"), (len(token), rank))
        automaton.make_automaton()
        self.automaton = automaton
        self.joined = {pair: rank for rank, pair in self.parts.items() if pair}
        self.pairs: dict[int, bool] = {}  # by left << 32 | right

    @classmethod
    def parse(cls, data: bytes, cache_pairs: int = CACHE_PAIRS) -> Vocabulary:
        """From the content of a file with lines of a base64 token, a blank and its rank."""
        lines = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, cache_pairs)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two tokens.

        Going back in time from the finished tokens, the later of the two merges next to the boundary is
        undone, again and again. In no such state may a merge across the boundary come before the merge
        that was undone last. Of equal ranks the leftmost merges first, so one on the left of the boundary
        goes before one across it, and one across it before one on the right.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        parts, joined = self.parts, self.joined
        until = float("inf")
        good = True
        while True:
            across = joined.get((left, right))
            if across is not None and across < until:
                good = False
                break
            of_left, of_right = parts[left], parts[right]
            if of_right is not None and (of_left is None or right >= left):
                until, right = right + 0.5, of_right[0]
            elif of_left is not None:
                until, left = left, of_left[1]
            else:
                break
        if len(self.pairs) >= self.cache_pairs:
            self.pairs.clear()
        self.pairs[key] = good
        return good


def merge(data: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Plain BPE: join the adjacent pair of lowest rank, leftmost first, while its rank is under ``below``."""
    pieces = [data[i : i + 1] for i in range(len(data))]
    while len(pieces) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(pairwise(pieces)))
        if best >= below:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


class PieceEncoder:
    """The valid last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.size: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; what is stored for earlier prefixes stays valid."""
        start = len(self.data)
        self.data += data
        extend(self.vocabulary, self.data, start, self.last, self.size)

    def splice(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes ``start`` to ``end``. Returns how many prefixes were computed anew.

        Once as many consecutive prefixes as the longest token has bytes agree with the old ones at the
        same distance from the end, all later ones do, as each depends on no more than those before it.
        """
        old_last, old_size = self.last, self.size
        text = self.data[:start] + data + self.data[end:]
        shift = len(text) - len(self.data)
        self.last, self.size = old_last[:start], old_size[:start]
        agreed, at = 0, start
        while at < len(text):
            extend(self.vocabulary, text, at, self.last, self.size, at + 1)
            same = at >= start + len(data) and self.last[at] == old_last[at - shift]
            agreed = agreed + 1 if same else 0
            at += 1
            if agreed >= self.vocabulary.longest:
                self.last += old_last[at - shift :]
                self.size += old_size[at - shift :]
                break
        self.data = text
        return at - start

    def tokens(self) -> list[int]:
        return read_back(self.last, self.size)


def extend(vocabulary: Vocabulary, text: bytes, start: int, last: list[int], size: list[int], stop: int | None = None) -> None:
    """Add to ``last`` and ``size`` the valid last token and its length for the prefixes that end from ``start`` on, up to ``stop``."""
    compatible, known = vocabulary.compatible, vocabulary.pairs.get
    begin = max(0, start - vocabulary.longest)
    done = start - begin - 1
    # The automaton gives the tokens that end at each byte, longest first.
    for end, (length, token) in vocabulary.automaton.iter(text[begin:stop].decode("latin-1")):
        if end <= done:
            continue
        before = begin + end - length
        if before >= 0:
            left = last[before]
            good = known(left << 32 | token)
            if not (compatible(left, token) if good is None else good):
                continue
        last.append(token)
        size.append(length)
        done = end


def read_back(last: list[int], size: list[int]) -> list[int]:
    out, at = [], len(last) - 1
    while at >= 0:
        out.append(last[at])
        at -= size[at]
    out.reverse()
    return out


def encode_pieces(vocabulary: Vocabulary, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
    """Ids of distinct pieces: a piece that is a token is that token; else by prefix dynamic programming.

    In sorted order neighbours share prefixes, and what is stored for a shared prefix is used again.
    """
    out: dict[bytes, list[int]] = {}
    old, last, size = b"", [], []
    for data in sorted(pieces):
        whole = vocabulary.ranks.get(data)
        if whole is not None:
            out[data] = [whole]
            continue
        shared = 0
        for a, b in zip(old, data, strict=False):
            if a != b:
                break
            shared += 1
        del last[shared:], size[shared:]
        extend(vocabulary, data, shared, last, size)
        out[data] = read_back(last, size)
        old = data
    return out


def _touches_space(segment: str) -> bool:
    """Whether what lies between two blanks is empty, or begins or ends with white space."""
    return not segment or segment[0].isspace() or segment[-1].isspace()


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Text to ids and back.

    Under a pattern of :data:`BLANK_BEGINS`, what lies between two blanks that begin pieces is encoded on its own, blank
    included, and remembered (``segments``), as are pieces. Under any other pattern a text is split whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, cache_pieces: int | None = None, cache_bytes: int | None = None):
        import regex

        self.cache_pieces, self.cache_bytes = cache_pieces, cache_bytes

        self.vocabulary = vocabulary
        matches = regex.compile(pattern).finditer
        self.find = lambda text: [m.group() for m in matches(text)]  # whole matches, also of a pattern with groups
        self.cuts = pattern in BLANK_BEGINS
        self.pieces: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.held = 0  # bytes of both
        size = max(vocabulary.tokens) + 1
        self.table: list[bytes] = [vocabulary.tokens.get(i, b"") for i in range(size)]
        self.gaps = len(vocabulary.tokens) < size

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        known, pieces = self.segments, self.pieces
        most = CACHE_PIECES if self.cache_pieces is None else self.cache_pieces
        for memory in (known, pieces):
            if len(memory) > most:
                for old in list(memory)[: len(memory) - most // 2]:  # the oldest go
                    self.held -= len(old) + len(memory.pop(old))
        if self.held > (CACHE_BYTES if self.cache_bytes is None else self.cache_bytes):
            known.clear()
            pieces.clear()
            self.held = 0
        if not self.cuts:
            return [self._chunk(text) for text in texts]
        split = [text.split(" ") for text in texts]
        new = {s for segments in split for s in segments[1:] if s not in known}
        new = {s: self.find(" " + s) for s in new if not _touches_space(s)}
        self._learn(p for found in new.values() for p in found)
        for segment, found in new.items():
            known[segment] = packed = b"".join([pieces[p] for p in found])
            self.held += len(segment) + len(packed)
        out = []
        for text, (head, *rest) in zip(texts, split, strict=True):
            try:
                if rest and _touches_space(head):
                    raise KeyError
                out.append(self._chunk(head) + b"".join(map(known.__getitem__, rest)))
            except KeyError:
                out.append(self._joined(head, rest))
        return out

    def _joined(self, head: str, rest: list[str]) -> bytes:
        """For texts with longer runs of white space: those stay inside a chunk."""
        out, chunk = [], [head]
        for segment in rest:
            if chunk[-1] and not chunk[-1][-1].isspace() and segment and not segment[0].isspace():
                out.append(self._chunk("".join(chunk)))
                chunk = [" ", segment]
            else:
                chunk += [" ", segment]
        out.append(self._chunk("".join(chunk)))
        return b"".join(out)

    def _chunk(self, text: str) -> bytes:
        found = self.find(text)
        self._learn(found)
        return b"".join(map(self.pieces.__getitem__, found))

    def _learn(self, pieces: Iterable[str]) -> None:
        new = {p.encode("utf-8", "surrogatepass"): p for p in pieces if p not in self.pieces}
        for data, ids in encode_pieces(self.vocabulary, new).items():
            self.pieces[new[data]] = packed = _pack(ids)
            self.held += len(new[data]) + len(packed)

    def packed(self, text: str) -> bytes:
        return self.packed_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that the vocabulary lacks is an error."""
        ids = list(ids)
        data = b"".join(map(self.table.__getitem__, ids))
        if self.gaps and any(not self.table[i] for i in ids):
            raise ValueError("unknown token id")
        return data


_ENCODERS: dict[tuple[bytes, str, float], Encoder] = {}


def encoder(data: bytes, pattern: str, memory: float = 1.0) -> Encoder:
    """The encoder of a rank file's content, made once in each Python process; ``memory`` is the share of what it may remember by default."""
    key = (hashlib.sha256(data).digest(), pattern, memory)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary.parse(data, int(CACHE_PAIRS * memory)), pattern, int(CACHE_PIECES * memory), int(CACHE_BYTES * memory))
    return _ENCODERS[key]


OUTPUT = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: Iterable[str] = ("doc_id",), with_ids: bool = True, memory: float = 1.0
) -> DataFrame:
    """Encode the column ``text`` and decode the ids again.

    Adds ``ids`` (little-endian unsigned 32-bit integers; left out if ``with_ids`` is false), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` (lowercase hex). One row for each input row, repeated rows included;
    an empty table gives an empty table. A null or empty text has no ids and the hashes of no bytes. Texts of
    any length are encoded whole, and memory grows with the longest piece rather than with the corpus.
    The rank file, of a fixed size, is read on the driver and sent to the workers. ``memory`` scales what a worker remembers between
    texts, some 300 MB by default; it costs or saves time and changes no result.
    """
    with open(ranks_path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())
    added = OUTPUT if with_ids else T.StructType(OUTPUT.fields[1:])

    def compute():
        own = encoder(ranks.value, pattern, memory)

        def function(columns):
            ids, counts, hashes, decoded = [], [], [], []
            _, offsets = text_bytes(columns[0])
            for start, end in row_groups(offsets, GROUP_BYTES):
                texts = [value or "" for value in columns[0][start:end].to_pylist()]
                for packed in own.packed_many(texts):
                    numbers = np.frombuffer(packed, dtype="<u4").tolist()
                    counts.append(len(numbers))
                    hashes.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(numbers)).hexdigest())
                    if with_ids:
                        ids.append(packed)
            return [ids, counts, hashes, decoded] if with_ids else [counts, hashes, decoded]

        return function

    return add_columns(df, carry, [text], added, compute)
