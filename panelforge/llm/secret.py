"""Secrets: patterns, and random strings that a tokenizer cannot shorten.

Base findings are assignments to names such as ``password``, access keys and long runs of hexadecimal digits. The
token-efficiency test adds what no pattern names: a vocabulary learned from text writes words and names with few tokens, but
random characters with about one token each. A run of the characters that keys are written with is random if it has fewer
characters a token than ``ratio``, or than ``plain_ratio`` if it is of letters alone, where long words of small languages come
closer. Known digests (hexadecimal runs as long as a hash) and identifiers (UUIDs, account numbers with right check digits, times,
versions, document ids, parts of addresses, and what has no letter) are left out first. Where a run as a whole is no secret, its
parts between dots, slashes and equals signs are tried.

The vocabulary is a file in the tiktoken format whose path is a parameter; it has a fixed size, is read on the driver and sent to
the workers. The runs of a text are encoded in pieces of :data:`PIECE` characters, so that time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

KINDS = ("assign", "access", "hex")
#: ASCII alone, so that other letters are not folded onto these.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The fewest characters of a finding; of an assignment those of its value.
LEAST = {"assign": 8, "access": 16, "hex": 32}
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
PART = re.compile(r"[^./=]+")
PIECE = 1024
SHORTEST = 16
RATIO = 1.8
PLAIN_RATIO = 1.5

#: Digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGESTS = (32, 40, 56, 64, 96, 128)
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIERS = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T?[0-9.]*Z?"  # day or time
    r"|[vV]?[0-9]+(\.[0-9]+)+([.-]?(a|b|rc|alpha|beta|dev|post|pre|snapshot|SNAPSHOT|RELEASE|FINAL)[0-9]*([.-][0-9]+)*)*"  # version
    r"|10\.[0-9]{4,9}/[A-Za-z0-9._-]+"  # document id
    r"|[^A-Za-z]+"  # numbers
)
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, sorted; code points, end exclusive.

    Each kind's matches are leftmost and do not overlap; one that is too short is dropped with all that it covers.
    """
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(spans)


def is_account(run: str) -> bool:
    """An account number (two letters, two check digits and the rest) whose check digits are right."""
    return bool(ACCOUNT.fullmatch(run)) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def is_known(run: str) -> bool:
    """Digests by their length, and identifiers."""
    return (len(run) in DIGESTS and bool(HEXADECIMAL.fullmatch(run))) or bool(IDENTIFIERS.fullmatch(run)) or is_account(run)


class Efficiency:
    """Characters a token under a vocabulary, and what follows for a run."""

    def __init__(self, ranks: bytes, pattern: str, ratio: float = RATIO, plain_ratio: float = PLAIN_RATIO, shortest: int = SHORTEST):
        import tiktoken

        lines = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.ratio, self.plain_ratio, self.shortest = ratio, plain_ratio, shortest

    def of(self, run: str) -> float:
        return len(run) / sum(len(self.encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def random(self, run: str) -> bool:
        if len(run) < self.shortest or is_known(run):
            return False
        one_case = run.isalpha() and (run[1:].islower() or run.isupper())
        return self.of(run) < (self.plain_ratio if one_case else self.ratio)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The random runs outside the base findings."""
        found = []
        free, done = [], 0
        for start, _, end in base:
            if start > done:
                free.append((done, start))
            done = max(done, end)
        free.append((done, len(text)))
        for low, high in free:
            for m in RUN.finditer(text, low, high):
                if m.end() - m.start() < self.shortest:
                    continue
                a, b = m.span()
                if text[a - 1 : a] == "@" or text[b : b + 1] == "@":  # of an e-mail address
                    continue
                while a < b and text[a] in "./=_-+":  # punctuation around it
                    a += 1
                while a < b and text[b - 1] in "./_-+":
                    b -= 1
                run = text[a:b]
                if self.random(run):
                    found.append((a, len(KINDS), b))
                elif not IDENTIFIERS.fullmatch(run):
                    found += [(a + p.start(), len(KINDS), a + p.end()) for p in PART.finditer(run) if p.end() - p.start() < len(run) and self.random(p.group())]
        return found


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    names = (*KINDS, "random")
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every finding replaced by ``[SECRET]``; findings that overlap become one."""
    pieces, done = [], 0
    for start, _, end in sorted(spans):
        if start > done or not pieces:
            pieces.append(text[done:start])
            pieces.append("[SECRET]")
        elif start == done:
            pieces.append("[SECRET]")
        done = max(done, end)
    pieces.append(text[done:])
    return "".join(pieces)


SPANS = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in (*KINDS, "random")]
    + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())]
)
_TESTS: dict[tuple, Efficiency] = {}


def find_secrets(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    ratio: float = RATIO,
    plain_ratio: float = PLAIN_RATIO,
    shortest: int = SHORTEST,
    text: str = "text",
    carry: Iterable[str] = ("doc_id",),
    with_text: bool = True,
) -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_spans``, ``spans`` and ``redacted`` to each row.

    Spans are written kind:start:end, by start and then kind as in :data:`KINDS` with ``random`` last, joined by commas; offsets
    are code points, ends exclusive. The efficiency test looks outside the base findings only. ``redacted`` is the text without
    the findings and is left out unless ``with_text``; of a null text it is null. Null and empty texts have no findings. One row
    for each input row, repeated rows included; carried columns of these names are replaced; an empty table gives an empty one.
    Texts of any length are searched whole.
    """
    with open(ranks_path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())
    added = SPANS if with_text else T.StructType(SPANS.fields[:-1])

    def compute() -> Callable:
        key = (hashlib.sha256(ranks.value).digest(), pattern, ratio, plain_ratio, shortest)
        if key not in _TESTS:
            _TESTS[key] = Efficiency(ranks.value, pattern, ratio, plain_ratio, shortest)
        test = _TESTS[key]

        def function(columns):
            counts: list[list[int]] = [[] for _ in range(len(KINDS) + 1)]
            base, every, clean = [], [], []
            for value in columns[0].to_pylist():
                own = base_spans(value or "")
                spans = own + test.spans(value or "", own)
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in spans))
                base.append(written(own))
                every.append(written(spans))
                if with_text:
                    clean.append(None if value is None else redact(value, spans))
            return [*counts, base, every, clean] if with_text else [*counts, base, every]

        return function

    return add_columns(df, carry, [text], added, compute)
