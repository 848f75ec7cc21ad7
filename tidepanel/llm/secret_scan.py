"""Secrets in text: three fixed patterns, and high-entropy strings found by sliding windows.

Candidates are the longest runs of one character class. A window of fixed length slides over each candidate; its
Shannon entropy follows from the counts of its characters, of which each step changes two. The entropy is kept as the
whole number sum(G[count]), with G[c] = round(c * log2(c) * 2**20): H = log2(W) - sum / (W * 2**20), so sums are exact in
any order. Windows at or above the limit of their class are joined to spans, unless the candidate is on the allow-list.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from tidepanel.llm.common import fields, map_texts

#: Kinds in the order that breaks ties of the start, their patterns, and the least characters of the part that counts.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: As ACCESS and HEX with these lengths: both take a whole run of their class or none of it.
_LONG_ACCESS, _LONG_HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

#: Bits of the fixed point of the entropy.
SCALE = 1 << 20


class CharacterClass(NamedTuple):
    """Characters (the inside of a bracket expression), window length, and least entropy of a window in bits."""

    name: str
    characters: str
    window: int
    bits: float


#: Prose reaches 3.6 bits in 24 letters; random letters and digits lie at 4.1 on average, random hex digits at 3.3 in 20.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 20, 3.05),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.85),
)
#: Candidates that are no secrets: no digit or no letter at all (words, numbers, rules), UUIDs, the alphabet, stand-ins,
#: and paths of words.
ALLOW = (
    r"[^0-9]*", r"[^A-Za-z]*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r".*(?:abcdefghijkl|ABCDEFGHIJKL|0123456789).*", r"(?i:.*(?:example|placeholder|dummy|your_).*)", r"(?:[A-Za-z]+[-_/=])+[A-Za-z]*[0-9]{0,4}",
)

RESULT = fields(n_assign="long", n_access="long", n_hex="long", n_entropy="long", base_sha256="string", spans="string")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end) of the matches of the three patterns that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in _LONG_ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]


def weights(window: int) -> list[int]:
    """G[c] of every count a window can hold."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, window + 1))]


def most_weight(window: int, bits: float) -> int:
    """The largest sum of G of a window whose entropy is at least ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def rich_windows(run: str, window: int, most: int, gain: Sequence[int]) -> Iterable[int]:
    """Starts of the windows of ``run`` whose weight is at most ``most``."""
    counts: dict[str, int] = {}
    total = 0
    for i, new in enumerate(run):
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += gain[c - 1] - gain[c]
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += gain[c + 1] - gain[c]
        if i >= window - 1 and total <= most:
            yield i - window + 1


class Scanner:
    """All spans of a text; patterns are compiled once."""

    def __init__(self, classes: Sequence[CharacterClass] = CLASSES, allow: Sequence[str] = ALLOW) -> None:
        if len({*BASE_KINDS, *(c.name for c in classes)}) < len(BASE_KINDS) + len(classes):
            raise ValueError("class names must differ from each other and from the base kinds")
        if any(c.window < 2 for c in classes):
            raise ValueError("a window has two characters at least")
        self.kinds = [*BASE_KINDS, *(c.name for c in classes)]
        self.classes = [(re.compile(f"[{c.characters}]{{{c.window},}}"), c.window, most_weight(c.window, c.bits), weights(c.window)) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allow), re.DOTALL) if allow else None

    def added(self, text: str) -> list[Span]:
        out = []
        for k, (runs, window, most, gain) in enumerate(self.classes, len(BASE_KINDS)):
            for m in runs.finditer(text):
                if self.allowed and self.allowed.fullmatch(m[0]):
                    continue
                start = end = -1
                for at in rich_windows(m[0], window, most, gain):
                    if at > end:
                        if end >= 0:
                            out.append((m.start() + start, k, m.start() + end))
                        start = at
                    end = at + window
                if end >= 0:
                    out.append((m.start() + start, k, m.start() + end))
        return out

    def written(self, spans: list[Span]) -> str:
        return ",".join(f"{self.kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def row(self, text: str | None) -> tuple[int, int, int, int, str, str]:
        base = base_spans(text) if text else []
        more = self.added(text) if text else []
        n = [sum(k == i for _, k, _ in base) for i in range(len(BASE_KINDS))]
        return *n, len(more), hashlib.sha256(self.written(base).encode()).hexdigest(), self.written(base + more)


def scan(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    classes: Sequence[CharacterClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """Carried columns (default ``doc_id``) and the secrets of every whole text; one pass, no shuffle.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind; ``base_sha256`` is the
    digest of that list for the three patterns alone. Touching and overlapping windows are one span; a span of a class
    may overlap base spans, which always stay, also on the allow-list. ``allow`` has patterns for whole candidates.
    Null and empty texts have no spans and the digest of the empty string. Repeated rows give repeated rows, an empty
    table an empty result. Very long texts are scanned whole, in time linear in their length. Other columns of ``docs``
    are not read, so they may have any name; a carried column named as a result column raises ``ValueError``.
    """
    scanner = Scanner(classes, allow)
    return map_texts(docs, text, RESULT, lambda: lambda texts: list(zip(*map(scanner.row, texts))), ["doc_id"] if carry is None else carry)
