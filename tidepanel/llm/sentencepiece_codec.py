"""SentencePiece byte-pair encoding with seeded merge-dropout, and its lossless decoding.

The agenda takes the best adjacent pair whose join is a piece (leftmost on a tie); a keyed hash of the unit,
the place and the piece decides whether this candidate is skipped. A skipped candidate comes back only when
a neighbour changes, so segmentations vary by document and occurrence and are the same on every retry.
Texts split into units (blanks and what follows them) that no piece crosses. The distinct units of an Arrow
chunk run their agendas side by side in numpy; long units and units with characters outside the vocabulary
use a heap.

A blank is the model's meta symbol; the symbol itself, when a text contains it, and all other characters
without a piece become byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fields, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
#: Different segmentations a unit may have in one corpus.
VARIANTS = 16
#: Longest unit, in characters, whose agenda runs in the matrix.
WIDEST = 40

META = "▁"
NONE = np.int32(2**31 - 1)
ENCODED = fields(n_tokens="long", tokens="array<int>", round_trip="boolean")

_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)
_MASK = 2**64 - 1


def load_pieces(model: str = MODEL) -> tuple[list[str], list[float], dict[int, int]]:
    """Pieces (blanks in place of the meta symbol; empty for control pieces), scores and byte -> id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    pieces = ["" if special(i) else sp.id_to_piece(i).replace(META, " ") for i in range(n)]
    return pieces, [sp.get_score(i) for i in range(n)], {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}


class Codec:
    """Encoder and decoder over a model's pieces."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], dropout: float, seed: int) -> None:
        if dropout and not 0 <= dropout <= 1:
            raise ValueError("dropout lies between 0 and 1")
        self.dropout, self.seed, self.byte_ids = dropout, seed, byte_ids
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ids):
            raise ValueError("the model has pieces across blanks or line ends")
        order = sorted(self.ids.values(), key=lambda i: -scores[i])
        self.rank = np.zeros(len(pieces), dtype=np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.joins = {
            (self.ids[p[:k]], self.ids[p[k:]]): i
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        }
        self.n = len(pieces)
        # The same joins as an open-addressing table, for lookups of many pairs at once.
        self.bits = max(10, (8 * len(self.joins)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        self.probes = 1
        for (a, b), i in self.joins.items():
            key = a * self.n + b
            at, tries = self._slot(key), 1
            while self.keys[at] >= 0:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[at], self.values[at] = key, i
            self.probes = max(self.probes, tries)
        self.bytes = [p.encode() for p in pieces]
        for b, i in byte_ids.items():
            self.bytes[i] = bytes([b])
        self.limit = int(dropout * 2**32)
        self.split = re.compile(r" +[^ \n]*|\n|[^ \n]+").findall

    def _slot(self, key: int) -> int:
        return (key * _K[0] & _MASK) >> (64 - self.bits)

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each joined pair, -1 where there is none."""
        key = a.astype(np.int64) * self.n + b
        at = ((key.view(np.uint64) * np.uint64(_K[0])) >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.keys[at] == key
        out = np.where(hit, self.values[at], -1)
        rest = np.flatnonzero(~hit & (self.keys[at] >= 0))
        for k in range(1, self.probes):
            if not len(rest):
                break
            slot = (at[rest] + k) & ((1 << self.bits) - 1)
            ok = self.keys[slot] == key[rest]
            out[rest[ok]] = self.values[slot[ok]]
            rest = rest[~ok & (self.keys[slot] >= 0)]
        return out

    def _unit_key(self, unit: str, variant: int) -> int:
        return xxhash.xxh64_intdigest(unit.encode(), (self.seed * VARIANTS + variant) & _MASK)

    def _skipped(self, key: int, left: int, right: int, piece: int) -> bool:
        h = (key + left * _K[1] + right * _K[2] + piece * _K[0]) & _MASK
        h = (h ^ h >> 31) * _K[3] & _MASK
        return h >> 32 < self.limit

    def agenda(self, unit: str, variant: int) -> list[int]:
        """Ids of one unit by a heap of candidates."""
        symbol = [int(self.chars[ord(c)]) for c in unit]
        n, key = len(symbol), self._unit_key(unit, variant)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def propose(left: int) -> None:
            right = nxt[left] if left >= 0 else n
            if right < n and (made := self.joins.get((symbol[left], symbol[right]))) is not None:
                heapq.heappush(heap, (int(self.rank[made]), left, right, symbol[left], symbol[right]))

        for i in range(n):
            propose(i)
        while heap:
            _, left, right, a, b = heapq.heappop(heap)
            if symbol[left] != a or nxt[left] != right or symbol[right] != b:
                continue
            made = self.joins[a, b]
            if self.limit and self._skipped(key, left, right, made):
                continue
            symbol[left], symbol[right], nxt[left] = made, -2, nxt[right]
            if nxt[left] < n:
                prev[nxt[left]] = left
            propose(left)
            propose(prev[left])
        out: list[int] = []
        for c, s in zip(unit, symbol):
            if s >= 0:
                out.append(s)
            elif s == -1:
                out += [self.byte_ids[b] for b in c.encode()]
        return out

    def _matrix(self, units: list[str], keys: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, count per unit) for units whose characters all have a piece."""
        u, width = len(units), int(sizes.max()) + 1
        column = np.arange(width, dtype=np.int64)
        alive = column < sizes[:, None]
        symbol = np.zeros((u, width), dtype=np.int32)
        symbol[alive] = symbols
        nxt = np.tile(column + 1, (u, 1))
        prev = np.tile(column - 1, (u, 1))
        best = np.full((u, width), NONE, dtype=np.int32)
        r, c = np.nonzero(alive[:, 1:])
        made = self._join(symbol[r, c], symbol[r, c + 1])
        best[r, c] = np.where(made >= 0, self.rank[made], NONE)
        rows = np.arange(u)
        seeds = keys
        while len(rows):
            at = np.argmin(best[rows], axis=1)
            live = best[rows, at] != NONE
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            right = nxt[rows, at]
            made = self._join(symbol[rows, at], symbol[rows, right])
            best[rows, at] = NONE
            if self.limit:
                h = seeds[rows] + at.astype(np.uint64) * np.uint64(_K[1]) + right.astype(np.uint64) * np.uint64(_K[2])
                h += made.astype(np.uint64) * np.uint64(_K[0])
                h = (h ^ (h >> np.uint64(31))) * np.uint64(_K[3])
                go = (h >> np.uint64(32)) >= np.uint64(self.limit)
            else:
                go = np.ones(len(rows), dtype=bool)
            r, left, right, made = rows[go], at[go], right[go], made[go]
            symbol[r, left] = made
            alive[r, right] = False
            best[r, right] = NONE
            after = nxt[r, right]
            nxt[r, left] = after
            inside = after < width
            prev[r[inside], after[inside]] = left[inside]
            follows = after < sizes[r]
            self._propose(best, symbol, r[follows], left[follows], after[follows])
            before = prev[r, left]
            leads = before >= 0
            self._propose(best, symbol, r[leads], before[leads], left[leads])
        return symbol[alive], alive.sum(axis=1)

    def _propose(self, best: np.ndarray, symbol: np.ndarray, r: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        made = self._join(symbol[r, left], symbol[r, right])
        best[r, left] = np.where(made >= 0, self.rank[made], NONE)

    def encode_units(self, units: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, count per unit) of distinct (unit, variant) pairs."""
        sizes = np.fromiter((len(x) for x, _ in units), dtype=np.int64, count=len(units))
        points = np.frombuffer("".join(x for x, _ in units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.chars[points]
        ends = np.cumsum(sizes)
        unknown = np.add.reduceat(symbols < 0, ends - sizes) > 0
        keys = np.fromiter((self._unit_key(x, v) for x, v in units), dtype=np.uint64, count=len(units))
        own: list[np.ndarray | None] = [None] * len(units)
        odd = unknown | (sizes > WIDEST)
        for i in np.flatnonzero(odd):
            own[i] = np.asarray(self.agenda(*units[i]), dtype=np.int32)
        counts = np.fromiter((0 if x is None else len(x) for x in own), dtype=np.int64, count=len(units))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, WIDEST)):
            at = np.flatnonzero(~odd & (sizes > lo) & (sizes <= hi))
            if len(at):
                ids, n = self._matrix([units[i][0] for i in at], keys[at], symbols[ragged(ends[at] - sizes[at], sizes[at])], sizes[at])
                counts[at] = n
                parts.append((at, ids, n))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for at, ids, n in parts:
            out[ragged(starts[at], n)] = ids
        for i in np.flatnonzero(odd):
            out[starts[i] : starts[i] + counts[i]] = own[i]
        return out, counts

    def encode(self, texts: list[str], keys: Iterable[int]) -> list[np.ndarray]:
        """Ids of each text; ``keys`` choose the variants of its units."""
        distinct: dict[tuple[str, int], int] = {}
        numbers, lengths = [], []
        for text, key in zip(texts, keys):
            units = self.split(" " + text) if text else []
            lengths.append(len(units))
            if self.limit:
                h = (np.arange(len(units), dtype=np.uint64) + np.uint64(key & _MASK)) * np.uint64(_K[0])
                variants = ((h ^ (h >> np.uint64(29))) * np.uint64(_K[3]) >> np.uint64(58)) % np.uint64(VARIANTS)
                numbers += [distinct.setdefault(x, len(distinct)) for x in zip(units, variants.tolist())]
            else:
                numbers += [distinct.setdefault((x, 0), len(distinct)) for x in units]
        if not distinct:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        ids, counts = self.encode_units(list(distinct))
        number = np.asarray(numbers, dtype=np.int64)
        starts = np.cumsum(counts) - counts
        flat = ids[ragged(starts[number], counts[number])]
        per = np.r_[0, np.cumsum(counts[number])][np.r_[0, np.cumsum(lengths)]]
        return np.split(flat, per[1:-1])

    def decode(self, ids: Iterable[int]) -> str:
        """The text that was encoded."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        return data.decode("utf-8", "surrogatepass")[1:]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + count) in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
) -> DataFrame:
    """Carried columns (default ``doc_id``), n_tokens, tokens and round_trip (decoding gave the text back).

    The variants of a text's units follow from ``seed`` and the text, so repeated rows are segmented alike. A
    null text has null tokens and no count; an empty one has none and count 0. An empty table gives an empty
    result. The model is read on the driver; its pieces, of fixed size, travel with the job.
    """
    vocabulary = load_pieces(model)

    def prepare():
        codec = Codec(*vocabulary, dropout, seed)

        def work(texts: list) -> list:
            known = [t or "" for t in texts]
            keys = [xxhash.xxh64_intdigest(t.encode(), seed) for t in known]
            ids = codec.encode(known, keys)
            same = [codec.decode(x.tolist()) == t for x, t in zip(ids, known)]
            null = [t is None for t in texts]
            return [
                [None if z else len(x) for x, z in zip(ids, null)], [None if z else x for x, z in zip(ids, null)],
                [None if z else s for s, z in zip(same, null)],
            ]

        return work

    return map_texts(docs, text, ENCODED, prepare, ["doc_id"] if carry is None else carry)


def decode(encoded: DataFrame, tokens: str = "tokens", out: str = "text", model: str = MODEL) -> DataFrame:
    """Add the decoded text ``out``; null tokens give a null text. All other columns are kept."""
    vocabulary = load_pieces(model)

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*vocabulary, 0.0, 0)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else codec.decode(ids))

    return encoded.withColumn(out, spell(F.col(f"`{tokens}`")))
