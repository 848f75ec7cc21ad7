"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides.

Words are counted over the whole corpus; the most frequent ones have a number of their own, the others share one by
their first byte. A word's probability is that of its class times that within the class, with classes of about equal
mass; for a shared number times that of its other bytes, each given the byte before it, and of the end. These byte pairs
are counted over the words without a number of their own, so any word has a probability, and those of all words sum to
one. The network adds the window's embeddings, weighted by place, and squashes the sum. Texts are split in Arrow and turned
into numbers once; training and scoring read those. It is trained in numpy where the data lies: each task runs Adagrad from
the common weights over its part of the documents, and the weights are averaged by token count in a tree of tasks. Scores
are the summed conditional log-probabilities of all tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import chunks, fields, laid_out, map_texts, stored

CLASSES, MEMBERS = 64, 128
#: Numbers shared by the words without one of their own, one for each first byte.
SHARED = 256
SIDE, WIDTH = 3, 32
ROUNDS, RATE, BATCH = 1, 0.4, 3072
#: Those numbers of a window that are not its token.
PLACES = [i for i in range(2 * SIDE + 1) if i != SIDE]
#: Rows worked on as one row, and classes worked on at a time.
ABREAST, TOGETHER = 16, 8
#: Training tasks for each core of the cluster: their number, and that of the weights, follows the cluster, not the corpus.
TASKS_PER_CORE = 1
#: Weights averaged in one task.
FAN_IN = 8
#: Bytes of words counted at once in a task.
HELD_BYTES = 32 << 20
#: Ends of words in the table of byte pairs, and in joined words.
STOP, BLANK = 256, 0x20

COUNTS = fields(word="binary", n="long")
PAIRS = fields(cell="int", n="long")
WEIGHTS = fields(part="int", n_tokens="long", weights="binary")
N_PIECES = 32
PIECES = fields(piece="int", weights="binary")
#: Numbers of a text as bytes, with SIDE pads after them, and the log-probability of its words of shared numbers given these.
ENCODED = fields(ids="binary", spelt="double")
SCORED = fields(n_tokens="long", log_likelihood="double", mean_log_likelihood="double")

#: Context before the first and after the last word of a text.
PAD = CLASSES * MEMBERS
ONES = np.ones(max(CLASSES, MEMBERS), dtype=np.float32)
#: Of numbers; numpy sorts 16 bits by radix.
KIND = np.int16


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def split(texts: list[str | None]) -> tuple[np.ndarray, pa.StringArray]:
    """Word counts of all texts, and the ``words`` of all of them in a row."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower() if t else "" for t in texts], pa.string()))
    pieces = lists.flatten()
    full = pc.greater(pc.binary_length(pieces), 0)
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return np.diff(before[lists.offsets.to_numpy()]).astype(np.int64), pieces.filter(full)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    size = 0

    def emptied() -> pa.RecordBatch:
        made = pc.value_counts(pa.chunked_array(held, pa.string()))
        held.clear()
        return pa.RecordBatch.from_arrays([made.field(0).cast(pa.binary()), made.field(1)], names=["word", "n"])

    for batch in batches:
        for part in chunks(batch.column(0)):
            held.append(split(part.to_pylist())[1])
            size += held[-1].nbytes
            if size > HELD_BYTES:
                yield emptied()
                size = 0
    if held:
        yield emptied()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of all words of the corpus."""
    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(_count, COUNTS)
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(docs: DataFrame, text: str = "text", counted: DataFrame | None = None) -> list[tuple[bytes, int]]:
    """The most frequent words of the corpus with their counts; of equally frequent ones the first in byte order.

    The least count that enters is read off two small histograms, of the counts' powers of two and of the counts
    within one power, so the driver gets no more words than there are numbers.
    """
    room = CLASSES * MEMBERS - SHARED
    counted = word_counts(docs, text) if counted is None else counted
    power = F.length(F.bin("n")) - 1
    border, left = 0, room
    for p, n in sorted(map(tuple, counted.groupBy(power).count().collect()), reverse=True):
        if n > left:
            within = counted.where(power == p).groupBy("n").count()
            for value, words_there in sorted(map(tuple, within.collect()), reverse=True):
                border = value
                if words_there > left:
                    break
                left -= words_there
            break
        left -= n
    top = counted.where(F.col("n") > border).collect()
    if border:
        top += counted.where(F.col("n") == border).orderBy("word").limit(left).collect()
    return sorted(((bytes(w), n) for w, n in top), key=lambda r: (-r[1], r[0]))


def spelling(counted: DataFrame, vocab: list[tuple[bytes, int]]) -> tuple[np.ndarray, list[int]]:
    """log P(next byte or end | byte) of the words without a number of their own, and their counts by first byte.

    Every pair has one count more than found, so no word is impossible.
    """
    rare = counted
    if vocab:
        last, n = vocab[-1]
        rare = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(last))))
    found = np.zeros((STOP, STOP + 1))
    first = [0] * SHARED
    for cell, n in rare.mapInArrow(_byte_pairs, PAIRS).groupBy("cell").agg(F.sum("n")).collect():
        if cell < 0:
            first[-1 - cell] = n
        else:
            found[divmod(cell, STOP + 1)] = n
    return np.log((found + 1) / (found + 1).sum(axis=1, keepdims=True)), first


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the byte pairs of a task's words, the end as STOP, and of first bytes b as cell -1 - b."""
    pairs, first = np.zeros(STOP * STOP), np.zeros(SHARED)
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, n = _joined(batch.column(0).to_pylist()), batch.column(1).to_numpy()
        sizes = np.diff(np.flatnonzero(flat == BLANK), prepend=-1)
        first += np.bincount(flat[np.cumsum(sizes) - sizes], weights=n, minlength=SHARED)
        cells = flat[:-1].astype(np.int64) * STOP + flat[1:]
        pairs += np.bincount(cells, weights=np.repeat(n, sizes)[:-1], minlength=STOP * STOP)
    found = np.zeros((STOP, STOP + 1))
    found[:, :STOP] = pairs.reshape(STOP, STOP)
    found[:, STOP] = found[:, BLANK]
    found[:, BLANK] = 0
    # Only a word's last byte has a blank after it, also at the end of a batch.
    found[BLANK] = 0
    found = found.ravel()
    cells = np.r_[np.flatnonzero(found), -1 - np.flatnonzero(first)]
    values = np.r_[found[found > 0], first[first > 0]].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(values)], names=PAIRS.names)


def _joined(words: list[bytes]) -> np.ndarray:
    """The bytes of all words, a blank after each; no word holds one."""
    return np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8)


def spelt(rare: list[bytes] | pa.Array, pairs: np.ndarray) -> np.ndarray:
    """log P(word | its first byte) of each word."""
    if not len(rare):
        return np.empty(0)
    flat, bounds = laid_out(pa.array(rare, pa.binary()) if isinstance(rare, list) else rare)
    after = np.r_[flat[1:], 0].astype(np.int64)
    after[bounds[1:] - 1] = STOP
    return np.add.reduceat(pairs.ravel()[flat * np.int64(STOP + 1) + after], bounds[:-1])


class Numbers(dict):
    """Numbers of words; one without its own has the shared number of its first byte, at the end of a class."""

    def __missing__(self, word: bytes) -> int:
        return shared_number(word[0])


def shared_number(first: int | np.ndarray) -> int | np.ndarray:
    """Number of the words without one of their own that begin with a byte."""
    per = SHARED // CLASSES
    return first // per * MEMBERS + MEMBERS - per + first % per


def numbers(vocab: list[tuple[bytes, int]]) -> Numbers:
    """Word -> class * MEMBERS + member. Words go, most frequent first, to the lightest class with room."""
    mass, size = np.zeros(CLASSES), np.zeros(CLASSES, dtype=int)
    room = np.full(CLASSES, MEMBERS - SHARED // CLASSES)
    out = Numbers()
    for word, n in vocab:
        k = int(np.argmin(np.where(size < room, mass, np.inf)))
        out[word] = k * MEMBERS + int(size[k])
        mass[k] += n
        size[k] += 1
    return out


class Encoder:
    """Numbers of the words of texts; with ``pairs`` (see ``spelling``) also what their spelling adds to a score."""

    def __init__(self, known: dict[bytes, int], pairs: np.ndarray | None = None) -> None:
        self.words = pa.array(list(known), pa.binary()).cast(pa.string())
        self.own = np.fromiter([*known.values(), 0], dtype=KIND)
        self.pairs = pairs

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all texts, SIDE pads after each; texts' token counts; log-probabilities of spellings)."""
        sizes, row = split(texts)
        at = pc.index_in(row, value_set=self.words)
        rare = at.is_null()
        ids = self.own[at.fill_null(len(self.own) - 1).to_numpy()]
        shared, of_text = row.filter(rare), np.repeat(np.arange(len(sizes)), sizes)
        rare = rare.to_numpy(zero_copy_only=False)
        flat, bounds = laid_out(shared)
        ids[rare] = shared_number(flat[bounds[:-1]].astype(KIND))
        out = np.full(len(ids) + SIDE * len(sizes), PAD, dtype=KIND)
        out[np.arange(len(ids)) + SIDE * of_text] = ids
        if self.pairs is None:
            return out, sizes, np.zeros(len(sizes))
        return out, sizes, np.bincount(of_text[rare], weights=spelt(shared, self.pairs), minlength=len(sizes))


def encode(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all texts, each between pads; texts' token counts)."""
    ids, sizes, _ = Encoder(known)(texts)
    return _led_in(ids), sizes


def _led_in(ids: np.ndarray) -> np.ndarray:
    return np.r_[np.full(SIDE, PAD, dtype=KIND), ids]


def encoded(docs: DataFrame, text: str, known: dict[bytes, int], pairs: np.ndarray | None = None, carry: list[str] | None = None) -> DataFrame:
    """Carried columns, ids and spelt of each row."""

    def prepare():
        made = Encoder(known, pairs)

        def work(texts: list) -> list:
            ids, sizes, more = made(texts)
            ends = np.cumsum(sizes + SIDE)
            return [[ids[a:b].tobytes() for a, b in zip(ends - sizes - SIDE, ends)], more]

        return work

    return map_texts(docs, text, ENCODED, prepare, carry)


def _stream(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows between pads, token counts) of encoded rows."""
    flat, bounds = laid_out(ids)
    return _led_in(flat.view(KIND)), np.diff(bounds).astype(np.int64) // KIND(0).itemsize - SIDE


def shapes() -> dict[str, tuple[int, ...]]:
    return {
        "embed": (PAD + 1, WIDTH), "place": (2 * SIDE, WIDTH), "shift": (WIDTH,),
        "kind": (WIDTH + 1, CLASSES), "word": (CLASSES, WIDTH + 1, MEMBERS),  # the last row of a matrix is the bias
    }


def initial(vocab: list[tuple[bytes, int]], shared: list[int] | None = None) -> np.ndarray:
    """Start weights: small embeddings, biases at the corpus frequencies; ``shared`` are those of the shared numbers."""
    rng = np.random.default_rng(11)
    w = unpack(np.zeros(sum(int(np.prod(s)) for s in shapes().values()), dtype=np.float32))
    w["embed"][:] = rng.normal(0, 0.3, w["embed"].shape)
    w["place"][:] = 1 / np.sqrt(2 * SIDE)
    w["kind"][:] = rng.normal(0, 0.1, w["kind"].shape)
    w["word"][:] = rng.normal(0, 0.1, w["word"].shape)
    mass = np.ones((CLASSES, MEMBERS))
    for (word, n), k in zip(vocab, numbers(vocab).values()):
        mass[k // MEMBERS, k % MEMBERS] += n
    rest = mass[:, MEMBERS - SHARED // CLASSES :]
    if shared is None:
        rest[:] = max(1.0, mass.sum() / (2 * SHARED))  # not counted: about a third of the tokens
    else:
        rest += np.reshape(shared, rest.shape)
    w["kind"][-1] = np.log(mass.sum(axis=1) / mass.sum())
    w["word"][:, -1] = np.log(mass / mass.sum(axis=1, keepdims=True))
    return pack(w)


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in shapes()]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


class Room:
    """Arrays by name, taken once and lent again: the pages of new ones cost a step more than its arithmetic."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.zeros(size, dtype=np.float32)
        return self.held[name][:size].reshape(shape)


def _abreast(rows: np.ndarray) -> np.ndarray:
    """The same numbers in longer rows; numpy is slow on short ones with a factor for each column."""
    return rows.reshape(len(rows) // ABREAST, ABREAST * rows.shape[1])


def _tiled(rows: np.ndarray) -> np.ndarray:
    """Factors of columns for rows abreast."""
    return np.repeat(rows[:, None], ABREAST, axis=1).reshape(len(rows), ABREAST * rows.shape[1])


def _shifted(rows: np.ndarray) -> np.ndarray:
    """All but 2 * SIDE of the rows, abreast, from each of the first 2 * SIDE + 1 on."""
    down, right = rows.strides
    shape = (2 * SIDE + 1, (len(rows) - 2 * SIDE) // ABREAST, ABREAST * rows.shape[1])
    return as_strided(rows, shape, (down, ABREAST * down, right), writeable=False)


def _up(n: int) -> int:
    return max(0, -(-n // ABREAST) * ABREAST)


class Window:
    """Hidden values of the tokens of one stretch of a stream, ordered by number; SIDE numbers lead in and out.

    The stretch is contiguous, so each place of the window is a shift of the embedded stream, not a lookup. Arrays come
    from ``room``, which the next window takes over.
    """

    def __init__(self, w: dict[str, np.ndarray], ids: np.ndarray, room: Room) -> None:
        n, self.room = len(ids), room
        self.order = np.argsort(ids, kind="stable")
        own = self.order[: np.searchsorted(ids, PAD, sorter=self.order)]
        own = own[(own >= SIDE) & (own < n - SIDE)]
        self.at = own - SIDE
        self.kind, member = np.divmod(ids[own], MEMBERS)
        # Places of the targets in all scores in a row, which numpy finds sooner than by row and column.
        at = np.arange(len(own))
        self.targets = at * CLASSES + self.kind, at * MEMBERS + member
        # Rows of zeros fill the last long row; the token itself weighs nothing.
        self.size = _up(n - 2 * SIDE)
        self.embedded = room("embedded", max(n, self.size + 2 * SIDE), WIDTH)
        np.take(w["embed"], ids, axis=0, out=self.embedded[:n], mode="clip")
        self.embedded[n:] = 0
        self.places = np.zeros((2 * SIDE + 1, WIDTH), dtype=np.float32)
        self.places[PLACES] = w["place"]
        total = room("stream", self.size, WIDTH)
        wide = np.einsum("pij,pj->ij", _shifted(self.embedded), _tiled(self.places), out=_abreast(total))
        wide += _tiled(w["shift"][None])
        np.tanh(wide, out=wide)
        self.hidden = np.take(total, self.at, axis=0, out=room("sorted", len(own), WIDTH), mode="clip")
        self.cuts = np.searchsorted(self.kind, np.arange(CLASSES + 1, dtype=self.kind.dtype)).tolist()

    def target(self, i: int, rows: slice) -> np.ndarray:
        """Places of the targets in the scores of some rows, of classes (0) or members (1)."""
        return self.targets[i][rows] - rows.start * (CLASSES, MEMBERS)[i]

    def exponentials(self, w: dict[str, np.ndarray]) -> Iterator[tuple[int, slice, list[tuple[int, slice]], np.ndarray, np.ndarray, np.ndarray]]:
        """For TOGETHER classes at a time: the first, their tokens, (class, its tokens within these), hidden values with
        a one, exp of the scores of all classes, and of all members of each token's class; these stay in a core's cache."""
        words = list(w["word"])
        for first in range(0, CLASSES, TOGETHER):
            start, *ends = self.cuts[first : first + TOGETHER + 1]
            n = ends[-1] - start
            if not n:
                continue
            rows, h = slice(start, start + n), self.room("hidden", n, WIDTH + 1)
            h[:, :WIDTH] = self.hidden[rows]
            h[:, WIDTH] = 1
            kinds = np.matmul(h, w["kind"], out=self.room("kinds", n, CLASSES))
            members, classes, a = self.room("members", n, MEMBERS), [], 0
            for k, end in enumerate(ends, first):
                if a < end - start:
                    at = slice(a, end - start)
                    classes.append((k, at))
                    np.matmul(h[at], words[k], out=members[at])
                    a = end - start
            yield first, rows, classes, h, np.exp(kinds, out=kinds), np.exp(members, out=members)


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ ONES[: rows.shape[1]]


def log_probabilities(w: dict[str, np.ndarray], ids: np.ndarray, room: Room | None = None) -> np.ndarray:
    """log P(word | both sides) of every token that is no pad, in order; ``ids`` has SIDE pads at both ends."""
    out, room = np.zeros(max(0, len(ids) - 2 * SIDE), dtype=np.float64), Room() if room is None else room
    for lo in range(0, len(out), BATCH):
        part = Window(w, ids[lo : lo + BATCH + 2 * SIDE], room)
        for _, rows, _, _, *scores in part.exponentials(w):
            out[lo + part.at[rows]] = sum(_log_shares(z, part.target(i, rows)) for i, z in enumerate(scores))
    return out[ids[SIDE : len(ids) - SIDE] != PAD]


def _log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.log(z.reshape(-1)[target].astype(np.float64) / _sums(z))


class Trainer:
    """Adagrad on the cross-entropy of all tokens of contiguous stretches, in place."""

    def __init__(self, flat: np.ndarray, rate: float = RATE) -> None:
        self.flat, self.rate, self.room = flat.copy(), rate, Room()
        self.w = unpack(self.flat)
        self.seen = {k: np.full(v.shape, 1e-2, dtype=np.float32) for k, v in self.w.items()}

    def _move(self, name: str, grad: np.ndarray, at: slice | np.ndarray = slice(None)) -> None:
        seen, step = self.seen[name][at], np.multiply(grad, grad, out=self.room("step", *grad.shape))
        seen += step
        np.sqrt(seen, out=step)
        np.divide(grad, step, out=step)
        step *= self.rate
        if not isinstance(at, slice):
            self.seen[name][at] = seen
        self.w[name][at] -= step

    def step(self, ids: np.ndarray) -> None:
        """One step on the tokens of ``ids`` but for SIDE at each end."""
        w, room = self.w, self.room
        part = Window(w, ids, room)
        if not len(part.at):
            return
        scale = np.float32(32 / len(part.at))

        def gradient(z: np.ndarray, target: np.ndarray) -> np.ndarray:
            total = _sums(z)
            z.reshape(-1)[target] -= total
            return np.multiply(z, (scale / total)[:, None], out=z)

        turned = list(w["word"][:, :WIDTH].transpose(0, 2, 1))
        of_kinds, of_hidden = np.zeros_like(w["kind"]), room("of hidden", len(part.at) + 1, WIDTH)
        for first, rows, classes, h, kinds, members in part.exponentials(w):
            gradient(kinds, part.target(0, rows))
            gradient(members, part.target(1, rows))
            back = np.matmul(kinds, w["kind"][:WIDTH].T, out=of_hidden[rows])
            of_kinds += h.T @ kinds
            more, grad = room("more", len(h), WIDTH), room("of words", min(TOGETHER, CLASSES - first), WIDTH + 1, MEMBERS)
            if len(classes) < len(grad):
                grad[:] = 0
            for k, at in classes:
                np.matmul(members[at], turned[k], out=more[at])
                np.matmul(h[at].T, members[at], out=grad[k - first])
            back += more
            slope = np.multiply(part.hidden[rows], part.hidden[rows], out=more)
            back *= np.subtract(1, slope, out=slope)
            self._move("word", grad, slice(first, first + len(grad)))
        self._move("kind", of_kinds)
        # Back in the order of the stream; pads take the row of zeros after the last.
        of_hidden[-1], place_of = 0, np.full(part.size, len(part.at))
        place_of[part.at] = np.arange(len(part.at))
        long = _up(len(part.embedded))
        led = room("stream", long + 2 * SIDE, WIDTH)
        spread = led[2 * SIDE : 2 * SIDE + part.size]
        led[: 2 * SIDE] = led[2 * SIDE + part.size :] = 0
        np.take(of_hidden, place_of, axis=0, out=spread, mode="clip")
        place, shift = np.einsum("pij,ij->pj", _shifted(part.embedded), _abreast(spread)), np.einsum("ij->j", _abreast(spread))
        embed = room("embedded", long, WIDTH)  # no more needed
        np.einsum("pij,pj->ij", _shifted(led), _tiled(part.places[::-1]), out=_abreast(embed))
        ordered = ids[part.order]
        first = np.flatnonzero(np.r_[True, ordered[1:] > ordered[:-1]])
        grouped = np.take(embed, part.order, axis=0, out=room("sorted", len(ids), WIDTH), mode="clip")
        self._move("embed", np.add.reduceat(grouped, first, axis=0, out=room("summed", len(first), WIDTH)), ordered[first])
        self._move("place", place.reshape(-1, ABREAST, WIDTH).sum(axis=1)[PLACES])
        self._move("shift", shift.reshape(ABREAST, WIDTH).sum(axis=0))


def _train(flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = Trainer(flat), 0
        for batch in batches:
            for part in chunks(batch.column(0)):
                ids, sizes = _stream(part)
                for lo in range(0, len(ids) - 2 * SIDE, BATCH):
                    trainer.step(ids[lo : lo + BATCH + 2 * SIDE])
                n += int(sizes.sum())
        if n:
            yield _weights(TaskContext.get().partitionId(), n, trainer.flat)

    return run


def _weights(part: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
    made = [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(made, names=WEIGHTS.names)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, part = None, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            one = np.frombuffer(row["weights"], dtype=np.float32).astype(np.float64) * row["n_tokens"]
            total = one if total is None else total + one
            n, part = n + row["n_tokens"], row["part"]
    if n:
        yield _weights(part // FAN_IN, n, total / n)


def fit(
    docs: DataFrame, text: str = "text", rounds: int = ROUNDS, counted: DataFrame | None = None, vocab: list[tuple[bytes, int]] | None = None, shared: list[int] | None = None
) -> tuple[dict[bytes, int], np.ndarray]:
    """Word numbers and weights, trained on all documents."""
    if vocab is None:
        counted = word_counts(docs, text) if counted is None else counted
        vocab = vocabulary(docs, text, counted)
    if shared is None:
        shared = spelling(counted if counted is not None else word_counts(docs, text), vocab)[1]
    known = numbers(vocab)
    return known, trained(stored(encoded(docs, text, known, carry=[]), "numbers"), initial(vocab, shared), rounds)


def trained(rows: DataFrame, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from ``flat`` on, trained on all rows of ``encoded``."""
    # Neighbouring partitions of the scan are read one after another by a task; nothing is shuffled.
    parts = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    for _ in range(rounds):
        made, left = stored(rows.select("ids").coalesce(parts).mapInArrow(_train(flat), WEIGHTS), "weights"), parts
        while left > 1:
            left = -(-left // FAN_IN)
            group = F.floor(F.col("part") / FAN_IN)
            made = made.repartition(left, group).sortWithinPartitions("part").mapInArrow(_grouped, WEIGHTS)
        # One row, fetched in pieces so that each task's result stays small.
        got = sorted(map(tuple, made.mapInArrow(_split, PIECES).repartition(N_PIECES, "piece").collect()))
        if got:
            flat = np.frombuffer(b"".join(bytes(b) for _, b in got), dtype=np.float32)
    return flat


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = -(-len(row["weights"]) // N_PIECES)
            parts = [row["weights"][i * size : (i + 1) * size] for i in range(N_PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(N_PIECES), pa.int32()), pa.array(parts, pa.binary())], names=PIECES.names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Average the rows of each group of neighbouring parts; they arrive in order of the part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if held and held[0].column(0)[0].as_py() // FAN_IN != row.column(0)[0].as_py() // FAN_IN:
                yield from _average(iter(held))
                held = []
            held.append(row)
    if held:
        yield from _average(iter(held))


def score(
    docs: DataFrame,
    model: tuple[dict[bytes, int], np.ndarray],
    text: str = "text",
    carry: list[str] | None = None,
    pairs: np.ndarray | None = None,
) -> DataFrame:
    """Carried columns (default ``doc_id``), n_tokens, log_likelihood and its mean per token.

    With ``pairs`` (see ``spelling``) a word with a shared number is scored by its bytes as well; without, by the number
    alone. Null and empty texts have no token, a likelihood of 0 and no mean. Repeated rows score alike. Very long texts
    are scored whole. An empty table gives an empty result. A carried column named as a result column raises
    ``ValueError``; other columns are not read.
    """
    known, flat = model

    def prepare():
        w, made, room = unpack(flat), Encoder(known, pairs), Room()

        def work(texts: list) -> list:
            ids, sizes, more = made(texts)
            return _scored(w, _led_in(ids), sizes, more, room)

        return work

    return map_texts(docs, text, SCORED, prepare, ["doc_id"] if carry is None else carry)


def _scored(w: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, more: np.ndarray, room: Room) -> list:
    """Values of SCORED for texts with these numbers and token counts."""
    total = np.r_[0, np.cumsum(log_probabilities(w, ids, room))]
    ends = np.cumsum(sizes)
    summed = total[ends] - total[ends - sizes] + more
    return [sizes, summed, [s / n if n else None for s, n in zip(summed, sizes)]]


def _score(flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, room = unpack(flat), Room()
        for batch in batches:
            done, n_carry = 0, batch.num_columns - len(ENCODED)
            for part in chunks(batch.column(n_carry)):
                more = batch.column(n_carry + 1).slice(done, len(part)).to_numpy()
                held = [c.slice(done, len(part)) for c in batch.columns[:n_carry]]
                made = [pa.array(v, t) for v, t in zip(_scored(w, *_stream(part), more, room), (pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*held, *made], names=[*batch.schema.names[:n_carry], *SCORED.names])
                done += len(part)

    return run


def fit_and_score(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Scores of the documents under a model of the same documents; their numbers are stored once for both."""
    carry = ["doc_id"] if carry is None else carry
    if clash := set(carry) & set(SCORED.names):
        raise ValueError(f"carried columns repeat result columns: {sorted(clash)}")
    counted = word_counts(docs, text)
    vocab = vocabulary(docs, text, counted)
    pairs, shared = spelling(counted, vocab)
    # Names of their own: the carried ones may repeat those of the stored columns, or each other but for case.
    held = [f"c{i}" for i in range(len(carry))]
    named = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held)], F.col(f"`{text}`").alias("text"))
    rows = stored(encoded(named, "text", numbers(vocab), pairs, held), "numbers")
    flat = trained(rows, initial(vocab, shared))
    scored = rows.mapInArrow(_score(flat), T.StructType([*rows.schema.fields[: len(held)], *SCORED.fields]))
    return scored.toDF(*carry, *SCORED.names)
