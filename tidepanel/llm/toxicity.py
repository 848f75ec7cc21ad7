"""Toxicity by compression distance: separate zstandard dictionaries of ordinary and of toxic text.

The ordinary dictionary is a raw-content dictionary of stretches drawn from ordinary texts. The toxic one
continues it with windows drawn from toxic texts, those whose byte grams are far more usual there. A window is
a word between blanks, followed by a fixed ordinary stretch, as zstandard looks for no match in the last bytes
of its input. Its gain is the compressed size under the ordinary dictionary less that under the toxic one. How
many windows of a text reach each gain, absolutely and by length, is calibrated to a probability by ridge
logistic regression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fields, map_texts
from tidepanel.llm.compression import labelled_sample, probability, remainder, solve_logistic

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Bytes of a gram, and how much more often toxic texts must hold it.
GRAM, RATIO, COUNT_RATIO = 5, 2.0, 8.0
ORDINARY_BYTES, TOXIC_BYTES = 96_000, 4_000
GAINS = (1, 2, 3, 4)
#: Gains a task remembers.
MEMORY = 300_000


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    beta: np.ndarray


def windows(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _grams(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _contrast(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Toxic windows with a gram of far higher rate, by texts and by occurrences, rarest first."""
    seen, texts = [Counter(), Counter()], [Counter(), Counter()]
    for k, docs in enumerate((toxic, ordinary)):
        for words in docs:
            mine = Counter(g for w in words for g in _grams(w))
            seen[k].update(mine)
            texts[k].update(mine.keys())
    total = [max(1, sum(c.values())) for c in seen]
    least = max(4, 0.02 * len(toxic))
    grams = {
        g for g, n in texts[0].items()
        if n >= least and n / len(toxic) > RATIO * (texts[1][g] + 1) / max(1, len(ordinary))
        and seen[0][g] / total[0] > COUNT_RATIO * (seen[1][g] + 3) / total[1]
    }
    count = Counter(w for words in toxic for w in words)
    kept = {w: n for w, n in count.items() if n > 1 and not grams.isdisjoint(_grams(w))}
    return sorted(kept, key=lambda w: (kept[w], w))


def gains(ordinary: bytes, toxic: bytes):
    """A function from a window to its gain; a task's gains are remembered up to ``MEMORY``."""
    raw = lambda b: zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    plain = zstandard.ZstdCompressor(dict_data=raw(ordinary), compression_params=params).compress
    other = zstandard.ZstdCompressor(dict_data=raw(ordinary + toxic), compression_params=params).compress
    after = b" " + ordinary[len(ordinary) // 3 : len(ordinary) // 3 + 48]
    known: dict[bytes, int] = {}

    def gain(word: bytes) -> int:
        got = known.get(word)
        if got is None:
            if len(known) >= MEMORY:
                known.clear()
            data = b" " + word + after
            got = known[word] = len(plain(data)) - len(other(data))
        return got

    return gain


def features(ordinary: bytes, toxic: bytes):
    """A function from texts to the design matrix of the calibration."""
    gain = gains(ordinary, toxic) if ordinary else lambda word: 0

    def one(text: str) -> list[float]:
        words = Counter(windows(text))
        n = sum(words.values())
        reached = Counter()
        for w, k in words.items():
            if (g := gain(w)) > 0:
                reached[min(g, GAINS[-1])] += k
        count = np.cumsum([reached[g] for g in reversed(GAINS)])[::-1]
        return [1.0, *np.log1p(count), *(10 * count / (n + 20)), np.log1p(n) / 5]

    return lambda texts: np.asarray([one(t) for t in texts], dtype=float).reshape(len(texts), 2 + 2 * len(GAINS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Dictionaries and calibration from the labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    toxic, ordinary = ([windows(t) for m, t in sample if m == mark] for mark in (1, 0))
    lines = [b" " + b" ".join(words[i : i + 8]) + b" " for words in ordinary for i in range(0, len(words), 8)]
    order = np.random.default_rng(3).permutation(len(lines))[:20_000]
    base = b"".join(lines[i] for i in order)[:ORDINARY_BYTES]
    contrast = [b" " + w + b" " for w in _contrast(toxic, ordinary)] if toxic else []
    special = b"".join(contrast)[-TOXIC_BYTES:]
    if not sample:
        return Model(base, special, np.zeros(2 + 2 * len(GAINS)))
    x = features(base, special)([t for _, t in sample])
    return Model(base, special, solve_logistic(x, np.asarray([m for m, _ in sample], dtype=float), 0.3))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts are scored as empty ones; repeated rows are scored alike. A model fitted on no label gives 0.5.
    """

    def prepare():
        design = features(model.ordinary, model.toxic)

        def work(texts: list) -> list:
            p = probability(design([t or "" for t in texts]), model.beta)
            return [p, (p >= threshold).astype(np.int32)]

        return work

    marked = docs.select("doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(marked, "text", fields(score="double", predicted="int"), prepare, ["doc_id", "held_out"])
