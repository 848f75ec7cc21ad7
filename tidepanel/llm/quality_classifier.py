"""Quality from compressed sizes: one zstandard dictionary trained on good text, one on bad.

A text is cut in blocks; each block is compressed with both dictionaries. The normalised difference over the
whole text, its extremes over the blocks, the size under the good dictionary and the length are calibrated to
a probability by ridge logistic regression on the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fields, map_texts
from tidepanel.llm.compression import labelled_sample, probability, remainder, solve_logistic, trained

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BLOCK = 512
DICTIONARY = 65_536
#: Blocks of each class a dictionary is trained on.
TRAIN_BLOCKS = 16_000


@dataclass
class Model:
    good: bytes
    bad: bytes
    beta: np.ndarray


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=zstandard.ZstdCompressionParameters.from_level(3, **bare)
    )


def features(good: bytes, bad: bytes):
    """A function from texts to the design matrix of the calibration."""
    c_good, c_bad = _compressor(good), _compressor(bad)

    def one(text: str) -> tuple[float, ...]:
        parts = blocks(text)
        g = np.fromiter((len(c_good.compress(x)) for x in parts), dtype=float, count=len(parts))
        b = np.fromiter((len(c_bad.compress(x)) for x in parts), dtype=float, count=len(parts))
        n = np.fromiter((len(x) + 16 for x in parts), dtype=float, count=len(parts))
        each = (b - g) / n
        return 1.0, 5 * (b - g).sum() / n.sum(), 5 * each.min(), 5 * each.max(), g.sum() / n.sum(), np.log1p(n.sum()) / 5

    return lambda texts: np.asarray([one(t) for t in texts], dtype=float).reshape(len(texts), 6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Dictionaries and calibration from the labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    rng = np.random.default_rng(1)
    made = []
    for mark in (1, 0):
        parts = [x for m, t in sample if m == mark for x in blocks(t)]
        made.append(trained([parts[i] for i in rng.permutation(len(parts))[:TRAIN_BLOCKS]], DICTIONARY))
    if not sample:
        return Model(*made, np.zeros(6))
    x = features(*made)([t for _, t in sample])
    return Model(*made, solve_logistic(x, np.asarray([m for m, _ in sample], dtype=float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts are scored as empty ones; repeated rows are scored alike. A model fitted on no label gives 0.5.
    """

    def prepare():
        design = features(model.good, model.bad)

        def work(texts: list) -> list:
            p = probability(design([t or "" for t in texts]), model.beta)
            return [p, (p >= threshold).astype(np.int32)]

        return work

    marked = docs.select("doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(marked, "text", fields(score="double", predicted="int"), prepare, ["doc_id", "held_out"])
