"""Shared parts of the classifiers that compare zstandard dictionaries: labelled sample, dictionaries, calibration."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample a classifier is fitted on: rows per class, and bytes of a sampled text.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 20_000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, training: Column, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES
) -> list[tuple[int, str]]:
    """(label, text) of at most ``rows`` training rows a class with texts of at most ``most`` bytes.

    Rows are taken in order of a hash of the id, so the sample does not depend on partitions. Rows without
    text, id or label are not used.
    """
    marks = labels.where(training & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("mark")).distinct()
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).where((F.octet_length("text") <= most) & (F.length("text") > 0))
    out: list[tuple[int, str]] = []
    for mark in (0, 1):
        # Ids first: only the rows taken carry their text.
        ids = marks.where(F.col("mark") == mark).join(known.select("doc_id"), "doc_id", "left_semi")
        taken = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        got = known.join(F.broadcast(taken), "doc_id").select("mark", "text", F.xxhash64("doc_id").alias("h"))  # ``rows`` ids
        out += [(m, t) for m, t, _ in sorted(map(tuple, got.collect()), key=lambda r: (r[2], r[1]))[:rows]]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """Bytes of a trained dictionary; the samples' own end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def solve_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Ridge logistic coefficients by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = probability(x, beta)
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
