"""Whitening of embeddings by QDWH spectral divide and conquer.

Sums and the centred covariance are gathered in two passes. The covariance, whose size is that of the vectors alone,
is then split on the driver: the polar factor U of V - s*I, found by dynamically weighted Halley iterations with QR,
has eigenvalues 1 and -1, and (I + U) / 2 projects on the components whose eigenvalue passes s. Bases of both ranges
split V in two diagonal blocks, each split again until single components remain. All rows are then projected with the
same components, which travel with the tasks.

Entries c become whole numbers floor(64 * c) + 1000000, so sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import fields

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Larger entries (in steps of 1/64) are no whole numbers a double can tell apart.
LARGEST = 2.0**52
#: Components of a smaller share of the largest eigenvalue are noise of rounding and cannot be scaled to variance 1.
RANK_TOLERANCE = 1e-12
EPS = np.finfo(float).eps

PARTS = fields(size="int", n="long", sums="array<long>")
PRODUCTS = fields(place="int", total="double")


# --- the spectral decomposition -------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """U of A = U H for symmetric A by QDWH; None if A is singular to working precision."""
    d = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return None
    x = a / norm
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))  # at most the smallest singular value
    except np.linalg.LinAlgError:
        return None
    if not least > 4 * d * EPS:
        return None
    low = min(least, 1.0)
    for _ in range(40):
        q = low * low
        e = np.cbrt(4 * (1 - q) / (q * q))
        h = np.sqrt(1 + e) + 0.5 * np.sqrt(max(0.0, 8 - 4 * e + 8 * (2 - q) / (q * np.sqrt(1 + e))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(d)]))[0]
        new = b / c * x + (h - b / c) / np.sqrt(c) * basis[:d] @ basis[d:].T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (h + b * q) / (1 + c * q))
        if moved <= (4 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            return x
    return None


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of A; None if A is a multiple of the identity."""
    d = len(a)
    centre = np.trace(a) / d
    spread = np.linalg.norm(a - centre * np.eye(d))
    if spread <= 4 * d * EPS * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    # The mean lies strictly between the least and the greatest eigenvalue; next to an eigenvalue, move off it.
    for shift in (float(np.median(np.diag(a))), centre, *(centre + spread / np.sqrt(d) * rng.uniform(-0.9, 0.9, 30))):
        u = polar_factor(a - shift * np.eye(d))
        if u is None:
            continue
        rank = round((d + np.trace(u)) / 2)
        if not 0 < rank < d:
            continue
        high, low = (np.eye(d) + u) / 2, (np.eye(d) - u) / 2
        q = np.hstack([high @ rng.normal(size=(d, rank)), low @ rng.normal(size=(d, d - rank))])
        for _ in range(3):
            q = np.linalg.qr(q)[0]
            rest = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
            if rest <= 8 * d * EPS * np.linalg.norm(a):
                return q[:, :rank], q[:, rank:]
            q = np.hstack([high @ q[:, :rank], low @ q[:, rank:]])
    raise ArithmeticError("no shift splits the covariance")


def spectral(v: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix. Equal inputs give equal results."""
    d = len(v)
    rng = np.random.default_rng(seed)
    blocks, vectors = [np.eye(d)] if d else [], []
    while blocks:
        basis = blocks.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        halves = _split(a, rng) if len(a) > 1 else None
        if halves is None:
            vectors.append(basis)
        else:
            blocks += [np.linalg.qr(basis @ h)[0] for h in halves]
    q = np.hstack(vectors) if vectors else np.zeros((0, 0))
    q = np.linalg.qr(q)[0] if d else q
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


# --- passes over the vectors ----------------------------------------------------------------------------------------


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid rows, their offsets, flat x-values); a row with a null or unusable entry is not valid."""
    lists = column.cast(pa.list_(pa.float64()))
    present = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(present, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(flat * SCALE)
        bad = ~(np.abs(x) <= LARGEST)
    starts = np.r_[0, np.cumsum(sizes)]
    n_bad = np.r_[0, np.cumsum(bad)]
    valid = present & (sizes > 0) & (n_bad[starts[1:]] == n_bad[starts[:-1]])
    return np.flatnonzero(valid), starts, np.where(bad, 0, x).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count and their x-vectors of length ``size``."""
    rows, starts, flat = whole_numbers(column)
    rows = rows[starts[rows + 1] - starts[rows] == size]
    return rows, flat[starts[rows][:, None] + np.arange(size)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        rows, starts, _ = whole_numbers(batch.column(0))
        for size in np.unique(starts[rows + 1] - starts[rows]).tolist():
            x = _matrix(batch.column(0), size)[1]
            n, total = held.get(size, (0, 0))
            held[size] = (n + len(x), total + x.sum(axis=0))
    if held:
        values = [list(held), [n for n, _ in held.values()], [t.tolist() for _, t in held.values()]]
        types = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=PARTS.names)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if n * (LARGEST + SHIFT) < 2.0**62 or n * int(np.abs(x).max(initial=0)) < 2**62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _exact(x, n, sums).astype(float) / n


def _products(size: int, make) -> object:
    """Sums of products of the rows of ``make(column)``, upper triangle, with the sums of the rows behind."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, total, seen = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            c = make(batch.column(0))
            squares += c.T @ c
            total += c.sum(axis=0)
            seen = seen or len(c) > 0
        if seen:
            out = np.r_[squares[upper], total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=PRODUCTS.names)

    return run


def _covariance(vectors: DataFrame, size: int, n: int, make) -> np.ndarray:
    """Covariance with divisor n of the rows that ``make`` gives, from one pass; (size + 3) * size / 2 numbers reach the driver."""
    parts = vectors.mapInArrow(_products(size, make), PRODUCTS).groupBy("place").agg(F.sum("total").alias("total"))
    flat = np.zeros(size * (size + 3) // 2)
    for place, total in parts.collect():
        flat[place] = total
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat[: size * (size + 1) // 2] / n
    mean = flat[size * (size + 1) // 2 :] / n
    out = out + np.triu(out, 1).T
    return out - np.outer(mean, mean)


class Model:
    """n, S, eigenvalues and components of a fit list, and the largest error of the whitened covariance."""

    def __init__(self, size: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.size, self.n, self.sums = size, n, np.array(sums, dtype=np.int64)
        self.values, self.vectors, self.trace = values, vectors, trace
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - S; null beyond 64 bits."""
        d = _exact(x, self.n, self.sums)
        if len(d) and max(abs(int(d.max())), abs(int(d.min()))) ** 2 * max(1, self.size) >= 2**63:
            sums = [sum(int(v) ** 2 for v in row) for row in d]
            return [s if s < 2**63 else None for s in sums]
        return (d * d).sum(axis=1).tolist()


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Components of the vectors of the most frequent length (of equally frequent ones the longest); None without any."""
    vectors = table.select(F.col(f"`{vector}`"))
    parts = vectors.mapInArrow(_sums, PARTS)
    by_size = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if by_size is None:
        return None
    size, n = by_size
    each = parts.where(F.col("size") == size).select(F.posexplode("sums").alias("place", "s"))
    sums = [0] * size
    for place, s in each.groupBy("place").agg(F.sum("s")).collect():
        sums[place] = s
    held = np.array(sums, dtype=np.int64)
    v = _covariance(vectors, size, n, lambda column: _centred(_matrix(column, size)[1], n, held))
    values, axes = spectral(v)
    keep = np.flatnonzero(values > RANK_TOLERANCE * max(values.max(initial=0.0), 0.0))[:components]
    model = Model(size, n, sums, values[keep], axes[:, keep], float(np.trace(v)))
    if len(keep):
        got = _covariance(vectors, len(keep), n, lambda column: model.project(_matrix(column, size)[1]))
        model.identity_error = float(np.abs(got - np.eye(len(keep))).max())
    return model


def whiten(table: DataFrame, vector: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS, model: Model | None = None) -> DataFrame:
    """Carried columns (default ``vec_id``), n, deviation, whitened and explained (arrays by component) and identity_error.

    Rows are dropped whose vector is null or empty, holds a null, non-finite or unusable entry (beyond 2**52 / 64), or
    has another length than most. Null ids and repeated rows stay and count like any other. Components end at the rank
    of the covariance, so one vector, or equal ones, give empty arrays; tied eigenvalues get some orthonormal basis of
    their space. An empty table gives an empty result. A deviation beyond 64 bits is null. Other columns are not read; a
    carried column named as a result column raises ``ValueError``. Vectors are bounded by one row each; the driver
    gets numbers by dimension alone: d sums and d * (d + 3) / 2 products.
    """
    names = ["vec_id"] if carry is None else carry
    made = T.StructType([*fields(n="long", deviation="long").fields, *fields(whitened="array<double>", explained="array<double>", identity_error="double").fields])
    if clash := set(names) & set(made.names):
        raise ValueError(f"carried columns repeat result columns: {sorted(clash)}")
    model = fit(table, vector, components) if model is None else model
    rows = table.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{vector}`").alias("__vector"))
    schema = T.StructType([*rows.schema.fields[:-1], *made.fields])
    if model is None:
        return rows.where(F.lit(False)).select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in made])
    explained = (model.values / model.trace).tolist() if model.trace else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(len(names)), model.size)
            k = len(at)
            white = model.project(x) if len(model.values) else np.zeros((k, 0))
            offsets = pa.array(np.arange(k + 1, dtype=np.int32) * white.shape[1])
            arrays = [
                pa.array([model.n] * k, pa.int64()), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
                pa.array([explained] * k, pa.list_(pa.float64())), pa.array([model.identity_error] * k, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns[: len(names)]], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)
