import numpy as np
import pytest

from tidepanel.llm import queries, whitening


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string, whitened string")


def plain(rows, size, most=32):
    """Whole numbers, covariance and eigenvectors by numpy."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    d = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    v = d.T @ d / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, deviation, d @ axes / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("size, n", [(5, 200), (40, 300), (64, 1000)])
def test_against_eigh(spark, size, n):
    rng = np.random.default_rng(size)
    x = (rng.normal(size=(n, size)) * np.linspace(0.5, 3, size)).astype(np.float32).tolist()
    out = whitening.whiten(vectors(spark, [(i, v, "", "") for i, v in enumerate(x)]).repartition(7)).collect()
    rows = {r.vec_id: r for r in out}
    want_n, deviation, white, explained = plain(x, size)
    assert [rows[i].deviation for i in range(n)] == deviation and {r.n for r in out} == {want_n}
    got = np.array([rows[i].whitened for i in range(n)])
    signs = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * signs, atol=1e-8) and np.allclose(rows[0].explained, explained, rtol=1e-10)
    assert all(r.identity_error < 1e-9 for r in out)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(size=(50, 4)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [3e38, 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, "n", "w") for i, v in enumerate(good)] + [(100 + i, v, "n", "w") for i, v in enumerate(bad)] + [(None, good[0], "n", "w"), (3, good[3], "n", "w")]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted(repr(r.vec_id) for r in out) == sorted([*map(str, range(50)), "None", "3"]) and {r.n for r in out} == {52}
    want = plain([*good, good[0], good[3]], 4)
    assert sorted(r.deviation for r in out) == sorted(want[1])
    twice = [r.whitened for r in out if r.vec_id == 3]
    assert twice[0] == twice[1]


def test_flat_and_empty_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, "", "")])).collect() == []
    out = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "", "")] * 3)).collect()
    assert [(r.whitened, r.deviation, r.identity_error) for r in out] == [([], 0, 0.0)] * 3
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0], "", "") for i in range(9)], "double")).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-9 for r in line)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, []), carry=["n"])


def test_polar_factor_and_splits():
    rng = np.random.default_rng(1)
    for d in (2, 7, 33):
        a = rng.normal(size=(d, d))
        a = a + a.T
        values, axes = np.linalg.eigh(a)
        assert np.allclose(whitening.polar_factor(a), axes @ np.diag(np.sign(values)) @ axes.T, atol=1e-11)
    assert whitening.polar_factor(np.ones((3, 3))) is None
    for v in (np.eye(6), np.zeros((3, 3)), np.diag([1, 1, 2, 2, 2.0]), np.ones((5, 5)), np.diag([1e-9, 1, 1e9]), np.zeros((0, 0))):
        values, q = whitening.spectral(v)
        assert np.allclose(q @ np.diag(values) @ q.T, v, atol=1e-12 * max(1, np.abs(v).max(initial=0)))
        assert np.allclose(q.T @ q, np.eye(len(v)), atol=1e-13) and np.all(np.diff(values) <= 0)


def test_large_sums_stay_exact():
    n = 10**12
    model = whitening.Model(2, n, [1_000_010 * n - 7, 1_000_000 * n + 3], np.ones(2), np.eye(2), 2.0)
    x = np.array([[1_000_011, 1_000_000], [1_000_010, 1_000_000]])
    assert model.deviations(x) == [None, 58]  # (n + 7)**2 + 9 passes 64 bits; 49 + 9


def test_query_has_a_row_for_each_component(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_embedding_whitening"](spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, deviation, white, explained = plain([r.embedding for r in table], 64)
    got = {(r.vec_id, r.component): r for r in rows.collect()}
    k = white.shape[1]
    assert len(got) == len(table) * k and {r.n for r in got.values()} == {n}
    for i, r in enumerate(table):
        assert got[r.vec_id, 1].deviation == deviation[i]
    each = np.array([[got[r.vec_id, j + 1].whitened for j in range(k)] for r in table])
    assert np.allclose(each, white * np.sign((each * white).sum(axis=0)), atol=1e-6)
