import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwright.llm import whitening
from panelwright.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.001"


def rotated(values, seed):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = turn @ np.diag(values) @ turn.T
    return (a + a.T) / 2


@given(st.lists(st.sampled_from([0.0, 1e-9, 1.0, 1.0 + 1e-12, 1.0 + 1e-7, 2.0, 2.0, 1e4]), min_size=1, max_size=12), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_clustered_eigenvalues(values, seed):
    a = rotated(np.array(values), seed)
    found, x = whitening.eigenvectors(a)
    size = max(values) or 1.0
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 2e-14 * size * len(a)
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=1e-13 * size)


def test_float32_vectors_are_corrected():
    a = rotated(np.linspace(1, 2, 64), 3)
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(start.T @ start - np.eye(64)).max() > 1e-8
    _, exact = np.linalg.eigh(a)
    _, x = whitening.eigenvectors(a)
    assert np.abs(np.abs((exact[:, ::-1] * x).sum(0)) - 1).max() < 1e-13


def plain(rows):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} of (id, vector) rows."""
    x = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(i, []).append([int(np.floor(256 * float(c))) for c in v])
    distinct = sorted({tuple(v) for vs in x.values() for v in vs})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    mean = np.array([s / n for s in sums])
    centred = np.array(distinct) - mean
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, vs in x.items():
        for row in vs:
            deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums))
            whitened = np.abs((np.array(row) - mean) @ vectors / np.sqrt(values))
            out.setdefault(i, []).append((n, deviation, whitened, values / np.trace(v)))
    return out


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    want = plain(rows)
    got = QUERIES["op11_whitened_embeddings"](spark, SMALL).collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - whitened[r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, -1, "x") for i, v in rows],
                                 "vec_id bigint, embedding array<double>, n int, component int, x string")


def test_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 1.0]),
           (55, [1.0, 2.0]), (3, rows[3][1]), (None, rows[4][1])]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    want = plain(rows)
    assert len(got) == 3 * 42 and {r.n for r in got} == {40}
    for r in got:
        _, deviation, whitened, _ = want[4 if r.vec_id is None else r.vec_id][0]
        assert r.deviation == deviation and abs(abs(r.whitened) - whitened[r.component - 1]) < 1e-9
    assert len({round(sum(r.explained for r in got if r.vec_id == i), 9) for i in (1, 2)}) == 1
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_no_variance_and_huge_entries(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(0, None, None, None)] * 4
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 6.0])])).collect()
    assert [r.whitened is None for r in got] == [r.component == 2 for r in got]
    big = [(1, [2.0 ** 50, 0.0]), (2, [-(2.0 ** 50), 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(vectors(spark, big)).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None} and {r.deviation for r in got if r.vec_id == 3} == {(3 * 1280 - 1536) ** 2}


@pytest.mark.parametrize("size", [2 ** 20, 2 ** 40])
def test_exact_deviations(size):
    model = whitening.Whitening(10 ** 6, [7, -size], np.ones(1), np.ones((2, 1)), np.ones(1))
    x = np.array([[size, -size], [3, 5]])
    assert model.deviations(x) == [sum((10 ** 6 * int(c) - s) ** 2 for c, s in zip(r, [7, -size])) for r in x]
