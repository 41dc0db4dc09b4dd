import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, component string"
NAN, INF = float("nan"), float("inf")


def brute(vectors, kept=4):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in vectors}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1][:kept], components[:, ::-1][:, :kept].T, values.sum()


def agrees(rows, vectors):
    x, n, s, values, components, total = brute(vectors)
    found = {}
    for r in rows:
        found.setdefault(r["component"], []).append(r)
        v = x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / total, rel=1e-9) and r["identity_error"] < 1e-10
        assert abs(r["whitened"]) == pytest.approx(abs((v - s / n) @ components[k]) / np.sqrt(values[k]), abs=1e-9)
    for k, own in found.items():  # one sign for all rows
        want = [(x[r["vec_id"]] - s / n) @ components[k - 1] for r in own]
        got = [r["whitened"] for r in own]
        assert np.dot(want, got) == pytest.approx(np.linalg.norm(want) * np.linalg.norm(got) * np.sign(np.dot(want, got)))
    return found


def test_documents(spark, sf):
    rows = W.op13_whitening(spark, sf).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = agrees(rows, vectors)
    assert sorted(found) == [1, 2, 3, 4] and all(len(f) == len(vectors) for f in found.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    good += [(100 + i, v) for i, v in good[:7]]  # copies count once
    odd = [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0]), (503, [NAN, 0.0, 0.0, 0.0, 0.0]), (504, [INF, 0.0, 0.0, 0.0, 0.0]), (505, [1.0, 2.0])]
    rows = W.whiten(spark.createDataFrame([(i, v, "clash") for i, v in good + odd], SCHEMA).repartition(4)).collect()
    assert len(agrees(rows, good)[1]) == len(good) and len(rows) == 4 * len(good)
    twice = W.whiten(spark.createDataFrame([(1, [0.0, 1.0], ""), (1, [1.0, 0.0], ""), (None, [3.0, 3.0], "")], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in twice) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_without_variance(spark):
    same = W.whiten(spark.createDataFrame([(i, [0.5, 0.25, 1.0, 2.0, 3.0], "") for i in range(3)], SCHEMA)).collect()
    assert len(same) == 12 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    line = W.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 0.0], "") for i in range(4)], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert {round(r["explained"], 12) for r in line} == {1.0, 0.0}
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    huge = W.whiten(spark.createDataFrame([(1, [1e30, 0.0], ""), (2, [-1e30, 0.0], ""), (3, [0.0, 1.0], "")], SCHEMA)).collect()
    assert {r["deviation"] is None for r in huge if r["vec_id"] < 3} == {True}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10_000), st.floats(0, 6))
def test_cholesky_and_jacobi(dim, rows, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dim)) * 10.0 ** (rng.random(dim) * spread)
    a = x.T @ x
    g = W.rotated(W.pivoted_cholesky(a))
    scale = np.abs(a).max()
    assert np.abs(g @ g.T - a).max() <= 1e-12 * scale
    gram, norms = g.T @ g, np.linalg.norm(g, axis=0)
    assert (np.abs(gram - np.diag(np.diag(gram))) <= 1e-13 * np.outer(norms, norms)).all()
    assert np.allclose(np.sort(norms**2)[::-1], np.sort(np.linalg.eigvalsh(a))[::-1][: g.shape[1]], atol=1e-11 * scale)
