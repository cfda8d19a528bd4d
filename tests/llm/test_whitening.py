import math

import numpy as np
import pytest

import __spark_entry__ as entry
from driftlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened int"


def naive(vectors):
    kept = [(i, [float(c) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(0)
    deviations = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums)) for row in x]
    centred = np.array([[float(n * int(e) - int(s)) / n for e, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, deviations, centred, values, axes, np.trace(cov)


def compare(rows, vectors, components=8):
    kept, n, deviations, centred, values, axes, trace = naive(vectors)
    k = min(components, len(values))
    assert len(rows) == len(kept) * k
    by = {(r.vec_id, r.component): r for r in rows}
    for j in range(k):
        want = centred @ axes[:, j] / math.sqrt(values[j])
        got = np.array([by[i, j + 1].whitened for i, _ in kept])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert by[kept[0][0], j + 1].explained == pytest.approx(values[j] / trace, rel=1e-9)
    assert all(by[i, 1].deviation == d and by[i, 1].n == n for (i, _), d in zip(kept, deviations))
    assert rows[0].identity_error < 1e-9


def test_query_equals_eigenvectors_of_the_covariance(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = entry.queries()["op13_whitening"](spark, sf).collect()
    compare(rows, vectors)


def test_odd_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) * np.arange(1, 13)]) for i in range(60)]
    good += [(60, good[0][1]), (60, good[0][1])]
    odd = [(90, None), (91, [None] * 12), (92, [float("nan")] * 12), (93, [float("inf")] + [0.0] * 11), (94, []), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in good + odd], SCHEMA)
    rows = whitening.whiten(df).collect()
    assert {r.vec_id for r in rows} == set(range(61))
    once = [(i, v) for i, v in good]
    kept, n, deviations, *_ = naive(once)
    assert n == 62 and len(rows) == 62 * 8
    assert {r.deviation for r in rows if r.vec_id == 60} == {deviations[0]}


def test_few_vectors_equal_vectors_and_none(spark):
    frame = lambda v: spark.createDataFrame([(i, x, 0, "x", 1) for i, x in enumerate(v)], SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([[1.0, 2.0]] * 5)).count() == 0
    two = whitening.whiten(frame([[0.0, 0.0, 0.0], [1.0, 2.0, 0.5]])).collect()
    assert sorted({r.component for r in two}) == [1] and sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0]
    assert two[0].explained == pytest.approx(1.0)


def test_large_entries_stay_exact(spark):
    vectors = [(i, [float(np.float32(3e5 * i)), float(i % 3), float(np.float32(1e4 * (i % 7)))]) for i in range(1000)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in vectors], SCHEMA)
    _, n, deviations, *_ = naive(vectors)
    rows = {r.vec_id: r for r in whitening.whiten(df).where("component = 1").collect()}
    assert all(rows[i].deviation == (d if d < 2**63 else None) for i, d in enumerate(deviations))
    assert whitening.whiten(spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)], 0, "x", 1) for i in range(9)], SCHEMA)).count() > 0


def test_subspace_iteration_widens_until_certified():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for spectrum in (np.linspace(1, 2, 120)[::-1], np.r_[np.full(40, 3.0), np.full(80, 1.0)], 0.8 ** np.arange(120), np.r_[5.0, np.zeros(119)]):
        a = basis * spectrum @ basis.T
        values, axes = whitening.leading_eigenvectors(lambda q: a @ q, 120, 8)
        assert np.allclose(values, spectrum[:8], atol=1e-12)
        assert np.abs(a @ axes - axes * values).max() < 1e-11 and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
