import numpy as np
import pytest

from driftlake.llm import ann_tree as at

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every=20):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good], np.float32).astype(np.float64)
    out = {}
    for q, v in good:
        if q % every == 0:
            s = (x * np.array(v, np.float32).astype(np.float64)).sum(axis=1)
            score = {}
            for i, y in zip(ids.tolist(), s.tolist(), strict=True):
                if i != q:
                    score[i] = max(y, score.get(i, -np.inf))
            out[q] = sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def as_lists(found):
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = as_lists(at.search(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.92
    true = {(q, i): s for q in want for i, s in want[q]}
    for q, found in got.items():
        assert len(found) == 20 and all(s == pytest.approx(true[q, i], abs=1e-12) for i, s in found if (q, i) in true)


def test_exact_on_a_few_rows_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, 0) for i in range(60, 160)] + [(i, rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(30)]
    bad = [(None, same, 0), (200, None, 0), (220, [0.0] * 3, 0), (240, [1.0, None, 2.0], 0), (260, [1.0, float("nan"), 0.0], 0), (280, [float("inf"), 0.0, 0.0], 0), (300, [], 0), (320, [1.0, 2.0], 0)]
    rows += bad[:7] + [rows[0]] * 5
    got = as_lists(at.search(spark.createDataFrame([*rows, bad[7]], SCHEMA)).collect())
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_fewer_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, 1.0], 1), (20, [-1.0, 0.0], 1)]
    got = as_lists(at.search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 20], 20: [1, 0]}
    assert at.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert at.search(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).collect() == []


def test_visits_follow_the_priority_queue():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    tree = at.fit(x, 3000)
    leaf = tree.assign(x)
    tree.rows = np.bincount(leaf, minlength=tree.leaf.max() + 1)
    assert tree.rows.sum() == 3000 and len(tree.rows) > 8
    order = tree.visits(tree.centres @ x[0], len(tree.rows), 0)
    assert sorted(order) == list(range(len(tree.rows)))
    assert len(tree.visits(tree.centres @ x[0], 1, 700)) > 1


def test_nearly_orthogonal_vectors_of_large_norm():
    rng = np.random.default_rng(4)
    q = np.zeros((1, 8))
    q[0, 0] = 4e6
    x = rng.standard_normal((500, 8)) * 4e6
    x[:, 0] = rng.standard_normal(500) * 1e-9
    (_, ids, scores), = at.best(q, x, np.arange(500), 20)
    exact = (x * q).sum(axis=1)
    assert ids.tolist() == np.lexsort((np.arange(500), -exact))[:20].tolist() and (scores == exact[ids]).all()


def test_products_beyond_the_range_of_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(4) * 1e200], 0) for i in range(60)]
    out = at.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.query_id for r in out} == {0, 20, 40} and len(out) == 60
    for r in out:
        with np.errstate(over="ignore", invalid="ignore"):
            want = sum(a * b for a, b in zip(rows[r.query_id][1], rows[r.vec_id][1]))
        assert r.score == want or (np.isnan(want) and r.score == -np.inf)
