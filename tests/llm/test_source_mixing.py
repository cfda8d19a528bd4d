import random

import pytest

from driftlake.llm import source_mixing as sm


def reshared(sizes):
    """Targets by sharing all words by weight and resharing what lies above a cap, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: sm.WEIGHTS[i % len(sm.WEIGHTS)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(sm.MOST_REPEATS * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        target = {s: sm.MOST_REPEATS * sizes[s] if s in capped else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in capped and target[s] > sm.MOST_REPEATS * sizes[s]}
        if not above:
            return target
        capped |= above


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for s in [f"s{i}" for i in range(rng.randrange(2, 9))] + [None, "é", ""]:
        for _ in range(rng.choice([1, 3, 40, 400])):
            rows.append((len(rows) if rng.random() < 0.95 else None, rng.choice(["a b\tc ", "word " * rng.randrange(0, 9), None, ""]), s, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_copies(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = reshared(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    out = sm.mix_report(docs).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        if sizes[s] > 300:
            assert abs(n - want[s]) < 0.15 * want[s]
    again = sm.mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sm.mix_report(docs).count() == 0 and sm.mix(docs).count() == 0
