import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftlake.llm import bagminhash as bm

WORDS = [f"w{i}" for i in range(3000)]


def bag(text):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values()) if x | y else 0.0


def corpus(seed=7):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.randrange(3, 150))
        if rng.random() < 0.2:
            base = base[:6] * 12
        docs.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w))
    docs += [docs[3]] * 4 + ["", None, "one", "One", "a b c d", "  "]
    rng.shuffle(docs)
    return docs


def classes(docs):
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i] or "") == (docs[j] or "") or jaccard(docs[i], docs[j]) >= bm.SIMILAR:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(docs))]


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = rng.choices(WORDS, k=200)
    pairs = [(" ".join(base), " ".join(base[k:] + rng.choices(WORDS, k=k))) for k in (0, 10, 40, 120)]
    pairs.append((" ".join(base[:10] * 30), " ".join(base[:10] * 17 + rng.choices(WORDS, k=40))))
    for a, b in pairs:
        sig = bm.signatures(*bm.weighted(*bm.shingles(pa.array([a, b]))), 2, slots=4096)
        got, want = (sig[0] == sig[1]).mean(), jaccard(a, b)
        assert abs(got - want) < 4 * (want * (1 - want) / 4096) ** 0.5 + 1e-9
        assert bm.similarity(pa.array([a]), pa.array([b]))[0] == pytest.approx(want)


def test_a_text_has_one_signature_in_any_batch():
    texts = [t or "" for t in corpus()]
    whole = bm.signatures(*bm.weighted(*bm.shingles(pa.array(texts))), len(texts))
    for i, t in enumerate(texts):
        assert (bm.signatures(*bm.weighted(*bm.shingles(pa.array([t]))), 1)[0] == whole[i]).all()
        assert (whole[i] == 0).all() == (not t.split())


@pytest.mark.parametrize("leaders", [2, 0])
def test_classes_equal_brute_force(spark, monkeypatch, leaders):
    if not leaders:
        # without verified leaders, the comparison of mixed buckets must find all links
        monkeypatch.setattr(bm, "leader_pairs", lambda nodes, f=bm.leader_pairs: (f(nodes)[0], f(nodes)[1].limit(0)))
        monkeypatch.setattr(bm, "BLOCK", 3)
    docs = corpus()
    got = bm.classify(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    want = classes(docs)
    assert [r.class_id for r in sorted(got)] == want
    assert sum(r.first for r in got) == len(set(want))
    assert {r.doc_id: r.class_size for r in got} == {i: want.count(c) for i, c in enumerate(want)}


def test_chain_is_one_component(spark):
    rows = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    got = {(bytes(r.bmh_node), bytes(r.bmh_class)) for r in bm.components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    assert got == {(bytes([i]), b"\0") for i in range(41)} | {(b"\xf0", b"\xf0"), (b"\xf1", b"\xf0")}


def test_keep_first(spark):
    text = " ".join(WORDS[:80])
    rows = [(5, text, "x", 1), (3, text + " more", "y", 2), (3, text + " more", "y", 2), (None, text, None, 3), (9, "other words entirely", "z", 4), (None, None, "n", 5), (None, "", "m", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, first int")
    got = bm.keep_first(docs).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 3, 9] and got[0].asDict().keys() == {"doc_id", "text", "source", "first"}
    assert bm.keep_first(docs.limit(0)).count() == 0
