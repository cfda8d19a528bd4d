import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from driftlake.llm import suffix_dedup as sd


def naive(docs):
    """doc_id, bytes, removed, spans, hash of the kept bytes, by a table of all windows."""
    data = [(sd._LAST if i is None else i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, b in data:
        for k in range(len(b) - sd.WINDOW + 1):
            w = b[k : k + sd.WINDOW]
            least[w] = min(i, least.get(w, sd._LAST))
    out = []
    for (i, b), (real, _) in zip(data, docs, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - sd.WINDOW + 1):
            if least[b[k : k + sd.WINDOW]] < i:
                gone[k : k + sd.WINDOW] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((real, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=9, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    line = "A very common line that stands in many documents and is long enough to be found."
    docs, pool = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 150)))
        if pool and rng.random() < 0.5:
            src = rng.choice(pool)
            a = rng.randrange(len(src) + 1)
            text = text[: len(text) // 2] + src[a : a + rng.randrange(20, 300)] + text[len(text) // 2 :]
        if rng.random() < 0.4:
            text = line + text
        if rng.random() < 0.1:
            text += "ab" * 80 + "\0" * 70
        pool.append(text)
        docs.append((i if rng.random() < 0.9 else rng.choice([None, 3, -5]), text))
    docs += [docs[5], docs[6], (1000, docs[7][1]), (1001, None), (None, ""), (1002, "z" * 400), (1003, "z" * 300)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("block", "bucket", "many"), [(4 << 20, 4 << 20, 256), (3000, 2000, 256), (3000, 5000, 3)])
def test_equals_brute_force(spark, monkeypatch, block, bucket, many):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(sd, "MANY", many)
    docs = corpus()
    out = sd.remove_repeats(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int")).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == naive(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert sum(r.n_removed for r in out) > 3000


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(3)
    for alphabet, n in ((2, 300), (4, 500), (200, 400), (1, 130)):
        data = rng.integers(1, alphabet + 1, n).astype(np.uint8)
        data[rng.integers(0, n, 5)] = 0
        order = sd.suffix_order(data)
        assert sorted(order.tolist()) == list(range(n))
        text = data.tobytes()
        tops = [text[i : i + sd.WINDOW].ljust(sd.WINDOW, b"\0") for i in order.tolist()]
        assert tops == sorted(tops)
        wanted = rng.random(n) < 0.3
        some = sd.suffix_order(data, wanted=wanted)
        assert set(some.tolist()) >= set(np.flatnonzero(wanted).tolist())
        assert [text[i : i + sd.WINDOW] for i in some.tolist()] == sorted(text[i : i + sd.WINDOW] for i in some.tolist())
        same = sd.equal_prefixes(data, order)
        assert same.tolist() == [False] + [a == b for a, b in zip(tops[1:], tops[:-1], strict=True)]


def test_every_window_has_one_stretch():
    texts = [t or "" for _, t in corpus(n=30)]
    data, offsets = sd.raw_bytes(pa.array(texts))
    runs = sd.stretches(data, offsets)
    own = sorted(int(a) + k for a, n in zip(runs["start"], runs["count"], strict=True) for k in range(n))
    want = [int(a) + k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in range(b - a - sd.WINDOW + 1)]
    assert own == want
    names = {}
    text = data.tobytes()
    for anchor, key, a, n in zip(*(runs[k].tolist() for k in ("anchor", "key", "start", "count")), strict=True):
        for k in range(n):
            assert names.setdefault(text[a + k : a + k + sd.WINDOW], (anchor, key)) == (anchor, key)
