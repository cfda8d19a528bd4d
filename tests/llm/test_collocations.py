import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from driftlake.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, rank string, n int"


def naive(rows, least=10, share=50, best=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, docs=400):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "c", "ca", "é", "ñandú", "\x00z", "über", "x-y", "中"] + [f"w{i}" for i in range(20)]
    marks = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "!", "\r\n", "?"]
    text = lambda m: "".join(rng.choice(vocabulary[: rng.choice((4, 12, 31))]) + rng.choice(marks) for _ in range(m))
    return [(i, text(rng.randrange(60)), rng.choice(("en", "en", "en", "de", None, "und", "")), "x", 1) for i in range(docs)]


@pytest.mark.parametrize("layout", [{}, {"ranges": 1}, {"ranges": 25}, {"ranges": 40, "fan": 2}])
def test_against_brute_force(spark, monkeypatch, layout):
    rows = corpus(5)
    if "fan" in layout:  # many small shards, so that they are united on several levels
        monkeypatch.setattr(C, "SHARD_BYTES", 4000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(C.phrases(df, **layout)) == naive([r[1:3] for r in rows])


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], SCHEMA)
    assert C.phrases(frame([])).count() == 0
    assert C.phrases(frame([(None, "en"), ("", None), ("...", "de"), (" \t\n", "en")])).count() == 0
    rows = [("one two three", "en")] * 10 + [("one two", None)] * 9 + [("one two", "und")] + [("long " * 60_000, "fr")]
    assert rows_of(C.phrases(frame(rows))) == naive(rows)
    # best=1 keeps the first of equal rank columns
    tied = [("b a. a b. c d", "en")] * 12
    assert rows_of(C.phrases(frame(tied), best=1)) == naive(tied, best=1)


def test_pieces_come_back_as_they_were(spark):
    import pyarrow as pa

    text = " ".join(r[1] for r in corpus(9))
    (_, t), = C._shards(pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]}))
    back = C.Transducer.unpacked(t.packed(0, len(t.keys)))
    assert back.words.to_pylist() == t.words.to_pylist() and (back.keys == t.keys).all() and (back.weights == t.weights).all()
    half = len(t.keys) // 2
    both = C.Transducer.union([C.Transducer.unpacked(t.packed(half, len(t.keys))), C.Transducer.unpacked(t.packed(0, half)), t])
    assert (both.keys == t.keys).all() and (both.weights == 2 * t.weights).all()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(entry.queries()["op12_collocations"](spark, sf)) == naive(rows)
