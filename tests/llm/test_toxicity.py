import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftlake.llm import deobfuscate as D
from driftlake.llm import toxicity as T
from driftlake.llm.common import mixed as D_mixed

# the smaller tables hold some forty toxic rows to learn from
SF = "/root/testdata/sf0.1"
LEET = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$", "t": "7"})


def disguise(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(LEET) if word.translate(LEET) != word else word + word[-1] * 3
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return "-".join(word)
    at = rng.randrange(1, len(word))
    return word[:at] + word[at - 1] * 4 + word[at:]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    ranks = np.array([np.mean(order[scores == s]) for s in scores]) + 1
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, T.learn(docs, labels)


def test_held_out_documents(spark, learnt):
    docs, labels, classifier = learnt
    rows = T.score_texts(docs, classifier).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(*map(np.array, zip(*held))) > 0.95
    clean = [r.predicted for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean(clean) < 0.01


def test_disguised_words_are_caught(spark, learnt):
    docs, labels, classifier = learnt
    rng = random.Random(3)
    insults = ["idiot", "moron", "clown", "scum", "pathetic", "worthless", "disgusting", "stupid", "loser", "trash"]
    known = [w for w in insults if docs.where(F.col("text").contains(w)).count() > 5]
    clean = [r.text for r in docs.where("lang = 'en' and n_chars between 200 and 900").collect() if not any(w in r.text.lower() for w in insults)][:60]
    made = []
    for i, text in enumerate(clean):
        tokens = text.split()
        for w in rng.sample(known, 2):
            tokens.insert(rng.randrange(len(tokens)), disguise(w, rng))
        made.append((i, " ".join(tokens)))
    scored = {r.doc_id: r.predicted for r in T.score_texts(spark.createDataFrame(made, "doc_id long, text string"), classifier).collect()}
    assert np.mean(list(scored.values())) > 0.85
    plain = T.score_texts(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), classifier)
    assert plain.agg(F.avg("predicted")).first()[0] < 0.1


@pytest.mark.parametrize("text, want", [
    ("You 1d10t!", "you idiot"), ("an i d i o t here", "an idiot here"), ("m-o-r-o-n", "moron"), ("cl0wn", "clown"), ("iiiidiooot", "idiot"),
    ("idіot", "idiot"), ("id​iot", "idiot"), ("tr@sh $cum", "trash scum"), ("2024 is 3.14", "2024 is 3.14"), ("", ""), ("...", ""),
])
def test_restored_text(learnt, text, want):
    model = D.Restorer(learnt[2].language).model
    assert D.restore_text(text, model) == want


def test_batches_equal_single_texts(learnt):
    docs = learnt[0]
    model = learnt[2].language
    odd = ["", None, "a b c d", "x", "i. d! i o t", "1d10t " * 3, "ÉÊ!! ENÊÈ!! aaaa", "a b\nc d e", "word" * 300, "k l", "x1y2" * 40, "\x00 é é é"]
    values = [r.text for r in docs.limit(150).collect()] + odd
    restorer = D.Restorer(model)
    distinct, token, text = restorer.batch(pa.array([v or "" for v in values]))
    strip = lambda w: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in w).split()
    got = [sorted(x for t in token[text == i] for x in strip(distinct[int(t)].as_py().decode())) for i in range(len(values))]
    want = [sorted(strip(D.restore_text(v, restorer.model))) for v in values]
    assert got == want


def test_windows_and_pairs_against_python(learnt):
    values = ["the idiot, the Idiot", "a ab abc", "", "don't über 1d10t"]
    restorer = D.Restorer(learnt[2].language)
    distinct, token, text = restorer.batch(pa.array(values))
    code, word = T._windows(distinct)
    got = set(zip(*[x.tolist() for x in T._expanded(token, text, word, code, len(distinct))], strict=True))
    want = set()
    for i, v in enumerate(values):
        for w in D.restore_text(v, restorer.model).split():
            for p in "".join(c if c.isalnum() else " " for c in w).split():
                b = b" " + p.encode() + b" "
                want |= {(i, int.from_bytes(b[j : j + n], "big") | n << 56) for n in (4, 5) for j in range(len(b) - n + 1)}
                want |= {(i, hashed(p.encode()[:n], 16 + n)) for n in T.STEMS if n < len(p.encode())} | {(i, hashed(p.encode(), T.WORD))}
    assert got == want


def hashed(prefix, kind):
    h = D_mixed(np.array([b | i << 8 for i, b in enumerate(prefix)], np.uint64)).sum(dtype=np.uint64)
    return int(h) & ((1 << 56) - 1) | kind << 56


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, "", 5, "x"), (None, "a 1d10t", 5, "x"), (4, "word " * 200_000, 5, "x")], "doc_id long, text string, score int, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.score(docs, none).collect()
    assert len(rows) == 4 and {r.predicted for r in rows} == {0}
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 7), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert T.score(docs, odd).count() == 4
    assert T.score(docs.where("false"), odd).count() == 0
    out = T.restored(docs.withColumn("restored", F.lit(1)))
    assert [r.restored for r in out.collect()][:3] == ["", "", "a idiot"] or out.count() == 4


def test_registered(spark):
    out = entry.queries()["op11_toxicity"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 200
