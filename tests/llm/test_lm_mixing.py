import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftlake.llm import lm_mixing as lm

SF = "/root/testdata/sf0.01"


def token_list(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def check_base(rows, docs):
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter(t for i, text in docs if not held[i] for t in token_list(text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, text in docs:
        toks = token_list(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in toks)
        want.append((i, held[i], len(toks), sum(counts[t] > 0 for t in toks), total, base))
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted((tuple(r)[:6] for r in rows), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_against_brute_force_and_beats_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.score(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    whole = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60_000)
    for r in lm.score(docs).collect():
        assert r.score == pytest.approx(whole[r.doc_id], rel=1e-6)


def test_next_token_probabilities_sum_to_one():
    train = pa.array(["the cat sat on the mat", "a dog and a cat", "the end of the dog", "then they left"])
    t = lm.tokens(train)
    counts = np.bincount(t.word, minlength=len(t.distinct))
    seen, ones = lm.count_slots(t, np.ones(len(t.word), bool))
    mass = np.bincount(t.classes, weights=counts + 0.5, minlength=lm._NODES)
    model = lm.Model(lm._stretch(ones, seen), np.where(mass > 0, mass, 1), int(counts.sum()), len(counts), 0.1)
    # every training word, the end, and a word that is none of them, after the same beginning
    unknown = lm.tokens(pa.array(["zebra"]))
    prefix = [t.word[0], t.word[1], t.word[0]] * 60
    n = len(t.distinct)
    ends = [*range(n), n]
    distinct = pa.concat_arrays([t.distinct, unknown.distinct.slice(0, 1)])

    def build(texts):
        flat = np.array([w for x in texts for w in x])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        return lm.Tokens(distinct, flat, owner, np.append(t.hashed, unknown.hashed[0]), np.append(t.classes, unknown.classes[0]), len(texts))

    count = np.append(counts, 0)
    before = model.score(build([prefix]), count)[0]
    after = model.score(build([[*prefix, w] for w in ends]), count)
    # classes that hold no training word keep a little probability
    assert 0.9 < (10 ** (after - before)).sum() <= 1 + 1e-9


def test_edges(spark):
    rows = [(None, None, 1), (None, "", 2), (1, "A b\x0bC d", 3), (1, "A b\x0bC d", 3), (2, "x " * 3000, 4), (6, "never seen", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    check_base(lm.score(docs).collect(), [r[:2] for r in rows])
    assert lm.score(docs.limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score <= 0 for r in lm.score(only_held).collect())


def test_contexts_share_no_counts_and_reach_the_word(spark):
    # far more contexts than a fixed table holds; the two words before decide the next one, the class alone does not
    rng = np.random.default_rng(1)
    texts = [" ".join(f"a{a} b{b} x{(a * 7 + b * 13) % 500}" for a, b in rng.integers(0, 1000, (300, 2))) for _ in range(300)]
    first = lm.tokens(pa.array(texts))
    context, word = lm.pairs(first)
    n = len(first.word)
    way = lm.ways(context, word, np.ones(len(word)))
    want, after = Counter(), Counter()
    words_of = first.distinct.to_pylist()
    flat = [(words_of[first.word[i - 2]], words_of[first.word[i - 1]], words_of[first.word[i]]) for i in range(2, n)]
    for a, b, c in flat:
        want[a, b, c] += 1
        after[a, b] += 1
    assert len(after) > 1 << 16
    for i in range(2, n, 997):
        if first.text[i] == first.text[i - 2]:
            a, b, c = flat[i - 2]
            if b"" not in (a, b):
                assert (way[0, n + i], way[lm._WORD, n + i]) == (after[a, b], want[a, b, c])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [r for r in lm.score(docs).collect() if r.held_out]
    # a third of the words follow from the two before
    seen = sum(r.score for r in held)
    shuffled = [" ".join(rng.permutation(t.split())) for t in texts]
    mixed = spark.createDataFrame([(i, t if zlib.crc32(str(i).encode()) % 5 != 1 else shuffled[i]) for i, t in enumerate(texts)], "doc_id long, text string")
    assert seen > 0.97 * sum(r.score for r in lm.score(mixed).collect() if r.held_out)


def test_words_in_context_sum_to_one():
    t = lm.tokens(pa.array(["the cat then the cat that the cat", "the dog the cat thus then"]))
    n = len(t.word)
    context, word = lm.pairs(t)
    # every word of the class of "the" after the same words
    same = np.flatnonzero(t.classes == t.classes[t.word[0]])
    plain = np.arange(1, len(same) + 1) / sum(range(1, len(same) + 1))
    total = 0.0
    for k, w in enumerate(same):
        one, two = context[4], context[n + 4]
        key = np.uint64(t.classes[w]) << np.uint64(56) | t.hashed[w] >> np.uint64(8)
        way = lm.ways(np.append(context, [one, two]), np.append(word, [key, key]), np.append(np.ones(2 * n), [0, 0]))
        total += np.exp(lm._word(plain[k : k + 1], way[:, -2:-1], way[:, -1:], np.zeros(1, int), np.zeros(1, int), np.array([1])))[0]
    assert total == pytest.approx(1)


def test_unknown_words_pay_for_their_letters(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    prose = {i for i, x in rows if zlib.crc32(str(i).encode()) % 5 == 1 and len(x) > 500}
    rng = np.random.default_rng(2)
    junk = next(i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows.append((junk, " ".join("".join(rng.choice(list("qxzjkvwy0123"), 8)) for _ in range(200))))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[junk].n_known <= 1
    assert got[junk].bits_per_byte > max(got[i].bits_per_byte for i in prose)
    assert got[junk].bits_per_byte > 2


def test_spelling_is_a_probability():
    seen, ones = lm.spelling_slots(pa.array([b"ab", b"abc", b"\xff"], pa.binary()))
    letter = [bytes([b]) for b in range(256) if b != 32]
    of = lambda words: (2.0 ** -lm.spelling_bits(pa.array(words, pa.binary()), seen, ones)).sum()
    assert 0 < of(letter) + of([x + y for x in letter for y in letter]) < 1


def test_letters_in_the_same_context_are_counted_once(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice([97, 98, 99, 255], int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(3000)]
    spelled, taken = lm._spelled, []
    monkeypatch.setattr(lm, "_spelled", lambda letter, contexts: taken.append(len(letter)) or spelled(letter, contexts))
    seen, ones = lm.spelling_slots(pa.array(words, pa.binary()))
    bits = lm.spelling_bits(pa.array(words, pa.binary()), seen, ones)
    letter, _, contexts = lm._letters(pa.array(words, pa.binary()))
    want = np.zeros((2, len(seen)), np.int64)
    for bit, places in spelled(letter, contexts):
        for place in places:
            np.add.at(want[0], place, 1)
            np.add.at(want[1], place[bit], 1)
    assert (seen == want[0]).all() and (ones == want[1]).all() and max(taken) <= 5**4 < len(letter)
    alone = [lm.spelling_bits(pa.array([w], pa.binary()), seen, ones)[0] for w in words[:50]]
    assert np.allclose(bits[:50], alone, rtol=1e-12)


def test_counts_on_the_way_are_sent_packed():
    rng = np.random.default_rng(6)
    context, word = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64)), rng.integers(0, 2**63, 5000).astype(np.uint64)
    context[100:400] = context[100]
    way = lm.ways(context, word, np.ones(5000, np.int64))
    way[:, 7] = 3.0 * 2**33
    packed = lm._pack(way)
    assert (lm._unpack(packed, len(way)).astype(np.float32) == way).all() and len(packed) < way.nbytes / 20
    assert (lm._unpack(lm._pack(context)) == context).all() and (lm._unpack(lm._pack(word)) == word).all()
    assert len(lm._unpack(lm._pack(word[:0]))) == 0 and lm._unpack(lm._pack(way[:, :0]), len(way)).shape == (len(way), 0)


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    plan = lm.score(docs)._jdf.queryExecution().executedPlan().toString()
    # texts stay where they were written: only words and counts are sent to the blocks
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(block" in line]
    assert "CoGroupsInArrow" in plan and len(shuffled) < 2 * plan.count("CoGroupsInArrow")


@pytest.mark.parametrize("name", ["one", "two"])
def test_blocks_are_told_what_others_add(name):
    rng = np.random.default_rng(7)
    depths, cells = lm._DEPTHS[name], []
    for _ in range(3):
        number = np.where(rng.random(400) < 0.8, rng.permutation(np.repeat(np.arange(1, 21), 20) << 8 | np.tile(np.arange(1, 241, 12), 20)), 0)
        word, lengths = rng.integers(0, 400, 30_000) // (1 + rng.integers(0, 40, 30_000)), np.full(300, 100)
        pairs = lm._pairs_of(word, lengths, number)[name == "two"]
        n = np.bincount(pairs.place, weights=rng.random(len(pairs.place)) < 0.7, minlength=len(pairs.columns[0])).astype(np.int64)
        cells.append((pairs.columns, n))
    columns, n = [np.concatenate(x) for x in zip(*(c for c, _ in cells), strict=True)], np.concatenate([n for _, n in cells])
    word = columns[-1].astype(np.uint64)
    way, place = lm._ways(lm._context(columns), word << np.uint64(56) | word >> np.uint64(8), n, depths)
    # plain counts of all blocks
    total, behind = Counter(), Counter()
    for *before, last, k in zip(*columns, n, strict=True):
        total[(*before, last)] += int(k)
    for (*before, last), k in total.items():
        behind[(*before, last & 255)] += k
    ends = np.cumsum([len(n) for _, n in cells])
    said = lm._others(lambda k, at: way[k, place[at]].astype(np.int64), n, lm._levels(columns, depths, np.append(0, ends[:-1])))
    for own, a, b in zip(cells, [0, *ends[:-1]], ends, strict=True):
        values = [v[np.searchsorted(at, a) : np.searchsorted(at, b)] for at, v in said]
        got = lm._with_others(values, own[1], lm._levels(own[0], depths))[:, :-1]
        assert (got == way[:, place[a:b]]).all()
        rows = list(zip(*own[0], strict=True))
        assert got[-2].tolist() == [total[r] for r in rows]
        assert got[-3].tolist() == [behind[(*r[:-1], r[-1] & 255)] for r in rows]
