import random

from driftlake.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(500)]


def naive(text, item):
    """All diagonals of both texts, without seeds."""
    a, b = ([w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in t.lower().split()) if w] for t in (text or "", item or ""))
    m = min(dc.OVERLAP, len(b))
    for shift in range(-len(b) + 1, len(a)):
        equal = [a[i] == b[i - shift] for i in range(max(0, shift), min(len(a), shift + len(b)))]
        if any(sum(equal[i : i + m]) >= dc.SIMILAR * m for i in range(len(equal) - m + 1)):
            return True
    return False


def sample():
    rng = random.Random(5)
    items = [" ".join(rng.choices(WORDS, k=rng.choice([3, 7, 10, 12, 20, 40]))) for _ in range(30)]
    docs = []
    for i in range(80):
        body = rng.choices(WORDS, k=rng.randrange(0, 60))
        if i % 2:
            w = rng.choice(items).split()
            for k in range(4, len(w), 9):
                if i % 4 == 1:
                    w[k] = "changed"
            cut = rng.randrange(len(w) // 2 + 1) if i % 3 == 0 else 0
            body[10:10] = [x.upper() + "," for x in w[cut:]]
        docs.append(" ".join(body))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = sample()
    rows = [(i, t, "x") for i, t in enumerate(docs)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_overlaps(d, b).collect()}
    want = {(i, j) for i, t in enumerate(docs) for j, m in enumerate(items) if naive(t, m)}
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in dc.drop_contaminated(d, b, least_equal=1).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in got}
    long = {r.doc_id for r in dc.find_overlaps(d, b).where("n_equal >= 8").collect()}
    assert {r.doc_id for r in dc.drop_contaminated(d, b).collect()} == set(range(len(docs))) - long and long < {i for i, _ in got}


def test_a_full_bit_table_gives_the_same(spark, monkeypatch):
    docs, items = sample()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, dc.find_overlaps(d, b).collect()))
    monkeypatch.setattr(dc, "FILTER_BITS", 6)
    monkeypatch.setattr(dc, "LEAST_BITS", 5)
    assert sorted(map(tuple, dc.find_overlaps(d, b).collect())) == whole


def test_short_items_are_reported_but_drop_nothing(spark):
    d = spark.createDataFrame([(1, "we saw Paris in spring", 5), (2, "Paris", 5), (3, "x " * 50_000 + "a b c d e f g h i j", 5)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(7, "Paris", "q"), (8, "a b c d e f g h i j", "q")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id, r.doc_word) for r in dc.find_overlaps(d, b).collect()} == {(1, 7, 2), (2, 7, 0), (3, 8, 50_000)}
    assert [(r.doc_id, r.item_id) for r in dc.drop_contaminated(d, b).orderBy("doc_id").collect()] == [(1, 5), (2, 5)]


def test_edges(spark):
    d = spark.createDataFrame([(None, None), (1, ""), (2, "..."), (None, "one two three"), (None, "one two three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, None), (2, ""), (None, "one two THREE!"), (4, "one two")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_words, r.n_equal) for r in dc.find_overlaps(d, b).collect()), key=str)
    assert got == sorted([(None, None, 3, 3), (None, 4, 2, 2)] * 2, key=str)
    assert dc.find_overlaps(d.limit(0), b).count() == 0 and dc.find_overlaps(d, b.limit(0)).count() == 0
