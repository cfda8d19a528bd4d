import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftlake.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na b  c\t d", "x<|endoftext|> y <|endoftext|>z", "don't 's 've  it's!!", "naïve 日本語 текст 123 4567",
    "tab\t tab", "!!! ...  ???", "a  b", "\x0bq w\x0b e", "\x1c a \x1f", "emoji 😀 👩‍👩‍👧 end", "é combining", "a\x85 b \x85c",
]


def expect(texts, path=PATH):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def got(texts, path=PATH):
    ids, ends = tc.encoded(tc.Encoder(path), pa.array(texts))
    return [x.tolist() for x in np.split(ids, ends)[:-1]]


def test_pieces_equal_whole_texts():
    rng = random.Random(1)
    alphabet = ["a", "th", " ", " ", "\n", "é", "!", "'s", "1", "日", "\t", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    enc = tc.Encoder(PATH)
    for _ in range(2):  # the second time from what the encoder remembers
        ids, ends = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == expect(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_huge_texts_are_spliced(name):
    path = public_tokenizers.path(name)
    enc = tc.Encoder(path)
    rng = random.Random(2)
    for text in ("".join(rng.choice(["word", " thing", " of", ".\n", " é日", "  ", " x1"]) for _ in range(3000)), "ab" * 3000, "a b" * 2000, "no " + "spaces" * 900 + " end of it " * 50):
        whole = enc.offsets(text)[0].tolist()
        assert tc.resynchronised(enc, text, 500, 20).tolist() == whole
        assert enc.ids([text])[0] == whole


def test_huge_and_small_in_one_batch(monkeypatch):
    monkeypatch.setattr(tc, "HUGE", 1000)
    texts = ["a b c", "word and thing " * 300, "", "x  y", " lead " * 900, "last"]
    assert got(texts) == expect(texts)


def test_counts(spark):
    rows = [(1, "hello world", "x"), (None, None, "y"), (3, "", None), (3, "a " * 3000, "z"), (3, "a " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(tc.count_tokens(docs, PATH).collect(), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(expect([t or ""])[0]), n > 1024) for i, t, _ in rows], key=lambda x: str((x[0],)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
