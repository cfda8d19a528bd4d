import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftlake.llm import common
from driftlake.llm import token_output as to

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    rows = [(i % 37, f"text number {i} " * (i % 11), i) for i in range(200)] + [(None, None, 1), (None, "", 2), (5, "long words here " * 4000, 3), (5, "same", 4), (5, "same", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    files = to.write_tokens(docs, PATH, str(tmp_path), length=64)
    out = sorted(to.read_documents(spark, files).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(PATH)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in out) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in out] == [w[:2] for w in want]
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    for f in files.collect():
        file = to.TokenFile(f.file)
        n = -(-f.n_tokens // 64)
        ids = np.concatenate([file.sequence(i) for i in range(n)])
        mask = np.concatenate([file.mask(i) for i in range(n)])
        assert len(ids) == n * 64 and mask.sum() == f.n_tokens and mask[: f.n_tokens].all()
        assert (ids[: f.n_tokens] == file.tokens(0, f.n_tokens)).all()
        view = file.sequence(0)
        assert not view.flags.owndata


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = to.write_tokens(docs, PATH, str(tmp_path / "none"))
    assert files.count() == 0 and to.read_documents(spark, files).count() == 0


def test_slices_bound_text(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10] * 5 + [None, "b" * 100, ""]})
    parts = list(common.slices(iter([batch]), limit=25))
    assert sum(p.num_rows for p in parts) == 8 and all(len(p) == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 125 for p in parts)
