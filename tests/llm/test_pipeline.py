import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from driftlake.llm import decontaminate, source_mixing
from tests.llm.test_bagminhash import classes
from tests.llm.test_decontaminate import naive

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, "qzxv jkqw " * 40, None, "src0", 1), (900_002, None, None, None, None), (900_003, None, "en", None, 0)], docs.schema)
    docs = docs.union(odd)
    languages = cp.known_language(spark, docs, SF)
    assert languages.columns == docs.columns
    kept = sorted(languages.collect())
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept}
    assert gone >= {900_001, 900_002, 900_003} and len(gone) <= 3 + 0.01 * docs.count()
    once = cp.near_duplicates(spark, languages, SF)
    own = classes([r.text for r in kept])
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted({kept[c].doc_id for c in own})
    clean = cp.decontaminated(spark, once, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect() if not any(naive(r.text, i) for i in items)}
    mixed = cp.mixed_sources(spark, clean, SF)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in source_mixing.mix_report(clean).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    out = cp.token_files(spark, mixed, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == sorted((r.doc_id, crc(r.text)) for r in mixed.collect())


def test_registered(spark):
    assert "pipeline" in entry.queries() and [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix", "token_output"]
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)} >= {f"op{i}" for i in range(1, 11)}


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


assert decontaminate.OVERLAP == 13
