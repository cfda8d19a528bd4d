import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftlake.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    models = li.fit(docs.where(~fold))
    rows = li.identify(docs.where(fold), models, host="source").collect()
    right = [r.lid_language == r.lang for r in rows if r.n_chars > 40]
    assert np.mean(right) > 0.98 and np.mean([r.lid_kept for r in rows]) > 0.98


def test_gibberish_and_missing_text_are_rejected(spark):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = li.fit(docs)
    odd = [("".join(rng.choice("qxzjkvwpbg ") for _ in range(300)), "s"), ("1234 5678 %% &&", "s"), (None, None), ("", "src0"), ("中文内容" * 50, None)]
    out = li.identify(spark.createDataFrame(odd, "text string, source string"), models, host="source").collect()
    assert not any(r.lid_kept for r in out) and len(out) == 5


def test_evidence_is_added_like_bayes(spark):
    table = np.log(np.full((li.SLOTS, 2), 1 / li.SLOTS)).astype(np.float32)
    models = li.TextModels(["de", "en"], table, np.array([-20.0, -20.0]))
    rows = spark.createDataFrame([("some words", "a.example.de", "en"), ("some words", None, None), ("some words", "b.example.de", None)], "text string, host string, declared string")
    got = {(r.host, r.declared): r.lid_posterior for r in li.identify(rows, models, host="host", declared="declared").collect()}
    # votes: the first row speaks 20:1 for en, the third is even
    de, en = 1 / 21 + 0.5, 20 / 21 + 0.5
    w = li.PARENT_WEIGHT
    level = np.array([0.5, 0.5])
    for _ in ("all hosts", "suffix", "domain"):
        level = (np.array([de, en]) + w * level) / (2 + w)
    prior = (np.array([1 / 21, 20 / 21]) + w * level) / (1 + w)
    odds = prior * np.array([li.SUFFIX_ODDS, li.DECLARED_ODDS])
    assert abs(got["a.example.de", "en"] - max(odds) / sum(odds)) < 1e-9
    assert abs(got[None, None] - 0.5) < 1e-9


def test_clashing_names_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumn("host", F.lit(1)).withColumn("declared", F.lit("x")).withColumn("p0", F.lit(2))
    kept = li.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 45
    assert li.keep_known(docs.limit(0)).count() == 0
    page = spark.createDataFrame([(1, "https://u@Www.Example.FR:80/x", '<!DOCTYPE html><html class=x lang="fr-CA"><script>var a=1</script><p>du texte</p>'), (2, None, None)], "page_id long, url string, html string")
    got = li.page_evidence(page).collect()
    assert (got[0].host, got[0].declared, got[0].text.split()) == ("Www.Example.FR", "fr-CA", ["du", "texte"]) and got[1].host is None


def test_trigrams_stay_inside_texts():
    data, offsets = li.raw_bytes(pa.array(["ab", "", "cde", "É"]))
    assert li._trigrams(data, offsets)[1].tolist() == [2]


def test_seventy_labels_are_all_fitted(spark):
    rng = random.Random(2)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(40)] for _ in range(70)]
    rows = [(f"x{k:02d}"[0] + "abcdefghij"[k // 10] + "abcdefghij"[k % 10], " ".join(rng.choices(words[k], k=60)), f"h{k}.example.org") for k in range(70) for _ in range(12)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    models = li.fit(docs)
    assert len(models.languages) == 70
    found = li.identify(docs, models, host="source").collect()
    assert np.mean([r.lang == r.lid_language for r in found]) > 0.98 and np.mean([r.lid_kept for r in found]) > 0.98


def test_declared_tags_of_any_length_and_case(spark):
    table = np.log(np.full((li.SLOTS, 3), 1 / li.SLOTS)).astype(np.float32)
    models = li.TextModels(["EN", "deu", "fil"], table, np.array([-20.0] * 3))
    rows = spark.createDataFrame([("words", "en-GB"), ("words", "DEU"), ("words", "fil_PH"), ("words", "fi"), ("words", "")], "text string, declared string")
    got = [(r.lid_language, round(r.lid_posterior, 3)) for r in li.identify(rows, models, declared="declared").collect()]
    assert [g for g, _ in got[:3]] == ["EN", "deu", "fil"] and {p for _, p in got[3:]} == {0.333}


def test_repeated_rows_long_texts_and_ties(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = li.fit(docs)
    one = docs.where("lang = 'fr'").orderBy(F.desc("n_chars")).limit(1).collect()[0]
    rows = [(one.text * 40, "s")] + [(one.text, "s")] * 3 + [("zz " * 300_000, None)]
    out = li.identify(spark.createDataFrame(rows, "text string, source string"), models, host="source").collect()
    assert len(out) == 5 and {r.lid_language for r in out[:4]} == {"fr"} and len({r.lid_posterior for r in out[1:4]}) == 1
