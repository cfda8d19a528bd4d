"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are added as log odds: the likelihood of the text under byte trigram models (with a flat model
for text of none of the languages), the language that the markup declares, the suffix of the address, and a prior of
the host. Host priors are counts of the languages that the text and markup give, summed by host, domain and suffix
with a grouped aggregation; each level is smoothed towards the level above it, so a small host leans on its domain.

The trigram models are fitted on a bounded sample: at most ``FIT_DOCS`` labelled texts for each language, those with the
smallest hashes, ``FIT_CHARS`` characters of each. Every label gets a model, and plans do not grow with their number but
for lists of the names. All texts are scored whole.

Rejected are texts for which the flat model is likelier than all languages, or the best language has a posterior under
``SURE``. Null and empty texts carry no evidence and are rejected unless markup and address decide. A null host, address
or markup is no evidence. Null labels are not fitted on. Repeated rows are scored each by itself. Empty tables give
no rows; with no labelled text nothing is fitted and every text is rejected. Other columns are kept by ``keep_known``;
names beginning with ``lid_`` are reserved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import mixed, raw_bytes, ready, saved, slices, texts

#: Bounds of the sample that the models are fitted on, for each language.
FIT_DOCS, FIT_CHARS = 400, 4000
#: Slots of a hashed trigram model, its additive smoothing, and the share of one trigram's evidence that counts.
SLOTS, SMOOTHING, TEMPER = 1 << 15, 0.5, 0.3
#: Nats a trigram may be worse than a language's own texts before the flat model wins.
SLACK = 4.0
#: Odds of declared markup and address suffix for their language, weight of a parent level, and the least posterior kept.
DECLARED_ODDS, SUFFIX_ODDS, PARENT_WEIGHT, SURE = 20.0, 8.0, 10.0, 0.4
#: Address suffixes that speak for a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}


@dataclass
class TextModels:
    """Log probabilities of hashed trigrams for each language, and the flat model's as a level below each."""

    languages: list[str]
    table: np.ndarray  # slots x languages
    floor: np.ndarray  # mean log probability of a language's own trigrams, less SLACK

    def score(self, values: pa.Array) -> np.ndarray:
        """Log likelihoods per text, the flat model first; 0 where there is no trigram."""
        data, offsets = raw_bytes(values)
        slot, owner = _trigrams(data, offsets)
        out = np.zeros((len(values), len(self.languages) + 1))
        for k in range(len(self.languages)):
            out[:, k + 1] = np.bincount(owner, weights=self.table[slot, k], minlength=len(values)) * TEMPER
        count = np.bincount(owner, minlength=len(values))
        # a text of none of the languages is as far below the best one's own level as the slack allows
        if len(self.languages):
            best = out[:, 1:].argmax(axis=1)
            out[:, 0] = count * self.floor[best] * TEMPER
        return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each letter trigram, its text). Digits, punctuation and white space all read as one blank."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    # lower case of ASCII letters; of two-byte letters, case differs in one bit of the last byte
    low = np.where(letter, data | np.where(data < 128, 32, 0), 32).astype(np.uint64)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    low[second & (data >= 0x80) & (data <= 0x9E)] |= np.uint64(0x20)
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (owner[:-2] == owner[2:]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
    return (mixed(code[inside]) >> np.uint64(49)).astype(np.int64), owner[:-2][inside]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> TextModels:
    """Trigram models of all languages in ``label``, from a bounded sample of each."""
    ready(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("l"), F.substring(text, 1, FIT_CHARS).alias("t"), F.pmod(F.xxhash64(text), F.lit(1 << 40)).alias("h")
    )
    # a text is drawn if its hash is low enough to leave about twice the bound, then the lowest stay
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    # one list of rates in the plan, so that no text is moved to meet its rate
    names, rates = (F.array(*[F.lit(x) for x in y]) for y in (languages, [min(1.0, 2 * FIT_DOCS / counts[x]) for x in languages]))
    rate = F.try_element_at(F.map_from_arrays(names, rates), F.col("l")) if languages else F.lit(0.0)
    drawn = rows.where(F.col("h") < rate * (1 << 40))
    lowest = Window.partitionBy("l").orderBy("h", "t")
    sample = drawn.distinct().withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= FIT_DOCS).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            names = part.column("l").dictionary_encode()
            slot, owner = _trigrams(*raw_bytes(texts(part, "t")))
            pairs, n = np.unique(names.indices.to_numpy()[owner].astype(np.int64) * SLOTS + slot, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(pairs // SLOTS)), pa.array(pairs % SLOTS), pa.array(n)], ["l", "slot", "n"])

    grams = sample.mapInArrow(count, "l string, slot long, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((SLOTS, len(languages)))
    if grams.num_rows:
        column = pc.index_in(grams.column("l"), value_set=pa.array(languages)).to_numpy()
        seen[grams.column("slot").to_numpy(), column] = grams.column("n").to_numpy()
    total = seen.sum(axis=0)
    table = np.log((seen + SMOOTHING) / (total + SMOOTHING * SLOTS))
    floor = (table * seen).sum(axis=0) / np.maximum(total, 1) - SLACK
    return TextModels(languages, table.astype(np.float32), floor)


def with_text_scores(rows: DataFrame, models: TextModels, text: str = "text") -> DataFrame:
    """``rows`` with lid_scores: log likelihoods, the flat model first."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=text):
            score = models.score(texts(part, text))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), score.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "lid_scores"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lid_scores", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def _main_part(name: Column) -> Column:
    """The language itself of a tag such as fr-CA, in lower case."""
    return F.lower(F.regexp_extract(name, "^[A-Za-z]+", 0))


def _votes(column: str, known: Column, odds: float) -> Column:
    """Log odds of one declared language, as a list over the languages; 0 for all others."""
    said = _main_part(F.coalesce(F.col(column), F.lit("")))
    return F.transform(known, lambda name: F.when((said != "") & (said == name), F.lit(float(np.log(odds)))).otherwise(F.lit(0.0)))


def _plus(*lists: Column) -> Column:
    whole, *rest = lists
    for more in rest:
        whole = F.zip_with(whole, more, lambda x, y: x + y)
    return whole


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def _smoothed(mine: str, above: Column) -> Column:
    """Shares of the counts in a list, leaning on the shares above."""
    whole = _total(F.col(mine)) + PARENT_WEIGHT
    return F.zip_with(F.col(mine), above, lambda x, y: (x + PARENT_WEIGHT * y) / whole)


def host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """lid_host and lid_prior (log probability of each language) from counts of lid_votes by host, domain and suffix."""
    n = len(languages)

    def added(column: str) -> Column:
        return F.array(*[F.sum(F.col(column)[i]) for i in range(n)]).alias("v")

    hosts = saved(rows.where(F.col("lid_host").isNotNull()).groupBy("lid_host").agg(added("lid_votes")), "hosts")
    parts = F.split("lid_host", r"\.")
    hosts = hosts.withColumn("lid_suffix", F.element_at(parts, -1)).withColumn("lid_domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), "lid_suffix")).otherwise(F.col("lid_host")))
    # each level is a table of its own and far smaller than the one below
    even = [1.0 / n] * n
    counted = hosts.agg(added("v")).select(_smoothed("v", F.array(*[F.lit(x) for x in even])).alias("p")).first().p
    top = F.array(*[F.lit(float(x)) for x in (counted if counted and None not in counted else even)])
    suffixes = hosts.groupBy("lid_suffix").agg(added("v")).select("lid_suffix", _smoothed("v", top).alias("above"))
    domains = hosts.groupBy("lid_domain", "lid_suffix").agg(added("v")).join(suffixes, "lid_suffix").select("lid_domain", _smoothed("v", F.col("above")).alias("above"))
    level = hosts.join(domains, "lid_domain").select("lid_host", _smoothed("v", F.col("above")).alias("p"))
    return saved(level.select("lid_host", F.transform("p", lambda x: F.log(x)).alias("lid_prior")), "priors")


def identify(rows: DataFrame, models: TextModels, text: str = "text", host: str | None = None, declared: str | None = None) -> DataFrame:
    """``rows`` with lid_language, lid_posterior and lid_kept. ``host`` may be a host name or any source name."""
    languages, n = models.languages, len(models.languages)
    scored = with_text_scores(rows, models, text)
    if n == 0:
        return scored.select(*rows.columns, F.lit(None).cast("string").alias("lid_language"), F.lit(0.0).alias("lid_posterior"), F.lit(False).alias("lid_kept"))
    host_of = F.lower(F.col(host)) if host else F.lit(None).cast("string")
    scored = scored.withColumn("lid_host", host_of)
    suffix = F.element_at(F.split("lid_host", r"\."), -1)
    spoken = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    by_suffix = F.when(F.instr("lid_host", ".") > 0, F.try_element_at(spoken, suffix))
    known = F.array(*[F.lit(x) for x in languages])
    tags = F.array(*[F.lit(m.group().lower() if (m := re.match("[A-Za-z]+", x)) else x) for x in languages])
    zeros = F.array(*[F.lit(0.0)] * n)
    scored = scored.withColumn("lid_suffix_language", by_suffix)
    own = _votes(declared, tags, DECLARED_ODDS) if declared else zeros
    scored = scored.withColumn("lid_evidence", _plus(F.slice("lid_scores", 2, n), own)).withColumn("lid_address", _votes("lid_suffix_language", tags, SUFFIX_ODDS))
    # the flat model stands against the best language by the text alone; without any text, markup or address must speak
    heard = F.array_max(F.slice("lid_scores", 2, n)) >= F.col("lid_scores")[0]
    silent = F.array_max("lid_scores") == F.array_min("lid_scores")
    voices = _shares(scored.where(heard & ~silent & F.col("lid_host").isNotNull()).select("lid_host", "lid_evidence"), F.col("lid_evidence"), "lid_votes")
    priors = host_priors(voices.select("lid_host", "lid_votes"), languages)
    # rows without a host get keys that match nothing but spread over the tasks
    spread = F.coalesce("lid_host", F.concat(F.lit("\0"), F.pmod(F.xxhash64(text), F.lit(4096)).cast("string")))
    joined = scored.withColumn("lid_host", spread).join(priors, "lid_host", "left")
    prior = F.coalesce("lid_prior", F.array(*[F.lit(float(-np.log(n)))] * n))
    joined = _shares(joined, _plus(F.col("lid_evidence"), F.col("lid_address"), prior), "lid_posteriors")
    best = F.array_max("lid_posteriors")
    at = F.array_position("lid_posteriors", best).cast("int")
    spoke = (F.array_max("lid_address") > 0) | (F.array_max("lid_evidence") > 0)
    kept = (best >= SURE) & F.when(silent, spoke).otherwise(heard)
    return joined.select(*rows.columns, F.element_at(known, at).alias("lid_language"), best.alias("lid_posterior"), kept.alias("lid_kept"))


def _shares(rows: DataFrame, logs: Column, name: str) -> DataFrame:
    """``rows`` with probabilities from a list of log odds; each list is made once."""
    rows = rows.withColumn("lid_logs", logs)
    rows = rows.withColumn("lid_top", F.array_max("lid_logs"))
    rows = rows.withColumn("lid_powers", F.transform("lid_logs", lambda x: F.exp(x - F.col("lid_top"))))
    rows = rows.withColumn("lid_sum", _total(F.col("lid_powers")))
    return rows.withColumn(name, F.transform("lid_powers", lambda x: x / F.col("lid_sum"))).drop("lid_logs", "lid_top", "lid_powers", "lid_sum")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a known language, with all their columns; the source stands for the host."""
    found = identify(docs, fit(docs), host="source")
    return found.where("lid_kept").select(*docs.columns)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text without markup, host of the address, and the language that the page declares."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    return pages.select(
        "page_id", body.alias("text"),
        F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1), F.lit("")).alias("declared"),
    )


def identify_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document and every page: doc_id or page_id, language, posterior, kept."""
    models = fit(docs)
    rows = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"))
    web = page_evidence(pages).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), "text", "host", "declared")
    found = identify(rows.unionByName(web), models, host="host", declared="declared")
    return found.select("doc_id", "page_id", "host", F.col("lid_language").alias("language"), F.col("lid_posterior").alias("posterior"), F.col("lid_kept").alias("kept"))
