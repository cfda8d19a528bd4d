"""Toxicity of texts whose disguised words are restored first (operator 11).

Texts are restored by :mod:`driftlake.llm.deobfuscate` and scored on the restored words: every word gives the 4 and 5 byte
windows of itself between two blanks, its beginnings of 5 to 9 bytes that it goes on after (stems of longer words), and
itself; these are called windows here. A text's score is the logistic function of the weights of the windows it holds.
Windows are chosen by their association with the label (likelihood ratio), weights are fitted together with an L1 penalty,
so what only comes along with a toxic word (the rest of a copied text) gets none.

The classifier learns from a bounded sample of the labelled rows that are not held out: at most ``SAMPLE`` rows of each
label, by hash of their id, equal texts once; it has at most ``WINDOWS`` windows. The language model counts all texts, and
every text is scored whole. Labels, languages, sources and ids are no inputs of a score.

Edge cases: a null text is empty and gets the score of no evidence; a null id counts as the text '' for the hold-out rule;
labels that are null or not 0 or 1 are left out, an id with both labels counts as toxic; without labels of both kinds the
score is the share of toxic rows (0 if there are none). Repeated rows and ids are each scored. Other columns of either table take no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftlake.llm.common import mixed, saved, slices, texts
from driftlake.llm.deobfuscate import Restorer, character_model, restore_text, spread_out

SAMPLE, WINDOWS = 10_000, 4096
#: Least likelihood ratio (2 log L) and least number of texts of a window; penalty, steps, and the move that ends the fit.
ASSOCIATED, SEEN, PENALTY, STEPS, SETTLED = 12.0, 3, 5e-5, 600, 1e-4
#: Squared penalty of the last fit, of the windows that the first one keeps.
RIDGE = 2e-5
FOLDS = 5
#: Text bytes worked on at a time; every word of it stands for some twenty windows.
SLICE = 1 << 21
STEMS, WORD = range(5, 10), 15

_SEPARATES = np.zeros(256, bool)
_SEPARATES[:128] = True
_SEPARATES[97:123] = _SEPARATES[48:58] = False
_FILTER_BITS = 20


def remainder(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _windows(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each window, word it lies in) of distinct words."""
    out, starts = spread_out(distinct, 1, 1, 32)
    out[_SEPARATES[out]] = 32
    blank = out == 32
    wide = out.astype(np.uint64)
    codes, places = [], []
    for n in (4, 5):
        m = len(out) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n << 56, np.uint64)
        fine = np.ones(m, bool)
        for i in range(n):
            code |= wide[i : i + m] << np.uint64(8 * (n - 1 - i))
            if 0 < i < n - 1:
                fine &= ~blank[i : i + m]
        at = np.flatnonzero(fine)
        codes.append(code[at].astype(np.int64))
        places.append(np.searchsorted(starts, at, "right") - 1)
    for code, place in _stems(wide, blank, starts):
        codes.append(code)
        places.append(place)
    return np.concatenate(codes), np.concatenate(places)


def _stems(wide: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the beginnings of words that go on, and of whole words; a token may hold several words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    place = np.searchsorted(starts, begin, "right") - 1
    length = end - begin
    low = np.uint64((1 << 56) - 1)
    letters = np.flatnonzero(~blank)
    position = (letters - np.repeat(begin, length)).astype(np.uint64)
    parts = mixed(wide[letters] | position << np.uint64(8))
    if len(begin):
        cut = np.cumsum(length) - length
        yield ((np.add.reduceat(parts, cut) & low) | np.uint64(WORD << 56)).astype(np.int64), place
    for n in STEMS:
        on = np.flatnonzero(length > n)
        h = np.zeros(len(on), np.uint64)
        for i in range(n):
            h += parts[cut[on] + i] if len(on) else h
        yield ((h & low) | np.uint64((16 + n) << 56)).astype(np.int64), place[on]


def _expanded(token: np.ndarray, text: np.ndarray, word: np.ndarray, value: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) for every value of every token of a text, each pair once; values are given per word."""
    order = np.argsort(word, kind="stable")
    value = value[order]
    count = np.bincount(word, minlength=n_words)
    offset = np.concatenate([[0], np.cumsum(count)])
    n = count[token]
    some = n > 0
    token, text, n = token[some], text[some], n[some]
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each token of a text once
    pair = np.unique(text * n_words + token)
    text, token = pair // n_words, pair % n_words
    n = count[token]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = value[np.repeat(offset[token], n) + inside]
    texts_ = np.repeat(text, n)
    ids, back = np.unique(found, return_inverse=True)
    both = np.unique(texts_ * len(ids) + back)
    return both // len(ids), ids[both % len(ids)]


class _Lookup:
    """Finds the few windows of a classifier among many: a bit table first, then an exact search."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, word) of those that are in the classifier."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.bits[self._slot(codes)])
        at = np.minimum(np.searchsorted(self.codes, codes[near]), len(self.codes) - 1)
        same = self.codes[at] == codes[near]
        return at[same], word[near[same]]


@dataclass
class Classifier:
    codes: np.ndarray  # windows, rising
    weights: np.ndarray
    bias: float
    language: np.ndarray  # log-probabilities of the character model


def _present(restorer: Restorer, lookup: _Lookup, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, window of the classifier) pairs of a batch, each once."""
    distinct, token, text = restorer.batch(values)
    number, word = lookup.find(*_windows(distinct))
    return _expanded(token, text, word, number, len(distinct))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, column: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the sample, and the number of labelled rows of each label it stands for."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (remainder(doc_id) != 0))
    known = known.groupBy(F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(SAMPLE) for y in (0, 1)]
    # at most 2 x SAMPLE ids, so they can go to every task and no text is shuffled for the join
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col(doc_id).alias("key"), F.coalesce(column, F.lit("")).alias("text")).join(chosen, "key")
    return rows.groupBy("toxic", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).agg(F.min("text").alias("text")).select("text", "toxic"), totals


def _associated(sample: DataFrame, language: np.ndarray) -> np.ndarray:
    """The windows most associated with either label, rising."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        for batch in slices(batches, "text", SLICE):
            toxic = batch.column("toxic").to_numpy()
            distinct, token, text = restorer.batch(batch.column("text"))
            code, word = _windows(distinct)
            text, code = _expanded(token, text, word, code, len(distinct))
            ids, back = np.unique(code, return_inverse=True)
            bad = np.bincount(back, weights=toxic[text], minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(back, minlength=len(ids))), pa.array(bad)], ["code", "n", "bad"])

    sizes = {r.toxic: float(r.n) for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = sample.mapInArrow(count, "code long, n long, bad long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole, toxic = sizes[0] + sizes[1], sizes[1]
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    rate = toxic / whole
    ratio = 2 * (term(bad, n * rate) + term(n - bad, n * (1 - rate)) + term(toxic - bad, (whole - n) * rate) + term(whole - toxic - n + bad, (whole - n) * (1 - rate)))
    best = counted.where(n >= SEEN).withColumn("g", ratio).where(F.col("g") >= ASSOCIATED).orderBy(F.desc("g"), "code").limit(WINDOWS)
    return np.sort(best.select("code").toArrow().column("code").to_numpy())


def _fitted(text: np.ndarray, window: np.ndarray, toxic: np.ndarray, n_windows: int, lasso: float, ridge: float) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on presence, by accelerated proximal gradient steps."""
    n = len(toxic)
    weights, bias = np.zeros(n_windows), float(np.log(toxic.mean() / (1 - toxic.mean())))
    ahead, ahead_bias, t = weights, bias, 1.0
    step = 4.0 / max(float(np.bincount(text, minlength=n).mean()) + 1, 2.0)
    for _ in range(STEPS):
        z = np.bincount(text, weights=ahead[window], minlength=n) + ahead_bias
        rest = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic
        now = ahead - step * (np.bincount(window, weights=rest[text], minlength=n_windows) / n + ridge * ahead)
        now = np.sign(now) * np.maximum(np.abs(now) - step * lasso, 0)
        now_bias = ahead_bias - step * float(rest.mean())
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = now + (t - 1) / again * (now - weights), now_bias + (t - 1) / again * (now_bias - bias)
        moved = max(float(np.abs(now - weights).max(initial=0)), abs(now_bias - bias))
        weights, bias, t = now, now_bias, again
        if moved < SETTLED:
            break
    return weights, bias


def _chosen(text: np.ndarray, window: np.ndarray, toxic: np.ndarray, n_windows: int) -> tuple[np.ndarray, float]:
    """Windows chosen by the lasso, their weights fitted again without its shrinking."""
    first, bias = _fitted(text, window, toxic, n_windows, PENALTY, 0.0)
    kept = np.flatnonzero(first)
    if not len(kept):
        return first, bias
    place = np.full(n_windows, -1)
    place[kept] = np.arange(len(kept))
    inside = place[window] >= 0
    again, bias = _fitted(text[inside], place[window[inside]], toxic, len(kept), 0.0, RIDGE)
    first[kept] = again
    return first, bias


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", column: str = "text", label: str = "toxic") -> Classifier:
    language = character_model(docs, column)
    sample, totals = labelled_sample(docs, labels, doc_id, column, label)
    sample = saved(sample, "toxic-sample")
    used = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = np.zeros(0, np.int64)
    if len(used) < 2:
        share = totals.get(1, 0) / max(sum(totals.values()), 1)
        return Classifier(nothing, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), language)
    codes = _associated(sample, language)
    lookup = _Lookup(codes)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        for batch in slices(batches, "text", SLICE):
            text, number = _present(restorer, lookup, batch.column("text"))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(cuts), pa.array(number.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([held, batch.column("toxic")], ["held", "toxic"])

    rows = sample.mapInArrow(presence, "held array<smallint>, toxic int").toArrow()
    held = rows.column("held").combine_chunks()
    text = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
    toxic = rows.column("toxic").to_numpy().astype(np.float64)
    weights, bias = _chosen(text, held.values.to_numpy().astype(np.int64), toxic, len(codes))
    # the sample holds another share of toxic rows than the table
    bias += np.log(totals[1] / totals[0]) - np.log(used[1] / used[0])
    kept = weights != 0
    return Classifier(codes[kept], weights[kept], bias, language)


def score_texts(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    lookup = _Lookup(classifier.codes)
    weights, bias, language = classifier.weights, classifier.bias, classifier.language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        for batch in slices(batches, "tox_text", SLICE):
            text, number = _present(restorer, lookup, texts(batch, "tox_text"))
            z = np.bincount(text, weights=weights[number], minlength=batch.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tox_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["tox_id", "held_out", "score", "predicted"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("tox_id"), (remainder(doc_id) == 0).alias("held_out"), F.col(column).alias("tox_text"))
    return rows.mapInArrow(score, f"tox_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("tox_id", doc_id)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", column: str = "text", label: str = "toxic") -> DataFrame:
    return score_texts(docs, learn(docs, labels, doc_id, column, label), doc_id, column)


def restored(docs: DataFrame, language: np.ndarray | None = None, column: str = "text", name: str = "restored") -> DataFrame:
    """All rows and columns, with the restored words of each text as a further column ``name``."""
    language = character_model(docs, column) if language is None else language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Restorer(language).model
        for batch in slices(batches, column):
            out = [restore_text(t, model) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    plain = docs.drop(name)
    return plain.mapInArrow(work, StructType([*plain.schema.fields, StructField(name, StringType())]))
