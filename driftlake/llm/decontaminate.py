"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of punctuation at both ends. A fixed mask looks at some positions of a stretch of
words and ignores the others, so a hash of the seen words survives substitutions in the ignored places; four masks
cover what one would miss. Hashes of all test stretches are joined with the hashes of all training stretches; around a
hit, test item and document are laid on each other word by word, and they overlap if in some ``OVERLAP`` words in a row
(or the whole of a shorter item) at least ``SIMILAR`` of them are equal. The masks find every such overlap.

Test seeds are a table of hashes. A document of which some seed passes a bit table of the test hashes (at most ``FILTER_BITS``
bits, so it is bounded and may only let more through) is written down with those seeds; both are joined by hash, and the
distinct (text, item, diagonal) of the hits are verified beside the text, once for equal texts. Nothing of the benchmark
but the bit table and the lengths of short items passes through the driver, and texts without hits are not moved.

``find_overlaps`` reports overlaps with items of any length. ``drop_contaminated`` drops a document only for an overlap of at
least ``LEAST_EQUAL`` equal words: a word or a short phrase is no passage of a test.

Items of fewer words than the longest mask are also looked up whole, under all masks that ignore
as many words as may differ. Empty items and documents
match nothing, a null text is empty. Null ids are passed on. Repeated items or documents are reported each by itself.
Empty tables give no rows. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import hash64, mixed, ready, saved, slices, texts, words

#: Seen (1) and ignored (0) positions: together they find any 13 words with 2 substitutions, 15 with 3 or 20 with 4.
MASKS = ("1101111", "111010011", "1100011011", "10110001011")
#: Words that an overlap needs at least (or the whole item), and the part of them that must be equal.
OVERLAP, SIMILAR = 13, 0.8
#: Score of an unequal word in the stretch that is reported; an equal one counts 1.
UNEQUAL = -3
#: Equal words of an overlap for which a document is dropped.
LEAST_EQUAL = 8
#: Size of the bit table of test hashes, as a power of two: the least and the most.
LEAST_BITS, FILTER_BITS = 16, 27
#: Bits that each hash sets and tests; about one bit in 32 is set until the table has its full size.
PROBES = 4

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPREAD = np.array([hash64(f"position {i}".encode()) | 1 for i in range(64)], np.uint64)
_SEED = [(np.array([i for i, c in enumerate(m) if c == "1"]), len(m)) for m in MASKS]
_SHORTEST = max(map(len, MASKS))


def _coded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end); words of punctuation only are left out."""
    distinct, codes, first = words(values)
    stripped = [w.strip(_PUNCTUATION) for w in distinct.to_pylist()]
    kept = np.array([len(w) > 0 for w in stripped], bool)
    hashes = np.array([hash64(w) for w in stripped], np.uint64)
    takes = kept[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(takes)])
    return hashes[codes][takes] if len(codes) else np.zeros(0, np.uint64), before[first]


def _seeds(tokens: np.ndarray, seen: np.ndarray, span: int) -> np.ndarray:
    """A hash for each stretch of ``span`` words, of its seen words."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in seen:
        out += tokens[i : i + n] * _SPREAD[i]
    # equal seen words under different masks must not meet
    return mixed(out ^ np.uint64(hash64(f"{span} {seen.tolist()}".encode())))


def _whole(n: int) -> list[tuple[np.ndarray, int]]:
    """Masks over a whole short item, with as many words ignored as may differ."""
    return [(np.delete(np.arange(n), gone), n) for gone in combinations(range(n), int(n - SIMILAR * n + 1e-9))]


def _item_seeds(tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seed hashes, positions) of a test item under each mask."""
    for seen, span in _SEED + (_whole(len(tokens)) if 0 < len(tokens) < _SHORTEST else []):
        h = _seeds(tokens, seen, span)
        yield h, np.arange(len(h))


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Begin and end of the stretch with the largest score (equal 1, unequal ``UNEQUAL``)."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, UNEQUAL))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return begin, end


def _overlap(tokens: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
    """(begin in the text, begin in the item, words, equal words) of the best overlap on the given diagonals."""
    best = None
    for shift in shifts.tolist():
        a, b = max(shift, 0), min(shift + len(item), len(tokens))
        if a >= b:
            continue
        equal = tokens[a:b] == item[a - shift : b - shift]
        m = min(OVERLAP, len(item))
        if len(equal) < m:
            continue
        total = np.concatenate([[0], np.cumsum(equal)])
        windows = total[m:] - total[:-m]
        if windows.max() < SIMILAR * m:
            continue
        x, y = best_stretch(equal)
        if y - x < m:
            x = int(np.argmax(windows))
            y = x + m
        found = (a + x, a + x - shift, y - x, int(total[y] - total[x]))
        if best is None or (found[3], found[2]) > (best[3], best[2]):
            best = found
    return best


def _seed_table(items: DataFrame) -> DataFrame:
    """h, item, at: every seed of every test item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, first = _coded(texts(part))
            for i, name in enumerate(part.column("item").to_pylist()):
                for h, at in _item_seeds(flat[first[i] : first[i + 1]]):
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([name] * len(h)), pa.array(at)], ["h", "item", "at"])

    return items.select("item", "text").mapInArrow(run, "h long, item long, at long").distinct()


def _short_spans(items: DataFrame) -> list[int]:
    """The lengths of items that are shorter than the longest mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            sizes = np.diff(_coded(texts(part))[1])
            seen |= set(sizes[(sizes > 0) & (sizes < _SHORTEST)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["n"])

    return sorted(r.n for r in items.select("text").mapInArrow(run, "n long").distinct().collect())


def _slots(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each hash."""
    for k in range(PROBES):
        yield (mixed(h ^ _SPREAD[k]) >> np.uint64(64 - bits)).astype(np.int64)


class _Bits:
    """A bit table of hashes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the table."""
        at = np.arange(len(h))
        for k in range(PROBES):
            slot = (mixed(h[at] ^ _SPREAD[k]) >> np.uint64(64 - self.bits)).astype(np.int64)
            at = at[(self.words[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1]
        return at


def _bit_table(hashes: DataFrame) -> _Bits:
    """The bits of column ``h``."""
    bits = min(FILTER_BITS, max(LEAST_BITS, (32 * PROBES * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            slot = np.unique(np.concatenate(list(_slots(part.column("h").to_numpy().view(np.uint64), bits))))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], ["w", "b"])

    rows = hashes.select("h").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words_ = np.zeros(1 << (bits - 5), np.uint32)
    words_[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return _Bits(words_, bits)


def _hits(docs: DataFrame, table: _Bits, spans: list[int]) -> DataFrame:
    """text_key, h64, text, and the hashes and positions (h, at) of its seeds that may be seeds of a test item."""
    masks = _SEED + [x for n in spans for x in _whole(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, first = _coded(texts(part))
            hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for seen, span in masks:
                h = _seeds(flat, seen, span)
                near = table.find(h)
                owner = np.searchsorted(first[1:], near, "right")
                # a stretch that runs over the end of its text is none
                near = near[near + span <= first[1:][owner]] if len(near) else near
                hashes.append(h[near])
                places.append(near)
            h, place = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(place, kind="stable")
            h, place = h[order], place[order]
            owner = np.searchsorted(first[1:], place, "right")
            text, count = np.unique(owner, return_counts=True)
            if len(text):
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(text)) for c in ("text_key", "h64", "text")), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place - first[owner]))],
                    ["text_key", "h64", "text", "h", "at"],
                )

    return docs.select("text_key", "h64", "text").mapInArrow(run, "text_key string, h64 long, text string, h array<long>, at array<long>")


_FOUND = "text_key string, item long, doc_word long, item_word long, n_words long, n_equal long"


def _verified(key, texts_, candidates):
    """The best overlap of one text with each of its candidate items."""
    out = []
    if texts_.num_rows and candidates.num_rows:
        tokens, _ = _coded(texts_.column("text").slice(0, 1).combine_chunks())
        order = candidates.sort_by([("item", "ascending"), ("shift", "ascending")])
        item, shift = order.column("item").to_numpy(), order.column("shift").to_numpy()
        cuts = np.flatnonzero(np.diff(item)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(item)], strict=True):
            own, _ = _coded(pa.array([order.column("item_text")[int(low)].as_py() or ""], pa.string()))
            found = _overlap(tokens, own, shift[low:high])
            if found:
                out.append((key[0].as_py(), int(item[low]), *found))
    columns = list(zip(*out, strict=True)) or [[] for _ in range(6)]
    return pa.table([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["text_key", "item", "doc_word", "item_word", "n_words", "n_equal"])


def _overlapping_texts(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overlaps by key of the text and number of the item, numbered items, texts with hits); ``docs`` has text_key, h64, text."""
    ready(docs.sparkSession)
    items = saved(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    seeds = saved(_seed_table(items), "seeds")
    near = saved(_hits(docs, _bit_table(seeds), _short_spans(items)), "hits")
    hits = near.select("text_key", F.explode(F.arrays_zip("h", "at")).alias("s")).select("text_key", "s.h", F.col("s.at").alias("doc_at"))
    candidates = saved(hits.join(seeds, "h").select("text_key", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct(), "candidates")
    wanted = near.select("text_key", "text").join(candidates.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    laid = candidates.join(items.select("item", F.col("text").alias("item_text")), "item")
    return wanted.groupBy("text_key").cogroup(laid.groupBy("text_key")).applyInArrow(_verified, _FOUND), items, near


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(*columns, F.sha2(text, 256).alias("text_key"), F.xxhash64(text).alias("h64"), text.alias("text"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that overlap, with the best overlap.

    Columns doc_id, item_id, doc_word and item_word (first word of the overlap), n_words, n_equal.
    """
    keyed = _keyed(docs, "doc_id")
    found, items, _ = _overlapping_texts(keyed, benchmark)
    named = saved(found, "overlaps").join(items.select("item", "item_id"), "item")
    return keyed.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """``docs`` without the rows that overlap a test item in ``least_equal`` equal words; all columns and their order are kept."""
    found, _, near = _overlapping_texts(_keyed(docs), benchmark)
    bad = found.where(F.col("n_equal") >= least_equal).select("text_key").distinct()
    bad = saved(near.select("text_key", F.col("h64").alias("h")).distinct().join(bad, "text_key"), "contaminated")
    table = _bit_table(bad)
    mark = "text_hash"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))

    def parted(passing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                near_ = np.zeros(part.num_rows, bool)
                near_[table.find(part.column(mark).to_numpy().view(np.uint64))] = True
                yield part.filter(pa.array(near_ == passing)).drop_columns([mark])

        return marked.mapInArrow(run, docs.schema)

    # rows that the bit table lets through are told apart exactly, all others stay without being moved
    maybe = parted(True)
    exact = maybe.join(bad.select(F.col("text_key").alias(mark)), F.sha2(F.coalesce(maybe["text"], F.lit("")), 256) == F.col(mark), "left_anti")
    return parted(False).unionByName(exact)
