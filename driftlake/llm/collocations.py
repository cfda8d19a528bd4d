"""Phrase collocations by weighted acyclic automata (operator 12).

A shard (some megabytes of texts, read where they lie) sorts its windows of up to three words and builds a count
transducer from them in one pass: a path spells a phrase, the weights below an arc sum up to the phrase's count, states
with a single arc out are shared by all prefixes that lead to equal ones. Transducers are cut at prefixes (language, two words);
the pieces of a range from all shards are united and their weights summed, in levels of at most ``FAN`` shards, so neither
the pieces of a range nor those of a shard grow without bound and a phrase in every text is one path per shard. Of the
united transducers the paths of ``least`` occurrences or more stay: parts of candidates are candidates or words themselves.
Counts of parts are found by composing: each range lists the parts of its candidates as an acceptor, sends it to the ranges
where they lie and gets back the weights of the paths both have; a word whose paths lie in several ranges is summed.

Words end a window where the text or a piece ends, so every word starts one window and f of any phrase of up to three
words is the weight of its prefix. Scores are Python integers, so nothing overflows. Ranges are cut by a sample of texts,
which decides where work is done and has no influence on results.

A range may hold 2**21 - 1 different words; beyond, the run ends with an
error that names ``RANGE_BYTES``.

Edge cases: a null text is empty; a null language is ``und``, also beside one called so; texts without words give
nothing; equal rows count each; phrases of equal rank columns are ordered by their bytes; other columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.common import raw_bytes, saved, texts

LEAST, SHARE, BEST, LONGEST = 10, 50, 2000, 3
#: Bytes of text of a shard and of a range; shards (or united shards) per union; sampled bytes for the cuts.
SHARD_BYTES, RANGE_BYTES, FAN, SAMPLE_BYTES = 8 << 20, 12 << 20, 256, 2 << 20
BITS = 21
_MASK = (1 << BITS) - 1

# separators: 1 between words, 2 between pieces
_BREAK = np.zeros(256, np.uint8)
_BREAK[[0x20, 0x09]] = 1
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _tokens(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words in byte order, rank of each token's word from 1, whether the next token follows in the same piece, text)."""
    data, offsets = raw_bytes(values)
    kind = _BREAK[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    some = offsets[:-1] < offsets[1:]
    firsts, lasts = offsets[:-1][some], offsets[1:][some] - 1
    begins[firsts] |= kind[firsts] == 0
    ends[lasts] |= kind[lasts] == 0
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    kept = data[kind == 0]
    kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype(np.uint8)
    bounds = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=bounds[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(data) else np.zeros(0, np.int32)
    text = np.searchsorted(offsets, start, "right") - 1
    follows = np.zeros(len(start), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return coded.dictionary.take(order), rank[coded.indices.to_numpy(zero_copy_only=False)], follows, text


def _windows(rank: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Packed words of the window that starts at each token; 0 where the piece has ended."""
    second, third = np.zeros_like(rank), np.zeros_like(rank)
    second[:-1] = np.where(follows[:-1], rank[1:], 0)
    third[:-1] = np.where(second[:-1] > 0, second[1:], 0)
    return rank << (2 * BITS) | second << BITS | third


class Transducer:
    """Sorted windows of words with weights; ``words`` is in byte order, the numbers in the windows count from 1."""

    def __init__(self, words: pa.Array, keys: np.ndarray, weights: np.ndarray):
        self.words, self.keys, self.weights = words, keys, weights

    # -- as bytes ------------------------------------------------------------------------------------------------------

    def packed(self, low: int, high: int) -> bytes:
        """The automaton of the windows [low, high): arcs by depth, single-arc states shared, words that occur."""
        keys, weights = self.keys[low:high], self.weights[low:high]
        used, local = np.unique(np.concatenate([keys >> (2 * BITS), keys >> BITS & _MASK, keys & _MASK]), return_inverse=True)
        if used[0] != 0:
            used, local = np.append(0, used), local + 1
        w1, w2, w3 = local.reshape(3, -1)
        new1 = np.append(True, w1[1:] != w1[:-1])
        new2 = new1 | np.append(True, w2[1:] != w2[:-1])
        at2 = np.flatnonzero(new2)
        arcs1 = np.diff(np.append(np.flatnonzero(new1[at2]), len(at2)))
        arcs2 = np.diff(np.append(at2, len(keys)))
        single = np.repeat(arcs2 == 1, arcs2)
        states, shared = np.unique(w3[single] << 40 | np.minimum(weights[single], (1 << 40) - 1), return_inverse=True)
        names = self.words.take(pa.array(used[1:] - 1))
        data, offsets = raw_bytes(names)
        parts = [
            data, np.diff(offsets), w1[new1], arcs1, w2[at2], arcs2, states >> 40, states & ((1 << 40) - 1), shared, w3[~single], weights[~single],
        ]
        raw = b"".join(_small(p) for p in parts)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(piece: bytes) -> Transducer:
        raw = pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True)
        data, lengths, w1, arcs1, w2, arcs2, ends, sums, shared, w3, weights = _large(raw)
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(data.astype(np.uint8))])
        single = np.repeat(arcs2 == 1, arcs2)
        third, total = np.empty(len(single), np.int64), np.empty(len(single), np.int64)
        third[single], total[single] = ends[shared], sums[shared]
        third[~single], total[~single] = w3, weights
        first, second = np.repeat(np.repeat(w1, arcs1), arcs2), np.repeat(w2, arcs2)
        return Transducer(words, first << (2 * BITS) | second << BITS | third, total)

    # -- union and lookup ----------------------------------------------------------------------------------------------

    @staticmethod
    def union(parts: list[Transducer]) -> Transducer:
        """All paths of all parts, weights of equal ones summed."""
        coded = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        if len(order) > _MASK:
            raise ValueError("a range holds too many different words; lower RANGE_BYTES")
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(1, len(order) + 1)
        names = rank[coded.indices.to_numpy(zero_copy_only=False)]
        keys, at = [], 0
        for p in parts:
            to = np.append(0, names[at : at + len(p.words)])
            at += len(p.words)
            keys.append(to[p.keys >> (2 * BITS)] << (2 * BITS) | to[p.keys >> BITS & _MASK] << BITS | to[p.keys & _MASK])
        key, weight = np.concatenate(keys), np.concatenate([p.weights for p in parts])
        by = np.argsort(key, kind="stable")
        return Transducer(coded.dictionary.take(order), *_runs(key[by], weight[by]))

    def prefix(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(packed prefixes of ``depth`` words, their weights)."""
        shift = (LONGEST - depth) * BITS
        cut = self.keys >> shift
        real = (cut & _MASK) > 0
        return _runs(cut[real], self.weights[real])

    def rank(self, word: bytes) -> int:
        """Number of a word, or the number before which it would come as a negative one."""
        low, high = 0, len(self.words)
        while low < high:
            mid = (low + high) // 2
            if self.words[mid].as_py() < word:
                low = mid + 1
            else:
                high = mid
        return low + 1 if low < len(self.words) and self.words[low].as_py() == word else -(low + 1)

    def place(self, cut: tuple[bytes, bytes]) -> int:
        """The first window at or after a cut (word, word)."""
        first = self.rank(cut[0])
        if first < 0:
            return int(np.searchsorted(self.keys, -first << (2 * BITS)))
        return int(np.searchsorted(self.keys, first << (2 * BITS) | (abs(self.rank(cut[1])) if cut[1] else 0) << BITS))


def _runs(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, weights
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(weights, at)


def _small(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, behind their width and count."""
    top = int(values.max(initial=0))
    kind = next(i for i, bits in enumerate((8, 16, 32, 64)) if top < 1 << bits or bits == 64)
    body = values.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()
    return bytes([kind]) + len(values).to_bytes(6, "little") + body


def _large(raw: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        kind, count = raw[at], int.from_bytes(raw[at + 1 : at + 7], "little")
        at += 7
        yield np.frombuffer(raw, (np.uint8, np.uint16, np.uint32, np.uint64)[kind], count, at).astype(np.int64)
        at += count << kind


# -- shards and ranges -------------------------------------------------------------------------------------------------

_PIECES = "range int, shard long, lang string, piece binary"
_PIECE_NAMES = ["range", "shard", "lang", "piece"]


def _stacked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[str, Transducer]]:
    """One transducer per language of a batch."""
    words, rank, follows, text = _tokens(texts(batch))
    if len(words) > _MASK:
        half = batch.num_rows // 2
        if not half:
            raise ValueError("one text holds too many different words")
        yield from _shards(batch.slice(0, half))
        yield from _shards(batch.slice(half))
        return
    keys = _windows(rank, follows)
    langs = batch.column("lang").dictionary_encode()
    of = langs.indices.to_numpy()[text]
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        mine = np.sort(keys[of == i])
        if len(mine):
            yield lang, Transducer(words, *_runs(mine, np.ones(len(mine), np.int64)))


def _cut_up(lang: str, t: Transducer, cuts: list[tuple[str, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(range, bytes of the piece) of each range that the transducer has windows in."""
    first = bisect_right(cuts, (lang, b"", b""))
    own = [(a, b) for name, a, b in cuts[first:] if name == lang] if len(cuts) > first and cuts[first][0] == lang else []
    at = [0, *(t.place(c) for c in own), len(t.keys)]
    for i, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if high > low:
            yield first + i, t.packed(low, high)


def _united(pieces: pa.Table, lang: str) -> Transducer:
    mine = pieces.filter(pc.equal(pieces.column("lang"), lang))
    held, keys = [], 0
    for piece in mine.column("piece").to_pylist():
        held.append(Transducer.unpacked(piece))
        keys += len(held[-1].keys)
        if keys > 1 << 22:  # unite early, so that pieces which are alike take no more room
            held, keys = [Transducer.union(held)], 0
    return Transducer.union(held)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _uniting(cuts: list):
    """Unites the pieces of one range and some shards, and cuts the result up again."""

    def unite(key, table):
        out = []
        for name in pc.unique(table.column("lang")).to_pylist():
            out += [(at, key[1].as_py(), name, piece) for at, piece in _cut_up(name, _united(table, name), cuts)]
        return _batch(out, _PIECE_NAMES, [pa.int32(), pa.int64(), pa.string(), pa.binary()])

    return unite


def _cuts(docs: DataFrame, total: int, ranges: int) -> list[tuple[str, bytes, bytes]]:
    """Prefixes (language, word, word) that part the windows of a sample of texts evenly."""
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE_BYTES / max(total, 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for lang, t in _shards(batch):
                keys = t.keys[:: 1 + len(t.keys) // 2000]
                first = t.words.take(pa.array((keys >> (2 * BITS)) - 1))
                second = pc.fill_null(t.words.take(pa.array([int(k) - 1 if k else None for k in keys >> BITS & _MASK], pa.int64())), b"")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), first, second], ["lang", "a", "b"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = sorted((r.lang, bytes(r.a), bytes(r.b)) for r in sample.mapInArrow(pick, "lang string, a binary, b binary").collect())
    if not found:
        return []
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)})


def automata(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", ranges: int | None = None, fan: int | None = None) -> tuple[DataFrame, list]:
    """(united transducers by range and language: range, lang, n, piece; the cuts between ranges).

    Only paths of ``least`` or more occurrences stay, and words at the ends of a range, which may go on in the next one.
    """
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    total = int(rows.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    cuts = _cuts(rows, total, ranges or max(8, -(-total // RANGE_BYTES)))
    fan = fan or FAN
    shards = max(1, -(-total // SHARD_BYTES))
    levels = 1
    while fan**levels < shards:
        levels += 1

    def coarse(level: int) -> list:
        """The cuts of a level: about ``fan`` times as many as on the level before, all of them on the last."""
        step = 1 if level == levels else max(1, len(cuts) // fan**level)
        return cuts[step - 1 :: step]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(_stacked(batches, SHARD_BYTES)):
            shard = part << 24 | number
            for name, t in _shards(batch):
                for at, piece in _cut_up(name, t, coarse(1)):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([shard]), pa.array([name]), pa.array([piece], pa.binary())], _PIECE_NAMES)

    pieces = rows.mapInArrow(build, _PIECES)
    for level in range(1, levels):
        groups = -(-shards // fan**level)

        group = F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("g")
        pieces = pieces.groupBy("range", group).applyInArrow(_uniting(coarse(level + 1)), _PIECES)

    def finish(key, table):
        out = []
        for name in pc.unique(table.column("lang")).to_pylist():
            t = _united(table, name)
            kept = _frequent(t, least)
            out.append((key[0].as_py(), name, int(t.weights.sum()), kept.packed(0, len(kept.keys))))
        return _batch(out, ["range", "lang", "n", "piece"], [pa.int32(), pa.string(), pa.int64(), pa.binary()])

    return pieces.groupBy("range").applyInArrow(finish, "range int, lang string, n long, piece binary"), cuts


def _frequent(t: Transducer, least: int) -> Transducer:
    """Paths that occur ``least`` times or more, the rest of their prefixes' weights as paths that end there."""
    one, f1 = t.prefix(1)
    two, f2 = t.prefix(2)
    three, f3 = t.prefix(3)
    # the words at both ends may go on in the neighbouring ranges
    keep1 = (f1 >= least) | (one == one[0]) | (one == one[-1])
    keep2, keep3 = f2 >= least, f3 >= least
    one, f1, two, f2, three, f3 = one[keep1], f1[keep1], two[keep2], f2[keep2], three[keep3], f3[keep3]
    rest2 = f2 - _sum_at(two, three >> BITS, f3)
    rest1 = f1 - _sum_at(one, two >> BITS, f2)
    keys = np.concatenate([one << (2 * BITS), two << BITS, three])
    weights = np.concatenate([rest1, rest2, f3])
    by = np.argsort(keys, kind="stable")
    return Transducer(t.words, keys[by], weights[by])


def _sum_at(prefixes: np.ndarray, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(prefixes), np.int64)
    np.add.at(out, np.searchsorted(prefixes, of), weights)
    return out


# -- parts and scores --------------------------------------------------------------------------------------------------


def _numbers(words: pa.Array, wanted: pa.Array) -> np.ndarray:
    """Numbers of words in a transducer, 0 for those that it lacks."""
    return pc.fill_null(pc.index_in(wanted, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _weights_at(prefixes: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Weights of packed prefixes, 0 for those that no path has."""
    known, weights = prefixes
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weights[at], 0)


class _Candidates:
    """Phrases of a range as columns of word numbers, with their counts."""

    def __init__(self, piece: bytes, least: int):
        self.t = t = Transducer.unpacked(piece)
        self.two, self.three = t.prefix(2), t.prefix(3)
        often2, often3 = self.two[1] >= least, self.three[1] >= least
        self.pairs, self.f2 = self.two[0][often2], self.two[1][often2]
        self.triples, self.f3 = self.three[0][often3], self.three[1][often3]
        self.a2, self.b2 = self.pairs >> BITS, self.pairs & _MASK
        self.a3, self.b3, self.c3 = self.triples >> (2 * BITS), self.triples >> BITS & _MASK, self.triples & _MASK
        self.rest, self.rest_of = np.unique(self.triples & ((1 << (2 * BITS)) - 1), return_inverse=True)

    def most(self) -> np.ndarray:
        """The largest count of a candidate that ends in each rest."""
        out = np.zeros(len(self.rest), np.int64)
        np.maximum.at(out, self.rest_of, self.f3)
        return out

    def names(self) -> list[bytes]:
        return [b"", *self.t.words.to_pylist()]


def _requests(table: DataFrame, cuts: list, least: int) -> DataFrame:
    """Parts whose counts a range (src) needs, addressed to the ranges they lie in."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, lang, piece in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "piece")), strict=True):
                c = _Candidates(piece, least)
                names = c.names()
                out = []
                for number in np.unique(np.concatenate([c.a2, c.b2, c.a3, c.c3])).tolist():
                    word = names[number]
                    low, high = bisect_right(cuts, (lang, word, b"")), bisect_left(cuts, (lang, word + b"\0", b""))
                    out += [(at, src, lang, word, b"", 0) for at in range(low, high + 1)]
                for rest, most in zip(c.rest.tolist(), c.most().tolist(), strict=True):
                    a, b = names[rest >> BITS], names[rest & _MASK]
                    out.append((bisect_right(cuts, (lang, a, b)), src, lang, a, b, most))
                if out:
                    yield from _batch(out, ["range", "src", "lang", "a", "b", "most"], [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()]).to_batches()

    return table.select("range", "lang", "piece").mapInArrow(ask, "range int, src int, lang string, a binary, b binary, most long")


_ANSWER = "range int, lang string, a binary, b binary, f long, covers boolean"


def _composed(asked: pa.Table, own: pa.Table) -> pa.Table:
    """Counts of the parts asked for, to those who asked; and for this range, which of its phrases longer ones cover."""
    out = []
    for lang, piece in zip(own.column("lang").to_pylist(), own.column("piece").to_pylist(), strict=True):
        mine = asked.filter(pc.equal(asked.column("lang"), lang)).combine_chunks()
        if not mine.num_rows:
            continue
        t = Transducer.unpacked(piece)
        a, b = (mine.column(c).combine_chunks() for c in "ab")
        first, second = _numbers(t.words, a), _numbers(t.words, b)
        pair = pc.binary_length(b).to_numpy() > 0
        found = np.where(pair, _weights_at(t.prefix(2), np.where(second > 0, first << BITS | second, -1)), _weights_at(t.prefix(1), first))
        at = pa.array(np.flatnonzero(found > 0))
        out.append(pa.table({"range": mine.column("src").take(at), "lang": mine.column("lang").take(at), "a": a.take(at), "b": b.take(at), "f": pa.array(found[found > 0]), "covers": pa.array(np.zeros(len(at), bool))}))
        cover = mine.filter(pa.array(pair)).group_by(["range", "lang", "a", "b"]).aggregate([("most", "max")])
        out.append(pa.table({"range": cover.column("range"), "lang": cover.column("lang"), "a": cover.column("a"), "b": cover.column("b"), "f": cover.column("most_max"), "covers": pa.array(np.ones(cover.num_rows, bool))}))
    if not out:
        return _batch([], ["range", "lang", "a", "b", "f", "covers"], [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()])
    return pa.concat_tables(out)


def _scored(answers: pa.Table, own: pa.Table, least: int, share: int) -> pa.Table:
    """Candidates of a range that no longer one covers, with their lowest cut."""
    out = []
    for lang, piece in zip(own.column("lang").to_pylist(), own.column("piece").to_pylist(), strict=True):
        c = _Candidates(piece, least)
        words = c.t.words
        mine = answers.filter(pc.equal(answers.column("lang"), lang)).combine_chunks()
        a, b = (_numbers(words, mine.column(x).combine_chunks()) for x in "ab")
        f, covers = mine.column("f").to_numpy(), mine.column("covers").to_numpy(zero_copy_only=False)
        pair = pc.binary_length(mine.column("b")).to_numpy() > 0
        single = np.zeros(len(words) + 1, np.int64)
        np.add.at(single, a[~pair & ~covers], f[~pair & ~covers])
        asked = pair & ~covers
        by = np.argsort(a[asked] << BITS | b[asked])
        rests = (a[asked] << BITS | b[asked])[by], f[asked][by]
        longest = np.zeros(len(c.pairs), np.int64)
        # longer phrases that begin with a pair lie in this range; those that end in it were told by theirs
        starts = np.searchsorted(c.pairs, c.triples >> BITS)
        np.maximum.at(longest, starts, c.f3)
        told = np.searchsorted(c.pairs, key := a[covers] << BITS | b[covers])
        real = told < len(c.pairs)
        real[real] &= c.pairs[told[real]] == key[real]
        np.maximum.at(longest, told[real], f[covers][real])
        names = [w.decode("utf-8", "replace") for w in c.names()]
        for x, y, n, over in zip(c.a2.tolist(), c.b2.tolist(), c.f2.tolist(), longest.tolist(), strict=True):
            if 100 * over < share * n:
                left, right = int(single[x]), int(single[y])
                out.append((lang, f"{names[x]} {names[y]}", n, left, right, 1_000_000 * n * n // (left * right)))
        tail = _weights_at(rests, c.triples & ((1 << (2 * BITS)) - 1)).tolist()
        head = _weights_at(c.two, c.triples >> BITS).tolist()
        for x, y, z, n, front, back in zip(c.a3.tolist(), c.b3.tolist(), c.c3.tolist(), c.f3.tolist(), head, tail, strict=True):
            sides = (int(single[x]), back), (front, int(single[z]))
            score, _, (left, right) = min((1_000_000 * n * n // (p * q), k, (p, q)) for k, (p, q) in enumerate(sides))
            out.append((lang, f"{names[x]} {names[y]} {names[z]}", n, left, right, score))
    return _batch(out, ["lang", "phrase", "a", "l", "r", "score"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, best: int | None = BEST, text: str = "text", lang: str = "lang", **layout: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language (all, for ``best=None``)."""
    table, cuts = automata(docs, least, text, lang, **layout)
    table = saved(table, "automata")
    asked = _requests(table, cuts, least).groupBy("range")
    own = table.groupBy("range")
    answers = asked.cogroup(own).applyInArrow(_composed, _ANSWER)
    scored = answers.groupBy("range").cogroup(own).applyInArrow(lambda x, y: _scored(x, y, least, share), "lang string, phrase string, a long, l long, r long, score long")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    if best is not None:
        # the best of shares of a language first, so that the last task of it reads a bounded number of rows
        for shares in (64, 8):
            scored = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
            part = Window.partitionBy("lang", "share").orderBy(*order)
            scored = scored.withColumn("place", F.row_number().over(part)).where(F.col("place") <= best).drop("place", "share")
    ranked = scored.withColumn("rank", rank)
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT id, i, lang, word, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3
  FROM (SELECT id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
    FROM (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p))
  WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, word AS phrase FROM w
  UNION ALL SELECT lang, 2, word || ' ' || word2 FROM w WHERE word2 IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || word2 || ' ' || word3 FROM w WHERE word3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(ws[:j], ' ') AS first_part, array_to_string(ws[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
lefts AS MATERIALIZED (SELECT parts.*, f.f AS l FROM parts JOIN f ON f.lang = parts.lang AND f.phrase = parts.first_part),
s AS MATERIALIZED (SELECT lefts.lang, lefts.phrase, lefts.k, a, j, l, f.f AS r, 1000000 * a * a // (l * f.f) AS score
  FROM lefts JOIN f ON f.lang = lefts.lang AND f.phrase = lefts.rest
  QUALIFY row_number() OVER (PARTITION BY lefts.lang, lefts.phrase ORDER BY 1000000 * a * a // (l * f.f), j) = 1),
inner_parts AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.part = s.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * s.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang)
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
