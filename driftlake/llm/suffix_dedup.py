"""Exact removal of repeated passages by suffix arrays built with two-stage sorting.

A byte goes if it is covered by a string of ``WINDOW`` bytes that also starts in a document with a smaller id; strings
are judged on the input. Every such string ("window") has one anchor, the smallest hash among its ``GRAM``-byte grams, so
equal windows have equal anchors at the same place; with some bytes to the left or right of it, it is the window's key.
The work is done in four exchanges:

1. Documents are dealt into blocks. A block sends the hashes of its keys to buckets.
2. A bucket answers which keys occur in more than one document; all others cannot hold a repeated window.
3. A block sends, for each anchor with repeated keys, the stretch of text whose windows have them (equal stretches once,
   with the smallest id). The windows of a key that many hold are sent one by one, to the buckets of their own hashes.
4. A bucket sorts the suffixes of its stretches: those smaller than their successor directly, the others induced by
   scanning the buckets of first bytes. Adjacent common prefixes of ``WINDOW`` bytes make groups of equal windows, whose
   smallest id is sent back; the block removes what a smaller id covers.

Rows between Spark stages are packed arrays for a (block, bucket) pair, so a task holds one block or one bucket.

Null texts are empty. A null id is larger than any other, and equal among nulls; equal ids do not remove from each other.
Repeated rows are documents of their own. Texts shorter than a window stay whole. An empty table gives no rows. Other
columns are passed over.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import hash64, mixed, raw_bytes, ready, slices, text_bytes, texts

#: Bytes of a window and of the grams whose least hash is its anchor.
WINDOW, GRAM = 50, 26
#: Text bytes of a block, and text bytes for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
#: Documents that hold a key above which its windows are sent one by one.
MANY = 256

_SPAN = WINDOW - GRAM + 1  # grams of a window
_LAST = np.iinfo(np.int64).max
_STEP = np.array([hash64(f"gram {i}".encode()) | 1 for i in range(5)], np.uint64)
# bytes that a key has besides the gram, and where its eight-byte words lie
_EXTRA = (WINDOW - GRAM) // 2
_KEY = (0, 8, 16, 24, GRAM + _EXTRA - 8)
# windows worked on at a time, and bits for a place among them
_PIECE, _PLACE = 1 << 20, np.uint64(22)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = padded[:n] << np.uint64(8) | padded[1 : n + 1]
    two = np.append(out, np.zeros(2, np.uint64))
    out = two[:n] << np.uint64(16) | two[2 : n + 2]
    four = np.append(out, np.zeros(4, np.uint64))
    return four[:n] << np.uint64(32) | four[4 : n + 4]


def _hashed(eight: np.ndarray, at: np.ndarray | slice, starts: tuple[int, ...]) -> np.ndarray:
    """A hash of the eight bytes at each of the given distances from the places."""
    out = np.uint64(0)
    for k, start in enumerate(starts):
        out = out + (eight[at + start] if isinstance(at, np.ndarray) else eight[at.start + start : at.stop + start]) * _STEP[k]
    return mixed(out)


def least_in_windows(h: np.ndarray) -> np.ndarray:
    """Place of the least hash (the first of equal ones) among the grams of each window."""
    n = len(h) - _SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the place stands in the low bits, so one minimum finds both
    best, width = h >> _PLACE << _PLACE | np.arange(len(h), dtype=np.uint64), 1
    while width < _SPAN:
        step = min(width, _SPAN - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows that have one anchor and one key: arrays anchor and key (hashes), start, count, occurrence, doc.

    The windows of an anchor that reach ``_EXTRA`` bytes to its left have the gram and those bytes as key, the others the
    gram and as many bytes to its right: longer than the anchor, and still inside every one of the windows.
    """
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts, occurrences = [], 0
    for begin in range(0, max(1, len(data) - WINDOW + 1), _PIECE):
        part = data[begin : begin + _PIECE + WINDOW - 1]
        own = owner[begin : begin + len(part)]
        eight = words_at(part)
        grams = len(part) - GRAM + 1
        h = _hashed(eight, slice(0, grams), (0, 8, 16, GRAM - 8)) if grams > 0 else np.zeros(0, np.uint64)
        at = least_in_windows(h)
        n = len(at)
        if not n:
            continue
        left = np.arange(n) <= at - _EXTRA
        same = np.zeros(n, bool)
        same[1:] = (at[1:] == at[:-1]) & (own[1:n] == own[: n - 1])
        new = ~same
        new[1:] |= left[1:] != left[:-1]
        # windows that cross from one document into the next belong to none
        inside = own[:n] == own[WINDOW - 1 :]
        start = np.flatnonzero(new & inside)
        run = np.cumsum(new) - 1
        count = np.bincount(run[inside], minlength=int(run[-1]) + 1)[run[start]]
        key = at[start] - np.where(left[start], _EXTRA, 0)
        parts.append((h[at[start]], _hashed(eight, key, _KEY), start + begin, count, (np.cumsum(~same) - 1)[start] + occurrences, own[start]))
        occurrences += n
    names = ("anchor", "key", "start", "count", "occurrence", "doc")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return {name: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))}


def suffix_order(data: np.ndarray, depth: int = WINDOW, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``data`` in the order of their first ``depth`` bytes.

    Two-stage sorting: suffixes smaller than their successors are sorted directly; the others are put in place by
    scanning, bucket by bucket of first bytes, what is already in place and looking at the byte before it. With ``wanted``
    (a flag for each place), the order holds these places and the few that they are induced from.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    follows = np.append(data[1:], np.uint8(0))
    # smaller than the successor: by the first byte that differs; the end is smaller than all
    differ = data != follows
    differ[-1] = True
    where = np.where(differ, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    small = data[nearest] < follows[nearest]
    needed = np.ones(n, bool)
    if wanted is not None:
        # each wanted suffix is induced through those behind it, up to the next that is sorted directly
        onward = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
        mine = np.flatnonzero(wanted)
        change = np.bincount(mine, minlength=n + 1) - np.bincount(onward[mine] + 1, minlength=n + 1)
        needed = np.cumsum(change)[:n] > 0
    eight = np.append(words_at(data), np.zeros(depth, np.uint64))
    picked = np.flatnonzero(small & needed)
    keys = [eight[picked + k] for k in range(0, depth + 1, 8)]
    direct = picked[np.lexsort(keys[::-1])]
    begin = np.concatenate([[0], np.cumsum(np.bincount(data[needed], minlength=256))])
    order = np.full(int(begin[-1]), -1, np.int64)
    # the small suffixes end each bucket
    small_counts = np.bincount(data[direct], minlength=256)
    small_begin = np.concatenate([[0], np.cumsum(small_counts)])
    fill = begin[:-1].copy()
    for c in range(256):
        if small_counts[c]:
            order[begin[c + 1] - small_counts[c] : begin[c + 1]] = direct[small_begin[c] : small_begin[c + 1]]

    def induce(found: np.ndarray, lowest: int) -> None:
        """Put the large predecessors of suffixes, in order, at the next free places of their buckets."""
        before = found[found > 0] - 1
        before = before[needed[before] & ~small[before] & (data[before] >= lowest)]
        if len(before):
            byte = data[before]
            for c in np.unique(byte).tolist():
                mine = before[byte == c]
                order[fill[c] : fill[c] + len(mine)] = mine
                fill[c] += len(mine)

    # the last suffix is large and follows the empty one
    induce(np.array([n]), 0)
    for c in range(256):
        done = int(begin[c])
        large_end = begin[c + 1] - small_counts[c]
        while done < large_end:  # a run of one byte induces within its own bucket
            upto = int(fill[c])
            if upto == done:
                break
            induce(order[done:upto], c)
            done = upto
        induce(order[large_end : begin[c + 1]], c + 1)
    return order


def equal_prefixes(data: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Whether each suffix has its first ``depth`` bytes in common with the one before it in order."""
    eight = np.append(words_at(data), np.zeros(depth, np.uint64))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in [*range(0, depth - 8, 8), depth - 8]:
        w = eight[order + k]
        same[1:] &= w[1:] == w[:-1]
    return same


def least_ids(pool: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each window of stretches laid end to end: ``length`` bytes each, from documents ``ids``."""
    # each stretch ends with a byte 0, which texts are shifted to be free of (0xFF is in no UTF-8)
    total = int((length + 1).sum())
    data = np.zeros(total, np.uint8)
    begin = np.cumsum(length + 1) - (length + 1)
    at = np.arange(len(pool)) + np.repeat(np.arange(len(length)), length)
    data[at] = pool + 1
    windows = length - WINDOW + 1
    first = np.repeat(begin, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window = np.zeros(total, bool)
    is_window[first] = True
    owner = np.zeros(total, np.int64)
    owner[first] = np.repeat(ids, windows)
    order = suffix_order(data, wanted=is_window)
    order = order[is_window[order]]
    group = np.cumsum(~equal_prefixes(data, order)) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, _LAST)
    np.minimum.at(least, group, owner[order])
    out = np.empty(total, np.int64)
    out[order] = least[group]
    return out[first]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each bucket that occurs, ascending."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return {int(bucket[x[0]]): x for x in np.split(order, cuts) if len(x)}


class _Block:
    """One block's texts with their stretches."""

    def __init__(self, table: pa.Table):
        data, ends, found, base = [], [np.zeros(1, np.int64)], [], 0
        docs = 0
        for part in slices(table.to_batches(), limit=_PIECE):
            bytes_of, offsets = raw_bytes(texts(part))
            f = stretches(bytes_of, offsets)
            f["start"], f["doc"], f["occurrence"] = f["start"] + base, f["doc"] + docs, f["occurrence"] + base
            found.append(f)
            data.append(bytes_of)
            ends.append(offsets[1:] + base)
            base, docs = base + len(bytes_of), docs + len(offsets) - 1
        self.data, self.offsets = np.concatenate(data), np.concatenate(ends)
        self.anchor, self.key, self.start, self.count, self.occurrence, self.doc = (np.concatenate([f[k] for f in found]) for k in ("anchor", "key", "start", "count", "occurrence", "doc"))
        self.ids = np.array([_LAST if i is None else i for i in table["doc_id"].to_pylist()], np.int64)
        # keys once each, in order of their hashes; documents of the block that hold each, and their different ids
        self.keys, self.which = np.unique(self.key, return_inverse=True)
        ids, kind = np.unique(self.ids, return_inverse=True)
        self.holders = self._different(self.doc, len(self.ids))
        self.kinds = self.holders
        if len(ids) < len(self.ids):  # documents with equal ids do not remove from each other
            self.kinds = self._different(kind[self.doc], len(ids))

    def _different(self, values: np.ndarray, n: int) -> np.ndarray:
        """How many different values (of n) each key has."""
        pairs = np.sort(self.which * n + values)
        return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] // n if len(pairs) else pairs, minlength=len(self.keys))

    def flagged(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """0, 1 (repeated) or 2 (held by many) for each key, from the buckets' answers."""
        out = np.zeros(len(self.keys), np.uint8)
        mine = _by_bucket(bucket_of(self.keys, buckets))
        for b, flags in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            out[mine[b]] = np.frombuffer(flags, np.uint8)
        return out

    def units(self, flags: np.ndarray, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct stretches to look up, their buckets, least id of each; unit, start and document of each use).

        The repeated runs of an anchor's occurrence are one unit in the anchor's bucket. The windows of a run whose key
        many hold are units of their own, in the buckets of their own hashes.
        """
        flag = flags[self.which]
        whole, each = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        # both runs of an occurrence follow one another
        head = np.append(True, self.occurrence[whole][1:] != self.occurrence[whole][:-1]) if len(whole) else np.zeros(0, bool)
        first = whole[head]
        joined = np.add.reduceat(self.count[whole], np.flatnonzero(head)) if len(whole) else np.zeros(0, np.int64)
        count = self.count[each]
        single = np.repeat(self.start[each], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = np.concatenate([self.start[first], single])
        length = np.concatenate([joined + WINDOW - 1, np.full(len(single), WINDOW)])
        doc = np.concatenate([self.doc[first], np.repeat(self.doc[each], count)])
        text = self.data.tobytes()
        cut = [text[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
        # a window that stands alone may be of either kind, so each kind has its own names
        stands, alone = {}, {}
        unit = np.array([stands.setdefault(t, len(stands)) for t in cut[: len(first)]] + [alone.setdefault(t, len(alone)) for t in cut[len(first) :]], np.int64)
        unit[len(first) :] += len(stands)
        bucket = np.empty(len(stands) + len(alone), np.int64)
        bucket[unit[: len(first)]] = bucket_of(self.anchor[first], buckets)
        bucket[len(stands) :] = [hash64(t) % buckets for t in alone]
        least = np.full(len(bucket), _LAST)
        np.minimum.at(least, unit, self.ids[doc])
        return [*stands, *alone], bucket, least, np.stack([unit, start, doc])


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    block, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})


_ROWS = "block int, bucket int, payload binary"


def _send_keys(table: pa.Table, buckets: int) -> pa.Table:
    block = _Block(table)
    number, rows = table["block"][0].as_py(), []
    for b, mine in _by_bucket(bucket_of(block.keys, buckets)).items():
        # 32 bits tell the keys of a bucket apart well enough; a clash only costs work
        h = (block.keys[mine] >> np.uint64(32)).astype("<u4")
        held = np.minimum(block.holders[mine], 255).astype(np.uint8)
        several = (block.kinds[mine] > 1).astype(np.uint8)
        rows.append((number, b, h.tobytes() + held.tobytes() + several.tobytes()))
    return _packed(rows)


def _answer_keys(table: pa.Table) -> pa.Table:
    payloads = table["payload"].to_pylist()
    sizes = [len(p) // 6 for p in payloads]
    h = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(payloads, sizes, strict=True)])
    held = np.concatenate([np.frombuffer(p, np.uint8, n, 4 * n) for p, n in zip(payloads, sizes, strict=True)])
    several = np.concatenate([np.frombuffer(p, np.uint8, n, 5 * n) for p, n in zip(payloads, sizes, strict=True)])
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    holders = np.bincount(which, weights=held)
    # in more than one block, or under more than one id of its only block
    repeated = (times > 1) | (np.bincount(which, weights=several) > 0)
    flag = np.where(repeated, np.where(holders > MANY, 2, 1), 0).astype(np.uint8)[which]
    ends = np.cumsum(sizes)
    return _packed([(a, b, flag[e - n : e].tobytes()) for a, b, e, n in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), ends, sizes, strict=True)])


def _send_stretches(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _packed([])
    block = _Block(docs)
    names, bucket, least, _ = block.units(block.flagged(answers, buckets), buckets)
    rows = []
    for b, mine in _by_bucket(bucket).items():
        texts_of = [names[u] for u in mine.tolist()]
        size = np.array([len(t) for t in texts_of], "<u2")
        rows.append((docs["block"][0].as_py(), b, np.array([len(mine)], "<u4").tobytes() + size.tobytes() + least[mine].astype("<i8").tobytes() + b"".join(texts_of)))
    return _packed(rows)


def _short(ids: np.ndarray) -> bytes:
    """Ids as the different ones and a number for each."""
    names, number = np.unique(ids, return_inverse=True)
    return np.array([len(names)], "<u4").tobytes() + names.astype("<i8").tobytes() + number.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()


def _long(payload: bytes) -> np.ndarray:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    return np.frombuffer(payload, "<i8", n, 4)[np.frombuffer(payload, "<u2" if n <= 1 << 16 else "<u4", -1, 4 + 8 * n)]


def _answer_stretches(table: pa.Table) -> pa.Table:
    sizes, ids, pools = [], [], []
    for p in table["payload"].to_pylist():
        n = int(np.frombuffer(p, "<u4", 1)[0])
        sizes.append(np.frombuffer(p, "<u2", n, 4).astype(np.int64))
        ids.append(np.frombuffer(p, "<i8", n, 4 + 2 * n))
        pools.append(np.frombuffer(p, np.uint8, -1, 4 + 10 * n))
    length = np.concatenate(sizes)
    least = least_ids(np.concatenate(pools), length, np.concatenate(ids))
    ends = np.cumsum([int((s - WINDOW + 1).sum()) for s in sizes])
    cuts = np.split(least, ends[:-1])
    return _packed([(a, b, _short(x)) for a, b, x in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), cuts, strict=True)])


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(docs: pa.Table, flags: pa.Table, answers: pa.Table, buckets: int, keep_text: bool) -> pa.Table:
    block = _Block(docs)
    names, bucket, _, unit = block.units(block.flagged(flags, buckets), buckets)
    size = np.array([len(t) for t in names], np.int64) - WINDOW + 1
    begin = np.cumsum(size) - size
    least = np.full(int(size.sum()), _LAST)
    places = _by_bucket(bucket)
    for b, payload in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True):
        mine = places[b]
        at = np.repeat(begin[mine], size[mine]) + np.arange(int(size[mine].sum())) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
        least[at] = _long(payload)
    # windows of each occurrence that start in a document with a smaller id
    u, start, doc = unit
    n = size[u]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    gone = least[np.repeat(begin[u], n) + step] < np.repeat(block.ids[doc], n)
    at = (np.repeat(start, n) + step)[gone]
    change = np.bincount(at, minlength=len(block.data) + 1) - np.bincount(at + WINDOW, minlength=len(block.data) + 1)[: len(block.data) + 1]
    covered = np.cumsum(change)[: len(block.data)] > 0
    rises = covered.copy()
    rises[1:] &= ~covered[:-1]
    inner = block.offsets[:-1][np.diff(block.offsets) > 0]
    rises[inner] = covered[inner]
    out: dict[str, list] = {k.split()[0]: [] for k in _RESULT.split(", ")}
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        kept = block.data[a:b][~covered[a:b]].tobytes()
        for name, value in zip(out, (b - a, b - a - len(kept), int(rises[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
            out[name].append(value)
    return pa.table({"doc_id": docs["doc_id"]} | {k: pa.array(v, {"kept_sha256": pa.string(), "kept": pa.binary()}.get(k, pa.int64())) for k, v in out.items()})


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with ``keep_text``) the kept bytes of each document."""
    ready(docs.sparkSession)
    total = text_bytes(docs)
    blocks, buckets = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # rows that repeat are spread by the part of the input they lie in
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    # the three steps over blocks read one exchange of the texts
    by_block = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", block.alias("block")).groupBy("block")

    def ordered(table: pa.Table) -> pa.Table:
        # every step must see a block in the same order
        text = [hash64((t or "").encode()) for t in table["text"].to_pylist()]
        ids = [_LAST if i is None else i for i in table["doc_id"].to_pylist()]
        return table.take(pa.array(np.lexsort((np.array(text, np.uint64), np.array(ids, np.int64)))))

    keys = by_block.applyInArrow(lambda t: _send_keys(ordered(t), buckets), _ROWS)
    flags = keys.groupBy("bucket").applyInArrow(_answer_keys, _ROWS)
    sent = by_block.cogroup(flags.groupBy("block")).applyInArrow(lambda a, b: _send_stretches(ordered(a), b, buckets), _ROWS)
    found = sent.groupBy("bucket").applyInArrow(_answer_stretches, _ROWS)
    # both answers to a block come together, told apart by their kind
    answers = flags.withColumn("kind", F.lit(0)).union(found.withColumn("kind", F.lit(1)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = b["kind"].to_numpy()
        return _remove(ordered(a), b.filter(pa.array(kinds == 0)), b.filter(pa.array(kinds == 1)), buckets, keep_text)

    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id bigint, {_RESULT}")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return out if keep_text else out.drop("kept")
