"""LM scoring by online logistic context mixing.

A text is a sequence of words and an end. A first decision says whether a word is one of the training words; a known word
is written as eight bits that its first letters decide, then as one of the words with these bits. Each bit is predicted by
several contexts: counts over the training corpus of the bits so far alone, after the class of the word before, and after
the two words before; and counts over the text so far, alone and after the class of the word before. Their log odds are
mixed by weights that bit position and experience select; the weights learn from their errors every ``CHUNK`` words, and an
adaptive table corrects the mix. The word within its class has two predictions: the counts of the corpus and of the text so
far, and the training words that followed the word before and the two words before; a logistic gate that learns in the same
way mixes them. It is one decision among the words of the class, not a row of bits. The rate of unknown words blends corpus
and text. The product over all decisions is a probability over training words, one unknown word and the end, so it can be
held against a unigram model. ``bits_per_byte`` also pays for the letters of unknown words: each is spelled byte by byte up
to a blank, every bit predicted by a mix of hashed counts after no, one, two and three bytes, taken from the training words.

Each task cuts its rows into blocks of about ``BLOCK_BYTES`` of text, which are written once, as the places of their tokens
in the block's list of words, in a table bucketed by block; texts are not shuffled. The list goes to parts by the words'
hash. A part sums the training counts over all blocks, numbers the training words within their class, frequent ones first,
and returns count and number of each block's own words, so the vocabulary may be of any size. The same holds for words in
context: each block sends its distinct (words before, word) by these numbers to parts by the context's hash, with columns
compressed; a part sums them over all training documents, and returns to each block the counts on the way to its own pairs,
from the context over the class bits to the word. A pair with a word that no training text holds has no counts and is not
sent. A part compares full 64-bit hashes of contexts, so these share no counts. Only tables whose size the classes fix
(after a class), those of spelling and a few sums are broadcast. Every text is scored by itself, from fixed starting
weights: results do not depend on the blocks.

Null and empty texts consist of the end. A null id counts as an empty one (a training document). Repeated rows are scored
and counted each. Texts of more than ``SPAN`` words begin with fresh adaptive state every ``SPAN`` words. With no training
document every token is unknown. An empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import SLICE_BYTES, mixed, raw_bytes, ready, saved, shared_path, slices, text_bytes, texts, word_hashes, words

FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES, SPAN = 12 << 20, 1 << 20
#: Text bytes to one part of the words and of the (context, word) pairs; tokens that are scored at a time.
PART_BYTES, SCORED = 8 << 20, 120_000
#: Bits of a class, words between updates of the weights.
BITS, CHUNK = 8, 64
#: Learning rate and starting weights of: corpus alone, after a class, after two words; text alone, after a class.
RATE, WEIGHTS = 0.004, (0.35, 0.3, 0.25, 0.25, 0.15)
#: Strength of the corpus estimate of unknown words, of the words of a class, and of the correcting table.
UNKNOWN_PRIOR, WORD_PRIOR, TABLE_PRIOR = 40.0, 6.0, 100.0
#: Learning rate and starting weights of the gate: constant, repetition after one word, after two words.
GATE_RATE, GATE_WEIGHTS = 0.02, (0.0, 0.3, 0.3)
#: Bytes before that spelling looks at, at most, and slots of each table.
SPELL_ORDERS, SPELL_SLOTS = 3, 1 << 18

_NODES = 1 << BITS
_POS = np.int64(20)
_SIZE = _NODES + (_NODES + 1) * _NODES
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Counts on the way to a pair: the context, each class bit, the word; and how many words the class has there.
_WORD, _KINDS = BITS + 1, BITS + 2
_WAY = BITS + 3


@dataclass
class Tokens:
    """Words of some texts with an end behind each text."""

    distinct: pa.Array  # the end is the empty word
    word: np.ndarray  # code of each token
    text: np.ndarray  # text of each token
    hashed: np.ndarray  # of each distinct word
    classes: np.ndarray  # class of each distinct word; the end alone is 0
    n: int


def tokens(values: pa.Array) -> Tokens:
    distinct, codes, first = words(values)
    n, count = len(values), np.diff(first)
    word = np.insert(codes.astype(np.int64), first[1:], len(distinct))
    distinct = pa.concat_arrays([distinct, pa.array([b""], pa.binary())])
    return Tokens(distinct, word, np.repeat(np.arange(n), count + 1), word_hashes(distinct), classes_of(distinct), n)


def _leading(distinct: pa.Array, count: int) -> list[np.ndarray]:
    """The first bytes of each word, 0 behind its end."""
    data, offsets = raw_bytes(distinct)
    length, data = np.diff(offsets), np.append(data, np.zeros(count, np.uint8))
    return [np.where(length > k, data[offsets[:-1] + k], 0).astype(np.int64) for k in range(count)]


def classes_of(distinct: pa.Array) -> np.ndarray:
    """Class of each word; the end, an empty word, alone has 0."""
    one, two = _leading(distinct, 2)
    return np.where(pc.binary_length(distinct).to_numpy() > 0, np.maximum((one & 31) * 8 + (two & 7), 1), 0)


def _before(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Class of the token before each one."""
    before = np.append(_NODES, code[:-1])
    before[np.append(True, text[1:] != text[:-1])[: len(code)]] = _NODES
    return before[: len(code)]


def _node(code: np.ndarray, depth: int) -> np.ndarray:
    """The node of a binary tree (1: root) at which bit ``depth`` is decided."""
    return (code | _NODES) >> (BITS - depth)


def _places(node: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the two contexts made of classes; no two contexts share one."""
    return node, before * _NODES + node + _NODES


def class_pairs(code: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How often each class follows each class."""
    return np.bincount(before * _NODES + code, minlength=(_NODES + 1) * _NODES)


def slots_of(followed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits seen, ones among them) of each slot, from ``class_pairs``."""
    followed = followed.reshape(_NODES + 1, _NODES)
    seen, ones = np.zeros((_NODES + 2, _NODES), np.int64), np.zeros((_NODES + 2, _NODES), np.int64)
    for depth in range(BITS):
        halves = followed.reshape(_NODES + 1, 1 << depth, 2, -1).sum(3)
        nodes = slice(1 << depth, 2 << depth)
        seen[1:, nodes], ones[1:, nodes] = halves.sum(2), halves[:, :, 1]
    seen[0], ones[0] = seen[1:].sum(0), ones[1:].sum(0)
    return seen.reshape(-1), ones.reshape(-1)


def count_slots(t: Tokens, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits seen, ones among them) of each slot, over the used tokens."""
    code = t.classes[t.word]
    return slots_of(class_pairs(code[used], _before(code, t.text)[used]))


def _after_one(last: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A single word as context. It is one for each class, since few words may be followed by most of the corpus."""
    return mixed(last.astype(np.uint64) * _ODD + code.astype(np.uint64) * _ODD2 + np.uint64(1))


def _after_two(last: np.ndarray, last2: np.ndarray) -> np.ndarray:
    return mixed((last.astype(np.uint64) * _ODD + last2.astype(np.uint64)) * _ODD2)


def pairs(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of each token after the word before, then of each after the two words before, by hashes.

    The word's class stands in its upper bits.
    """
    code, h = t.classes[t.word], t.hashed[t.word]
    begins = np.append(True, t.text[1:] != t.text[:-1])
    last = np.append(np.uint64(1), h[:-1])
    last[begins] = 1
    last2 = np.append(np.uint64(2), last[:-1])
    last2[begins] = 2
    word = code.astype(np.uint64) << np.uint64(64 - BITS) | h >> np.uint64(BITS)
    return np.concatenate([_after_one(last, code), _after_two(last, last2)]), np.concatenate([word, word])


def _distinct(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, the sum of each, and the place of each input among them."""
    # blocks send their pairs in order: a stable sort merges them
    order = np.argsort(context, kind="stable")
    group = np.cumsum(np.append(False, np.diff(context[order]) != 0)[: len(order)]).astype(np.uint64)
    # numbers of words leave room for the context's place before them, hashes do not
    low = int((word & np.uint64((1 << (64 - BITS)) - 1)).max(initial=0)).bit_length()
    if len(word) and low + BITS + int(group[-1]).bit_length() <= 64:
        short = word >> np.uint64(64 - BITS) << np.uint64(low) | word & np.uint64((1 << low) - 1)
        order = order[np.argsort(group << np.uint64(low + BITS) | short[order], kind="stable")]
    else:
        order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return context[at], word[at], _sums(np.asarray(n)[order].astype(np.int64), at), place


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at ``start``."""
    return np.add.reduceat(values, start) if len(start) else np.zeros(0, values.dtype)


def ways(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_WAY`` counts for each pair, from all pairs of its context."""
    way, place = _ways(context, word, n, range(BITS + 1))
    return way.astype(np.float32)[:, place]


def _ways(context: np.ndarray, word: np.ndarray, n: np.ndarray, depths) -> tuple[np.ndarray, np.ndarray]:
    """(counts on the way to each distinct pair after ``depths`` bits, its own and the words of its class; place of each input)."""
    context, word, n, place = _distinct(context, word, n)
    out = np.empty((len(depths) + 2, len(n)), np.uint32 if n.sum() < 1 << 31 else np.uint64)
    other = np.append(True, context[1:] != context[:-1])[: len(n)]
    for k, depth in enumerate(depths):
        new = other.copy()
        if depth:
            bits = word >> np.uint64(64 - depth)
            new[1:] |= bits[1:] != bits[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(n)))
        out[k] = np.repeat(_sums(n, start), size)
        if depth == BITS:
            out[-1] = np.repeat(_sums((n > 0).astype(np.int64), start), size)
    out[-2] = n
    return out, place


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by key, in order within each; where the key of each begins among them)."""
    at = np.arange(len(key), dtype=np.int64)
    if len(key) <= 1 << int(_POS):
        order = np.sort(key << _POS | at)
        place, group = order & ((1 << int(_POS)) - 1), order >> _POS
    else:
        place = np.argsort(key, kind="stable")
        group = key[place]
    new = np.append(True, group[1:] != group[:-1])[: len(key)]
    return place, np.maximum.accumulate(np.where(new, at, 0))


def _along(place: np.ndarray, start: np.ndarray, code: np.ndarray):
    """For each number of bits of the class: how many tokens of its group before each one have the same.

    ``place`` and ``start`` are those of ``_grouped``. Each bit splits the groups in order, so nothing is sorted again.
    """
    at, code = np.arange(len(code)), code.astype(np.uint8)[place]
    for depth in range(BITS + 1):
        seen = np.empty(len(code), np.float32)
        seen[place] = at - start
        yield seen
        if depth == BITS:
            return
        one = (code >> (BITS - 1 - depth) & 1).astype(np.int64)
        total = np.cumsum(one) - one
        hits = total - total[start]
        head = np.flatnonzero(start == at)
        size = np.diff(np.append(head, len(at)))
        second = start + np.repeat(size - _sums(one, head), size)
        to = at - hits
        to += one * (second + hits - to)
        start += one * (second - start)
        moved = [np.empty_like(x) for x in (place, start, code)]
        for x, y in zip(moved, (place, start, code), strict=True):
            x[to] = y
        place, start, code = moved


def _stretch(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.log((hits + np.float32(0.4)) / (seen - hits + np.float32(0.4)))


@dataclass
class Model:
    """What is learnt from the training corpus, in fixed size; counts in context come with the texts."""

    odds: np.ndarray  # log odds of a one in each slot
    mass: np.ndarray  # of the words of each class
    total: int
    distinct: int
    unknown: float  # share of unknown words to expect

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def score(self, t: Tokens, count: np.ndarray, way: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each text; ``count`` has the corpus count of each distinct word, ``way`` those of ``pairs``."""
        n = len(t.word)
        if way is None:
            way = np.zeros((_WAY, 2 * n), np.float32)
        return self.scored(t, count, lambda at: way[BITS:, at], lambda at: way[:, at + n])

    def scored(self, t: Tokens, count: np.ndarray, after_one, after_two) -> np.ndarray:
        """``score`` with two functions that give the counts of tokens, after one word from those of the class on."""
        n = len(t.word)
        position = np.arange(n) - np.flatnonzero(np.append(True, t.text[1:] != t.text[:-1]))[t.text]
        # adaptive state belongs to a span of a text
        span = np.cumsum(np.append(True, (t.text[1:] != t.text[:-1]) | (position[1:] % SPAN == 0))) - 1
        position = position % SPAN
        c = count[t.word]
        known = c > 0
        code = t.classes[t.word]
        before = _before(code, t.text)
        begin = np.flatnonzero(np.append(True, span[1:] != span[:-1])[:n])[span]
        unknowns = np.cumsum(~known) - ~known
        p_unknown = (unknowns - unknowns[begin] + UNKNOWN_PRIOR * self.unknown) / (np.arange(n) - begin + UNKNOWN_PRIOR)
        out = np.log(np.where(known, 1 - p_unknown, p_unknown))
        at = np.flatnonzero(known)
        span_k, code_k, c_k = span[at], code[at], c[at]
        gain = np.zeros(len(at))
        if len(at):
            turn = position[at] // CHUNK
            # spans are numbered from the longest, so those still running are the first
            length = np.zeros(int(span[-1]) + 1, np.int64)
            np.maximum.at(length, span_k, turn)
            number = np.empty(len(length), np.int64)
            number[np.argsort(-length, kind="stable")] = np.arange(len(length))
            span_k = number[span_k]
            # tokens of one chunk of all texts are worked on together
            order = np.lexsort((at, turn))
            ends = np.append(np.flatnonzero(np.diff(turn[order])) + 1, len(order))
            at, code_k, c_k, span_k = at[order], code_k[order], c_k[order], span_k[order]
            two = after_two(at)
            gain, class_before = self._bits(code_k, before[at], two, span_k, ends)
            # the word among those of its class
            place, start = _grouped(span_k * np.int64(len(t.distinct)) + t.word[at])
            words_before = np.empty(len(at))
            words_before[place] = np.arange(len(at)) - start
            plain = (words_before + WORD_PRIOR * (c_k + 0.5) / self.mass[code_k]) / (class_before + WORD_PRIOR)
            gain += _word(plain, after_one(at), two, span_k, slice(None), ends)
        out[at] += gain
        return np.bincount(t.text, weights=out, minlength=t.n) / math.log(10)

    def _bits(self, code, before, two, span, ends) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of the class of each token, eight bits, each with weights of its own; and its earlier ones."""
        m = len(code)
        share = (1 / (1 + np.exp(-self.odds))).astype(np.float32)
        inputs, gate = np.empty((len(WEIGHTS), BITS, m), np.float32), np.empty((BITS, m), np.int32)
        y = np.empty((BITS, m), np.float32)
        # a text's tokens stand in their order here too, only those of others between them
        histories = [_along(*_grouped(span), code), _along(*_grouped(span * np.int64(_NODES + 1) + before), code)]
        alike = [next(history) for history in histories]
        for depth in range(BITS):
            y[depth] = code >> (BITS - 1 - depth) & 1
            bit = y[depth]
            sign = 2 * bit - 1
            for k, place in enumerate(_places(_node(code, depth), before)):
                inputs[k, depth] = self.odds.take(place, mode="clip")
            # after two words; what was never seen there falls back to the class of the word before
            same, back = two[depth + 1], np.abs(share.take(place, mode="clip") - (1 - bit))
            inputs[2, depth] = sign * np.log((same + back) / (two[depth] - same + (1 - back)))
            gate[depth] = (span * 3 + (alike[0] > 0) + (alike[0] > 7)) * BITS + depth
            for k, history in enumerate(histories):
                same = next(history)
                inputs[3 + k, depth] = sign * _stretch(same, alike[k])
                alike[k] = same
        sets = (int(span.max()) + 1) * 3 * BITS
        weights = [np.full(sets, w, np.float32) for w in WEIGHTS]
        # the correcting table: by span and log odds
        cells = 16
        hits, tries = np.zeros(sets // 3 * cells), np.zeros(sets // 3 * cells)
        out, a = np.empty(m), 0
        for b in ends:
            x, t = inputs[:, :, a:b].reshape(len(WEIGHTS), -1), y[:, a:b].reshape(-1)
            g = gate[:, a:b].astype(np.int64)
            cell = (g // (3 * BITS) * BITS + np.arange(BITS)[:, None]).reshape(-1) * cells
            g = g.reshape(-1)
            z = x[0] * weights[0].take(g, mode="clip")
            for k in range(1, len(WEIGHTS)):
                z += x[k] * weights[k].take(g, mode="clip")
            z = np.clip(z, -12, 12)
            p = 1 / (1 + np.exp(-z))
            cell += ((z + 12) * (cells / 24.0001)).astype(np.int64)
            refined = (hits.take(cell, mode="clip") + TABLE_PRIOR * p) / (tries.take(cell, mode="clip") + TABLE_PRIOR)
            final = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            # the probability of what came, of all bits of a word
            out[a:b] = np.log(np.abs(final - (1 - t)).reshape(BITS, -1).prod(0))
            if b < m:
                error = (t - p) * np.float32(RATE)
                running = (int(g.max()) // (3 * BITS) + 1) * 3 * BITS
                for k, own in enumerate(weights):
                    own[:running] += np.bincount(g, weights=error * x[k], minlength=running)
                running = running // 3 * cells
                hits[:running] += np.bincount(cell, weights=t, minlength=running)
                tries[:running] += np.bincount(cell, minlength=running)
            a = b
        return out, alike[0]


def _letters(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of all words, each with a blank behind it; the word of each; and its contexts by number of bytes."""
    data, offsets = raw_bytes(distinct)
    count = np.diff(offsets)
    letter = np.insert(data, offsets[1:], 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(count)), count + 1)
    contexts, past = [np.zeros(len(letter), np.uint64)], letter
    for _ in range(SPELL_ORDERS):
        # a word begins after blanks
        past = np.append(np.uint64(32), past[:-1])
        past[np.append(True, owner[1:] != owner[:-1])[: len(past)]] = 32
        contexts.append(contexts[-1] << np.uint64(8) | past + np.uint64(1))
    return letter.astype(np.int64), owner, contexts


def _grams(distinct: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct letters with all their contexts, the contexts, which of them each letter of the words is, and its word."""
    letter, owner, contexts = _letters(distinct)
    key = letter.astype(np.uint64)
    # a context of k bytes has 8 k + 1 bits
    for k, context in enumerate(contexts[1:], 1):
        key = key << np.uint64(8 * k + 1) | context
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return letter[first], [c[first] for c in contexts], of, owner


def _spelled(letter: np.ndarray, contexts: list[np.ndarray]):
    """For each bit of the letters: is it a one, and its slot in each table."""
    for depth in range(8):
        node = (letter | 256) >> (8 - depth)
        yield letter >> (7 - depth) & 1 == 1, [k * SPELL_SLOTS + (mixed(c * _ODD + node.astype(np.uint64)) % np.uint64(SPELL_SLOTS)).astype(np.int64) for k, c in enumerate(contexts)]


def spelling_slots(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits seen, ones among them) of each slot, over the letters of the words."""
    size = (SPELL_ORDERS + 1) * SPELL_SLOTS
    seen, ones = np.zeros(size, np.int64), np.zeros(size, np.int64)
    letter, contexts, of, _ = _grams(distinct)
    count = np.bincount(of, minlength=len(letter))
    for bit, places in _spelled(letter, contexts):
        for k, place in enumerate(places):
            own, place = slice(k * SPELL_SLOTS, (k + 1) * SPELL_SLOTS), place - k * SPELL_SLOTS
            seen[own] += np.bincount(place, count, SPELL_SLOTS).astype(np.int64)
            ones[own] += np.bincount(place[bit], count[bit], SPELL_SLOTS).astype(np.int64)
    return seen, ones


def spelling_bits(distinct: pa.Array, seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Bits that it takes to spell each word."""
    letter, contexts, of, owner = _grams(distinct)
    out = np.zeros(len(letter))
    for bit, places in _spelled(letter, contexts):
        z, weight = np.zeros(len(letter)), np.zeros(len(letter))
        for k, place in enumerate(places):
            # the more a context was seen, and the longer it is, the more it counts
            trust = (k + 1) ** 2 * seen[place] / (seen[place] + 4.0) + 1e-3
            z += trust * _stretch(ones[place], seen[place])
            weight += trust
        out += np.logaddexp(0, np.where(bit, -1, 1) * z / weight)
    return np.bincount(owner, weights=out[of], minlength=len(distinct)) / math.log(2)


def _word(plain: np.ndarray, one: np.ndarray, two: np.ndarray, span, order, ends) -> np.ndarray:
    """Natural log probability of each word within its class, by the gate's mix of ``plain`` and the words in context."""
    near = plain
    features = [np.ones(len(plain))]
    for way in (one, two):
        seen, hits, kinds = way[-3:].astype(np.float64)
        # as many shares go to the shorter context as there are different words
        near = np.where(seen > 0, (hits + kinds * near) / np.maximum(seen + kinds, 1), near)
        features.append(np.log((seen + 0.4) / (kinds + 0.4)))
    gate = span * 3 + (one[-3] > 0) + (two[-3] > 0)
    features = np.stack(features, 1)[order]
    gate, far, plain = gate[order], near[order], plain[order]
    sets = (int(gate.max()) // 3 + 1) * 3
    weights = np.tile(np.array(GATE_WEIGHTS), (sets, 1))
    out, a = np.empty(len(plain)), 0
    for b in ends:
        x, g = features[a:b], gate[a:b]
        share = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", x, weights[g]), -8, 8)))
        p = share * far[a:b] + (1 - share) * plain[a:b]
        out[a:b] = np.log(p)
        if b < len(plain):
            error = (share * far[a:b] / p - share) * GATE_RATE
            running = (int(g.max()) // 3 + 1) * 3
            for k in range(x.shape[1]):
                weights[:running, k] += np.bincount(g, weights=error * x[:, k], minlength=running)
        a = b
    back = np.empty(len(plain))
    back[order] = out
    return back


def _pack(values: np.ndarray, steps: bool = True) -> bytes:
    """Integers by columns, or with ``steps`` their differences: the bytes of equal weight side by side, compressed."""
    values = np.ascontiguousarray(values)
    wide = bool(values.max(initial=0) >= 1 << 31)
    values = values.astype(np.uint64 if wide else np.uint32, copy=False)
    if steps:
        step = values.copy()
        step[1:] -= values[:-1]
        step = step.view(np.int64 if wide else np.int32)
        # small differences of either sign become small numbers
        values = (step << 1 ^ step >> (8 * step.itemsize - 1)).view(values.dtype)
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T[:width])
    return bytes([steps, wide, width]) + planes.nbytes.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int = 0) -> np.ndarray:
    """What ``_pack`` was given, as unsigned integers; with ``rows`` a table of so many."""
    steps, wide, width = packed[:3]
    planes = np.frombuffer(pa.decompress(packed[11:], int.from_bytes(packed[3:11], "little"), codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    kind, signed = (np.uint64, np.int64) if wide else (np.uint32, np.int32)
    values = np.zeros((planes.shape[1], 8 if wide else 4), np.uint8)
    for k, plane in enumerate(planes):
        values[:, k] = plane
    values = values.view(kind).reshape(-1)
    values = values.reshape(rows, -1) if rows else values
    if not steps:
        return values
    return np.cumsum((values >> kind(1)).view(signed) ^ -(values & kind(1)).view(signed), axis=0, dtype=signed).view(kind)


def _pack_words(distinct: pa.Array) -> bytes:
    data, offsets = raw_bytes(distinct)
    lengths = _pack(np.diff(offsets), steps=False)
    return len(lengths).to_bytes(8, "little") + len(data).to_bytes(8, "little") + lengths + pa.compress(np.ascontiguousarray(data), codec="zstd", asbytes=True)


def _unpack_words(packed: bytes) -> pa.Array:
    at, size = (int.from_bytes(packed[k : k + 8], "little") for k in (0, 8))
    lengths = _unpack(packed[16 : 16 + at])
    data = pa.decompress(packed[16 + at :], size, codec="zstd", asbytes=True)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of a hash."""
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _dealing(distinct: pa.Array) -> np.ndarray:
    """A hash of each word by which it is dealt; words may share one."""
    data, offsets = raw_bytes(distinct)
    length = np.diff(offsets)
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, _ODD))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(offsets[:-1], length)]))
    return mixed(total[offsets[1:]] - total[offsets[:-1]])


def _planes(lengths: np.ndarray) -> list[np.ndarray]:
    """Where each of the four bytes of each token stands; those of equal weight of a text are side by side."""
    first = np.cumsum(lengths) - lengths
    size = np.repeat(lengths, lengths)
    base = 4 * np.repeat(first, lengths) + np.arange(len(size)) - np.repeat(first, lengths)
    return [base + k * size for k in range(4)]


def _token_bytes(word: np.ndarray, lengths: np.ndarray) -> pa.Array:
    data = np.empty(4 * len(word), np.uint8)
    for k, place in enumerate(_planes(lengths)):
        data[place] = word >> 8 * k & 255
    offsets = np.append(0, 4 * np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _frequent(n: np.ndarray) -> np.ndarray:
    """A block's words, those of many training tokens first."""
    return np.argsort(-n, kind="stable")


def _tokens_of(rows: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """(a block's texts, its words by part, the words of all texts, how many each text has)."""
    listed = rows.filter(pc.is_valid(rows["part"])).sort_by("part")
    rows = rows.filter(pc.is_null(rows["part"]))
    column = rows["tokens"]
    data, offsets = raw_bytes(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type))
    lengths = np.diff(offsets) // 4
    code = sum(data[place].astype(np.int64) << 8 * k for k, place in enumerate(_planes(lengths)))
    return rows, listed, _frequent(_all_numbers(listed, "n"))[code], lengths


def _block_rows(block: int, held: list[tuple], parts: int, schema: pa.Schema):
    """A block's rows with their tokens; its words by part, with training counts; and its classes in sequence."""
    coded = pa.concat_arrays([*(found[0] for _, found in held), pa.array([b""], pa.binary())]).dictionary_encode()
    distinct, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    part, lead = _part_of(_dealing(distinct), parts), np.zeros(len(distinct), np.int64)
    for byte in _leading(distinct, 7):
        lead = lead << 8 | byte
    order = np.lexsort((lead, part))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    distinct, part = distinct.take(pa.array(order)), part[order]
    of, classes = number[of], classes_of(distinct)
    n, followed, begin = np.zeros(len(order), np.int64), np.zeros((_NODES + 1) * _NODES, np.int64), 0

    def batch(rows: int, **columns) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(rows, block), pa.int64())
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    found = []
    for rows, (own, code, first) in held:
        word = np.insert(of[begin : begin + len(own)][code], first[1:], of[-1])
        begin += len(own)
        lengths = np.diff(first) + 1
        train = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), lengths)
        n += np.bincount(word[train], minlength=len(n))
        kind = classes[word]
        followed += class_pairs(kind[train], _before(kind, np.repeat(np.arange(len(lengths)), lengths))[train])
        found.append((rows, word, lengths))
    # tokens are written by how frequent they are, as small numbers
    rank = np.empty(len(n), np.int64)
    rank[_frequent(n)] = np.arange(len(n))
    for rows, word, lengths in found:
        yield batch(len(lengths), doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), n_bytes=rows.column("n_bytes"), tokens=_token_bytes(rank[word], lengths))
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
    cuts = list(zip([0, *ends[:-1]], ends, strict=True))
    yield batch(len(cuts), part=pa.array(part[ends - 1]), words=pa.array([_pack_words(distinct.slice(a, b - a)) for a, b in cuts], pa.binary()), n=pa.array([_pack(n[a:b], False) for a, b in cuts], pa.binary()))
    yield batch(1, part=pa.array([-1], pa.int32()), n=pa.array([_pack(followed, False)], pa.binary()))


def _dealt(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows of all blocks, as ``_block_rows`` gives them, in a table bucketed by block."""
    spark, limit = docs.sparkSession, BLOCK_BYTES
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        block, kept, filled, schema = TaskContext.get().partitionId() << 32, [], 0, None
        for rows in slices(batches, limit=min(SLICE_BYTES, limit)):
            n_bytes = pc.cast(pc.binary_length(texts(rows)), pa.int64())
            more = pc.sum(n_bytes).as_py()
            schema = pa.schema([("block", pa.int64()), ("doc_id", rows.schema.field("doc_id").type), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("tokens", pa.binary()), ("part", pa.int32()), ("words", pa.binary()), ("n", pa.binary())])
            if kept and filled + more > limit:
                yield from _block_rows(block, kept, parts, schema)
                block, kept, filled = block + 1, [], 0
            kept.append((pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_bytes": n_bytes}).combine_chunks().to_batches()[0], words(texts(rows))))
            filled += more
        if kept:
            yield from _block_rows(block, kept, parts, schema)

    rows = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"block long, doc_id {kind}, held_out boolean, n_bytes long, tokens binary, part int, words binary, n binary")
    name = f"lm_blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(max(1, math.ceil(size / BLOCK_BYTES)), "block").option("compression", "zstd").option("path", shared_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _numbered(dealt: DataFrame, parts: int) -> DataFrame:
    """Of each block and part, in order of its words: n (training count) and number; then all training words, without a block.

    A word's number is 0 if no training text holds it, else its class and, above that, its place within the class from 1.
    """

    def run(table: pa.Table) -> pa.Table:
        lists = [_unpack_words(x) for x in table["words"].to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        distinct, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        part, ends = table["part"][0].as_py(), np.cumsum([len(x) for x in lists])
        total = np.bincount(of, weights=np.concatenate([_unpack(x) for x in table["n"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
        classes = classes_of(distinct)
        known = np.flatnonzero(total)
        known = known[np.lexsort((-total[known], classes[known]))]
        at = np.arange(len(known))
        first = np.append(True, classes[known][1:] != classes[known][:-1])[: len(known)]
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        number = np.zeros(len(distinct), np.int64)
        number[known] = (place * parts + part + 1) << BITS | classes[known]
        cut = [of[e - len(x) : e] for e, x in zip(ends, lists, strict=True)] + [known]
        packed = lambda x: pa.array([_pack(x[c], False) for c in cut], pa.binary())
        return pa.table({
            "block": pa.array([*table["block"].to_pylist(), None], pa.int64()), "part": pa.array(np.full(len(cut), part, np.int32)),
            "n": packed(total), "number": packed(number), "words": pa.array([None] * len(lists) + [_pack_words(distinct.take(pa.array(known)))], pa.binary()),
        })

    asked = dealt.where("part >= 0").select("block", "part", "words", "n")
    return asked.groupBy("part").applyInArrow(run, "block long, part int, n binary, number binary, words binary")


def _summed(rows: DataFrame, run) -> dict[str, np.ndarray]:
    """slot, a, b, c: sums over all tasks of tables of fixed size."""
    found = rows.mapInArrow(run, "slot int, a long, b long, c long").groupBy("slot").agg(*(F.sum(x).alias(x) for x in "abc")).toArrow()
    return {name: found[name].to_numpy() for name in found.column_names}


def _followed(dealt: DataFrame) -> np.ndarray:
    """``class_pairs`` of all training texts."""

    def run(batches):
        total = np.zeros((_NODES + 1) * _NODES, np.int64)
        for batch in batches:
            for x in batch.column("n").to_pylist():
                total += _unpack(x).astype(np.int64)
        slot = np.flatnonzero(total)
        yield pa.record_batch({"slot": slot.astype(np.int32), "a": total[slot], "b": total[slot], "c": total[slot]})

    found, total = _summed(dealt.where("part = -1").select("n"), run), np.zeros((_NODES + 1) * _NODES, np.int64)
    total[found["slot"]] = found["a"]
    return total


def _learnt(vocabulary: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """``spelling_slots`` of the training words, each taken once; and by class: tokens, words, words of one token."""
    size = (SPELL_ORDERS + 1) * SPELL_SLOTS

    def run(batches):
        sums = np.zeros((3, size + _NODES), np.int64)
        for batch in batches:
            for distinct, n, number in zip(*(batch.column(x).to_pylist() for x in ("words", "n", "number")), strict=True):
                distinct, n, classes = _unpack_words(distinct), _unpack(n).astype(np.int64), (_unpack(number) & np.uint64(_NODES - 1)).astype(np.int64)
                for part in slices([pa.record_batch({"word": distinct})], "word"):
                    sums[:2, :size] += spelling_slots(part.column("word"))
                for k, x in enumerate((n, np.ones(len(n)), n == 1)):
                    sums[k, size:] += np.bincount(classes, weights=x, minlength=_NODES).astype(np.int64)
        slot = np.flatnonzero(sums[0])
        yield pa.record_batch({"slot": slot.astype(np.int32)} | {name: sums[k, slot] for k, name in enumerate("abc")})

    found, sums = _summed(vocabulary.select("words", "n", "number"), run), np.zeros((3, size + _NODES), np.int64)
    for k, name in enumerate("abc"):
        sums[k, found["slot"]] = found[name]
    return (sums[0, :size], sums[1, :size]), sums[:, size:]


@dataclass
class _Pairs:
    """Distinct pairs of a block's words before, one or two, with a word behind them; all are training words."""

    columns: list[np.ndarray]  # numbers of the words, those before first; 0: the begin of the text
    token: np.ndarray  # tokens that have a pair
    place: np.ndarray  # the pair of each of these

    def parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(the pairs in order of their parts, where each part begins)."""
        *before, word = self.columns
        part = _part_of(_after_one(before[0], word & (_NODES - 1)) if len(before) == 1 else _after_two(before[1], before[0]), parts)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of so many bits in order, the place of each input among them)."""
    low = len(key).bit_length()
    if bits + low > 63:
        return np.unique(key, return_inverse=True)
    order = np.sort(key << low | np.arange(len(key)))
    key = order >> low
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    place = np.empty(len(key), np.int64)
    place[order & ((1 << low) - 1)] = np.cumsum(new) - 1
    return key[new], place


def _pairs_of(word: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> list[_Pairs]:
    """Pairs after one word and after two; ``number`` is that of each word of the block."""
    known = np.flatnonzero(number)
    # by class, then by place in it
    known = known[np.argsort((number[known] & (_NODES - 1)) << (63 - BITS) | number[known] >> BITS)]
    place = np.full(len(number), -1)
    place[known] = np.arange(1, len(known) + 1)
    numbers, own, begins = np.append(0, number[known]), place[word], np.cumsum(lengths) - lengths
    bits = len(known).bit_length()

    def ahead(of: np.ndarray) -> np.ndarray:
        before = np.append(0, of[:-1])[: len(of)]
        before[begins] = 0
        return before

    last = ahead(own)
    token = np.flatnonzero((own > 0) & (last >= 0))
    key, place = _ranked(last[token] << bits | own[token], 2 * bits)
    one = _Pairs([numbers[key >> bits], numbers[key & ((1 << bits) - 1)]], token, place)
    # the two words before a token are the pair of the token before
    pair = np.full(len(word), -1)
    pair[token] = place + 1
    pair = ahead(pair)
    token = np.flatnonzero((own > 0) & (pair >= 0))
    key, place = _ranked(pair[token] << bits | own[token], bits + len(key).bit_length())
    return [one, _Pairs([*(np.append(0, x)[key >> bits] for x in one.columns), numbers[key & ((1 << bits) - 1)]], token, place)]


def _levels(columns: list[np.ndarray], depths, cuts: np.ndarray | None = None) -> list[np.ndarray]:
    """Where the pairs of a context and of each ``depths`` bits of the class behind it begin; anew at each of the ``cuts``."""
    *before, word = columns
    new = np.ones(len(word), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in before])
    if cuts is not None:
        new[cuts] = True
    kind, out = (word & word.dtype.type(_NODES - 1)).astype(np.uint8), []
    turn = kind[1:] ^ kind[:-1]
    for depth in depths:
        flag = new.copy()
        flag[1:] |= turn >= 1 << (BITS - depth)
        out.append(np.flatnonzero(flag).astype(np.int32))
    return out


def _others(count, n: np.ndarray, levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pair, value) of all that blocks with training counts ``n`` cannot know themselves; ``count(k, pairs)`` gives ``_ways``.

    That is what other blocks count in a context, and at each step on the way how many of those turn off. Where none are
    left, nothing is said.
    """
    out, rows = [], None
    for k, start in enumerate(levels):
        more = count(k, start) - _sums(n, start)
        if rows is None:
            out.append((start, more))
        else:
            above = rows[start]
            said = np.flatnonzero(above)
            out.append((start[said], (above - more)[said]))
        rows = np.repeat(more, np.diff(np.append(start, len(n))))
    said = np.flatnonzero(rows)
    out.append((said, rows[said] - (count(-2, said) - n[said])))
    said = start[more > 0]
    out.append((said, count(-1, said) - _sums((n > 0).astype(np.int64), start)[more > 0]))
    return out


def _with_others(values: list[np.ndarray], n: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The counts of ``_ways`` for each pair, from the values of ``_others``; zeros behind them."""
    every, rows = np.zeros((len(levels) + 2, len(n) + 1), np.float32), None
    out = every[:, :-1]
    for k, start in enumerate(levels):
        size = np.diff(np.append(start, len(n)))
        if rows is None:
            more = values[0].astype(np.int64)
        else:
            more = rows[start]
            more[more > 0] -= values[k].astype(np.int64)
        out[k] = np.repeat(_sums(n, start) + more, size)
        rows = np.repeat(more, size)
    kinds = _sums((n > 0).astype(np.int64), start)
    kinds[more > 0] += values[-1].astype(np.int64)
    out[-1] = np.repeat(kinds, size)
    rows[rows > 0] -= values[-2].astype(np.int64)
    out[-2] = n + rows
    return every


def _context(columns: list[np.ndarray]) -> np.ndarray:
    """The context of each pair: its words if their numbers are short, in the order in which blocks send them, else a hash."""
    *before, word = (x.astype(np.uint64) for x in columns)
    kind = word & np.uint64(_NODES - 1)
    if max(int(x.max(initial=0)) for x in before) < 1 << 32:
        before = [(x & np.uint64(_NODES - 1)) << np.uint64(32 - BITS) | x >> np.uint64(BITS) for x in before]
        return before[0] << np.uint64(32) | (before[1] if len(before) > 1 else kind)
    return _after_two(before[1], before[0]) if len(before) > 1 else _after_one(before[0], kind)


def _all_numbers(rows: pa.Table, name: str) -> np.ndarray:
    """Of a block's words, in their order."""
    return np.concatenate([_unpack(x).astype(np.int64) for x in rows.sort_by("part")[name].to_pylist()])


#: Bits of the class after which counts are told, by number of words before: the class belongs to the context of one.
_DEPTHS = {"one": [BITS], "two": list(range(BITS + 1))}


def _counts_in_context(dealt: DataFrame, numbered: DataFrame, parts: int) -> DataFrame:
    """block, part and what ``_others`` says of the block's pairs in that part, one word before and two."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block = (left if left.num_rows else right)["block"][0].as_py()
        left, _, word, lengths = _tokens_of(left)
        train = np.repeat(~left["held_out"].to_numpy(), lengths)
        out = []
        for p in _pairs_of(word, lengths, _all_numbers(right, "number")):
            n = np.bincount(p.place, weights=train[p.token], minlength=len(p.columns[0]))
            order, cuts = p.parts(parts)
            columns = [x[order] for x in (*p.columns, n.astype(np.int64))]
            out.append([[_pack(x[a:b], k == 0) for k, x in enumerate(columns)] if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        part = [k for k in range(parts) if out[0][k] or out[1][k]]
        column = lambda x: pa.array([x[k] for k in part], pa.list_(pa.binary()))
        return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array([block] * len(part), pa.int64()), "one": column(out[0]), "two": column(out[1])})

    def answer(table: pa.Table) -> pa.Table:
        out = {"block": table["block"], "part": table["part"]}
        for name, depths in _DEPTHS.items():
            cells = [x and [_unpack(y) for y in x] for x in table[name].to_pylist()]
            if not any(cells):
                out[name] = pa.nulls(len(cells), pa.binary())
                continue
            *columns, n = (np.concatenate(x) for x in zip(*(x for x in cells if x), strict=True))
            word, n = columns[-1].astype(np.uint64), n.astype(np.int64)
            way, place = _ways(_context(columns), word << np.uint64(64 - BITS) | word >> np.uint64(BITS), n, depths)
            ends = np.cumsum([len(x[0]) if x else 0 for x in cells])
            begins = np.append(0, ends[:-1])
            said = _others(lambda k, at: way[k, place[at]].astype(np.int64), n, _levels(columns, depths, begins[begins < len(n)]))  # noqa: B023
            cuts = [np.searchsorted(at, np.append(0, ends)) for at, _ in said]
            # how many values of each kind, and these
            one = lambda j: np.concatenate([[c[j + 1] - c[j] for c in cuts], *(v[c[j] : c[j + 1]] for (_, v), c in zip(said, cuts, strict=True))])  # noqa: B023, E731
            out[name] = pa.array([_pack(one(j), False) if x else None for j, x in enumerate(cells)], pa.binary())
        return pa.table(out)

    rows = dealt.where("part IS NULL OR part >= 0").select("block", "held_out", "tokens", "part", "n")
    own = numbered.where("block IS NOT NULL").select("block", "part", "number")
    asked = rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(ask, "part int, block long, one array<binary>, two array<binary>")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, one binary, two binary")


def _answered(p: _Pairs, train: np.ndarray, packed: list[bytes], depths: list[int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts on the way to each pair, in order of the parts; the place among these of the pair of each token of the block)."""
    order, _ = p.parts(parts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[p.place]
    n = np.bincount(place, weights=train[p.token], minlength=len(order)).astype(np.int64)
    kinds, cells = len(depths) + 2, [_unpack(x) for x in packed]
    ends = [np.append(0, np.cumsum(x[:kinds], dtype=np.int64)) + kinds for x in cells]
    values = [np.concatenate([np.zeros(0, np.uint32), *(x[e[k] : e[k + 1]] for x, e in zip(cells, ends, strict=True))]) for k in range(kinds)]
    # a token without a pair has no counts
    of = np.full(len(train), len(order), np.int32)
    of[p.token] = place
    del place, cells
    return _with_others(values, n, _levels([x[order].astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64) for x in p.columns], depths)), of


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    ready(docs.sparkSession)
    size = text_bytes(docs)
    parts = max(1, math.ceil(size / PART_BYTES))
    # a block must hold the same rows each time
    dealt = _dealt(docs, size, parts)
    numbered = saved(_numbered(dealt, parts), "numbered")
    spelling, (tokens_in, words_in, once) = _learnt(numbered.where("block IS NULL"))
    seen, ones = slots_of(_followed(dealt))
    total, distinct = int(tokens_in.sum()), int(words_in.sum())
    # words seen once are as many as new ones are to be expected
    unknown = min(0.5, max(1e-6, int(once.sum()) / total)) if total else 1.0
    model = Model(_stretch(ones.astype(float), seen.astype(float)).astype(np.float32), np.where(words_in > 0, tokens_in + 0.5 * words_in, 1.0), total, distinct, unknown)
    # a block gets the corpus counts of its own words, and of its own words in context
    told = numbered.where("block IS NOT NULL").select("block", "part", "n", "number").unionByName(_counts_in_context(dealt, numbered, parts), allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, listed, word, lengths = _tokens_of(left)
        distinct = pa.concat_arrays([_unpack_words(x) for x in listed["words"].to_pylist()])
        own = right.filter(pc.is_valid(right["number"]))
        number, count = _all_numbers(own, "number"), _all_numbers(own, "n")
        right = right.filter(pc.is_null(right["number"])).sort_by("part")
        train = np.repeat(~left["held_out"].to_numpy(), lengths)
        answers = [_answered(p, train, right[name].drop_null().to_pylist(), depths, parts) for p, (name, depths) in zip(_pairs_of(word, lengths, number), _DEPTHS.items(), strict=True)]
        # the letters of unknown words; the end, an empty word, has none
        strange = np.flatnonzero((count == 0) & (pc.binary_length(distinct).to_numpy() > 0))
        letters = np.zeros(len(count))
        letters[strange] = spelling_bits(distinct.take(pa.array(strange)), *spelling)
        classes, out = classes_of(distinct), []
        ends = np.cumsum(lengths)
        cuts = np.flatnonzero(np.append(np.diff((ends - 1) // SCORED) > 0, True)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            begin, end = ends[a] - lengths[a], ends[b - 1]
            t = Tokens(distinct, word[begin:end], np.repeat(np.arange(b - a), lengths[a:b]), None, classes, b - a)
            per_token = count[t.word]
            scored = model.scored(t, count, *(lambda at, begin=begin, counts=counts, place=place: counts.take(place[begin + at], 1, mode="clip") for counts, place in answers))
            of = lambda x: np.bincount(t.text, weights=x, minlength=t.n)  # noqa: B023, E731
            part = left.slice(a, b - a)
            out.append(pa.table({
                "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": lengths[a:b], "n_known": of(per_token > 0).astype(np.int64),
                "train_tokens": np.full(t.n, model.total, np.int64), "base_score": of(model.base(per_token)), "score": scored, "bits_per_byte": (of(letters[t.word]) - scored * math.log2(10)) / np.maximum(part["n_bytes"].to_numpy(), 1),
            }))
        return pa.concat_tables(out)

    rows = dealt.where("part IS NULL OR part >= 0").select("block", "doc_id", "held_out", "n_bytes", "tokens", "part", "words", "n")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
