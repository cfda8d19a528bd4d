"""Noisy-channel restoration of disguised words: character lattices, a character language model, Viterbi.

A token is noisy if letters stand beside digits or symbols, letters of two scripts mix, a letter comes three times or
more in a row, or two letters or more are doubled; so are three or more one-letter tokens in a row. Each character of
noise gives a lattice column of what it may stand for (itself, letters it resembles, a break, nothing), each with a
channel cost. The path with the best sum of channel and model log-probabilities is the restored text. All other tokens
have one path only, themselves in lower case, so they are not decoded.

The model is an interpolated 4-gram over 28 symbols (break, a to z, any other letter), counted over all words of all
documents that are not noisy themselves: a table of 28**4 numbers whatever the input.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import raw_bytes, slices, texts, words

SYMBOLS, OTHER = 28, 27
CONTEXTS = SYMBOLS**3

# Letters that digits and symbols stand for in leetspeak, letters of other scripts that look Latin.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "¡": "i", "¢": "c",
}
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}
INVISIBLE = {"​", "‌", "‍", "⁠", "﻿", "­"}
#: Channel log-probabilities.
AS_LETTER, AS_DIGIT, AS_BREAK, DROPPED, UNSEEN, TWICE, LONG_RUN, JOINED, APART = -1.0, -4.0, -0.5, -1.5, -0.1, -3.0, -0.7, -0.2, -3.0
#: One-letter tokens in a row that are read as one lattice.
SPACED = 3
#: Longer tokens are decoded in pieces between their symbols.
PIECE = 48

_LATIN = re.compile("[a-z]")
_EDGES = re.compile(r"^[^\w@$€£¥¢]+|[^\w@$€£¥¢]+$|^_+|_+$")
_LONG = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SPACE = re.compile(r"[\x20\x09-\x0d]+")
_LEET_OR_SIGN = re.compile(r"[0-9]|[^\w]|_")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def is_noisy(word: str) -> bool:
    """Whether a lower-cased token (punctuation at its ends cut off) has more than one reading."""
    if len(_LONG.findall(word)) and any(m.group(1).isalpha() for m in _LONG.finditer(word)):
        return True
    if not _LATIN.search(word):
        return False
    return bool(_LEET_OR_SIGN.search(word)) or len(_DOUBLE.findall(word)) > 1 or any(c in LOOKALIKE or c in INVISIBLE for c in word)


def _column(c: str, after: str, long: bool) -> list[tuple[int, str, float]]:
    """(symbol, or -1 for nothing; text; cost) of each reading of one character that follows ``after``."""
    if c in INVISIBLE:
        return [(-1, "", UNSEEN)]
    if c.isalpha() and c not in LOOKALIKE:
        cost = LONG_RUN if long and c == after else 0.0
        out = [(symbol(c), c, cost)]
        return [*out, (-1, "", LONG_RUN if long else TWICE)] if c == after else out
    letters = [(symbol(x), x, AS_LETTER) for x in LEET.get(c, LOOKALIKE.get(c, ""))]
    if c.isalnum():
        return [(OTHER, c, AS_DIGIT), *letters]
    return [(0, " ", AS_BREAK), (-1, "", DROPPED), *letters]


def _lattice(word: str) -> list[list[tuple[int, str, float]]]:
    long = {m.group(1) for m in _LONG.finditer(word)}
    short = _LONG.sub(r"\1\1", word)
    return [_column(c, short[i - 1] if i else "", c in long) for i, c in enumerate(short)]


def viterbi(lattice: list[list[tuple[int, str, float]]], model: array) -> str:
    """The text of the best path; a state is the last three symbols."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for column in lattice:
        following: dict[int, tuple[float, tuple | None]] = {}
        for context, (score, path) in states.items():
            for sign, text, cost in column:
                if sign < 0:
                    to, now, way = context, score + cost, path
                elif sign == 0:
                    to, now, way = 0, score + cost + (model[context * SYMBOLS] if context else 0.0), (path, text)
                else:
                    at = context * SYMBOLS + sign
                    to, now, way = at % CONTEXTS, score + cost + model[at], (path, text)
                if to not in following or now > following[to][0]:
                    following[to] = (now, way)
        states = following
    _, path = max(((score + (model[context * SYMBOLS] if context else 0.0), path) for context, (score, path) in states.items()), key=lambda s: s[0])
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def restore_token(token: str, model: array) -> str:
    """A token as it may have been meant, in lower case; several words if it holds breaks."""
    word = _EDGES.sub("", unicodedata.normalize("NFKC", token).lower() if not token.isascii() else token.lower())
    if not is_noisy(word):
        return word
    if len(word) > PIECE:
        pieces = re.split(r"([\W_]+)", _LONG.sub(r"\1\1", word))
        return " ".join(viterbi(_lattice(p), model) if len(p) <= PIECE and is_noisy(p) else p for p in pieces[::2] if p)
    return viterbi(_lattice(word), model)


def core(token: str) -> str:
    """The one letter or leet sign of a one-letter token, else nothing."""
    kept = [c for c in token.lower() if c.isalnum() or c in "@$"]
    return kept[0] if len(kept) == 1 else ""


def restore_spaced(letters: list[str], model: array) -> str:
    """One-letter tokens read as one lattice, in which each gap may be a break."""
    lattice = []
    for i, c in enumerate(letters):
        if i:
            lattice.append([(-1, "", JOINED), (0, " ", APART)])
        lattice.append(_column(c, "", False))
    return viterbi(lattice, model)


def restore_text(text: str | None, model: array) -> str:
    """Restored words of a text, in order, separated by blanks."""
    tokens = [t for t in _SPACE.split(text or "") if t]
    out, at = [], 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and core(tokens[end]):
            end += 1
        if end - at >= SPACED:
            out.append(restore_spaced([core(t) for t in tokens[at:end]], model))
            at = end
        else:
            end = max(end, at + 1)
            out += [restore_token(t, model) for t in tokens[at:end]]
            at = end
    return " ".join(w for w in " ".join(out).split(" ") if w)


# -- whole batches -----------------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)  # 0 sign, 1 letter, 2 digit, 3 byte of a character beyond ASCII
_CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3


def _per_word(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def suspects(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that may be noisy, one-letter tokens) among distinct lower-cased tokens; a superset of the first is fine."""
    data, offsets = raw_bytes(distinct)
    kind = _CLASS[data]
    letters, digits, beyond = (_per_word(kind == k, offsets) for k in (1, 2, 3))
    alnum = kind > 0
    inner = np.zeros(len(distinct), bool)
    has = letters + digits + beyond > 0
    if len(data):
        at = np.arange(len(data))
        first = np.minimum.reduceat(np.where(alnum, at, len(data)), offsets[:-1])
        last = np.maximum.reduceat(np.where(alnum, at, -1), offsets[:-1])
        inner = has & (last - first + 1 > letters + digits + beyond)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] == 1)
    same[offsets[:-1][offsets[:-1] < len(data)]] = False
    thrice = np.zeros(len(data), bool)
    thrice[1:] = same[1:] & same[:-1]
    money = np.isin(data, np.frombuffer(b"@$", np.uint8))
    some = letters > 0
    noisy = (beyond > 0) | (some & ((digits > 0) | inner | (_per_word(thrice, offsets) > 0) | (_per_word(same, offsets) > 1) | (_per_word(money, offsets) > 0)))
    one = (beyond == 0) & (letters + digits + _per_word(money, offsets) == 1)
    # tokens with characters beyond ASCII are few: look at each
    for i in np.flatnonzero(beyond):
        one[i] = len(core(distinct[int(i)].as_py().decode("utf-8", "replace"))) == 1
    return noisy, one


def spaced_runs(codes: np.ndarray, firsts: np.ndarray, one: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of one-letter tokens inside a text."""
    single = one[codes]
    if not single.any():
        return
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = single
    starts = inside[1:-1] & ~inside[:-2]
    begins = firsts[:-1][firsts[:-1] < len(codes)]
    starts[begins] |= single[begins]
    begin = np.flatnonzero(starts)
    # a run ends before the next start or the next token that is no single letter
    stop = np.append(np.flatnonzero(~single), len(codes))
    end = np.minimum(stop[np.searchsorted(stop, begin)], np.append(begin[1:], len(codes)))
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        if e - b >= SPACED:
            yield b, e


class Restorer:
    """Restored words of a batch of texts; remembers the tokens it has decoded (as many as fit a bounded table)."""

    REMEMBERED = 100_000

    def __init__(self, table: np.ndarray):
        self.model = array("f", np.ascontiguousarray(table, np.float32).tobytes())
        self.known: dict[bytes, bytes] = {}

    def token(self, word: bytes) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            found = self.known[word] = restore_token(word.decode("utf-8", "replace"), self.model).encode()
        return found

    def batch(self, values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct restored tokens, token of each (text, token) pair, text of the pair); pairs may repeat."""
        distinct, codes, firsts = words(values)
        noisy, one = suspects(distinct)
        text = np.repeat(np.arange(len(values)), np.diff(firsts))
        runs = list(spaced_runs(codes, firsts, one))
        plain = np.ones(len(codes), bool)
        extra = []
        for b, e in runs:
            plain[b:e] = False
            letters = [core(distinct[int(c)].as_py().decode("utf-8", "replace")) for c in codes[b:e]]
            extra.append(restore_spaced(letters, self.model).encode())
        changed = np.flatnonzero(noisy)
        restored = [self.token(distinct[int(i)].as_py()) for i in changed]
        place = np.arange(len(distinct))
        place[changed] = len(distinct) + np.arange(len(changed))
        all_words = pa.concat_arrays([distinct, pa.array(restored + extra, pa.binary())])
        run_codes = len(distinct) + len(changed) + np.arange(len(extra))
        return all_words, np.concatenate([place[codes[plain]], run_codes]), np.concatenate([text[plain], text[[b for b, _ in runs]] if runs else np.zeros(0, np.int64)])


def spread_out(distinct: pa.Array, before: int, after: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words with ``before`` and ``after`` fill bytes around each, start of each word with its fill)."""
    data, offsets = raw_bytes(distinct)
    gap = before + after
    out = np.full(len(data) + gap * len(distinct), fill, np.uint8)
    word = np.repeat(np.arange(len(distinct)), np.diff(offsets))
    out[np.arange(len(data)) + word * gap + before] = data
    return out, offsets[:-1] + gap * np.arange(len(distinct))


def _gram_counts(values: pa.Array) -> np.ndarray:
    """Counts of symbol 4-grams over the words of a batch that are not noisy."""
    distinct, codes, _ = words(values)
    if not len(distinct):
        return np.zeros(CONTEXTS * SYMBOLS, np.int64)
    noisy, _ = suspects(distinct)
    data, offsets = raw_bytes(distinct)
    beyond = _per_word(_CLASS[data] == 3, offsets) > 0
    digits = _per_word(_CLASS[data] == 2, offsets) > 0
    times = np.bincount(codes, minlength=len(distinct)) * ((~noisy | beyond) & ~digits)
    out, starts = spread_out(distinct, 3, 1, 0)
    keep = (out < 0x80) | (out >= 0xC0)
    sign = np.zeros(256, np.int64)
    sign[97:123], sign[0xC0:] = np.arange(1, 27), OTHER
    weight = np.repeat(times, np.diff(np.append(starts, len(out))))[keep]
    s = sign[out[keep]]
    ids = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(ids, weights=weight[3:], minlength=CONTEXTS * SYMBOLS).astype(np.int64)


def character_model(docs: DataFrame, column: str = "text") -> np.ndarray:
    """Log-probabilities of a symbol after three others, from all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        for batch in slices(batches, column):
            total += _gram_counts(texts(batch, column))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "c"])

    counts = docs.select(column).mapInArrow(count, "gram int, c long").groupBy("gram").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(CONTEXTS * SYMBOLS)
    table[counts.column("gram").to_numpy()] = counts.column("c").to_numpy()
    return log_probabilities(table)


def log_probabilities(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """Interpolation of orders one to four: each order leans on the shorter one with ``strength`` counts."""
    whole = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full((1, 1, 1, SYMBOLS), 1.0 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = whole.sum(axis=axes, keepdims=True) if axes else whole
        p = (c + strength * p) / (c.sum(axis=3, keepdims=True) + strength)
    return np.log(p).astype(np.float32).ravel()
