"""Token counts by overlap resynchronisation.

A document of more than ``HUGE`` characters is encoded in overlapping chunks with offsets. Two neighbours are spliced at
a boundary that both encodings have inside their overlap and that is proven stable: the place before a space that
stands between two other characters, where the tokenizer's pre-tokens always part, so neither side depends on what lies
beyond. If the overlap holds no such boundary, it is widened, at last up to the whole document. Other documents are
encoded whole: byte-level tokenizers part before each such space as well, so every distinct piece of a batch is encoded
once; a text with other white space around a space is given to the library as it is.

Null and empty texts have 0 tokens. Ids may be null or repeated; rows are neither joined nor grouped. Other columns are
passed over. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from driftlake.llm.common import ready, slices, texts

#: Characters above which a document is encoded in chunks, their length and first overlap.
HUGE, CHUNK, OVERLAP = 50_000, 20_000, 400
#: Distinct pieces a Python worker remembers between batches, and pieces encoded in one call.
REMEMBERED, PACK = 1_000_000, 500
LIMIT = 1024
#: Latin letters, then ASCII marks: byte-level pre-tokens part between them, so letters are encoded once for all marks.
_LETTERS_AND_MARKS = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


class Encoder:
    """Ids of whole texts, as the library of the vocabulary file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda batch: self.model.encode(batch, num_threads=1)
            self.size = self.model.get_piece_size()
        else:
            import tokenizers

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.model = None
            self.tokenizer = tokenizers.Tokenizer.from_file(path)
            self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.ids = lambda batch: [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            pre = spec.get("pre_tokenizer") or {}
            self.pieces = (
                spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
            )
        if self.pieces:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            # byte-level vocabularies write the space byte as U+0120
            self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
            self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
            self.known = pa.array([], pa.string())
            self.known_ids, self.known_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first character of each)."""
        if self.model is not None:
            made = self.model.encode(text, return_type="proto").pieces
            # this library counts bytes
            data = np.frombuffer(text.encode(), np.uint8)
            character = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
            return np.array([p.id for p in made], np.uint32), character[[p.begin for p in made]].astype(np.int64)
        made = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(made.ids, np.uint32), np.array([a for a, _ in made.offsets], np.int64)

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text among them)."""
        if not self.pieces:
            made = self.ids(values.to_pylist())
            counts = np.array([len(x) for x in made], np.int64)
            return np.array([i for x in made for i in x], np.uint32), np.cumsum(counts)
        split = pc.split_pattern(values, " ")
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        # a piece that is empty or has white space at an end might part elsewhere: its whole text goes to the library
        odd = pc.match_substring_regex(distinct, r"^[\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}]|[\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}]$|^$").to_numpy(zero_copy_only=False)
        texts_of = np.repeat(np.arange(len(values)), np.diff(ends))
        whole = np.zeros(len(values), bool)
        whole[texts_of[odd[codes]]] = True
        firsts = ends[:-1][~whole]
        takes = ~whole[texts_of]
        first = np.zeros(len(codes), bool)
        first[firsts] = True
        spaced_ids, spaced_ends = self._spaced(distinct, np.unique(codes[takes & ~first]))
        lead = np.unique(codes[firsts])
        lead_made = self.ids(distinct.take(pa.array(lead)).to_pylist())
        whole_at = np.flatnonzero(whole)
        whole_made = self.ids(values.take(pa.array(whole_at)).to_pylist())
        # one table of id runs: spaced pieces, leading pieces, whole texts
        n = len(distinct)
        tail = [np.array(x, np.uint32) for x in [*lead_made, *whole_made]]
        table = np.concatenate([spaced_ids, *tail]) if tail else spaced_ids
        run_end = np.concatenate([spaced_ends[1:], spaced_ends[-1] + np.cumsum([len(x) for x in tail], dtype=np.int64)]).astype(np.int64)
        run_start = np.concatenate([[0], run_end[:-1]])
        run = codes.astype(np.int64).copy()
        lead_of = np.zeros(n, np.int64)
        lead_of[lead] = n + np.arange(len(lead))
        run[first] = lead_of[codes[first]]
        keep = takes.copy()
        begins = ends[:-1][whole]
        keep[begins] = True
        run[begins] = n + len(lead) + np.arange(len(begins))
        owner = texts_of[keep]
        out, length = _gathered(table, run_start, run_end, run[keep])
        return out, np.cumsum(np.bincount(owner, weights=length, minlength=len(values)).astype(np.int64))

    def _spaced(self, distinct: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + piece for the used pieces (none for others), and their ends, by code."""
        picked = distinct.take(pa.array(used))
        parts = pc.extract_regex(picked, _LETTERS_AND_MARKS)
        plain = parts.is_valid()
        stems = pc.if_else(plain, parts.field(0), picked).dictionary_encode()
        marks = pc.if_else(plain, parts.field(1), "").dictionary_encode()
        stem_ids, stem_ends = self._stems(stems.dictionary)
        mark_made = [np.array(x, np.uint32) for x in self.ids(marks.dictionary.to_pylist())]
        table = np.concatenate([stem_ids, *mark_made])
        run_end = np.concatenate([stem_ends[1:], stem_ends[-1] + np.cumsum([len(x) for x in mark_made], dtype=np.int64)]).astype(np.int64)
        # each piece is its letters, then its marks
        runs = np.stack([stems.indices.to_numpy().astype(np.int64), marks.indices.to_numpy().astype(np.int64) + len(stem_ends) - 1], axis=1).ravel()
        out, length = _gathered(table, np.concatenate([[0], run_end[:-1]]), run_end, runs)
        counts = np.zeros(len(distinct), np.int64)
        counts[used] = length.reshape(-1, 2).sum(axis=1)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def _stems(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + piece for all pieces, and their ends."""
        n, size = len(distinct), len(self.known)
        found = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        pieces = distinct.take(pa.array(new)).to_pylist()
        packs = [" " + " ".join(pieces[i : i + PACK]) for i in range(0, len(pieces), PACK)]
        made = [np.array(x, np.uint32) for i in range(0, len(packs), 16) for x in self.ids(packs[i : i + 16])]
        ids = np.concatenate(made) if made else np.zeros(0, np.uint32)
        begins = np.flatnonzero(self.spaced[ids])
        assert len(begins) == len(new)
        table = np.concatenate([self.known_ids, ids])
        run_end = np.concatenate([self.known_ends[1:], np.append(begins[1:], len(ids))[: len(new)] + len(self.known_ids)])
        run_start = np.concatenate([self.known_ends[:-1], begins + len(self.known_ids)])
        runs = found.copy()
        runs[new] = size + np.arange(len(new))
        out, length = _gathered(table, run_start, run_end, runs)
        room = min(len(new), REMEMBERED - size)
        if room > 0:
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(new[:room])).cast(pa.string())])
            self.known_ends = np.concatenate([self.known_ends, run_end[size : size + room]])
            self.known_ids = table[: self.known_ends[-1]]
        return out, np.concatenate([[0], np.cumsum(length)]) if n else np.zeros(1, np.int64)


def _gathered(table: np.ndarray, start: np.ndarray, end: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of the table one after the other, the length of each)."""
    length = (end - start)[runs]
    total = np.cumsum(length)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start[runs] - (total - length), length)
    return table[at], length


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _boundary(text: str, a: int, b: int, left: set, right: set) -> int:
    """The last character after a and before b where both encodings part and pre-tokens always do; -1 if none.

    Encodings that trim offsets say that a token begins behind its space.
    """
    at = text.rfind(" ", a + 1, b - 1)
    while at > a:
        if not text[at - 1].isspace() and not text[at + 1].isspace() and all(at in x or at + 1 in x for x in (left, right)):
            return at
        at = text.rfind(" ", a + 1, at)
    return -1


def resynchronised(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of one text from overlapping chunks."""
    out, start, since, size = [], 0, 0, chunk
    ids, at = enc.offsets(text[:size])
    while start + size < len(text):
        end, width = start + size, overlap
        while end - width > start:
            begin = end - width
            next_ids, next_at = enc.offsets(text[begin : begin + chunk])
            next_at = next_at + begin
            cut = _boundary(text, max(begin, since), min(end, begin + chunk), set(at.tolist()), set(next_at.tolist()))
            if cut > 0:
                out.append(ids[(at >= since) & (at < cut)])
                ids, at, start, since, size = next_ids, next_at, begin, cut, chunk
                break
            width *= 2
        else:
            # no common boundary: encode a longer chunk from the same start
            size *= 2
            ids, at = enc.offsets(text[start : start + size])
            at = at + start
    out.append(ids[at >= since])
    return np.concatenate(out)


def encoded(enc: Encoder, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ends of each): huge ones in chunks, others whole."""
    long = pc.greater(pc.utf8_length(values), HUGE).to_numpy(zero_copy_only=False)
    if not long.any():
        return enc.encode(values)
    ids, ends = enc.encode(pc.if_else(pa.array(long), "", values))
    parts, begin = [], 0
    counts = np.diff(np.concatenate([[0], ends]))
    for i in np.flatnonzero(long):
        parts.append(ids[begin : ends[i]])
        own = resynchronised(enc, values[int(i)].as_py())
        parts.append(own)
        counts[i], begin = len(own), ends[i]
    return np.concatenate([*parts, ids[begin:]]), np.cumsum(counts)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit of every document."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in slices(batches, limit=8 << 20):
            values = texts(part)
            counts = np.diff(encoded(enc, values)[1], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.binary_length(values).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
