"""Token ids of whole texts by the tokenizers library, which encodes each distinct part once."""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from factloom.llm.common import give_back, holds

OTHER, LETTER, MARK, NEWLINE, SPACE = range(5)
#: The class of every byte. Letters beyond ASCII are two bytes and found by _classes(); the apostrophe, with which contractions begin, is no mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
_CLASS[ord("\n")], _CLASS[ord(" ")] = NEWLINE, SPACE
#: At so many parts or ids the memory keeps only those that came up again; forgetting costs only time. Longer parts are not kept.
MOST_PARTS, MOST_IDS, LONGEST_KEPT = 500_000, 4_000_000, 64
#: Bytes of texts that are cut at once, one text at least: the masks and places of a cut take some 15 times as many.
BYTES_AT_ONCE = 1 << 20
#: Words that are handed to the library as one text.
WORDS_AT_ONCE = 1000
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text: the letters of Latin-1 count as letters, all else beyond ASCII as other."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    tail = raw[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]  # the signs of multiplication and division
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    return kind


class Encoder:
    """Encodes texts exactly as the library does, with less work.

    An edge is ASCII that is neither white space nor a control character, or a
    letter of Latin-1. A text can be cut before a single space between two edges:
    neither tokenizer's splitting pattern or normaliser reaches over it. Such a
    chunk is cut further wherever letters, marks and newlines change, if it holds
    nothing else and its newlines stand by themselves between edges: there each
    of the vocabularies begins a new token, whatever stands further off. Other
    chunks are encoded whole, and so are texts that may hold a special token. The
    cuts are found for all bytes of a batch at once; each distinct part is then
    encoded once, and the ids of all parts are gathered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Whether letters lose their case, and parts a leading space, before they are looked up: then fewer differ.
        self.caseless = "Lowercase" in str(self.tokenizer.normalizer)
        self.spaceless = all(self.whole(f" {x}") == self.whole(x) for x in ("a", "É", ".", "#|", "-a"))
        #: Ids that begin a word with its space, or end one: they tell the words of a joined text apart.
        self.marks = np.array([t.endswith("</w>") if self.spaceless else t.startswith("Ġ") for t in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))])
        self.forget()

    def forget(self) -> None:
        """Empties the memory: known[part] is the row of starts and counts that says where flat has its ids; hit says whether it came up again."""
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.counts, self.hit = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.rows = self.used = 0

    def _shrink(self) -> None:
        """Keeps only the parts that came up again since the last time, unless they are too many as well."""
        kept = [(part, row) for part, row in self.known.items() if self.hit[row]]
        rows = np.array([row for _, row in kept], np.int64)
        starts, counts, flat = self.starts[rows], self.counts[rows], self.flat
        self.forget()
        if len(kept) <= MOST_PARTS // 2 and counts.sum() <= MOST_IDS // 2:
            ends = np.cumsum(counts)
            self._add([part for part, _ in kept], flat[np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())], counts)

    def whole(self, text: str) -> bytes:
        """The library's ids of one text, uncut, as little-endian unsigned 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """As whole(), by parts; null is the empty text."""
        return self.encode_batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, and where the ids of each of them end. A few texts are cut at a time, see BYTES_AT_ONCE."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        size = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        ids, ends, first, total = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0, 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, size[first] + BYTES_AT_ONCE, side="right")) - 1)
            some, at = self._encode_some(texts.slice(first, last - first))
            ids.append(some)
            ends.append(at + total)
            first, total = last, total + len(some)
        return np.concatenate(ids), np.concatenate(ends)

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_batch() of texts that are cut at once."""
        if len(self.known) >= MOST_PARTS or self.used >= MOST_IDS:
            self._shrink()
        size = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[size[0] : size[-1]]
        bounds = size - size[0]
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        parts, firsts = self._cut(raw, bounds)
        coded = parts.dictionary_encode()
        row = self._rows_of(coded.dictionary)[coded.indices.to_numpy()]
        count = self.counts[row]
        ends = np.cumsum(count)
        at = np.repeat(self.starts[row] - (ends - count), count)
        at += np.arange(len(at))
        return self.flat[at], np.r_[0, ends][firsts[1:]]

    def _cut(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The parts of the texts between bounds, and the number of parts before each bound."""
        n = len(raw)
        kind = _classes(raw)
        edge = (kind == LETTER) | ((raw >= 0x21) & (raw <= 0x7E))
        inside = np.ones(n, bool)  # between two bytes of the same text, both of them edges
        inside[0] = inside[-1] = False
        inside[1:] &= edge[:-1]
        inside[:-1] &= edge[1:]
        some = np.flatnonzero(np.diff(bounds))
        inside[bounds[some]] = inside[bounds[some + 1] - 1] = False
        gap = inside & (kind == SPACE)
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        odd = (kind == OTHER) | (((kind == SPACE) | (kind == NEWLINE)) & ~inside)
        for doc in np.unique(np.searchsorted(bounds, special, side="right") - 1):
            gap[bounds[doc] : bounds[doc + 1]] = False
            odd[bounds[doc]] = True
        begins = gap.copy()
        begins[bounds[some]] = True
        chunk = np.flatnonzero(begins)
        plain = np.repeat(~np.logical_or.reduceat(odd, chunk), np.diff(np.r_[chunk, n]))
        begins[1:] |= plain[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        starts = np.flatnonzero(begins)
        firsts = np.searchsorted(starts, bounds)
        if self.caseless:
            lower = plain & (((raw >= 0x41) & (raw <= 0x5A)) | ((raw >= 0x80) & (raw <= 0x9E)))  # second bytes of À to Þ, without the sign
            raw = raw + (lower.astype(np.uint8) << np.uint8(5))
        if self.spaceless:
            keep = ~(gap & plain)
            raw = raw[keep]
            starts = (np.cumsum(keep) - keep)[starts]
        ends = np.r_[starts, len(raw)].astype(np.int32 if len(raw) < 2**31 else np.int64)
        kind_of = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
        return pa.Array.from_buffers(kind_of, len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]), firsts

    def _rows_of(self, parts: pa.Array) -> np.ndarray:
        """The row of each of the distinct parts; new ones are encoded and added."""
        kind = np.int32 if parts.type == pa.binary() else np.int64
        at = np.frombuffer(parts.buffers()[1], kind, len(parts) + 1, parts.offset * np.dtype(kind).itemsize)
        raw = parts.buffers()[2].to_pybytes()
        held = [raw[a:b] for a, b in pairwise(at.tolist())]
        rows = np.fromiter(map(self.known.get, held, [-1] * len(held)), np.int64, len(held))
        old = rows >= 0
        self.hit[rows[old]] = True
        new = np.flatnonzero(~old)
        if len(new):
            fresh = [held[k] for k in new.tolist()]
            wanted = not self.spaceless
            words = [k for k, part in enumerate(fresh) if (part[:1] == b" ") == wanted and _WORD.fullmatch(part)]
            rows[new[words]] = self._learn_words([fresh[k] for k in words])
            rest = np.setdiff1d(np.arange(len(new)), words)
            rows[new[rest]] = self._learn([fresh[k] for k in rest.tolist()])
        return rows

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts in a row, and their number for each."""
        ids, counts = [np.empty(0, np.uint32)], []
        for coded in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False):
            ids.append(np.array(coded.ids, np.uint32))
            counts.append(len(ids[-1]))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _learn(self, parts: list[bytes]) -> np.ndarray:
        return self._add(parts, *self._ids(parts))

    def _learn_words(self, words: list[bytes]) -> np.ndarray:
        """As _learn(), for words that are tokenised alike with others beside them: many as one text."""
        glue = b" " if self.spaceless else b""
        some = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        ids, _ = self._ids([glue.join(s) for s in some])
        ends = np.flatnonzero(self.marks[ids])
        if len(ends) != len(words):
            return self._learn(words)
        bounds = np.r_[0, ends + 1] if self.spaceless else np.r_[ends, len(ids)]
        return self._add(words, ids, np.diff(bounds))

    def _add(self, parts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds parts to the memory; the rows that they get."""
        total, rows = len(ids), self.rows + len(parts)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), total), np.uint32)])
        if rows > len(self.starts):
            more = max(len(self.starts), rows - len(self.starts))
            self.starts, self.counts, self.hit = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.counts, self.hit))
        self.flat[self.used : self.used + total] = ids
        self.counts[self.rows : rows] = counts
        self.starts[self.rows : rows] = self.used + np.cumsum(counts) - counts
        own = range(self.rows, rows)
        self.known.update((part, row) for part, row in zip(parts, own, strict=True) if len(part) <= LONGEST_KEPT)
        self.rows, self.used = rows, self.used + total
        return np.array(own, np.int64)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """encode_batch()'s result with end_id behind each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


@cache
def _load(name: str) -> Encoder:
    import public_tokenizers

    made = Encoder(public_tokenizers.path(name))
    give_back()  # reading the vocabulary takes twice what it leaves
    return made


def encoder(name: str) -> Encoder:
    """The encoder of a public vocabulary file, loaded once per worker process."""
    holds("encoders", _load.cache_clear)
    return _load(name)
