"""Vectorised text helpers that run inside tasks on Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters that count as white space between words.
SPACE = r"[\x20\x09-\x0D]"


_KEPT = 250_000  # pieces that a tokenizer may keep from task to task


def frugal(run: Callable) -> Callable:
    """run over batches, and at its end the worker's free memory given back to the system: idle workers stay beside later stages."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch], *rest, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, *rest, **named)
        finally:
            for known in _KNOWN.values():
                known.keep(_KEPT)
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most max_bytes of a text column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, base + max_bytes, side="right")), at + 1), at + max_rows)
            yield batch.slice(at, to - at)
            at = to


def filled(column: pa.Array) -> pa.Array:
    """The column as large strings, nulls as empty texts, in memory of its own (some kernels misread slices)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    moved = column.offset or len(column) and np.frombuffer(column.buffers()[1], np.int64, 1)[0]
    return column.take(pa.array(np.arange(len(column)))) if moved else column


def split_words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all rows, and the n+1 row offsets into them."""
    column = filled(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


def word_hashes(words: pa.Array, strip: str = "") -> np.ndarray:
    """64-bit hash of each word, without the characters of strip at its ends; each distinct word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    distinct = [w.strip(strip) for w in distinct] if strip else distinct
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return own[coded.indices.to_numpy()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on, or of fewer where the row (ending at ends) is over."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    place = np.arange(n)
    factor = np.uint64(1)
    for j in range(k):
        here = place + j < ends
        rolled = np.zeros(n, np.uint64)
        rolled[: max(n - j, 0)] = hashes[j:]
        total += np.where(here, mix64(rolled + np.uint64(j + 1)) * factor, np.uint64(0))
        factor = factor * np.uint64(0x9E3779B97F4A7C15) if j == 0 else np.uint64((int(factor) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return mix64(total + np.minimum(ends - place, k).astype(np.uint64))


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row (lower-cased A-Z); the whole sequence when shorter."""
    words, offsets = split_words(column, lower=True)
    with np.errstate(over="ignore"):
        ends = np.repeat(offsets[1:], np.diff(offsets))
        hashes = window_hashes(word_hashes(words), ends, k)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(np.unique(hashes[a : max(b - k + 1, a + 1)]) if b > a else hashes[:0])
    return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where visible, else from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b if b in visible else 256 + rest.index(b)) for b in range(256)}


class WordTokenizer:
    """Encodes texts with a tokenizers file, each distinct piece once.

    ``spaced`` tells how words join: False where the tokenizer drops white
    space, True for byte-level files where a word keeps the one space before
    it.  A text is cut only at places that every match of the tokenizer's
    split pattern respects, so the ids are those of the whole text: before a
    space or line feed after a character that isn't white space, after such a
    line feed, and between a letter and a full stop or comma.  Pieces of letters
    go straight to the model, others through the whole tokenizer.  The memory of
    known pieces is bounded by max_words.
    """

    _BYTES = _byte_letters()

    def __init__(self, path: str, spaced: bool, max_words: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.spaced, self.max_words = Tokenizer.from_file(path), spaced, max_words
        self.model = self.tok.model
        #: Strings that the tokenizers library reads as tokens of their own, wherever they stand.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # in bytes
        self.used = self.n = 0

    def keep(self, most: int) -> None:
        """Forget all but the pieces learnt first, among which are the frequent ones."""
        if self.n > most:
            self.places = dict(islice(self.places.items(), most))
            self.ends = self.ends[: most + 1].copy()
            self.n, self.used = most, int(self.ends[most]) // 4
            self.flat = self.flat[: self.used + 1].copy()

    def _letters(self, piece: str) -> str | None:
        """The model's form of a piece that is one word of letters."""
        if self.spaced:
            bare = piece[1:] if piece[:1] == " " else piece
            if not bare.isalpha():
                return None
        else:
            if not piece.isalpha() or not piece.isascii() and (max(piece) >= "\u0250" or "\u0130" in piece):
                return None
            piece = piece.lower()
        return piece.encode().decode("latin-1").translate(self._BYTES)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 1 << 14):
            self._learn_some(words[at : at + (1 << 14)])

    def _learn_some(self, words: list[str]) -> None:
        tokenize, rest, known, ids = self.model.tokenize, [], [], []
        for w in words:
            form = self._letters(w)
            if form is None:
                rest.append(w)
            else:
                known.append(w)
                ids.append([t.id for t in tokenize(form)])
        for at in range(0, len(rest), 2048):
            ids += [e.ids for e in self.tok.encode_batch_fast(rest[at : at + 2048], add_special_tokens=False)]
        known += rest
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = int(sizes.sum())
        while self.n + len(known) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while self.used + new > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + new] = np.fromiter(chain.from_iterable(ids), np.uint32, new)
        self.ends[self.n + 1 : self.n + 1 + len(known)] = 4 * (self.used + np.cumsum(sizes))
        self.places.update(zip(known, range(self.n, self.n + len(known)), strict=True))
        self.used, self.n = self.used + new, self.n + len(known)

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        column = filled(column)
        if not self.spaced:
            column = pc.if_else(pc.string_is_ascii(column), pc.ascii_lower(column), column)
            return split_words(pc.replace_substring_regex(column, r"([A-Za-z])([.,])", r"\1 \2"))
        odd = np.flatnonzero(pc.match_substring_regex(column, r"\s\s|\x00|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False))
        marked = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, r"([A-Za-z])([.,])", "\\1\0\\2"), "\0")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        words, offsets = flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets]
        if not len(odd):
            return words, offsets
        parts, own, at = [], [0], 0
        for i in odd:  # rows with runs of white space, or with rare kinds of it, are cut by the general rule
            parts.append(words.slice(offsets[at], offsets[i] - offsets[at]))
            own.extend(own[-1] + offsets[at + 1 : i + 1] - offsets[at])
            cut = self.cut_text(column[int(i)].as_py())
            parts.append(pa.array(cut, pa.large_string()))
            own.append(own[-1] + len(cut))
            at = i + 1
        parts.append(words.slice(offsets[at]))
        own.extend(own[-1] + offsets[at + 1 :] - offsets[at])
        return pa.concat_arrays(parts), np.array(own, np.int64)

    @staticmethod
    def cut_text(text: str) -> list[str]:
        """Pieces that begin at a space after a character that isn't white space."""
        at = [0, *(m.start() for m in re.finditer(r"(?<=\S) ", text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the n+1 row offsets into them; rows with special strings are encoded whole."""
        column = filled(column)
        whole = np.zeros(len(column), bool)
        for text in self.special:
            whole |= pc.match_substring(column, text, ignore_case=not self.spaced).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode(column)
        rows = np.flatnonzero(whole)
        ids, offsets = self._encode(pc.if_else(pa.array(whole), "", column))
        own = [e.ids for e in self.tok.encode_batch_fast(column.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
        sizes, lengths = np.diff(offsets), [len(x) for x in own]
        ids = np.insert(ids, np.repeat(offsets[rows], lengths), np.array([i for x in own for i in x], np.uint32))
        sizes[rows] = lengths
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, offsets = self._cut(column)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if self.n + len(own) > self.max_words or self.used > 8 * self.max_words:
            self.keep(self.max_words // 4)
            if self.used > 4 * self.max_words:
                self.clear()
        self._learn([w for w in own if w not in self.places])
        if not own:
            return np.zeros(0, np.uint32), offsets
        place = np.fromiter(map(self.places.__getitem__, own), np.int32, len(own))[coded.indices.to_numpy()]
        # the pieces' ids as binary values, which Arrow gathers with one copy each
        pieces = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.ends), pa.py_buffer(self.flat)])
        taken = pieces.take(pa.array(place))
        into = np.frombuffer(taken.buffers()[1], np.int64, len(place) + 1) // 4
        ids = np.frombuffer(taken.buffers()[2], np.uint32, into[-1]) if into[-1] else np.zeros(0, np.uint32)
        return ids, into[offsets]


_KNOWN: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """The worker's own tokenizer; it keeps its words from task to task."""
    if (path, spaced) not in _KNOWN:
        _KNOWN[path, spaced] = WordTokenizer(path, spaced)
    return _KNOWN[path, spaced]
