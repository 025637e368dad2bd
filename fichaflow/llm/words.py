"""Words, word hashes and rolling window hashes of whole text batches, as numpy arrays."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# the functions below travel with the job: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that are no part of a word: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
#: Bytes of text that are hashed at once; a longer single text is hashed alone.
CHUNK_BYTES = 3_000_000

#: Bytes of a word that are hashed in steps of eight.
LONG_WORD = 64

_WORD_BASE = 0xD6E8FEB86659FD93
_CHAIN, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


class Words:
    """Words of a batch of texts.

    data: the UTF-8 bytes of all texts; start, end: byte range of each word; first: per text the number of its
    first word, and the total at the end; text: byte offset of each text, and the total at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.text = at - at[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            raw = table[raw]
        self.data = raw
        table = np.ones(256, bool)
        table[list(SPACE_BYTES)] = False
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = table[raw]
        begin = inside[:-1].copy()
        begin[1:] &= ~inside[:-2]
        stop = inside[:-1] & ~inside[1:]
        edges = self.text[1:-1]  # a text's first byte begins a word, its last one ends one, whatever is beside it
        edges = edges[(edges > 0) & (edges < len(raw))]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.text)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word. Different words of one length of up to eight bytes never share one.

        Eight bytes at a time are chained into it; words above LONG_WORD bytes take a digest of their bytes.
        """
        if self._hashes is None:
            size = self.end - self.start
            # all eight-byte stretches of the data, at any offset
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
            held = np.zeros(len(self), np.uint64)
            todo, at = np.arange(len(self)), 0
            while len(todo):
                left = size[todo] - at
                chunk = eight[self.start[todo] + at] & _KEEP[np.minimum(left, 8)]
                held[todo] = mix(held[todo] ^ chunk ^ (np.uint64(0) if at == 0 else _CHAIN))
                at += 8
                todo = todo[left > 8] if at < LONG_WORD else todo[:0]
            held = mix(held + _SIZE * size.astype(np.uint64))
            for k in np.flatnonzero(size > LONG_WORD):
                word = self.data[self.start[k]:self.end[k]].tobytes()
                held[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            self._hashes = held
        return self._hashes

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hash of each window of so many words, and the number of its first word; none crosses texts."""
        h, n = self.hashes(), len(self)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers(_WORD_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        rolled = mix((total[size:] - total[:-size]) * down[:n - size + 1])
        whole = np.repeat(self.first[1:], self.counts)[:n - size + 1] >= np.arange(size, n + 1)
        at = np.flatnonzero(whole)
        return rolled[at], at

    def sequence(self, k: int) -> np.uint64:
        """Hash of all words of text k as one sequence."""
        h = self.hashes()[self.first[k]:self.first[k + 1]]
        up, _ = powers(_WORD_BASE, len(h) + 1)
        return mix(np.array([np.sum(h * up[:len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    begin, held = 0, 0
    for i, size in enumerate(lengths.to_pylist()):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)
