"""Vectorised word handling over Arrow string columns, used inside tasks.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``. All hashes are over the
UTF-8 bytes, so no text is decoded. A text's words never run into the next's.

A word's hash takes eight bytes at a time through a bijective mixer, starting from
its length; words of a kilobyte and more have a BLAKE2 hash. No sum or polynomial is
taken, so no arrangement of letters gives equal hashes other than by chance. Where a
result rests on words being equal, ``same`` compares their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Pairs of odd multipliers, one pair for each family of gram hashes.
_TIMES = [(U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)), (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)), (U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3))]
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The bytes as 64-bit integers, with room to load eight bytes from every place."""
    out = np.zeros(len(data) // 8 + 2, U64)
    out.view(np.uint8)[: len(data)] = data
    return out


def load(wide: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on as an integer; ``size`` above 8 counts as 8."""
    i, shift = at >> 3, ((at & 7) << 3).astype(U64)
    return ((wide[i] >> shift) | (wide[i + 1] << (U64(64) - shift))) & _MASK[np.minimum(size, 8)]


def run_hash(data: np.ndarray, wide: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run of bytes [first, last)."""
    size = last - first
    h = mix(size.astype(U64) + U64(seed << 40) + U64(0x5851F42D4C957F2D))
    h = mix(h ^ load(wide, first, size))
    more, step = np.flatnonzero((size > 8) & (size < LONG)), 8
    while len(more):
        h[more] = mix(h[more] ^ load(wide, first[more] + step, size[more] - step))
        step += 8
        more = more[size[more] > step]
    for i in np.flatnonzero(size >= LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]], digest_size=8, salt=seed.to_bytes(2, "little")).digest(), "little")
    return h


def same(a: np.ndarray, a_first: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_size: np.ndarray, a_data: np.ndarray, b_data: np.ndarray) -> np.ndarray:
    """Whether the runs of bytes of two tables (``eights``) are equal, one by one."""
    out = a_size == b_size
    left, step = np.flatnonzero(out & (a_size < LONG)), 0
    while len(left):
        size = a_size[left] - step
        good = load(a, a_first[left] + step, size) == load(b, b_first[left] + step, size)
        out[left[~good]] = False
        step += 8
        left = left[good & (size > 8)]
    for i in np.flatnonzero(out & (a_size >= LONG)):
        out[i] = np.array_equal(a_data[a_first[i] : a_first[i] + a_size[i]], b_data[b_first[i] : b_first[i] + b_size[i]])
    return out


@dataclass
class Words:
    """The words of several texts: their bytes (also as ``eights``), first and last byte + 1, number of the text, hash."""

    data: np.ndarray
    wide: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    @cached_property
    def size(self) -> np.ndarray:
        return self.last - self.first

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each; one row at least."""
    _, at = text_bytes(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of the texts; ``lower`` turns A-Z into a-z before hashing."""
    data, at = text_bytes(texts)
    n_docs, n = len(at) - 1, len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, eights(data), none, none, none, np.zeros(0, U64), n_docs)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= edge[:n]
    first = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= edge[1:]
    last = np.flatnonzero(inside & after) + 1
    doc = np.searchsorted(at, first, "right") - 1
    wide = eights(data)
    return Words(data, wide, first, last, doc, run_hash(data, wide, first, last), n_docs)


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word: equal exactly where the words' bytes are."""
    _, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
    rep, size = at[number], w.last - w.first
    odd = np.flatnonzero(~same(w.wide, w.first, size, w.wide, w.first[rep], size[rep], w.data, w.data))
    known: dict[bytes, int] = {}
    for i in odd:  # equal hashes of different words
        number[i] = known.setdefault(w.data[w.first[i] : w.last[i]].tobytes(), len(at) + len(known))
    return number


def grams(w: Words, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; only good where all k lie in one text."""
    n, (p, q) = len(w.hash), _TIMES[which]
    if n < k:
        return np.zeros(0, U64)
    out, held, power, size = None, 0, w.hash, 1  # hashes of ``held`` and of ``size`` words
    while True:
        if k & size:
            out = power if out is None else mix(out[: n - held - size + 1] * p + power[held : n - size + 1] * q)
            held += size
            if held == k:
                return out[: n - k + 1] if k > 1 else mix(out * p)
        power = mix(power[: n - 2 * size + 1] * p + power[size : n - size + 1] * q)
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(h) < width:
        return h[:0]
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h
