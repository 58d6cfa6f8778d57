"""Words of whole texts as numpy arrays: positions and 64-bit hashes, straight from Arrow's buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators [\x09-\x0D\x20].
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

#: Separators: every ASCII character that is neither a letter nor a digit.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps: those of texts of up to so many bytes.
KEPT = 1 << 20
_kept: list[tuple[np.ndarray, np.ndarray]] = []


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` bytes at least."""
    if n > KEPT:
        return _powers(n)
    if not _kept or len(_kept[0][0]) < n:
        _kept[:] = [_powers(min(KEPT, 1 << max(16, n.bit_length())))]
    return _kept[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """``doc``: row of each word; ``start``, ``end``: its bytes in ``data``; ``offsets``: where each row's text lies in ``data``."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    total: np.ndarray

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words that have as many, and which words those are."""
        at = np.flatnonzero(self.end - self.start >= n)
        start = self.start[at]
        return mix((self.total[start + n] - self.total[start]) * _scale(len(self.data))[1][start]), at

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows in them; nulls are empty."""
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, where, held = values.buffers()
    offsets = np.frombuffer(where, dtype=kind, count=len(values) + 1, offset=values.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def tokenize(values: pa.Array, separators: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of bytes that aren't separators, A-Z lower-cased if ``fold``, each with a hash of its bytes.

    The hash is a polynomial modulo 2**64 taken from one running sum over all bytes, then mixed."""
    raw, offsets = text_bytes(values)
    empty = np.zeros(0, dtype=np.int64)
    if not len(raw):
        return Words(empty, empty, empty, empty.astype(np.uint64), raw, offsets, np.zeros(1, dtype=np.uint64))
    data = LOWER[raw] if fold else raw
    inside = ~separators[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _scale(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, value, data, offsets, total)


def hash_words(text: str, separators: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, in order."""
    return tokenize(pa.array([text], type=pa.string()), separators).hash


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, doc: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at positions ``mask`` of every window, and the first word of each window that lies in one row."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.full(n, len(mask), dtype=np.uint64)
    for k, at in enumerate(mask):
        total += hashes[at : at + n] * _MULTIPLIERS[k]
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    return mix(total[at]), at
