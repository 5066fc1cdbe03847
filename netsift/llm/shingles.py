"""Word shingles and MinHash bands of texts, vectorised over Arrow batches.

Words are those of ``common.words``: runs of 0-9, a-z (A-Z lower-cased) and
non-ASCII bytes. A word's 64-bit hash is a polynomial of random byte values, a
shingle's is a mix of the hashes of ``k`` consecutive words; a text of fewer
words, but not none, has one shingle of all its words. Texts are hashed in pieces
of bounded size, so memory doesn't follow the length of the longest text by more
than its word hashes; a word that goes on over pieces is one word, of any length.
"""

from __future__ import annotations

import numpy as np

K = 5
PIECE = 1 << 17  # bytes hashed at once

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 5


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW, _INV = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 2**64), PIECE)
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial) of the words, or their parts, in at most PIECE bytes."""
    edge = np.diff(np.concatenate([[False], _IS_WORD[b], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _POW[:len(b)], dtype=np.uint64)])
    return start, end, (total[end] - total[start]) * _INV[start]


def word_hashes(data: bytes | memoryview) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    b = np.frombuffer(data, np.uint8)
    out, begun, length, power = [], np.zeros(1, np.uint64), 0, np.ones(1, np.uint64)  # the word that a piece ended in
    for at in range(0, len(b), PIECE):
        piece = b[at:at + PIECE]
        start, end, sums = _piece_sums(piece)
        sizes = (end - start).astype(np.uint64)
        if length and not (len(start) and start[0] == 0):  # it had just ended
            out.append(mix(begun + np.uint64(length)))
            length = 0
        if length:  # its next part
            sums[:1], sizes[:1] = begun + sums[:1] * power, sizes[:1] + np.uint64(length)
        if len(end) and end[-1] == len(piece) and at + PIECE < len(b):
            goes_on = len(end) == 1 and length > 0
            power = (power if goes_on else np.ones(1, np.uint64)) * _POW[end[-1] - start[-1]]
            begun, length = sums[-1:], int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        else:
            length = 0
        out.append(mix(sums + sizes))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of a text with these word hashes."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _MULT[j] + words[j:j + n]
    return np.unique(mix(h + np.uint64(k)))


def texts_of(column) -> list:
    """The UTF-8 bytes of an Arrow string column, None for nulls, without copies."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        return [t for c in column.chunks for t in texts_of(c)]
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [view[a:b] if ok else None for a, b, ok in zip(offs[:-1].tolist(), offs[1:].tolist(), valid.tolist())]


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` MinHash values with which a pair at the threshold
    meets in at least one band with probability ``recall`` or more."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


class MinHasher:
    """Band hashes of shingle sets: ``bands`` keys of ``rows`` minima each."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.x = rng.integers(1, 2**63, (bands * rows, 1), dtype=np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; the band's number is part of it."""
        low = np.full(self.bands * self.rows, np.uint64(2**64 - 1))
        for at in range(0, len(s), 4096):
            low = np.minimum(low, ((s[None, at:at + 4096] ^ self.x) * self.a).min(axis=1))
        low = mix(low).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * _MULT[60] + low[:, j])
        return key.view(np.int64)
