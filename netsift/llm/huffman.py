"""Canonical length-limited Huffman codes over token ids, vectorised."""

from __future__ import annotations

import numpy as np

#: Bits of the longest code, unless more symbols need one more.
LIMIT = 16
#: Tokens between two bit-offset checkpoints of a block.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by
    package-merge: symbols of the n-th cheapest 2n - 2 packages get a bit each."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    coin = counts[order].astype(np.float64)
    rounds, packages = [], np.zeros(0)
    for _ in range(limit):
        every = np.concatenate([coin, packages])
        at = np.argsort(every, kind="stable")
        rounds.append(at < n)  # which of the sorted entries are single symbols
        every = every[at]
        even = len(every) // 2 * 2
        packages = every[0:even:2] + every[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(rounds):
        mine = int(single[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of sorted ``symbols`` with these ``lengths``."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        symbols, lengths = np.asarray(symbols, np.int64), np.asarray(lengths, np.int64)
        self.symbols, self.lengths = symbols, lengths
        self.width = int(lengths.max()) if len(lengths) else 1
        order = np.lexsort((symbols, lengths))
        span = np.int64(1) << (self.width - lengths[order])  # how much of the code space each symbol takes
        start = np.concatenate([[0], np.cumsum(span)])
        top = int(symbols.max()) + 1 if len(symbols) else 1
        self.bits, self.code = np.zeros(top, np.uint8), np.zeros(top, np.uint64)
        self.bits[symbols] = lengths
        self.code[symbols[order]] = (start[:-1] >> (self.width - lengths[order])).astype(np.uint64)
        # One entry for each value of the next ``width`` bits.
        self.next_symbol = np.zeros(1 << self.width, np.uint32)
        self.next_bits = np.ones(1 << self.width, np.int64)
        self.next_symbol[:start[-1]] = np.repeat(symbols[order], span)
        self.next_bits[:start[-1]] = np.repeat(lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, bit offsets of every STRIDE-th token)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        length = self.bits[ids].astype(np.int64)
        end = np.cumsum(length)
        start = end - length
        word, room = start >> 6, 64 - (start & 63) - length
        code = self.code[ids]
        out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
        left = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(left, first)
        over = np.flatnonzero(room < 0)  # at most one token crosses into each word
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[:(int(end[-1]) + 7) // 8], start[::STRIDE]

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block: every checkpoint's run is decoded at once, a token
        of each per step, by table look-up of the next ``width`` bits."""
        if not n:
            return np.zeros(0, np.uint32)
        b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = np.array(checkpoints, np.int64)
        out = np.empty((STRIDE, len(at)), np.uint32)
        last = n - (len(at) - 1) * STRIDE
        mask, free = np.uint32((1 << self.width) - 1), 32 - self.width
        for step in range(min(STRIDE, n)):
            if step == last:  # the last run is shorter
                at = at[:-1]
            peek = (four[at >> 3] >> (free - (at & 7)).astype(np.uint32)) & mask
            out[step, :len(at)] = self.next_symbol[peek]
            at = at + self.next_bits[peek]
        return out.T.ravel()[:n]
