"""Ids of many texts at once: a table from pre-tokens to ids, in flat arrays.

The bytes of a batch of texts are cut into pre-tokens by character class and each
is looked up by its own bytes: the first and the last eight and the length name a
pre-token of up to 16 bytes exactly. What the table doesn't have (new or longer
pre-tokens) is encoded by the library once, kept, and put in the table.

Only texts that ``eligible`` accepts go this way: printable ASCII and Latin
letters without apostrophes, for which the tokenizer's pattern is the same as
runs of letters, single digits and runs of anything else but blanks.
"""

from __future__ import annotations

import array
import re

import numpy as np

from netsift.llm.pretokens import Pretokens
from netsift.llm.shingles import mix

_ODD = re.compile(r"[^\t\n\r -&(-~ªµºÀ-ÖØ-öø-įı-ſ]")
_BLANK, _LETTER, _DIGIT, _REST = range(4)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
SLOT_BITS, MOST, MOST_IDS = 21, 1_200_000, 1 << 24
_SLOT = np.uint64((1 << SLOT_BITS) - 1)
_LOW = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)


def eligible(text: str, pre: Pretokens) -> bool:
    if pre.pattern is None or any(s in text for s in pre.special):
        return False
    if text.isascii() and text.replace("\n", " ").isprintable():
        return "'" not in text
    return _ODD.search(text) is None


class Table:
    """Ids of pre-tokens; emptied when it has ``MOST`` of them or ``MOST_IDS`` ids (only time is lost)."""

    def __init__(self, pre: Pretokens):
        self.pre = pre
        self.clear()

    def clear(self) -> None:
        # A slot: first and last bytes, place << 5 | length; a place is the pre-token's number, from 1 on.
        self.slots = np.zeros((1 << SLOT_BITS, 3), np.uint64)
        self.known: dict[bytes, int] = {}  # those that have no slot
        self.ids, self.ends, self.n = array.array("I"), array.array("q", [0]), 0  # place p: ids from ends[p - 1] to ends[p]

    def _add(self, word: bytes) -> int:
        """The place of the ids of a pre-token that isn't known yet."""
        self.ids.extend(self.pre.ids(word.decode()))
        self.ends.append(len(self.ids))
        self.n += 1
        return self.n

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of lower-cased UTF-8 texts."""
        if self.n > MOST or len(self.ids) > MOST_IDS:
            self.clear()
        buf = b"\n".join(texts) + b"\n" + bytes(16)
        b = np.frombuffer(buf, np.uint8)
        kind = _CLASS[b[:-16]]
        cut = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _DIGIT
        at = np.flatnonzero(cut)
        size = np.diff(at, append=len(kind))
        word = kind[at] != _BLANK
        at, size = at[word], size[word]
        eight = np.ndarray((len(b) - 7,), "<u8", buf, strides=(1,))
        first = eight[at] & _LOW[np.minimum(size, 8)]
        last = np.where(size > 8, eight[np.maximum(at + size - 8, 0)], np.uint64(0))
        name = mix(first + last * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        place = np.zeros(len(at), np.int64)  # 0: not known
        todo = np.flatnonzero(size <= 16)
        ways = [(name & _SLOT).astype(np.int64), ((name >> np.uint64(32)) & _SLOT).astype(np.int64)]
        for way in ways:
            slot = self.slots[way[todo]]
            held = slot[:, 2].astype(np.int64)
            hit = (slot[:, 0] == first[todo]) & (slot[:, 1] == last[todo]) & (held & 31 == size[todo])
            place[todo[hit]] = held[hit] >> 5
            todo = todo[~hit]
        new = np.flatnonzero(place == 0)
        fresh, seen = [], {}
        for i, a, n in zip(new.tolist(), at[new].tolist(), size[new].tolist()):
            w = buf[a:a + n]
            found = seen.get(w) or self.known.get(w)
            if found is None:
                found = seen[w] = self._add(w)
                if n <= 16:
                    fresh.append(i)
                else:
                    self.known[w] = found
            place[i] = found
        # A new pre-token takes the first of its two slots that is free.
        for way in ways:
            slot = way[fresh]
            free = self.slots[slot, 2] == 0
            take = np.array(fresh, np.int64)[free]
            self.slots[slot[free]] = np.stack([first[take], last[take], (place[take] << 5 | size[take]).astype(np.uint64)], axis=1)
            fresh = np.array(fresh, np.int64)[~free].tolist()
        for i in fresh:
            self.known[buf[at[i]:at[i] + size[i]]] = int(place[i])
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[place - 1]
        count = ends[place] - start
        end = np.cumsum(count)
        ids = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        out = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - count), count)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
        before = np.searchsorted(at, np.append(begins, len(kind)))
        total = np.concatenate([[0], end])
        return out, total[before[1:]] - total[before[:-1]]
