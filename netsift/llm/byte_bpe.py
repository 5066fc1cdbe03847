"""Byte-level BPE by a sentencepiece model that is written from the ranks.

The ranks (base64 bytes and a number a line) become a sentencepiece BPE model
of one piece for each rank: a piece's bytes are shown as one character each,
its score is the negative rank, and text is taken as it is (identity
normalisation, no prefix, blanks untouched). Merging the pair of the highest
score, leftmost first, is then what byte-level BPE does with the lowest rank,
and a piece's number is its rank. The model is serialised here, field by field;
nothing is trained.

Texts are cut into pre-tokens by the pattern, each is encoded by itself, and ids
are turned back into bytes by the inverse mapping of the pieces. A text's ids
travel packed, as little-endian unsigned 32-bit integers. Pre-tokens of at most
``KEPT_CHARS`` characters are remembered by the worker, at most ``KEPT`` of them;
long texts are cut and encoded ``BLOCK`` pre-tokens at a time, so a worker holds
one text, its packed ids and a block. A single pre-token is encoded as one.

Character classes are those of the tiktoken library: where the ``regex`` module
knows newer characters than it, they count as what the library takes them for.

Defined results: a null text counts as empty (no ids); repeated rows and null
ids are treated like any other row; special strings in texts are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import cached_property
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from netsift.llm.common import fresh, releasing

KEPT, KEPT_CHARS, BLOCK = 300_000, 48, 1 << 16
#: The pattern this module also has in a faster form, as it is published (a fixed value).
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Newer characters than the library's begin above this one in every class.
_SETTLED = re.compile("[^\x00-՗]")
#: A character of each class that can stand for another in the pattern, and the classes' patterns.
_STAND_IN = {r"\p{L}": "x", r"\p{N}": "0", r"\s": "\t", "": "¤"}
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


def shown_bytes() -> list[str]:
    """A character for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each rank, from 0 on."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(b) for b, n in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[n] for n in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(pieces: list[str]) -> bytes:
    """A serialised sentencepiece BPE model whose piece n has the score -n; the
    unknown piece that every model needs comes last."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + b"".join(_number(n, none) for n in (41, 42, 43))
    as_it_is = _bytes(1, b"identity") + b"".join(_number(n, 0) for n in (3, 4, 5))  # no prefix, blanks kept, not escaped
    return (b"".join(piece(p, -n, normal) for n, p in enumerate(pieces)) + piece("<unk>", 0, unknown)
            + _bytes(2, trainer) + _bytes(3, as_it_is))


class ByteBpe(dict):
    """Encoder and decoder; as a dict, the packed ids of the pre-tokens it remembers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.pattern, self.known = read_ranks(path), regex.compile(pattern), pattern == KNOWN_PATTERN
        chars = shown_bytes()
        self.shown = dict(enumerate(chars))  # for str.translate of latin-1 text
        pieces = ["".join(chars[b] for b in t) for t in self.ranks]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(pieces))
        byte = {c: b for b, c in enumerate(chars)}
        self.table = [bytes(byte[c] for c in self.model.id_to_piece(n)) for n in range(len(pieces))]
        if self.table != self.ranks:
            raise ValueError("pieces don't map back to the ranks")

    @staticmethod
    def load(path: str, pattern: str) -> "ByteBpe":
        """One for each worker process."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = ByteBpe(path, pattern)
        return _LOADED[path, pattern]

    def __missing__(self, word: str) -> bytes:
        ids = self.model.encode(word.encode().decode("latin-1").translate(self.shown))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = packed
        return packed

    @cached_property
    def unlike(self):
        """(a pattern of the characters the library has in another class, their stand-ins)."""
        import regex
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        blocks = ["".join(every[at:at + 4096]) for at in range(0, len(every), 4096)]
        theirs, ours = {}, {}
        for kind, char in _STAND_IN.items():
            if kind:
                library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
                mine = regex.compile(kind)
                for b in blocks:
                    theirs |= dict.fromkeys(bytes(library.encode_ordinary(b)).decode(), char)
                    ours |= dict.fromkeys(mine.findall(b), char)
        differ = {c: theirs.get(c, _STAND_IN[""]) for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}
        found = regex.compile("[" + "".join(map(regex.escape, sorted(differ))) + "]") if differ else None
        return found, str.maketrans(differ)

    def cut(self, text: str):
        """Lists of consecutive pre-tokens, BLOCK in each."""
        latin = self.known and not _BEYOND_LATIN.search(text)
        pattern = _LATIN if latin else self.pattern
        seen = text
        if not latin and _SETTLED.search(text):
            odd, to = self.unlike
            if odd and odd.search(text):
                seen = text.translate(to)
        if seen is text and len(text) <= BLOCK:
            yield pattern.findall(text)
            return
        found = pattern.finditer(seen)
        while block := [text[m.start():m.end()] for m in islice(found, BLOCK)]:
            yield block

    def encode(self, text: str) -> bytes:
        """A text's ids, packed."""
        get = self.__getitem__
        return b"".join(b"".join(map(get, words)) for words in self.cut(text))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.table.__getitem__, memoryview(packed).cast("I")))


def _appended(df: DataFrame, column: str, name: str, one) -> DataFrame:
    """``df`` with a binary column: ``one`` of each value of ``column``."""
    at, name = df.columns.index(column), fresh(df, name)
    names = [*df.columns, name]

    def run(batches):
        for batch in batches:
            values = pa.array((one(v.as_py()) for v in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names)

    return df.mapInArrow(releasing(run), StructType([*df.schema.fields, StructField(name, BinaryType())]))


def encoded(docs: DataFrame, path: str, pattern: str = KNOWN_PATTERN, text: str = "text") -> DataFrame:
    """``docs`` and a binary column ``ids``: each text's ids, packed."""
    return _appended(docs, text, "ids", lambda t: ByteBpe.load(path, pattern).encode(t or ""))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` and a binary column ``decoded``: the bytes that packed ids stand for; null has none."""
    return _appended(rows, ids, "decoded", lambda i: ByteBpe.load(path, KNOWN_PATTERN).decode(i or b""))


def report(docs: DataFrame, path: str, pattern: str = KNOWN_PATTERN) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, a text at a time in one pass."""
    def run(batches):
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for t in batch.column(1):
                packed = bpe.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        releasing(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
