import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from small import documents

from netsift.llm import byte_bpe as B

PATHS = [P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: n for n, t in enumerate(B.read_ranks(path))}, special_tokens={})


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def odd_texts():
    rng = random.Random(5)
    pools = ["abc 'S'll  \n\t.!", "é ß ʼnǅɏ²¼ª\x85\xa0\x1c", "日本語 　한국어 ", "\U0001f600‍ x", "՘֋꟎\U00011de0\U0003347a 1a ",
             "<|endoftext|> ", "\x00\x7f̀e", "ѧЂ ҁ՗ֈ "]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_the_pattern_is_the_published_one():
    assert B.KNOWN_PATTERN == P.PATTERN


@pytest.mark.parametrize("path", PATHS)
def test_ids_and_bytes_against_the_library(path):
    ours, theirs = B.ByteBpe.load(path, P.PATTERN), library(path)
    for t in odd_texts():
        ids = ours.encode(t)
        assert unpack(ids) == theirs.encode_ordinary(t), t
        assert ours.decode(ids) == t.encode()


def test_every_character_and_every_rank():
    ours, theirs = B.ByteBpe.load(PATHS[0], P.PATTERN), library(PATHS[0])
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 5000):
        t = " a1".join(chars[at:at + 5000])
        assert unpack(ours.encode(t)) == theirs.encode_ordinary(t), at
    odd = [n for n, t in enumerate(ours.ranks) if ours.model.encode("".join(B.shown_bytes()[b] for b in t)) != [n]]
    assert odd == []  # each rank's bytes are one id, as the library gives without merging


def test_long_texts(monkeypatch):
    ours, theirs = B.ByteBpe.load(PATHS[0], P.PATTERN), library(PATHS[0])
    rng = random.Random(2)
    run = "".join(rng.choice("acgt") for _ in range(300_000))
    blocks = " ".join("".join(rng.choice("abcdé .,1\n") for _ in range(30)) for _ in range(20_000))
    assert len(blocks) > 2 * B.BLOCK
    for t in (run, blocks, "x" * 100_000 + "꟎" + " " * 100_000):
        assert unpack(ours.encode(t)) == theirs.encode_ordinary(t)
    ours.clear()
    monkeypatch.setattr(B, "KEPT", 10)  # what is remembered changes no result
    assert unpack(ours.encode(blocks)) == theirs.encode_ordinary(blocks) and len(ours) <= 10 and max(map(len, ours)) <= B.KEPT_CHARS


def test_tables(spark, tmp_path):
    rows = [(n, t) for n, t in enumerate(odd_texts()[:200])] + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (900, None), (901, ""), (902, "x" * 200_000)]
    docs = documents(spark, tmp_path, rows)
    theirs = library(PATHS[0])

    def expected(t):
        ids = theirs.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = sorted(map(tuple, B.report(docs, PATHS[0], P.PATTERN).collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=str)
    both = B.decoded(B.encoded(docs.withColumnRenamed("h", "ids"), PATHS[0]), PATHS[0], "ids_")
    assert set(both.columns) - set(docs.columns) == {"ids", "ids_", "decoded"}
    for r in both.collect():
        assert unpack(r.ids_) == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert B.report(documents(spark, tmp_path / "none", []), PATHS[0]).collect() == []
