import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from small import documents
from test_tokens import BPE, odd_texts

from netsift.llm import token_files as T
from netsift.llm.huffman import STRIDE, Code, code_lengths
from netsift.llm.pretokens import Pretokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(9, 16), st.integers(0, 5000))
def test_code_round_trip(counts, limit, n):
    counts = np.array(counts)
    bits = code_lengths(counts, limit)
    assert bits.max() <= max(limit, 1) and (0.5 ** bits).sum() <= 1
    symbols = np.cumsum(np.arange(len(counts)) % 3 + 1)
    ids = np.random.default_rng(n).choice(symbols, n) if n else np.zeros(0, np.int64)
    code = Code(symbols, bits)
    data, points = code.encode(ids)
    assert len(points) == -(-n // STRIDE)
    assert (code.decode(data, points, n) == ids).all()


def test_lengths_are_optimal_within_the_limit():
    """Against Huffman's own cost where the limit doesn't bind."""
    import heapq
    c = np.random.default_rng(0).integers(1, 1000, 200)
    heap, cost = list(map(int, c)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert (code_lengths(c, 40) * c).sum() == cost
    fib = np.array([1, 1] + [0] * 38)
    for i in range(2, 40):
        fib[i] = fib[i - 1] + fib[i - 2]
    b = code_lengths(fib, 8)
    assert b.max() == 8 and (0.5 ** b).sum() == 1


@pytest.mark.parametrize("name, block", [("word_bpe_49k.json", 64), ("piece_bpe_32k.model", 1 << 16)])
def test_files_read_back(spark, tmp_path, name, block):
    texts = odd_texts()
    rows = [(7 * i % 997, t) for i, t in enumerate(texts)] + [(None, "null id"), (5000, "same"), (5000, "same")]
    path = public_tokenizers.path(name)
    pre = Pretokens(path)
    T.write_tokens(documents(spark, tmp_path, rows), str(tmp_path / "t"), path, block_tokens=block)
    got = T.read_tokens(spark, str(tmp_path / "t")).collect()
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*pre.encode([t or ""])[0], 1], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    key = lambda r: r[1]
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=key) == want


def test_pretoken_of_many_ids(spark, tmp_path):
    """More ids than 16 bits count, from one run of letters, and the texts around it."""
    rng = np.random.default_rng(5)
    rows = [(1, "before"), (2, "".join(rng.choice(list("acgt"), 300_000))), (3, "after it, " + "".join(rng.choice(list("qzxjkvw"), 200_000)) + " too"),
            (4, "the last")]
    from tokenizers import Tokenizer
    want, at = [], 0
    for d, t in rows:
        ids = np.array([*Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert max(n for _, _, n, _ in want) > 1 << 16
    assert sorted(map(tuple, T.report(documents(spark, tmp_path, rows), BPE).collect())) == want


def test_empty_table(spark, tmp_path):
    assert T.report(documents(spark, tmp_path, []), BPE).collect() == []
