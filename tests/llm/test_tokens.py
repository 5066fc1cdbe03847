import random

import public_tokenizers
import pytest
from small import documents

from netsift.llm import token_counts as C
from netsift.llm.pretokens import Pretokens

BPE = public_tokenizers.path("word_bpe_49k.json")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def odd_texts():
    rnd = random.Random(9)
    chars = "abcXYZ '  .,-_|<>@#09\n\t éÉàßñçÀȺĐ²½µªº·×÷ ­’́ẞ한中😀\x00\x0b\x0c\x1c\x85　İı'sS"
    out = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    out += ["it's THEY'RE i'll 's's 'd'x we've'", "a<|endoftext|>b", "<|startoftext|>", "<|x|>", "é été", None, "", " \n\t",
            "x" * 5000, "the cat " * 20000, "ſ K Å", "'T 'LL"]
    return out


def library(name, texts):
    pre = Pretokens(public_tokenizers.path(name))
    return [pre.encode([t or ""])[0] for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_library_s(spark, tmp_path, name):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    df = documents(spark, tmp_path, rows)
    got = sorted((tuple(r) for r in C.report(df, public_tokenizers.path(name)).collect()), key=repr)
    want = []
    for (i, t), ids in zip(rows, library(name, [t for _, t in rows])):
        want.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
    assert got == sorted(want, key=repr)


def test_neither_tier_keeps_long_pretokens(spark, tmp_path):
    """They count as the library counts them, and only short ones are remembered."""
    rnd = random.Random(3)
    long = ["".join(rnd.choice("acgt") for _ in range(n)) for n in (64, 65, 300, 50_000)]
    texts = [" ".join([w, "cat", w]) for w in long] * 3
    df = documents(spark, tmp_path, list(enumerate(texts)))
    held = C.frequent_pretokens(df, BPE)
    assert set(held) == {"cat", long[0]}
    tiers = C.Tiers({}, C.Cache(Pretokens.load(BPE), len))
    assert [tiers[w] for w in long] == [len(x) for x in library("word_bpe_49k.json", long)]
    assert list(tiers.rest) == long[:1]
    got = {r.doc_id: r.n_tokens for r in C.report(df, BPE).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in library("word_bpe_49k.json", texts)]


def test_pieces_join_to_the_library_s_ids():
    pre, texts = Pretokens(BPE), [t or "" for t in odd_texts()]
    cut = 0
    for t, ids in zip(texts, library("word_bpe_49k.json", texts)):
        w = pre.cut(t)
        if w is not None:
            cut += 1
            assert [i for x in w for i in pre.ids(x)] == ids, t
    assert cut > 10


def test_empty_table(spark, tmp_path):
    assert C.report(documents(spark, tmp_path, []), BPE).collect() == []


def test_table_gives_the_library_s_ids():
    """Also with slots that clash, words of more than 16 bytes, and after it was emptied."""
    import numpy as np

    from netsift.llm import lookup
    pre = Pretokens(BPE)
    texts = [t for t in odd_texts() if t is not None and lookup.eligible(t, pre)]
    texts += ["", " ", "é", "12 3", "a_b--c", "x" * 17 + " " + "é" * 8 + " " + "é" * 9, "Straße ŒUVRE ſo", "aaaaaaaaa aaaaaaaaaa a aa"]
    assert not any(lookup.eligible(t, pre) for t in ("it's", "İ", "x²", "中", "a\x0b", "<|endoftext|>"))
    table = lookup.Table(pre)
    for _ in range(3):
        ids, n = table.encode([t.lower().encode() for t in texts])
        assert np.split(ids, np.cumsum(n)[:-1])[0].dtype == np.uint32
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == library("word_bpe_49k.json", texts)
        table.slots[:, 2] = 31  # nothing in the table fits any more, no slot is free
    table.clear()
    assert table.encode([])[1].tolist() == []
