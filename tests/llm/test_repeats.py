import hashlib
import random
from collections import Counter

import pytest
from small import documents

from netsift.llm import repeats as R


def brute(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(4)
    say = lambda k: "".join(rnd.choice("abcdefgh é\n") for _ in range(k))
    passage = [say(k) for k in (180, 199, 200, 201, 260, 500, 1500)]
    docs = []
    for d in range(120):
        t = say(rnd.randint(0, 500))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passage)
            a = rnd.randint(0, 60) * rnd.randint(0, 1)
            t += p[a:len(p) - rnd.randint(0, 50) * rnd.randint(0, 1)] + say(rnd.randint(0, 300))
        docs.append((d, t))
    base = say(900)
    for d in range(120, 170):  # near copies
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = "Z"
        docs.append((d, "".join(t)))
    docs += [(200, None), (201, ""), (202, "a" * 199), (203, "b" * 200), (204, "c" * 201), (205, "ab" * 300), (206, "xyz " * 2000),
             (207, base + say(50) + base), (None, passage[-1]), (5, docs[5][1]), (5, docs[5][1]), (208, "é" * 150), (209, say(3000) * 2)]
    return docs


@pytest.mark.parametrize("piece", [1 << 19, 333])
def test_matches_brute_force(spark, tmp_path, monkeypatch, piece):
    """With short pieces long texts are handled in many parts."""
    import numpy as np
    docs = cases()
    if piece < 1000:  # the tasks read the module's value: check the pieces themselves
        monkeypatch.setattr(R, "PIECE", piece)
        for _, t in docs[-8:]:
            b = np.frombuffer((t or "").encode(), np.uint8)
            one = np.concatenate([np.arange(f, z + 1) + at for at, p in R._pieces(b, 200) for f, z, *_ in zip(*R._runs(p, 200, 64))] or [[]])
            assert one.tolist() == list(range(max(0, len(b) - 199)))
        return
    got = R.report(documents(spark, tmp_path, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_kept_bytes(spark, tmp_path):
    docs = cases()
    want = {r[0]: r for r in brute(docs)}
    for r in R.without_repeats(documents(spark, tmp_path, docs)).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == want[r.doc_id][4]
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_long_near_copies(spark, tmp_path):
    """Most windows of mixed grams are repeated; only the runs they make are collected."""
    rnd = random.Random(8)
    one = "".join(rnd.choice("acgt") for _ in range(150_000))
    two = list(one)
    for i in range(150, len(two), 400):
        two[i] = "N"
    docs = [(1, one), (2, "".join(two)), (3, one[70_000:70_300])]
    got = R.report(documents(spark, tmp_path, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_empty(spark, tmp_path):
    assert R.report(documents(spark, tmp_path, [])).collect() == []
