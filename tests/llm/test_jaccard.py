import random
from fractions import Fraction

import numpy as np
import pytest
from small import documents
from test_decontaminate import words

from netsift.llm import jaccard as J
from netsift.llm.shingles import choose_bands, shingles, word_hashes


def sets_of(docs):
    out = []
    for _, t in docs:
        w = words(t)
        k = min(5, len(w))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(docs, up=4, down=5):
    s, n = sets_of(docs), len(docs)
    near = [[j for j in range(n) if j != i and s[i] and s[j]
             and down * len(s[i] & s[j]) >= up * len(s[i] | s[j])] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)
    return sorted(((docs[i][0], label[i], len(near[i])) for i in range(n)), key=repr)


def cases():
    rnd = random.Random(3)
    vocab = [f"w{i}é" for i in range(300)]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    docs, d = [], 0
    for size, copies, edits in ((120, 60, 2), (60, 12, 1), (200, 8, 6), (30, 5, 1), (4, 3, 0), (5, 3, 0), (1, 3, 0), (400, 30, 25)):
        base = say(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((d, " ".join(w).upper() if d % 3 else ", ".join(w)))
            d += 1
    docs += [(d + i, " ".join(say(80))) for i in range(30)]
    docs += [(900, None), (901, ""), (902, " .,! "), (None, docs[0][1]), (5, docs[5][1]), (5, docs[5][1]), (None, None),
             (903, " ".join(say(30000))), (904, "x " * 9000), (905, "x " * 50)]
    return docs


@pytest.mark.parametrize("rows", [4096, 7])
def test_links_and_groups(spark, tmp_path, monkeypatch, rows):
    """Against all pairs; with small blocks the hot bucket is split."""
    monkeypatch.setattr(J, "BLOCK_ROWS", rows)
    docs = cases()
    got = sorted(map(tuple, J.report(documents(spark, tmp_path, docs)).collect()), key=repr)
    assert got == brute(docs)


def test_one_of_each_group_stays(spark, tmp_path):
    docs = cases()
    df = documents(spark, tmp_path, docs)
    kept = J.first_of_each_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for d, c, _ in brute(docs) if c is not None}
    assert len([i for i in ids if i in want]) == len(want)
    assert not {i for i in ids if i is not None} - want
    assert {900, 901, 902} <= set(ids)


def test_empty_table(spark, tmp_path):
    assert J.report(documents(spark, tmp_path, [])).collect() == []
    assert sorted(map(tuple, J.report(documents(spark, tmp_path / "n", [(1, None), (2, None)])).collect())) == [(1, 1, 0), (2, 2, 0)]


def test_shingles_are_word_sets():
    t = " The É cat, sat; on-the mat\n" * 3
    a, b = (shingles(word_hashes(x.encode())) for x in (t, " ".join(words(t))))
    assert (a == b).all() and len(a) == len(sets_of([(0, t)])[0])
    assert len(word_hashes(b"")) == 0 and len(shingles(np.zeros(0, np.uint64))) == 0
    big = ("word%d " * 3) % (1, 2, 3) * 200000
    assert len(word_hashes(big.encode())) == 600000


def test_bands_reach_the_recall():
    b = choose_bands(0.8, 0.9995, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.9995 > 1 - (1 - 0.8**4) ** (b - 1)
    assert Fraction(4, 5) == J.THRESHOLD


def test_words_longer_than_a_piece(spark, tmp_path):
    """A word of two megabytes is one word: texts of it and another word share no shingle."""
    import numpy as np
    from netsift.llm import shingles as S
    long = "l" * 2_000_000
    rows = [(1, long + " a"), (2, long + " b"), (3, long + " a"), (4, "x " + long), (5, "a " + long + " c d e"), (6, "a " + long + " c d e.")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.report(documents(spark, tmp_path, rows)).collect())
    assert got == [(1, 1, 1), (2, 2, 0), (3, 1, 1), (4, 4, 0), (5, 5, 1), (6, 5, 1)]
    rng = np.random.default_rng(3)
    for _ in range(12):  # words cut by pieces anywhere, against words hashed alone
        words = [bytes(rng.integers(97, 123, rng.choice([1, 5, 3 * S.PIECE, S.PIECE - 1, S.PIECE, S.PIECE + 1])).astype(np.uint8)) for _ in range(4)]
        text = b" " * rng.integers(0, 3) + b" ".join(words) + b" " * rng.integers(0, 2)
        alone = np.concatenate([_slow(S, w) for w in words])
        assert (S.word_hashes(text) == S.mix(alone)).all()


def _slow(S, w):
    """A long word's polynomial by halves."""
    import numpy as np
    total, power = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(w), 1000):
            part = np.frombuffer(w[at:at + 1000], np.uint8)
            total = total + power * (S._BYTE[part] * S._POW[:len(part)]).sum(dtype=np.uint64)
            power = power * S._POW[len(part)]
    return np.array([total + np.uint64(len(w))], np.uint64)
