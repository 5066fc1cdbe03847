import zlib

import numpy as np
from small import documents

from netsift.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.report(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(want)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out and want[i] is not None and got[i].lang_pred != "und"]
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.95


def test_edge_rows(spark, tmp_path):
    rows = [(i, f"the then there {i} this that", "en") for i in range(20)]
    rows += [(100 + i, f"der dieß das {i} über und nicht", "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !?", None), (203, "the this", None), (204, "über nicht das", None),
             (None, "there that", "en"), (205, "e", "en"), (206, "über das " * 30000, "de"), (3, rows[3][1], "en"), (207, "한국어 中文", None)]
    df = documents(spark, tmp_path, rows)
    got = L.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (200, 201, 202, 203, 204, None, 206)] == ["und", "und", "und", "en", "de", "en", "de"]
    assert by[None].held_out and by[202].score == 0 and by[207].score < L.REJECT_BELOW and by[207].lang_pred in ("en", "de")
    kept = L.accepted(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in rows if r[0] not in (200, 201, 202, 207)), key=repr)


def test_nothing_to_learn(spark, tmp_path):
    assert L.report(documents(spark, tmp_path / "a", [])).collect() == []
    assert {r.lang_pred for r in L.report(documents(spark, tmp_path / "b", [(1, "text", None), (2, None)])).collect()} == {"und"}


def test_filter_returns_all_languages_of_a_gram():
    g = np.arange(1, 2000, dtype=np.uint64) * np.uint64(2654435761)
    many = [f"l{i:03}" for i in range(70)]
    no = (np.arange(len(g)) % 70).astype(np.int64)
    f = L.Filter(many, np.concatenate([g, g]), np.concatenate([no, (no + 33) % 70]))
    m = f.slots[f._slot(g, 0)]
    for p in range(1, L.PROBES):
        m = m & f.slots[f._slot(g, p)]
    for k, n in enumerate(no):
        for x in (n, (n + 33) % 70):
            assert (int(m[k, x // 64]) >> int(x % 64)) & 1
    assert f.false_rate.max() < 0.01


def test_grams_do_not_cross_texts():
    a, w = L.grams(["ab", None, "", "b  c", "1"])
    one = [L.grams([t])[0] for t in ("ab", "b  c")]
    assert (a == np.concatenate(one)).all() and w.tolist() == [0, 0, 3, 3]


def test_long_texts_in_blocks(monkeypatch):
    """The grams of a text don't depend on where blocks end."""
    import random
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcÄß  .,1\n") for _ in range(3000)) + "x" * 500 + " " * 200 + "yz"
    whole, _ = L.grams([text])
    for step in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(L, "TEXT_STEP", step)
        assert (np.concatenate([g for g, _ in L.gram_blocks([text])]) == whole).all()


def plain(rows):
    """Sets and counts in plain Python: every gram with its share, no filter but the sets themselves."""
    from collections import Counter

    def of(t):
        out, word = [], ""
        for c in (t or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                out += [f" {word} "[i:i + 3] for i in range(len(word))]
                word = ""
        return out
    counts = {}
    for i, t, lang, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 and lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(of(t))
    kept = {lang: {g for g, n in c.items() if n / c.total() >= L.MIN_SHARE} for lang, c in counts.items()}
    out = []
    for i, t, *_ in rows:
        g = of(t)
        shares = sorted((-sum(x in k for x in g) / max(1, len(g)), lang) for lang, k in kept.items())
        out.append((i, shares[0][1] if g and shares else "und", -shares[0][0] if g and shares else 0.0, shares))
    return out


def test_against_plain_sets(spark, tmp_path):
    """Scores are the shares of known grams, but for the filter's corrected false positives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in docs] + [(9001, "der die the", None), (None, "x", "en"), (9002, None, "fr"), (9003, "日本", None)]
    got = {r.doc_id: r for r in L.report(documents(spark, tmp_path, rows)).collect()}
    for i, lang, score, shares in plain(rows):
        r = got[i]
        assert abs(r.score - score) < 0.02, (i, r, score)
        near = [name for s, name in shares if -s > score - 0.02]
        assert r.lang_pred == lang or r.lang_pred in near
