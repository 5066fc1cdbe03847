import hashlib
import random
import re

import pytest
from small import documents, table

from netsift.llm import decontaminate as D

UP = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(docs, items, n=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, it in items:
            iw = words(it)
            if not iw:
                continue
            m = min(n, len(iw))
            wins = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)}
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in wins:
                    hit.update(range(i, i + m))
                    ids.add("" if item_id is None else str(item_id))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(5)
    vocab = ["the", "An", "él", "x9", "zu", "ü", "oN", "it"]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    items = [(i, say(rnd.choice([3, 7, 12, 13, 14, 30, 45]))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "!!!"), (None, say(20)), (3, say(18)), (28, "a a a a a a a a a a a a a a a a"),
              (29, items[8][1]), (30, "Solo"), (31, "123")]
    docs = []
    for d in range(60):
        t = say(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            it = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(it) - 13))
            t += " -- " + ", ".join(it[a:a + rnd.randint(5, 20)]).upper() + "\n" + say(rnd.randint(0, 30))
        docs.append((d, t))
    docs += [(60, None), (61, ""), (62, "..."), (None, items[0][1]), (0, docs[0][1]), (0, docs[0][1]),
             (63, "a " * 5000), (64, "b " * 3000 + items[5][1] + " c" * 20000), (65, "123"), (66, "solo 123")]
    return docs, items


@pytest.mark.parametrize("limit", [None, 0])
def test_matches_brute_force(spark, tmp_path, monkeypatch, limit):
    """Both ways of joining: by broadcast, and by shuffle beyond its bound."""
    if limit is not None:
        monkeypatch.setattr("netsift.llm.common.BROADCAST_ROWS", limit)
    docs, items = cases()
    got = D.report(documents(spark, tmp_path, docs), table(spark, tmp_path, "benchmark", items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path, [(1, "some words here")])
    none = table(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.report(docs, none).collect()] == [(1, 3, 0, 0)]
    assert D.report(documents(spark, tmp_path / "e", []), none).collect() == []


def test_stage_keeps_clean_rows_and_columns(spark, tmp_path):
    docs, items = cases()
    df = documents(spark, tmp_path, docs)
    kept = D.decontaminated(df, table(spark, tmp_path, "benchmark", items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([r[0] for r in brute(docs, items) if not r[5]], key=repr)
