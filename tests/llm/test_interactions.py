from itertools import permutations
from math import factorial

import pytest
from small import documents, table

from netsift.llm import interactions as I

LABELS = "doc_id long, quality int, toxic int, part string"


def words_of(t):
    out, word = [], ""
    for ch in t + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def brute(rows, labels):
    """One document at a time through every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = words_of(t)
        fails = "".join(f for f, bad in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and least[t] < i]) if bad)
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            kept = mine
            for step, f in enumerate(order, 1):
                lost, left = [d for d in kept if f in d[0]], [d for d in kept if f not in d[0]]
                failing = sum(f in d[0] for d in mine)
                out[part, "".join(order), step] = [len(left), len(lost), failing - len(lost), sum(d[0] == f for d in mine),
                                                   sum(d[1] for d in lost), sum(d[2] for d in lost)]
                total[f] += len(lost)
                kept = left
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def check(got, want):
    have = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(have) == len(got) == len(want)
    assert have == want


def test_against_every_order(spark, tmp_path):
    many = " ".join(f"w{n}" for n in range(260))
    rows = [(1, many, "en"), (2, many, "en"), (3, many + " x", "de"), (4, "A B", None), (5, "A B", ""), (6, None, "en"), (7, "", "de"),
            (8, "the " * 300, "en"), (9, many + " 50%", "en"), (10, many.upper(), "fr"), (11, "a b c " * 90, "fr"),
            (12, "\x1c\x85é|" * 3, "fr"), (None, many, "en"), (None, many, "en"), (None, "only", None), (1, many, "en"), (0, many, "de"),
            (14, "x" * 400_000, "en"), (15, "Ünï " * 250 + "A" * 33, "de"), (16, "\U0001f600" * 97 + "ABC", "de"), (17, "\U0001f600" * 96 + "ABC", "de")]
    rows += [(100 + n, many, "en") for n in range(40)]  # copies of one text
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (8, 0, 1), (10, 1, 1), (None, 1, 1), (120, 1, 0), (999, 1, 1), (3, None, None)]
    docs = documents(spark, tmp_path, rows)
    lab = table(spark, tmp_path, "labels", [(*r, "p") for r in labels], LABELS)
    check(I.report(docs, lab).collect(), brute(rows, labels))


def test_empty(spark, tmp_path):
    lab = table(spark, tmp_path, "labels", [], LABELS)
    assert I.report(documents(spark, tmp_path, []), lab).collect() == []
    rows = [(1, "a b", "en"), (2, "a b", "en")]
    check(I.report(documents(spark, tmp_path / "two", rows), lab).collect(), brute(rows, []))


@pytest.mark.parametrize("m", [1, 2, 3, 5, 6])
def test_least_squares_gives_the_shapley_formula(m):
    for i, row in enumerate(I.shapley_table(m)):
        for s, c in enumerate(row):
            size, has = s.bit_count(), s >> i & 1
            share = factorial(size - has) * factorial(m - size - 1 + has)
            assert c == (share if has else -share) or (s == 0 and c == 0)


def test_other_filters_by_the_general_parts(spark):
    """Three filters given as masks: coalitions, and steps of all six orders."""
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 2), ("p", 6, 1, 1, 0)],
                                  "part string, mask int, documents long, good long, toxic long")
    found = I.coalitions(masks, 3)
    assert {r.coalition: r.removed for r in found.collect()} == {0: 0, 1: 6, 2: 5, 3: 7, 4: 1, 5: 7, 6: 5, 7: 7}
    rows = {(r.filter_order, r.step): r for r in I.steps(found, "xyz").collect()}
    assert len(rows) == 18
    assert [rows["yxz", n].removed for n in (1, 2, 3)] == [5, 2, 0] and rows["yxz", 2].redundant == 4 and rows["yxz", 2].unique_fails == 2
    for f in "xyz":
        orders = {o for o, _ in rows}
        assert rows[f + "".join(c for c in "xyz" if c != f), 1].shapley == sum(rows[o, o.index(f) + 1].removed for o in orders)
