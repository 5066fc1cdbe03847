import zlib
from collections import Counter

import numpy as np
from small import documents, table
from test_decontaminate import brute as contaminated
from test_jaccard import brute as groups
from test_mixing import draw

import corpus_pipeline as P
from netsift.llm import mixing
from netsift.llm.pretokens import Pretokens
from test_tokens import BPE

EN = "the cat then thought that this other thing there was with them and their father went".split()


def inputs():
    import random
    rnd = random.Random(11)
    say = lambda k: " ".join(rnd.choice(EN) + rnd.choice(["", "s", "ly"]) for _ in range(k))
    items = [(i, say(rnd.randint(13, 30))) for i in range(8)]
    rows = [(i, say(rnd.randint(10, 90)), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i][1].upper(), "en", "s0") for i in range(20)]  # copies
    rows += [(200 + i, say(20) + " " + items[i][1] + " " + say(15), "en", "s1") for i in range(8)]
    rows += [(300, None, "en", None), (301, "", "en", "s0"), (302, "12 34 ?!", "en", "s2"), (303, "xqj zzk qqx wqk kkj xxz", None, "s2"),
             (None, say(40), "en", None), (5, rows[5][1], "en", "s2"), (304, say(9000), "en", "s0"), (305, say(3), "en", "s1")]
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = inputs()
    documents(spark, tmp_path, rows)
    table(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = sorted((tuple(r) for r in P.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    kept = [r for r in rows if r[0] not in (300, 301, 302, 303)]
    pairs = sorted(((r[0], r[1]) for r in kept), key=lambda r: (r[0] is None, r[0] or 0))
    first = {c for _, c, _ in groups(pairs)}  # a group is named by its smallest id
    assert len(kept) - len(first) == 21
    one = {r[0]: r for r in reversed(kept) if r[0] in first}
    clean = [one[r[0]] for r in contaminated([(r[0], r[1]) for r in one.values()], items) if not r[5]]
    assert len(one) - len(clean) == 8
    n = Counter(r[3] or "" for r in clean)
    w = {s: c**mixing.POWER for s, c in n.items()}
    pre, want = Pretokens(BPE), []
    for r in clean:
        s = r[3] or ""
        ids = np.array([*pre.encode([r[1]])[0], 1], "<u4").tobytes()
        want += [(r[0], len(ids) // 4, zlib.crc32(ids))] * draw(r[0], len(clean) * w[s] / sum(w.values()) / n[s])
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == sorted(want, key=repr)
    at = 0
    for _, start, size, _ in got:  # the files hold them one after the other
        assert start == at
        at += size
    # In the shuffled order of the mixture: neither by id, nor copies side by side.
    ids = [r[0] for r in got if r[0] is not None]
    steps = sum(a <= b for a, b in zip(ids, ids[1:])) / len(ids)
    twice = sum(a == b for a, b in zip(ids, ids[1:]))
    assert 0.3 < steps < 0.7 and twice <= len(ids) / 10 and len(set(ids)) < len(ids)


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    rows, items = inputs()
    docs = documents(spark, tmp_path, rows)
    table(spark, tmp_path, "benchmark", items, "item_id long, text string")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_documents(spark, tmp_path):
    documents(spark, tmp_path, [])
    table(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert P.run(spark, str(tmp_path)).collect() == []
