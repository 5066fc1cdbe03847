import hashlib
import math
from collections import Counter

import duckdb
import pytest
from small import documents

from netsift.llm import mixing as M


def draw(doc_id, mean, seed=M.SEED):
    draws, n = max(1, math.ceil(mean / M.CHUNK)), 0
    for j in range(1, draws + 1):
        t = f"{seed}:{'null' if doc_id is None else doc_id}:{j}"
        u = int(hashlib.md5(t.encode()).hexdigest()[:13], 16) / 2**52
        p = below = math.exp(-mean / draws)
        for k in range(1, M.TERMS + 2):
            if u < below:
                break
            n += 1
            p *= mean / draws / k
            below += p
    return n


def rows_of():
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else "src%d" % (i % 5)) for i in range(600)]
    return rows + [(600, None, None, None), (601, "", "en", ""), (None, "null id", "de", "src1"), (5, "again", "en", "hot"), (5, "again", "en", "hot")]


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("weights, total", [(None, None), ({"hot": 1, "src0": 50, "src1": 1, "": 300}, 4000)])
def test_copies(spark, tmp_path, monkeypatch, limit, weights, total):
    if limit is not None:
        monkeypatch.setattr("netsift.llm.common.BROADCAST_ROWS", limit)
    rows = rows_of()
    df = documents(spark, tmp_path, rows)
    got, copy = M.mixture(df, weights, total)
    assert set(got.columns) == {*df.columns, copy}
    n = Counter(r[3] or "" for r in rows)
    w = {s: (weights.get(s, 0) if weights else c**M.POWER) for s, c in n.items()}
    want = []
    for r in rows:
        s = r[3] or ""
        mean = (total or len(rows)) * w[s] / sum(w.values()) / n[s]
        want += [(r[0], r[1], r[3], k) for k in range(1, draw(r[0], mean) + 1)]
    have = sorted(((r.doc_id, r.text, r.source, r[copy]) for r in got.collect()), key=repr)
    assert have == sorted(want, key=repr)


def test_oracle_and_no_python(spark, tmp_path):
    df = documents(spark, tmp_path, rows_of(), extra=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = M.report(df)
    want = con.execute(M.ORACLE_SQL).fetchall()
    cols = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, tmp_path):
    assert M.report(documents(spark, tmp_path, [])).collect() == []
