import numpy as np
import pytest
from small import table

from netsift.llm import neighbours as N
from netsift.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, label int, h string, v int, ids int"


def brute(rows, k=20):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for i, v in ok:
        if i % 20:
            continue
        mine = [(-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j) for j, w in ok if j != i and len(w) == len(v)]
        out[i] = sorted(mine)[:k]
    return out


def write(spark, tmp_path, rows):
    return table(spark, tmp_path, "embeddings", [(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def recall(got, want):
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(have) == {q for q in want if want[q]}
    hit = total = 0
    for q, near in want.items():
        mine = sorted(have.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len({m[1] for m in mine}) == len(mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine) and q not in [m[1] for m in mine]
        assert len(mine) == len(near)
        exact = dict((j, -s) for s, j in near)
        for _, j, s in mine:
            assert j not in exact or abs(exact[j] - s) < 1e-9
        hit += sum(m[1] in exact for m in mine)
        total += len(near)
    return hit / max(1, total)


def test_small_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(100)]  # a hot vector
    rows += [(500, None), (520, []), (540, [0.0] * 8), (560, [None] + [1.0] * 7), (580, [float("nan")] * 8), (600, [float("inf")] * 8),
             (None, [1.0] * 8), (620, [1.0, 2.0]), (621, [2.0, 1.0]), (640, rows[1][1]), (20, rows[20][1]), (660, [3.0])]
    got = N.report(write(spark, tmp_path, rows)).collect()
    assert recall(got, brute(rows)) > 0.999


@pytest.mark.parametrize("shard", [16384, 700])
def test_recall(spark, tmp_path, monkeypatch, shard):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    m = np.array([r[1] for r in rows], np.float64)
    q = [n for n, r in enumerate(rows) if r[0] % 20 == 0]
    score = m[q] @ m.T
    score[np.arange(len(q)), q] = -np.inf
    got = N.nearest(df, df.where("vec_id % 20 = 0"), shard=shard).collect()
    want = {}
    for n, s in zip(q, score):
        best = sorted(np.argsort(-s, kind="stable")[:60], key=lambda j: (-s[j], rows[j][0]))[:20]
        want[rows[n][0]] = [(-s[j], rows[j][0]) for j in best]
    assert recall(got, want) > 0.95


def test_a_full_shard_and_bounded_query_blocks(spark, tmp_path, monkeypatch):
    """16,384 vectors in one shard; no task of the search holds more than a block of the queries."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=(400, 32))
    m = (near[rng.integers(0, 400, 16384)] + 0.6 * rng.normal(size=(16384, 32))).astype(np.float32).astype(np.float64)
    df = write(spark, tmp_path, list(enumerate(m.tolist())))
    monkeypatch.setattr(N, "QUERY_ROWS", 100)
    tables, stored = {}, N.stored
    monkeypatch.setattr(N, "stored", lambda d, name: tables.setdefault(name, stored(d, name)))
    got = N.report(df).collect()
    assert tables["graphs"].count() == 1
    held = [len(r.q_ids) // 8 for r in tables["query-blocks"].collect()]
    assert len(held) >= 8 and sum(held) == 820 and max(held) < 200
    q = np.arange(0, 16384, 20)
    score = m[q] @ m.T
    score[np.arange(len(q)), q] = -np.inf
    want = {int(n): [(-s[j], int(j)) for j in np.argsort(-s, kind="stable")[:20]] for n, s in zip(q, score)}
    assert recall(got, want) > 0.95


@pytest.mark.parametrize("dim", [64, 128])
def test_a_full_shard_without_structure(dim):
    """Gaussian vectors, the hardest case: nothing is much nearer than the rest."""
    m = np.random.default_rng(5).normal(size=(N.SHARD, dim)).astype(np.float32)
    q = np.arange(0, N.SHARD, 64)
    score = m[q].astype(np.float64) @ m.T.astype(np.float64)
    score[np.arange(len(q)), q] = -np.inf
    found = Graph(m).search(m[q], N.BEAM, 21)
    hit = 0
    for me, want, nodes in zip(q, np.argsort(-score, axis=1)[:, :20], found):
        nodes = nodes[(nodes >= 0) & (nodes != me)]
        best = nodes[np.argsort(-(m[nodes].astype(np.float64) @ m[me].astype(np.float64)))[:20]]
        hit += len(np.intersect1d(best, want))
    assert hit >= 0.9 * 20 * len(q)


def test_empty(spark, tmp_path):
    assert N.report(write(spark, tmp_path, [])).collect() == []
    assert N.report(write(spark, tmp_path / "one", [(0, [1.0, 2.0])])).collect() == []
