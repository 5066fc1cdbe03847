import hashlib

import numpy as np
import pytest
from small import table

from netsift.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, label int, block int, a string, cluster int"


def brute(rows, k=8, dim=64, rounds=10, seed=3, scale=1024):
    """Python's integers, one vector and centroid at a time."""
    kept = [(i, [int(np.floor(np.float64(scale) * c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, c)), n) for n, c in enumerate(cs)) for _, v in kept]
    for _ in range(rounds):
        near = [n for _, n in assign()]
        for n in range(len(cs)):
            mine = [v for (_, v), a in zip(kept, near) if a == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = assign()
    inertia = {n: sum(d for d, a in last if a == n) for n in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, last)), key=str)


def write(spark, tmp_path, rows):
    return table(spark, tmp_path, "embeddings", [(i, v, 0, 1, "a", 7) for i, v in rows], SCHEMA)


def check(spark, tmp_path, rows):
    got = sorted(map(tuple, C.report(write(spark, tmp_path, rows)).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "BUCKET", 128)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 0.1 + rng.integers(-1, 2)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third of the rows are one vector
    rows += [(6, rows[6][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1]),
             (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("-inf")] * 64),
             (2006, [0.0] * 64), (2007, [-0.0005] * 64)]
    check(spark, tmp_path, rows)


def test_few_rows_ties_and_empty(spark, tmp_path):
    check(spark, tmp_path / "a", [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.0] * 64)])
    check(spark, tmp_path / "b", [(i, [float(i % 2)] * 64) for i in range(20)])  # equal centroids: the rest stay empty
    assert C.report(write(spark, tmp_path / "d", [])).collect() == []
    assert C.report(write(spark, tmp_path / "e", [(1, None)])).collect() == []


def test_large_components(spark, tmp_path):
    """Squared distances beyond what 64 bits hold on the way to a nearest one."""
    rng = np.random.default_rng(5)
    check(spark, tmp_path, [(i, (rng.normal(size=64) + (1e7 if i % 9 == 0 else 0)).tolist()) for i in range(60)])


@pytest.mark.parametrize("spread", [0, 1, 30])
def test_search_from_any_bounds(spread):
    """Rounds of moving centroids: assignments as by all distances, valid bounds, and vectors that needn't be searched for."""
    rng = np.random.default_rng(spread)
    centre = rng.integers(-200, 200, (12, 6))
    x = (centre[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))).astype(np.int64)
    now = x[rng.choice(3000, 12, replace=False)]
    cs = C.Centroids(now)
    a, b, up, low = C.first_search(x, cs)
    for _ in range(6):
        then = np.stack([x[a == n].sum(axis=0) // max(1, (a == n).sum()) if (a == n).any() else now[n] for n in range(12)])
        cs, now = C.Centroids(then, now), then
        a, b, up, low = C.shallot_search(x, cs, a, b, up, low)
        d = np.stack([C.squared(x, c) for c in now], axis=1)
        assert (a == d.argmin(axis=1)).all()
        true = np.sqrt(d[np.arange(3000), a].astype(float))
        d[np.arange(3000), a] = 1 << 60
        assert (up >= true).all() and (low <= np.sqrt(d.min(axis=1))).all()


def test_vectors_within_their_bounds_are_not_compared(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 6, (500, 4)) + at for at in (0, 1000, 2000)]).astype(np.int64)
    now = x[[0, 500, 1000]]
    state = C.first_search(x, C.Centroids(now))
    then = now + 1
    seen = []
    monkeypatch.setattr(C, "squared", lambda v, c, f=C.squared: seen.append(len(v)) or f(v, c))
    cs = C.Centroids(then, now)
    seen.clear()
    a, *_ = C.shallot_search(x, cs, *state)
    assert sum(seen) == 0 and (a == np.repeat([0, 1, 2], 500)).all()
