"""Centroid clustering of integer vectors by shallot search.

Lloyd's rounds with exact integer arithmetic. Between rounds a vector keeps its
centroid, the centroid that was second-nearest when it was last searched for, an
upper bound of the distance to the first and a lower bound of the distance to
every other. A round moves the bounds by how far centroids went. Where the upper
bound is below the lower one, or below half the way to the next centroid, the
vector stays. Otherwise the distances to the first and the remembered second are
computed, and the search goes from the closer of the two through the other
centroids in order of their distance from it. The ball it has to look at shrinks
as it goes: once a centroid lies farther than the vector's own distance plus the
second-best distance so far, none behind it can be among the best two.

Bounds are floating point, rounded away from a decision; what they leave over is
compared in integers (squared distance, then number), so results are exact.

Vectors are packed into blocks of ``BLOCK`` and written once, bucketed by block;
a round reads them beside the bounds of the round before (a table bucketed
alike, so neither is shuffled), and writes the new bounds together with the
block's changes to the sums of centroids. Only sums (one row per centroid) and
centroids reach the driver: centroids times components numbers, a parameter.
Equal vectors are dealt over blocks like any others.

Defined results: vectors of another length than ``dim``, null ones and those
with a null or non-finite component take no part; a null vec_id takes part, but
is a starting centroid only after all others; repeated rows each count; fewer
rows than centroids give as many centroids as rows; an empty table gives no
rows. Components count as floor(scale * x); a distance or sum that a long can't
hold fails the job.
"""

from __future__ import annotations

import hashlib
import os
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import releasing, stored
from netsift.session import scratch_path

K, DIM, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
BLOCK, BUCKET = 4096, 1 << 16  # vectors in a packed block, and about those in a bucket (a task of a round)


def usable(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; overflow is an error."""
    y = np.floor(x.astype(np.float64) * scale)
    if not (np.abs(y) < 2.0**62).all():
        raise OverflowError("a scaled component doesn't fit 64 bits")
    return y.astype(np.int64)


def _exact(x: np.ndarray) -> np.ndarray:
    """The array in a type in which squared distances don't overflow: 64 bits, or Python's integers."""
    return x if not x.size or max(int(x.max()), -int(x.min())) <= isqrt((1 << 60) // x.shape[1]) else x.astype(object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to c (a row, or one for each row of x)."""
    d = x - c
    return (d * d).sum(axis=1)


def _root_up(d) -> np.ndarray:
    return np.nextafter(np.sqrt(np.asarray(d, np.float64)).astype(np.float32), np.float32(np.inf))


def _root_down(d) -> np.ndarray:
    return np.nextafter(np.sqrt(np.asarray(d, np.float64)).astype(np.float32), np.float32(-np.inf))


class Centroids:
    """The centroids of a round, with what their search needs: distances between
    them, the order in which each sees the others, and how far each has come
    since the round before. All float values are lower (``gap``) or upper
    (``moved``) bounds."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.c = _exact(now)
        self.k = len(now)
        self.gap = np.stack([_root_down(squared(self.c, row)) for row in self.c]).astype(np.float64)
        np.fill_diagonal(self.gap, np.inf)
        self.half = self.gap.min(axis=1) / 2 if self.k > 1 else np.full(1, np.inf)
        self.order = np.argsort(self.gap, axis=1, kind="stable")[:, :-1]  # its own place comes last
        before = self.c if before is None else _exact(before)
        self.moved = np.where((self.c == before).all(axis=1), 0, _root_up(squared(self.c, before))).astype(np.float64)
        far = np.argsort(-self.moved, kind="stable")
        self.others = np.full(self.k, self.moved[far[0]])  # the farthest way that another one went
        self.others[far[0]] = self.moved[far[1]] if self.k > 1 else 0.0


def first_search(x: np.ndarray, cs: Centroids):
    """Assignment, second-nearest and bounds without any knowledge."""
    d = np.stack([squared(x, c) for c in cs.c], axis=1)
    a = d.argmin(axis=1)
    rows = np.arange(len(x))
    near = d[rows, a]
    if cs.k == 1:
        return a, a.copy(), _root_up(near), np.full(len(x), np.inf, np.float32)
    rest = d.copy()
    rest[rows, a] = d.max() + 1
    b = rest.argmin(axis=1)
    return a, b, _root_up(near), _root_down(rest[rows, b])


def shallot_search(x: np.ndarray, cs: Centroids, a: np.ndarray, b: np.ndarray, up: np.ndarray, low: np.ndarray):
    """The next assignment, second-nearest and bounds of the rows of ``x``."""
    a, b, up, low = a.copy(), b.copy(), up.astype(np.float64), low.astype(np.float64)
    up, low = np.nextafter(up + cs.moved[a], np.inf), np.nextafter(low - cs.others[a], -np.inf)
    todo = np.flatnonzero(up >= np.maximum(low, cs.half[a]))
    near = squared(x[todo], cs.c[a[todo]])  # a tight upper bound
    up[todo] = _root_up(near)
    left = up[todo] >= np.maximum(low[todo], cs.half[a[todo]])
    todo, near = todo[left], near[left]
    if len(todo) and cs.k > 1:
        v, one, two = x[todo], a[todo], b[todo]
        second = squared(v, cs.c[two])
        swap = (second < near) | ((second == near) & (two < one))
        near, second = np.where(swap, second, near), np.where(swap, near, second)
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        start, other = one.copy(), two.copy()  # the ball's centre is the closer of the two
        reach = _root_up(near).astype(np.float64)
        live = np.arange(len(todo))
        for step in range(cs.k - 1):
            c = cs.order[start[live], step]
            inside = cs.gap[start[live], c] <= reach[live] + _root_up(second[live])
            live, c = live[inside], c[inside]  # gaps grow and the second best only gets nearer
            if not len(live):
                break
            new = c != other[live]
            at, c = live[new], c[new]
            d = squared(v[at], cs.c[c])
            first = (d < near[at]) | ((d == near[at]) & (c < one[at]))
            then = ~first & ((d < second[at]) | ((d == second[at]) & (c < two[at])))
            f, t = at[first], at[then]
            second[f], two[f] = near[f], one[f]
            near[f], one[f] = d[first], c[first]
            second[t], two[t] = d[then], c[then]
        a[todo], b[todo] = one, two
        up[todo], low[todo] = _root_up(near), _root_down(second)
    to32 = lambda y, way: np.nextafter(y.astype(np.float32), np.float32(way))
    return a, b, to32(up, np.inf), to32(low, -np.inf)


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, dim: int) -> list[dict]:
    """What a block changes in the centroids' counts and sums."""
    out = []
    moved = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    for c in np.unique(np.concatenate([new[moved], old[moved] if old is not None else new[:0]])).tolist():
        come = moved[new[moved] == c]
        gone = moved[old[moved] == c] if old is not None else come[:0]
        total = x[come].sum(axis=0) - x[gone].sum(axis=0) if len(come) + len(gone) else [0] * dim
        out.append({"c": c, "n": len(come) - len(gone), "s": [int(t) for t in total]})
    return out


def _pack(dim: int, scale: int):
    def run(batches):
        from pyspark import TaskContext

        no, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            ids = pa.concat_arrays([b.column(0) for b in held])
            x = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for b in held])
            return pa.RecordBatch.from_arrays([pa.array([no]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                               pa.array([integers(x, scale).tobytes()], pa.binary())], ["block", "ids", "x"])
        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - size)
                batch = batch.slice(len(part))
                held.append(part)
                size += len(part)
                if size == BLOCK:
                    yield block()
                    no, held, size = no + 1, [], 0
        if size:
            yield block()
    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> str:
    """``df`` as a table of the session, bucketed by block, in the shared folder."""
    spark = df.sparkSession
    held = f"{name}_{os.getpid()}_{os.urandom(6).hex()}"
    (df.write.option("path", scratch_path(spark, name)).option("compression", "zstd")
     .bucketBy(buckets, "block").sortBy("block").saveAsTable(held))
    return held


STATE = "block long, a binary, b binary, up binary, low binary, changes array<struct<c int, n long, s array<long>>>"


def _round(dim: int, cs: Centroids):
    """A round over blocks (block, x[, a, b, up, low]): the next state of each."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.int64).reshape(-1, dim)
                v = _exact(x)
                old = None
                if "a" in row:
                    old, b = (np.frombuffer(row[n], np.int32).astype(np.int64) for n in "ab")
                    found = shallot_search(v, cs, old, b, *(np.frombuffer(row[n], np.float32) for n in ("up", "low")))
                else:
                    found = first_search(v, cs)
                a, b, up, low = found
                yield pa.RecordBatch.from_pylist([{
                    "block": row["block"], "a": a.astype(np.int32).tobytes(), "b": b.astype(np.int32).tobytes(), "up": up.tobytes(),
                    "low": low.tobytes(), "changes": _changes(v, old, a, dim)}], RESULT)
    return run


RESULT = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("a", "b", "up", "low")),
                    ("changes", pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])))])


def _assigned(dim: int, cs: Centroids):
    """(vec_id, cluster, distance) of the vectors of blocks with their last state."""
    def run(batches):
        for batch in batches:
            for n in range(len(batch)):
                get = lambda name: batch.column(name)[n].as_py()  # noqa: B023, E731
                v, a = _exact(np.frombuffer(get("x"), np.int64).reshape(-1, dim)), np.frombuffer(get("a"), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[n].values, pa.array(a), pa.array(squared(v, cs.c[a]).tolist(), pa.int64())],
                                                 ["vec_id", "cluster", "distance"])
    return run


def seeds(kept: DataFrame, k: int, dim: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors whose SHA-256 of "seed:vec_id" is smallest, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return integers(np.array([r.v for r in rows], np.float64).reshape(-1, dim), scale)


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
            ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each vector, the final centroids)."""
    spark: SparkSession = vectors.sparkSession
    kept = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), dim))
    n = kept.count()
    schema = "vec_id long, cluster int, distance long"
    now = seeds(kept, k, dim, seed, scale)
    if not n:
        return spark.createDataFrame([], schema), now
    buckets = max(-(-n // BUCKET), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK)))
    packed = kept.mapInArrow(_pack(dim, scale), "block long, ids array<long>, x binary")
    tables = [_bucketed(packed.repartition(buckets, "block"), "vectors", buckets)]
    try:
        blocks = spark.table(tables[0])
        cs, totals = Centroids(now), [[0] * (dim + 1) for _ in now]
        for turn in range(rounds + 1):
            rows = blocks.select("block", "x")
            if turn:
                rows = rows.join(spark.table(tables[-1]).drop("changes"), "block")
            tables.append(_bucketed(rows.mapInArrow(releasing(_round(dim, cs)), STATE), "bounds", buckets))
            if turn == rounds:
                break
            ch = spark.table(tables[-1]).select(F.explode("changes").alias("ch"))
            sums = [F.sum(F.col("ch.s")[i]).alias(f"s{i}") for i in range(dim)]
            for r in ch.groupBy("ch.c").agg(F.sum("ch.n").alias("n"), *sums).collect():  # a row for each centroid
                totals[r.c] = [t + d for t, d in zip(totals[r.c], r[1:])]
            then = np.array([[s // t[0] for s in t[1:]] if t[0] else row for t, row in zip(totals, now.tolist())], np.int64)
            cs, now = Centroids(then, now), then
        last = blocks.join(spark.table(tables[-1]).select("block", "a"), "block").select("ids", "x", "a")
        return stored(last.mapInArrow(releasing(_assigned(dim, cs)), schema), "assigned"), now
    finally:
        for name in tables:  # the session's entry only: the files stay in the shared folder
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def report(vectors: DataFrame) -> DataFrame:
    found, final = cluster(vectors)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each centroid
    rows = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for c, row in enumerate(final.tolist()) if c in inertia]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
