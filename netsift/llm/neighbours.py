"""Approximate nearest neighbours by largest inner product.

Distinct vectors are dealt over shards of ``SHARD`` vectors, by a hash; each
shard's graph (``hnsw.Graph``) is built once and stored as a row of flat arrays.
Queries are dealt over blocks of ``QUERY_ROWS``, by a hash; every block meets
every graph of its length, a pair at a time, and the shards' best are merged. Equal vectors are one node with the smallest vec_ids
that any answer could use. Scores are computed again from the original vectors
in double precision, and only those are returned.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, nor do rows with a null vec_id; vectors meet
only those of their own length; a query never gets rows with its own vec_id, and
repeated (vec_id, vector) rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import prepare, releasing, stored
from netsift.llm.hnsw import Graph

K, SHARD = 20, 16384
#: Wide enough for vectors without any structure: recall in a full shard of Gaussian ones is tested.
BEAM = 400
QUERY_ROWS, QUERY_BLOCK = 4096, 512  # queries of a stored block, and those that walk a graph together
GRAPH_PARTS, BLOCK_PARTS, BLOCKS_EACH = 1024, 64, 8


def usable(v: Column) -> Column:
    """Non-null, finite in every component and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers, without Python objects."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _built(key, t):
    """A shard as one row: vectors, ids and their number for each node, and the graph."""
    dim = key[0].as_py()
    vec, ids = _matrix(t.column("v"), dim), t.column("ids").combine_chunks()
    size, ids = ids.value_lengths().to_numpy().astype(np.int64), ids.flatten().to_numpy()
    at = np.cumsum(size) - size
    order = np.argsort(ids[at], kind="stable")  # the same graph for any order of the rows
    vec, (ids, size) = vec[order], _taken(ids, at[order], size[order])
    layers = Graph(vec).layers
    flat = {"vecs": vec.astype(np.float64), "ids": ids.astype(np.int64), "sizes": size,
            "layers": np.array([x for nodes, near in layers for x in near.shape], np.int64),
            "nodes": np.concatenate([nodes for nodes, _ in layers]).astype(np.int64),
            "links": np.concatenate([near.ravel() for _, near in layers]).astype(np.int32)}
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
                     **{c: pa.array([x.tobytes()], pa.binary()) for c, x in flat.items()}})


GRAPHS = "dim int, shard int, vecs binary, ids binary, sizes binary, layers binary, nodes binary, links binary"


def _block(key, t):
    """A block of queries as one row."""
    q = np.ascontiguousarray(_matrix(t.column("v"), key[0].as_py()), np.float64)
    return pa.table({"q_dim": pa.array([key[0].as_py()], pa.int32()),
                     "q_ids": pa.array([t.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "q_vecs": pa.array([q.tobytes()], pa.binary())})


def _taken(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` from ``start`` on, one after another, and their sizes."""
    end = np.cumsum(size)
    return ids[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)], size


def _search(k: int, beam: int):
    def answers(graph, vec, ids, size, q_ids, q):
        start = np.cumsum(size) - size
        for a in range(0, len(q), QUERY_BLOCK):
            for me, one, nodes in zip(q_ids[a:a + QUERY_BLOCK], q[a:a + QUERY_BLOCK], graph.search(q[a:a + QUERY_BLOCK], max(beam, k + 1), k + 1)):
                nodes = nodes[nodes >= 0]
                found, n = _taken(ids, start[nodes], size[nodes])
                score = np.repeat(vec[nodes] @ one, n)
                other = found != me
                found, score = found[other], score[other]
                best = np.lexsort((found, -score))[:k]
                yield np.full(len(best), me), found[best], score[best]

    def run(batches):
        shard, graph = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                def flat(name, kind):
                    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)
                dim = batch.column("dim")[i].as_py()
                if shard != (dim, batch.column("shard")[i].as_py()):
                    shard = dim, batch.column("shard")[i].as_py()
                    vec, ids, size = flat("vecs", np.float64).reshape(-1, dim).copy(), flat("ids", np.int64).copy(), flat("sizes", np.int64).copy()
                    layers, n, m = [], 0, 0
                    for rows, links in flat("layers", np.int64).reshape(-1, 2).tolist():
                        layers.append((flat("nodes", np.int64)[n:n + rows].copy(), flat("links", np.int32)[m:m + rows * links].reshape(rows, links).copy()))
                        n, m = n + rows, m + rows * links
                    graph = Graph.of(vec, layers)
                q_ids, q = flat("q_ids", np.int64), flat("q_vecs", np.float64).reshape(-1, dim)
                for a in range(0, len(q), QUERY_BLOCK):
                    rows = list(answers(graph, vec, ids, size, q_ids[a:a + QUERY_BLOCK], q[a:a + QUERY_BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) found for each row of
    ``queries`` (same columns): query_id, rank, vec_id, score."""
    def clean(df):
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
                .where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    prepare(vectors.sparkSession)  # a graph and a block of queries are one Arrow batch
    base = clean(vectors)
    # Equal vectors: only the k + 1 smallest ids can be in an answer (one may be the query's own).
    base = base.distinct().withColumn("h", F.xxhash64("v"))
    dealt = base.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))  # a hot vector is cut in two steps
    for keys in (["h", "v", "part"], ["h", "v"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    nodes = stored(dealt.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    sizes = {r.dim: r.n for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, max(1, -(-n // shard)))])
    dim = F.size("v")
    own = nodes.select("ids", "v", dim.alias("dim"), F.pmod(F.xxhash64("h"), F.element_at(shards, dim)).cast("int").alias("shard"))
    graphs = stored(own.groupBy("dim", "shard").applyInArrow(_built, GRAPHS), "graphs")
    q = stored(clean(queries).distinct().where(F.element_at(shards, dim).isNotNull()), "queries")
    asked = {r.dim: r.n for r in q.groupBy(dim.alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.create_map(*[F.lit(x) for d, n in asked.items() for x in (d, -(-n // QUERY_ROWS))])
    n_graphs, n_blocks = (sum(-(-n // rows) for n in of.values()) for of, rows in ((sizes, shard), (asked, QUERY_ROWS)))
    q = (q.select("vec_id", "v", dim.alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.element_at(blocks, dim)).alias("block"))
         .groupBy("dim", "block").applyInArrow(_block, "q_dim int, q_ids binary, q_vecs binary"))
    q = stored(q, "query-blocks")
    # Every task takes a partition of each side; neither side is copied for the pairs.
    pairs = (graphs.repartition(min(n_graphs, GRAPH_PARTS))
             .join(q.repartition(max(min(n_blocks, BLOCK_PARTS), -(-n_blocks // BLOCKS_EACH))).hint("shuffle_replicate_nl"),
                   (F.col("dim") <= F.col("q_dim")) & (F.col("dim") >= F.col("q_dim"))))
    found = pairs.mapInArrow(releasing(_search(k, beam)), "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", order).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
