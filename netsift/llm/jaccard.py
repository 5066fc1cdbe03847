"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its five-word shingles; texts with equal sets
   are one class (pre-aggregated by the set's digest), its first row stands for it.
2. MinHash signatures are cut into bands, band and row counts chosen for the
   target recall at the threshold. Representatives shuffle on band hashes; bands
   that gather the same representatives are kept once.
3. Every pair that meets in a band is verified on the full shingle sets. That is
   done per bucket, in blocks of a bounded number of rows and shingles, by
   products of incidence matrices: a block gives the number of links of each
   class and a forest of its links, never the pairs one by one. A pair that meets
   in several kept buckets counts in the first of them.
4. Connected components of the forests are the groups.

The result has a row per document: the group and the number of documents it is
linked to (Jaccard similarity at or above the threshold), copies included.

Defined results: a text without words (null, empty, punctuation) has no
shingles: no links, and a group of its own. Repeated rows are copies of each
other, also with equal ids.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import releasing, stored, with_row_id
from netsift.llm.components import components
from netsift.llm.shingles import MinHasher, choose_bands, shingles, texts_of, word_hashes

THRESHOLD, RECALL, ROWS = Fraction(4, 5), 0.9995, 4
#: Rows and shingles of a block (expected; blocks are dealt by a hash).
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2 << 20
#: Shingles held by more members than this go into the matrix product, others pair by pair.
DENSE = 24

PASS1 = "rid long, n_sh int, digest binary, keys array<long>"
UNIT = "a long, b long, links long"


def _sets(batch) -> list:
    return [None if t is None else shingles(word_hashes(t)) for t in texts_of(batch.column("text"))]


def _signatures(bands: int, rows: int):
    def run(batches):
        hasher = MinHasher(bands, rows)
        for batch in batches:
            sets = _sets(batch)
            have = [s is not None and len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("rid"),
                pa.array([len(s) if ok else 0 for s, ok in zip(sets, have)], pa.int32()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, have)], pa.binary()),
                pa.array([hasher.keys(s) if ok else None for s, ok in zip(sets, have)], pa.list_(pa.int64()))],
                ["rid", "n_sh", "digest", "keys"])
    return run


def _with_sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in _sets(batch)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """Yields (rows of left, common counts with every member of right)."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.concatenate([first, [len(every)]]))
    col = np.repeat(np.cumsum(counts > DENSE) - 1, counts).astype(np.int64)
    dense = np.repeat(counts > DENSE, counts)
    n_dense = int((counts > DENSE).sum())
    place = np.full(len(sets), -1, np.int64)  # of members, among those on the right
    place[right] = np.arange(len(right))
    # The members that hold each rare shingle, by how many do.
    rare = [owner[first[counts == size][:, None] + np.arange(size)] for size in np.unique(counts[(counts > 1) & (counts <= DENSE)])]
    d_owner, d_col = owner[dense], col[dense]
    by_owner = np.argsort(d_owner, kind="stable")
    d_owner, d_col = d_owner[by_owner], d_col[by_owner]

    def rows_of(members, lo, hi):  # incidence of the columns lo..hi
        at = np.full(len(sets), -1, np.int64)
        at[members] = np.arange(len(members))
        m = np.zeros((len(members), hi - lo), np.float32)
        ok = (at[d_owner] >= 0) & (d_col >= lo) & (d_col < hi)
        m[at[d_owner[ok]], d_col[ok] - lo] = 1
        return m

    step = 256
    wide = max(256, (4 << 20) // max(1, len(right)))
    for r0 in range(0, len(left), step):
        rows = left[r0:r0 + step]
        common = np.zeros((len(rows), len(right)), np.float32)
        for lo in range(0, n_dense, wide):
            hi = min(n_dense, lo + wide)
            common += rows_of(rows, lo, hi) @ rows_of(right, lo, hi).T
        common = common.astype(np.int32)
        here = np.full(len(sets), -1, np.int32)
        here[rows] = np.arange(len(rows))
        cells = []
        for who in rare:
            i, j = np.nonzero(here[who] >= 0)
            other = who[i]
            met = place[other]
            met[(other == who[i, j][:, None])] = -1
            cell = here[who[i, j]].astype(np.int64)[:, None] * len(right) + met
            cells.append(cell[met >= 0])
        if cells:
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            common.ravel()[at] += n.astype(np.int32)
        yield rows, common


def _verify(threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def unit(key, t):
        bucket, i, j = (k.as_py() for k in key)
        rep = t.column("rep").to_numpy()
        size = t.column("size").to_numpy()
        block = t.column("block").to_numpy()
        keys = np.array(t.column("keys").to_pylist(), np.int64)
        have = np.array(t.column("kept").to_pylist(), bool)
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        n_sh = np.array([len(s) for s in sets], np.int64)
        # Buckets before this one where two members also meet.
        here = int(np.flatnonzero((keys[0] == bucket) & have[0])[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        at_right = np.full(len(rep), -1, np.int64)
        at_right[right] = np.arange(len(right))
        links = np.zeros(len(rep), np.int64)
        parent = np.arange(len(rep))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges_a, edges_b = [], []
        for rows, common in _intersections(sets, left, right):
            near = common * (up + down) >= up * (n_sh[rows][:, None] + n_sh[right][None, :])
            for band in range(here):
                near &= ~((keys[rows, band][:, None] == keys[right, band][None, :])
                          & have[rows, band][:, None] & have[right, band][None, :])
            if i == j:
                near[np.arange(len(rows)), at_right[rows]] = False
            links[rows] += near @ size[right]
            if i != j:
                links[right] += near.T @ size[rows]
            for r, who in enumerate(rows):
                met = right[np.flatnonzero(near[r])]
                if not len(met):
                    continue
                # Follow parents in bulk; only the trees that differ need a link.
                top = met
                while True:
                    up1 = parent[top]
                    if (up1 == top).all():
                        break
                    top = up1
                parent[met] = top
                for x in np.unique(top):
                    a, b = root(int(who)), root(int(x))
                    if a != b:
                        parent[b] = a
                        edges_a.append(who)
                        edges_b.append(int(met[np.flatnonzero(top == x)[0]]))
        some = np.flatnonzero(links)
        a, b = np.array(edges_a, np.int64), np.array(edges_b, np.int64)
        return pa.table({"a": np.concatenate([rep[some], rep[a]]), "b": np.concatenate([rep[some], rep[b]]),
                         "links": np.concatenate([links[some], np.zeros(len(a), np.int64)])})
    return unit


def similarity_groups(docs: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL,
                      rows: int = ROWS) -> DataFrame:
    """(rid, label, links) for each row of ``docs`` (rid, text), a scan or stored
    table: ``label`` is the smallest rid of the group."""
    bands = choose_bands(float(threshold), recall, rows)
    docs = docs.select("rid", "text")
    sig = stored(docs.mapInArrow(releasing(_signatures(bands, rows)), PASS1), "signatures")
    classes = (sig.where(F.col("digest").isNotNull()).groupBy("digest")
               .agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("size")))
    classes = stored(classes, "classes")
    reps = sig.join(classes.withColumnRenamed("rep", "rid").select("rid", "size"), "rid").select(
        F.col("rid").alias("rep"), "size", "n_sh", "keys")

    met = reps.select("rep", "n_sh", F.explode("keys").alias("bucket"))
    who = F.xxhash64("rep")
    buckets = (met.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n_sh").cast("long")).alias("elements"),
        F.bit_xor(who).alias("x1"), F.bit_xor(F.xxhash64(who, F.lit(1))).alias("x2"), F.min("rep").alias("least"))
        .where(F.col("m") > 1).groupBy("m", "x1", "x2", "least")
        .agg(F.min("bucket").alias("bucket"), F.first("elements").alias("elements"))
        .select("bucket", F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("elements") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    # The kept buckets of each representative: at most one for each band.
    member = (met.join(buckets, "bucket").groupBy("rep")
              .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "blocks"))).alias("in")))
    member = stored(reps.join(member, "rep"), "members")

    texts = docs.withColumnRenamed("rid", "rep").join(member, "rep").select(
        "rep", "size", "keys", "in", "text")
    sets = (texts.select("rep", "size", "keys", F.transform("keys", lambda k: F.element_at("in", k).isNotNull()).alias("kept"),
                         F.map_entries("in").alias("in"), "text")
            .mapInArrow(releasing(_with_sets), "rep long, size long, keys array<long>, kept array<boolean>, "
                                    "in array<struct<key:long,value:int>>, shingles binary"))
    spread = (sets.select("*", F.explode("in").alias("e")).drop("in")
              .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("e.value")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("e.value") - 1)))
              .select(F.col("e.key").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "rep", "size", "keys", "kept", "block", "shingles"))
    found = stored(spread.groupBy("bucket", "i", "j").applyInArrow(_verify(threshold), UNIT), "links")

    links = found.where(F.col("links") > 0).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    label = components(found.where(F.col("links") == 0).select("a", "b"))
    per_class = (classes.join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
                         F.coalesce("label", "rep").alias("label")))
    return (sig.select("rid", "digest").join(per_class, "digest", "left")
            .select("rid", F.coalesce("label", "rid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the group; null only if all are
    null), n_links, for each document."""
    docs, rid = with_row_id(docs.select("doc_id", "text"))
    docs = docs.select("doc_id", "text", F.col(rid).alias("rid"))
    got = stored(similarity_groups(docs), "groups").join(docs.select("rid", "doc_id"), "rid")
    names = stored(got.groupBy("label").agg(F.min("doc_id").alias("class_id")), "names")  # else a hot label can't be split
    return got.join(names, "label").select("doc_id", "class_id", F.col("links").alias("n_links"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id (nulls
    last); documents without words all stay. All columns are kept."""
    docs, rid = with_row_id(docs)
    ids = docs.select(F.col(rid).alias("rid"), "doc_id", "text")
    got = stored(similarity_groups(ids), "groups").join(ids.select("rid", "doc_id"), "rid")
    first = stored(got.groupBy("label").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("keep")), "first")
    gone = stored(got.join(first, "label").where(F.col("rid") != F.col("keep"))
                  .select(F.col("rid").alias(rid)), "copies")
    return docs.join(gone, rid, "left_anti").drop(rid)
