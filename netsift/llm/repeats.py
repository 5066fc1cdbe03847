"""Removal of repeated substrings, from a sample of their places.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere
else, in its own text or another's. Only a sample of the suffixes is compared:

1. Sample. In each window of LENGTH bytes the smallest hash of a ``GRAM``-byte
   string marks one suffix (the leftmost of equals): equal windows mark it at the
   same place. Neighbouring windows with one mark are a run, one tuple
   (gram, context, text, first, last): about one for every 69 bytes. The context
   names all bytes its windows cover and the mark's place in them.
2. Grouping by Spark's external (spilling, partitioned) aggregation. A gram that
   occurs once clears its run: its windows are nowhere else. A context that
   occurs twice condemns its run as a whole.
3. For grams with several contexts only: the windows of each distinct
   context get their names, and those that two contexts share are repeated.
4. Spans of a text are merged, in a sorted and spilling window, and cut out.

This is a winnowing sample with grouping by hash, not external induced sorting: no
suffix is sorted and there are no common-prefix values. The README says why, with
figures. Names are 64-bit hashes.

Defined results: a null or empty text has no bytes, nothing removed, and the hash
of no bytes; texts shorter than LENGTH lose nothing; repeated rows are texts of
their own, so from LENGTH bytes on both lose everything; spans are of bytes and
may cut a character, so what is kept is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import releasing, stored, with_row_id
from netsift.llm.shingles import _BASE, _powers, mix, texts_of

LENGTH, GRAM = 200, 64
PIECE = 1 << 19  # window starts handled at once
BUCKET_WINDOWS = 200_000  # windows whose names are compared in one group
_VALUE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)
_pow = _inv = None


class _Names:
    """64-bit names of substrings of up to PIECE + LENGTH bytes of a text."""

    def __init__(self, b: np.ndarray):
        global _pow, _inv
        if _pow is None or len(_pow) <= len(b):
            n = max(PIECE + 2 * LENGTH, len(b))
            _pow, _inv = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        self.total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * _pow[:len(b)], dtype=np.uint64, out=self.total[1:])

    def of(self, start, end, salt: int):
        return mix((self.total[end] - self.total[start]) * _inv[start] + np.uint64(salt))


def _pieces(b: np.ndarray, length: int):
    """(offset, bytes) of pieces whose windows are, together, those of the text."""
    for at in range(0, max(0, len(b) - length + 1), PIECE):
        yield at, b[at:at + PIECE + length - 1]


def _runs(b: np.ndarray, length: int, gram: int):
    """(first, last, gram, context) of the runs of windows with one mark."""
    names = _Names(b)
    starts = np.arange(len(b) - gram + 1)
    g = names.of(starts, starts + gram, 1)
    low = (g & ~_PLACE) | starts.astype(np.uint64)  # the hash decides, then the place
    have, want = 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    mark = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(mark, prepend=-1))
    last = np.concatenate([first[1:], [len(mark)]]) - 1
    at = mark[first]
    context = mix(names.of(first, last + length, 2) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                  + (last - first).astype(np.uint64))
    return first, last, g[at], context


def _sample(length: int, gram: int):
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            out = []
            for i, t in zip(rid, texts_of(batch.column("text"))):
                for at, b in _pieces(np.frombuffer(t or b"", np.uint8), length):
                    first, last, g, context = _runs(b, length, gram)
                    out.append((np.full(len(first), i), first + at, last + at, g.view(np.int64), context.view(np.int64)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                for a in range(0, len(cols[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 100_000]) for c in cols], ["rid", "first", "last", "gram", "context"])
    return run


#: Flags of a named window: its context occurs once (so it is asked for), its
#: name was met again in the same task, it is already known to be repeated.
ALONE, TWICE, FOUND = 1, 2, 4
PACK = "bucket long, name binary, rid binary, at binary, flag binary"


def _pack(held: list, buckets: int):
    """Rows of PACK for the windows a task has named. Of windows with one name
    the first stands for all, so a name of any frequency is sent once a task."""
    name, rid, at, alone = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    first = np.ones(len(name), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(first) - 1
    lead, twice = np.empty(len(name), bool), np.empty(len(name), bool)
    lead[order], twice[order] = first, (np.bincount(group) > 1)[group]
    flag = (alone * ALONE + twice * TWICE).astype(np.uint8)
    flag[~lead] = FOUND
    keep = lead | alone
    name, rid, at, flag = name[keep], rid[keep], at[keep], flag[keep]
    place = mix(rid.view(np.uint64)) + (at >> 16).astype(np.uint64)  # a long text's are dealt over buckets too
    bucket = (mix(np.where(flag == FOUND, place, name)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, name, rid, at, flag = (x[order] for x in (bucket, name, rid, at, flag))
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cut[1:].tolist(), len(bucket)]
    blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut.tolist(), ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), blobs(name), blobs(rid), blobs(at.astype(np.int32)), blobs(flag)],
                                      ["bucket", "name", "rid", "at", "flag"])


def _windows(length: int, buckets: int):
    """The windows of the runs of each text, named and packed by buckets of names."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i, t, runs in zip(batch.column("rid").to_pylist(), texts_of(batch.column("text")), batch.column("runs").to_pylist()):
                b = np.frombuffer(t, np.uint8)
                for r in runs:  # a run covers less than two windows' bytes
                    part = b[r["first"]:r["last"] + length]
                    at = np.arange(r["last"] - r["first"] + 1)
                    held.append((_Names(part).of(at, at + length, 3), np.full(len(at), i), at + r["first"], np.full(len(at), r["alone"])))
                    n += len(at)
                if n >= 1 << 20:
                    yield _pack(held, buckets)
                    held, n = [], 0
        if held:
            yield _pack(held, buckets)
    return run


def _shared(key, t):
    """(rid, at) of the windows of a bucket that are repeated and asked for."""
    name, rid, at, flag = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (
        ("name", np.uint64), ("rid", np.int64), ("at", np.int32), ("flag", np.uint8)))
    found = flag == FOUND
    open_ = np.flatnonzero(~found)
    _, group, n = np.unique(name[open_], return_inverse=True, return_counts=True)
    again = (n > 1) | (np.bincount(group, flag[open_] & TWICE, len(n)) > 0)
    yes = open_[again[group] & ((flag[open_] & ALONE) > 0)]
    rows = np.concatenate([np.flatnonzero(found), yes])
    return pa.table({"rid": rid[rows], "at": at[rows].astype(np.int64)})


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans) of the texts of ``docs`` (rid, text; a scan) that lose bytes:
    ``spans`` are the merged (start, end) byte ranges, in order and apart."""
    runs = docs.select("rid", "text").mapInArrow(releasing(_sample(length, gram)), "rid long, first long, last long, gram long, context long")
    often = (runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"))
             .where(F.col("n") > 1).select("gram", (F.col("c0") != F.col("c1")).alias("mixed")))
    often = stored(often, "repeat-grams")  # a table: the join on a hot gram can then be split
    runs = stored(runs.join(often, "gram"), "repeat-runs")
    whole = runs.where(~F.col("mixed")).select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    # Where a gram has several contexts: one run stands for each of them.
    each = stored(runs.where("mixed").groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "last")).alias("one")), "repeat-contexts")
    again = each.where(F.col("n") > 1).select("gram", "context")
    copied = (runs.where("mixed").join(again, ["gram", "context"], "left_semi")
              .select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    asked = each.select("one.*", (F.col("n") == 1).alias("alone")).groupBy("rid").agg(
        F.collect_list(F.struct("first", "last", "alone")).alias("runs"))  # of one text
    total = each.agg(F.coalesce(F.sum(F.col("one.last") - F.col("one.first") + 1), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_WINDOWS))
    packed = docs.select("rid", "text").join(asked, "rid").select("rid", "text", "runs").mapInArrow(
        releasing(_windows(length, buckets)), PACK)
    found = stored(packed.groupBy("bucket").applyInArrow(_shared, "rid long, at long"), "repeat-windows").select(
        "rid", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return _joined(whole.unionByName(copied).unionByName(found)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _joined(spans: DataFrame) -> DataFrame:
    """(rid, start, end) of the spans with those that overlap or touch made one: what is
    collected of a text is its removed runs, not the windows that gave them."""
    by = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", (F.coalesce(reach < F.col("start"), F.lit(True))).cast("int"))
    return parted.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _cut(batches):
    for batch in batches:
        spans, kept, n = [], [], []
        for t, s in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
            t = bytes(t or b"")
            s = [(x["start"], x["end"]) for x in s or []]
            edge = [0, *(y for x in s for y in x), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))
            n.append(len(t))
            spans.append([{"start": a, "end": b} for a, b in s])
        yield pa.RecordBatch.from_arrays([
            batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["rid", "doc_id", "n_bytes", "spans", "kept", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, doc_id, n_bytes, spans (removed ranges), kept (what remains),
    kept_sha256 for each row of ``docs`` (doc_id, text), a table scan."""
    docs, rid = with_row_id(docs.select("doc_id", "text"))
    docs = docs.select(F.col(rid).alias("rid"), "doc_id", "text")
    spans = stored(repeated_spans(docs, length), "repeat-spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # One plan at every size: a broadcast of few spans would hold only for small tables.
    return docs.join(spans.hint("merge"), "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(
        releasing(_cut), f"rid long, doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"),
                                        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
