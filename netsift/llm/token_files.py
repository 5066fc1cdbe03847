"""Token-ID files: canonical length-limited Huffman codes in independent blocks.

Writing: documents are range-partitioned and sorted by doc_id, encoded by the
tokenizer with an end id after each, and the ids stored; global id counts give
one code; each partition's ids are coded in blocks of whole documents of at
least ``BLOCK_TOKENS`` ids. A token table is a folder of three Parquet tables
(so any store Spark writes to will do, with Spark's commit): ``code`` (id, bits),
``blocks`` (part, block, doc ids, ids per document, bit-offset checkpoints,
payload) and ``starts`` (part, block, ids before the block).

Reading: blocks are decoded independently, all checkpoints of a block at once.

Defined results: a null text counts as empty and has the end id alone; null ids
sort first; rows with equal ids are written next to each other, in the order of
a hash of their text; an empty table has no blocks.
"""

from __future__ import annotations

import array
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.llm.common import releasing, stored
from netsift.llm.huffman import Code, code_lengths
from netsift.llm.lookup import Table, eligible
from netsift.llm.pretokens import Cache, Pretokens, steps
from netsift.session import scratch_path

END_ID = 1
BLOCK_TOKENS = 1 << 17
TEXT_STEP = 1 << 18  # characters looked up at once
BLOCKS = ("part int, block long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
          "checkpoints array<long>, payload binary")
_TABLES: dict[str, tuple[Table, Cache]] = {}  # per worker process


class _Bytes:
    """Ids as bytes, two an id where the whole vocabulary fits."""

    def __init__(self, pre: Pretokens, end_id: int):
        size = pre.model.get_piece_size() if pre.piece else pre.model.get_vocab_size()
        self.kind, self.mark = ("H", b"\2") if max(size - 1, end_id) < 65536 else ("I", b"\4")
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")

    def __call__(self, ids: list[int]) -> bytes:
        return array.array(self.kind, ids).tobytes()


def _tokenize(path: str, end_id: int):
    def run(batches):
        pre, seq = Pretokens.load(path), 0
        as_bytes = _Bytes(pre, end_id)
        if path not in _TABLES:
            _TABLES[path] = (Table(pre), Cache(pre, as_bytes))
        table, cache = _TABLES[path]
        start, end = as_bytes.mark, as_bytes([end_id])
        for batch in batches:
            ids = []
            for _, texts in steps(batch.column("text").to_pylist(), TEXT_STEP):
                fast = [eligible(t, pre) for t in texts]
                found, n = table.encode([t.lower().encode() for t, ok in zip(texts, fast) if ok])
                raw, width = found.astype(as_bytes.dtype).tobytes(), as_bytes.dtype.itemsize
                at, one_by_one = 0, iter(_each([t for t, ok in zip(texts, fast) if not ok], pre, cache, as_bytes))
                sizes = iter((n * width).tolist())
                for ok in fast:
                    if ok:
                        size = next(sizes)
                        ids.append(start + raw[at:at + size] + end)
                        at += size
                    else:
                        ids.append(start + next(one_by_one) + end)
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(range(seq, seq + len(ids)), pa.int64()),
                                              batch.column("doc_id"), pa.array(ids, pa.binary())], ["part", "seq", "doc_id", "ids"])
            seq += len(ids)
    return run


def _each(texts: list[str], pre: Pretokens, cache: Cache, as_bytes: _Bytes) -> list[bytes]:
    """The ids of texts that the table can't take: by pre-tokens, or whole by the library."""
    words = [pre.cut(t) for t in texts]
    whole = iter(pre.encode([t for t, w in zip(texts, words) if w is None]))
    return [as_bytes(next(whole)) if w is None else b"".join(map(cache.__getitem__, w)) for w in words]


def _unpack(packed: bytes) -> np.ndarray:
    """The ids of a row; its first byte tells the bytes an id takes."""
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1)


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        packed = batch.column("ids").to_pylist()
        for width in (2, 4):
            ids = np.frombuffer(b"".join(memoryview(x)[1:] for x in packed if x[0] == width), f"<u{width}")
            n = np.bincount(ids, minlength=len(total))
            n[:len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _blocks(symbols: np.ndarray, bits: np.ndarray, block_tokens: int):
    def close(code, part, no, docs, ids):
        every = np.concatenate(ids)
        payload, points = code.encode(every)
        return {"part": part, "block": no, "n_tokens": len(every), "doc_ids": docs, "doc_tokens": [len(x) for x in ids],
                "checkpoints": points.tolist(), "payload": payload}

    def run(batches):
        code, part, no, docs, ids, held = Code(symbols, bits), None, 0, [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
        for batch in batches:
            for p, d, x, at in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids", "seq"))):
                if held and (p != part or held >= block_tokens):
                    yield pa.RecordBatch.from_pylist([close(code, part, no, docs, ids)], schema)
                    docs, ids, held = [], [], 0
                if not held:
                    part, no = p, at
                docs.append(d)
                ids.append(_unpack(x))
                held += len(ids[-1])
        if held:
            yield pa.RecordBatch.from_pylist([close(code, part, no, docs, ids)], schema)
    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS,
                 order: str | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as a token table at ``out``, in ascending order
    of ``order``, a column, or else of doc_id."""
    spark = docs.sparkSession
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                         F.col(order or "doc_id").alias("place")).withColumn("h", F.xxhash64("text")))
    dealt = (dealt.repartitionByRange(F.col("place").asc_nulls_first(), "h")
             .sortWithinPartitions(F.col("place").asc_nulls_first(), "h")
             .select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    ids = stored(dealt.mapInArrow(releasing(_tokenize(path, end_id)), "part int, seq long, doc_id long, ids binary"), "ids")

    counts = ids.select("ids").mapInArrow(releasing(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = counts.sort_values("id")
    symbols, bits = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(s), int(b)) for s, b in zip(symbols, bits)], "id long, bits int").coalesce(1).write.parquet(f"{out}/code")

    # A file is read in its order, maybe by several tasks; a block is named by its first document's place.
    ids.mapInArrow(releasing(_blocks(symbols, bits, block_tokens)), BLOCKS).write.parquet(f"{out}/blocks")
    heads = spark.read.parquet(f"{out}/blocks").select("part", "block", "n_tokens")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # The sums of the partitions (one row each) are added up in order.
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    (heads.withColumn("inside", F.coalesce(before, F.lit(0))).join(parts.select("part", "base"), "part")
     .select("part", "block", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{out}/starts"))


def _decoder(spark: SparkSession, path: str) -> Code:
    code = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    return Code(code["id"].to_numpy(), code["bits"].to_numpy())


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a token
    table; ``ids`` are little-endian unsigned 32-bit integers."""
    code = _decoder(spark, path)

    def run(batches):
        for batch in batches:
            for part, no, n, doc_ids, sizes, points, payload in zip(*(c.to_pylist() for c in batch.columns)):
                every = code.decode(payload, np.array(points, np.int64), n).astype("<u4")
                sizes = np.array(sizes, np.int64)
                ends = np.cumsum(sizes)
                raw = [every[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
                cols = [pa.array([part] * len(raw), pa.int32()), pa.array([no] * len(raw), pa.int64()), pa.array(doc_ids, pa.int64()),
                        pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(releasing(run), schema)
    starts = spark.read.parquet(f"{path}/starts")
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def report(docs: DataFrame, path: str, order: str | None = None) -> DataFrame:
    out = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, order=order)
    return read_tokens(docs.sparkSession, out, with_ids=False)
