"""Token counts by a map-side two-tier lookup.

First tier: the lengths (in tokens) of the most frequent pre-tokens, one table
of at most ``FREQUENT`` entries that is broadcast. It comes from counts over all
documents: each task sends its ``PER_TASK`` most frequent pre-tokens only, so no
pre-token is ever shuffled by itself. Second tier: a worker's cache of the rest,
bounded too; what neither holds is encoded by the library. Neither tier keeps a
pre-token above ``KEPT`` characters, so both are bounded in bytes. Either tier
only saves time: counts are the library's whatever they hold.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and null ids are counted like any other row.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import releasing
from netsift.llm.pretokens import Cache, Pretokens, steps

FREQUENT, PER_TASK, KEPT = 1 << 16, 1 << 14, 64
LIMIT = 2048
_CACHES: dict[str, Cache] = {}  # per worker process


class Tiers(dict):
    """The broadcast table; what it doesn't have comes from the worker's cache."""

    def __init__(self, table: dict[str, int], rest: Cache):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, word: str) -> int:
        return self.rest[word] if len(word) <= KEPT else len(self.rest.pre.ids(word))


def _short(words: list[str] | None) -> list[str]:
    if not words or max(map(len, words)) <= KEPT:
        return words or []
    return [w for w in words if len(w) <= KEPT]


def frequent_pretokens(docs: DataFrame, path: str) -> list[str]:
    def run(batches):
        pre, seen = Pretokens.load(path), Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                seen.update(_short(pre.cut(t or "")))
                if len(seen) > 20 * PER_TASK:  # a summary of bounded size: the rarest go
                    seen = Counter(dict(seen.most_common(5 * PER_TASK)))
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    counts = docs.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(FREQUENT).collect()]


def count_tokens(docs: DataFrame, path: str, key: str, limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    words = frequent_pretokens(docs, path) if Pretokens.load(path).pattern is not None else []
    table = {w: len(Pretokens.load(path).ids(w)) for w in words}
    held = sc.broadcast(table)

    def run(batches):
        pre = Pretokens.load(path)
        if path not in _CACHES:
            _CACHES[path] = Cache(pre, len)
        get = Tiers(held.value, _CACHES[path]).__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in steps(batch.column("text").to_pylist()):
                words = [pre.cut(t) for t in texts]
                n_bytes += [len(t.encode()) for t in texts]
                whole = iter(pre.encode([t for t, w in zip(texts, words) if w is None]))
                n_tokens += [len(next(whole)) if w is None else sum(map(get, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), "text")
            .mapInArrow(releasing(run), f"key {kind}, n_bytes long, n_tokens long, over_limit boolean"))


def report(docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), path, "doc_id").withColumnRenamed("key", "doc_id")
