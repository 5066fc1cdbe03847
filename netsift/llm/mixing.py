"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's mean repetition rate is ``total * weight / documents`` (weights are
scaled to sum to one over the sources present). Each document draws its number
of copies from a Poisson distribution with that mean: a uniform number from a
hash of seed and doc_id is inverted through the source's cumulative
probabilities. Copies are exploded and dealt out and sorted by a hash of seed,
doc_id and copy: a global shuffle in one exchange. A rerun gives the same rows.

Means above ``CHUNK`` are the sum of several draws with equal smaller means.

Defined results: a null source counts as the empty name, a null doc_id as the
text "null"; rows with equal doc_id and source draw the same number of copies;
an empty table stays empty; sources without a given weight have weight 0 and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import fresh, small, stored

SEED, POWER, CHUNK = "mix-1", 0.7, 32.0
#: Terms of the cumulative sum: beyond them less than 2^-52 remains for means up to CHUNK.
TERMS = 112
SALT = 16


def _source(c="source") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, documents, rate) of each source. Without ``weights`` a source
    weighs its documents to the power of POWER: large ones shrink, small ones grow."""
    n = stored(docs.groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("documents")), "sources")
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("documents").cast("double"), F.lit(POWER)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        n = n.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    all_w, all_n = n.agg(F.sum("weight"), F.sum("documents")).first()
    want = float(all_n or 0 if total is None else total)
    return n.select("source", "documents", (F.lit(want) * F.col("weight") / F.lit(all_w or 1.0) / F.col("documents")).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda s: s["c"])


def _uniform(seed: str, doc_id: Column, draw: Column) -> Column:
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None,
            seed: str = SEED) -> tuple[DataFrame, str]:
    """The mixed and shuffled copies, with the columns of ``docs`` and the
    copy's number (from 1) in the column that is also named."""
    rate = rates(docs, weights, total).withColumn("draws", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    rate = stored(rate.withColumn("below", _cumulative(F.col("rate") / F.col("draws"))), "rates")
    name = {c: fresh(docs, c) for c in ("_mix_source", "_mix_draws", "_mix_below", "_mix_salt", "_mix_key", "copy_no")}
    s, d, b, salt, key, copy = name.values()
    rate = rate.select(F.col("source").alias(s), F.col("draws").alias(d), F.col("below").alias(b))
    docs_s = docs.withColumn(s, _source())
    if small(rate, F.lit(8 * TERMS + 64) + F.length(s)):
        met = docs_s.join(F.broadcast(rate), s)
    else:  # a hot source is dealt over SALT keys
        rate = rate.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = docs_s.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(rate, [s, salt]).drop(salt)
    copies = F.aggregate(F.sequence(F.lit(1), F.col(d)), F.lit(0), lambda n, j: n + F.size(
        F.filter(b, lambda c: c <= _uniform(seed, F.col("doc_id"), j))))
    out = met.withColumn(copy, copies).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    out = out.drop(s, d, b).withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(copy)))
    return out.repartition(key).sortWithinPartitions(key).drop(key), copy


def report(docs: DataFrame) -> DataFrame:
    out, copy = mixture(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return out.withColumnRenamed(copy, "copy_no")


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture with the columns of documents alone."""
    out, copy = mixture(docs)
    return out.drop(copy)


#: DuckDB's version of ``report``: copies are counted against the same cumulative sums.
ORACLE_SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS documents FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(documents) FROM n)::DOUBLE * pow(documents::DOUBLE, {POWER})
             / (SELECT sum(pow(documents::DOUBLE, {POWER})) FROM n) / documents AS rate FROM n),
m AS (SELECT s, greatest(ceil(rate / {CHUNK}), 1)::INT AS draws, rate / greatest(ceil(rate / {CHUNK}), 1) AS mean FROM r),
c AS (SELECT s, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM m
      UNION ALL SELECT s, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM c WHERE k < {TERMS}),
l AS (SELECT s, list(below ORDER BY k) AS bs FROM c GROUP BY s),
d AS (SELECT doc_id, text, lang, source, n_chars, bs, draws FROM documents
      JOIN l ON l.s = coalesce(source, '') JOIN m ON m.s = l.s),
x AS (SELECT *, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(bs, lambda b: b <=
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::BIGINT
      / {float(1 << 52)})))) AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies::BIGINT + 1))::INT AS copy_no FROM x WHERE copies > 0
"""
