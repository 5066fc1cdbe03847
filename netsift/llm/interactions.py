"""Filter interaction audit: what each filter removes in every order of the filters.

A filter set of m filters has 2**m coalitions. Each document's failures are one
m-bit mask; from the counts of masks the removals of all coalitions are
tabulated (a coalition removes what fails any of its filters). Everything else
follows from that table, which has 2**m rows for each part:

* the counts of a step are differences of two coalitions: those of the filters
  up to the step and of the filters before it;
* Shapley values are the solution of the least-squares problem of m unknowns
  over the proper coalitions, weighted by the Shapley kernel, with the
  efficiency constraint (the values add up to the removal of all filters). Its
  normal equations with the constraint's multiplier don't depend on the data,
  so they are solved once, in rationals, for every coalition's unit vector;
  the rational solution, times m!, is a table of integers that is applied to
  the tabulated removals.

Nothing larger than one row for each document crosses a shuffle, texts never do:
equal texts meet by their SHA-256, after rows of one text, part and label have
been added up, so copies of one text don't meet in one task row by row.

Defined results: a null text counts as empty (no words, no failure of B, C, D);
a null lang is the part ''; a document is good (toxic) if any row of ``labels``
with its doc_id has quality (toxic) 1, null flags are not; rows with a null
doc_id have no labels, and are neither failures of E nor the text that others
repeat; rows with equal doc_id and text don't repeat each other. An empty table
has no parts and gives no rows.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest): failures of A to D as bits 0 to 3, and the text's hash."""
    text, size = F.col("text"), F.size("words").cast("long")
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select("*", F.array_remove(F.split(text, BLANKS), "").alias("words"))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [size < MIN_WORDS,
             100 * F.size(F.array_distinct("words")).cast("long") < 50 * size,
             100 * upper > 3 * F.char_length(text).cast("long"),
             text.rlike(r"[#$%&*|]")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return cut.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))


def tally(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by the filters they fail.
    Bit 4 of the mask, E, is a text that a smaller doc_id has too."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(flag("quality").alias("good"), flag("toxic").alias("toxic")))
    keys = ["digest", "part", "bits", "good", "toxic"]
    rows = text_failures(docs)
    known = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    unknown = rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    # Rows by id first (they lie together after the join), then what copies of a text in one part have in common.
    by_id = (known.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("c"))
             .unionByName(unknown.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("c"))))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    texts = by_id.groupBy(keys).agg(F.sum("c").alias("n"), least.alias("least"),
                                    F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    new = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.c")).otherwise(0)
    split = texts.withColumn("new", new).select("part", "bits", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), F.col("new").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("new")).alias("n")))).alias("s"))
    n = F.col("s.n")
    return (split.groupBy("part", (F.col("bits") + F.col("s.e")).alias("mask"))
            .agg(F.sum(n).alias("documents"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))
            .where(F.col("documents") > 0))


def coalitions(masks: DataFrame, m: int = len(LETTERS)) -> DataFrame:
    """(part, coalition, documents, removed, good, toxic): for each of the 2**m sets of
    filters the documents of the part, and those that fail any filter of the set."""
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    lost = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    return (masks.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))).alias("coalition"))
            .groupBy("part", "coalition").agg(F.sum("documents").alias("documents"), lost("documents").alias("removed"),
                                              lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
            .select("part", "coalition", "documents", "removed", F.col("good_lost").alias("good"), F.col("toxic_lost").alias("toxic")))


def shapley_table(m: int) -> list[list[int]]:
    """[filter][coalition] -> the coefficient of a coalition's value in m! times the
    filter's Shapley value: the solution of the constrained normal equations

        sum_S w(S) z_S (z_S . phi - v(S)) + multiplier * 1 = 0,   1 . phi = v(all),

    over proper, non-empty coalitions S with indicators z_S and kernel weights w(S),
    by elimination in rationals with a right-hand side for each coalition."""
    every = range(1 << m)
    z = [[s >> i & 1 for i in range(m)] for s in every]
    size = [sum(x) for x in z]
    weight = [Fraction(m - 1, comb(m, c) * c * (m - c)) if 0 < c < m else Fraction(0) for c in size]
    rows = [[sum((weight[s] * z[s][i] * z[s][j] for s in every), Fraction(0)) for j in range(m)] + [Fraction(1)]
            + [weight[s] * z[s][i] for s in every] for i in range(m)]
    rows.append([Fraction(1)] * m + [Fraction(0)] + [Fraction(size[s] == m) for s in every])
    for col in range(m + 1):
        pivot = next(r for r in range(col, m + 1) if rows[r][col])
        rows[col], rows[pivot] = rows[pivot], rows[col]
        rows[col] = [x / rows[col][col] for x in rows[col]]
        for r in range(m + 1):
            if r != col and rows[r][col]:
                by = rows[r][col]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[col])]
    scaled = [[x * factorial(m) for x in row[m + 1:]] for row in rows[:m]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("Shapley coefficients times m! are integers")
    return [[int(x) for x in row] for row in scaled]


def _orders(letters: str) -> Column:
    """Every (order, step) with its filter and the coalitions it joins, as one constant array."""
    every, out = (1 << len(letters)) - 1, []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(letters[i] for i in order), "step": step, "filter": f, "before": before,
                        "after": before | 1 << f, "alone": 1 << f, "others": every & ~(1 << f)})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order string, step int, filter int, before int, "
                                               "after int, alone int, others int>>")


def steps(values: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the table of ``coalitions``."""
    m = len(letters)
    by_part = values.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("coalition", "documents", "removed", "good", "toxic"))).alias("v"))  # 2**m entries
    apply = lambda cs: F.aggregate(F.zip_with("v", F.array(*[F.lit(c).cast("long") for c in cs]), lambda x, c: x["removed"] * c),
                                   F.lit(0).cast("long"), lambda a, x: a + x)
    rows = (by_part.select("part", "v", F.array(*[apply(cs) for cs in shapley_table(m)]).alias("phi"))
            .select("part", "v", "phi", F.explode(_orders(letters)).alias("o")))
    at = lambda name: F.element_at("v", F.col(f"o.{name}") + 1)
    before, after = at("before"), at("after")
    removed = after["removed"] - before["removed"]
    return rows.select(
        "part", "o.filter_order", "o.step", (after["documents"] - after["removed"]).alias("kept"), removed.alias("removed"),
        (at("alone")["removed"] - removed).alias("redundant"),
        (F.element_at("v", 1 << m)["removed"] - at("others")["removed"]).alias("unique_fails"),
        (after["good"] - before["good"]).alias("good_lost"), (after["toxic"] - before["toxic"]).alias("toxic_lost"),
        F.element_at("phi", F.col("o.filter") + 1).alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return steps(coalitions(tally(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))))
