"""Benchmark decontamination by winnowing (DataFrame functions only).

A window is ``n`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window. Each ``n``-word window of a text is
fingerprinted by the smallest hash of the ``k``-word grams in it (winnowing:
equal windows have equal fingerprints, so no shared window can be missed).
A text keeps one fingerprint for each run of windows with the same minimum;
the fingerprints of documents and items are joined, and every hit is extended
to the run's windows and compared word by word with the item's windows.

Defined results: a null or empty text has no words and is not contaminated; a
null ``item_id`` counts as the empty string; items with the same id count
once; repeated document rows are judged one by one, each gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import small, stored, with_row_id, words

WINDOW, GRAM = 13, 8


def _ladder(df: DataFrame, col: str, length: int, join) -> DataFrame:
    """Replaces array ``col`` by the array of its windows of ``length`` entries,
    each combined from two halves that may overlap: log2(length) passes.

    Arrays made here are only exploded with ``posexplode_outer``: for the plain
    form Spark infers a size filter and pushes it down through all the passes,
    which writes the whole nested expression out anew for every reference."""
    have = 1
    while have < length:
        step = min(have, length - have)
        n = F.greatest(F.size(col) - step, F.lit(0))
        df = df.withColumn(col, F.zip_with(F.slice(col, F.lit(1), n), F.slice(col, F.lit(1 + step), n), join))
        have += step
    return df


def _gram_hashes(df: DataFrame, length: int) -> DataFrame:
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return _ladder(df, "h", length, lambda a, b: F.xxhash64(a, b))


def _window_minima(df: DataFrame, n: int, k: int) -> DataFrame:
    """Adds ``h``: for each window of ``n`` words, its smallest gram hash."""
    return _ladder(_gram_hashes(df, k), "h", n - k + 1, lambda a, b: F.least(a, b))


def _text_of(arr: Column | str, start: Column, n) -> Column:
    return F.array_join(F.slice(arr, start, n), " ")


def benchmark_windows(bench: DataFrame, n: int = WINDOW, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the distinct windows (win_id, fp, len, win) and of the
    items that hold each (win_id, item)."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         words(F.col("text")).alias("words")).where(F.size("words") > 0)
    full = (_window_minima(items.where(F.size("words") >= n), n, k)
            .select("item", "words", F.posexplode_outer("h").alias("p", "fp"))
            .select("item", "fp", F.lit(n).alias("len"), _text_of("words", F.col("p") + 1, n).alias("win")))
    short = (items.where(F.size("words") < n)
             .select("item", F.lit(None).cast("long").alias("fp"), F.size("words").alias("len"),
                     F.array_join("words", " ").alias("win")))
    held = stored(full.unionByName(short).distinct(), "bench-windows")
    wins = stored(held.groupBy("win").agg(F.min("fp").alias("fp"), F.min("len").alias("len"))
                  .withColumn("win_id", F.monotonically_increasing_id()), "bench-distinct")
    return wins, stored(held.join(wins.select("win", "win_id"), "win").select("win_id", "item"), "bench-items")


def _hits(docs: DataFrame, wins: DataFrame, n: int, k: int) -> DataFrame:
    """A row (rid, n_words, start, len, win_id) for each occurrence of a window
    in a document, and one with null ``start`` for each document."""
    one_task = small(wins, F.length("win") + 32)
    held = F.broadcast if one_task else (lambda d: d)
    fps = wins.where(F.col("fp").isNotNull()).select("fp").distinct().withColumn("known", F.lit(True))
    base = docs.select("rid", words(F.col("text")).alias("words"))

    # One row per run of windows with the same minimum, and row 0 for the document itself.
    runs = (_window_minima(base, n, k)
            .withColumn("at", F.concat(F.array(F.lit(0)), F.when(F.size("h") > 0, F.filter(
                F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1))),
                lambda i: (i == 1) | (F.get("h", i - 1) != F.get("h", i - 2)))).otherwise(F.array().cast("array<int>"))))
            .select("rid", "words", "h", "at", F.posexplode_outer("at").alias("j", "s"))
            .select("rid", F.size("words").alias("n_words"), "words", "s",
                    F.when(F.col("s") > 0, F.get("h", F.col("s") - 1)).otherwise(F.col("rid")).alias("fp"),
                    (F.coalesce(F.get("at", F.col("j") + 1), F.size("h") + 1) - F.col("s")).alias("n_starts")))
    cols = ["rid", "n_words", "s", "n_starts"]
    if one_task:  # the words are looked at only after the join
        met, arr, base_at = runs.join(held(fps), "fp", "left"), "words", F.col("s")
    else:  # each run takes the words it covers along, at most n - 1 beside its own
        around = F.slice("words", F.greatest(F.col("s"), F.lit(1)), F.when(F.col("s") > 0, F.col("n_starts") + n - 1).otherwise(0))
        met, arr, base_at = runs.select(*cols, "fp", around.alias("ctx")).join(fps, "fp", "left"), "ctx", F.lit(1)
    spell = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_starts") - 1, F.lit(0))),
                        lambda o: _text_of(arr, base_at + o, n))
    cand = (met.where((F.col("s") == 0) | F.col("known"))
            .select("rid", "n_words", "s", F.posexplode_outer(F.when(F.col("s") > 0, spell).otherwise(F.array(F.lit(None).cast("string")))).alias("o", "win"))
            .select("rid", "n_words", F.when(F.col("s") > 0, F.col("s") + F.col("o")).alias("start"), F.lit(n).alias("len"), "win"))

    # Items shorter than a window: every gram of their length is looked up.
    lengths = [r[0] for r in wins.where(F.col("len") < n).select("len").distinct().collect()]  # below n of them
    for length in sorted(lengths):
        keys = (wins.where(F.col("len") == length)
                .select(F.split("win", " ").alias("words")))
        keys = _gram_hashes(keys, length).select(F.get("h", F.lit(0)).alias("g")).distinct()
        grams = _gram_hashes(base, length).select("rid", "words", F.posexplode_outer("h").alias("p", "g"))
        if not one_task:
            grams = grams.select("rid", "g", "p", F.slice("words", F.col("p") + 1, length).alias("words"))
        at = F.col("p") + 1 if one_task else F.lit(1)
        cand = cand.unionByName(grams.join(held(keys), "g", "left_semi").select(
            "rid", F.lit(None).cast("int").alias("n_words"), (F.col("p") + 1).alias("start"),
            F.lit(length).alias("len"), _text_of("words", at, length).alias("win")))
    # A document's own row joins by a key of its own: no words hold a line feed.
    cand = cand.withColumn("win", F.coalesce("win", F.concat(F.lit("\n"), F.col("rid").cast("string"))))
    return (cand.join(held(wins.select("win", "win_id")), "win", "left")
            .where(F.col("start").isNull() | F.col("win_id").isNotNull())
            .select("rid", "n_words", "start", "len", "win_id"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (rid, text): rid, n_words, n_hit (words
    inside an occurrence of any window), n_items, items, contaminated (a
    twentieth of the words or more are hit)."""
    wins, items = benchmark_windows(bench, n, k)
    hits = stored(_hits(docs, wins, n, k), "bench-hits")
    found = hits.where(F.col("start").isNotNull())
    n_hit = hit_words(found).groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    in_items = (found.select("rid", "win_id").distinct().join(items, "win_id").select("rid", "item").distinct()
                .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = hits.where(F.col("start").isNull()).select("rid", F.col("n_words").cast("long"))
    out = out.join(n_hit, "rid", "left").join(in_items, "rid", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
                           "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"),
                            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def hit_words(found: DataFrame) -> DataFrame:
    """The distinct word positions (rid, pos) inside occurrences."""
    return (found.select("rid", "start", "len").distinct()
            .select("rid", F.explode_outer(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct())


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows; all columns are kept."""
    docs, rid = with_row_id(docs)
    judged = contamination(docs.select(F.col(rid).alias("rid"), "text"), bench)
    bad = stored(judged.where("contaminated").select(F.col("rid").alias(rid)), "contaminated")
    return docs.join(bad, rid, "left_anti").drop(rid)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The digest of the registered query: one row per document."""
    docs, rid = with_row_id(docs.select("doc_id", "text"))
    judged = contamination(docs.select(F.col(rid).alias("rid"), "text"), bench)
    return (docs.select("doc_id", F.col(rid).alias("rid")).join(judged, "rid")
            .select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"))
