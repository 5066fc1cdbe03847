"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of every training text per language (per task
first, so a language of any size adds few rows) and keeps those whose share of
the language's n-grams is at least ``MIN_SHARE``: at most 1 / MIN_SHARE for a
language, whatever the corpus holds, which bounds what is broadcast by the number
of languages. All languages share one Bloom filter that is sliced by bits: each slot holds a bit for each language, so AND-ing a gram's
slots returns every language that kept it. A text's hits are counted per
language and corrected for the filter's false positives; the largest corrected
share decides and is the score.

N-grams are three characters of the lower-cased text where all that isn't a
letter counts as one blank; words are padded, so any letter gives n-grams. Long
texts are read ``TEXT_STEP`` characters at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0;
ties go to the smaller language; without training rows everything is ``und``.
A null doc_id counts as the empty text: it is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import releasing, stored, with_row_id
from netsift.llm.shingles import mix

MIN_SHARE = 2e-5
SLOTS_PER_GRAM, PROBES = 16, 4
UND = "und"
#: A document below this score is in none of the learned languages.
REJECT_BELOW = 0.2
TEXT_STEP = 1 << 18  # characters handled at once

_letters: np.ndarray | None = None
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, text number of each) of some texts, in order."""
    parts = [np.frombuffer(f"\0{t.lower()}\0".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts if t is not None]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which = np.repeat(np.flatnonzero([t is not None for t in texts]), [len(p) for p in parts])
    c = np.concatenate(parts)
    letter = _is_letter()[c]
    c = np.where(letter, c, 0)
    run = letter | np.concatenate([[True], letter[:-1]]) | (np.diff(which, prepend=-1) != 0)  # blanks in a row are one
    c, letter, which = c[run].astype(np.uint64), letter[run], which[run]
    # The middle is a letter: windows never span two texts, which a blank starts and ends.
    g = mix(c[:-2] * _C[0] + c[1:-1] * _C[1] + c[2:] * _C[2])
    mid = letter[1:-1]
    return g[mid], which[1:-1][mid]


def gram_blocks(texts: list[str | None]):
    """``grams`` of some texts in blocks of bounded size: one, or those of a single long text."""
    if len(texts) != 1 or len(texts[0] or "") <= TEXT_STEP:
        yield grams(texts)
        return
    low, seq, was_letter = f"\0{texts[0].lower()}\0", np.zeros(0, np.uint64), True
    for at in range(0, len(low), TEXT_STEP):
        c = np.frombuffer(low[at:at + TEXT_STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[c]
        run = letter | np.concatenate([[was_letter], letter[:-1]])
        was_letter = bool(letter[-1])
        seq = np.concatenate([seq, np.where(letter, c, 0)[run].astype(np.uint64)])
        if len(seq) > 2:
            g = mix(seq[:-2] * _C[0] + seq[1:-1] * _C[1] + seq[2:] * _C[2])[seq[1:-1] > 0]
            yield g, np.zeros(len(g), np.int64)
            seq = seq[-2:]


def _steps(column):
    """Lists of texts of a bounded total length (or one longer text)."""
    at, size, out = 0, 0, []
    for t in column.to_pylist():
        if out and len(t or "") > TEXT_STEP:
            yield at, out
            at, size, out = at + len(out), 0, []
        out.append(t)
        size += len(t or "")
        if size >= TEXT_STEP:
            yield at, out
            at, size, out = at + len(out), 0, []
    if out:
        yield at, out


def _merge(held: list) -> list:
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    keys, at = np.unique(keys, return_inverse=True)
    return [(keys, np.bincount(at, counts).astype(np.int64))]


def _count(batches):
    held: dict[str, list] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for at, texts in _steps(batch.column("text")):
            here = langs[at:at + len(texts)]
            for g, which in gram_blocks(texts):
                for lang in set(here):
                    keys, n = np.unique(g[(here == lang)[which]], return_counts=True)
                    mine = held.setdefault(lang, [])
                    mine.append((keys, n))
                    if len(mine) > 16:
                        held[lang] = _merge(mine)
    for lang, mine in held.items():
        (keys, n), = _merge(mine)
        for a in range(0, len(keys), 50_000):
            part = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part])],
                                             ["lang", "gram", "n"])


class Filter:
    """The bit-sliced Bloom filter: ``slots[s, w]`` holds 64 languages' bits."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang_no: np.ndarray):
        self.langs = langs
        n = max(1, len(np.unique(gram)))
        self.bits = max(10, int(np.ceil(np.log2(n * SLOTS_PER_GRAM))))
        self.slots = np.zeros((1 << self.bits, max(1, -(-len(langs) // 64))), np.uint64)
        for p in range(PROBES):
            np.bitwise_or.at(self.slots, (self._slot(gram, p), lang_no // 64), np.uint64(1) << (lang_no % 64).astype(np.uint64))
        fill = [((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false_rate = np.array(fill) ** PROBES

    def _slot(self, gram: np.ndarray, p: int) -> np.ndarray:
        return (mix(gram + _C[1:2] * np.uint64(p + 1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        total, hits = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for g, which in gram_blocks(texts) if self.langs else ():
            if not len(g):
                continue
            mask = self.slots[self._slot(g, 0)]
            for p in range(1, PROBES):
                mask &= self.slots[self._slot(g, p)]
            total += np.bincount(which, minlength=len(texts))
            for i in range(len(self.langs)):
                hits[i] += np.bincount(which, (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), len(texts))
        if not total.any():
            return lang, score
        false = self.false_rate[:, None]
        share = (hits / np.maximum(total, 1) - false) / np.maximum(1e-9, 1 - false)
        best = share.argmax(axis=0)
        for t in np.flatnonzero(total):
            lang[t], score[t] = self.langs[best[t]], min(1.0, max(0.0, share[best[t], t]))
        return lang, score


def train(docs: DataFrame) -> Filter:
    """Learns from the texts of ``docs`` (text, lang) with a non-null lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = stored(rows.mapInArrow(releasing(_count), "lang string, gram long, n long").groupBy("lang", "gram")
                    .agg(F.sum("n").alias("n")), "gram-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(total, "lang").withColumn("share", F.col("n") / F.col("total"))
    # A language keeps at most 1 / MIN_SHARE grams: what comes to the driver is bounded by that.
    kept = share.where(F.col("share") >= MIN_SHARE)
    kept = kept.groupBy("gram").agg(F.collect_list("lang").alias("langs"))
    langs = [r.lang for r in total.orderBy("lang").collect()]
    rows, no = kept.toPandas(), {v: i for i, v in enumerate(langs)}
    gram = np.repeat(rows["gram"].to_numpy(np.int64), [len(x) for x in rows["langs"]]).view(np.uint64)
    return Filter(langs, gram, np.array([no[v] for x in rows["langs"] for v in x], np.int64))


def identify(docs: DataFrame, model: Filter, key: str) -> DataFrame:
    """(key, lang_pred, score) for each row; only ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x 1 / MIN_SHARE

    def run(batches):
        for batch in batches:
            lang, score = [], []
            for _, texts in _steps(batch.column("text")):
                a, b = held.value.predict(texts)
                lang += a
                score += b.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(releasing(run), f"key {kind}, lang_pred string, score double")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def report(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, "doc_id")
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are in no learned language: ``und``, or a
    score below REJECT_BELOW. All columns are kept."""
    model = train(docs.select("lang", "text"))
    docs, rid = with_row_id(docs)
    got = identify(docs.select(rid, "text"), model, rid)
    out = stored(got.where((F.col("lang_pred") == UND) | (F.col("score") < REJECT_BELOW)).select(F.col("key").alias(rid)), "no-language")
    return docs.join(out, rid, "left_anti").drop(rid)
