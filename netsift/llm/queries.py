"""Registered queries of the corpus operators: each reads whole tables."""

from __future__ import annotations

import public_tokenizers

from netsift.llm import (byte_bpe, centroids, decontaminate, interactions, jaccard, langid, mixing, neighbours, pii, repeats,
                         token_counts, token_files, warc)
from netsift.llm.common import table
from netsift.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard.report(table(spark, sf_dir, "documents"))


def op4_repeats(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


def op5_neighbours(spark, sf_dir):
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return token_files.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_filter_interactions(spark, sf_dir):
    return interactions.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark, sf_dir):
    return byte_bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_centroids(spark, sf_dir):
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_decontaminate, op2_warc, op3_jaccard_join, op4_repeats, op5_neighbours, op6_mixing, op7_token_files, op8_pii,
    op9_language_id, op10_token_counts, op11_filter_interactions, op12_byte_bpe, op13_centroids)}
