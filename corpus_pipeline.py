"""Corpus pipeline: five stages, each written as Parquet and read by the next.

language_id            documents in no learned language go (``und``, or hardly
                       any known n-gram); op 9
near_duplicates        one document of each group of texts with a five-word
                       shingle similarity of 0.8 or more stays; op 3
decontamination        documents of which a twentieth of the words or more lie in
                       passages shared with the benchmark go; op 1
mixing                 sources are repeated or thinned to target weights; op 6
token_files            the mixture, in its shuffled order, as Huffman-coded token files, read back; op 7
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netsift.llm import decontaminate, jaccard, langid, mixing, token_files
from netsift.llm.common import prepare, stored, table, with_row_id


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, place = with_row_id(docs)  # rows are stored in the order of the mixture
    return token_files.report(docs, public_tokenizers.path("word_bpe_49k.json"), order=place)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mix), ("token_files", tokens)]

#: Trained filters, groups of near copies and the tokenizer aren't expressible in SQL: tests hold brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; a row (doc_id, start, n_tokens,
    ids_crc32) for each document of the token files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
