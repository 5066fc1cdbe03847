"""Rules file scan (A3) and sink (A5).

A rules file is line oriented: a line starting with ``[`` opens a section,
other non-empty lines are values of the current section. Lines end with LF, CR
or both and lose blanks and control characters at either end. Parsing is a Spark
job over lines: the section in force is the last header at or before a line, first
within the line's split, then carried over from the file's earlier splits.
Values that the engine would ignore or fail on go to the ``error`` column;
:func:`load_rules` keeps the valid ones, :func:`rule_rejects` the others.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.functions.names import normalize_ip
from netsift.schema import APP_NAMES, RULE_SECTIONS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_IPV4_RX = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


#: What ``trim`` means for a rules line: everything up to the blank.
_EDGES_RX = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _parse(lines: DataFrame) -> DataFrame:
    """``lines`` has (source, split, at, raw): a file's lines in the order of
    (split, at)."""
    lines = lines.withColumn("line", F.regexp_replace("raw", _EDGES_RX, ""))
    is_header = F.col("line").startswith("[")
    here = Window.partitionBy("source", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(is_header, F.col("line"))
    lines = lines.withColumns({"own": F.last(header, ignorenulls=True).over(here), "nth": F.row_number().over(
        Window.partitionBy("source", "split").orderBy("at")) - 1})
    # One row for each split: what the next ones of the file start from.
    before = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = (lines.groupBy("source", "split").agg(F.max_by("own", "at").alias("last"), F.count(F.lit(1)).alias("n"))
               .select("source", "split", F.last("last", ignorenulls=True).over(before).alias("carried"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    lines = lines.join(carried, ["source", "split"]).select(
        "source", (F.col("base") + F.col("nth")).cast("int").alias("pos"), "line",
        F.coalesce("own", "carried").alias("section"))
    values = lines.where((F.col("line") != "") & ~is_header)
    rule_type = F.lit(None).cast("string")
    for header, kind in reversed(RULE_SECTIONS):
        rule_type = F.when(F.col("section") == header, kind).otherwise(rule_type)
    v = F.col("line")
    rt = F.col("rule_type")
    octets_ok = F.forall(F.split(v, r"\."), lambda o: o.try_cast("int") <= 255)
    error = (F.when(rt.isNull(), F.lit("value outside a known section"))
             .when((rt == "IP") & ~(v.rlike(_IPV4_RX) & octets_ok), F.lit("not an IPv4 address"))
             .when((rt == "APP") & ~v.isin(*APP_NAMES), F.lit("unknown application"))
             .when((rt == "PORT") & v.try_cast("int").isNull(), F.lit("not a port number")))
    value = (F.when(rt == "PORT", v.try_cast("int").cast("string"))
             .when(rt == "IP", normalize_ip(v)).otherwise(v))
    return (values.withColumn("rule_type", rule_type)
            .select("source", "pos", "rule_type",
                    value.alias("value"),
                    ((rt == "DOMAIN") & v.contains("*")).alias("is_pattern"),
                    error.alias("error"), F.col("line").alias("raw_value")))


def parse_rules_files(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    return _parse(lines)


def parse_rules_text(spark: SparkSession, text: str, source: str = "inline") -> DataFrame:
    lines = spark.createDataFrame([(source, 0, text)], "source string, split bigint, value string")
    return _parse(lines.select("source", "split", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "raw")))


def _valid(parsed: DataFrame) -> DataFrame:
    return (parsed.where(F.col("error").isNull())
            .select("rule_type", "value", F.coalesce("is_pattern", F.lit(False)).alias("is_pattern"))
            .distinct())


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules table ``(rule_type, value, is_pattern)`` from rules files (A3)."""
    return _valid(parse_rules_files(spark, path))


def rules_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Rules table from rules-file text (same parser as :func:`load_rules`)."""
    return _valid(parse_rules_text(spark, text))


def rule_rejects(parsed: DataFrame) -> DataFrame:
    """Lines the loader cannot use, with the reason."""
    return parsed.where(F.col("error").isNotNull()).select("source", "pos", "rule_type", "raw_value", "error")


def rules_text(rules: DataFrame) -> DataFrame:
    """One row per line of the rules file, with its position (A5).

    Sections come in file order, each after the first preceded by a blank
    line; values are sorted within a section (ports numerically). Lines stay
    separate rows, so no section is ever gathered into one value.
    """
    spark = rules.sparkSession
    order = F.create_map(*[x for i, (_, kind) in enumerate(RULE_SECTIONS) for x in (F.lit(kind), F.lit(i))])
    heads = spark.createDataFrame(
        [(i, 0, None, None, ("" if i == 0 else "\n") + h) for i, (h, _) in enumerate(RULE_SECTIONS)],
        "section_no int, part int, n bigint, v string, value string")
    lines = rules.select(
        order[F.col("rule_type")].alias("section_no"), F.lit(1).alias("part"),
        F.when(F.col("rule_type") == "PORT", F.col("value").try_cast("bigint")).alias("n"),
        F.col("value").alias("v"), F.col("value").alias("value"))
    return heads.unionByName(lines)


def _headed(batches):
    """A file of its own for each partition: it starts with the section in force."""
    import pyarrow as pa
    first = True
    for batch in batches:
        out = batch.column("value").to_pylist()
        if first and out:
            first = False
            if batch.column("part")[0].as_py():
                out.insert(0, RULE_SECTIONS[batch.column("section_no")[0].as_py()][0])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def save_rules(rules: DataFrame, path: str) -> None:
    """Write re-loadable rules files: lines range-partitioned and sorted, each
    part file headed by its section. A small table gives one file."""
    (rules_text(rules).repartitionByRange("section_no", "part", "n", "v")
     .sortWithinPartitions("section_no", "part", "n", "v")
     .mapInArrow(_headed, "value string").write.mode("overwrite").text(path))
