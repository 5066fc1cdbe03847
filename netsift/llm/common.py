"""Helpers shared by the corpus operators.

Tables that are used more than once are written under the shared folder
(``spark.checkpoint.dir``) and read back: that cuts lineage, and a lost
executor only reruns the tasks of the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.session import ensure_shared_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whatever is not a word character: words are runs of 0-9, a-z and non-ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Largest table that an operator broadcasts itself, by measured rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (all are runtime settings):
    shuffle files go once the job that made them has ended, and Arrow batches
    are bounded by bytes, so that long texts don't pile up in a worker."""
    ensure_shared_dir(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that is not a column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str = "_rid") -> tuple[DataFrame, str]:
    """``df`` with a number for each row. The number follows the files and
    splits of a table scan, so a rerun task gives the same one; ``df`` must be
    a scan (operators store anything else first)."""
    name = fresh(df, name)
    return df.withColumn(name, F.monotonically_increasing_id()), name


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
           .otherwise(F.translate(text, UPPER, UPPER.lower())))
    return F.array_remove(F.split(low, NOT_WORD), "")


def releasing(run):
    """``run`` (a function over Arrow batches) that gives freed memory back when
    its task has ended: Python workers live on and share the executor's memory."""
    def task(batches):
        import ctypes
        import gc

        import pyarrow as pa
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.CDLL(None), "malloc_trim"):
            ctypes.CDLL(None).malloc_trim(0)
    return task


def small(df: DataFrame, size: Column) -> bool:
    """Whether a stored table, measured now, is within the broadcast bounds.
    ``size`` gives the bytes of a row."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and b <= BROADCAST_BYTES
