"""Session helpers: the shared working folder and materialized tables.

Intermediate tables are written under the folder the cluster names in
``spark.checkpoint.dir`` (shared storage), never to a machine-local folder.
A session without that setting gets one only in local mode (tests, bench).
"""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "netsift", cores: str = "*", partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the local bench (AQE on, UI off, UTC)."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.driver.memory", driver_memory)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             # Capture plans join small rule tables to streams whose keys are
             # deep byte expressions; there is never a partitioned table to
             # prune, and the pruning rule's lineage walk costs seconds of
             # planning per query. Results are unaffected.
             .config("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
             # Frame decoding compiles to large methods; let the JIT compile them.
             .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
             .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    return spark


def ensure_shared_dir(spark: SparkSession) -> str:
    """The shared working folder; set one up only in local mode when unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="netsift-ckpt-"))
    return sc.getCheckpointDir()


def compiled_decoding(spark: SparkSession) -> None:
    """Stages whose generated code holds a method above 8,000 bytes run as plain projections: the
    JVM leaves such methods to its interpreter (unless told otherwise), and frame decoding has them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the configured shared folder (stable across applications;
    Spark's own checkpoint subfolder is per application)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_shared_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def file_signature(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or folder (for cache keys)."""
    fs, p = _fs(spark, path)
    st = fs.getFileStatus(p)
    if st.isDirectory():
        summary = fs.getContentSummary(p)
        return f"{summary.getLength()}:{summary.getFileCount()}:{st.getModificationTime()}"
    return f"{st.getLen()}:{st.getModificationTime()}"


def cache_key(*parts: str) -> str:
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, build, name: str, key: str) -> DataFrame:
    """Parquet table ``name`` under the shared folder, written once per ``key``.

    ``build`` is called (lazily) only when no complete copy exists. Writing
    uses Spark's commit protocol, so a lost executor only reruns its tasks
    and readers see either no table or a complete one (``_SUCCESS``).
    """
    path = shared_path(spark, "netsift", name, key)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared folder."""
    return shared_path(spark, "netsift", "scratch", f"{name}-{os.getpid()}-{os.urandom(6).hex()}")
