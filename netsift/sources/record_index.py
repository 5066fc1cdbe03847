"""Where records start in capture files, found by many tasks for each file.

A capture has no sync marker: a record says how long it is, and that is all that
leads to the next one. So each byte range of a file is scanned for every place
that could be a record's start, and the chains of the right places are picked
afterwards:

* a record that starts before a range ends at most ``REACH`` bytes into it, so
  only offsets that near to the range's beginning can be its first record;
* every offset whose length field is within the format's bound, and whose record
  ends within the file, links to the place behind that record. Following all
  links of a block at once (doubling) gives, for each possible first record, where
  its chain leaves the range and how many records it has there;
* pointer jumping from the file's first record over those exits, doubling each
  round, keeps what the file's start reaches, with the number of records before
  it. That is the exact record table: what looks like a record inside a payload
  is not reached, and a chain ends at the first bad or cut record, as a whole
  read of the file does.

Work is proportional to bytes, tasks to ranges; a task holds one block of
``BLOCK`` bytes. Only files' names and sizes are listed on the driver.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.schema import PCAP_GLOBAL_HEADER_LEN, PCAP_MAX_RECORD_LEN, PCAP_RECORD_HEADER_LEN
from netsift.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REACH = PCAP_MAX_RECORD_LEN + PCAP_RECORD_HEADER_LEN
BLOCK = 1 << 20
#: Bytes of ranges that a task takes at least, where that leaves enough tasks for the cores: small ranges share tasks.
TASK_BYTES = 32 << 20
CHAINS = "file string, offset bigint, exit bigint, records bigint"


def links(data: np.ndarray, n: int, at: int, size: int, little: bool, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among the first ``n`` bytes (of a block at offset ``at``) where a whole
    record could start, and the offset behind that record. ``data`` goes on behind
    the ``n`` bytes by a record header, if the file does."""
    n = max(0, min(n, len(data) - PCAP_RECORD_HEADER_LEN + 1))
    b = [data[8 + i:8 + i + n] for i in (range(4) if little else range(3, -1, -1))]  # the length field, low byte first
    place = np.flatnonzero((b[2] == 0) & (b[3] == 0))  # no bound is above 65,535
    length = b[0][place].astype(np.int64) | b[1][place].astype(np.int64) << 8
    behind = at + place + PCAP_RECORD_HEADER_LEN + length
    ok = (length <= limit) & (behind <= size)
    return place[ok], behind[ok]


def follow(place: np.ndarray, behind: np.ndarray, n: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: where its chain leaves the block (-1: it ends at a bad record
    within) and the number of its records in the block."""
    inside = behind < at + n
    to = np.searchsorted(place, behind - at)
    to[to == len(place)] = 0
    linked = inside & (place[to] == behind - at)
    hop = np.where(linked, to, np.arange(len(place)))
    left = np.where(inside, -1, behind)
    records = linked.astype(np.int64)
    while True:
        far = hop[hop]
        if (far == hop).all():
            return left[hop], records + 1
        records = records + records[hop]
        hop = far


def range_chains(f, little: bool, limit: int, size: int, low: int, high: int, starts=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, exit, records) for each place that could hold the range's first record, or for those of ``starts``."""
    if starts is not None:
        at = np.array(sorted(starts), np.int64)
    else:
        at = np.array([PCAP_GLOBAL_HEADER_LEN]) if low == 0 else np.arange(low, min(low + REACH, high))
    first, records = at.copy(), np.zeros(len(at), np.int64)
    for start in range(low, high, BLOCK):
        n = min(BLOCK, high - start)
        here = np.flatnonzero((at >= start) & (at < start + n))
        if not len(here):
            continue
        f.seek(start)
        place, behind = links(np.frombuffer(f.read(n + PCAP_RECORD_HEADER_LEN - 1), np.uint8), n, start, size, little, limit)
        known = np.isin(at[here] - start, place)
        at[here[~known]] = -1
        here = here[known]
        if len(here):
            left, count = follow(place, behind, n, start)
            i = np.searchsorted(place, at[here] - start)
            at[here], records[here] = left[i], records[here] + count[i]
    some = records > 0
    return first[some], at[some], records[some]


def _chains(batches):
    """(file, size, offsets, exits, records) of the ranges listed, from their ``starts`` if they have any."""
    from netsift.sources.pcap import _fs_path, parse_header

    for batch in batches:
        for row in batch.to_pylist():
            filesystem, path = _fs_path(row["file"])
            with filesystem.open_input_file(path) as f:
                header = parse_header(f.read(PCAP_GLOBAL_HEADER_LEN))
                if header is None:
                    continue
                found = range_chains(f, header.order == "<", min(header.snaplen, PCAP_MAX_RECORD_LEN),
                                     row["size"], row["low"], row["high"], row.get("starts"))
            yield row["file"], row["size"], *found


def _exits(batches):
    """Where chains leave each range: few places, as chains meet; those that could begin them are many."""
    for file, size, _, left, _ in _chains(batches):
        left = np.unique(left[(left >= 0) & (left < size)])
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(left), pa.string()), pa.array(left, pa.int64())], ["file", "offset"])


def _scan(batches):
    for file, size, first, left, records in _chains(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(first), pa.string()), pa.array(first, pa.int64()),
             pa.array(left, pa.int64(), mask=(left < 0) | (left >= size)), pa.array(records, pa.int64())],
            ["file", "offset", "exit", "records"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"index-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_tasks(spark: SparkSession, files: list[tuple[str, int]], size: int) -> int:
    """Tasks for the ranges of ``size`` bytes of these files: one for each range, up to four
    a core; of more ranges, as many as give each task TASK_BYTES."""
    ranges, enough = sum(-(-n // size) for _, n in files), 4 * spark.sparkContext.defaultParallelism
    return max(1, min(ranges, max(enough, sum(n for _, n in files) // TASK_BYTES)))


def record_ranges(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """Stored table (file, start, first_no, records): for each byte range of ``size``
    bytes in which records start, its first record, that record's number in the
    file, and how many there are. Files without a known header have no rows."""
    listed = spark.createDataFrame([(f, n) for f, n in files if n > PCAP_GLOBAL_HEADER_LEN], "file string, size bigint")
    no = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / size)))
    ranges = (listed.select("file", "size", no.alias("no"))
              .select("file", "size", (F.col("no") * size).alias("low"), F.least((F.col("no") + 1) * size, "size").alias("high")))
    most = max((-(-n // size) for _, n in files), default=1)
    tasks = range_tasks(spark, files, size)
    # Only chains that another chain leads to can be right, and those at a file's first record: a first scan
    # says where chains leave, a second one follows the chains from there.
    led = _stored(ranges.repartition(tasks).mapInArrow(_exits, "file string, offset bigint"), "exits").distinct()
    first = ranges.where(F.col("low") == 0).select("file", F.lit(PCAP_GLOBAL_HEADER_LEN).cast("bigint").alias("offset"))
    starts = (led.unionByName(first).groupBy("file", (F.floor(F.col("offset") / size) * size).alias("low"))
              .agg(F.collect_set("offset").alias("starts")))
    found = _stored(ranges.join(starts, ["file", "low"]).repartition(tasks).mapInArrow(_scan, CHAINS), "chains")
    root = F.col("offset") == PCAP_GLOBAL_HEADER_LEN
    jump = found
    reach = _stored(found.where(root).select("file", "offset", F.lit(0).cast("bigint").alias("first_no")), "reach")
    for _ in range((most - 1).bit_length()):
        going = jump.where(F.col("exit").isNotNull())
        ahead = (reach.join(going, ["file", "offset"])
                 .select("file", F.col("exit").alias("offset"), (F.col("first_no") + F.col("records")).alias("first_no")))
        reach = _stored(reach.unionByName(ahead).distinct(), "reach")
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("to"), F.col("records").alias("more"))
        jump = _stored(going.join(far, ["file", "exit"])
                       .select("file", "offset", F.col("to").alias("exit"), (F.col("records") + F.col("more")).alias("records")), "jump")
    return _stored(reach.join(found.select("file", "offset", "records"), ["file", "offset"])
                   .select("file", F.col("offset").alias("start"), "first_no", "records"), "ranges")
