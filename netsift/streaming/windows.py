"""Streaming aggregates in the capture's own time.

Both keep a watermark: the latest packet time seen so far, less ``delay``. A
window or session is written once, when the watermark has passed its end, and its
state goes then; so state is bounded by what lies within the delay. A packet whose
window the watermark had passed before its micro-batch began is late: it is left
out, and counted in the query's progress (``numRowsDroppedByWatermark``). What the
watermark hasn't passed when the query stops stays in its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.schema import FLOW_KEY

COUNTERS = ("packets", "bytes", "tcp_packets", "udp_packets")


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("bigint").alias("bytes"),
            F.count_if(F.col("protocol") == 6).alias("tcp_packets"), F.count_if(F.col("protocol") == 17).alias("udp_packets")]


def window_totals(packets: DataFrame, width: str, delay: str) -> DataFrame:
    """Packet totals of each capture in windows of ``width``; one row when a window is over."""
    rows = packets.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "capture_id").agg(*_counters())
    return rows.select("capture_id", F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"), *COUNTERS)


def flow_sessions(packets: DataFrame, gap_seconds: int, delay: str, key: list[str] | None = None) -> DataFrame:
    """Sessions of each flow, apart by silences of ``gap_seconds`` or more; one row when a session is over."""
    key = list(key or FLOW_KEY)
    rows = (packets.withWatermark("ts", delay).groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), *key)
            .agg(F.min("ts_us").alias("first_seen_us"), F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("bigint").alias("bytes")))
    return rows.select(*key, "first_seen_us", F.unix_micros("w.end").alias("session_end_us"), "packets", "bytes")
