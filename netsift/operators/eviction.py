"""A flow table of bounded size, in packet order (H4).

The table of a capture holds at most N flows. A packet of a flow that isn't in
it, when it is full, pushes out the flow whose last packet is longest ago; that
flow starts anew with its next packet, its label and block forgotten. So a flow
falls into instances, and everything downstream treats those as flows.

Which packets find their flow is settled without walking the capture from its
start. The packets fall into chunks of consecutive numbers. What the table holds
when a chunk begins are the N flows seen last before it, which is an associative
combination of what each chunk saw last: "the N most recent of both, the later
packet of a flow counts". A prefix scan over chunks by doubling gives it, and a
chunk that saw N flows itself needs nothing from those before it, so with chunks
larger than the table there is little to combine. Each chunk is then walked by
itself, from its own starting table: a task holds a chunk's packets and N flows.
"""

from __future__ import annotations

import sys
from collections import OrderedDict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.schema import FLOW_KEY
from netsift.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_PACKETS = 1 << 18


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"table-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _recent(seen: DataFrame, n: int) -> DataFrame:
    """The ``n`` flows of each chunk whose last packet is latest."""
    last = seen.groupBy("capture_id", "place", "flow").agg(F.max("packet_no").alias("packet_no"))
    rank = F.row_number().over(Window.partitionBy("capture_id", "place").orderBy(F.desc("packet_no")))
    return last.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def seen_before(packets: DataFrame, n: int) -> DataFrame:
    """(capture_id, place, flow, packet_no): the ``n`` flows seen last before each
    chunk, with their last packet. ``packets`` has the chunks' places (1, 2, ... in
    each capture), flows and packet numbers."""
    upto = _stored(_recent(packets, n), "seen")
    last = upto.agg(F.max("place")).first()[0] or 0
    step = 1
    while step < last:
        # Chunks that still miss flows take those of the chunks `step` before: both sums cover `step` chunks so far.
        size = upto.groupBy("capture_id", "place").agg(F.count(F.lit(1)).alias("held"))
        lacking = _stored(size.where((F.col("held") < n) & (F.col("place") > step)).select("capture_id", "place"), "lacking")
        if lacking.isEmpty():
            break
        earlier = upto.withColumn("place", F.col("place") + step).join(lacking, ["capture_id", "place"], "left_semi")
        upto = _stored(_recent(upto.unionByName(earlier), n), "seen")
        step *= 2
    return upto.withColumn("place", F.col("place") + 1).where(F.col("place") <= last)


def _walk(n: int):
    """Numbers of the packets of one chunk that don't find their flow in the table."""
    def run(key, rows):
        table, missed = OrderedDict(), []
        rows = rows.sort_by("packet_no")
        for flow, no, here in zip(*(rows.column(c).to_pylist() for c in ("flow", "packet_no", "here"))):
            if flow in table:
                table.move_to_end(flow)
                continue
            if len(table) >= n:
                table.popitem(last=False)
            table[flow] = None
            if here:
                missed.append(no)
        return pa.table({"capture_id": pa.array([key[0].as_py()] * len(missed), pa.string()), "packet_no": pa.array(missed, pa.int64())})
    return run


def table_entries(packets: DataFrame, max_flows: int, chunk_packets: int = CHUNK_PACKETS, key: list[str] | None = None) -> DataFrame:
    """(capture_id, packet_no) of the packets with which a flow enters its capture's
    table: its first, and the first after each time it was pushed out."""
    if max_flows < 1:
        raise ValueError("a flow table holds at least one flow")
    key = list(key or FLOW_KEY)
    flow = F.concat_ws("|", *[F.col(c).cast("string") for c in key if c != "capture_id"])
    chunk = F.floor(F.col("packet_no") / chunk_packets).cast("bigint")
    slim = _stored(packets.select("capture_id", flow.alias("flow"), "packet_no", chunk.alias("chunk")), "packets")
    chunks = slim.select("capture_id", "chunk").distinct()
    places = _stored(chunks.withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy("chunk"))), "places")  # a row a chunk
    placed = slim.join(places, ["capture_id", "chunk"]).drop("chunk")
    rows = placed.withColumn("here", F.lit(True)).unionByName(seen_before(placed, max_flows).withColumn("here", F.lit(False)))
    return rows.groupBy("capture_id", "place").applyInArrow(_walk(max_flows), "capture_id string, packet_no bigint")


def with_table_instances(rows: DataFrame, packets: DataFrame, max_flows: int, chunk_packets: int = CHUNK_PACKETS,
                         key: list[str] | None = None) -> DataFrame:
    """``rows`` (one for each of ``packets``) with ``flow_instance``: how often the
    packet's flow was pushed out of the table before it."""
    key = list(key or FLOW_KEY)
    entered = _stored(table_entries(packets, max_flows, chunk_packets, key), "entries").withColumn("_in", F.lit(1))
    w = Window.partitionBy(*key).orderBy("packet_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(entered, ["capture_id", "packet_no"], "left")
    return marked.withColumn("flow_instance", F.sum(F.coalesce("_in", F.lit(0))).over(w) - 1).drop("_in")
