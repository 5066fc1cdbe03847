"""Streams in event time, state that is let go, and callbacks."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from frames import eth, ipv4, pcap_file, tcp
from netsift.operators.decode import admit, decode
from netsift.operators.flowstate import visit_flows
from netsift.sources.pcap import PcapStreamWriter, WrittenFiles, list_captures, read_captures, stream_captures, write_capture_stream
from netsift.sources.rules import rules_from_text
from netsift.streaming.stateful import replacing, stream_verdicts
from netsift.streaming.windows import window_totals


def _put(d, name, records):
    with open(os.path.join(d, name), "wb") as f:
        f.write(pcap_file(records))


def test_late_packets_are_left_out_and_counted(spark):
    d = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    frame = eth(ipv4(tcp(b"x")))
    # Windows of 100 s, a delay of 50 s: after 1,000 s, what belongs before 900 s is late.
    files = [[10, 20, 110], [130, 90, 1000], [880, 899, 905, 950], [2000]]
    for n, times in enumerate(files):
        _put(src, f"m{n}.pcap", [(t, frame) for t in times])
        q = (window_totals(admit(decode(stream_captures(spark, src, "cap"), keep_data=False)), "100 seconds", "50 seconds")
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start())
        q.processAllAvailable()
        if n == 2:
            assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) > 0
        q.stop()
    got = {r.window_start_us // 1_000_000: r.packets for r in spark.read.parquet(out).collect()}
    assert got == {0: 3, 100: 2, 900: 2, 1000: 1}


def test_state_of_closed_flows_goes(spark):
    """With ``retain_s``, rows of state fall to the flows that are still open; verdicts are unchanged."""
    d = tempfile.mkdtemp(prefix="retain-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    frames = [eth(ipv4(tcp(b"x", sport=p))) for p in range(1, 11)] + [eth(ipv4(tcp(b"", sport=p, flags=4))) for p in range(1, 8)]
    _put(src, "m1.pcap", [(n, f) for n, f in enumerate(frames)])
    v = stream_verdicts(stream_captures(spark, src, "cap"), rules_from_text(spark, "[BLOCKED_IPS]\n"), retain_s=1)
    q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()

    def rows():
        p = q.lastProgress
        return p.stateOperators[0].numRowsTotal if p and p.stateOperators else None
    try:
        most, until = 0, time.time() + 90
        while time.time() < until and not (most == 10 and rows() == 3):
            most = max(most, rows() or 0)
            time.sleep(0.2)
        assert most == 10 and rows() == 3
    finally:
        q.stop()
    states = [r.state for r in spark.read.parquet(out).orderBy("packet_no").collect()]
    assert len(states) == 17 and states[10:] == ["CLOSED"] * 7


def test_repeated_callbacks_count_once(spark):
    d = tempfile.mkdtemp(prefix="callback-", dir="/tmp")
    write = replacing(d, lambda b: b.where("n > 1"))
    for batch_id, rows in ((0, [1, 2, 3]), (1, [4]), (0, [1, 2, 3]), (1, [4])):
        write(spark.createDataFrame([(n,) for n in rows], "n int"), batch_id)
    assert sorted(r.n for r in spark.read.parquet(d).collect()) == [2, 3, 4]


def test_visitor_sees_each_flow_once(spark):
    d = tempfile.mkdtemp(prefix="visit-", dir="/tmp")
    flows = spark.range(1000).repartition(7).withColumn("state", F.lit("NEW"))

    def visitor(partition, batches):
        ids = [i for b in batches for i in b.column("id").to_pylist()]
        with open(f"{d}/{partition}", "w") as f:
            f.write(" ".join(map(str, ids)))
    assert visit_flows(flows, visitor) == 1000
    assert sorted(int(x) for n in os.listdir(d) for x in open(f"{d}/{n}").read().split()) == list(range(1000))
    assert visit_flows(flows.limit(0), lambda p, b: None) == 0 and visit_flows(flows, lambda p, b: None) == 1000


def test_capture_sink_writes_each_packet_once(spark):
    """Batches that are repeated, and ones that were half moved, leave each packet once."""
    d = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    frames = [eth(ipv4(tcp(bytes([n]) * n))) for n in range(30)]
    for n in range(3):
        _put(src, f"m{n}.pcap", [(t, frames[t]) for t in range(10 * n, 10 * n + 10)])
        q = write_capture_stream(stream_captures(spark, src, "a"), out, ck)
        q.processAllAvailable()
        q.stop()
        if n == 1:  # died before Spark noted the batch, which is in the folder already
            for log in (f"{ck}/commits/1", f"{ck}/commits/.1.crc"):
                if os.path.exists(log):
                    os.remove(log)
    got = sorted((r.ts_sec, bytes(r.data)) for r in read_captures(spark, out).collect())
    assert got == list(enumerate(frames))
    assert not [x for x in os.listdir(out) if x.startswith("_temporary")]

    def written(name, tmp="_temporary-stream-x"):
        os.makedirs(f"{out}/{tmp}", exist_ok=True)
        _put(f"{out}/{tmp}", name, [(99, frames[1])])
        return WrittenFiles([(f"{out}/{tmp}/{name}", name)])

    sink, before = PcapStreamWriter({"path": out}), set(list_captures(out))
    sink.commit([written("p0"), None], 1)                       # noted already: nothing changes
    assert set(list_captures(out)) == before and not os.path.exists(f"{out}/_temporary-stream-x")
    _put(out, "p7-batch-000000000007.pcap", [(98, frames[2])])  # moved, then killed before the note
    sink.commit([written("p0"), written("p1")], 7)
    assert {os.path.basename(f) for f in set(list_captures(out)) - before} == {f"p{n}-batch-000000000007.pcap" for n in (0, 1)}
    sink.commit([], 8)
    written("p2")
    sink.abort([], 9)
    assert len(list_captures(out)) == len(before) + 2 and not os.path.exists(f"{out}/_temporary-stream-x")
