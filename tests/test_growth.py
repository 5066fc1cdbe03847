"""What grows with a capture: micro-batches, tasks for ranges, columns of the state operator, encoding."""

import json
import os
import tempfile

from frames import eth, ipv4, pcap_file, tcp
from conftest import SF001
from netsift.plans import catalog, fixture
from netsift.sources.pcap import stream_captures
from netsift.sources.record_index import TASK_BYTES, range_tasks
from netsift.sources.rules import rules_from_text
from netsift.streaming.stateful import OUTPUT_SCHEMA, flow_state_fn, stream_verdicts


def test_micro_batches_do_not_grow_with_the_capture():
    d = tempfile.mkdtemp(prefix="share-", dir="/tmp")
    for n in range(37):
        open(f"{d}/m{n}.pcap", "wb").close()
    assert catalog._batch_files(d) == 10 and catalog._batch_files(d, 20) == 20
    d = tempfile.mkdtemp(prefix="share-", dir="/tmp")
    assert catalog._batch_files(d) == 2


def test_small_ranges_share_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert range_tasks(spark, [("a", 100), ("b", 70)], 50) == 4
    assert range_tasks(spark, [(str(n), 1 << 21) for n in range(10_000)], 64 << 10) == max(4 * cores, 10_000 * (1 << 21) // TASK_BYTES)
    assert range_tasks(spark, [], 50) == 1


class _State:
    exists = hasTimedOut = False

    def update(self, value):
        self.value = value


def test_packets_cross_to_the_state_operator_as_one_column():
    import pandas as pd
    key = ("c", "10.0.0.1", "10.0.0.2", 1, 443, 6)
    name = 'a"\\\x01�.example'
    packet = {"ts_us": 5, "frame_length": 60, "payload_length": 6, "tcp_flags": None, "cand_app": "HTTPS", "cand_sni": name,
              "cand_route": "TLS", "const_type": None, "const_detail": None, "cand_type": None, "cand_detail": None}
    pdfs = [pd.DataFrame({"packet": [json.dumps(packet | {"packet_no": n})]}) for n in ((1 << 53) + 1, 7)]
    flow = json.dumps(dict(zip(("capture_id", "src_ip", "dest_ip", "src_port", "dest_port", "protocol"), key)))
    out = next(flow_state_fn(False, None)((flow,), iter(pdfs), _State()))
    assert list(out.columns) == ["verdict"]
    got = [json.loads(v) for v in out["verdict"]]
    assert [(v["packet_no"], v["sni"], v["flow_packets"]) for v in got] == [(7, name, 1), ((1 << 53) + 1, name, 2)]


def test_verdicts_keep_their_columns(spark):
    d = tempfile.mkdtemp(prefix="packed-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    with open(f"{src}/m1.pcap", "wb") as f:
        f.write(pcap_file([(1, eth(ipv4(tcp(b"x"))))]))
    v = stream_verdicts(stream_captures(spark, src, 'a "b"\\c'), rules_from_text(spark, "[BLOCKED_IPS]\n"))
    assert [(x.name, x.dataType) for x in v.schema] == [(x.name, x.dataType) for x in OUTPUT_SCHEMA]
    q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.capture_id, r.packet_no, r.ts_us, r.flow_packets) for r in spark.read.parquet(out).collect()] == [('a "b"\\c', 1 << 32, 1_000_007, 1)]


def test_frames_are_encoded_after_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fixture, "materialized", lambda spark, build, name, key: build())
    for frames in (fixture.fixture_frames, fixture.quic_frames, fixture.pages_frames):
        plan = frames(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("unhex") < plan.index("RepartitionByExpression")


def test_decoding_is_compiled(spark):
    import __spark_entry__ as entry
    entry.queries()["tls_sni"](spark, SF001)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_index_keeps_few_chains(spark, monkeypatch):
    """Frames of zeros could hold a record at every byte; only places that chains lead to are stored."""
    from netsift.sources import record_index
    d = tempfile.mkdtemp(prefix="chains-", dir="/tmp")
    with open(f"{d}/m1.pcap", "wb") as f:
        f.write(pcap_file([(n, bytes(500)) for n in range(400)]))
    kept, stored = {}, record_index._stored

    def counting(df, name):
        kept[name] = (out := stored(df, name)).count()
        return out
    monkeypatch.setattr(record_index, "_stored", counting)
    got = record_index.record_ranges(spark, [(f"{d}/m1.pcap", os.path.getsize(f"{d}/m1.pcap"))], 4096).collect()
    assert sum(r.records for r in got) == 400 and sorted(r.first_no for r in got)[0] == 0
    assert kept["chains"] < os.path.getsize(f"{d}/m1.pcap") // 20
