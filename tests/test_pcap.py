"""Capture files: scan, header scan, stop rules, write + read back."""

import os
import tempfile

import pytest

from frames import eth, ipv4, pcap_file, tcp
from netsift.sources.pcap import read_capture_headers, read_captures, write_captures


def _write(d, name, blob):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(blob)
    return p


def test_byte_orders_and_stop_rules(spark):
    d = tempfile.mkdtemp(prefix="pcap-test-", dir="/tmp")
    recs = [(100 + i, eth(ipv4(tcp(bytes([i]))))) for i in range(5)]
    _write(d, "le.pcap", pcap_file(recs, little=True))
    _write(d, "be.pcap", pcap_file(recs, little=False))
    _write(d, "ns.pcap", pcap_file(recs, magic=0xA1B23C4D))
    good = pcap_file(recs[:3])
    _write(d, "cut.pcap", good + b"\x00" * 7)
    _write(d, "snap.pcap", pcap_file(recs, snaplen=40))
    rows = read_captures(spark, d).collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r["capture_id"]), []).append(r)
    assert len(by["le.pcap"]) == 5 and len(by["be.pcap"]) == 5
    assert [bytes(r["data"]) for r in by["le.pcap"]] == [bytes(r["data"]) for r in by["be.pcap"]]
    assert [r["packet_no"] for r in by["le.pcap"]] == [0, 1, 2, 3, 4]
    assert by["le.pcap"][2]["ts_sec"] == 102 and by["le.pcap"][2]["ts_usec"] == 7
    assert "ns.pcap" not in by and "snap.pcap" not in by
    assert len(by["cut.pcap"]) == 3
    heads = {os.path.basename(r["capture_id"]): r for r in read_capture_headers(spark, d).collect()}
    assert heads["le.pcap"]["byte_order"] == "little" and heads["be.pcap"]["byte_order"] == "big"
    assert heads["ns.pcap"]["error"] == "unknown magic"
    assert heads["le.pcap"]["snaplen"] == 65535 and heads["le.pcap"]["link_type"] == 1


def test_write_read_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="pcap-rt-", dir="/tmp")
    frames = [("cap-a", i, 1000 + i, i, eth(ipv4(tcp(bytes([i % 256]) * (i % 9))))) for i in range(300)]
    df = spark.createDataFrame(frames, "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, data binary")
    out = os.path.join(d, "out")
    write_captures(df, out, chunk_packets=64)
    back = read_captures(spark, out).orderBy("capture_id", "packet_no").collect()
    assert [bytes(r["data"]) for r in back] == [f[4] for f in frames]
    assert [(r["ts_sec"], r["ts_usec"]) for r in back] == [(f[2], f[3]) for f in frames]
    assert not os.path.exists(os.path.join(out, "_temporary"))
    assert os.path.exists(os.path.join(out, "_SUCCESS"))


def _rows(df):
    return sorted((r["capture_id"], r["packet_no"], r["ts_sec"], bytes(r["data"])) for r in df.collect())


def test_split_reads_equal_whole_read(spark):
    """Read as many ranges, files give exactly the rows of the whole read: also
    with zero-filled payloads, cut in a record, and with an oversize record."""
    import random
    rng = random.Random(3)
    d = tempfile.mkdtemp(prefix="pcap-split-", dir="/tmp")
    recs = [(1000 + i // 7, eth(ipv4(tcp(bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300))))))) for i in range(2000)]
    zero = [(1000 + i, eth(ipv4(tcp(bytes(1000))))) for i in range(400)]
    _write(d, "big.pcap", pcap_file(recs, little=False))
    _write(d, "zero.pcap", pcap_file(zero))
    _write(d, "cut.pcap", pcap_file(zero)[:-500])
    _write(d, "over.pcap", pcap_file(zero[:50]) + b"\0" * 8 + b"\xff" * 8 + pcap_file(zero[:9])[24:])
    _write(d, "none.pcap", b"nothing")
    whole = _rows(read_captures(spark, d))
    assert len(whole) == 2000 + 400 + 399 + 50
    for size in (10_000, 50_000, 1 << 30):
        assert _rows(read_captures(spark, d, split_size=size)) == whole


def test_index_of_payloads_full_of_headers(spark, monkeypatch):
    """Payloads that are captures themselves, runs of zeros and random bytes; both byte
    orders; files cut everywhere: the record table is that of a walk from the start,
    for ranges and blocks smaller and larger than a record."""
    import io
    import random
    import struct

    import numpy as np

    from netsift.sources import record_index as X
    from netsift.sources.pcap import capture_index, iter_records, parse_header
    rng = random.Random(11)

    def payload():
        kind = rng.randrange(4)
        if kind == 0:
            return bytes(rng.randrange(0, 3000))
        if kind == 1:  # records within a record, some of which lead to places beyond it
            return b"".join(struct.pack("<IIII", 9, 9, n := rng.randrange(0, 200), n) + bytes(rng.choice((n, n // 2))) for _ in range(rng.randrange(1, 12)))
        if kind == 2:
            return pcap_file([(1, b"x" * rng.randrange(40))] * 5, little=False)
        return rng.randbytes(rng.randrange(0, 1500))
    for little in (True, False):
        whole = pcap_file([(5, payload()) for _ in range(60)], little=little)
        for blob in (whole, whole[:-7], whole[:40], whole[:24], whole + b"\xff" * 50, whole + struct.pack("<IIII", 0, 0, 65535, 0)):
            f = io.BytesIO(blob)
            header = parse_header(f.read(24))
            want, at = {}, 24
            for *_, incl, _, data in iter_records(f, header):
                want[at] = len(want)
                at += 16 + len(data)
            for size, block in ((4096, 1 << 20), (997, 100), (1 << 20, 5000)):
                monkeypatch.setattr(X, "BLOCK", block)
                chains = {}
                for low in range(0, len(blob), size):
                    for a, to, n in zip(*X.range_chains(io.BytesIO(blob), little, 65535, len(blob), low, min(low + size, len(blob)))):
                        chains[int(a)] = (int(to), int(n))
                at, no, seen = 24, 0, {}
                while at in chains:
                    seen[at] = no
                    at, no = chains[at][0], no + chains[at][1]
                assert no == len(want) and all(want[a] == n for a, n in seen.items())
                assert [a // size for a in seen] == sorted({a // size for a in want})
    d = tempfile.mkdtemp(prefix="pcap-index-", dir="/tmp")
    _write(d, "one.pcap", whole)
    index = capture_index(spark, d, 4096).orderBy("start").collect()
    assert len(index) > len(whole) / 8192 and sum(r.records for r in index) == len([*iter_records(io.BytesIO(whole[24:]), parse_header(whole))])
    assert np.cumsum([r.records for r in index])[:-1].tolist() == [r.first_no for r in index][1:]
    assert _rows(read_captures(spark, d, split_size=4096)) == _rows(read_captures(spark, d))


def test_files_of_one_capture(spark):
    """Rotated files under one id: numbers go on from file to file, split or not."""
    d = tempfile.mkdtemp(prefix="pcap-one-", dir="/tmp")
    frames = [("cap", i, 1000 + i, 0, eth(ipv4(tcp(bytes(i % 50))))) for i in range(100)]
    write_captures(spark.createDataFrame(frames, "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, data binary"), d, chunk_packets=30)
    for split in (None, 500):
        rows = read_captures(spark, d, split, "cap").orderBy("packet_no").collect()
        assert [(r.capture_id, r.packet_no) for r in rows] == [("cap", (i // 30 << 32) + i % 30) for i in range(100)]
        assert [r.ts_sec for r in rows] == [1000 + i for i in range(100)]


def test_names_overwrite_and_append(spark):
    """Captures that share a base name stay apart; overwriting leaves nothing of
    what was there, appending keeps it."""
    d = tempfile.mkdtemp(prefix="pcap-names-", dir="/tmp")
    schema = "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, data binary"
    frame = eth(ipv4(tcp(b"x")))
    rows = [("/in/a/x.pcap", i, i, 0, frame) for i in range(10)] + [("/in/b/x.pcap", i, 100 + i, 0, frame) for i in range(7)]
    out = os.path.join(d, "out")
    write_captures(spark.createDataFrame(rows, schema), out, chunk_packets=4)
    assert read_captures(spark, out).count() == 17
    write_captures(spark.createDataFrame(rows[:4], schema), out)
    assert read_captures(spark, out).count() == 4
    write_captures(spark.createDataFrame(rows[:4], schema), out, mode="append")
    assert read_captures(spark, out).count() == 8
    write_captures(spark.createDataFrame([], schema), out)
    assert read_captures(spark, out).count() == 0


def test_missing_empty_and_several_paths(spark):
    d = tempfile.mkdtemp(prefix="pcap-path-", dir="/tmp")
    with pytest.raises(Exception, match="no capture file or folder"):
        read_captures(spark, os.path.join(d, "nowhere")).count()
    os.mkdir(os.path.join(d, "empty"))
    assert read_captures(spark, os.path.join(d, "empty")).count() == 0
    recs = [(5, eth(ipv4(tcp(b"x"))))]
    os.mkdir(os.path.join(d, "a,b"))
    one = _write(os.path.join(d, "a,b"), "c.pcap", pcap_file(recs * 3))
    two = _write(d, "d.pcap", pcap_file(recs * 2))
    assert read_captures(spark, os.path.join(d, "a,b")).count() == 3
    assert read_captures(spark, [one, two]).groupBy("capture_id").count().count() == 2


def test_stream_survives_restart_and_late_names(spark):
    """Each file is read once: after a stop, with a name that sorts first, and
    with files that are deleted when read."""
    from netsift.sources.pcap import stream_captures
    d = tempfile.mkdtemp(prefix="pcap-stream-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    frame = eth(ipv4(tcp(b"x")))

    def run():
        q = (stream_captures(spark, src, "cap", 2).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).start())
        q.processAllAvailable()
        q.stop()
        return sorted(r[0] for r in spark.read.parquet(out).select("packet_no").collect())

    for i in range(1, 7):
        _write(src, f"m{i}.pcap", pcap_file([(i, frame)]))
    six = [i << 32 for i in range(1, 7)]
    assert run() == six
    assert run() == six
    _write(src, "a9.pcap", pcap_file([(9, frame)]))
    os.remove(os.path.join(src, "m1.pcap"))
    assert run() == [*six, 9 << 32]


def test_stream_idle_timeout_keeps_unordered_captures(spark):
    """A capture of an earlier time that comes later is neither late nor an error,
    with and without retention; state of closed flows times out."""
    from netsift.sources.pcap import stream_captures
    from netsift.sources.rules import rules_from_text
    from netsift.streaming.stateful import stream_verdicts
    d = tempfile.mkdtemp(prefix="pcap-idle-", dir="/tmp")
    frame = eth(ipv4(tcp(b"x")))
    src = os.path.join(d, "in")
    os.mkdir(src)
    _write(src, "m1.pcap", pcap_file([(1_000_000 + i, frame) for i in range(5)]))
    _write(src, "m2.pcap", pcap_file([(1_000 + 400 * i, frame) for i in range(10)]))
    rules = rules_from_text(spark, "[BLOCKED_IPS]\n")
    v = stream_verdicts(stream_captures(spark, src, None, 1), rules, idle_timeout_s=300)
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 15
    assert sorted(r["flow_packets"] for r in rows) == [1] * 11 + [2, 3, 4, 5]


def test_stream_takes_up_changed_rules(spark):
    """A rule added between batches blocks a flow that was labelled before it."""
    from netsift.sources.pcap import stream_captures
    from netsift.sources.rules import rules_from_text, save_rules
    from netsift.streaming.stateful import stream_verdicts
    d = tempfile.mkdtemp(prefix="pcap-live-", dir="/tmp")
    src, rules, out, ck = (os.path.join(d, x) for x in ("in", "rules", "out", "ck"))
    os.mkdir(src)
    http = eth(ipv4(tcp(b"GET / HTTP/1.1\r\nHost: www.example.org\r\n\r\n", dport=80)))
    none = rules_from_text(spark, "")
    texts = ["[BLOCKED_PORTS]\n22\n", "[BLOCKED_DOMAINS]\n*.example.org\n", "[BLOCKED_PORTS]\n22\n"]
    for n, text in enumerate(texts):
        save_rules(rules_from_text(spark, text), rules)
        _write(src, f"m{n}.pcap", pcap_file([(n * 10 + i, http) for i in range(2)]))
        v = stream_verdicts(stream_captures(spark, src, "cap"), none, live_rules=rules)
        q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(out).orderBy("packet_no").collect()
    assert [r["action"] for r in rows] == ["FORWARD"] * 2 + ["DROP"] * 4
    assert [r["drop_cause"] for r in rows] == [None, None, "RULE", "STATE", "STATE", "STATE"]
    assert {r["sni"] for r in rows} == {"www.example.org"} and rows[2]["reason_type"] == "DOMAIN"
