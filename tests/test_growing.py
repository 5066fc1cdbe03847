"""Streams over capture files that are still being written."""

import os
import struct
import tempfile

import pytest

from frames import eth, ipv4, pcap_file, tcp
from netsift.sources.growing import Growth, GrowthReader, Notes, follow_captures
from netsift.sources.pcap import read_captures


def _pcap(sizes):
    return pcap_file([(n, eth(ipv4(tcp(bytes([n % 251]) * size)))) for n, size in enumerate(sizes)])


@pytest.fixture
def folder():
    d = tempfile.mkdtemp(prefix="growing-", dir="/tmp")
    for x in ("in", "out", "ck"):
        os.mkdir(os.path.join(d, x))
    return [os.path.join(d, x) for x in ("in", "out", "ck")]


@pytest.mark.parametrize("noted", [True, False])
def test_every_cut_gives_each_record_once(folder, noted):
    """Read on at every possible size, a byte at a time, with notes and with none."""
    whole = _pcap([0, 3, 40, 1, 0])
    path, notes = os.path.join(folder[0], "a.pcap"), Notes(folder[1])
    got = []
    for size in range(len(whole) + 1):
        with open(path, "wb") as f:
            f.write(whole[:size])
        growth = notes.growth(path, max(size - 1, 0), size)
        got += [(r[0], r[1]) for r in growth.read()]
        assert not growth.ended
        if noted:
            notes.put(growth)
    assert got == [(n, n) for n in range(5)] and (growth.at, growth.records) == (len(whole), 5)
    if noted:
        notes.keep({path: len(whole), "another": 3})
        assert len(os.listdir(folder[1])) == 1


def test_size_bounds_a_repeated_batch(folder):
    """What was appended after a batch was planned is left to the next one."""
    whole = _pcap([5, 5, 5])
    path = os.path.join(folder[0], "a.pcap")
    with open(path, "wb") as f:
        f.write(whole)
    cut = len(whole) - 1
    assert [r[1] for r in Growth(path, cut).read()] == [0, 1]
    r = GrowthReader({"path": folder[0], "notes": folder[1]})
    assert r.initialOffset() == {} and r.latestOffset() == {path: len(whole)}
    (p,) = r.partitions({path: cut}, {path: len(whole)})
    for _ in range(2):  # also when the task is repeated
        assert [b.column("packet_no").to_pylist() for b in r.read(p)] == [[2]]
    assert r.partitions({path: cut}, {path: cut}) == [] and r.partitions({path: 9}, {}) == []


def test_appended_files_over_restarts(spark, folder):
    src, out, ck = folder
    a, b = _pcap([1, 30, 0, 7, 900]), _pcap([3] * 9000)     # more than one Arrow batch
    bad = _pcap([4, 4]) + struct.pack("<IIII", 1, 1, 1 << 30, 1) + b"x" * 40
    steps = [{"a1.pcap": a[:10], "none.pcap": b""},          # not even a header
             {"a1.pcap": a[:24 + 16 + 20], "b2.pcap": b[:len(b) // 2 + 3], "odd.pcap": b"no capture at all, but long enough"},
             {"a1.pcap": a[:-1], "bad3.pcap": bad[:-45]},
             {"a1.pcap": a, "b2.pcap": b, "bad3.pcap": bad}]
    q = None
    for n, files in enumerate(steps):
        for name, content in files.items():
            with open(os.path.join(src, name), "r+b" if os.path.exists(os.path.join(src, name)) else "wb") as f:
                f.write(content)                             # the same bytes, and more
        if n in (0, 2):                                      # a restart in between
            if q is not None:
                q.stop()
            q = (follow_captures(spark, src, "cap").writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ck).start())
        q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in read_captures(spark, src, capture_id="cap").collect())
    assert len(got) == 5 + 9000 + 2
