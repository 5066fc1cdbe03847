"""The stream's state operator: a call holds the flows of a group, not one flow."""

import json
import os
import tempfile

import pandas as pd

from frames import eth, ipv4, pcap_file, tcp
from netsift.sources.pcap import stream_captures
from netsift.sources.rules import rules_from_text
from netsift.streaming.stateful import FLOW_GROUPS, flow_state_fn, stream_verdicts

FIELDS = ("capture_id", "src_ip", "dest_ip", "src_port", "dest_port", "protocol")


class State:
    """A row of state, on a clock of its own."""

    hasTimedOut, clock = False, 0

    def __init__(self):
        self.value = self.timeout = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):
        return self.clock

    def setTimeoutDuration(self, ms):
        self.timeout = self.clock + ms


def flow(port, capture="c"):
    return json.dumps(dict(zip(FIELDS, (capture, "10.0.0.1", "10.0.0.2", port, 443, 6))))


def packet(no, ts_s=0, flags=24, **over):
    return json.dumps({"packet_no": no, "ts_us": ts_s * 1_000_000, "frame_length": 60, "payload_length": 0, "tcp_flags": flags, "cand_app": None,
                       "cand_sni": None, "cand_route": None, "const_type": None, "const_detail": None, "cand_type": None, "cand_detail": None, **over})


def call(fn, state, *rows, key=7):
    """One call for (port, packet) rows in two chunks; its verdicts as (port, number, packets of the flow)."""
    pdfs = [pd.DataFrame({"flow": [flow(p) for p, _ in part], "packet": [x for _, x in part]}) for part in (rows[:2], rows[2:]) if part]
    out = [json.loads(v) for pdf in fn((key,), iter(pdfs), state) for v in pdf["verdict"]]
    return [(v["src_port"], v["packet_no"], v["flow_packets"]) for v in out]


def test_a_call_holds_many_flows():
    fn, state = flow_state_fn(False, None), State()
    assert call(fn, state, (1, packet(3)), (2, packet(1)), (1, packet(2)), (3, packet(4))) == [(2, 1, 1), (1, 2, 1), (1, 3, 2), (3, 4, 1)]
    assert call(fn, state, (3, packet(6)), (1, packet(5)), (4, packet(7))) == [(1, 5, 3), (3, 6, 2), (4, 7, 1)]


def test_flows_of_a_group_idle_apart():
    fn, state = flow_state_fn(False, 300), State()
    call(fn, state, (1, packet(1, 0)), (2, packet(2, 0)))
    assert call(fn, state, (1, packet(3, 300)), (2, packet(4, 301)), (1, packet(5, 601))) == [(1, 3, 2), (2, 4, 1), (1, 5, 1)]


def test_flows_of_a_group_are_let_go_one_by_one():
    """As with a timeout for each flow: closed ones go after ``retain_s`` without packets, others stay, the group goes with its last one."""
    fn, state = flow_state_fn(False, None, retain_s=10), State()
    call(fn, state, (1, packet(1, flags=4)), (2, packet(2)), (3, packet(3, flags=4)))
    assert state.timeout == 10_000
    state.clock, state.timeout = 5_000, None
    assert call(fn, state, (3, packet(4))) == [(3, 4, 2)] and state.timeout == 10_000     # 1 goes at 10 s, 3 now at 15 s
    state.clock, state.timeout = 10_001, None
    assert call(fn, state, (2, packet(5))) == [(2, 5, 2)] and state.timeout == 15_000     # 1 has gone with this call
    assert call(fn, state, (1, packet(6)), (3, packet(7))) == [(1, 6, 1), (3, 7, 3)]
    state.clock, state.timeout, state.hasTimedOut = 30_000, None, True
    assert call(fn, state) == [] and state.exists and state.timeout is None               # 1 and 2 are open and stay
    state.hasTimedOut = False
    assert call(fn, state, (2, packet(8, flags=4)), (3, packet(9, flags=4)), (1, packet(10, flags=4))) == [(2, 8, 3), (3, 9, 1), (1, 10, 2)]
    state.clock, state.hasTimedOut = 40_001, True
    assert call(fn, state) == [] and not state.exists


def test_rows_of_state_do_not_grow_with_flows(spark):
    d = tempfile.mkdtemp(prefix="groups-", dir="/tmp")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    flows = FLOW_GROUPS + 1000
    for n in range(2):
        with open(f"{src}/m{n}.pcap", "wb") as f:
            f.write(pcap_file([(n, eth(ipv4(tcp(b"", sport=1024 + port)))) for port in range(flows)]))
        v = stream_verdicts(stream_captures(spark, src, "cap"), rules_from_text(spark, "[BLOCKED_IPS]\n"))
        q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= FLOW_GROUPS
        q.stop()
    got = spark.read.parquet(out).groupBy("src_port").agg({"flow_packets": "max", "*": "count"}).collect()
    assert len(got) == flows and {tuple(r)[1:] for r in got} == {(2, 2)}
