"""Flows closed by key while the capture runs, against the sequential walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from netsift.operators.flowstate import final_flows, packet_verdicts, with_closes
from netsift.plans import catalog
from netsift.plans.inspect import HOT_FLOW_PACKETS, Inspection
from netsift.schema import FLOW_KEY
from netsift.streaming.sequential import FlowState, Rules, step
from test_flowstate import SCHEMA, _flows

CALLS = "capture_id string, src_ip string, dest_ip string, src_port int, dest_port int, protocol int, packet_no bigint"
RULES = Rules(ips=frozenset({"10.0.0.5"}), ports=frozenset({22}), apps=frozenset({"GitHub"}),
              domains=frozenset({"www.youtube.com"}), pattern_rests=("example.org",))


def _calls(rng, rows):
    """Calls at, between, before and after packets, several at once, and for flows that don't occur."""
    flows = sorted({r[:6] for r in rows})
    out = []
    for flow in flows:
        numbers = [r[6] for r in rows if r[:6] == flow]
        for _ in range(rng.choice((0, 1, 1, 3))):
            out.append((*flow, rng.choice(numbers) + rng.choice((-1, 0, 0, 1))))
        if rng.random() < 0.2:
            out.append((*flow, max(numbers) + 5))
    out += out[:20] + [(*flows[0], None), (None, *flows[0][1:], 3), ("c", "10.9.9.9", "93.0.0.1", 1, 2, 6, 7)]
    rng.shuffle(out)
    return out


def _sequential(rows, calls):
    """Verdict of each packet and the state each flow is left in; calls come before the packet of their number."""
    events = [((r[6], 1), "packet", r) for r in rows] + [((c[6], 0), "call", c) for c in calls if c[6] is not None]
    states, out = {}, {}
    for _, kind, r in sorted(events, key=lambda e: e[0]):
        if kind == "call":
            if r[:6] in states:
                states[r[:6]].state = "CLOSED"
            continue
        st = states.setdefault(r[:6], FlowState())
        out[r[6]] = step(st, {"src_ip": r[1], "dest_port": r[4], "protocol": r[5], "tcp_flags": r[11], "payload_length": r[10],
                              "frame_length": r[9], "ts_us": r[8], "cand_app": r[14], "cand_sni": r[15], "cand_route": r[16]}, RULES)
    return out, {k: st.state for k, st in states.items()}


@pytest.mark.parametrize("seed, chunk", [(11, None), (12, None), (13, 4)])
def test_closes_match_the_sequential_walk(spark, seed, chunk):
    rng = random.Random(seed)
    rows = _flows(rng, RULES, 100)
    calls = _calls(rng, rows)
    expected, left = _sequential(rows, calls)
    marked = with_closes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(calls, CALLS), chunk_size=chunk)
    verdicts = packet_verdicts(marked, False, chunk_size=chunk).cache()
    got = {r.packet_no: r for r in verdicts.collect()}
    assert got.keys() == expected.keys()
    for no, e in expected.items():
        g = got[no]
        reason = None if g.block_reason is None else (g.block_reason.type, g.block_reason.detail)
        assert (g.state, g.action, g.app_type, g.sni, g.drop_cause, reason, g.assigned, g.inspected) == (
            e["state"], e["action"], e["app_type"], e["sni"], e["drop_cause"], e["reason"], e["assigned"], e["inspected"]), no
    assert {tuple(r[c] for c in FLOW_KEY): r.state for r in final_flows(verdicts).collect()} == left
    assert sum(s == "CLOSED" for s in left.values()) > 10
    verdicts.unpersist()


def test_no_calls_change_nothing_and_extra_columns_stay_out(spark):
    rows = spark.createDataFrame(_flows(random.Random(14), RULES, 20), SCHEMA)
    none = spark.createDataFrame([], CALLS + ", frame_length string")  # a column of that name is not theirs to fill
    marked = with_closes(rows, none)
    assert marked.columns == rows.columns + ["close_before", "close_after"]
    assert marked.where("close_before or close_after").count() == 0
    same = packet_verdicts(marked, False).drop("close_after")
    assert sorted(map(str, same.collect())) == sorted(map(str, packet_verdicts(rows, False).collect()))
    assert with_closes(rows.limit(0), none).count() == 0


def test_closes_take_no_exchange_of_their_own(spark):
    df = catalog._closed_in_time(spark, SF001).verdicts
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # One exchange for the union of packets and calls; the others belong to the fixture's calls (a group by flow).
    windows = plan[:plan.index("Union")]
    assert len(re.findall(r"Exchange hashpartitioning\(capture_id#\d+, src_ip", windows)) == 1, plan
    assert len(re.findall(r"\bSort \[capture_id", windows)) == 1, plan
    plain = {r.packet_no: r.state for r in catalog.inspection(spark, SF001).verdicts.collect()}
    assert any(plain[r.packet_no] != r.state for r in df.collect())


def test_closes_with_instances_and_changing_rules(spark):
    """A close in one life of a flow is not one in the next, and rules that change go with closes."""
    raw = catalog.fixture_frames(spark, SF001)
    rules = catalog.rules_from_text(spark, "[BLOCKED_IPS]\n10.0.0.5\n")
    closes = catalog.operator_closes(spark, SF001)

    def states(**kw):
        v = Inspection(raw, rules, closes=closes, **kw).verdicts
        return {r.packet_no: (r.state, r.app_type, r.action) for r in v.select("packet_no", "state", "app_type", "action").collect()}
    plain = states()
    no_change = spark.createDataFrame([], "valid_from_us bigint, op string, rule_type string, value string")
    assert states(rule_changes=no_change) == plain
    assert states(idle_timeout_s=10**9) == plain and states(max_flows=10**6) == plain
    assert states(hot_flow_threshold=12, hot_flow_chunk=64) == plain
    alone = Inspection(raw, rules, closes=closes, max_flows=1).verdicts
    # With room for one flow, nearly every packet is its flow's first: there is nothing to close.
    assert alone.where((F.col("flow_packets") == 1) & (F.col("state") == "CLOSED") & (F.col("tcp_flags").isin(0, 2, 18, 16, 24))).count() == 0


def test_large_flows_are_split_unless_told_otherwise(spark):
    raw, rules = catalog.fixture_frames(spark, SF001), catalog.rules_from_text(spark, "[BLOCKED_IPS]\n")
    assert Inspection(raw, rules).split_above == HOT_FLOW_PACKETS
    assert Inspection(raw, rules, hot_flow_threshold=0).split_above is None
    assert Inspection(raw, rules, hot_flow_chunk=64).split_above is None
    assert Inspection(raw, rules, hot_flow_threshold=7, hot_flow_chunk=64).split_above == 7
