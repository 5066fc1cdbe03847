"""Bounded flow tables against a sequential least-recently-seen table."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from netsift.operators.eviction import table_entries, with_table_instances
from netsift.schema import FLOW_KEY

SCHEMA = "capture_id string, src_ip string, dest_ip string, src_port int, dest_port int, protocol int, packet_no bigint"


def sequential(rows, n):
    """{(capture, packet): how often its flow was pushed out before}."""
    tables, out, count = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[6])):
        table, flow = tables.setdefault(r[0], OrderedDict()), r[:6]
        if flow in table:
            table.move_to_end(flow)
        else:
            if len(table) == n:
                table.popitem(last=False)
            table[flow] = None
            count[flow] = count.get(flow, -1) + 1
        out[r[0], r[6]] = count[flow]
    return out


def packets(rng):
    rows = []
    for cap, flows, many in (("a", 30, 700), ("b", 4, 150), ("c", 200, 400)):
        no = 0
        for _ in range(many):
            no += rng.choice((1, 1, 1, 2, 40))
            f = rng.choice((0, 0, 0, rng.randrange(flows), rng.randrange(flows // 3 + 1)))  # one flow has most packets
            rows.append((cap, f"10.0.0.{f}", "93.0.0.1", 1000 + f, 443, 6, no))
    return rows + [("d", "10.0.0.1", "93.0.0.1", 1, 443, 6, (k << 32) + i) for k in range(3) for i in range(5)]  # rotated files


@pytest.mark.parametrize("n, chunk", [(1, 64), (3, 50), (10, 16), (25, 4), (60, 100), (1000, 30), (5, 1 << 18)])
def test_against_a_sequential_table(spark, n, chunk):
    rows = packets(random.Random(n))
    df = spark.createDataFrame(rows, SCHEMA)
    got = with_table_instances(df.withColumn("more", F.lit(1)), df, n, chunk)
    assert got.columns == ["capture_id", "packet_no", *[c for c in df.columns if c not in ("capture_id", "packet_no")], "more", "flow_instance"]
    assert {(r.capture_id, r.packet_no): r.flow_instance for r in got.collect()} == sequential(rows, n)


def test_no_packets_and_no_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert with_table_instances(df, df, 5).collect() == []
    with pytest.raises(ValueError):
        table_entries(df, 0)


def test_a_block_is_forgotten_with_its_flow(spark):
    """A blocked flow that was pushed out is inspected again when it comes back."""
    from frames import eth, ipv4, tcp, tls_hello
    from netsift.plans.inspect import Inspection
    from netsift.sources.rules import rules_from_text

    def frame(host, payload):
        return eth(ipv4(tcp(payload), src=(10, 0, 0, host)))
    hello, data = tls_hello(b"www.youtube.com"), b"plain bytes"
    sent = [frame(1, hello), frame(1, data), frame(2, data), frame(3, data), frame(1, data), frame(1, hello)]
    raw = spark.createDataFrame([("cap", i, 100, 0, len(f), len(f), f) for i, f in enumerate(sent)],
                                "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, incl_len bigint, orig_len bigint, data binary")
    rules = rules_from_text(spark, "[BLOCKED_DOMAINS]\nwww.youtube.com\n")

    def verdicts(**kw):
        return [(r.state, r.app_type) for r in Inspection(raw, rules, **kw).verdicts.orderBy("packet_no").collect()]
    wide, narrow = verdicts(), verdicts(max_flows=2, table_chunk=2)
    assert wide == verdicts(max_flows=3)
    assert [s for s, _ in wide] == ["BLOCKED", "BLOCKED", "CLASSIFIED", "CLASSIFIED", "BLOCKED", "BLOCKED"]
    assert narrow[:4] == wide[:4] and narrow[4] == ("CLASSIFIED", "HTTPS") and narrow[5] == ("CLASSIFIED", "HTTPS")
    with pytest.raises(ValueError):
        Inspection(raw, rules, idle_timeout_s=3, max_flows=2)
    assert set(FLOW_KEY) < set(Inspection(raw, rules, max_flows=2).key)
