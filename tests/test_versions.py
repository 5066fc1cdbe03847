"""Rules that change during a capture against a walk, one packet at a time, with the rules of its time."""

import random

import pytest
from pyspark.sql import functions as F

from frames import dns_query, eth, ipv4, tcp, tls_hello, udp
from netsift.operators.decode import admit, decode
from netsift.operators.versions import rule_versions, versioned_verdicts
from netsift.sources.rules import rules_from_text
from netsift.streaming.sequential import FlowState, rules_from_rows, step_flags

FIRST = "[BLOCKED_APPS]\nGitHub\n[BLOCKED_DOMAINS]\nwww.youtube.com\n*.Example.org\n[BLOCKED_PORTS]\n8080\n"
HOSTS = [b"www.youtube.com", b"api.github.com", b"a.example.org", b"example.org", b"mail.google.com", b"plain.net", b"A.B.EXAMPLE.org"]
VALUES = [("IP", "10.0.0.1"), ("IP", "10.0.0.2"), ("PORT", "8080"), ("PORT", "443"), ("APP", "GitHub"), ("APP", "Unknown"), ("APP", "HTTPS"),
          ("DOMAIN", "www.youtube.com"), ("DOMAIN", "*.example.org"), ("DOMAIN", "*.b.example.org"), ("DOMAIN", "mail.google.com")]


def capture(rng, n):
    rows, us = [], 1_000_000_000
    for no in range(n):
        us += rng.choice((0, 10, 1000, -500))
        src = (10, 0, 0, rng.choice((1, 2, 3, 4)))
        kind = rng.randrange(6)
        flags = rng.choice((0x18, 0x18, 0x18, 0x10, 0x02, 0x12, 0x04, 0x11, 0x14))
        dport = rng.choice((443, 443, 8080, 80))
        if kind < 2:
            f = ipv4(tcp(tls_hello(rng.choice(HOSTS)), sport=rng.choice((1, 2)), dport=dport, flags=flags), src=src)
        elif kind == 2:
            f = ipv4(udp(dns_query([x for x in rng.choice(HOSTS).split(b".")])), proto=17, src=src)
        else:
            f = ipv4(tcp(rng.choice((b"", b"", b"data")), sport=rng.choice((1, 2)), dport=dport, flags=flags), src=src)
        rows.append(("cap", no, us // 1_000_000, us % 1_000_000, len(eth(f)), len(eth(f)), eth(f)))
    return rows, us


def walked(packets, first, changes):
    """{packet: its verdict}, by flow states and plain rule sets for each time."""
    held, states, out = {}, {}, {}
    for r in sorted(packets, key=lambda r: r.packet_no):
        now = {(t, v) for t, v, _ in first}
        for at, op, t, v in sorted(changes, key=lambda c: (c[0], c[1] == "add")):
            if at <= r.ts_us:
                (now.add if op == "add" else now.discard)((t, v))
        rules = held.setdefault(frozenset(now), rules_from_rows([(t, v, t == "DOMAIN" and "*" in v) for t, v in now]))
        key = (r.src_ip, r.dest_ip, r.src_port, r.dest_port, r.protocol)
        st, block = states.setdefault(key, (FlowState(), []))
        st.label_reason = rules.reason("\0", -1, st.app, st.sni)
        st.label_blk = st.label_reason is not None
        pkt = {"protocol": r.protocol, "tcp_flags": r.tcp_flags, "payload_length": r.payload_length, "frame_length": r.frame_length, "ts_us": r.ts_us,
               "cand_app": r.cand_app, "cand_sni": r.cand_sni, "cand_route": r.cand_route, "const_reason": rules.reason(r.src_ip, r.dest_port, "\0", ""),
               "cand_reason": None if r.cand_route is None else rules.reason("\0", -1, r.cand_app, r.cand_sni)}
        v = step_flags(st, pkt)
        if v["drop_cause"] == "RULE":
            block[:] = [v["reason"]]
        out[r.packet_no] = (v["state"], v["action"], v["app_type"], v["sni"], v["drop_cause"], block[0] if v["drop_cause"] else None,
                            v["assigned"], v["inspected"], v["flow_packets"])
    return out


@pytest.mark.parametrize("seed, chunk", [(1, None), (2, None), (3, 40)])
def test_against_a_walk(spark, seed, chunk):
    from netsift.operators.candidates import with_candidates
    rng = random.Random(seed)
    rows, end = capture(rng, 900)
    changes = [(rng.randrange(1_000_000_000 - 5, end), rng.choice(("add", "remove", "add")), *rng.choice(VALUES)) for _ in range(40)]
    changes += [(changes[0][0], "remove" if changes[0][1] == "add" else "add", *changes[0][2:])]  # both at one time
    raw = spark.createDataFrame(rows, "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, incl_len bigint, orig_len bigint, data binary").coalesce(2)
    packets, rules = admit(decode(raw, keep_data=False)), rules_from_text(spark, FIRST)
    table = spark.createDataFrame(changes, "valid_from_us bigint, op string, rule_type string, value string")
    got = {r.packet_no: (r.state, r.action, r.app_type, r.sni, r.drop_cause, None if r.block_reason is None else tuple(r.block_reason),
                         r.assigned, r.inspected, r.flow_packets) for r in versioned_verdicts(packets, rules, table, chunk_size=chunk).collect()}
    want = walked(with_candidates(packets).collect(), [tuple(r) for r in rules.select("rule_type", "value", "is_pattern").collect()], changes)
    assert got == want
    assert len({v[4:6] for v in want.values()}) > 8  # blocked for many reasons, now and then


def test_versions_of_times(spark):
    none = spark.createDataFrame([], "valid_from_us bigint, op string, rule_type string, value string")
    rules = rules_from_text(spark, FIRST)
    assert rule_versions(rules, none).times == []
    times = list(range(100, 5100, 10))
    rv = rule_versions(rules, spark.createDataFrame([(t, "add", "IP", f"10.0.0.{t % 200}") for t in times], none.schema))
    got = spark.createDataFrame([(t,) for t in (0, 99, 100, 101, 110, 2345, 5090, 9999)], "t bigint").select("t", rv.version(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {t: sum(x <= t for x in times) for t in (0, 99, 100, 101, 110, 2345, 5090, 9999)}
