"""Window form of the flow state machine vs the sequential walk (property test)."""

import random

from pyspark.sql import types as T

from netsift.operators.flowstate import packet_verdicts
from netsift.streaming.sequential import FlowState, Rules, step

CANDS = [("YouTube", "www.youtube.com", "TLS"), ("Google", "mail.google.com", "TLS"),
         ("HTTPS", "", "PORT"), ("DNS", "ads.example.org", "DNS"), ("Unknown", "plain.example.com", "HTTP"),
         ("GitHub", "api.github.com", "TLS"), ("HTTP", "", "PORT")]
FLAGS = [0, 2, 18, 16, 24, 17, 4, 1, 20, 25]

SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()), T.StructField("protocol", T.IntegerType()),
    T.StructField("packet_no", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("ts_us", T.LongType()), T.StructField("frame_length", T.IntegerType()),
    T.StructField("payload_length", T.IntegerType()), T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("has_tcp", T.BooleanType()), T.StructField("has_udp", T.BooleanType()),
    T.StructField("cand_app", T.StringType()), T.StructField("cand_sni", T.StringType()),
    T.StructField("cand_route", T.StringType()), T.StructField("cand_blk", T.BooleanType()),
    T.StructField("cand_reason", T.StructType([T.StructField("type", T.StringType()),
                                               T.StructField("detail", T.StringType())])),
    T.StructField("ip_hit", T.BooleanType()), T.StructField("port_hit", T.BooleanType()),
])


def _flows(rng, rules, n_flows):
    rows, no = [], 0
    for f in range(n_flows):
        src = "10.0.0.5" if rng.random() < 0.15 else f"10.1.{f // 250}.{f % 250}"
        proto = 17 if rng.random() < 0.15 else 6
        dport = rng.choice([443, 80, 53, 8080, 22])
        for _ in range(rng.randint(1, 14)):
            no += rng.randint(1, 3)
            has_payload = rng.random() < 0.6
            cand = rng.choice(CANDS) if has_payload and rng.random() < 0.5 else None
            flags = 0 if proto == 17 else rng.choice(FLAGS)
            c_reason = None
            if cand is not None:
                r = rules.reason("x", -1, cand[0], cand[1])
                c_reason = None if r is None else {"type": r[0], "detail": r[1]}
            rows.append(("c", src, "93.0.0.1", 40000 + f, dport, proto, no, None, no * 1000, 60 + no % 7,
                         (rng.randint(1, 40) if has_payload else 0), flags if proto == 6 else None,
                         proto == 6, proto == 17,
                         cand[0] if cand else None, cand[1] if cand else None, cand[2] if cand else None,
                         c_reason is not None if cand else False, c_reason,
                         src in rules.ips, dport in rules.ports))
    return rows


def _sequential(rows, rules):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: r[6]):
        key = r[:6]
        st = states.setdefault(key, FlowState())
        pkt = {"src_ip": r[1], "dest_port": r[4], "protocol": r[5], "tcp_flags": r[11], "payload_length": r[10],
               "frame_length": r[9], "ts_us": r[8], "cand_app": r[14], "cand_sni": r[15], "cand_route": r[16]}
        out[r[6]] = step(st, pkt, rules)
    return out


def _check(spark, seed, unknown_blocked, chunk_size=None):
    rng = random.Random(seed)
    apps = {"GitHub"} | ({"Unknown"} if unknown_blocked else set())
    rules = Rules(ips=frozenset({"10.0.0.5"}), ports=frozenset({22}), apps=frozenset(apps),
                  domains=frozenset({"www.youtube.com"}), pattern_rests=("example.org",))
    rows = _flows(rng, rules, 120)
    expected = _sequential(rows, rules)
    got = packet_verdicts(spark.createDataFrame(rows, SCHEMA), unknown_blocked, chunk_size=chunk_size).collect()
    assert len(got) == len(expected)
    bad = []
    for g in got:
        e = expected[g["packet_no"]]
        reason = None if g["block_reason"] is None else (g["block_reason"]["type"], g["block_reason"]["detail"])
        pairs = [("state", g["state"], e["state"]), ("action", g["action"], e["action"]),
                 ("app", g["app_type"], e["app_type"]), ("sni", g["sni"], e["sni"]),
                 ("cause", g["drop_cause"], e["drop_cause"]), ("reason", reason, e["reason"]),
                 ("assigned", g["assigned"], e["assigned"]), ("rule_block", g["rule_block"], e["rule_block"]),
                 ("inspected", g["inspected"], e["inspected"]), ("packets", g["flow_packets"], e["flow_packets"]),
                 ("bytes", g["flow_bytes"], e["flow_bytes"])]
        bad += [(g["packet_no"], n, a, b) for n, a, b in pairs if a != b]
    assert not bad, bad[:10]


def test_window_form_matches_sequential(spark):
    for seed in (1, 2, 3):
        _check(spark, seed, unknown_blocked=False)


def test_window_form_matches_sequential_unknown_blocked(spark):
    _check(spark, 7, unknown_blocked=True)


def test_chunked_form_matches_sequential(spark):
    """Hot-flow plan: flows split into chunks of packet numbers, prefixes combined."""
    for seed, chunk in ((4, 3), (5, 7)):
        _check(spark, seed, unknown_blocked=False, chunk_size=chunk)
    _check(spark, 6, unknown_blocked=True, chunk_size=5)
