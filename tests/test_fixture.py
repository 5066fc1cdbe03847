"""Fixture capture totals (expected values from a sequential simulation) and oracle checks."""

import duckdb

from netsift.plans import catalog
from conftest import SF001


def test_expected_totals_sf0001(spark):
    ins = catalog.inspection(spark, SF001)
    s = ins.packet_stats().collect()[0]
    assert (s["total_packets"], s["tcp_packets"], s["udp_packets"], s["total_bytes"]) == (1000, 800, 200, 91712)
    assert (s["forwarded"], s["dropped"]) == (634, 366)
    f = ins.flow_stats().collect()[0]
    assert (f["total_seen"], f["classified"], f["blocked"]) == (75, 247, 107)
    reasons = {r["reason_type"]: r["count"] for r in ins.block_events().groupBy("reason_type").count().collect()}
    assert reasons == {"IP": 11, "APP": 19, "DOMAIN": 77}
    finals = {r["state"]: r["count"] for r in ins.flows.groupBy("state").count().collect()}
    assert finals == {"CLASSIFIED": 45, "BLOCKED": 27, "CLOSED": 3}


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return len(rows), [cols[i] for i in order], sorted(
        repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def test_oracle_subset_sf0001(spark):
    import __spark_entry__ as entry
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF001}/events.parquet')")
    qs, oracle = entry.queries(), entry.oracle_sql()
    for name in ("packet_verdicts", "final_flows", "app_breakdown", "top_domains", "inspection_metrics",
                 "rule_verdict", "bidirectional_flows", "flow_sessions", "admitted_packets"):
        df = qs[name](spark, SF001)
        res = con.execute(oracle[name])
        assert _digest(df.columns, [tuple(r) for r in df.collect()]) == \
            _digest([d[0] for d in res.description], res.fetchall()), name


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() == 1
    assert df.columns == ["total_packets", "total_bytes", "tcp_packets", "udp_packets", "forwarded", "dropped",
                          "drop_rate"]


def test_streaming_equals_batch_sf0001(spark):
    """Keyed-state streaming verdicts over rotated capture files equal the batch verdicts."""
    s = catalog.stream_verdicts(spark, SF001)
    b = catalog.inspection(spark, SF001).verdicts.select(
        "ts_us", *catalog.KEY5, "state", "action", "app_type", "sni", "drop_cause",
        "block_reason.type", "block_reason.detail")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))
    t = catalog.stream_totals(spark, SF001).collect()[0]
    assert (t["total_packets"], t["total_bytes"]) == (1000, 91712)



def test_adaptive_hot_flow_switch(spark):
    """Flows above the threshold take the chunked plan, the others don't; results stay the same."""
    from netsift.plans.fixture import FIXTURE_RULES_TEXT, fixture_frames
    from netsift.plans.inspect import Inspection
    from netsift.sources.rules import rules_from_text
    raw, rules = fixture_frames(spark, SF001), rules_from_text(spark, FIXTURE_RULES_TEXT)
    cold = Inspection(raw, rules, hot_flow_threshold=10_000)
    hot = Inspection(raw, rules, hot_flow_threshold=13, hot_flow_chunk=97)
    assert cold.heavy is None and 0 < hot.heavy.count() < hot.flows.count()
    cols = ["packet_no", "state", "action", "app_type", "sni", "drop_cause", "flow_packets"]
    assert sorted(map(tuple, hot.verdicts.select(*cols).collect())) == \
        sorted(map(tuple, cold.verdicts.select(*cols).collect()))


def test_one_flow_with_half_of_all_packets(spark, tmp_path):
    """The hot flow is split over chunks; verdicts equal those of the single sort."""
    from pyspark.sql import functions as F

    from netsift.plans.fixture import FIXTURE_RULES_TEXT, encode_frames, synthetic_packets
    from netsift.plans.inspect import Inspection
    from netsift.sources.rules import rules_from_text
    hot = F.col("packet_no") % 2 == 0
    same = {"src_ip": "10.9.9.9", "dest_ip": "93.184.0.1", "src_port": 40000, "dest_port": 443, "protocol": 6}
    pk = synthetic_packets(spark, SF001)
    frames = encode_frames(pk.withColumns({c: F.when(hot, v).otherwise(F.col(c)) for c, v in same.items()}))
    frames.write.parquet(str(tmp_path / "frames"))  # as captures are: the plans begin with a scan
    raw = spark.read.parquet(str(tmp_path / "frames"))
    rules = rules_from_text(spark, FIXTURE_RULES_TEXT)
    one, split = Inspection(raw, rules), Inspection(raw, rules, hot_flow_threshold=100, hot_flow_chunk=64)
    assert split.heavy.count() == 1
    cols = ["packet_no", "src_ip", "state", "action", "app_type", "sni", "drop_cause", "flow_packets", "flow_bytes"]
    assert sorted(map(tuple, split.verdicts.select(*cols).collect())) == sorted(map(tuple, one.verdicts.select(*cols).collect()))
