"""Named queries over the fixture capture, one per operator of the inventory.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the oracle SQL of the same name (``oracle_sql.py``). All of them read
the fixture capture, which Spark derives from the ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions import hosts, names
from netsift.operators import flowstate, reports
from netsift.operators import rules as R
from netsift.operators.candidates import with_candidates
from netsift.operators.decode import admit, decode
from netsift.plans.fixture import CAPTURE_ID, FIXTURE_RULES_TEXT, fixture_frames
from netsift.plans.inspect import Inspection
from netsift.sources.pcap import list_captures, order_by_number, read_capture_headers, read_captures, stream_captures, write_captures, write_forwarded
from netsift.sources.rules import load_rules, rules_from_text, save_rules
from netsift.schema import FLOW_KEY
from netsift.session import scratch_path

KEY5 = ["src_ip", "dest_ip", "src_port", "dest_port", "protocol"]

# Rules used by the single-rule queries (blocked_by_*, rule_verdict).
EXTRA_RULES_TEXT = """[BLOCKED_IPS]
10.0.0.5
10.0.1.7

[BLOCKED_APPS]
GitHub
Twitter/X

[BLOCKED_DOMAINS]
www.youtube.com
mail.google.com
*.ads.example.org
*.example.net

[BLOCKED_PORTS]
8080
"""

_CACHE: dict = {}


def inspection(spark: SparkSession, sf_dir: str, rules_text: str = FIXTURE_RULES_TEXT,
               idle_timeout_s: int | None = None, hot_flow_chunk: int | None = None) -> Inspection:
    """One lazily built inspection per (session, data, rules, options)."""
    key = (spark.sparkContext.applicationId, sf_dir, rules_text, idle_timeout_s, hot_flow_chunk)
    if key not in _CACHE:
        raw = fixture_frames(spark, sf_dir)
        _CACHE[key] = Inspection(raw, rules_from_text(spark, rules_text), idle_timeout_s, hot_flow_chunk)
    return _CACHE[key]


def _packets(spark, sf_dir) -> DataFrame:
    return inspection(spark, sf_dir).packets


# --- packet totals and decoding -------------------------------------------------

def packet_totals(spark, sf_dir):
    return reports.packet_totals(_packets(spark, sf_dir))


def action_totals(spark, sf_dir):
    return reports.action_totals(inspection(spark, sf_dir).verdicts)


def drop_rate(spark, sf_dir):
    return inspection(spark, sf_dir).packet_stats().select("total_packets", "dropped", "drop_rate")


def admitted_packets(spark, sf_dir):
    p = admit(decode(fixture_frames(spark, sf_dir)))
    return p.select("packet_no", "ts_us", *KEY5, "tcp_flags", "ttl", "src_mac", "dest_mac",
                    "frame_length", "payload_length", "payload_offset")


def flow_keys(spark, sf_dir):
    return _packets(spark, sf_dir).groupBy(*KEY5).agg(F.min("packet_no").alias("first_packet_no"))


def flow_counters(spark, sf_dir):
    return flowstate.flow_counters(_packets(spark, sf_dir), KEY5)


def running_counters(spark, sf_dir):
    return inspection(spark, sf_dir).verdicts.select("packet_no", "flow_packets", "flow_bytes")


# --- scalar functions ------------------------------------------------------------

def protocol_names(spark, sf_dir):
    return (_packets(spark, sf_dir).groupBy("protocol")
            .agg(F.count(F.lit(1)).alias("packets"))
            .select("protocol", names.protocol_name("protocol").alias("protocol_name"), "packets"))


def tcp_flag_names(spark, sf_dir):
    return (_packets(spark, sf_dir).where(F.col("has_tcp")).groupBy("tcp_flags")
            .agg(F.count(F.lit(1)).alias("packets"))
            .select("tcp_flags", names.tcp_flag_names("tcp_flags").alias("flag_names"), "packets"))


def ip_to_long(spark, sf_dir):
    return (_packets(spark, sf_dir).select("src_ip").distinct()
            .select("src_ip", names.ip_to_long("src_ip").alias("ip_long")))


def long_to_ip(spark, sf_dir):
    return (_packets(spark, sf_dir).select("dest_ip").distinct()
            .select("dest_ip", names.long_to_ip(names.ip_to_long("dest_ip")).alias("ip_text")))


def host_app(spark, sf_dir):
    c = with_candidates(_packets(spark, sf_dir)).where(F.col("cand_route").isin("TLS", "HTTP"))
    return c.select("cand_sni").distinct().select(F.col("cand_sni").alias("host"),
                                                  names.host_app("cand_sni").alias("app"))


def packet_candidates(spark, sf_dir):
    c = with_candidates(_packets(spark, sf_dir)).where(F.col("cand_route").isNotNull())
    return c.select("packet_no", "cand_app", "cand_sni", "cand_route")


def tls_sni(spark, sf_dir):
    p = _packets(spark, sf_dir).where(F.col("payload_length") > 0)
    return p.select("packet_no", hosts.tls_sni(F.col("payload")).alias("sni")).where(F.col("sni").isNotNull())


def http_host(spark, sf_dir):
    p = _packets(spark, sf_dir).where((F.col("payload_length") > 0) & (F.col("dest_port") == 80))
    return p.select("packet_no", hosts.http_host(F.col("payload")).alias("host")).where(F.col("host").isNotNull())


def dns_name(spark, sf_dir):
    p = _packets(spark, sf_dir).where((F.col("payload_length") > 0)
                                      & ((F.col("dest_port") == 53) | (F.col("src_port") == 53)))
    return p.select("packet_no", hosts.dns_name(F.col("payload")).alias("name")).where(F.col("name").isNotNull())


def quic_sni(spark, sf_dir):
    """Hosts in QUIC Initials (S10, C10); the capture's TLS, HTTP, DNS and opaque payloads in the clear give none."""
    from netsift.plans.fixture import quic_frames
    p = admit(decode(quic_frames(spark, sf_dir))).where(F.col("payload_length") > 0)
    return p.select("packet_no", hosts.quic_sni(F.col("payload")).alias("sni")).where(F.col("sni").isNotNull())


# --- rule matching ---------------------------------------------------------------

def _extra(spark, sf_dir):
    ins = inspection(spark, sf_dir, EXTRA_RULES_TEXT)
    return ins, ins.tables


def blocked_by_ip(spark, sf_dir):
    ins, rt = _extra(spark, sf_dir)
    m = R.mark_ip_port(ins.packets.select("packet_no", "src_ip", "dest_port"), rt)
    return m.where("ip_hit").groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"))


def blocked_by_port(spark, sf_dir):
    ins, rt = _extra(spark, sf_dir)
    m = R.mark_ip_port(ins.packets.select("packet_no", "src_ip", "dest_port"), rt)
    return m.where("port_hit").groupBy("dest_port").agg(F.count(F.lit(1)).alias("packets"))


def _cands_marked(spark, sf_dir):
    ins, rt = _extra(spark, sf_dir)
    c = with_candidates(ins.packets).where(F.col("cand_route").isNotNull())
    return R.mark_app_domain(c, rt, "cand_app", "cand_sni", ""), rt


def blocked_by_app(spark, sf_dir):
    m, _ = _cands_marked(spark, sf_dir)
    return m.where("app_hit").groupBy("cand_app").agg(F.count(F.lit(1)).alias("packets"))


def blocked_by_domain(spark, sf_dir):
    m, _ = _cands_marked(spark, sf_dir)
    return m.where("domain_hit").groupBy("cand_sni").agg(F.count(F.lit(1)).alias("packets"))


def rule_verdict(spark, sf_dir):
    ins, rt = _extra(spark, sf_dir)
    c = with_candidates(ins.packets).where(F.col("cand_route").isNotNull())
    v = R.verdict(c, rt, app="cand_app", domain="cand_sni")
    return v.where(F.col("block_reason").isNotNull()).select(
        "packet_no", F.col("block_reason.type").alias("reason_type"),
        F.col("block_reason.detail").alias("reason_detail"))


# --- flow state and verdicts -----------------------------------------------------

def packet_verdicts(spark, sf_dir):
    v = inspection(spark, sf_dir).verdicts
    return v.select("packet_no", *KEY5, "state", "action", "app_type", "sni", "drop_cause",
                    F.col("block_reason.type").alias("reason_type"),
                    F.col("block_reason.detail").alias("reason_detail"))


def split_flow_verdicts(spark, sf_dir):
    """Packet verdicts from the hot-flow plan: every flow split into chunks of
    500 packet numbers (about 20 per fixture flow), prefixes combined."""
    v = inspection(spark, sf_dir, hot_flow_chunk=500).verdicts
    return v.select("packet_no", *KEY5, "state", "action", "app_type", "sni", "drop_cause",
                    F.col("block_reason.type").alias("reason_type"),
                    F.col("block_reason.detail").alias("reason_detail"), "flow_packets", "flow_bytes")


def tcp_states(spark, sf_dir):
    v = inspection(spark, sf_dir).verdicts
    return v.groupBy("state").agg(F.count(F.lit(1)).alias("packets"))


def block_events(spark, sf_dir):
    return inspection(spark, sf_dir).block_events().select("packet_no", *KEY5, "reason_type", "reason_detail")


def final_flows(spark, sf_dir):
    f = inspection(spark, sf_dir).flows
    return f.select(*KEY5, "state", "app_type", "sni", "packets_out", "bytes_out")


def closed_override(spark, sf_dir):
    f = inspection(spark, sf_dir).flows
    closes = f.where(F.col("protocol") == 17).select(*FLOW_KEY)
    return flowstate.close_flows(f, closes).select(*KEY5, "state")


def operator_closes(spark, sf_dir) -> DataFrame:
    """An operator's close calls: every flow in the middle of its packet numbers, and those to port 80 after their last."""
    seen = _packets(spark, sf_dir).groupBy(*FLOW_KEY).agg(F.min("packet_no").alias("lo"), F.max("packet_no").alias("hi"))
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint") + 1
    calls = F.when(F.col("dest_port") == 80, F.array(middle, F.col("hi") + 1)).otherwise(F.array(middle))
    return seen.select(*FLOW_KEY, F.explode(calls).alias("packet_no"))


def _closed_in_time(spark, sf_dir) -> Inspection:
    key = (spark.sparkContext.applicationId, sf_dir, "closes")
    if key not in _CACHE:
        _CACHE[key] = Inspection(fixture_frames(spark, sf_dir), rules_from_text(spark, FIXTURE_RULES_TEXT),
                                 closes=operator_closes(spark, sf_dir))
    return _CACHE[key]


def closed_verdicts(spark, sf_dir):
    """Verdicts with flows closed by key while the capture runs: their next packets are inspected anew."""
    return _closed_in_time(spark, sf_dir).verdicts.select(
        "packet_no", *KEY5, "state", "action", "app_type", "sni", "drop_cause", "rule_block",
        F.col("block_reason.type").alias("reason_type"), F.col("block_reason.detail").alias("reason_detail"))


def closed_flows(spark, sf_dir):
    """The flow table with those closes, a call after a flow's last packet included."""
    return _closed_in_time(spark, sf_dir).flows.select(*KEY5, "state", "app_type", "sni", "packets_out", "bytes_out")


def flow_totals(spark, sf_dir):
    return inspection(spark, sf_dir).flow_stats()


def app_breakdown(spark, sf_dir):
    return inspection(spark, sf_dir).app_breakdown()


def top_domains(spark, sf_dir):
    return inspection(spark, sf_dir).top_domains()


def top_domains_pages(spark, sf_dir):
    """Top-20 domains over the capture derived from ``pages`` (more than 20 names, ties)."""
    from netsift.plans.fixture import pages_frames
    key = (spark.sparkContext.applicationId, sf_dir, "pages")
    if key not in _CACHE:
        _CACHE[key] = Inspection(pages_frames(spark, sf_dir), rules_from_text(spark, "[BLOCKED_IPS]\n"))
    return _CACHE[key].top_domains()


def inspection_metrics(spark, sf_dir):
    return reports.inspection_metrics(inspection(spark, sf_dir).verdicts)


def recent_flows(spark, sf_dir):
    f = inspection(spark, sf_dir).flows
    return flowstate.retain_recent_flows(f, 100, KEY5).select(*KEY5, "last_seen_us")


def _bounded(spark, sf_dir) -> Inspection:
    """The fixture inspected with a table of 60 flows, the table found chunk by chunk."""
    return Inspection(fixture_frames(spark, sf_dir), rules_from_text(spark, FIXTURE_RULES_TEXT), max_flows=60, table_chunk=1 << 11)


def evicting_verdicts(spark, sf_dir):
    """Verdicts with a flow table of 60 flows: flows pushed out start anew (H4)."""
    return _bounded(spark, sf_dir).verdicts.select(
        "packet_no", *KEY5, "flow_instance", "state", "action", "app_type", "sni", "drop_cause", "flow_packets")


def evicted_flows(spark, sf_dir):
    """How often each flow was pushed out of a table of 60 flows and came back."""
    return _bounded(spark, sf_dir).verdicts.groupBy(*KEY5).agg(F.max("flow_instance").alias("returns"))


#: Changes of the fixture's rules: seconds after the capture's first packet, op, kind and value.
RULE_CHANGES = [
    (400_000, "add", "DOMAIN", "mail.google.com"), (400_000, "remove", "DOMAIN", "www.youtube.com"),
    (800_000, "add", "IP", "10.0.0.9"), (800_000, "add", "APP", "Twitter/X"), (900_000, "remove", "DOMAIN", "*.ads.example.org"),
    (1_200_000, "remove", "APP", "GitHub"), (1_200_000, "add", "PORT", "8080"), (1_500_000, "add", "APP", "Unknown"),
    (1_600_000, "remove", "APP", "Unknown"), (1_700_000, "add", "DOMAIN", "www.youtube.com"), (1_800_000, "remove", "PORT", "8080"),
    (2_100_000, "remove", "IP", "10.0.0.5"), (2_100_000, "add", "DOMAIN", "*.example.net")]


def rule_changes(spark, sf_dir) -> DataFrame:
    """RULE_CHANGES in the capture's own time."""
    start = _packets(spark, sf_dir).agg(F.min("ts_us")).first()[0] or 0
    return spark.createDataFrame([(start + s * 1_000_000, *c) for s, *c in RULE_CHANGES],
                                 "valid_from_us bigint, op string, rule_type string, value string")


def _versioned(spark, sf_dir) -> Inspection:
    return Inspection(fixture_frames(spark, sf_dir), rules_from_text(spark, FIXTURE_RULES_TEXT), rule_changes=rule_changes(spark, sf_dir))


def versioned_rule_verdicts(spark, sf_dir):
    """Verdicts under rules that are added and removed while the capture runs."""
    return _versioned(spark, sf_dir).verdicts.select(
        "packet_no", *KEY5, "state", "action", "app_type", "sni", "drop_cause",
        F.col("block_reason.type").alias("reason_type"), F.col("block_reason.detail").alias("reason_detail"))


def versioned_rule_spans(spark, sf_dir):
    """From which to which version of the rules each value was one."""
    from netsift.operators.versions import rule_versions
    rv = rule_versions(data_rules(spark, sf_dir), rule_changes(spark, sf_dir))
    return rv.spans.select("rule_type", "value", F.explode("spans").alias("s")).select("rule_type", "value", "s.lo", "s.hi")


def idle_split_flows(spark, sf_dir):
    f = inspection(spark, sf_dir, idle_timeout_s=300).flows
    return f.select(*KEY5, "flow_instance", "state", "app_type", "sni", "packets_out")


#: Packets of a capture file that a query writes: a capture becomes as many files, and tasks, as it needs.
FILE_PACKETS = 1 << 14


def merged_captures(spark, sf_dir):
    """Two captures (TCP and UDP packets, written apart as rotated files) loaded as
    one table (I6); a flow belongs to its capture, so the breakdown is of both (F9)."""
    frames = fixture_frames(spark, sf_dir)
    packets = decode(frames).where(F.col("packet_no").isNotNull())
    read = []
    for name, number in (("tcp", 6), ("udp", 17)):
        own = packets.where(F.col("protocol") == number).select(*frames.columns)
        path = scratch_path(spark, f"merge-{name}")
        write_captures(own.withColumn("capture_id", F.lit(name)), path, chunk_packets=FILE_PACKETS)
        read.append(read_captures(spark, path, split_size=256 << 10, capture_id=name))
    return Inspection(read[0].unionByName(read[1]), rules_from_text(spark, FIXTURE_RULES_TEXT)).app_breakdown()


def split_capture_scan(spark, sf_dir):
    """The fixture written as rotated files by many tasks, and each file read as ranges
    of records found in parallel; ``packet_no`` is the record's index in the capture."""
    path = scratch_path(spark, "rotated-files")
    write_captures(fixture_frames(spark, sf_dir), path, chunk_packets=FILE_PACKETS)
    p = admit(decode(read_captures(spark, path, split_size=64 << 10, capture_id=CAPTURE_ID)))
    index = F.shiftright("packet_no", 32) * FILE_PACKETS + F.col("packet_no").bitwiseAND(0xFFFFFFFF)
    return p.select(index.alias("packet_no"), "ts_us", *KEY5, "tcp_flags", "frame_length",
                    F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("payload_sha256"))


def forwarded_packets(spark, sf_dir):
    fwd = inspection(spark, sf_dir).forwarded()
    return fwd.select("packet_no", F.octet_length("data").cast("int").alias("frame_length"))


def _forwarded_capture(spark, sf_dir) -> str:
    """Write the forwarded packets as capture files; returns the folder."""
    path = scratch_path(spark, "forwarded")
    ins = inspection(spark, sf_dir)
    write_forwarded(ins.raw, ins.verdicts, path, chunk_packets=FILE_PACKETS)
    return path


def capture_roundtrip(spark, sf_dir):
    """Forwarded packets written as capture files (A4), scanned back (A1) and decoded."""
    p = admit(decode(read_captures(spark, _forwarded_capture(spark, sf_dir))))
    return p.select("ts_us", *KEY5, "tcp_flags", "frame_length")


def capture_headers(spark, sf_dir):
    """Global headers of the written capture files (A2)."""
    return read_capture_headers(spark, _forwarded_capture(spark, sf_dir)).drop("capture_id")


# --- streaming ------------------------------------------------------------------

def _rotated(spark, sf_dir) -> str:
    """The fixture capture as rotated files of at most FILE_PACKETS packets (at least
    about six files), written by as many tasks and stamped in capture order."""
    path = scratch_path(spark, "stream-in")
    frames = fixture_frames(spark, sf_dir)
    last = frames.agg(F.max("packet_no")).first()[0] or 0
    write_captures(frames, path, chunk_packets=min(FILE_PACKETS, last // 6 + 1))
    order_by_number(spark, path)
    return path


#: Micro-batches that a folder of more files than a few is read in. Each has a fixed cost (a task and a commit
#: for every partition of the state), so their number must not grow with the capture.
STREAM_BATCHES = 4


#: How often it is looked whether a stream has its first batch behind it. A stream in event time that is stopped between its
#: last batch with data and the one without, which writes what that closed, has it written only with new data.
STOP_POLL_S = 0.02


def _batch_files(src: str, least: int = 2) -> int:
    """Files that a micro-batch over the folder takes: ``least``, or a share of a long capture."""
    return max(least, -(-len(list_captures(src)) // STREAM_BATCHES))


def _capture_stream(spark, sf_dir):
    """Rotated capture files, read as a stream (A8) in several micro-batches."""
    src = _rotated(spark, sf_dir)
    return stream_captures(spark, src, CAPTURE_ID, _batch_files(src, 3))


def _copy_grown(spark, files: list[tuple[str, str, int]]) -> None:
    """Copies (file, target, bytes): as much of each capture file as its writer has got to, by a task for each."""
    def copy(batches):
        from netsift.sources.pcap import _fs_path
        for batch in batches:
            for file, target, size in zip(*(c.to_pylist() for c in batch.columns)):
                (source, p), (sink, t) = _fs_path(file), _fs_path(target)
                with source.open_input_stream(p) as f, sink.open_output_stream(t) as out:
                    while size > 0 and (piece := f.read(min(size, 1 << 20))):
                        out.write(piece)
                        size -= len(piece)
            yield batch
    rows = spark.createDataFrame(files, "file string, target string, size bigint").repartition(len(files))
    rows.mapInArrow(copy, rows.schema).count()


def stream_growing_verdicts(spark, sf_dir):
    """Verdicts of a capture that is still being written (A8): its files up to the middle
    one, which is cut within a record; then, over a restart, the rest."""
    from netsift.session import _fs
    from netsift.sources.growing import follow_captures
    from netsift.sources.pcap import _file_number, sized_captures
    from netsift.streaming.stateful import stream_verdicts as verdict_stream
    src, out, ck = scratch_path(spark, "growing-in"), scratch_path(spark, "growing-out"), scratch_path(spark, "growing-ck")
    filesystem, p = _fs(spark, src)
    filesystem.mkdirs(p)
    files = sorted(sized_captures(_rotated(spark, sf_dir)), key=lambda f: _file_number(f[0]))
    files = [(f, f"{src}/{f.rsplit('/', 1)[-1]}", size) for f, size in files]
    half = len(files) // 2
    cut = [(f, t, size if n < half else size // 2 + 1) for n, (f, t, size) in enumerate(files[:half + 1])]
    for written in (cut, files[half:]):
        if written:
            _copy_grown(spark, written)
        v = verdict_stream(follow_captures(spark, src, CAPTURE_ID), rules_from_text(spark, FIXTURE_RULES_TEXT))
        q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(out).select(
        "ts_us", *KEY5, "state", "action", "app_type", "sni", "drop_cause", "reason_type", "reason_detail")


def _stream_verdicts(spark, sf_dir, idle_timeout_s=None, rule_changes=None):
    """Verdicts of the streaming operator; the query is stopped after its first
    batches and started again from its checkpoint."""
    from netsift.streaming.stateful import stream_verdicts as verdict_stream
    src, out, ck = _rotated(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    for wait in (0, None):
        v = verdict_stream(stream_captures(spark, src, CAPTURE_ID, _batch_files(src)), rules_from_text(spark, FIXTURE_RULES_TEXT), idle_timeout_s,
                          rule_changes=rule_changes)
        q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").start()
        if wait is None:
            q.processAllAvailable()
        else:
            while q.isActive and q.lastProgress is None:
                q.awaitTermination(STOP_POLL_S)
        q.stop()
    return spark.read.parquet(out)


def stream_verdicts(spark, sf_dir):
    """Verdicts from the streaming operator (J1), over a restart in mid-stream."""
    return _stream_verdicts(spark, sf_dir).select(
        "ts_us", *KEY5, "state", "action", "app_type", "sni", "drop_cause", "reason_type", "reason_detail")


def stream_forwarded(spark, sf_dir):
    """Forwarded packets written by the streaming capture sink (A4), over a restart in
    mid-stream, scanned back and decoded."""
    from netsift.sources.pcap import write_capture_stream
    from netsift.streaming.stateful import stream_forwarded as forwarded
    src, out, ck = _rotated(spark, sf_dir), scratch_path(spark, "stream-capture"), scratch_path(spark, "stream-ck")
    for wait in (0, None):
        q = write_capture_stream(forwarded(stream_captures(spark, src, CAPTURE_ID, _batch_files(src)), rules_from_text(spark, FIXTURE_RULES_TEXT)), out, ck)
        if wait is None:
            q.processAllAvailable()
        else:
            while q.isActive and q.lastProgress is None:
                q.awaitTermination(STOP_POLL_S)
        q.stop()
    return admit(decode(read_captures(spark, out))).select("ts_us", *KEY5, "tcp_flags", "frame_length")


def stream_versioned_rules(spark, sf_dir):
    """Streamed verdicts under rules that change while the capture runs (J6), over a restart."""
    return _stream_verdicts(spark, sf_dir, rule_changes=rule_changes(spark, sf_dir)).select(
        "ts_us", *KEY5, "state", "action", "app_type", "sni", "drop_cause", "reason_type", "reason_detail")


def stream_idle_flows(spark, sf_dir):
    """Verdicts with an idle timeout of 300 s of capture time (J2), streamed."""
    return _stream_verdicts(spark, sf_dir, 300).select(
        "ts_us", *KEY5, "state", "action", "app_type", "sni", "drop_cause", "flow_packets", "flow_bytes")


def stream_totals(spark, sf_dir):
    """Packet totals accumulated over micro-batches."""
    from netsift.streaming.stateful import running_totals, stream_totals as totals_stream
    out, ck = scratch_path(spark, "totals-out"), scratch_path(spark, "totals-ck")
    q = totals_stream(_capture_stream(spark, sf_dir), out, ck, trigger_available_now=False)
    q.processAllAvailable()
    q.stop()
    return running_totals(spark, out)


def _event_time(spark, sf_dir, build) -> DataFrame:
    """The rows that a stream in event time writes, over a restart after its first batch."""
    src, out, ck = _rotated(spark, sf_dir), scratch_path(spark, "event-out"), scratch_path(spark, "event-ck")
    for wait in (0, None):
        packets = admit(decode(stream_captures(spark, src, CAPTURE_ID, _batch_files(src)), keep_data=False))
        q = build(packets).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").start()
        if wait is None:
            q.processAllAvailable()
        else:
            while q.isActive and q.lastProgress is None:
                q.awaitTermination(STOP_POLL_S)
        q.stop()
    return spark.read.parquet(out)


def stream_window_totals(spark, sf_dir):
    """Daily packet totals, streamed in event time with a day's delay."""
    from netsift.streaming.windows import window_totals
    return _event_time(spark, sf_dir, lambda p: window_totals(p, "1 day", "1 day")).drop("capture_id")


def stream_flow_sessions(spark, sf_dir):
    """Flow sessions, streamed in event time with an hour's delay."""
    from netsift.streaming.windows import flow_sessions as sessions
    return _event_time(spark, sf_dir, lambda p: sessions(p, 300, "1 hour")).drop("capture_id")


def callback_block_events(spark, sf_dir):
    """Block events that a per-batch callback wrote (K1)."""
    from netsift.streaming.stateful import on_verdicts, replacing, stream_verdicts as verdict_stream
    out, ck = scratch_path(spark, "callback-out"), scratch_path(spark, "callback-ck")
    v = verdict_stream(_capture_stream(spark, sf_dir), rules_from_text(spark, FIXTURE_RULES_TEXT))
    q = on_verdicts(v, replacing(out, lambda b: b.where(F.col("drop_cause") == "RULE").select("ts_us", *KEY5, "reason_type", "reason_detail")), ck)
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).drop("batch")


def visited_flows(spark, sf_dir):
    """Flows and packets of each state, as a visitor on the executors wrote them, a file for each partition (K2)."""
    from netsift.sources.pcap import _fs_path
    out = scratch_path(spark, "visited")

    def visitor(partition, batches):
        import collections
        seen = collections.Counter()
        for batch in batches:
            for state, packets in zip(batch.column("state").to_pylist(), batch.column("packets_out").to_pylist()):
                seen[state, "flows"] += 1
                seen[state, "packets"] += packets
        filesystem, base = _fs_path(out)
        filesystem.create_dir(base, recursive=True)
        with filesystem.open_output_stream(f"{base}/part-{partition:05d}.csv") as f:
            f.write("".join(f"{s},{what},{n}\n" for (s, what), n in sorted(seen.items())).encode())
    flowstate.visit_flows(inspection(spark, sf_dir).flows.select("state", "packets_out"), visitor)
    wrote = spark.read.schema("state string, what string, n bigint").csv(out)
    return wrote.groupBy("state").agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("flows", "packets")])


# --- flows by key ------------------------------------------------------------------

def reverse_lookup(spark, sf_dir):
    f = inspection(spark, sf_dir).flows
    keys = flowstate.reverse_key(f.select(*FLOW_KEY)).unionByName(f.where(F.col("protocol") == 17).select(*FLOW_KEY))
    found = flowstate.lookup_flows(keys, f.select(*FLOW_KEY, "app_type", "packets_out"))
    return found.select(*KEY5, "match", "app_type", "packets_out")


def _with_replies(spark, sf_dir):
    p = _packets(spark, sf_dir).select("capture_id", "packet_no", *KEY5, "frame_length", "ts_us")
    orig = p.withColumn("packet_no", F.col("packet_no") * 2)
    reply = flowstate.reverse_key(p).withColumn("packet_no", F.col("packet_no") * 2 + 1)
    return orig.unionByName(reply)


def bidirectional_flows(spark, sf_dir):
    b = flowstate.bidirectional_flows(_with_replies(spark, sf_dir))
    return b.select(*KEY5, "packets_out", "bytes_out", "packets_in", "bytes_in")


def flow_sessions(spark, sf_dir):
    s = flowstate.flow_sessions(_packets(spark, sf_dir), 300)
    return s.select(*KEY5, "first_seen_us", "session_end_us", "packets", "bytes")


# --- rules tables ------------------------------------------------------------------

def data_rules_values(spark, sf_dir) -> DataFrame:
    """Rule values derived from the data, plus the fixture rules: every page host
    exactly and as a wildcard, every source address, and a port for each event."""
    from netsift.plans.fixture import URL_HOST_RX, synthetic_packets
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", URL_HOST_RX, 1)
    exact = pages.select(F.lit("DOMAIN").alias("rule_type"), host.alias("value")).where(F.col("value") != "")
    wild = exact.select("rule_type", F.concat(F.lit("*."), F.col("value")).alias("value"))
    ips = synthetic_packets(spark, sf_dir).select(F.lit("IP").alias("rule_type"), F.col("src_ip").alias("value"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ports = ev.select(F.lit("PORT").alias("rule_type"), (F.col("event_id") % 40 + 1000).cast("string").alias("value"))
    fixed = rules_from_text(spark, FIXTURE_RULES_TEXT).select("rule_type", "value")
    return fixed.unionByName(exact).unionByName(wild).unionByName(ips).unionByName(ports).distinct()


def pages_blocked_by_wildcard(spark, sf_dir):
    """Page hosts and names below them against a wildcard rule for every host."""
    from netsift.plans.fixture import URL_HOST_RX
    host = F.regexp_extract("url", URL_HOST_RX, 1)
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host")).where(F.col("host") != "")
    rules = hosts.select(F.lit("DOMAIN").alias("rule_type"), F.concat(F.lit("*."), F.col("host")).alias("value"),
                         F.lit(True).alias("is_pattern")).distinct()
    names = hosts.select("page_id", F.explode(F.array(
        F.upper("host"), F.concat(F.lit("a.b."), F.col("host")), F.concat(F.lit("x"), F.col("host")))).alias("name"))
    marked = R.mark_app_domain(names.withColumn("app", F.lit("Unknown")), R.rule_tables(rules), "app", "name", "")
    return marked.select("page_id", "name", F.col("domain_hit").alias("blocked"))


def data_rules(spark, sf_dir) -> DataFrame:
    """The data-derived rules written as a rules file (A5) and scanned back (A3)."""
    values = data_rules_values(spark, sf_dir).withColumn("is_pattern", F.col("value").contains("*"))
    path = scratch_path(spark, "data-rules")
    save_rules(values, path)
    return load_rules(spark, path)


def rule_counts(spark, sf_dir):
    return R.rule_counts(data_rules(spark, sf_dir))


def rules_add(spark, sf_dir):
    new = spark.createDataFrame([("IP", "10.0.0.9"), ("DOMAIN", "*.example.net"), ("DOMAIN", "www.youtube.com")],
                                "rule_type string, value string")
    return R.add_rules(data_rules(spark, sf_dir), new)


def rules_remove(spark, sf_dir):
    """Remove the fixture's facebook rule and the exact rule of every host with an https page."""
    from netsift.plans.fixture import URL_HOST_RX
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("url").startswith("https:"))
    gone = pages.select(F.lit("DOMAIN").alias("rule_type"), F.regexp_extract("url", URL_HOST_RX, 1).alias("value"))
    gone = gone.unionByName(spark.createDataFrame([("DOMAIN", "www.facebook.com")], "rule_type string, value string"))
    return R.remove_rules(data_rules(spark, sf_dir), gone)


def rules_clear(spark, sf_dir):
    """Counts per type after clearing the data-derived rules."""
    return R.rule_counts(R.clear_rules(data_rules(spark, sf_dir)))


def rule_rejected_values(spark, sf_dir):
    """Every page host and source address filed under the wrong section: an
    address and a host that no application, port or address section accepts (S13)."""
    from netsift.plans.fixture import URL_HOST_RX, synthetic_packets
    from netsift.sources.rules import parse_rules_files, rule_rejects
    host = F.regexp_extract("url", URL_HOST_RX, 1)
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(host.alias("value")).where(F.col("value") != "").distinct()
    ips = synthetic_packets(spark, sf_dir).select(F.col("src_ip").alias("value")).distinct()
    wrong = (hosts.select(F.lit("APP").alias("rule_type"), "value").unionByName(hosts.select(F.lit("PORT").alias("rule_type"), "value"))
             .unionByName(hosts.select(F.lit("IP").alias("rule_type"), "value")).unionByName(ips.select(F.lit("APP").alias("rule_type"), "value")))
    path = scratch_path(spark, "wrong-rules")
    save_rules(wrong.withColumn("is_pattern", F.lit(False)), path)
    return rule_rejects(parse_rules_files(spark, path)).select("rule_type", "raw_value", "error")


def rules_list(spark, sf_dir):
    return R.list_rules(data_rules(spark, sf_dir), "DOMAIN")


def rules_roundtrip(spark, sf_dir):
    """Data-derived rules saved and loaded a second time: the same table."""
    path = scratch_path(spark, "rules")
    save_rules(data_rules(spark, sf_dir), path)
    return load_rules(spark, path)


QUERIES = {
    "packet_totals": packet_totals, "action_totals": action_totals, "drop_rate": drop_rate,
    "admitted_packets": admitted_packets, "flow_keys": flow_keys, "flow_counters": flow_counters,
    "running_counters": running_counters, "protocol_names": protocol_names, "tcp_flag_names": tcp_flag_names,
    "ip_to_long": ip_to_long, "long_to_ip": long_to_ip, "host_app": host_app,
    "packet_candidates": packet_candidates, "tls_sni": tls_sni, "http_host": http_host, "dns_name": dns_name,
    "quic_sni": quic_sni,
    "blocked_by_ip": blocked_by_ip, "blocked_by_port": blocked_by_port, "blocked_by_app": blocked_by_app,
    "blocked_by_domain": blocked_by_domain, "rule_verdict": rule_verdict,
    "packet_verdicts": packet_verdicts, "split_flow_verdicts": split_flow_verdicts, "tcp_states": tcp_states, "block_events": block_events,
    "final_flows": final_flows, "closed_override": closed_override,
    "closed_verdicts": closed_verdicts, "closed_flows": closed_flows, "flow_totals": flow_totals,
    "app_breakdown": app_breakdown, "top_domains": top_domains, "top_domains_pages": top_domains_pages, "inspection_metrics": inspection_metrics,
    "recent_flows": recent_flows, "idle_split_flows": idle_split_flows, "evicting_verdicts": evicting_verdicts, "evicted_flows": evicted_flows,
    "versioned_rule_verdicts": versioned_rule_verdicts, "versioned_rule_spans": versioned_rule_spans,
    "stream_versioned_rules": stream_versioned_rules, "stream_window_totals": stream_window_totals,
    "stream_flow_sessions": stream_flow_sessions, "callback_block_events": callback_block_events, "visited_flows": visited_flows, "merged_captures": merged_captures,
    "forwarded_packets": forwarded_packets, "capture_roundtrip": capture_roundtrip,
    "capture_headers": capture_headers, "stream_verdicts": stream_verdicts, "stream_forwarded": stream_forwarded, "stream_growing_verdicts": stream_growing_verdicts, "stream_totals": stream_totals,
    "reverse_lookup": reverse_lookup,
    "bidirectional_flows": bidirectional_flows, "flow_sessions": flow_sessions,
    "rule_counts": rule_counts, "rules_add": rules_add, "rules_remove": rules_remove, "rules_list": rules_list,
    "rules_roundtrip": rules_roundtrip, "rules_clear": rules_clear, "rule_rejected_values": rule_rejected_values,
    "split_capture_scan": split_capture_scan, "stream_idle_flows": stream_idle_flows,
    "pages_blocked_by_wildcard": pages_blocked_by_wildcard,
}
