"""Structured Streaming: verdicts with keyed flow state, running totals.

* :func:`stream_verdicts` (J1, J2, J3): decoded packets get their candidate
  and rule flags exactly as in batch (stream-static broadcast joins; the rule
  tables are re-read every micro-batch, J6), then
  ``applyInPandasWithState`` runs the state machine incrementally, each flow's
  packets sorted by number. A call costs a thousand times as much as a packet and
  flows are short, so flows are dealt by a hash of their key into ``FLOW_GROUPS``
  groups: a call, and a row of state, holds the flows of a group. With
  ``idle_timeout_s`` a packet that comes after a longer gap in its own flow's capture times starts the flow anew, exactly as in batch. There is no
  watermark: captures may come in any order of their times, and no row is late.
  With ``retain_s``, state is let go after that time on the clock without packets:
  for flows that are CLOSED (J3; whatever comes then is a new flow), and for idle
  ones if an idle timeout is given, never less than that. Such a query runs
  batches for as long as it lives, to see which flows timed out.
* :func:`stream_totals` (J5, K1): stateless per-batch totals written through
  ``foreachBatch``, idempotent per batch id; the running totals are their sum.
"""

from __future__ import annotations

import itertools
import json
import pickle
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netsift.operators import reports
from netsift.operators.candidates import check_candidates, with_candidates
from netsift.operators.decode import admit, decode
from netsift.operators.rules import const_reason, mark_ip_port, rule_tables
from netsift.operators.versions import APP_KIND, rule_versions, versioned_packets
from netsift.schema import FLOW_KEY, RULE_SECTIONS
from netsift.streaming.sequential import FlowState, rules_from_rows, step_flags

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

#: The flows of a group, packed, and how many bytes they have unpacked.
STATE_SCHEMA = T.StructType([T.StructField("size", _L), T.StructField("flows", T.BinaryType())])
#: Groups that flows are dealt into: enough for thousands of tasks, and few enough that one has many packets of a batch.
FLOW_GROUPS = 2048

KEY_FIELDS = [("capture_id", _S), ("src_ip", _S), ("dest_ip", _S), ("src_port", _I), ("dest_port", _I),
              ("protocol", _I)]
VERDICT_FIELDS = [("packet_no", _L), ("ts_us", _L), ("frame_length", _I), ("state", _S), ("action", _S),
                  ("app_type", _S), ("sni", _S), ("drop_cause", _S), ("reason_type", _S), ("reason_detail", _S),
                  ("assigned", _B), ("rule_block", _B), ("inspected", _B), ("flow_packets", _L), ("flow_bytes", _L)]
OUTPUT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in KEY_FIELDS + VERDICT_FIELDS])
#: What the stateful operator itself takes and gives: a flow's key, and a packet or verdict, as JSON text. It converts each
#: column of each group of a batch by itself, which costs more than the packets of a small group do, so rows cross as one column.
PACKED_SCHEMA = T.StructType([T.StructField("verdict", _S)])


def _load(state: GroupState) -> dict[str, tuple]:
    """By flow what :func:`_save` gave for it, and when on the clock it goes (None: never)."""
    if not state.exists:
        return {}
    size, flows = state.get
    return pickle.loads(pa.decompress(flows, size, codec="zstd", asbytes=True))


def _store(state: GroupState, flows: dict[str, tuple]) -> None:
    packed = pickle.dumps(flows, pickle.HIGHEST_PROTOCOL)
    state.update((len(packed), pa.compress(packed, codec="zstd", asbytes=True)))


def _restored(saved: tuple) -> FlowState:
    (s, app, sni, blk, rt, rd, syn, sa, fin, pk, by, f, l, spans, bt, bd) = saved
    return FlowState(s, app, sni, blk, None if rt is None else (rt, rd), syn, sa, fin, pk, by, f, l,
                     spans, None if bt is None else (bt, bd))


def _fresh(unknown_blocked: bool) -> FlowState:
    st = FlowState()
    if unknown_blocked:
        st.label_blk, st.label_reason = True, ("APP", "Unknown")
    return st


def _save(st: FlowState) -> tuple:
    (rt, rd), (bt, bd) = st.label_reason or (None, None), st.block_reason or (None, None)
    return (st.state, st.app, st.sni, st.label_blk, rt, rd, st.syn, st.syn_ack, st.fin, st.packets, st.bytes,
            st.first_ts, st.last_ts, st.spans, bt, bd)


class _Memo(dict):
    """What a function gives for the arguments seen lately."""

    def __init__(self, fn: Callable):
        self.fn = fn

    def __missing__(self, arg):
        if len(self) >= 1 << 16:
            self.clear()
        self[arg] = out = self.fn(arg)
        return out


def _kind_at(spans_version: tuple) -> int | None:
    """The kind of rule that blocks a label with these spans (as JSON) in a version of the rules; None without one."""
    spans, version = spans_version
    return min((s["kind"] for s in json.loads(spans or "[]") if s["lo"] <= version < s["hi"]), default=None)


#: Rules of the micro-batch's task at hand: (task attempt, path) and the sets.
_LIVE: dict = {}


def _live_rules(path: str):
    """Rule sets of the rules files under ``path`` as they are now, read once a task."""
    from pyspark import TaskContext

    from netsift.sources.pcap import _fs_path, list_captures
    key = (TaskContext.get().taskAttemptId(), path)
    if _LIVE.get("key") != key:
        rows, kinds = [], dict(RULE_SECTIONS)
        for file in list_captures(path):
            filesystem, p = _fs_path(file)
            with filesystem.open_input_stream(p) as f:
                lines = re.split(r"\r\n|\r|\n", f.read().decode("utf-8", "replace"))
            kind = None
            for line in (x.strip("".join(map(chr, range(33)))) for x in lines):
                if line.startswith("["):
                    kind = kinds.get(line)
                elif line and kind and (kind != "PORT" or line.isdecimal()):
                    rows.append((kind, line, kind == "DOMAIN" and "*" in line))
        _LIVE.update(key=key, rules=rules_from_rows(rows))
    return _LIVE["rules"]


def flow_state_fn(unknown_blocked: bool, idle_timeout_s: int | None, retain_s: int | None = None,
                  live_rules: str | None = None, first_spans: str | None = None, keep_data: bool = False) -> Callable:
    """The function for ``applyInPandasWithState`` over groups of flows: rows name theirs in the
    column ``flow``, or else a group is the flow that its key names. With ``live_rules``,
    each packet is checked against the rules that path holds when its batch runs,
    and so is the label its flow got in an earlier batch. With ``first_spans`` (those
    of the initial label), against the rules of its own time. With ``keep_data`` a
    verdict carries its frame."""
    idle_us = None if idle_timeout_s is None else idle_timeout_s * 1_000_000
    text, kind_at = _Memo(json.dumps), _Memo(_kind_at)
    truth = ("false", "true")

    def spans_reason(spans: str | None, version: int, app: str, sni: str):
        kind = kind_at[spans, version]
        return None if kind is None else ("APP", app) if kind == APP_KIND else ("DOMAIN", sni)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flows, live = _load(state), {}
        now = _live_rules(live_rules) if live_rules and not state.hasTimedOut else None
        rows = []
        for pdf in () if state.hasTimedOut else pdfs:
            of = pdf["flow"] if "flow" in pdf else itertools.repeat(key[0])
            frames = pdf["data"] if keep_data else itertools.repeat(None)
            rows += zip(of, json.loads(f"[{','.join(pdf['packet'])}]"), frames)
        rows.sort(key=lambda row: row[1]["packet_no"])
        out, data = [], []
        for flow, r, frame in rows:
            known = live.get(flow)
            if known is None:
                st = _restored(flows[flow][0]) if flow in flows else _fresh(unknown_blocked)
                _, src_ip, _, _, dest_port, protocol = json.loads(flow).values()
                known = live[flow] = [st, src_ip, dest_port, protocol]
            st, src_ip, dest_port, protocol = known
            ts = r["ts_us"]
            if idle_us is not None and st.last_ts is not None and ts - st.last_ts > idle_us:
                st = known[0] = _fresh(unknown_blocked)      # the gap shows the old flow expired
            r["protocol"] = protocol
            r["const_reason"] = None if r["const_type"] is None else (r["const_type"], r["const_detail"])
            r["cand_reason"] = None if r["cand_type"] is None else (r["cand_type"], r["cand_detail"])
            if now is not None:
                r["const_reason"] = now.reason(src_ip, dest_port, "\0", "")
                r["cand_reason"] = None if r["cand_route"] is None else now.reason("\0", -1, r["cand_app"], r["cand_sni"])
                if st.state != "BLOCKED":  # what is blocked keeps its reason
                    st.label_reason = now.reason("\0", -1, st.app, st.sni)
                    st.label_blk = st.label_reason is not None
            if first_spans is not None:
                version = r["version"]
                r["cand_reason"] = spans_reason(r["cand_spans"], version, r["cand_app"], r["cand_sni"])
                st.spans = first_spans if st.spans is None else st.spans
                st.label_reason = spans_reason(st.spans, version, st.app, st.sni)
                st.label_blk = st.label_reason is not None
            v = step_flags(st, r)
            if first_spans is not None:
                if v["assigned"]:
                    st.spans = r["cand_spans"]
                if v["drop_cause"] == "RULE":
                    st.block_reason = v["reason"]
                elif v["drop_cause"] == "STATE":
                    v["reason"] = st.block_reason
            reason = v["reason"] or (None, None)
            # VERDICT_FIELDS after the flow's key, which is JSON already.
            out.append(f'{flow[:-1]},"packet_no":{r["packet_no"]},"ts_us":{"null" if ts is None else ts},"frame_length":{r["frame_length"]},'
                       f'"state":"{v["state"]}","action":"{v["action"]}","app_type":{text[v["app_type"]]},"sni":{text[v["sni"]]},'
                       f'"drop_cause":{text[v["drop_cause"]]},"reason_type":{text[reason[0]]},"reason_detail":{text[reason[1]]},'
                       f'"assigned":{truth[v["assigned"]]},"rule_block":{truth[v["rule_block"]]},"inspected":{truth[v["inspected"]]},'
                       f'"flow_packets":{v["flow_packets"]},"flow_bytes":{v["flow_bytes"]}}}')
            data.append(frame)
        clock = None if retain_s is None else state.getCurrentProcessingTimeMs()
        if retain_s is not None:    # idle flows expire (J2), CLOSED ones too (J3)
            flows = {flow: saved for flow, saved in flows.items() if flow in live or saved[1] is None or saved[1] >= clock}
        for flow, (st, *_) in live.items():
            goes = retain_s is not None and (idle_us is not None or st.state == "CLOSED")
            flows[flow] = _save(st), clock + max(retain_s, idle_timeout_s or 0) * 1000 if goes else None
        if flows:
            _store(state, flows)
            next_ms = min((at for _, at in flows.values() if at is not None), default=None)
            if next_ms is not None:
                state.setTimeoutDuration(max(next_ms - clock, 1))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame({"verdict": out} | ({"data": data} if keep_data else {}))

    return run


def flow_verdicts(df: DataFrame, fn: Callable, timeout: str, keep_data: bool = False) -> DataFrame:
    """Runs a function of :func:`flow_state_fn` over labelled rows, keyed by groups of flows."""
    key = [n for n, _ in KEY_FIELDS]
    packet = F.to_json(F.struct(*[c for c in df.columns if c not in (*key, "ts", "data")]), {"ignoreNullFields": "false"})
    frame = ["data"] * keep_data
    packed = df.select(F.pmod(F.xxhash64(*key), F.lit(FLOW_GROUPS)).cast("int").alias("flows"),
                       F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("flow"), packet.alias("packet"), *frame)
    schema = T.StructType([*PACKED_SCHEMA, *[T.StructField(c, T.BinaryType()) for c in frame]])
    done = packed.groupBy("flows").applyInPandasWithState(fn, schema, STATE_SCHEMA, "append", timeout)
    return done.select(F.from_json("verdict", OUTPUT_SCHEMA).alias("v"), *frame).select("v.*", *frame)


def labelled_stream(raw: DataFrame, rules: DataFrame, keep_data: bool = False) -> tuple[DataFrame, bool]:
    """Narrow labelled rows of a raw-frame stream (same operators as batch), with the frame where asked."""
    rt = rule_tables(rules, materialize=False)
    p = admit(decode(raw, keep_data=keep_data))
    df = mark_ip_port(check_candidates(with_candidates(p), rt), rt)
    const = (F.when(F.col("ip_hit"), F.struct(F.lit("IP").alias("t"), F.col("src_ip").alias("d")))
             .when(F.col("port_hit"), F.struct(F.lit("PORT").alias("t"), F.col("dest_port").cast("string").alias("d"))))
    df = df.select(*FLOW_KEY, "packet_no", "ts", "ts_us", "frame_length", "payload_length", "tcp_flags",
                   "cand_app", "cand_sni", "cand_route",
                   const["t"].alias("const_type"), const["d"].alias("const_detail"),
                   F.col("cand_reason.type").alias("cand_type"), F.col("cand_reason.detail").alias("cand_detail"),
                   *(["data"] if keep_data else []))
    return df, rt.unknown_blocked


def versioned_stream(raw: DataFrame, rules: DataFrame, changes: DataFrame) -> tuple[DataFrame, str]:
    """Labelled rows of a stream with the version of the rules at each packet's time."""
    rv = rule_versions(rules, changes)
    df = versioned_packets(admit(decode(raw, keep_data=False)), rv)
    const = const_reason(F.col("ip_hit"), F.col("port_hit"), F.col("src_ip"), F.col("dest_port"))
    none = F.lit(None).cast("string")
    df = df.select(*FLOW_KEY, "packet_no", "ts", "ts_us", "frame_length", "payload_length", "tcp_flags", "cand_app", "cand_sni", "cand_route",
                   const["type"].alias("const_type"), const["detail"].alias("const_detail"), none.alias("cand_type"), none.alias("cand_detail"),
                   "version", F.to_json("cand_spans").alias("cand_spans"))
    return df, json.dumps([dict(zip(("lo", "hi", "kind"), s)) for s in rv.initial])


def stream_verdicts(raw: DataFrame, rules: DataFrame, idle_timeout_s: int | None = None, retain_s: int | None = None,
                    live_rules: str | None = None, rule_changes: DataFrame | None = None) -> DataFrame:
    """Streaming packet verdicts (J1): one output row per packet, append mode.

    ``rule_changes`` (valid_from_us, op, rule_type, value): rules that are added to
    ``rules`` or removed at those times of the capture, as in batch (J6).

    ``live_rules``: path of rules files that may change while the stream runs
    (J6); each task reads them anew, so an edit holds from the next batch on, for
    labels that flows already have as well. ``rules`` isn't used then."""
    first_spans = None
    if rule_changes is not None:
        (df, first_spans), unknown_blocked = versioned_stream(raw, rules, rule_changes), False
    else:
        df, unknown_blocked = labelled_stream(raw, rules)
    timeout = GroupStateTimeout.NoTimeout if retain_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return flow_verdicts(df, flow_state_fn(unknown_blocked, idle_timeout_s, retain_s, live_rules, first_spans), timeout)


def stream_forwarded(raw: DataFrame, rules: DataFrame, idle_timeout_s: int | None = None, retain_s: int | None = None) -> DataFrame:
    """Streaming frames of forwarded packets (A4), for ``write_capture_stream``: the
    verdicts of :func:`stream_verdicts`, but frames travel with their packets through
    the one shuffle by flow, so that no join of two streams has to remember them."""
    df, unknown_blocked = labelled_stream(raw, rules, keep_data=True)
    timeout = GroupStateTimeout.NoTimeout if retain_s is None else GroupStateTimeout.ProcessingTimeTimeout
    verdicts = flow_verdicts(df, flow_state_fn(unknown_blocked, idle_timeout_s, retain_s, keep_data=True), timeout, keep_data=True)
    second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
    return verdicts.where(F.col("action") == "FORWARD").select(
        "capture_id", "packet_no", second.alias("ts_sec"), (F.col("ts_us") - second * 1_000_000).alias("ts_usec"), "data")


def on_verdicts(verdicts: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str):
    """Per-batch callback over the verdict stream (K1); returns the started query.

    ``fn(batch, batch_id)`` may be called again for a batch after a failure: what it
    does should be keyed by ``batch_id``, as ``replacing`` does for tables."""
    return verdicts.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).start()


def replacing(path: str, of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A callback that writes ``of(batch)`` as the batch's own part of a table: a repeated batch replaces it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        of(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def stream_totals(raw: DataFrame, out_path: str, checkpoint: str, trigger_available_now: bool = True):
    """Per-batch packet totals appended to ``out_path`` (J5); returns the started query.

    Each batch overwrites only its own ``batch_id`` partition, so a retried
    batch replaces its earlier attempt instead of counting twice.
    """
    packets = admit(decode(raw, keep_data=False))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (reports.packet_totals(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    w = packets.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def running_totals(spark, out_path: str) -> DataFrame:
    """Sum of the per-batch totals written by :func:`stream_totals`."""
    t = spark.read.parquet(out_path)
    return t.agg(*[F.sum(c).cast("bigint").alias(c)
                   for c in ("total_packets", "total_bytes", "tcp_packets", "udp_packets")])
