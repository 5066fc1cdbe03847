"""Ordered per-flow state (G1-G9) as window functions, and flow tables.

The packet verdict of the inspected engine is a sequential walk over each
directional flow in file order. It has an exact closed form in running window
aggregates (see ``packet_verdicts``). Every window here uses the same
partitioning (the flow key) and the same ordering (``packet_no``), so the
whole state machine costs one hash exchange and one sort; stacked Window
operators reuse the child ordering. Per-epoch and per-chain running values
are derived from flow-wide running values (they are contiguous segments), so
no second partitioning is introduced.

Columns expected on the input (admitted packets with candidates):
flow key, ``packet_no``, ``ts``, ``ts_us``, ``frame_length``,
``payload_length``, ``tcp_flags``, ``has_tcp``, ``has_udp``, ``cand_app``,
``cand_sni``, ``cand_route``,
``cand_blk``, ``cand_reason``, ``ip_hit``, ``port_hit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.names import has_flag
from netsift.operators.rules import const_reason
from netsift.session import scratch_path
from netsift.schema import ACK, FIN, FLOW_KEY, RST, SYN

INIT_APP, INIT_SNI = "Unknown", ""


class _Scan:
    """Running aggregates over each flow in packet order.

    Plain mode: window functions over one spec (flow, ordered by packet_no).
    Chunked mode (``chunk_size``): rows are partitioned by (flow, chunk of
    packet numbers) so a hot flow spreads over many tasks; each running value
    is computed inside the chunk, the chunk totals are combined into an
    exclusive prefix per flow (one small row per chunk), and the prefix is
    joined back and combined with the in-chunk value. Every operator used
    here is associative (sum, max, last non-null, previous row), so the
    result is exact.
    """

    def __init__(self, key: list[str], chunk_size: int | None, order: tuple[str, ...] = ("packet_no",)):
        self.key, self.chunk, self.order = key, chunk_size, order
        part = key + (["_chunk"] if chunk_size else [])
        self.w = Window.partitionBy(*part).orderBy(*order)
        self.run = self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = self.w.rowsBetween(Window.unboundedPreceding, -1)

    def prepare(self, df: DataFrame) -> DataFrame:
        if self.chunk:
            return df.withColumn("_chunk", F.floor(F.col("packet_no") / self.chunk))
        return df

    def _local(self, op: str, e: Column) -> Column:
        if op == "sum":
            return F.sum(e).over(self.run)
        if op == "max":
            return F.max(e).over(self.run)
        if op == "last":
            return F.last(e, ignorenulls=True).over(self.run)
        if op == "last_before":
            return F.last(e, ignorenulls=True).over(self.before)
        if op == "lag":
            return F.lag(e, 1).over(self.w)
        if op == "lead":
            return F.lead(e, 1).over(self.w)
        if op == "is_last":
            return F.lead(F.col("packet_no"), 1).over(self.w).isNull()
        raise ValueError(op)

    def apply(self, df: DataFrame, specs: dict) -> DataFrame:
        """Add one column per ``name: (op, expr)``, the running value over the flow."""
        if not self.chunk:
            return df.select("*", *[self._local(op, e).alias(n) for n, (op, e) in specs.items()])
        key, ck = self.key, self.key + ["_chunk"]
        df = df.select("*", *[e.alias(f"_e_{n}") for n, (op, e) in specs.items() if op != "is_last"])
        df = df.select("*", *[self._local(op, F.col(f"_e_{n}") if op != "is_last" else None).alias(f"_l_{n}")
                              for n, (op, e) in specs.items()])
        # The rows feed both the chunk totals and the join back: a stored table,
        # so that no layer evaluates (or plans) the ones below it again.
        path = scratch_path(df.sparkSession, "flow-layer")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        totals, place = [], F.struct(*self.order)
        for n, (op, _) in specs.items():
            v = F.col(f"_e_{n}")
            if op == "sum":
                totals.append(F.sum(v).alias(f"_t_{n}"))
            elif op == "max":
                totals.append(F.max(v).alias(f"_t_{n}"))
            elif op in ("last", "last_before"):
                totals.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t_{n}"))
            elif op in ("lag", "lead"):
                totals.append((F.max_by if op == "lag" else F.min_by)(v, place).alias(f"_t_{n}"))
        chunks = df.groupBy(*ck).agg(F.count(F.lit(1)).alias("_rows"), *totals)
        wc = Window.partitionBy(*key).orderBy("_chunk")
        prior = wc.rowsBetween(Window.unboundedPreceding, -1)
        prefix = []
        for n, (op, _) in specs.items():
            t = F.col(f"_t_{n}") if op != "is_last" else None
            if op == "sum":
                prefix.append(F.sum(t).over(prior).alias(f"_p_{n}"))
            elif op == "max":
                prefix.append(F.max(t).over(prior).alias(f"_p_{n}"))
            elif op in ("last", "last_before"):
                prefix.append(F.last(t, ignorenulls=True).over(prior).alias(f"_p_{n}"))
            elif op == "lag":
                prefix.append(F.lag(t, 1).over(wc).alias(f"_p_{n}"))
            elif op == "lead":
                prefix.append(F.lead(t, 1).over(wc).alias(f"_p_{n}"))
            elif op == "is_last":
                prefix.append(F.lead(F.col("_chunk"), 1).over(wc).isNull().alias(f"_p_{n}"))
        joined = df.join(chunks.select(*ck, *prefix), ck, "left")
        out = []
        for n, (op, _) in specs.items():
            lv, pv = F.col(f"_l_{n}"), F.col(f"_p_{n}")
            if op == "sum":
                out.append((F.coalesce(pv, F.lit(0)) + lv).alias(n))
            elif op == "max":
                out.append(F.greatest(pv, lv).alias(n))
            elif op in ("last", "last_before", "lag", "lead"):
                out.append(F.coalesce(lv, pv).alias(n))
            elif op == "is_last":
                out.append((lv & pv).alias(n))
        drop = [c for n in specs for c in (f"_e_{n}", f"_l_{n}", f"_p_{n}")]
        return joined.select("*", *out).drop(*[c for c in drop if c in joined.columns])


def _label(app: Column, sni: Column, route: Column, blk: Column, reason: Column) -> Column:
    return F.struct(app.alias("app"), sni.alias("sni"), route.alias("route"),
                    blk.alias("blk"), reason.alias("reason"))


def with_closes(rows: DataFrame, closes: DataFrame, key: list[str] | None = None, chunk_size: int | None = None) -> DataFrame:
    """Closes by key, each at its place among the packets (G8). ``closes`` has the flow
    key and ``packet_no``: the call is made before the packet of that number (which need
    not be one of the flow's). Adds ``close_before`` (calls lie between the flow's packet
    before this row and this one; before its first packet a flow isn't there to be closed)
    and ``close_after`` (calls lie between this row and the flow's next packet, or its end).

    Calls without a number, or for flows that don't occur, change nothing; repeated ones
    count once. The calls go through the exchange and the sort that the state machine
    needs anyway, as rows between the packets, and are dropped there."""
    key = list(key or FLOW_KEY)
    sc = _Scan(key, chunk_size, ("packet_no", "_is_packet"))
    calls = closes.where(F.col("packet_no").isNotNull()).select(
        *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in (*key, "packet_no")], F.lit(0).alias("_is_packet"))
    both = sc.prepare(rows.withColumn("_is_packet", F.lit(1)).unionByName(calls, allowMissingColumns=True))
    is_call = F.col("_is_packet") == 0
    both = sc.apply(both, {"_call_before": ("lag", is_call), "_call_after": ("lead", is_call), "_prior": ("sum", F.col("_is_packet").cast("bigint"))})
    no = F.lit(False)
    return both.where(~is_call).select(
        *rows.columns, (F.coalesce("_call_before", no) & (F.col("_prior") > 1)).alias("close_before"),
        F.coalesce("_call_after", no).alias("close_after"))


def packet_verdicts(pk: DataFrame, unknown_blocked: bool, key: list[str] | None = None,
                    chunk_size: int | None = None) -> DataFrame:
    """Verdict of every packet (G1-G6, G9): state, action, label, reason.

    Output columns: flow key, ``packet_no``, ``ts``, ``ts_us``,
    ``frame_length``, ``payload_length``, ``tcp_flags``, ``has_tcp``, ``has_udp``,
    ``state``, ``action``, ``app_type``, ``sni``, ``block_reason``,
    ``drop_cause`` ('RULE' = this packet blocked the flow, 'STATE' = already
    blocked), ``assigned`` (label assigned here), ``rule_block``,
    ``inspected``, ``sni_extraction``, ``classification_hit``,
    ``flow_packets``/``flow_bytes`` (running counters), ``syn_seen``,
    ``syn_ack_seen``, ``fin_seen``, ``last_in_flow``; ``close_after`` where ``pk``
    has been through ``with_closes``. A flow that was closed is CLOSED when its next
    packet comes, also if it was blocked: that packet is inspected and checked anew.

    Default plan: one exchange on the flow key, one sort, stacked windows.
    With ``chunk_size`` a flow is split into chunks of that many packet
    numbers (see :class:`_Scan`): use it when single flows may hold a large
    share of all packets; it costs a small exchange and a join per layer.
    """
    key = list(key or FLOW_KEY)
    sc = _Scan(key, chunk_size)
    df = epochs(pk, sc)
    df = sc.apply(df, {"_chain": ("sum", (F.col("_eff") & F.col("_start")).cast("bigint"))})
    # Layer 4: label in force. Within a chain (segment opened by a candidate on
    # a start packet) the first blocked effective candidate sticks, else the
    # latest effective candidate; before any, the initial label. "Blocked"
    # includes the flow-constant rules (source address, destination port):
    # such a flow is blocked under any label, so its first label sticks.
    cand_label = _label(F.col("cand_app"), F.col("cand_sni"), F.col("cand_route"),
                        F.col("cand_blk"), F.col("cand_reason"))
    init_reason = F.when(F.lit(unknown_blocked), F.struct(F.lit("APP").alias("type"), F.lit(INIT_APP).alias("detail")))
    init_label = _label(F.lit(INIT_APP), F.lit(INIT_SNI), F.lit(None).cast("string"),
                        F.lit(unknown_blocked), init_reason)
    df = sc.apply(df, {
        "_fb": ("max", F.when(F.col("_eff") & (F.col("cand_blk") | F.col("_const")),
                              F.struct(F.col("_chain").alias("chain"), (-F.col("packet_no")).alias("neg_no"),
                                       cand_label.alias("label")))),
        "_le": ("last", F.when(F.col("_eff"), cand_label)),
    })
    carry = F.coalesce(
        F.when((F.col("_chain") == 0) & (F.lit(unknown_blocked) | F.col("_const")), init_label),
        F.when(F.col("_fb.chain") == F.col("_chain"), F.col("_fb.label")),
        F.col("_le"),
        init_label,
    )
    df = df.withColumn("_carry", carry)
    creason = const_reason(F.col("ip_hit"), F.col("port_hit"), F.col("src_ip"), F.col("dest_port"))
    df = df.withColumn("_drop", creason.isNotNull() | F.col("_carry.blk"))
    return verdict_rows(df, sc, F.coalesce(creason, F.col("_carry.reason")))


def epochs(pk: DataFrame, sc: _Scan) -> DataFrame:
    """Packets with their flow's running values and the epoch they are in: a flow's
    closing packets, and the first ones after closes by key, open epochs, and the first candidate of an epoch (``_eff``) is the
    only one of it that can label the flow."""
    tcp = F.col("protocol") == 6
    flags = F.col("tcp_flags")
    s_, a_, f_, r_ = (tcp & has_flag(flags, b) for b in (SYN, ACK, FIN, RST))
    hc = F.col("cand_route").isNotNull()
    no = F.lit(False)

    # Layer 1: row values and flow-wide running values.
    df = sc.prepare(pk).select(
        "*",
        F.coalesce(a_, no).alias("_A"), F.coalesce(r_, no).alias("_R"), hc.alias("_hc"),
        (F.col("ip_hit") | F.col("port_hit")).alias("_const"),
    )
    df = sc.apply(df, {
        "_rn": ("sum", F.lit(1).cast("bigint")),
        "syn_seen": ("max", F.coalesce(s_ & ~a_, no)),
        "syn_ack_seen": ("max", F.coalesce(s_ & a_, no)),
        "fin_seen": ("max", F.coalesce(f_, no)),
        "_ccount": ("sum", hc.cast("bigint")),
        "flow_bytes": ("sum", F.col("frame_length").cast("bigint")),
    })
    df = df.withColumn("flow_packets", F.col("_rn"))
    # Layer 2: closes open epochs; candidates counted from the epoch start.
    close = F.col("_R") | (F.col("fin_seen") & F.col("_A"))
    if "close_before" in df.columns:
        close = close | (F.col("close_before") & (F.col("_rn") > 1))
    df = df.withColumn("_close", close).withColumn("_start", close | (F.col("_rn") == 1))
    est_flag = F.col("syn_seen") & F.col("syn_ack_seen") & F.col("_A")
    cands_before = F.col("_ccount") - F.col("_hc").cast("bigint")
    df = sc.apply(df, {
        "_epoch": ("sum", F.col("_close").cast("bigint")),
        "_est": ("max", est_flag),
        "_epoch_base": ("last", F.when(F.col("_start"), cands_before)),
        "_first_ts_us": ("last", F.when(F.col("_rn") == 1, F.col("ts_us"))),
    })
    # Layer 3: the first candidate of each epoch is the only one that can label.
    eff = F.col("_hc") & ((F.col("_ccount") - F.col("_epoch_base")) == 1)
    return df.withColumn("_eff", eff)


def verdict_rows(df: DataFrame, sc: _Scan, reason: Column) -> DataFrame:
    """The rows of ``packet_verdicts`` from the label in force (``_carry``) and whether
    the flow is blocked (``_drop``) at each packet; ``reason`` counts where it is."""
    key, no = sc.key, F.lit(False)
    # Layer 5: the transitions that drop decisions imply.
    df = sc.apply(df, {"_prev0": ("lag", F.col("_drop"))})
    df = df.withColumn("_prev", F.coalesce(F.col("_prev0"), no))
    fresh = F.col("_start") | ~F.col("_prev")
    df = df.withColumn("rule_block", F.col("_drop") & fresh).withColumn("assigned", F.col("_eff") & fresh)
    # Layer 6: classification within the current epoch, inspection, flow end.
    assigned_epoch = F.when(F.col("assigned"), F.col("_epoch"))
    df = sc.apply(df, {
        "_cls_epoch": ("last", assigned_epoch),
        "_cls_before": ("last_before", assigned_epoch),
        "last_in_flow": ("is_last", None),
    })
    classified = F.coalesce(F.col("_cls_epoch") == F.col("_epoch"), no)
    assigned_before = F.coalesce(F.col("_cls_before") == F.col("_epoch"), no)
    state = (F.when(F.col("_drop"), "BLOCKED").when(classified, "CLASSIFIED")
             .when(F.col("_epoch") > 0, "CLOSED").when(F.col("_est"), "ESTABLISHED").otherwise("NEW"))
    inspected = (F.col("payload_length") > 0) & (F.col("_start") | (~F.col("_prev") & ~assigned_before))
    route, app = F.col("cand_route"), F.col("cand_app")
    hit = F.col("assigned") & (((route == "TLS") & ~app.isin("Unknown", "HTTPS"))
                               | ((route == "HTTP") & ~app.isin("Unknown", "HTTP")))
    return df.select(
        *key, *[c for c in ("packet_no", "ts", "ts_us", "frame_length", "payload_length", "tcp_flags",
                            "has_tcp", "has_udp") if c not in key],
        state.alias("state"),
        F.when(F.col("_drop"), "DROP").otherwise("FORWARD").alias("action"),
        F.col("_carry.app").alias("app_type"),
        F.col("_carry.sni").alias("sni"),
        F.when(F.col("_drop"), reason).alias("block_reason"),
        F.when(F.col("rule_block"), "RULE").when(F.col("_drop"), "STATE").alias("drop_cause"),
        "assigned", "rule_block",
        inspected.alias("inspected"),
        (F.col("assigned") & (route == "TLS")).alias("sni_extraction"),
        F.coalesce(hit, no).alias("classification_hit"),
        F.col("_hc").alias("has_candidate"),
        "flow_packets", "flow_bytes", "syn_seen", "syn_ack_seen", "fin_seen", "last_in_flow",
        F.col("_first_ts_us").alias("first_ts_us"), *[c for c in ("close_after",) if c in df.columns],
    )


def state_left(verdicts: DataFrame) -> Column:
    """The state in which a packet leaves its flow until the next one comes."""
    if "close_after" in verdicts.columns:
        return F.when(F.col("close_after"), "CLOSED").otherwise(F.col("state"))
    return F.col("state")


def final_flows(verdicts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Flow table (T6): counters (F4) and the state after the last packet.

    The last verdict row of each flow already holds the running totals and
    the final state, so this is a filter on ``last_in_flow`` (no aggregation,
    no exchange). ``first_seen``/``last_seen`` are the times of the flow's
    first and last packet in capture order.
    """
    key = list(key or FLOW_KEY)
    last = verdicts.withColumn("state", state_left(verdicts)).where(F.col("last_in_flow"))
    return last.select(
        *key, F.col("flow_packets").alias("packets_out"), F.col("flow_bytes").cast("bigint").alias("bytes_out"),
        F.lit(0).cast("bigint").alias("packets_in"), F.lit(0).cast("bigint").alias("bytes_in"),
        F.timestamp_micros(F.col("first_ts_us")).alias("first_seen"), F.col("ts").alias("last_seen"),
        F.col("first_ts_us").alias("first_seen_us"), F.col("ts_us").alias("last_seen_us"),
        "state", "app_type", "sni", "action", "syn_seen", "syn_ack_seen", "fin_seen")


def flow_counters(packets: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Per-flow packets, bytes, first/last seen over admitted packets."""
    key = list(key or FLOW_KEY)
    return (packets.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("bigint").alias("bytes"),
                 F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")))


def close_flows(flows: DataFrame, closes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Explicit close by key at the end of a run (G8): listed flows get state CLOSED.
    ``with_closes`` is for closes in the course of it."""
    key = list(key or FLOW_KEY)
    marked = closes.select(*key).distinct().withColumn("_closed", F.lit(True))
    joined = flows.join(marked, key, "left")
    return joined.withColumn("state", F.when(F.col("_closed"), "CLOSED").otherwise(F.col("state"))).drop("_closed")


def with_idle_instances(pk: DataFrame, idle_timeout_s: int, key: list[str] | None = None) -> DataFrame:
    """Split a key into flow instances at gaps over ``idle_timeout_s`` (J2, batch form).

    Adds ``flow_instance``: the number of idle gaps before the packet in file order.
    """
    key = list(key or FLOW_KEY)
    w = Window.partitionBy(*key).orderBy("packet_no")
    gap = (F.col("ts_us") - F.lag("ts_us", 1).over(w)) > idle_timeout_s * 1_000_000
    marked = pk.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    return marked.withColumn("flow_instance", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .drop("_gap")


def retain_recent_flows(flows: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
    """The ``n`` most recently seen flows (H4), ties by key: a distributed top-k."""
    key = list(key or FLOW_KEY)
    return flows.orderBy(F.desc("last_seen_us"), *key).limit(n)


def reverse_key(df: DataFrame) -> DataFrame:
    """Swap source and destination address and port."""
    return df.select(
        *[c for c in df.columns if c not in ("src_ip", "dest_ip", "src_port", "dest_port")],
        F.col("dest_ip").alias("src_ip"), F.col("src_ip").alias("dest_ip"),
        F.col("dest_port").alias("src_port"), F.col("src_port").alias("dest_port"))


def lookup_flows(keys: DataFrame, flows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Forward-or-reverse lookup (E6): the flow stored under the key, else under its reverse.

    Both joins are equi-joins on the full key; the planner shuffles or
    broadcasts by size. ``match`` tells which direction hit.
    """
    key = list(key or FLOW_KEY)
    payload = [c for c in flows.columns if c not in key]
    fwd = flows.select(*key, *[F.col(c).alias(f"f_{c}") for c in payload])
    rev = reverse_key(flows).select(*key, *[F.col(c).alias(f"r_{c}") for c in payload])
    joined = keys.join(fwd, key, "left").join(rev, key, "left")
    found_f = F.col(f"f_{payload[0]}").isNotNull()
    found_r = F.col(f"r_{payload[0]}").isNotNull()
    return joined.select(
        *keys.columns,
        F.when(found_f, "forward").when(found_r, "reverse").alias("match"),
        *[F.when(found_f, F.col(f"f_{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in payload])


def bidirectional_flows(packets: DataFrame) -> DataFrame:
    """Flows keyed by the unordered endpoint pair.

    The initiator is the source of the pair's first packet; ``*_out`` counts
    packets from the initiator, ``*_in`` the replies. One aggregation, one
    shuffle on the canonical key.
    """
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dest_ip").alias("ip"), F.col("dest_port").alias("port"))
    lo, hi = F.least(src, dst), F.greatest(src, dst)
    df = packets.select("capture_id", "protocol", lo.alias("a"), hi.alias("b"), src.alias("s"),
                        "packet_no", "frame_length", "ts_us")
    agg = (df.groupBy("capture_id", "a", "b", "protocol")
           .agg(F.min_by("s", "packet_no").alias("init"),
                F.count_if(F.col("s") == F.col("a")).alias("pa"),
                F.sum(F.when(F.col("s") == F.col("a"), F.col("frame_length")).otherwise(0)).alias("ba"),
                F.count_if(F.col("s") != F.col("a")).alias("pb"),
                F.sum(F.when(F.col("s") != F.col("a"), F.col("frame_length")).otherwise(0)).alias("bb"),
                F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")))
    a_init = F.col("init") == F.col("a")
    resp = F.when(a_init, F.col("b")).otherwise(F.col("a"))
    return agg.select(
        "capture_id",
        F.col("init.ip").alias("src_ip"), resp["ip"].alias("dest_ip"),
        F.col("init.port").alias("src_port"), resp["port"].alias("dest_port"), "protocol",
        F.when(a_init, F.col("pa")).otherwise(F.col("pb")).cast("bigint").alias("packets_out"),
        F.when(a_init, F.col("ba")).otherwise(F.col("bb")).cast("bigint").alias("bytes_out"),
        F.when(a_init, F.col("pb")).otherwise(F.col("pa")).cast("bigint").alias("packets_in"),
        F.when(a_init, F.col("bb")).otherwise(F.col("ba")).cast("bigint").alias("bytes_in"),
        "first_seen_us", "last_seen_us")


def flow_sessions(packets: DataFrame, gap_seconds: int, key: list[str] | None = None) -> DataFrame:
    """Per-flow sessions separated by silences of ``gap_seconds`` or more."""
    key = list(key or FLOW_KEY)
    win = F.session_window("ts", f"{gap_seconds} seconds")
    agg = (packets.groupBy(win.alias("session"), *key)
           .agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("bigint").alias("bytes"),
                F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")))
    return agg.select(*key, "first_seen_us", "last_seen_us",
                      (F.col("last_seen_us") + gap_seconds * 1_000_000).alias("session_end_us"),
                      "packets", "bytes")


def visit_flows(flows: DataFrame, visitor) -> int:
    """Call ``visitor(partition, batches)`` once for each partition of the flow table,
    on the executor that holds it (K2); returns the number of flows visited.

    ``batches`` are Arrow batches of the partition's flows. A lost or repeated task
    calls the visitor again with the same partition number: what it does should be
    keyed by that number, so that the later call replaces the earlier one. No flow
    comes to the driver, only a count for each partition."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        seen = [0]

        def counted():
            for batch in batches:
                seen[0] += batch.num_rows
                yield batch
        rest = counted()
        visitor(TaskContext.get().partitionId(), rest)
        for _ in rest:  # what the visitor left
            pass
        yield pa.RecordBatch.from_pydict({"flows": pa.array(seen, pa.int64())})
    return flows.mapInArrow(run, "flows bigint").agg(F.sum("flows")).first()[0] or 0


def heavy_flows(packets: DataFrame, min_packets: int, key: list[str] | None = None) -> DataFrame:
    """Flows with more than ``min_packets`` packets.

    Reads only the key columns of the packets (the decode is pruned to them)
    and aggregates partially before its shuffle, so the exchange carries one
    row per flow and task.
    """
    key = list(key or FLOW_KEY)
    counts = packets.groupBy(*key).agg(F.count(F.lit(1)).alias("packets"))
    return counts.where(F.col("packets") > min_packets)
