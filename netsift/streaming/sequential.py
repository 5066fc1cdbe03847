"""The per-flow state machine, one packet at a time.

This is the incremental form of the verdict: it keeps the state of one flow
and advances it by one packet. It is the body of the streaming operator
(keyed state in ``applyInPandasWithState``), and tests use it as the
independent check of the batch window form.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle

from netsift.schema import ACK, FIN, RST, SYN

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class FlowState:
    state: str = "NEW"
    app: str = "Unknown"
    sni: str = ""
    label_blk: bool = False          # does the label hit an APP / DOMAIN rule?
    label_reason: tuple | None = None
    syn: bool = False
    syn_ack: bool = False
    fin: bool = False
    packets: int = 0
    bytes: int = 0
    first_ts: int | None = None
    last_ts: int | None = None
    spans: str | None = None            # under changing rules: when the label is blocked,
    block_reason: tuple | None = None   # and what the flow was blocked for


@dataclass
class Rules:
    """Plain rule sets for the sequential form (small by nature)."""

    ips: frozenset = frozenset()
    ports: frozenset = frozenset()
    apps: frozenset = frozenset()
    domains: frozenset = frozenset()
    pattern_rests: tuple = ()

    def domain_blocked(self, d: str) -> bool:
        if d in self.domains:
            return True
        low = d.lower()
        return any(low == r or low.endswith("." + r) for r in self.pattern_rests)

    def reason(self, src_ip: str, dest_port: int, app: str, sni: str):
        if src_ip in self.ips:
            return "IP", src_ip
        if dest_port in self.ports:
            return "PORT", str(dest_port)
        if app in self.apps:
            return "APP", app
        if sni and self.domain_blocked(sni):
            return "DOMAIN", sni
        return None


def rules_from_rows(rows) -> Rules:
    """Rules from ``(rule_type, value, is_pattern)`` rows."""
    ips, ports, apps, domains, rests = set(), set(), set(), set(), []
    for t, v, pat in rows:
        if t == "IP":
            ips.add(v)
        elif t == "PORT":
            ports.add(int(v))
        elif t == "APP":
            apps.add(v)
        elif t == "DOMAIN" and not pat:
            domains.add(v)
        elif t == "DOMAIN" and v.startswith("*."):
            rests.append(v[2:].lower())
    return Rules(frozenset(ips), frozenset(ports), frozenset(apps), frozenset(domains), tuple(rests))


def step(st: FlowState, pkt: dict, rules: Rules) -> dict:
    """Advance ``st`` by one packet using rule sets; return the packet's verdict.

    ``pkt`` holds src_ip, dest_port, protocol, tcp_flags, payload_length,
    frame_length, ts_us, and the candidate (cand_app, cand_sni, cand_route;
    cand_route None when the packet yields no label).
    """
    flags = dict(pkt)
    ip_or_port = rules.reason(pkt["src_ip"], pkt["dest_port"], "\0", "")
    flags["const_reason"] = ip_or_port
    if pkt.get("cand_route") is not None:
        r = rules.reason("\0", -1, pkt["cand_app"], pkt["cand_sni"])
        flags["cand_reason"] = r
    if st.packets == 0:
        init = rules.reason("\0", -1, st.app, st.sni)
        st.label_blk, st.label_reason = init is not None, init
    return step_flags(st, flags)


def step_flags(st: FlowState, pkt: dict) -> dict:
    """Advance ``st`` by one packet whose rule hits are given as flags.

    ``const_reason`` is the (type, detail) of a source-address or destination
    port rule hit, or None; ``cand_reason`` the APP / DOMAIN hit of the
    packet's candidate label, or None. The label in force keeps its own
    reason, so every packet is checked against its flow's current label.
    """
    st.packets += 1
    st.bytes += pkt["frame_length"]
    ts = pkt.get("ts_us")
    st.first_ts = ts if st.first_ts is None else st.first_ts
    st.last_ts = ts
    if pkt["protocol"] == 6:
        f = pkt["tcp_flags"] or 0
        if f & SYN:
            if f & ACK:
                st.syn_ack = True
            else:
                st.syn = True
        if st.syn and st.syn_ack and f & ACK and st.state == "NEW":
            st.state = "ESTABLISHED"
        if f & FIN:
            st.fin = True
        if f & RST:
            st.state = "CLOSED"
        if st.fin and f & ACK:
            st.state = "CLOSED"
    out = {"assigned": False, "rule_block": False, "inspected": False, "route": None}
    const = pkt.get("const_reason")
    if st.state == "BLOCKED":
        out.update(state="BLOCKED", action="DROP", drop_cause="STATE", reason=const or st.label_reason)
    else:
        if st.state != "CLASSIFIED" and pkt["payload_length"] > 0:
            out["inspected"] = True
            if pkt.get("cand_route") is not None:
                st.app, st.sni, st.state = pkt["cand_app"], pkt["cand_sni"], "CLASSIFIED"
                st.label_reason = pkt.get("cand_reason")
                st.label_blk = st.label_reason is not None
                out["assigned"], out["route"] = True, pkt["cand_route"]
        reason = const or (st.label_reason if st.label_blk else None)
        if reason is not None:
            st.state = "BLOCKED"
            out.update(state="BLOCKED", action="DROP", drop_cause="RULE", reason=reason, rule_block=True)
        else:
            out.update(state=st.state, action="FORWARD", drop_cause=None, reason=None)
    out.update(app_type=st.app, sni=st.sni, flow_packets=st.packets, flow_bytes=st.bytes)
    return out
