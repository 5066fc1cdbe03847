"""Frame decoding (B1-B7) and admission (C1) as one native projection.

``raw_packets`` (capture_id, packet_no, ts_sec, ts_usec, incl_len, orig_len,
data) becomes the ``packets`` table. Each layer is a CASE over byte reads, so
the whole decode is a single codegen'd Project; an absent layer is NULL. The
decode is stateless per frame (no field survives from an earlier frame).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.binary import ipv4_text, mac_text, u8, u16, u32
from netsift.functions.names import capture_ts
from netsift.schema import ETHERTYPE_IPV4, FLOW_KEY, PROTO_TCP, PROTO_UDP

ETH_LEN, IP_MIN, TCP_MIN, UDP_LEN = 14, 20, 20, 8


def decode(raw: DataFrame, keep_data: bool = True) -> DataFrame:
    """Decode Ethernet / IPv4 / TCP / UDP headers of every frame.

    Adds ``decode_ok`` (False = the frame is rejected, B6) and the T3 columns;
    ``payload`` is the slice after the last decoded header to the end of the
    captured frame, Ethernet padding included.
    """
    d, c = F.col("data"), F.col
    # Stage 1: fixed-offset reads. Stage 2: reads behind the IPv4 header.
    # Stage 3: validity flags, each a flat formula over those primitive
    # columns (never over other flags), so that pushing a filter through the
    # stages re-expands only two shallow levels.
    # Reads are unguarded: every use is behind an explicit length test.
    df = raw.withColumns({
        "frame_length": F.octet_length(d).cast("int"),
        "_et": u16(d, 12, checked=False),
        "_vihl": u8(d, ETH_LEN, checked=False),
        "_proto": u8(d, ETH_LEN + 9, checked=False),
    })
    df = df.withColumn("_l4", F.lit(ETH_LEN) + c("_vihl").bitwiseAND(15) * 4)
    df = df.withColumn("_doff", F.shiftright(u8(d, c("_l4") + 12, checked=False), 4) * 4)
    n, et, vihl, proto, l4, doff = (c(x) for x in ("frame_length", "_et", "_vihl", "_proto", "_l4", "_doff"))
    eth_ok = n >= ETH_LEN
    is_ipv4 = eth_ok & (et == ETHERTYPE_IPV4)
    ip_ok = (is_ipv4 & (n >= ETH_LEN + IP_MIN) & (F.shiftright(vihl, 4) == 4) & (l4 >= ETH_LEN + IP_MIN)
             & (n >= l4))
    is_tcp = ip_ok & (proto == PROTO_TCP)
    is_udp = ip_ok & (proto == PROTO_UDP)
    tcp_ok = is_tcp & (n >= l4 + TCP_MIN) & (doff >= TCP_MIN) & (n >= l4 + doff)
    udp_ok = is_udp & (n >= l4 + UDP_LEN)
    decode_ok = eth_ok & (~is_ipv4 | (ip_ok & (~is_tcp | tcp_ok) & (~is_udp | udp_ok)))
    # Admission (C1) written so each test appears once: it is what gets
    # pushed down to the scan, and its size is the size of the scan's code.
    admitted = ip_ok & (((proto == PROTO_TCP) & (n >= l4 + TCP_MIN) & (doff >= TCP_MIN) & (n >= l4 + doff))
                        | ((proto == PROTO_UDP) & (n >= l4 + UDP_LEN)))
    offset = (F.when(~is_ipv4, F.lit(ETH_LEN)).when(is_tcp, l4 + doff).when(is_udp, l4 + UDP_LEN).otherwise(l4))
    df = df.withColumns({
        "decode_ok": F.coalesce(decode_ok, F.lit(False)),
        "admitted": admitted,
        "_eth_ok": F.coalesce(eth_ok, F.lit(False)),
        "_ip_ok": F.coalesce(ip_ok, F.lit(False)),
        "_tcp_ok": F.coalesce(tcp_ok, F.lit(False)),
        "_udp_ok": F.coalesce(udp_ok, F.lit(False)),
        "_offset": offset,
    })
    # Stage 4: fields, each guarded by its layer's flag.
    ok, ip_ok, tcp_ok, udp_ok, off = c("decode_ok"), c("_ip_ok"), c("_tcp_ok"), c("_udp_ok"), c("_offset")
    has_payload = ok & (off < n)
    ports_ok = tcp_ok | udp_ok
    cols = [
        c("capture_id"), c("packet_no"), c("ts_sec"), c("ts_usec"),
        capture_ts(c("ts_sec"), c("ts_usec")).alias("ts"),
        (c("ts_sec") * 1_000_000 + c("ts_usec")).alias("ts_us"),
        c("incl_len"), c("orig_len"), n.alias("frame_length"),
        ok.alias("decode_ok"),
        F.coalesce(c("admitted"), F.lit(False)).alias("admitted"),
        F.when(c("_eth_ok"), mac_text(d, 6)).alias("src_mac"),
        F.when(c("_eth_ok"), mac_text(d, 0)).alias("dest_mac"),
        F.when(c("_eth_ok"), et).alias("ether_type"),
        (ok & ip_ok).alias("has_ip"),
        F.when(c("_eth_ok") & (et == ETHERTYPE_IPV4) & (n >= ETH_LEN + IP_MIN), F.shiftright(vihl, 4))
        .alias("ip_version"),
        F.when(ip_ok, ipv4_text(d, ETH_LEN + 12)).alias("src_ip"),
        F.when(ip_ok, ipv4_text(d, ETH_LEN + 16)).alias("dest_ip"),
        F.when(ip_ok, proto).alias("protocol"),
        F.when(ip_ok, u8(d, ETH_LEN + 8)).alias("ttl"),
        (ok & tcp_ok).alias("has_tcp"),
        (ok & udp_ok).alias("has_udp"),
        F.when(ports_ok, u16(d, l4)).alias("src_port"),
        F.when(ports_ok, u16(d, l4 + 2)).alias("dest_port"),
        F.when(tcp_ok, u8(d, l4 + 13)).alias("tcp_flags"),
        F.when(tcp_ok, u32(d, l4 + 4)).alias("seq_number"),
        F.when(tcp_ok, u32(d, l4 + 8)).alias("ack_number"),
        F.when(has_payload, off).otherwise(0).cast("int").alias("payload_offset"),
        F.when(has_payload, n - off).otherwise(0).cast("int").alias("payload_length"),
        F.when(has_payload, d.substr(off + 1, n - off)).alias("payload"),
    ]
    if keep_data:
        cols.append(d)
    return df.select(*cols)


def admit(packets: DataFrame) -> DataFrame:
    """Keep decoded frames carrying IPv4 and TCP or UDP."""
    return packets.where(F.col("admitted"))


def flow_keys(packets: DataFrame) -> DataFrame:
    """Flow-key projection of admitted packets."""
    return packets.select(*FLOW_KEY, "packet_no", "tcp_flags", "payload_offset", "payload_length",
                          "frame_length")
