"""Byte-level cases: frame decoding, host extraction, address forms."""

from pyspark.sql import functions as F

from frames import dns_query, eth, ipv4, tcp, tls_hello, udp
from netsift.functions import hosts, names
from netsift.operators.candidates import with_candidates
from netsift.operators.decode import decode


def _decode(spark, frames):
    rows = [("t", i, 0, 0, len(f), len(f), f) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, "
                                     "incl_len bigint, orig_len bigint, data binary")
    return {r["packet_no"]: r for r in decode(df).collect()}


def test_decode_cases(spark):
    frames = [
        b"\x00" * 13,                                               # 0 too short
        eth(b"\x00" * 28, 0x0806),                                  # 1 ARP
        eth(b"\x60" + b"\x00" * 39, 0x86DD),                        # 2 IPv6
        eth(ipv4(tcp(), version=6)),                                # 3 version nibble 6
        eth(ipv4(tcp(), ihl=4)),                                    # 4 IHL 4
        eth(ipv4(tcp(b"abc"), ihl=6, options=b"\x01\x01\x01\x01")),  # 5 IP options
        eth(ipv4(b"\x08\x00" + b"\x00" * 6, proto=1)),              # 6 ICMP
        eth(ipv4(tcp(offset_words=4))),                             # 7 TCP offset 4
        eth(ipv4(tcp(b"xy", offset_words=8, options=b"\x01" * 12))),  # 8 TCP options
        eth(ipv4(tcp(flags=0x10))) + b"\x00" * 6,                   # 9 padded bare ACK
        eth(ipv4(udp(b"q"), proto=17)),                             # 10 UDP
    ]
    d = _decode(spark, frames)
    assert not d[0]["decode_ok"]
    assert d[1]["decode_ok"] and not d[1]["has_ip"] and not d[1]["admitted"]
    assert d[2]["decode_ok"] and not d[2]["admitted"]
    assert not d[3]["decode_ok"] and not d[4]["decode_ok"]
    assert d[5]["admitted"] and d[5]["payload_offset"] == 14 + 24 + 20 and d[5]["payload_length"] == 3
    assert d[6]["decode_ok"] and d[6]["has_ip"] and not d[6]["admitted"] and d[6]["protocol"] == 1
    assert not d[7]["decode_ok"]
    assert d[8]["payload_offset"] == 14 + 20 + 32 and d[8]["payload_length"] == 2
    assert d[9]["payload_length"] == 6 and d[9]["tcp_flags"] == 0x10
    assert d[10]["has_udp"] and d[10]["dest_port"] == 53 and d[10]["payload_length"] == 1
    assert d[5]["src_ip"] == "10.0.0.1" and d[5]["dest_ip"] == "93.184.0.1" and d[5]["ttl"] == 64
    assert d[5]["src_mac"] == "02:00:00:00:00:01" and d[5]["dest_mac"] == "0a:1b:2c:3d:4e:5f"


def test_padded_ack_labels_https(spark):
    df = spark.createDataFrame([("t", 0, 0, 0, 60, 60, eth(ipv4(tcp(flags=0x10))) + b"\x00" * 6)],
                               "capture_id string, packet_no bigint, ts_sec bigint, ts_usec bigint, "
                               "incl_len bigint, orig_len bigint, data binary")
    r = with_candidates(decode(df)).collect()[0]
    assert (r["cand_app"], r["cand_sni"], r["cand_route"]) == ("HTTPS", "", "PORT")


def test_tls_cases():
    ok = tls_hello(b"a.co")
    assert hosts.tls_sni_of(ok) == "a.co"
    assert hosts.tls_sni_of(tls_hello(b"a.co", version=0x0305)) is None
    assert hosts.tls_sni_of(tls_hello(b"a.co", hs_type=2)) is None
    assert hosts.tls_sni_of(tls_hello(b"a.co", record_len=500)) is None
    assert hosts.tls_sni_of(tls_hello(b"b.org", extra_ext=b"\x00\x0b\x00\x02\x01\x00")) == "b.org"
    assert hosts.tls_sni_of(tls_hello(b"a.co", name_type=1)) is None
    assert hosts.tls_sni_of(tls_hello(b"a.co", list_len=2)) is None
    assert hosts.tls_sni_of(tls_hello(b"", ext_len=5, list_len=3, name_len=0)) == ""
    assert hosts.candidate_of(tls_hello(b"a.co"), 8080, 40000) == ("a.co", "TLS")   # 65 bytes >= 50


def test_http_cases(spark):
    cases = [b"GET / HTTP/1.1\r\nhOsT:   \r\nHost: a.b.com:80\r\n\r\n", b"GET /\r\nX-Host: q.com\r\nHost: r.com\r\n",
             b"GET Host:x", b"GET Host:xy", b"GET /\r\nHost: :80\r\n", b"GET /\r\nHost: \xffz.com\r\n",
             b"POST /\r\n\r\n", b"get /\r\nHost: a.com\r\n"]
    want = ["a.b.com", "q.com", None, "xy", "", "�z.com", None, None]
    assert [hosts.http_host_of(c) for c in cases] == want
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p binary")
    got = [r["h"] for r in df.select("i", hosts.http_host(F.col("p")).alias("h")).orderBy("i").collect()]
    assert got == want


def test_dns_cases():
    assert hosts.dns_name_of(dns_query([b"a", b"co"])) == "a.co"
    assert hosts.dns_name_of(dns_query([b"a", b"co"], flags=0x8180)) is None
    assert hosts.dns_name_of(dns_query([b"a", b"co"], qdcount=0)) is None
    assert hosts.dns_name_of(b"\x00" * 11) is None
    assert hosts.dns_name_of(dns_query([b"www", b"x"], tail=b"\xc0\x0c")) == "www.x"
    assert hosts.dns_name_of(dns_query([b"ab"], tail=b"\x09abc")) == "ab"


def test_quic_scan():
    payload = b"\xc0" + b"\x00" * 20 + tls_hello(b"q.example")
    assert hosts.quic_sni_of(payload) == "q.example"
    assert hosts.quic_sni_of(b"\x40" + payload[1:]) is None
    assert hosts.quic_sni_of(b"\xc0\x16\x03\x01\x00\x05\x01" + payload[7:]) == "q.example"   # a false start before it
    assert hosts.quic_sni_of(payload[:-9]) is None                                        # too little is left
    assert hosts.quic_sni_of(b"\xc0" + b"\x16\x03\x01\x00\x00\x01" * 10_000) is None


def test_cut_extensions():
    hello = tls_hello(b"a.co", extra_ext=b"\x00\x0b\x00\x02\x01\x00")
    assert hosts.tls_sni_of(hello) == "a.co"
    for cut in range(len(hello)):                     # the record's length no longer fits
        assert hosts.tls_sni_of(hello[:cut]) is None
    short = hello[:3] + b"\x00\x00" + hello[5:]       # a record that claims nothing: the payload's end counts
    assert [hosts.tls_sni_of(short[:len(short) - n]) for n in (0, 1)] == ["a.co", None]


def test_address_forms(spark):
    df = spark.createDataFrame([("192.168.1.2",), ("10.0.0.0/8",), ("1..2.3",)], "ip string")
    r = df.select(names.ip_to_long("ip").alias("v"), names.normalize_ip("ip").alias("n")).collect()
    assert r[0]["v"] == 33663168
    assert r[1]["n"] == "10.0.0.8"
    assert r[2]["n"] == "1.0.2.3"


def test_flag_and_protocol_names(spark):
    df = spark.createDataFrame([(0, 6), (18, 17), (63, 1), (4, 99)], "f int, p int")
    r = df.select(names.tcp_flag_names("f").alias("t"), names.protocol_name("p").alias("n")).collect()
    assert [x["t"] for x in r] == ["none", "SYN ACK", "SYN ACK FIN RST PSH URG", "RST"]
    assert [x["n"] for x in r] == ["TCP", "UDP", "ICMP", "Unknown(99)"]
