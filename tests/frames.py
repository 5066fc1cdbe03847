"""Hand-built frames for byte-level tests."""

import struct


def eth(payload: bytes, ether_type: int = 0x0800) -> bytes:
    return bytes.fromhex("0a1b2c3d4e5f") + bytes.fromhex("020000000001") + struct.pack(">H", ether_type) + payload


def ipv4(l4: bytes, proto: int = 6, src=(10, 0, 0, 1), dst=(93, 184, 0, 1), ihl: int = 5, version: int = 4,
         options: bytes = b"") -> bytes:
    head = struct.pack(">BBHHHBBH4B4B", (version << 4) | ihl, 0, 20 + len(options) + len(l4), 0, 0x4000, 64, proto, 0,
                       *src, *dst)
    return head + options + l4


def tcp(payload: bytes = b"", sport=40000, dport=443, flags=0x18, offset_words=5, options: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, offset_words << 4, flags, 0xFFFF, 0, 0) + options + payload


def udp(payload: bytes = b"", sport=40003, dport=53) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def tls_hello(host: bytes, version=0x0301, hs_type=1, extra_ext: bytes = b"", name_type=0,
              list_len=None, ext_len=None, name_len=None, record_len=None) -> bytes:
    n = len(host)
    name_len = n if name_len is None else name_len
    list_len = n + 3 if list_len is None else list_len
    ext_len = n + 5 if ext_len is None else ext_len
    sni = struct.pack(">HHHBH", 0, ext_len, list_len, name_type, name_len) + host
    exts = extra_ext + sni
    body = b"\x03\x03" + b"\x00" * 32 + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">H", len(exts)) + exts
    hs = bytes([hs_type]) + struct.pack(">I", len(body))[1:] + body
    rl = len(hs) if record_len is None else record_len
    return b"\x16" + struct.pack(">HH", version, rl) + hs


def dns_query(labels, flags=0x0100, qdcount=1, tail=b"\x00\x00\x01\x00\x01") -> bytes:
    q = b"".join(bytes([len(x)]) + x for x in labels)
    return struct.pack(">HHHHHH", 1, flags, qdcount, 0, 0, 0) + q + tail


def pcap_file(records, little=True, magic=0xA1B2C3D4, snaplen=65535) -> bytes:
    o = "<" if little else ">"
    out = struct.pack(o + "IHHiIII", magic, 2, 4, 0, 0, snaplen, 1)
    for ts, data in records:
        out += struct.pack(o + "IIII", ts, 7, len(data), len(data)) + data
    return out
