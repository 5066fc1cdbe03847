"""Table schemas, enumerations and fixed value lists shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the inspected engine's for identical results.
# ---------------------------------------------------------------------------

# Application display names, in enumeration order.
APP_NAMES = (
    "Unknown", "HTTP", "HTTPS", "DNS", "TLS", "QUIC", "Google", "Facebook",
    "YouTube", "Twitter/X", "Instagram", "Netflix", "Amazon", "Microsoft",
    "Apple", "WhatsApp", "Telegram", "TikTok", "Spotify", "Zoom", "Discord",
    "GitHub", "Cloudflare",
)

# Host keyword -> application, tested on the lower-cased host in this order;
# the first keyword contained in the host wins.
HOST_KEYWORDS = (
    ("youtube", "YouTube"),
    ("facebook", "Facebook"),
    ("google", "Google"),
    ("tiktok", "TikTok"),
    ("github", "GitHub"),
    ("discord", "Discord"),
    ("twitter", "Twitter/X"),
    ("twimg", "Twitter/X"),
    ("spotify", "Spotify"),
    ("amazon", "Amazon"),
    ("zoom", "Zoom"),
    ("apple", "Apple"),
    ("microsoft", "Microsoft"),
    ("whatsapp", "WhatsApp"),
    ("telegram", "Telegram"),
    ("instagram", "Instagram"),
    ("netflix", "Netflix"),
    ("cloudflare", "Cloudflare"),
)

# HTTP request methods recognised by their first four bytes (case-sensitive).
HTTP_METHOD_PREFIXES = ("GET ", "POST", "PUT ", "HEAD", "DELE", "PATC", "OPTI")

# Rule file sections, in the order the rules sink writes them.
RULE_SECTIONS = (
    ("[BLOCKED_IPS]", "IP"),
    ("[BLOCKED_APPS]", "APP"),
    ("[BLOCKED_DOMAINS]", "DOMAIN"),
    ("[BLOCKED_PORTS]", "PORT"),
)

# Capture file format constants.
PCAP_MAGIC = 0xA1B2C3D4            # big-endian reading of the standard magic
PCAP_MAGIC_SWAPPED = 0xD4C3B2A1    # same magic written little-endian
PCAP_GLOBAL_HEADER_LEN = 24
PCAP_RECORD_HEADER_LEN = 16
PCAP_MAX_RECORD_LEN = 65535

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
# IP protocol numbers.
PROTO_ICMP, PROTO_TCP, PROTO_UDP = 1, 6, 17
# Ether types.
ETHERTYPE_IPV4, ETHERTYPE_IPV6, ETHERTYPE_ARP = 0x0800, 0x86DD, 0x0806

# Flow states and packet actions.
STATES = ("NEW", "ESTABLISHED", "CLASSIFIED", "BLOCKED", "CLOSED")
FORWARD, DROP = "FORWARD", "DROP"

# Default idle timeout of a flow, seconds.
IDLE_TIMEOUT_S = 300
# Domain label length above which reports truncate it, and the kept prefix.
DOMAIN_LABEL_MAX, DOMAIN_LABEL_KEEP = 35, 32
# Rows in the top-domain report.
TOP_DOMAINS_N = 20

# ---------------------------------------------------------------------------
# Column groups and schemas.
# ---------------------------------------------------------------------------

FLOW_KEY = ("capture_id", "src_ip", "dest_ip", "src_port", "dest_port", "protocol")

RAW_PACKETS = T.StructType([
    T.StructField("capture_id", T.StringType(), False),
    T.StructField("packet_no", T.LongType(), False),
    T.StructField("ts_sec", T.LongType(), False),
    T.StructField("ts_usec", T.LongType(), False),
    T.StructField("incl_len", T.LongType(), False),
    T.StructField("orig_len", T.LongType(), False),
    T.StructField("data", T.BinaryType(), False),
])

CAPTURES = T.StructType([
    T.StructField("capture_id", T.StringType(), False),
    T.StructField("magic", T.LongType(), True),
    T.StructField("version_major", T.IntegerType(), True),
    T.StructField("version_minor", T.IntegerType(), True),
    T.StructField("thiszone", T.IntegerType(), True),
    T.StructField("sigfigs", T.LongType(), True),
    T.StructField("snaplen", T.LongType(), True),
    T.StructField("link_type", T.LongType(), True),
    T.StructField("byte_order", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

RULES = T.StructType([
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("is_pattern", T.BooleanType(), False),
])

CANDIDATE = T.StructType([
    T.StructField("app", T.StringType(), True),
    T.StructField("sni", T.StringType(), True),
    T.StructField("route", T.StringType(), True),
])

BLOCK_REASON = T.StructType([
    T.StructField("type", T.StringType(), True),
    T.StructField("detail", T.StringType(), True),
])
