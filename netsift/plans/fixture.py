"""Packet traffic derived from the driver's ``events`` table.

The inspected engine ships no capture, so the test and bench captures are
derived from ``events`` with a fixed, portable mapping (one event = one packet)
and then encoded into real Ethernet frames with native expressions. Every
downstream job decodes those bytes; nothing reads the synthetic columns back.
The DuckDB oracle applies the same mapping in SQL (see ``FIXTURE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions.binary import hex_u8, hex_u16, hex_u24, hex_u32
from netsift.functions.names import ntz_micros
from netsift.session import cache_key, file_signature, materialized

CAPTURE_ID = "events"
QUIC_CAPTURE_ID = "events-quic"

# Portable SQL over ``events`` (runs unchanged in Spark and DuckDB).
FIXTURE_SQL = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type,
         event_id % 5 AS slot, CAST(round(value * 100) AS BIGINT) AS c
  FROM events)
SELECT event_id AS packet_no, ts,
  concat('10.', CAST(CAST(floor(user_id / 62500) AS BIGINT) % 250 AS STRING), '.', CAST(CAST(floor(user_id / 250) AS BIGINT) % 250 AS STRING), '.', CAST(user_id % 250 + 1 AS STRING)) AS src_ip,
  concat('93.184.', CAST(slot AS STRING), '.', CAST(user_id % 7 AS STRING)) AS dest_ip,
  CAST(40000 + slot AS INT) AS src_port,
  CAST(CASE WHEN slot IN (0, 1) THEN 443 WHEN slot = 2 THEN 80 WHEN slot = 3 THEN 53 ELSE 8080 END AS INT) AS dest_port,
  CAST(CASE WHEN slot = 3 THEN 17 ELSE 6 END AS INT) AS protocol,
  CAST(CASE WHEN slot = 3 THEN 0 WHEN c % 40 = 0 THEN 4 WHEN c % 40 = 1 THEN 17 WHEN c % 40 = 2 THEN 1
            WHEN c % 8 = 3 THEN 2 WHEN c % 8 = 4 THEN 18 WHEN c % 8 = 5 THEN 16 ELSE 24 END AS INT) AS tcp_flags,
  CASE WHEN event_type = 'error' THEN 'none' WHEN event_type = 'signup' THEN 'opaque'
       WHEN slot = 2 THEN 'http' WHEN slot = 3 THEN 'dns' ELSE 'tls' END AS payload_kind,
  CASE WHEN event_type IN ('error', 'signup') THEN NULL
       WHEN c % 10 = 0 THEN 'www.youtube.com' WHEN c % 10 = 1 THEN 'www.facebook.com' WHEN c % 10 = 2 THEN 'mail.google.com'
       WHEN c % 10 = 3 THEN 'pbs.twimg.com' WHEN c % 10 = 4 THEN 'pineapple.example.net' WHEN c % 10 = 5 THEN 'API.GitHub.com'
       WHEN c % 10 = 6 THEN 'cdn.ads.example.org' WHEN c % 10 = 7 THEN 'ads.example.org' WHEN c % 10 = 8 THEN 'badads.example.org'
       ELSE 'a-very-long-host-name-for-truncation.example.com' END AS host
FROM e
"""

# Rules the fixture is checked with (rules-file text).
FIXTURE_RULES_TEXT = """[BLOCKED_IPS]
10.0.0.5

[BLOCKED_APPS]
GitHub

[BLOCKED_DOMAINS]
www.youtube.com
www.facebook.com
*.ads.example.org

[BLOCKED_PORTS]
"""

# Fixed MAC addresses of the synthetic frames.
DEST_MAC_HEX = "0a1b2c3d4e5f"
SRC_MAC_HEX = "020000000001"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def synthetic_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column form of the fixture packets (FIXTURE_SQL over ``events``)."""
    view = f"netsift_events_{abs(hash(sf_dir))}"
    events(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(FIXTURE_SQL.replace("FROM events)", f"FROM {view})"))


def _ip_hex(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.concat(*[hex_u8(parts.getItem(i).cast("int")) for i in range(4)])


def _ascii_hex(s: Column) -> Column:
    return F.hex(F.encode(s, "UTF-8"))


def _payload_hex(kind: Column, host: Column) -> Column:
    n = F.octet_length(F.encode(host, "UTF-8"))
    name = _ascii_hex(host)
    tls = F.concat(
        F.lit("160301"), hex_u16(n + 56),          # record header
        F.lit("01"), hex_u24(n + 52),              # handshake header
        F.lit("0303"), F.lit("00" * 32),           # version, random
        F.lit("00"),                               # session id
        F.lit("00021301"),                         # cipher suites
        F.lit("0100"),                             # compression
        hex_u16(n + 9),                            # extensions length
        F.lit("0000"), hex_u16(n + 5),             # server_name extension
        hex_u16(n + 3), F.lit("00"), hex_u16(n), name,
    )
    http = F.concat(_ascii_hex(F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))))
    labels = F.transform(F.split(host, r"\."),
                         lambda lab: F.concat(hex_u8(F.octet_length(F.encode(lab, "UTF-8"))), _ascii_hex(lab)))
    dns = F.concat(F.lit("000101000001000000000000"), F.array_join(labels, ""), F.lit("00"), F.lit("00010001"))
    # An Initial with its ClientHello in the clear: long header, version 1, 8-byte connection id, no source id.
    quic = F.concat(F.lit("c30000000108"), F.substring(F.md5(name), 1, 16), F.lit("00" * 4), tls)
    return (F.when(kind == "tls", tls).when(kind == "quic", quic).when(kind == "http", http).when(kind == "dns", dns)
            .when(kind == "opaque", F.lit("00" * 8)).otherwise(F.lit("")))


def encode_frames(pk: DataFrame, capture_id: str = CAPTURE_ID) -> DataFrame:
    """Encode synthetic packet columns into ``raw_packets`` rows (real frame bytes)."""
    payload = _payload_hex(F.col("payload_kind"), F.col("host"))
    is_udp = F.col("protocol") == 17
    l4_len = F.when(is_udp, 8).otherwise(20)
    ip_total = F.lit(20) + l4_len + F.length(payload) / 2
    tcp = F.concat(hex_u16(F.col("src_port")), hex_u16(F.col("dest_port")),
                   hex_u32(F.col("packet_no") % 4294967296), F.lit("00000000"),
                   F.lit("50"), hex_u8(F.col("tcp_flags")), F.lit("ffff"), F.lit("0000"), F.lit("0000"))
    udp = F.concat(hex_u16(F.col("src_port")), hex_u16(F.col("dest_port")),
                   hex_u16((F.lit(8) + F.length(payload) / 2).cast("int")), F.lit("0000"))
    ipv4 = F.concat(F.lit("4500"), hex_u16(ip_total.cast("int")), F.lit("00004000"), F.lit("40"),
                    hex_u8(F.col("protocol")), F.lit("0000"), _ip_hex(F.col("src_ip")), _ip_hex(F.col("dest_ip")))
    frame = F.unhex(F.concat(F.lit(DEST_MAC_HEX), F.lit(SRC_MAC_HEX), F.lit("0800"), ipv4,
                             F.when(is_udp, udp).otherwise(tcp), payload))
    us = ntz_micros(F.col("ts"))
    return pk.select(
        F.lit(capture_id).alias("capture_id"),
        F.col("packet_no").cast("bigint").alias("packet_no"),
        F.floor(us / 1_000_000).cast("bigint").alias("ts_sec"),
        (us % 1_000_000).cast("bigint").alias("ts_usec"),
        F.octet_length(frame).cast("bigint").alias("incl_len"),
        F.octet_length(frame).cast("bigint").alias("orig_len"),
        frame.alias("data"),
    )


# Bump when the encoding changes, so stored captures are rebuilt.
ENCODER_VERSION = "3"


def fixture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_packets`` of the fixture capture, derived from ``events``.

    The encoded frames are stored once as a Parquet table in the shared folder
    (keyed by the events file and the encoder version) and read back, so the
    decode starts from a scan, exactly as it does on real captures.
    """
    events_path = f"{sf_dir}/events.parquet"
    key = cache_key(events_path, file_signature(spark, events_path), FIXTURE_SQL, ENCODER_VERSION)
    parts = max(spark.sparkContext.defaultParallelism, 1)

    def build() -> DataFrame:
        # A capture stored as ordered chunks: ranges of packet_no, one file each. Packets are dealt before they
        # are encoded: the sample for the ranges needs no frames, and all tasks encode, however few files hold the events.
        return encode_frames(synthetic_packets(spark, sf_dir).repartitionByRange(parts, "packet_no"))

    return materialized(spark, build, "fixture-frames", key)


def quic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture capture with each TLS ClientHello inside a QUIC Initial over
    UDP instead (stored like :func:`fixture_frames`); other packets are the same."""
    events_path = f"{sf_dir}/events.parquet"
    key = cache_key(events_path, file_signature(spark, events_path), FIXTURE_SQL, ENCODER_VERSION, "quic")
    parts = max(spark.sparkContext.defaultParallelism, 1)
    tls = F.col("payload_kind") == "tls"

    def build() -> DataFrame:
        pk = synthetic_packets(spark, sf_dir).withColumns({
            "protocol": F.when(tls, 17).otherwise(F.col("protocol")),
            "payload_kind": F.when(tls, "quic").otherwise(F.col("payload_kind"))})
        return encode_frames(pk.repartitionByRange(parts, "packet_no"), QUIC_CAPTURE_ID)

    return materialized(spark, build, "quic-frames", key)


# Host of a page URL, the same expression on both engines.
URL_HOST_RX = "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
PAGES_CAPTURE_ID = "pages"


def pages_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second capture, derived from ``pages``: one TLS ClientHello per page,
    naming the host of the page URL, one flow per page (stored like
    :func:`fixture_frames`)."""
    pages_path = f"{sf_dir}/pages.parquet"
    key = cache_key(pages_path, file_signature(spark, pages_path), URL_HOST_RX, ENCODER_VERSION)

    def build() -> DataFrame:
        pg = spark.read.parquet(pages_path).select("page_id", "url")
        pid = F.col("page_id")
        pk = pg.select(
            pid.alias("packet_no"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
            F.concat_ws(".", F.lit("11"), F.floor(pid / 62500) % 250, F.floor(pid / 250) % 250, pid % 250 + 1).alias("src_ip"),
            F.lit("93.184.9.9").alias("dest_ip"),
            F.lit(40443).alias("src_port"), F.lit(443).alias("dest_port"), F.lit(6).alias("protocol"),
            F.lit(24).alias("tcp_flags"), F.lit("tls").alias("payload_kind"),
            F.regexp_extract("url", URL_HOST_RX, 1).alias("host"))
        parts = max(spark.sparkContext.defaultParallelism, 1)
        return encode_frames(pk.repartitionByRange(parts, "packet_no"), PAGES_CAPTURE_ID)

    return materialized(spark, build, "pages-frames", key)
