"""Scalar column functions: names, address forms, labels and percentages.

All are native Column expressions (no Python at run time).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.schema import (
    ACK, DOMAIN_LABEL_KEEP, DOMAIN_LABEL_MAX, FIN, HOST_KEYWORDS, PSH, RST, SYN, URG,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_flag(flags: Column | str, bit: int) -> Column:
    return (_col(flags).bitwiseAND(F.lit(bit)) != 0)


def protocol_name(protocol: Column | str) -> Column:
    """ICMP / TCP / UDP, otherwise ``Unknown(n)`` (S3)."""
    p = _col(protocol)
    return (F.when(p == 1, "ICMP").when(p == 6, "TCP").when(p == 17, "UDP")
            .otherwise(F.concat(F.lit("Unknown("), p.cast("string"), F.lit(")"))))


def tcp_flag_names(flags: Column | str) -> Column:
    """Set flags in the order SYN ACK FIN RST PSH URG, space separated; ``none`` if empty."""
    f = _col(flags)
    parts = [F.when(has_flag(f, bit), name)
             for name, bit in (("SYN", SYN), ("ACK", ACK), ("FIN", FIN),
                               ("RST", RST), ("PSH", PSH), ("URG", URG))]
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", "none").otherwise(text)


def ip_to_long(ip: Column | str) -> Column:
    """Dotted text to the packed form with the first octet in the low byte.

    Characters other than digits and dots are skipped and an empty octet is 0,
    so ``10.0.0.0/8`` packs as ``10.0.0.8``.
    """
    cleaned = F.regexp_replace(_col(ip), r"[^0-9.]", "")
    octets = F.split(cleaned, r"\.")
    shifted = F.transform(
        octets,
        lambda x, i: F.call_function("shiftleft", F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")), i * 8),
    )
    return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(v))


def long_to_ip(v: Column | str) -> Column:
    """Inverse of :func:`ip_to_long` on the low 32 bits."""
    x = _col(v)
    return F.concat_ws(".", *[F.shiftright(x, 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def normalize_ip(ip: Column | str) -> Column:
    """The address a rule value denotes, in dotted form (S6 of S5)."""
    return long_to_ip(ip_to_long(ip))


def host_app(host: Column | str) -> Column:
    """Application label of a host name (S11): first keyword contained wins.

    One array scan over the keyword list; the host is referenced once, so the
    expression stays small wherever the optimizer moves it.
    """
    h = F.lower(_col(host))
    keywords = F.array(*[F.lit(k) for k, _ in HOST_KEYWORDS])
    apps = F.create_map(*[x for k, a in HOST_KEYWORDS for x in (F.lit(k), F.lit(a))])
    first = F.get(F.filter(keywords, lambda k: F.instr(h, k) > 0), 0)
    return F.when(h.isNull(), F.lit("Unknown")).otherwise(F.coalesce(apps[first], F.lit("Unknown")))


def domain_label(domain: Column | str) -> Column:
    """Report label: names longer than 35 characters keep 32 and gain ``...``."""
    d = _col(domain)
    return F.when(F.length(d) > DOMAIN_LABEL_MAX,
                  F.concat(F.substring(d, 1, DOMAIN_LABEL_KEEP), F.lit("..."))).otherwise(d)


def percent(part: Column | str, total: Column | str, digits: int, zero_as_null: bool) -> Column:
    """``100 * part / total`` rounded (S16); NULL or 0 when total is 0."""
    p, t = _col(part), _col(total)
    value = F.round(F.lit(100.0) * p / t, digits)
    return F.when(t > 0, value).otherwise(F.lit(None) if zero_as_null else F.lit(0.0))


def capture_ts(ts_sec: Column | str, ts_usec: Column | str) -> Column:
    """Capture timestamp from seconds and microseconds."""
    return F.timestamp_micros(_col(ts_sec) * 1_000_000 + _col(ts_usec))


def ntz_micros(ts: Column | str) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ read as UTC, independent of the session zone."""
    t = _col(ts)
    return (F.unix_date(F.to_date(t)).cast("bigint") * 86_400_000_000
            + F.hour(t).cast("bigint") * 3_600_000_000
            + F.minute(t).cast("bigint") * 60_000_000
            + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint"))

