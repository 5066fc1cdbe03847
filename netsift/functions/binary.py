"""Native byte access on ``binary`` columns.

Every helper returns a JVM-side Column expression, so decoding stays inside
whole-stage codegen. Offsets are 0-based and may be Columns. Reading past the
end of the value yields NULL (``substr`` returns a short value and the length
check fails), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrInt = Column | int


def _c(x: ColOrInt) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def byte_slice(data: Column, offset: ColOrInt, length: ColOrInt) -> Column:
    """``length`` bytes from 0-based ``offset``; NULL when not all are present."""
    off, ln = _c(offset), _c(length)
    return F.when(F.octet_length(data) >= off + ln, data.substr(off + 1, ln))


def _unsigned(data: Column, offset: ColOrInt, width: int, cast: str, checked: bool) -> Column:
    raw = byte_slice(data, offset, width) if checked else data.substr(_c(offset) + 1, F.lit(width))
    return F.conv(F.hex(raw), 16, 10).cast(cast)


def u8(data: Column, offset: ColOrInt, checked: bool = True) -> Column:
    """Unsigned byte. ``checked=False`` skips the length guard: use it only
    where the caller has already checked the length (smaller generated code)."""
    return _unsigned(data, offset, 1, "int", checked)


def u16(data: Column, offset: ColOrInt, checked: bool = True) -> Column:
    """Big-endian unsigned 16-bit value."""
    return _unsigned(data, offset, 2, "int", checked)


def u32(data: Column, offset: ColOrInt, checked: bool = True) -> Column:
    """Big-endian unsigned 32-bit value (bigint)."""
    return _unsigned(data, offset, 4, "bigint", checked)


def mac_text(data: Column, offset: ColOrInt) -> Column:
    """Six bytes as lower-case hex pairs joined by ``:``."""
    h = F.lower(F.hex(byte_slice(data, offset, 6)))
    return F.regexp_replace(h, r"(..)(?!$)", "$1:")


def ipv4_text(data: Column, offset: ColOrInt) -> Column:
    """Four bytes as dotted decimal (S2): one 32-bit read, octets by shifts."""
    v = u32(data, offset)
    return F.concat_ws(".", *[F.shiftright(v, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def _hex(x: Column, digits: int) -> Column:
    """Hex digits of an integer column, for frame encoding; a value that needs
    more raises. ``x`` is referenced once, so nested encodings stay small."""
    def one(v):
        return F.when(v.between(0, (1 << 4 * digits) - 1), F.lpad(F.hex(v), digits, "0")).when(v.isNotNull(), F.raise_error(
            F.concat(v.cast("string"), F.lit(f" needs more than {digits} hex digits"))).cast("string"))
    return F.get(F.transform(F.array(x.cast("bigint")), one), F.lit(0))


def hex_u8(x: Column) -> Column:
    return _hex(x, 2)


def hex_u16(x: Column) -> Column:
    return _hex(x, 4)


def hex_u24(x: Column) -> Column:
    return _hex(x, 6)


def hex_u32(x: Column) -> Column:
    return _hex(x, 8)


def hex_u32_le(x: Column) -> Column:
    """Little-endian hex of an unsigned 32-bit value."""
    h = hex_u32(x)
    return F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2))


def latin1_text(data: Column) -> Column:
    """Bytes as a string with one character per byte (lossless)."""
    return F.decode(data, "ISO-8859-1")


def utf8_text(data: Column) -> Column:
    """Bytes as UTF-8 text; malformed sequences become U+FFFD, never an error."""
    return F.make_valid_utf8(data.cast("string"))
