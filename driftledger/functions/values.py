"""Number, time, digest and flag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EVENT_TAGS, NO_HASH, REASON_BITS


def unsigned_id(col: Column) -> Column:
    """A 64-bit id stored as a signed long, shown as the unsigned number it is."""
    wide = col.cast("decimal(20,0)")
    shifted = (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(col < 0, shifted).otherwise(wide)


def signed_id(col: Column) -> Column:
    """Inverse of :func:`unsigned_id`."""
    wide = col.cast("decimal(21,0)")
    wrapped = (wide - F.lit("18446744073709551616").cast("decimal(21,0)")).cast("decimal(21,0)")
    limit = F.lit("9223372036854775807").cast("decimal(21,0)")
    return F.when(wide > limit, wrapped).otherwise(wide).cast("long")


def unix_or_zero(ts: Column) -> Column:
    """Unix seconds of a nullable timestamp; missing counts as 0."""
    return F.coalesce(F.unix_seconds(ts), F.lit(0).cast("long"))


def clock_text(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session time zone, ``?`` when out of range."""
    # the calendar of the text form ends with year 9999
    valid = seconds.between(-62167219200, 253402300799)
    return F.when(
        valid, F.date_format(F.timestamp_seconds(F.when(valid, seconds)), "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.lit("?"))


def hex_lower(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def second_digest(content: Column, algorithm: str | None) -> Column:
    """The optional extra digest: ``sha512``, ``xxhash64`` or none."""
    if algorithm is None:
        return F.lit(None).cast("string")
    if algorithm == "sha512":
        return F.sha2(content, 512)
    if algorithm == "xxhash64":
        return F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))
    raise ValueError(f"unknown second digest '{algorithm}', must be sha512 or xxhash64")


def starts_with_mz(content: Column) -> Column:
    """The first two bytes are ``MZ``; false for null or shorter content."""
    return F.coalesce(F.substring(content, 1, 2) == F.lit(b"MZ"), F.lit(False))


def short_hash(sha256: Column) -> Column:
    return F.coalesce(F.substring(sha256, 1, 16), F.lit(NO_HASH))


def floor_div(col: Column, width: int) -> Column:
    """Integer division rounding down, exact also where a double quotient would round."""
    return ((col - F.pmod(col, F.lit(width))) / F.lit(width)).cast("long")


def has_bits(reason: Column, *names: str) -> Column:
    """Any of the named reason bits is set."""
    mask = 0
    for name in names:
        mask |= REASON_BITS[name]
    return reason.cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0


def event_tag(kind: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, tag in EVENT_TAGS.items():
        expr = F.when(kind == name, F.lit(tag)).otherwise(expr)
    return expr
