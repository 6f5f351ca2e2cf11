"""Canonical row text, its checksum, and version timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_json(columns: list[str]) -> Column:
    """The row as JSON: the given columns by name in order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def signed_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, read as a signed 32-bit number."""
    c = F.crc32(text)
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int")


def version_text(ts: Column) -> Column:
    """UTC, RFC 3339, exactly milliseconds; text that is no timestamp stays as it is."""
    parsed = F.try_to_timestamp(ts.cast("string"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ts.cast("string"))


def row_version(deleted_at: Column, updated_at: Column, seq: Column) -> Column:
    return F.coalesce(deleted_at.cast("string"), updated_at.cast("string"), seq.cast("string"))


def deterministic_uuid(namespace: str, key: Column) -> Column:
    """A version-5-shaped UUID from SHA-256 of ``namespace:key``."""
    h = F.sha2(F.concat(F.lit(f"{namespace}:"), key.cast("string")), 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
