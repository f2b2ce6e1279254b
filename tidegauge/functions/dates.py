"""Date and time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge.functions.hashing import md5_mod

PROJECT_ZONE = "America/Sao_Paulo"


def customer_since(
    stable_id: Column,
    tenure_years: Column,
    anchor: str = "2024-12-31",
    jitter_days: int = 365,
) -> Column:
    """Anchor minus the tenure in years plus a hash-fixed number of days, as text."""
    years = F.coalesce(tenure_years.cast("int"), F.lit(0))
    start = F.add_months(F.lit(anchor).cast("date"), years * F.lit(-12))
    days = md5_mod(stable_id.cast("string"), jitter_days).cast("int") if jitter_days > 0 else F.lit(0)
    return F.date_format(F.date_add(start, days), "yyyy-MM-dd")


def snapshot_date(row_number: Column, base: str = "2024-01-01", cycle_days: int = 365) -> Column:
    """Base date plus the zero-based row number modulo the cycle, as text."""
    offset = F.pmod(row_number.cast("long") - F.lit(1), F.lit(cycle_days)).cast("int")
    return F.date_format(F.date_add(F.lit(base).cast("date"), offset), "yyyy-MM-dd")


def minute_timestamp(position: Column, start: str = "2024-01-01 00:00:00") -> Column:
    """Start time plus ``position`` minutes."""
    return F.timestamp_add("MINUTE", position, F.lit(start).cast("timestamp"))


def iso_with_offset(moment: Column, zone: str = PROJECT_ZONE) -> Column:
    """ISO-8601 text with the numeric offset of the zone (session zone must be UTC)."""
    local = F.from_utc_timestamp(moment, zone)
    minutes = F.timestamp_diff("MINUTE", moment, local)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(minutes)
    offset = F.format_string(
        "%s%02d:%02d", sign, F.floor(size / 60).cast("int"), F.pmod(size, F.lit(60)).cast("int")
    )
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)
