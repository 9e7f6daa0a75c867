"""Identifiers, timestamps as text, formatters and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
EPOCH_ISO = "1970-01-01T00:00:00.000Z"

# Every space character that trimming and \s cover.
SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def nul() -> Column:
    return F.char(F.lit(0))


def seed(*parts: Column) -> Column:
    """NUL-joined id seed."""
    return F.concat_ws("\0", *[part.cast("string") for part in parts])


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(seed(*parts), 256), F.lit(length)))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def trim_all(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, f"^[{SPACES}]+", ""), f"[{SPACES}]+\\z", "")


def blank_to_null(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def clean_identifier(value: Column, limit: int = 160) -> Column:
    """``value`` is composed first (``redaction.compose``)."""
    dashed = F.regexp_replace(trim_all(value), "[^A-Za-z0-9_-]+", "-")
    edged = F.regexp_replace(F.regexp_replace(dashed, "^-+", ""), "-+\\z", "")
    return F.coalesce(blank_to_null(F.left(edged, F.lit(limit))), F.lit("unknown"))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def grouped(count: Column) -> Column:
    """1234567 -> 1,234,567."""
    return F.format_number(count.cast("decimal(38,0)"), 0)


def _tenths(tenths: Column) -> Column:
    whole = F.floor(tenths / 10).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), (tenths - whole * 10).cast("long").cast("string"))


def _scaled(total: Column, unit: int, suffix: str) -> Column:
    return F.concat(_tenths(F.floor((total * 10 + unit // 2) / unit).cast("long")), F.lit(suffix))


def compact_tokens(total: Column) -> Column:
    """1234 -> 1.2K, one decimal rounded half up, K/M/B."""
    return (
        F.when(total >= 1_000_000_000, _scaled(total, 1_000_000_000, "B"))
        .when(total >= 1_000_000, _scaled(total, 1_000_000, "M"))
        .when(total >= 1_000, _scaled(total, 1_000, "K"))
        .otherwise(total.cast("string"))
    )


def usd(micro: Column) -> Column:
    """Whole cents, rounded half up."""
    cents = F.floor((micro + 5000) / 10000).cast("long")
    whole = F.floor(cents / 100).cast("long")
    return F.when(micro.isNull(), F.lit("not priced")).otherwise(
        F.concat(F.lit("$"), whole.cast("string"), F.lit("."), F.lpad((cents - whole * 100).cast("string"), 2, "0"))
    )


def ellipsis(value: Column, limit: Column | int) -> Column:
    most = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.left(value, F.greatest(F.lit(1), most - 1)), F.lit("…")))


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def offset_label(offset: Column) -> Column:
    """UTC, UTC+05:30, UTC-07:00."""
    size = F.abs(offset).cast("long")
    sign = F.when(offset > 0, F.lit("+")).otherwise(F.lit("-"))
    return F.when(F.coalesce(offset, F.lit(0)) == 0, F.lit("UTC")).otherwise(
        F.concat(
            F.lit("UTC"), sign,
            F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad((size % 60).cast("string"), 2, "0"),
        )
    )


def decimal_text(value: Column) -> Column:
    """One-decimal number the way it reads in a sentence: 2 not 2.0, 2.5 as is."""
    tenths = F.floor(value * 10 + F.lit(0.5)).cast("long")
    return F.when(tenths % 10 == 0, F.floor(tenths / 10).cast("long").cast("string")).otherwise(_tenths(tenths))


# Local time under a whole-minute offset ------------------------------------


def shifted(ts: Column, offset: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(ts) + F.coalesce(offset, F.lit(0)).cast("long") * 60000)


def local_hour(ts: Column, offset: Column) -> Column:
    return F.coalesce(F.hour(shifted(ts, offset)), F.lit(0)).cast("int")


def local_weekday(ts: Column, offset: Column) -> Column:
    """0 = Sunday."""
    return F.coalesce(F.dayofweek(shifted(ts, offset)) - 1, F.lit(0)).cast("int")


def local_day(ts: Column, offset: Column) -> Column:
    return F.date_format(shifted(ts, offset), "yyyy-MM-dd")


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in DAY_NAMES]), weekday + 1)


# Archetype aliases -----------------------------------------------------------


def archetype_name(name: Column) -> Column:
    return F.when(name == "Velocity Machine", F.lit("Shipping Machine")).otherwise(name)


def archetype_facet(name: Column) -> Column:
    return F.replace(F.lower(archetype_name(name)), F.lit(" "), F.lit("-"))
