"""Time bounds, presets and renderings, all independent of the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The relative ranges a user can pick. None means no bound at all.
PRESETS: dict[str, timedelta | None] = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "4h": timedelta(hours=4),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
    "all": None,
}


def as_utc(value: datetime | str) -> datetime:
    """A bound as a UTC instant; a value without an offset is taken as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def preset(name: str, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """``(start, end)`` of a named relative range that ends now."""
    if name not in PRESETS:
        raise ValueError(f"unknown time preset {name!r}; choose one of {', '.join(PRESETS)}")
    span = PRESETS[name]
    if span is None:
        return None, None
    end = as_utc(now) if now is not None else datetime.now(timezone.utc)
    return end - span, end


def comparable(df: DataFrame, column: str) -> Column:
    """The column in a form that ``bound_literal`` can be compared with."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return parse_iso(F.col(column))
    return F.col(column)


def bound_literal(df: DataFrame, column: str, value: datetime | str) -> Column:
    """A bound in the column's own type, so that the comparison reaches the file reader.

    Comparing a zone-less column with an instant would put a cast on the column and stop
    Parquet from skipping row groups.
    """
    kind = df.schema[column].dataType
    text = as_utc(value).isoformat(sep=" ", timespec="microseconds")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(text.removesuffix("+00:00")).cast("timestamp_ntz")
    if isinstance(kind, (T.TimestampType, T.StringType)):
        return F.lit(text).cast("timestamp")
    raise TypeError(f"column {column!r} is {kind.simpleString()}, expected a timestamp")


def iso_utc(ts: Column) -> Column:
    """An instant as ISO text in UTC, e.g. ``2026-03-01T12:00:00+00:00``.

    Microseconds are printed only where there are any.
    """
    micros = F.unix_micros(ts)
    wall_clock = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz")).cast("string")
    seconds = F.replace(F.left(wall_clock, F.lit(19)), F.lit(" "), F.lit("T"))
    rest = F.pmod(micros, F.lit(1_000_000))
    fraction = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(seconds, fraction, F.lit("+00:00"))


def trunc_ms(ts: Column) -> Column:
    """Cut an instant to whole milliseconds."""
    return F.date_trunc("MILLISECOND", ts)


def expiry(ttl_seconds: int, now: datetime | None = None) -> Column:
    """The moment ``ttl_seconds`` from now, as ISO text in UTC."""
    base = F.current_timestamp() if now is None else F.lit(as_utc(now).isoformat()).cast("timestamp")
    return iso_utc(F.timestamp_add("SECOND", F.lit(ttl_seconds), base))


def parse_iso(text: Column) -> Column:
    """ISO text to an instant; null or unreadable text gives null. Without an offset it is UTC, whatever the session."""
    offset = F.rlike(text, F.lit("[0-9][T ].*([Zz]|[+-][0-9]{1,2}(:?[0-9]{2})?)$"))
    timed = F.rlike(text, F.lit("[0-9][T ][0-9]"))
    return (
        F.when(offset, text.try_cast("timestamp"))
        .when(timed, F.concat(text, F.lit("Z")).try_cast("timestamp"))
        .otherwise(F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))
    )


def require_iso(text: Column) -> Column:
    """As ``parse_iso``, but text that is there and cannot be read is an error."""
    instant = parse_iso(text)
    wrong = text.isNotNull() & instant.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp")).otherwise(instant)
