"""Instants, UTC/local buckets, calendar labels. The session time zone must be UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import constants as K

_CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
_ZONED = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_CLOCK}(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})$"
_ZONELESS = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[T ]{_CLOCK})?$"


def epoch_to_utc(number: Column) -> Column:
    """Unix seconds (below 1e12) or milliseconds; NULL unless positive."""
    number = number.try_cast("bigint")
    millis = F.when(number < 10**12, number * 1000).otherwise(number)
    return F.date_trunc("second", F.when(number > 0, F.timestamp_millis(millis)))


def to_utc_ts(text: Column, tz: str = "UTC") -> Column:
    """Instant of a log timestamp; zone-less text is read in the collector's zone."""
    parsed = text.try_cast("timestamp")
    return F.coalesce(
        F.date_trunc("second", F.when(text.rlike(_ZONED), parsed)),
        F.date_trunc("second", F.when(text.rlike(_ZONELESS), F.to_utc_timestamp(parsed, tz))),
        epoch_to_utc(F.when(text.rlike(r"^[+-]?[0-9]+$"), text)),
    )


def utc_date(instant: Column) -> Column:
    return F.to_date(instant)


def utc_hour(instant: Column) -> Column:
    """Hour of day, -1 for a missing instant."""
    return F.coalesce(F.hour(instant), F.lit(-1))


def bucket_instant(date: Column, hour: Column) -> Column:
    return F.timestamp_seconds(F.unix_date(date).cast("bigint") * F.lit(86400) + hour * F.lit(3600))


def bucket_to_local(date: Column, hour: Column, tz: str) -> Column:
    """UTC (date, hour) as a local struct<usage_date, hour>."""
    local = F.from_utc_timestamp(bucket_instant(date, hour), tz)
    return F.struct(F.to_date(local).alias("usage_date"), F.hour(local).alias("hour"))


def bucket_to_utc(date: Column, hour: Column, tz: str) -> Column:
    """Local (date, hours since local midnight) as a UTC struct<usage_date, hour>."""
    midnight = F.unix_seconds(F.to_utc_timestamp(date.cast("timestamp"), tz))
    instant = F.timestamp_seconds(midnight + hour * F.lit(3600))
    return F.struct(F.to_date(instant).alias("usage_date"), F.hour(instant).alias("hour"))


def noon_localize(date: Column, tz: str) -> Column:
    """Local day of a UTC day that carries no hours, taken at its noon."""
    return F.to_date(F.from_utc_timestamp(bucket_instant(date, F.lit(12)), tz))


def local_date(instant: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, tz))


def normalize_date(text: Column) -> Column:
    """Date from "Y/M/D" or ISO text, NULL otherwise."""
    slashed = r"^\s*([0-9]{4})\s*/\s*([0-9]{1,2})\s*/\s*([0-9]{1,2})\s*$"
    padded = F.regexp_replace(F.regexp_replace(text, slashed, "$1-0$2-0$3"), "-0([0-9]{2})", "-$1")
    return F.regexp_extract(padded, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*$", 1).try_cast("date")


def bucket_label(date: Column, granularity: str, legacy_week: bool = False) -> Column:
    """Chart label of a day. Weeks are ISO weeks; ``legacy_week`` counts them from zero
    within the calendar year."""
    if granularity == "weekly":
        year = F.year(date) if legacy_week else F.extract(F.lit("YEAROFWEEK"), date)
        week = F.weekofyear(date) - (1 if legacy_week else 0)
        return F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    patterns = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    return F.date_format(date, patterns[granularity])


def default_granularity(days: int | None) -> str:
    for limit, granularity in K.GRANULARITY_LIMITS:
        if days is not None and days > limit:
            return granularity
    return "daily"


def granularity_of(days: Column) -> Column:
    """The default granularity of a range of so many days."""
    chosen = F.lit("daily")
    for limit, granularity in reversed(K.GRANULARITY_LIMITS):
        chosen = F.when(days > limit, granularity).otherwise(chosen)
    return chosen
