"""Row filters, date ranges and ordered reads of the usage tables."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.times import bucket_to_local, local_date
from tallyhouse.functions.tokens import has_usage, token_total
from tallyhouse.schemas import COST, REASONING, TOTAL

Span = tuple[date, date]


def with_total_tokens(usage: DataFrame) -> DataFrame:
    return usage.withColumn(TOTAL, token_total())


def repair_totals(usage: DataFrame) -> DataFrame:
    """Restate totals that counted reasoning twice; other rows keep theirs."""
    wrong = (F.col(REASONING) > 0) & (F.col(TOTAL) != token_total())
    return usage.withColumn(TOTAL, F.when(wrong, token_total()).otherwise(F.col(TOTAL)))


def drop_zero_usage(usage: DataFrame) -> DataFrame:
    return usage.where(has_usage())


def drop_zero_buckets(usage: DataFrame) -> DataFrame:
    return usage.where((F.col(TOTAL) != 0) | (F.col(COST) != 0))


def _among(column: str, values) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def filter_series(usage: DataFrame, sources=(), models=()) -> DataFrame:
    """Rows of the given sources and models; an empty selection does not restrict."""
    return usage.where(_among("source", sources) & _among("model", models))


def filter_daily(
    daily: DataFrame, start: date | None, end: date | None, sources=(), devices=(), models=()
) -> DataFrame:
    """Days from start to end with usage, optionally of some sources, devices and models; an
    absent bound does not restrict."""
    after = F.lit(True) if start is None else F.col("usage_date") >= F.lit(start)
    until = F.lit(True) if end is None else F.col("usage_date") <= F.lit(end)
    rows = daily.where(after & until & _among("device", devices) & (F.col(TOTAL) > 0))
    return filter_series(rows, sources, models)


def local_midnight(as_of: date, days_back: int, tz: str) -> Column:
    """Instant of the local midnight that began the day ``days_back`` days before ``as_of``."""
    day = F.lit(as_of - timedelta(days=days_back)).cast("timestamp")
    return F.to_utc_timestamp(day, tz)


def recent_hours(hour: DataFrame, days: int, as_of: date, tz: str) -> DataFrame:
    """Hour rows from the UTC date on which the last ``days`` local days begin; all for days <= 0."""
    if days > 0:
        first = F.to_date(local_midnight(as_of, days - 1, tz))
        hour = hour.where(F.col("usage_date") >= first)
    return hour


def recent_events(events: DataFrame, days: int, as_of: date, tz: str) -> DataFrame:
    """Events since the local midnight ``days`` days back; all for days <= 0."""
    if days > 0:
        events = events.where(F.col("event_time") >= local_midnight(as_of, days, tz))
    return events


def today_events(events: DataFrame, as_of: date, tz: str) -> DataFrame:
    """Events since yesterday's local midnight, dated by local day."""
    return recent_events(events, 1, as_of, tz).withColumn(
        "usage_date", local_date(F.col("event_time"), tz)
    )


def localized_hours(hour: DataFrame, tz: str) -> DataFrame:
    """Hour rows with local date and hour."""
    local = bucket_to_local(F.col("usage_date"), F.col("hour"), tz)
    return hour.withColumn("_local", local).withColumns(
        {"usage_date": F.col("_local.usage_date"), "hour": F.col("_local.hour")}
    ).drop("_local")


def _month_start(day: date, months_back: int) -> date:
    months = day.year * 12 + day.month - 1 - months_back
    return date(months // 12, months % 12 + 1, 1)


def range_span(range_id: str, as_of: date) -> Span | None:
    """First and last day of a named range; None for ``all``, which the data decide."""
    day = timedelta(days=1)
    spans = {
        "today": (as_of, as_of),
        "yesterday": (as_of - day, as_of - day),
        "7d": (as_of - 6 * day, as_of),
        "30d": (as_of - 29 * day, as_of),
        "month": (_month_start(as_of, 0), as_of),
        "lastMonth": (_month_start(as_of, 1), _month_start(as_of, 0) - day),
    }
    return spans.get(range_id)


def compare_span(range_id: str, start: date, end: date) -> Span:
    """The span a range is compared with: whole months for months, else equally long before."""
    day = timedelta(days=1)
    if range_id in ("month", "lastMonth"):
        return _month_start(start, 1), _month_start(start, 0) - day
    length = (end - start).days + 1
    return start - length * day, start - day


def detail_range(range_id: str, as_of: date, custom: Span | None = None) -> Span:
    """Span of the model page; ``all`` is the last 180 days until the model's own dates are known."""
    if range_id == "custom" and custom:
        return custom
    days = {"today": 1, "last30": 30, "last90": 90, "all": 180}.get(range_id, 7)
    if range_id == "yesterday":
        return as_of - timedelta(days=1), as_of - timedelta(days=1)
    return as_of - timedelta(days=days - 1), as_of


def date_span(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date")
    )


def min_usage_date(daily: DataFrame) -> DataFrame:
    return daily.groupBy("source").agg(F.min("usage_date").alias("first_date"))


def daily_series_all(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.desc("usage_date"))


def model_daily(daily: DataFrame, model: str) -> DataFrame:
    return daily.where(F.col("model") == model).orderBy(F.desc("usage_date"))


def ordered_hours(hour: DataFrame) -> DataFrame:
    return hour.orderBy(F.desc("usage_date"), "hour")


def model_hour(hour: DataFrame, model: str) -> DataFrame:
    return ordered_hours(hour.where(F.col("model") == model))


def ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("event_time"))


def ordered_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc(TOTAL))


def ordered_devices(devices: DataFrame) -> DataFrame:
    return devices.orderBy(F.desc("is_local"), "display_name")


def ordered_prices(prices: DataFrame) -> DataFrame:
    return prices.orderBy("model_key")


def search_prices(prices: DataFrame, keyword: str) -> DataFrame:
    return prices.where(F.lower("model_key").contains(keyword.strip().lower()))


def distinct_values(daily: DataFrame) -> DataFrame:
    """(kind, value) of the sources, models and devices in use."""
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
        for k in ("source", "model", "device")
    ])
    return daily.select(F.inline(kinds)).where("value != ''").distinct()


def quarantined(events: DataFrame) -> DataFrame:
    """Events per source that lack a time or a day and so reach no hour or day bucket."""
    return (
        events.where(F.col("event_time").isNull() | F.col("usage_date").isNull())
        .groupBy("source").agg(F.count("*").alias("events"))
    )
