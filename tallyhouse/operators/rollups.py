"""Roll-ups: events to hours, hours to local days, events to sessions, proxy rows to both."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.times import (
    bucket_instant, bucket_to_utc, local_date, normalize_date, utc_hour,
)
from tallyhouse.operators.filters import drop_zero_buckets
from tallyhouse.operators.lookup import lookup_join
from tallyhouse.operators.merge import key_hash
from tallyhouse.operators.pricing import price_usage
from tallyhouse.schemas import COST, DAILY_KEYS, HOUR_KEYS, MEASURES, REQUESTS, SESSION_KEYS, TOTAL
from tallyhouse.session import cut_lineage
from tallyhouse.sources.tables import attributed, read_ccswitch_requests


def measure_sums(columns=MEASURES) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def daily_by_model(events: DataFrame) -> DataFrame:
    return events.groupBy("usage_date", "model").agg(*measure_sums())


def hour_rollup(events: DataFrame) -> DataFrame:
    """UTC hour buckets with request counts; events without a time are left out."""
    return (
        events.where(F.col("event_time").isNotNull())
        .withColumn("hour", utc_hour(F.col("event_time")))
        .groupBy(*HOUR_KEYS).agg(*measure_sums(), F.count("*").alias(REQUESTS))
    )


def daily_rebuild(hour: DataFrame, tz: str, span: tuple[date, date] | None = None) -> DataFrame:
    """Local days summed from UTC hours. A span of local days reads only the UTC dates that
    can reach it, one more on each side."""
    if span:
        day = timedelta(days=1)
        hour = hour.where(
            F.col("usage_date").between(F.lit(span[0] - day), F.lit(span[1] + day))
        )
    local = local_date(bucket_instant(F.col("usage_date"), F.col("hour")), tz)
    days = (
        hour.withColumn("usage_date", local).groupBy(*DAILY_KEYS)
        .agg(*measure_sums([*MEASURES, REQUESTS]))
    )
    return days.where(F.col("usage_date").between(*map(F.lit, span))) if span else days


def rebucket_local_to_utc(hour: DataFrame, tz: str) -> DataFrame:
    """Buckets once kept in local time as UTC buckets; buckets that meet are summed."""
    moved = hour.withColumn("_utc", bucket_to_utc(F.col("usage_date"), F.col("hour"), tz))
    return (
        moved.withColumns({"usage_date": F.col("_utc.usage_date"), "hour": F.col("_utc.hour")})
        .groupBy(*HOUR_KEYS).agg(*measure_sums([*MEASURES, REQUESTS]))
    )


def session_parts(events: DataFrame) -> DataFrame:
    """Sums per session, day, model and project, with the first and last activity.

    Counters and times are summed in a hash table, so a session of any size is small before it
    is brought together.
    """
    return events.where(F.col("session_id").isNotNull()).groupBy(
        *SESSION_KEYS, "usage_date", "model", "project_path"
    ).agg(*measure_sums(), F.max("event_time").alias("last_activity"),
          F.min("event_time").alias("first_activity"))


def sessions_of_parts(parts: DataFrame) -> DataFrame:
    """Sessions with their last activity, first project and the model with most tokens; both
    steps share one partitioning by session."""
    first = F.struct(F.col("first_activity").isNull(), "first_activity", "project_path")
    per_model = parts.repartition(*SESSION_KEYS).groupBy(key_hash(SESSION_KEYS), *SESSION_KEYS, "model").agg(
        *measure_sums(), F.max("last_activity").alias("last_activity"),
        F.min(F.when(F.col("project_path").isNotNull(), first)).alias("project"),
    )
    return per_model.groupBy("_key_hash", *SESSION_KEYS).agg(
        F.max("last_activity").alias("last_activity"),
        F.min("project").alias("project"),
        F.min_by("model", F.struct((-F.col(TOTAL)).alias("t"), "model")).alias("model"),
        *measure_sums(),
    ).withColumn("project_path", F.col("project.project_path")).drop("project", "_key_hash")


def session_rollup(events: DataFrame) -> DataFrame:
    return sessions_of_parts(session_parts(events))


def ccswitch_hours(requests: DataFrame, prices: DataFrame, device: str) -> DataFrame:
    """Hour buckets of proxied requests under their own sources, priced per model."""
    instant = F.timestamp_seconds("created_at")
    rows = attributed(requests).withColumns({
        "device": F.lit(device), "usage_date": F.to_date(instant), "hour": F.hour(instant)
    })
    sums = rows.groupBy(*HOUR_KEYS).agg(
        *measure_sums([c for c in MEASURES if c != COST]), F.count("*").alias(REQUESTS)
    )
    return drop_zero_buckets(price_usage(sums, prices))


def requests_of_touched_hours(requests: DataFrame, low: int | None = None) -> DataFrame:
    """All successful requests of the hours that may have requests from ``low`` on, so that an hour split over two reads
    is summed whole. The bound is a literal of the scan."""
    good = read_ccswitch_requests(requests)
    return good if low is None else good.where(F.col("created_at") >= low // 3600 * 3600)


def dated_rollups(rollups: DataFrame) -> DataFrame:
    """Proxy day rollups under their own sources; rows without a readable date are left out."""
    dated = attributed(rollups).withColumn("usage_date", normalize_date(F.col("date")))
    return dated.where(F.col("usage_date").isNotNull())


def rollups_before_local(rollups: DataFrame, daily: DataFrame) -> DataFrame:
    """Rollups older than the first local day of their source, or of sources without local days."""
    first = (
        daily.where(F.col("source").isin(K.LOCAL_FIRST_SOURCES))
        .groupBy("source").agg(F.min("usage_date").alias("first_local"))
    )
    kept = F.col("first_local").isNull() | (F.col("usage_date") < F.col("first_local"))
    return lookup_join(rollups, cut_lineage(first), "source").where(kept).drop("first_local")


def ccswitch_rollup_daily(
    rollups: DataFrame, daily: DataFrame, prices: DataFrame, device: str
) -> DataFrame:
    """Day rows from the proxy's history where no local history exists."""
    rows = rollups_before_local(dated_rollups(rollups), daily).withColumn("device", F.lit(device))
    sums = rows.groupBy(*DAILY_KEYS).agg(*measure_sums([c for c in MEASURES if c != COST]))
    return drop_zero_buckets(price_usage(sums, prices))


def rollup_statistics(rollups: DataFrame, daily: DataFrame) -> DataFrame:
    """Rollup rows read, taken over and skipped because local history exists."""
    dated = dated_rollups(rollups)
    kept = rollups_before_local(dated, daily).agg(F.count("*"))
    return dated.agg(F.count("*").alias("scanned")).withColumn(
        "included", kept.scalar()
    ).withColumn("skipped", F.col("scanned") - F.col("included"))
