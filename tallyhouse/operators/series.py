"""Zero-filled series over calendars, activity, comparison and the layered day views."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.times import bucket_label
from tallyhouse.functions.tokens import cache_hit_rate, delta_pct, heat_level
from tallyhouse.operators.filters import Span, local_midnight, localized_hours
from tallyhouse.operators.ranking import top_n_other
from tallyhouse.schemas import (
    CACHE_READ, CACHE_WRITE, COST, INPUT, MEASURES, OUTPUT, REASONING, REQUESTS, TOTAL,
)


def _col(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def calendar_days(first: date | Column, last: date | Column) -> Column:
    """Generator of the days from first to last; either may be a scalar subquery."""
    return F.explode(F.sequence(_col(first), _col(last)))


def data_span(daily: DataFrame) -> tuple[Column, Column]:
    """First and last day of the data as scalar subqueries."""
    return daily.agg(F.min("usage_date")).scalar(), daily.agg(F.max("usage_date")).scalar()


def calendar(spark: SparkSession, first: date | Column, last: date | Column) -> DataFrame:
    return spark.range(1).select(calendar_days(first, last).alias("usage_date"))


def zero_filled(facts: DataFrame, skeleton: DataFrame, keys: list[str], measures: list[str]):
    """Sums per key with a zero row for every key of the skeleton.

    The skeleton joins the facts as rows of zeros, so one aggregation with map-side partial
    sums does both.
    """
    kinds = {f.name: f.dataType for f in facts.schema}
    zeros = skeleton.select(*keys, *[F.lit(0).cast(kinds[m]).alias(m) for m in measures])
    both = facts.select(*keys, *measures).unionByName(zeros)
    return both.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def _within(usage: DataFrame, first, last) -> DataFrame:
    return usage.where(F.col("usage_date").between(_col(first), _col(last)))


def trend(
    usage: DataFrame, first: date | Column, last: date | Column, granularity: str = "daily",
    sources: DataFrame | None = None, legacy_week: bool = False,
) -> DataFrame:
    """Tokens per calendar bucket and source, zero filled over the sources (default: those
    that occur)."""
    bucket = bucket_label(F.col("usage_date"), granularity, legacy_week).alias("bucket")
    present = (usage if sources is None else sources).select("source").distinct()
    skeleton = present.select("source", calendar_days(first, last).alias("usage_date"))
    facts = _within(usage, first, last).select(bucket, "source", TOTAL)
    return zero_filled(
        facts, skeleton.select(bucket, "source"), ["bucket", "source"], [TOTAL]
    ).orderBy("bucket", "source")


def trend_field(
    usage: DataFrame, first: date | Column, last: date | Column, granularity: str, field: str,
    legacy_week: bool = False,
) -> DataFrame:
    """One measure per calendar bucket, zero filled."""
    bucket = bucket_label(F.col("usage_date"), granularity, legacy_week).alias("bucket")
    facts = _within(usage, first, last).select(bucket, F.col(field).alias("value"))
    skeleton = calendar(usage.sparkSession, first, last).select(bucket)
    return zero_filled(facts, skeleton, ["bucket"], ["value"]).orderBy("bucket")


def activity_stats(
    usage: DataFrame, first: date | Column, last: date | Column, granularity: str = "daily",
    by: str | None = None, legacy_week: bool = False,
) -> DataFrame:
    """Buckets with usage and the longest run without, over all rows or per column ``by``.

    The ordered steps see one row per calendar bucket.
    """
    keys = [by] if by else []
    bucket = bucket_label(F.col("usage_date"), granularity, legacy_week).alias("bucket")
    if by:
        days = usage.select(by).distinct().select(by, calendar_days(first, last).alias("usage_date"))
    else:
        days = calendar(usage.sparkSession, first, last)
    facts = _within(usage, first, last).select(*keys, bucket, F.lit(1).alias("n"))
    seen = zero_filled(facts, days.select(*keys, bucket), [*keys, "bucket"], ["n"])
    active = (F.col("n") > 0).cast("bigint")
    order = Window.partitionBy(*keys).orderBy("bucket")
    runs = seen.select(*keys, active.alias("active"), F.sum(active).over(order).alias("run"))
    per_run = runs.groupBy(*keys, "run").agg(
        F.sum("active").alias("active"), F.sum(1 - F.col("active")).alias("gap")
    )
    return per_run.groupBy(*keys).agg(
        F.sum("active").alias("active_buckets"), F.max("gap").alias("longest_gap")
    )


_KPIS = [TOTAL, INPUT, OUTPUT, CACHE_READ, CACHE_WRITE, REASONING, COST]


def _kpi_columns(suffix: str = "") -> list[Column]:
    read, written = F.col(CACHE_READ + suffix), F.col(CACHE_WRITE + suffix)
    return [
        (read + written).alias("cache_tokens" + suffix),
        cache_hit_rate(read, F.col(TOTAL + suffix)).alias("cache_hit_pct" + suffix),
    ]


def kpi_totals(usage: DataFrame) -> DataFrame:
    """One row of totals; all zero without usage."""
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in _KPIS]
    return usage.agg(*sums).select(*_KPIS, *_kpi_columns())


def kpi_compare(usage: DataFrame, current: Span, previous: Span) -> DataFrame:
    """Totals of two spans in one pass, and the change in percent."""
    def total(column: str, span: Span, suffix: str) -> Column:
        inside = F.col("usage_date").between(F.lit(span[0]), F.lit(span[1]))
        return F.coalesce(F.sum(F.when(inside, F.col(column))), F.lit(0).cast("bigint")).alias(
            column + suffix
        )

    reach = usage.where(
        F.col("usage_date").between(F.lit(current[0]), F.lit(current[1]))
        | F.col("usage_date").between(F.lit(previous[0]), F.lit(previous[1]))
    )
    sums = reach.agg(
        *[total(c, current, "") for c in _KPIS], *[total(c, previous, "_prev") for c in _KPIS]
    ).select("*", *_kpi_columns(), *_kpi_columns("_prev"))
    compared = [*_KPIS, "cache_tokens", "cache_hit_pct"]
    return sums.select(
        *[c + s for c in compared for s in ("", "_prev")],
        *[delta_pct(F.col(c), F.col(c + "_prev")).alias(c + "_delta_pct") for c in compared],
    )


_SERIES = {REQUESTS: "requests", CACHE_READ: "input_cached", INPUT: "input_uncached",
           OUTPUT: "output", COST: "cost"}


def _renamed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(n) for c, n in _SERIES.items()])


def hours_of_day(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def near_day(hour: DataFrame, day: date) -> DataFrame:
    """UTC hour rows whose local day can be the given one."""
    step = timedelta(days=1)
    return hour.where(F.col("usage_date").between(F.lit(day - step), F.lit(day + step)))


def hourly_24(hour: DataFrame, model: str, day: date, tz: str) -> DataFrame:
    """24 local hours of a model's day, zero filled."""
    rows = localized_hours(near_day(hour.where(F.col("model") == model), day), tz)
    facts = _renamed(rows.where(F.col("usage_date") == F.lit(day)), "hour")
    return zero_filled(
        facts, hours_of_day(hour.sparkSession), ["hour"], list(_SERIES.values())
    ).orderBy("hour")


def model_daily_series(
    daily: DataFrame, model: str, first: date | Column, last: date | Column
) -> DataFrame:
    """Days of a model, zero filled."""
    facts = _renamed(_within(daily.where(F.col("model") == model), first, last), "usage_date")
    days = calendar(daily.sparkSession, first, last)
    return zero_filled(facts, days, ["usage_date"], list(_SERIES.values())).orderBy("usage_date")


def series_headline(series: DataFrame) -> DataFrame:
    tokens = F.col("input_cached") + F.col("input_uncached") + F.col("output")
    return series.agg(
        F.sum("requests").alias("requests"), F.sum(tokens).alias("tokens"),
        F.sum("cost").alias("cost"),
    )


def calendar_heatmap(daily: DataFrame, as_of: date) -> DataFrame:
    """Tokens and heat level of the last 365 days in Sunday-to-Saturday columns.

    Cells that complete the first and last column have neither total nor level.
    """
    first = as_of - timedelta(days=K.HEATMAP_DAYS_BACK)
    grid_first = first - timedelta(days=first.isoweekday() % 7)
    grid_last = as_of + timedelta(days=6 - as_of.isoweekday() % 7)
    spark = daily.sparkSession
    facts = _within(daily, first, as_of).select("usage_date", TOTAL)
    totals = zero_filled(facts, calendar(spark, grid_first, grid_last), ["usage_date"], [TOTAL])
    shown = F.when(F.col("usage_date").between(F.lit(first), F.lit(as_of)), F.col(TOTAL))
    return totals.select(
        "usage_date", shown.alias(TOTAL),
        F.floor(F.date_diff("usage_date", F.lit(grid_first)) / 7).cast("int").alias("week_column"),
        (F.dayofweek("usage_date") - 1).alias("weekday"), heat_level(shown).alias("heat_level"),
    ).orderBy("usage_date")


def _layers(hour, events, daily, day: date, tz: str, fallback_hour: int) -> DataFrame:
    """Sums of one local day per source, hour, model and layer: 0 hours, 1 events, 2 days."""
    start, end = local_midnight(day, 0, tz), local_midnight(day, -1, tz)
    instant = F.col("event_time")
    local_hour = F.hour(F.from_utc_timestamp(instant, tz))
    columns = ["source", "hour", "model", *MEASURES]
    on_day = F.col("usage_date") == F.lit(day)
    hours = localized_hours(near_day(hour, day), tz).where(on_day)
    seen = events.where((instant >= start) & (instant < end)).withColumn("hour", local_hour)
    days = daily.where(on_day).withColumn("hour", F.lit(fallback_hour))
    rows = [r.select(*columns, F.lit(n).alias("layer")) for n, r in enumerate((hours, seen, days))]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.groupBy("source", "hour", "model", "layer").agg(
        *[F.sum(c).alias(c) for c in MEASURES]
    )


def fallback_hour(day: date, as_of: date, current_hour: int) -> int:
    """Hour that takes the usage of sources without hours: now for today, else the last."""
    return current_hour if day == as_of else 23


def hour_first_series(
    hour: DataFrame, events: DataFrame, daily: DataFrame, day: date, tz: str,
    fallback: int = 23,
) -> DataFrame:
    """A day per source and hour: hour rows, else events of that source and hour; day rows only
    for sources that have neither."""
    layers = _layers(hour, events, daily, day, tz, fallback)
    sums = layers.groupBy("source", "hour", "layer").agg(
        *[F.sum(c).alias(c) for c in MEASURES]
    )
    slot, source = Window.partitionBy("source", "hour"), Window.partitionBy("source")
    first = F.when(F.col("layer") == 2, F.min("layer").over(source)).otherwise(
        F.min("layer").over(slot)
    )
    return sums.withColumn("_first", first).where("layer = _first").drop("layer", "_first")


def kpi_today(series: DataFrame) -> DataFrame:
    """Totals of a layered day."""
    return kpi_totals(series)


def event_first_drill(
    hour: DataFrame, events: DataFrame, daily: DataFrame, day: date, tz: str, fallback: int = 23
) -> DataFrame:
    """A day per source, hour and model: a source's events, else its hours, else its day rows."""
    layers = _layers(hour, events, daily, day, tz, fallback)
    rank = F.when(F.col("layer") == 1, 0).when(F.col("layer") == 0, 1).otherwise(2)
    best = F.min("_rank").over(Window.partitionBy("source"))
    return layers.withColumn("_rank", rank).withColumn("_best", best).where(
        "_rank = _best").drop("layer", "_rank", "_best")


def day_summary(daily: DataFrame, day: date) -> DataFrame:
    """Sources, peak source and total of a day."""
    rows = daily.where(F.col("usage_date") == F.lit(day))
    per_source = rows.groupBy("source").agg(F.sum(TOTAL).alias("t"))
    first = F.struct((-F.col("t")).alias("t"), "source")
    return per_source.agg(
        F.count("*").alias("source_count"), F.min_by("source", first).alias("peak_source"),
        F.max("t").alias("peak_tokens"), F.sum("t").alias("day_total"),
    )


def day_drill(
    hour: DataFrame, events: DataFrame, daily: DataFrame, day: date, tz: str, fallback: int = 23,
    n: int = K.DRILL_MODELS,
) -> DataFrame:
    """Tokens per hour of a day and model in it, 0 where there are none; models beyond the day's top n
    together."""
    day_rows = daily.where(F.col("usage_date") == F.lit(day))
    groups = top_n_other(day_rows, n).select("model", "model_group").distinct()
    drill = event_first_drill(hour, events, daily, day, tz, fallback)
    grouped = drill.join(groups, "model", "left").select(
        "hour", F.coalesce("model_group", F.lit(K.OTHER_MODEL)).alias("model"), TOTAL
    )
    frame = grouped.select("model").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), "model", F.lit(0).cast("bigint").alias(TOTAL))
    return grouped.unionByName(frame).groupBy("hour", "model").agg(F.sum(TOTAL).alias(TOTAL)).orderBy("hour", "model")
