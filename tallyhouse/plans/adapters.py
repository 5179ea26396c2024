"""The given tables as usage facts, devices, prices and logs.

Usage from ``events`` covers one month, usage from ``lineitem`` seven years with repeated keys.
"""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.models import normalize_model
from tallyhouse.operators.carry import as_lines
from tallyhouse.operators.pricing import is_excluded, price_usage
from tallyhouse.operators.rollups import daily_rebuild, hour_rollup, measure_sums
from tallyhouse.functions.tokens import token_total
from tallyhouse.schemas import DAILY_KEYS, MEASURES, RATES, REQUESTS, TOTAL

AS_OF = date(2024, 1, 30)
LOCK_TIME = datetime(2024, 1, 30, 12, 0)
TZ = "+08:00"
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 30)

# Prices in USD per token.
PRICES = [
    ("claude-sonnet-4", 3e-6, 15e-6, 0.3e-6, 3.75e-6),
    ("openai/gpt-5", 1.25e-6, 10e-6, 0.125e-6, 0.0),
    ("gemini/gemini-2.5-pro", 1.25e-6, 10e-6, 0.31e-6, 0.0),
    ("deepseek/deepseek-chat", 0.27e-6, 1.1e-6, 0.07e-6, 0.0),
    ("github_copilot/gpt-5", 1e-6, 1e-6, 0.0, 0.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_prices(spark: SparkSession) -> DataFrame:
    schema = "model_key string, " + ", ".join(f"{r} double" for r in RATES)
    rows = spark.createDataFrame(PRICES, schema)
    return rows.where(~is_excluded(F.col("model_key"))).withColumn(
        "fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def _device(number: Column) -> Column:
    return F.concat(F.lit("dev-"), number.cast("string"))


def raw_model() -> Column:
    names = ["Claude-Sonnet-4-20250514 (high)", "claude-sonnet-4.5", "gpt-5", "gemini-2.5-pro",
             "deepseek-chat", "my-local-model"]
    return F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 6 + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events of ``events`` before model names are normalised."""
    return as_usage(table(spark, sf_dir, "events"))


def as_usage(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    units = F.floor(F.col("value") * 100).cast("bigint")
    kind = F.col("event_type")
    source = (
        F.when(kind == "view", "Claude Code").when(kind == "click", "Codex CLI")
        .when(kind == "purchase", "Gemini CLI").when(kind == "signup", "OpenCode")
        .otherwise("OpenClaw")
    )
    time = F.col("ts").cast("timestamp")
    user, day = F.col("user_id").cast("string"), F.to_date("ts")
    return events.select(
        _device(F.col("user_id") % 4).alias("device"), source.alias("source"),
        F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("event_key"),
        time.alias("event_time"), day.alias("usage_date"), raw_model().alias("raw_model"),
        F.concat_ws("-", F.lit("s"), user, day.cast("string")).alias("session_id"),
        F.concat(F.lit("proj-"), (F.col("user_id") % 10).cast("string")).alias("project_path"),
        units.alias("input_tokens"), (units % 997).alias("output_tokens"),
        (k % 7 * 50).alias("cache_creation_tokens"), (k * 120).alias("cache_read_tokens"),
        (k % 5 * 30).alias("reasoning_output_tokens"), "event_id", "user_id",
    )


def unpriced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpriced(table(spark, sf_dir, "events"))


def unpriced(events: DataFrame) -> DataFrame:
    return (
        as_usage(events).withColumn("model", normalize_model(F.col("raw_model")))
        .withColumn(TOTAL, token_total()).drop("raw_model", "event_id", "user_id")
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_usage(unpriced_events(spark, sf_dir), listed_prices(spark))


def hour_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_rollup(usage_events(spark, sf_dir))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_rebuild(hour_usage(spark, sf_dir), TZ)


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices for the models of ``lineitem``, derived from ``part``, under four kinds of key."""
    n = F.col("p_partkey") % 40
    model = F.concat(F.lit("model-"), n.cast("string"))
    key = (
        F.when(n % 4 == 0, F.concat(F.lit("vendor/"), model))
        .when(n % 4 == 1, F.concat(F.lit("openai/"), model))
        .when(n % 4 == 2, F.concat(F.lit("Model-"), n.cast("string"))).otherwise(model)
    )
    sizes = table(spark, sf_dir, "part").groupBy(key.alias("model_key")).agg(
        F.max("p_size").alias("hi"), F.min("p_size").alias("lo"))
    return sizes.select(
        "model_key", (F.col("hi") / 1e6).alias("input_rate"),
        (F.col("hi") * 2 / 1e6).alias("output_rate"), (F.col("lo") / 1e6).alias("cache_read_rate"),
        F.lit(0.0).alias("cache_write_rate"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def unpriced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events of ``lineitem``, whose event keys repeat; ``arrival`` columns order repeats."""
    def text(column: str) -> Column:
        return F.col(column).cast("string")

    def whole(value: Column) -> Column:
        return value.cast("bigint")

    day = F.to_date("l_shipdate")
    hour = (F.col("l_orderkey") % 24).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        _device(F.col("l_suppkey") % 8).alias("device"),
        F.concat(F.lit("src-"), "l_returnflag", "l_linestatus").alias("source"),
        F.concat_ws(":", text("l_orderkey"), text("l_linenumber")).alias("event_key"),
        F.timestamp_seconds(F.unix_date(day) * 86400 + hour * 3600).alias("event_time"),
        day.alias("usage_date"),
        F.concat(F.lit("model-"), (F.col("l_partkey") % 40).cast("string")).alias("model"),
        F.concat(F.lit("s-"), text("l_orderkey")).alias("session_id"),
        F.lit(None).cast("string").alias("project_path"),
        (whole(F.col("l_quantity")) * 100).alias("input_tokens"),
        whole(F.floor("l_extendedprice")).alias("output_tokens"),
        whole(F.floor(F.col("l_discount") * 1000)).alias("cache_creation_tokens"),
        whole(F.floor(F.col("l_tax") * 10000)).alias("cache_read_tokens"),
        (whole(F.col("l_linenumber")) * 10).alias("reasoning_output_tokens"),
        *ARRIVAL,
    ).withColumn(TOTAL, token_total())


ARRIVAL = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_usage(unpriced_orders(spark, sf_dir), order_prices(spark, sf_dir))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day rows of ``lineitem`` usage by its own dates."""
    return order_events(spark, sf_dir).groupBy(*DAILY_KEYS).agg(
        *measure_sums(MEASURES), F.count("*").alias(REQUESTS))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices dev-N from ``supplier``; every third has no display name of its own."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _device(n).alias("device_id"), F.col("s_name").alias("hostname"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("Box "), n.cast("string")))
        .alias("display_name"), (n == 0).alias("is_local"),
    )


def log_lines(rows: DataFrame, path: Column, *records: Column, width: int = 8) -> DataFrame:
    """Line frame with up to ``width`` JSON records per event, in event order; NULLs are left out."""
    numbered = rows.select(path.alias("path"), "event_id",
                           F.posexplode(F.array(*records)).alias("n", "line")).where("line IS NOT NULL")
    return as_lines(numbered, F.col("path"), F.col("event_id") * width + F.col("n"), F.col("line"))


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
