"""Token counters, totals, rates and report ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.schemas import CACHE_READ, CACHE_WRITE, INPUT, OUTPUT, REASONING, TOKENS


def pos_int(value: Column) -> Column:
    """Non-negative counter from an integer, decimal or quoted JSON number."""
    text = value.cast("string")
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)).cast("bigint")


def token_total() -> Column:
    """Reasoning is part of the output count and is not added again."""
    return F.col(INPUT) + F.col(OUTPUT) + F.col(CACHE_WRITE) + F.col(CACHE_READ)


def has_usage() -> Column:
    return F.greatest(*[F.abs(F.col(c)) for c in TOKENS]) > 0


def split_cached(input_tokens: Column, cached: Column) -> tuple[Column, Column]:
    """(input without its cached part, cached part), where cached is at most the input."""
    part = F.least(cached, input_tokens)
    return input_tokens - part, part


def normalize_gemini_cache(
    input_tokens: Column, cached: Column, output: Column, reasoning: Column, tool: Column,
    total: Column,
) -> tuple[Column, Column]:
    """(net input, cache read): the stated total tells whether input includes the cached part."""
    zero = F.lit(0).cast("bigint")
    given, cached = F.greatest(input_tokens, zero), F.greatest(cached, zero)
    inclusive = given + output + reasoning + tool
    inside = (total == 0) | ((cached > 0) & (total == inclusive))
    return F.when(inside, given - F.least(cached, given)).otherwise(given), cached


def valid_rate(rate: Column) -> Column:
    usable = (rate >= 0) & ~F.isnan(rate) & (rate != float("inf"))
    return F.when(usable, rate).otherwise(F.lit(0.0))


def usage_cost() -> Column:
    """USD of a row joined to its rates; a row without rates costs nothing."""
    def used(column: str) -> Column:
        return F.greatest(F.col(column), F.lit(0)).cast("double")

    cost = (
        used(INPUT) * valid_rate(F.col("input_rate"))
        + (used(OUTPUT) + used(REASONING)) * valid_rate(F.col("output_rate"))
        + used(CACHE_READ) * valid_rate(F.col("cache_read_rate"))
        + used(CACHE_WRITE) * valid_rate(F.col("cache_write_rate"))
    )
    return F.coalesce(cost, F.lit(0.0))


def delta_pct(current: Column, previous: Column) -> Column:
    change = (current - previous) / F.nullif(previous.cast("double"), F.lit(0.0)) * 100
    return F.when(previous != 0, change)


def cache_hit_rate(cache_read: Column, total: Column) -> Column:
    share = cache_read / F.nullif(total.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(F.when(total != 0, share), F.lit(0.0))


def heat_level(total: Column) -> Column:
    level = F.lit(len(K.HEAT_LIMITS) + 1)
    for number, limit in reversed(list(enumerate(K.HEAT_LIMITS, start=1))):
        level = F.when(total <= limit, number).otherwise(level)
    return F.when(total.isNull(), None).when(total == 0, 0).otherwise(level)


def rate_per_million(rate: Column) -> Column:
    return rate * 1e6


def rate_per_token(rate: Column) -> Column:
    return rate / 1e6
