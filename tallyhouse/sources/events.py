"""Common shape of the events that log parsers emit."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.identity import empty_to_null
from tallyhouse.functions.models import normalize_model
from tallyhouse.functions.tokens import has_usage, token_total
from tallyhouse.schemas import TOKENS, TOTAL

EVENT_COLUMNS = [
    "source", "event_key", "event_time", "usage_date", "model", "project_path", "session_id",
    *TOKENS, TOTAL,
]


def may_name(*words: str) -> Column:
    """Whether a line of JSON can hold one of the words in a string. Words are of letters, digits and "_", so JSON writes them as
    they are or by \\u escapes; all other lines need no parsing."""
    return reduce(Column.__or__, [F.col("value").contains(w) for w in [*words, "\\u"]])


def parsed_json(lines: DataFrame, schema: str) -> DataFrame:
    """Line frame with the parsed line in ``j``; text that is not an object parses to NULLs.

    The generator keeps later filters on ``j`` behind the parser, so each line is parsed once
    and not again for every filter.
    """
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.explode(F.array(F.from_json("value", schema))).alias("j"))


def as_events(
    df: DataFrame, source: str, key: Column, time: Column, model: Column, tokens: dict[str, Column],
    session: Column | None = None, project: Column | None = None, date: Column | None = None,
    *extra: Column,
) -> DataFrame:
    """Usage events without cost; rows whose counters are all zero are dropped."""
    nothing = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    return df.select(
        F.lit(source).alias("source"), key.alias("event_key"), time.alias("event_time"),
        (F.to_date(time) if date is None else date).alias("usage_date"),
        normalize_model(model).alias("model"),
        (nothing if project is None else empty_to_null(project)).alias("project_path"),
        (nothing if session is None else empty_to_null(session)).alias("session_id"),
        *[tokens.get(c, zero).alias(c) for c in TOKENS],
        *extra,
    ).withColumn(TOTAL, token_total()).where(has_usage())
