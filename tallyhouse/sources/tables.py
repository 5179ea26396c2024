"""Usage rows kept in other tools' tables; cursors make the reads incremental."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import source_from_app_type
from tallyhouse.functions.models import normalize_model
from tallyhouse.functions.times import normalize_date
from tallyhouse.functions.tokens import split_cached, token_total
from tallyhouse.schemas import (
    CACHE_READ, CACHE_WRITE, INPUT, OUTPUT, PROXY_ROLLUP, REASONING, TOKENS, TOTAL,
)
from tallyhouse.sources.events import as_events

_MESSAGE = """modelID string, tokens struct<input: bigint, output: bigint, reasoning: bigint,
    cache: struct<read: bigint, write: bigint>>"""


def read_opencode_messages(messages: DataFrame, cursor: int = 0) -> DataFrame:
    """Events of messages created at or after the cursor (ms); replays are absorbed by the key."""
    j, zero = F.col("j"), F.lit(0)
    rows = (
        messages.where((F.col("time_created") >= cursor)
                       & F.get_json_object("data", "$.tokens").isNotNull()
                       & F.get_json_object("data", "$.modelID").isNotNull())
        .withColumn("j", F.from_json("data", _MESSAGE))
        .where((F.coalesce(j.tokens.input, zero) != 0) | (F.coalesce(j.tokens.output, zero) != 0))
    )
    parts = {
        INPUT: j.tokens.input, OUTPUT: j.tokens.output, CACHE_READ: j.tokens.cache.read,
        CACHE_WRITE: j.tokens.cache.write, REASONING: j.tokens.reasoning,
    }
    time = F.date_trunc("second", F.timestamp_millis("time_created"))
    return as_events(
        rows, K.OPENCODE, F.col("id"), time, j.modelID,
        {c: F.coalesce(v, zero) for c, v in parts.items()}, F.col("session_id"),
    )


def next_cursor(column: str, cursor: int = 0) -> Column:
    """Aggregate expression: the cursor after the rows it is applied to."""
    return F.greatest(F.coalesce(F.max(column), F.lit(cursor)), F.lit(cursor)).alias("cursor")


def read_hermes_daily(rows: DataFrame) -> DataFrame:
    """Daily rows per date and model; the cached part is taken out of the input."""
    net, cached = split_cached(F.col("input_tokens"), F.col("cached_tokens"))
    zero = F.lit(0).cast("bigint")
    parts = {INPUT: net, OUTPUT: F.col("output_tokens"), CACHE_WRITE: zero, CACHE_READ: cached,
             REASONING: zero}
    return rows.select(
        F.lit(K.HERMES_AGENT).alias("source"), normalize_date(F.col("date")).alias("usage_date"),
        normalize_model(F.col("model")).alias("model"), *[v.alias(c) for c, v in parts.items()],
    ).withColumn(TOTAL, token_total())


def read_ccswitch_requests(requests: DataFrame, cursor: int = 0) -> DataFrame:
    """Successful proxied requests after the cursor (s). A cursor beyond the newest row is stale
    and ignored."""
    newest = requests.agg(F.max("created_at")).scalar()
    good = (F.col("data_source") == "proxy") & F.col("status_code").between(200, 299)
    rows = requests.where(good)
    if cursor > 0:
        rows = rows.where((F.col("created_at") > cursor) | (newest < cursor))
    return rows


def read_ccswitch_rollups(rollups: DataFrame | None, cursor: str | None = None, spark=None):
    """Day rollups after the cursor date, however their dates are written; with a cursor, rows without a
    readable date are left out. An absent table reads as empty."""
    if rollups is None:
        return spark.createDataFrame([], PROXY_ROLLUP)
    return rollups.where(normalize_date(F.col("date")) > F.lit(cursor).cast("date")) if cursor else rollups


def attributed(rows: DataFrame) -> DataFrame:
    """Proxy rows under the source and model they belong to."""
    return rows.withColumns({
        "source": source_from_app_type(F.col("app_type")),
        "model": normalize_model(F.col("model")),
        REASONING: F.lit(0).cast("bigint"),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in TOKENS if c != REASONING},
    }).withColumn(TOTAL, token_total())
