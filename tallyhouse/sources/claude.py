"""Claude Code logs: one JSON object per line, a message may be logged several times."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import (
    empty_to_null, event_key, file_stem, workspace_key, workspace_label,
)
from tallyhouse.functions.models import normalize_model
from tallyhouse.functions.times import to_utc_ts
from tallyhouse.functions.tokens import pos_int
from tallyhouse.operators.carry import line_order
from tallyhouse.operators.merge import key_hash
from tallyhouse.schemas import CACHE_READ, CACHE_WRITE, INPUT, OUTPUT, REASONING, TOKENS
from tallyhouse.sources.events import as_events, may_name, parsed_json

_LINE = """
    type string, model string, timestamp string, costUSD double, requestId string,
    message struct<id: string, model: string, usage: struct<
        input_tokens: string, output_tokens: string, cache_read_input_tokens: string,
        cache_creation_input_tokens: string, reasoning_tokens: string, thinking_tokens: string>>
"""


def claude_records(lines: DataFrame) -> DataFrame:
    """Assistant lines that report usage, before repeats are merged."""
    j, usage = F.col("j"), F.col("j.message.usage")
    model = F.coalesce(
        empty_to_null(j.message.model), empty_to_null(j.model), F.lit("unknown")
    )
    identified = F.when(
        j.requestId != "", F.concat(j.message.id, F.lit(":"), j.requestId)
    ).otherwise(F.concat(F.lit("message:"), j.message.id))
    return (
        parsed_json(lines.where(may_name("assistant")), _LINE)
        .where((j.type == "assistant") & usage.isNotNull() & ~model.contains("synthetic"))
        .select(
            "path", "block", "chunk", "pos", j.timestamp.alias("timestamp"), model.alias("model"),
            F.when(j.message.id != "", identified).alias("message_key"),
            pos_int(usage.input_tokens).alias(INPUT),
            pos_int(usage.output_tokens).alias(OUTPUT),
            pos_int(usage.cache_creation_input_tokens).alias(CACHE_WRITE),
            pos_int(usage.cache_read_input_tokens).alias(CACHE_READ),
            F.greatest(
                pos_int(usage.reasoning_tokens), pos_int(usage.thinking_tokens)
            ).alias(REASONING),
            F.greatest(F.coalesce(j.costUSD, F.lit(0.0)), F.lit(0.0)).alias("logged_cost_usd"),
        )
    )


def dedup_merge_messages(records: DataFrame) -> DataFrame:
    """One record per message and file: the highest counters, the first timestamp and model.

    Records without a message id stay as they are. A message repeated very often is combined
    before the shuffle.
    """
    unnamed = F.when(F.col("message_key").isNull(), line_order())
    counters = [*TOKENS, "logged_cost_usd"]
    return (
        records.groupBy(key_hash(["path", "message_key"]), "path", "message_key", unnamed.alias("_line"))
        .agg(
            F.min_by(F.struct("timestamp", "model"), line_order()).alias("_first"),
            *[F.max(c).alias(c) for c in counters],
        )
        .select("path", "_first.timestamp", "_first.model", "message_key", *counters)
    )


def parse_claude_log(lines: DataFrame, root: str = "", tz: str = "UTC") -> DataFrame:
    """Events of Claude Code lines; lines without a readable timestamp are left out."""
    merged = dedup_merge_messages(claude_records(lines))
    time = to_utc_ts(F.col("timestamp"), tz)
    key = event_key(
        F.col("path"), F.col("timestamp"), normalize_model(F.col("model")),
        F.col(INPUT) + F.col(OUTPUT),
    )
    return as_events(
        merged, K.CLAUDE_CODE, key, time, F.col("model"), {c: F.col(c) for c in TOKENS},
        file_stem(F.col("path"), r"\.jsonl"), workspace_label(workspace_key(F.col("path"), root)),
        None, F.col("logged_cost_usd"),
    ).where(F.col("event_time").isNotNull())
