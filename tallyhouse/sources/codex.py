"""Codex CLI logs: the model and cumulative totals are state along the file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import empty_to_null, event_key, file_stem
from tallyhouse.functions.times import to_utc_ts
from tallyhouse.functions.tokens import split_cached
from tallyhouse.operators.carry import carry_forward
from tallyhouse.schemas import CACHE_READ, INPUT, OUTPUT, REASONING
from tallyhouse.session import cut_lineage
from tallyhouse.sources.events import as_events, may_name, parsed_json

_PARTS = ["input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens"]
USAGE = "struct<" + ", ".join(f"{p}: bigint" for p in _PARTS) + ">"
_LINE = f"""
    type string, timestamp string, payload struct<
        type: string, cwd: string, model: string, model_info: struct<slug: string>,
        info: struct<last_token_usage: {USAGE}, total_token_usage: {USAGE}>>
"""


def _usage(reported: Column) -> Column:
    parts = [F.coalesce(reported[p], F.lit(0)).alias(p) for p in _PARTS]
    return F.when(reported.isNotNull(), F.struct(*parts))


def codex_states(lines: DataFrame) -> DataFrame:
    """Lines that set or use state, with what each of them sets."""
    j = F.col("j")
    counts = (j.type == "event_msg") & (j.payload.type == "token_count")
    model = F.coalesce(empty_to_null(j.payload.model), empty_to_null(j.payload.model_info.slug))
    return (
        parsed_json(lines.where(may_name("token_count", "turn_context", "session_meta")), _LINE)
        .where(counts | j.type.isin("turn_context", "session_meta"))
        .select(
            "path", "block", "chunk", "pos", counts.alias("counts"),
            j.timestamp.alias("timestamp"),
            F.when(j.type == "turn_context", model).alias("line_model"),
            F.when(j.type == "session_meta", empty_to_null(j.payload.cwd)).alias("line_cwd"),
            F.when(counts, _usage(j.payload.info.last_token_usage)).alias("last_usage"),
            F.when(counts, _usage(j.payload.info.total_token_usage)).alias("total_usage"),
        )
    )


UPTO = {"model": "line_model", "cwd": "line_cwd"}
BEFORE = {"previous_total": "total_usage"}


def ffill_model(states: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """States with the current model, working folder and previous total of their file."""
    return carry_forward(states, UPTO, BEFORE, initial)


def cumulative_delta(states: DataFrame) -> DataFrame:
    """Usage of each token count: the stated last usage, else the growth of the total.

    A repeated total counts nothing, a shrinking one is a reset and counts nothing either, the
    first total of a file counts whole.
    """
    last, total, previous = F.col("last_usage"), F.col("total_usage"), F.col("previous_total")
    growth = F.struct(*[(total[p] - previous[p]).alias(p) for p in _PARTS])
    shrinks = F.least(*[growth[p] for p in _PARTS]) < 0
    unchanged = F.coalesce(total == previous, F.lit(False))
    increase = (
        F.when(unchanged, None)
        .when(last.isNotNull(), last)
        .when(previous.isNull(), total)
        .when(~shrinks, growth)
    )
    used = F.greatest(*[F.abs(F.col("increase")[p]) for p in _PARTS]) > 0
    return states.where("counts").withColumn("increase", increase).where(used)


def parse_codex_log(
    lines: DataFrame, tz: str = "UTC", initial: DataFrame | None = None
) -> DataFrame:
    """Events of Codex lines. The state lines are stored, so that the logs are parsed once."""
    states = cut_lineage(codex_states(lines))
    return codex_events(cumulative_delta(ffill_model(states, initial)), tz)


def codex_events(deltas: DataFrame, tz: str = "UTC") -> DataFrame:
    step, session = F.col("increase"), file_stem(F.col("path"), r"\.jsonl")
    net, cached = split_cached(step.input_tokens, step.cached_input_tokens)
    key = event_key(F.col("path"), F.col("timestamp"), net + step.output_tokens, sep="::")
    tokens = {
        INPUT: net, OUTPUT: step.output_tokens, CACHE_READ: cached,
        REASONING: step.reasoning_output_tokens,
    }
    return as_events(
        deltas, K.CODEX_CLI, key, to_utc_ts(F.col("timestamp"), tz), F.col("model"), tokens,
        session, F.coalesce(F.col("cwd"), session),
    )
