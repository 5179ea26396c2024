"""Gemini CLI: JSON lines, session documents and headless statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import empty_to_null, event_key, file_stem
from tallyhouse.functions.times import to_utc_ts
from tallyhouse.functions.tokens import normalize_gemini_cache, pos_int
from tallyhouse.operators.carry import carry_forward, line_order
from tallyhouse.schemas import CACHE_READ, INPUT, OUTPUT, REASONING
from tallyhouse.session import cut_lineage
from tallyhouse.sources.events import as_events, parsed_json

_TOKENS = """struct<input: string, output: string, cached: string, thoughts: string,
    tool: string, total: string>"""
_STATS = f"""struct<models: map<string, struct<tokens: {_TOKENS}>>, input_tokens: string,
    output_tokens: string, cached_tokens: string>"""
_LINE = f"""type string, model string, session_id string, timestamp string, id string,
    tokens {_TOKENS}, stats {_STATS}, result struct<stats: {_STATS}>"""
_DOCUMENT = f"""sessionId string, messages array<struct<type: string, model: string,
    timestamp: string, tokens: {_TOKENS}>>, stats {_STATS}"""


def message_usage(tokens: Column) -> Column:
    """Counters of a message; tool tokens count as input."""
    given, output, tool = pos_int(tokens.input), pos_int(tokens.output), pos_int(tokens.tool)
    thoughts = pos_int(tokens.thoughts)
    net, cached = normalize_gemini_cache(
        given, pos_int(tokens.cached), output, thoughts, tool, pos_int(tokens.total)
    )
    return F.struct(
        (net + tool).alias(INPUT), output.alias(OUTPUT), cached.alias(CACHE_READ),
        thoughts.alias(REASONING),
    )


def _stat_entry(model: Column, given, output, cached, thoughts) -> Column:
    zero = F.lit(0).cast("bigint")
    net, read = normalize_gemini_cache(given, cached, output, thoughts, zero, zero)
    usage = F.struct(
        net.alias(INPUT), output.alias(OUTPUT), read.alias(CACHE_READ), thoughts.alias(REASONING)
    )
    used = F.greatest(given, output, cached, thoughts) > 0
    return F.struct(model.alias("model"), usage.alias("usage"), used.alias("used"))


def stats_usage(stats: Column, model_hint: Column) -> Column:
    """Array of (model, usage): the models with usage, or the flat totals when there is none."""
    per_model = F.transform(
        F.map_entries(stats.models),
        lambda e: _stat_entry(
            e.key, pos_int(e.value.tokens.input), pos_int(e.value.tokens.output),
            pos_int(e.value.tokens.cached), pos_int(e.value.tokens.thoughts),
        ),
    )
    used = F.filter(per_model, lambda e: e.used)
    flat = F.array(_stat_entry(
        model_hint, pos_int(stats.input_tokens), pos_int(stats.output_tokens),
        pos_int(stats.cached_tokens), F.lit(0).cast("bigint"),
    ))
    return F.when(F.size(used) > 0, used).otherwise(F.filter(flat, lambda e: e.used))


def ffill_session_model(lines: DataFrame) -> DataFrame:
    """Parsed lines with the session and model in force; a file's session defaults to its name.

    The parsed lines are stored, so that the logs are parsed once.
    """
    named = parsed_json(lines, _LINE).withColumns(
        {"line_session": empty_to_null(F.col("j.session_id")),
         "line_model": empty_to_null(F.col("j.model"))}
    ).where(F.col("j.type").isNotNull() | F.col("line_session").isNotNull()
            | F.col("line_model").isNotNull() | F.col("j.stats").isNotNull()
            | F.col("j.result").isNotNull())
    carried = carry_forward(cut_lineage(named), {"session": "line_session", "model": "line_model"})
    return carried.withColumns({
        "session": F.coalesce("session", file_stem(F.col("path"), r"\.jsonl")),
        "model": F.coalesce("model", F.lit("")),
    })


def replace_by_id(messages: DataFrame) -> DataFrame:
    """The last record of every message id of a file, and every record without id."""
    named = empty_to_null(F.col("id"))
    kept = [c for c in messages.columns if c not in ("path", "id", "block", "chunk", "pos")]
    return (
        messages.groupBy(
            "path", named.alias("id"), F.when(named.isNull(), line_order()).alias("_line")
        )
        .agg(F.max_by(F.struct(*kept), line_order()).alias("_last"))
        .select("path", "id", "_last.*")
    )


def parse_gemini_jsonl(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Events of JSON lines: messages with tokens, and the models of statistics records."""
    j = F.col("j")
    current = ffill_session_model(lines).where(F.coalesce(j.type, F.lit("")) != "init")
    is_message = F.coalesce((j.type == "gemini") & j.tokens.isNotNull(), F.lit(False))
    message = F.array(F.struct(
        F.col("model"), message_usage(j.tokens).alias("usage"), F.lit(True).alias("used")))
    stats = stats_usage(F.coalesce(j.stats, j.result.stats), F.col("model"))
    reported = current.select(
        "path", "block", "chunk", "pos", F.when(is_message, j.id).alias("id"), "session",
        F.when(is_message, j.timestamp).alias("timestamp"), j.timestamp.alias("date_text"),
        F.when(is_message, message).otherwise(stats).alias("entries"),
    ).where(F.size("entries") > 0)
    latest = replace_by_id(reported).select("session", "timestamp", "date_text", "entries")
    return _events(latest.select(F.inline(F.transform("entries", lambda e: F.struct(
        F.col("session"), F.col("timestamp"), F.col("date_text"), e.model.alias("model"),
        e.usage.alias("usage"))))), tz)


def parse_gemini_session(docs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Events of session documents: one per answer with a model and tokens."""
    m = F.col("m")
    messages = (
        parsed_json(docs, _DOCUMENT).where("j.sessionId != ''")
        .select(F.col("j.sessionId").alias("session"), F.explode("j.messages").alias("m"))
        .where((m.type == "gemini") & (m.model != "") & m.tokens.isNotNull())
        .select("session", m.model.alias("model"), m.timestamp.alias("timestamp"),
                m.timestamp.alias("date_text"), message_usage(m.tokens).alias("usage"))
    )
    return _events(messages, tz)


def parse_gemini_stats(docs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Events of headless statistics documents, which state no time."""
    j, nothing = F.col("j"), F.lit(None).cast("string")
    reports = (
        parsed_json(docs, _DOCUMENT)
        .where((F.coalesce(j.sessionId, F.lit("")) == "") & j.stats.isNotNull())
        .select(file_stem(F.col("path"), r"\.json").alias("session"),
                F.inline(stats_usage(j.stats, F.lit(""))))
        .select("session", "model", nothing.alias("timestamp"), nothing.alias("date_text"),
                "usage")
    )
    return _events(reports, tz)


def _events(records: DataFrame, tz: str) -> DataFrame:
    usage = F.col("usage")
    key = event_key(F.col("session"), F.col("timestamp"), usage[INPUT] + usage[OUTPUT])
    return as_events(
        records, K.GEMINI_CLI, key, to_utc_ts(F.col("timestamp"), tz), F.col("model"),
        {c: usage[c] for c in (INPUT, OUTPUT, CACHE_READ, REASONING)},
        F.col("session"), F.col("session"), F.to_date(to_utc_ts(F.col("date_text"), tz)),
    )
