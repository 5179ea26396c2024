"""Canonical column names and schemas of the usage tables and their inputs."""

from pyspark.sql import types as T

INPUT = "input_tokens"
OUTPUT = "output_tokens"
CACHE_WRITE = "cache_creation_tokens"
CACHE_READ = "cache_read_tokens"
REASONING = "reasoning_output_tokens"
TOKENS = [INPUT, OUTPUT, CACHE_WRITE, CACHE_READ, REASONING]
TOTAL = "total_tokens"
COST = "cost_usd"
REQUESTS = "request_count"
MEASURES = [*TOKENS, TOTAL, COST]
RATES = ["input_rate", "output_rate", "cache_read_rate", "cache_write_rate"]

EVENT_KEYS = ["device", "source", "event_key"]
HOUR_KEYS = ["device", "source", "usage_date", "hour", "model"]
DAILY_KEYS = ["device", "source", "usage_date", "model"]
SESSION_KEYS = ["device", "source", "session_id"]

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_MEASURES = {**dict.fromkeys([*TOKENS, TOTAL], _L), COST: _D}

USAGE_EVENT = _struct(
    device=_S, source=_S, event_key=_S, event_time=_TS, usage_date=_DATE, model=_S,
    project_path=_S, session_id=_S, **_MEASURES,
)
HOUR_USAGE = _struct(
    device=_S, source=_S, usage_date=_DATE, hour=_I, model=_S, **_MEASURES, request_count=_L
)
DAILY_USAGE = _struct(
    device=_S, source=_S, usage_date=_DATE, model=_S, **_MEASURES, request_count=_L,
    pricing_locked_at=_TS,
)
SESSION_USAGE = _struct(
    device=_S, source=_S, session_id=_S, last_activity=_TS, project_path=_S, model=_S, **_MEASURES
)
SESSION_PART = _struct(
    device=_S, source=_S, session_id=_S, usage_date=_DATE, model=_S, project_path=_S, **_MEASURES,
    last_activity=_TS, first_activity=_TS,
)
MODEL_PRICING = _struct(model_key=_S, **dict.fromkeys(RATES, _D), fetched_at=_TS)
DEVICES = _struct(device_id=_S, hostname=_S, display_name=_S, is_local=_B)
MANIFEST = _struct(source=_S, file_path=_S, fingerprint=_S, last_offset=_L, updated_at=_TS)

PENDING = _struct(device=_S, source=_S, usage_date=_DATE)

OPENCODE_MESSAGE = _struct(id=_S, session_id=_S, time_created=_L, data=_S)
HERMES_DAILY = _struct(date=_S, model=_S, input_tokens=_L, output_tokens=_L, cached_tokens=_L)
PROXY_REQUEST = _struct(
    created_at=_L, app_type=_S, model=_S, data_source=_S, status_code=_I, input_tokens=_L,
    output_tokens=_L, cache_read_tokens=_L, cache_creation_tokens=_L, total_cost_usd=_S,
)
PROXY_ROLLUP = _struct(
    date=_S, app_type=_S, model=_S, input_tokens=_L, output_tokens=_L, cache_read_tokens=_L,
    cache_creation_tokens=_L, total_cost_usd=_S,
)

# Names inside the export bundle, which is camel case JSON.
_BUNDLE_NAMES = {
    "usage_date": "usageDate", "session_id": "sessionId", "last_activity": "lastActivity",
    "project_path": "projectPath", INPUT: "inputTokens", OUTPUT: "outputTokens",
    CACHE_WRITE: "cacheCreationTokens", CACHE_READ: "cacheReadTokens",
    REASONING: "reasoningOutputTokens", TOTAL: "totalTokens", COST: "costUSD",
    REQUESTS: "requestCount",
}


def bundle_name(column: str) -> str:
    return _BUNDLE_NAMES.get(column, column)


def _bundle_row(schema: T.StructType, *skip: str) -> T.StructType:
    text = (T.DateType, T.TimestampType)
    return T.StructType([
        T.StructField(bundle_name(f.name), _S if isinstance(f.dataType, text) else f.dataType)
        for f in schema if f.name not in skip
    ])


BUNDLE = _struct(
    format=_S, version=_L, exportedAt=_S, deviceNames=T.MapType(_S, _S),
    hourUsage=T.ArrayType(_bundle_row(HOUR_USAGE)),
    dailyUsage=T.ArrayType(_bundle_row(DAILY_USAGE, "pricing_locked_at")),
    sessionUsage=T.ArrayType(_bundle_row(SESSION_USAGE)),
)
