"""SQL building blocks of the comparison queries, over the given tables."""

TOKENS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
          "reasoning_output_tokens"]

# The rates each normalised model resolves to.
_RATES = """rates(model, price_key, input_rate, output_rate, cache_read_rate, cache_write_rate) AS (VALUES
 ('claude-sonnet-4', 'claude-sonnet-4', 3e-6, 15e-6, 0.3e-6, 3.75e-6),
 ('claude-sonnet-4-5', 'claude-sonnet-4', 3e-6, 15e-6, 0.3e-6, 3.75e-6),
 ('gpt-5', 'openai/gpt-5', 1.25e-6, 10e-6, 0.125e-6, 0.0),
 ('gemini-2.5-pro', 'gemini/gemini-2.5-pro', 1.25e-6, 10e-6, 0.31e-6, 0.0),
 ('deepseek-chat', 'deepseek/deepseek-chat', 0.27e-6, 1.1e-6, 0.07e-6, 0.0))"""

COST = """coalesce(input_tokens * input_rate + (output_tokens + reasoning_output_tokens) * output_rate
 + cache_read_tokens * cache_read_rate + cache_creation_tokens * cache_write_rate, 0)"""

_EV = """ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k,
 floor(value * 100)::BIGINT AS v FROM events),
ue0 AS (SELECT event_id, user_id, 'dev-' || (user_id % 4) AS device,
 CASE event_type WHEN 'view' THEN 'Claude Code' WHEN 'click' THEN 'Codex CLI'
  WHEN 'purchase' THEN 'Gemini CLI' WHEN 'signup' THEN 'OpenCode' ELSE 'OpenClaw' END AS source,
 'ev:' || event_id AS event_key, ts AS event_time, ts::DATE AS usage_date, hour(ts)::BIGINT AS hour,
 CASE user_id % 6 WHEN 0 THEN 'claude-sonnet-4' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'gpt-5'
  WHEN 3 THEN 'gemini-2.5-pro' WHEN 4 THEN 'deepseek-chat' ELSE 'my-local-model' END AS model,
 's-' || user_id || '-' || ts::DATE::VARCHAR AS session_id, 'proj-' || (user_id % 10) AS project_path,
 v AS input_tokens, v % 997 AS output_tokens, k % 7 * 50 AS cache_creation_tokens,
 k * 120 AS cache_read_tokens, k % 5 * 30 AS reasoning_output_tokens,
 v + v % 997 + k % 7 * 50 + k * 120 AS total_tokens FROM ev)"""


def sums(alias: str = "", columns=(*TOKENS, "total_tokens")) -> str:
    return ", ".join(f"sum({alias}{c})::BIGINT AS {c}" for c in columns)


SUMS = sums() + ", sum(cost_usd) AS cost_usd"
SUMS_N = SUMS + ", sum(request_count)::BIGINT AS request_count"
COLS = ", ".join([*TOKENS, "total_tokens"])
OUT = COLS + ", round(cost_usd, 9) AS cost_usd"
OUT_N = OUT + ", request_count"

EVENTS = f"""WITH {_RATES},
{_EV},
ue AS (SELECT ue0.*, {COST} AS cost_usd FROM ue0 LEFT JOIN rates USING (model))"""

HOURS = f"""{EVENTS},
hu AS (SELECT device, source, usage_date, hour, model, {SUMS}, count(*) AS request_count
 FROM ue GROUP BY ALL)"""

DAYS = f"""{HOURS},
hl AS (SELECT * REPLACE ((usage_date + to_hours(hour + 8))::DATE AS usage_date,
 (hour + 8) % 24 AS hour) FROM hu),
du AS (SELECT device, source, usage_date, model, {SUMS_N} FROM hl GROUP BY ALL)"""

_ORDER_PRICES = """op AS (SELECT p_partkey % 40 AS n, CASE p_partkey % 4
  WHEN 0 THEN 'vendor/model-' || (p_partkey % 40) WHEN 1 THEN 'openai/model-' || (p_partkey % 40)
  WHEN 2 THEN 'Model-' || (p_partkey % 40) ELSE 'model-' || (p_partkey % 40) END AS model_key,
 max(p_size) / 1e6 AS input_rate, max(p_size) * 2 / 1e6 AS output_rate,
 min(p_size) / 1e6 AS cache_read_rate, 0.0::DOUBLE AS cache_write_rate FROM part GROUP BY ALL)"""

_ORDERS = """ub0 AS (SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens
  AS total_tokens FROM (SELECT 'dev-' || (l_suppkey % 8) AS device,
  'src-' || l_returnflag || l_linestatus AS source, l_orderkey || ':' || l_linenumber AS event_key,
  l_shipdate::DATE AS usage_date, (l_orderkey % 24)::BIGINT AS hour, l_partkey % 40 AS n,
  'model-' || (l_partkey % 40) AS model, 's-' || l_orderkey AS session_id,
  l_quantity::BIGINT * 100 AS input_tokens, floor(l_extendedprice)::BIGINT AS output_tokens,
  floor(l_discount * 1000)::BIGINT AS cache_creation_tokens,
  floor(l_tax * 10000)::BIGINT AS cache_read_tokens, l_linenumber::BIGINT * 10
  AS reasoning_output_tokens, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice
 FROM lineitem))"""

ORDERS = f"""WITH {_ORDER_PRICES},
{_ORDERS},
ub AS (SELECT ub0.*, {COST} AS cost_usd FROM ub0 LEFT JOIN op USING (n))"""

ORDER_DAYS = f"""{ORDERS},
bd AS (SELECT device, source, usage_date, model, {SUMS}, count(*) AS request_count
 FROM ub GROUP BY ALL)"""


def text_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
