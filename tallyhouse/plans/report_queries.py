"""Named queries: filters, roll-ups, rankings, series and day views."""

from datetime import date

from pyspark.sql import functions as F

from tallyhouse.functions.times import default_granularity
from tallyhouse.operators import filters as flt
from tallyhouse.operators import ranking as rnk
from tallyhouse.operators import rollups as rol
from tallyhouse.operators import series as ser
from tallyhouse.plans import adapters as a
from tallyhouse.plans.oracle import (
    COLS, DAYS, EVENTS, HOURS, ORDER_DAYS, ORDERS, OUT, OUT_N, SUMS, TOKENS, sums, text_time,
)
from tallyhouse.plans.registry import query, shown
from tallyhouse.schemas import DAILY_KEYS, HOUR_KEYS, MEASURES, REQUESTS, SESSION_KEYS, TOTAL

DAY_COLUMNS = [*DAILY_KEYS, *MEASURES, REQUESTS]
HOUR_COLUMNS = [*HOUR_KEYS, *MEASURES, REQUESTS]
_DAY_OUT = f"device, source, usage_date::VARCHAR AS usage_date, model, {OUT_N}"
_HOUR_OUT = f"device, source, usage_date::VARCHAR AS usage_date, hour, model, {OUT_N}"
_EVENT_OUT = f"device, source, event_key, {text_time('event_time')} AS event_time, model, {OUT}"
EVENT_COLUMNS = ["device", "source", "event_key", "event_time", "model", *MEASURES]


# Projections, filters, ranges

@query("with_total_tokens", f"{EVENTS} SELECT event_key, {COLS} FROM ue")
def with_total_tokens(spark, sf):
    rows = flt.with_total_tokens(a.unpriced_events(spark, sf).drop(TOTAL))
    return shown(rows, "event_key", *TOKENS, TOTAL)


@query("repair_totals", f"""{ORDERS} SELECT event_key, l_partkey, l_suppkey, l_quantity,
 CASE WHEN reasoning_output_tokens > 0 THEN total_tokens ELSE total_tokens + 1 END AS total_tokens
 FROM ub""")
def repair_totals(spark, sf):
    off = a.unpriced_orders(spark, sf).withColumn(
        TOTAL, F.col(TOTAL) + F.when(F.col("reasoning_output_tokens") > 0,
                                     F.col("reasoning_output_tokens")).otherwise(1))
    return shown(flt.repair_totals(off), "event_key", "l_partkey", "l_suppkey", "l_quantity", TOTAL)


@query("drop_zero_usage", f"""{EVENTS} SELECT source, count(*) AS events, {sums()} FROM ue
 WHERE input_tokens <> 0 OR output_tokens <> 0 OR cache_creation_tokens <> 0
 OR cache_read_tokens <> 0 OR reasoning_output_tokens <> 0 GROUP BY source""")
def drop_zero_usage(spark, sf):
    kept = flt.drop_zero_usage(a.unpriced_events(spark, sf)).groupBy("source")
    return shown(kept.agg(F.count("*").alias("events"), *[F.sum(c).alias(c) for c in [*TOKENS, TOTAL]]))


@query("drop_zero_buckets", f"""{ORDER_DAYS} SELECT {_DAY_OUT.replace(', 9)', ', 6)')} FROM bd
 WHERE total_tokens <> 0 OR cost_usd <> 0""")
def drop_zero_buckets(spark, sf):
    return shown(flt.drop_zero_buckets(a.order_days(spark, sf)), *DAY_COLUMNS, digits=6)


@query("filter_daily", f"""{DAYS} SELECT {_DAY_OUT} FROM du
 WHERE usage_date BETWEEN '2024-01-24' AND '2024-01-30' AND total_tokens > 0
 AND source IN ('Claude Code', 'Codex CLI') AND device IN ('dev-0', 'dev-1', 'dev-2')
 AND model IN ('gpt-5', 'claude-sonnet-4', 'deepseek-chat')""")
def filter_daily(spark, sf):
    start, end = flt.range_span("7d", a.AS_OF)
    return shown(flt.filter_daily(
        a.daily_usage(spark, sf), start, end, ["Claude Code", "Codex CLI"],
        ["dev-0", "dev-1", "dev-2"], ["gpt-5", "claude-sonnet-4", "deepseek-chat"]), *DAY_COLUMNS)


@query("filter_series", f"{HOURS} SELECT {_HOUR_OUT} FROM hu WHERE source IN ('OpenCode', 'OpenClaw')")
def filter_series(spark, sf):
    return shown(flt.filter_series(a.hour_usage(spark, sf), ["OpenCode", "OpenClaw"]), *HOUR_COLUMNS)


@query("recent_hours", f"{HOURS} SELECT {_HOUR_OUT} FROM hu WHERE usage_date >= '2024-01-23'")
def recent_hours(spark, sf):
    return shown(flt.recent_hours(a.hour_usage(spark, sf), 7, a.AS_OF, a.TZ), *HOUR_COLUMNS)


@query("recent_events", f"""{EVENTS} SELECT {_EVENT_OUT} FROM ue
 WHERE event_time >= TIMESTAMP '2024-01-22 16:00:00'""")
def recent_events(spark, sf):
    return shown(flt.recent_events(a.usage_events(spark, sf), 7, a.AS_OF, a.TZ), *EVENT_COLUMNS)


@query("today_events", f"""{EVENTS} SELECT {_EVENT_OUT},
 (event_time + INTERVAL 8 HOURS)::DATE::VARCHAR AS usage_date FROM ue
 WHERE event_time >= TIMESTAMP '2024-01-28 16:00:00'""")
def today_events(spark, sf):
    return shown(flt.today_events(a.usage_events(spark, sf), a.AS_OF, a.TZ),
                 *EVENT_COLUMNS, "usage_date")


def _spans_sql(spans: dict[str, tuple[str, str]]) -> str:
    rows = ", ".join(f"('{n}', DATE '{s}', DATE '{e}')" for n, (s, e) in spans.items())
    return f"""{DAYS}, spans(range_id, s, e) AS (VALUES {rows}) SELECT range_id,
 s::VARCHAR AS first_date, e::VARCHAR AS last_date, sum(total_tokens)::BIGINT AS total_tokens
 FROM spans JOIN du ON usage_date BETWEEN s AND e GROUP BY ALL"""


def _span_totals(daily, spans: dict[str, tuple[date, date]]):
    """Total per named span; a day belongs to every span that covers it."""
    covered = F.array_compact(F.array(*[
        F.when(F.col("usage_date").between(F.lit(s), F.lit(e)), F.struct(
            F.lit(n).alias("range_id"), F.lit(s).alias("first_date"), F.lit(e).alias("last_date")))
        for n, (s, e) in spans.items()
    ]))
    keys = ["range_id", "first_date", "last_date"]
    return daily.select(F.inline(covered), TOTAL).groupBy(*keys).agg(F.sum(TOTAL).alias(TOTAL))


@query("range_span", _spans_sql({
    "today": ("2024-01-30", "2024-01-30"), "yesterday": ("2024-01-29", "2024-01-29"),
    "7d": ("2024-01-24", "2024-01-30"), "30d": ("2024-01-01", "2024-01-30"),
    "month": ("2024-01-01", "2024-01-30")}))
def range_span(spark, sf):
    names = ["today", "yesterday", "7d", "30d", "month", "lastMonth"]
    return shown(_span_totals(a.daily_usage(spark, sf),
                              {n: flt.range_span(n, a.AS_OF) for n in names}))


@query("detail_range", _spans_sql({
    "today": ("2024-01-30", "2024-01-30"), "yesterday": ("2024-01-29", "2024-01-29"),
    "last7": ("2024-01-24", "2024-01-30"), "last30": ("2024-01-01", "2024-01-30"),
    "last90": ("2023-11-02", "2024-01-30"), "all": ("2023-08-04", "2024-01-30")}))
def detail_range(spark, sf):
    names = ["today", "yesterday", "last7", "last30", "last90", "all"]
    return shown(_span_totals(a.daily_usage(spark, sf),
                              {n: flt.detail_range(n, a.AS_OF) for n in names}))


@query("daily_series_all", f"{DAYS} SELECT {_DAY_OUT} FROM du")
def daily_series_all(spark, sf):
    return shown(flt.daily_series_all(a.daily_usage(spark, sf)), *DAY_COLUMNS)


@query("model_daily", f"{DAYS} SELECT {_DAY_OUT} FROM du WHERE model = 'gpt-5'")
def model_daily(spark, sf):
    return shown(flt.model_daily(a.daily_usage(spark, sf), "gpt-5"), *DAY_COLUMNS)


@query("model_hour", f"{HOURS} SELECT {_HOUR_OUT} FROM hu WHERE model = 'deepseek-chat'")
def model_hour(spark, sf):
    return shown(flt.model_hour(a.hour_usage(spark, sf), "deepseek-chat"), *HOUR_COLUMNS)


@query("localized_hours", f"{DAYS} SELECT {_HOUR_OUT} FROM hl")
def localized_hours(spark, sf):
    return shown(flt.localized_hours(a.hour_usage(spark, sf), a.TZ), *HOUR_COLUMNS)


@query("ordered_sessions", f"""{EVENTS} SELECT device, source, session_id, {SUMS.replace(
    'sum(cost_usd)', 'round(sum(cost_usd), 9)')} FROM ue GROUP BY ALL""")
def ordered_sessions(spark, sf):
    rows = flt.ordered_sessions(rol.session_rollup(a.usage_events(spark, sf)))
    return shown(rows, *SESSION_KEYS, *MEASURES)


@query("ordered_hours", f"{HOURS} SELECT {_HOUR_OUT} FROM hu")
def ordered_hours(spark, sf):
    return shown(flt.ordered_hours(a.hour_usage(spark, sf)), *HOUR_COLUMNS)


@query("ordered_events", f"{EVENTS} SELECT {_EVENT_OUT} FROM ue")
def ordered_events(spark, sf):
    return shown(flt.ordered_events(a.usage_events(spark, sf)), *EVENT_COLUMNS)


@query("distinct_values", f"""{EVENTS} SELECT 'source' AS kind, source AS value FROM ue
 UNION SELECT 'model', model FROM ue UNION SELECT 'device', device FROM ue""")
def distinct_values(spark, sf):
    return flt.distinct_values(a.unpriced_events(spark, sf))


@query("date_span", f"""{DAYS} SELECT min(usage_date)::VARCHAR AS first_date,
 max(usage_date)::VARCHAR AS last_date FROM du""")
def date_span(spark, sf):
    return shown(flt.date_span(a.daily_usage(spark, sf)))


@query("min_usage_date", f"""{DAYS} SELECT source, min(usage_date)::VARCHAR AS first_date
 FROM du GROUP BY source""")
def min_usage_date(spark, sf):
    return shown(flt.min_usage_date(a.daily_usage(spark, sf)))


# Roll-ups

@query("daily_by_model", f"""{EVENTS} SELECT usage_date::VARCHAR AS usage_date, model,
 {sums()}, round(sum(cost_usd), 9) AS cost_usd FROM ue GROUP BY ALL""")
def daily_by_model(spark, sf):
    return shown(rol.daily_by_model(a.usage_events(spark, sf)))


@query("hour_rollup", f"{HOURS} SELECT {_HOUR_OUT} FROM hu")
def hour_rollup(spark, sf):
    return shown(a.hour_usage(spark, sf), *HOUR_COLUMNS)


@query("hour_rollup_orders", f"""{ORDERS} SELECT device, source, usage_date::VARCHAR AS usage_date,
 hour, model, {sums()}, round(sum(cost_usd), 6) AS cost_usd, count(*) AS request_count
 FROM ub GROUP BY ALL""")
def hour_rollup_orders(spark, sf):
    return shown(rol.hour_rollup(a.order_events(spark, sf)), *HOUR_COLUMNS, digits=6)


@query("daily_rebuild", f"{DAYS} SELECT {_DAY_OUT} FROM du")
def daily_rebuild(spark, sf):
    return shown(a.daily_usage(spark, sf), *DAY_COLUMNS)


@query("daily_rebuild_span", f"""{DAYS} SELECT {_DAY_OUT} FROM du
 WHERE usage_date BETWEEN '2024-01-10' AND '2024-01-12'""")
def daily_rebuild_span(spark, sf):
    span = date(2024, 1, 10), date(2024, 1, 12)
    return shown(rol.daily_rebuild(a.hour_usage(spark, sf), a.TZ, span), *DAY_COLUMNS)


@query("rebucket_local_to_utc", f"""{HOURS} SELECT device, source,
 (usage_date + to_hours(hour - 8))::DATE::VARCHAR AS usage_date, (hour + 16) % 24 AS hour, model,
 {OUT_N} FROM hu""")
def rebucket_local_to_utc(spark, sf):
    return shown(rol.rebucket_local_to_utc(a.hour_usage(spark, sf), a.TZ), *HOUR_COLUMNS)


@query("session_rollup", f"""{EVENTS}, pm AS (SELECT device, source, session_id, model, {SUMS},
  max(event_time) AS last_activity FROM ue GROUP BY ALL)
SELECT device, source, session_id, {text_time('max(last_activity)')} AS last_activity,
 (SELECT any_value(project_path) FROM ue WHERE ue.session_id = pm.session_id
  AND ue.device = pm.device AND ue.source = pm.source) AS project_path,
 arg_min(model, (-total_tokens, model)) AS model, {sums()}, round(sum(cost_usd), 9) AS cost_usd
FROM pm GROUP BY device, source, session_id""")
def session_rollup(spark, sf):
    rows = rol.session_rollup(a.usage_events(spark, sf))
    return shown(rows, *SESSION_KEYS, "last_activity", "project_path", "model", *MEASURES)


# Rankings and shares

@query("model_ranking", f"""{DAYS} SELECT model, sum(total_tokens)::BIGINT AS total_tokens,
 round(sum(cost_usd), 9) AS cost_usd, sum(request_count)::BIGINT AS request_count
 FROM du GROUP BY model""")
def model_ranking(spark, sf):
    return shown(rnk.model_ranking(a.daily_usage(spark, sf)))


@query("rank_models", f"""{ORDER_DAYS}, r AS (SELECT model, sum(total_tokens)::BIGINT AS total_tokens,
 sum(request_count)::BIGINT AS request_count FROM bd GROUP BY model)
SELECT *, row_number() OVER (ORDER BY total_tokens DESC, model) AS rank FROM r""")
def rank_models(spark, sf):
    ranked = rnk.rank_models(rnk.model_ranking(a.order_days(spark, sf)))
    return shown(ranked, "model", TOTAL, REQUESTS, "rank")


@query("rank_sessions", f"""{ORDERS}, r AS (SELECT session_id AS model, sum(total_tokens)::BIGINT
 AS total_tokens FROM ub0 GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY total_tokens DESC, model) AS rank FROM r""")
def rank_sessions(spark, sf):
    sessions = a.unpriced_orders(spark, sf).groupBy(F.col("session_id").alias("model")).agg(
        F.sum(TOTAL).alias(TOTAL))
    return shown(rnk.with_global_rank(sessions, F.desc(TOTAL), F.asc("model")))


_TOP = f"""{ORDER_DAYS}, f AS (SELECT * FROM bd WHERE usage_date BETWEEN '1998-01-01' AND '1998-12-31'),
 t AS (SELECT model, sum(total_tokens)::BIGINT AS total_tokens, sum(cost_usd) AS cost_usd FROM f
 GROUP BY model ORDER BY total_tokens DESC, model LIMIT 8),
 s AS (SELECT model, source, sum(total_tokens) AS n FROM f GROUP BY ALL),
 m AS (SELECT model, arg_min(source, (-n, source)) AS top_source, count(*) AS source_count,
  string_agg(source || ':' || n::BIGINT, ',' ORDER BY n DESC, source) AS sources FROM s GROUP BY model),
 d AS (SELECT model, count(DISTINCT usage_date) AS active_days FROM bd GROUP BY model)
SELECT model, total_tokens, round(cost_usd, 6) AS cost_usd, top_source, source_count, sources, active_days
FROM t JOIN m USING (model) JOIN d USING (model)"""


@query("top_models", _TOP)
def top_models(spark, sf):
    days = a.order_days(spark, sf)
    year = flt.filter_daily(days, date(1998, 1, 1), date(1998, 12, 31))
    listed = F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["total"].cast("string")))
    return shown(rnk.top_models(year, days).withColumn("sources", F.array_join(listed, ",")), digits=6)


@query("model_source_share", f"""{DAYS}, s AS (SELECT model, source,
 sum(total_tokens)::BIGINT AS total_tokens FROM du GROUP BY ALL)
SELECT *, round(total_tokens / (sum(total_tokens) OVER (PARTITION BY model))::DOUBLE * 100, 6)
 AS share_pct FROM s""")
def model_source_share(spark, sf):
    return shown(rnk.model_source_share(a.daily_usage(spark, sf)), digits=6)


@query("top_n_other", f"""{ORDER_DAYS}, t AS (SELECT model FROM bd GROUP BY model
 ORDER BY sum(total_tokens) DESC, model LIMIT 6)
SELECT coalesce(t.model, '__other__') AS model_group, bd.source,
 sum(total_tokens)::BIGINT AS total_tokens, count(*) AS day_rows
FROM bd LEFT JOIN t USING (model) GROUP BY ALL""")
def top_n_other(spark, sf):
    grouped = rnk.top_n_other(a.order_days(spark, sf)).groupBy("model_group", "source")
    return shown(grouped.agg(F.sum(TOTAL).alias(TOTAL), F.count("*").alias("day_rows")))


@query("top_source_per_day", f"""{ORDER_DAYS}, s AS (SELECT usage_date, source, sum(total_tokens) AS n
 FROM bd GROUP BY ALL) SELECT usage_date::VARCHAR AS usage_date,
 arg_min(source, (-n, source)) AS source, max(n)::BIGINT AS total_tokens FROM s GROUP BY usage_date""")
def top_source_per_day(spark, sf):
    return shown(rnk.top_source_per_day(a.order_days(spark, sf)))


# Totals and comparison

_KPI = f"""coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens,
 coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
 coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
 coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens,
 coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens,
 coalesce(sum(reasoning_output_tokens), 0)::BIGINT AS reasoning_output_tokens,
 round(coalesce(sum(cost_usd), 0), 6) AS cost_usd,
 coalesce(sum(cache_read_tokens + cache_creation_tokens), 0)::BIGINT AS cache_tokens,
 round(sum(cache_read_tokens) / sum(total_tokens)::DOUBLE * 100, 6) AS cache_hit_pct"""


@query("kpi_totals", f"{DAYS} SELECT {_KPI} FROM du WHERE usage_date BETWEEN '2024-01-01' AND '2024-01-30'")
def kpi_totals(spark, sf):
    month = flt.filter_daily(a.daily_usage(spark, sf), *flt.range_span("month", a.AS_OF))
    return shown(ser.kpi_totals(month), digits=6)


@query("kpi_today", f"{DAYS} SELECT {_KPI} FROM hl WHERE usage_date = '2024-01-30'")
def kpi_today(spark, sf):
    return shown(ser.kpi_today(_hour_first(spark, sf)), digits=6)


def _compare_sql(source: str, current: tuple, previous: tuple, digits: int = 6) -> str:
    kpis = {"total_tokens": "total_tokens", "input_tokens": "input_tokens",
            "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_tokens",
            "cache_creation_tokens": "cache_creation_tokens",
            "reasoning_output_tokens": "reasoning_output_tokens", "cost_usd": "cost_usd",
            "cache_tokens": "cache_read_tokens + cache_creation_tokens"}
    inner = ", ".join(
        f"sum({e}) FILTER (usage_date BETWEEN '{s[0]}' AND '{s[1]}')::DOUBLE AS {c}{x}"
        for c, e in kpis.items() for s, x in ((current, ""), (previous, "_prev")))
    whole = ", ".join(
        (f"round({c}{x}, {digits}) AS {c}{x}" if c == "cost_usd" else f"{c}{x}::BIGINT AS {c}{x}")
        for c in kpis for x in ("", "_prev"))
    deltas = ", ".join(
        f"round(({c} - {c}_prev) / {c}_prev * 100, {digits}) AS {c}_delta_pct" for c in kpis)
    hit = "cache_read_tokens / total_tokens * 100"
    hit_prev = "cache_read_tokens_prev / total_tokens_prev * 100"
    return f"""{source}, k AS (SELECT {inner} FROM {'bd' if 'bd AS' in source else 'du'})
SELECT {whole}, {deltas}, round({hit}, {digits}) AS cache_hit_pct,
 round({hit_prev}, {digits}) AS cache_hit_pct_prev,
 round(({hit} - {hit_prev}) / ({hit_prev}) * 100, {digits}) AS cache_hit_pct_delta_pct FROM k"""


@query("kpi_compare", _compare_sql(DAYS, ("2024-01-24", "2024-01-30"), ("2024-01-17", "2024-01-23")))
def kpi_compare(spark, sf):
    span = flt.range_span("7d", a.AS_OF)
    before = flt.compare_span("7d", *span)
    return shown(ser.kpi_compare(a.daily_usage(spark, sf), span, before), digits=6)


@query("kpi_compare_month", _compare_sql(
    ORDER_DAYS, ("1999-03-01", "1999-03-18"), ("1999-02-01", "1999-02-28")))
def kpi_compare_month(spark, sf):
    span = flt.range_span("month", date(1999, 3, 18))
    before = flt.compare_span("month", *span)
    return shown(ser.kpi_compare(a.order_days(spark, sf), span, before), digits=6)


# Series over calendars

_LABELS = {
    "daily": "strftime(d, '%Y-%m-%d')", "monthly": "strftime(d, '%Y-%m')",
    "yearly": "strftime(d, '%Y')", "weekly": "isoyear(d) || '-W' || lpad(weekofyear(d)::VARCHAR, 2, '0')",
    "legacy": "year(d) || '-W' || lpad((weekofyear(d) - 1)::VARCHAR, 2, '0')",
}


def _trend_sql(granularity: str) -> str:
    return f"""{ORDER_DAYS}, span AS (SELECT min(usage_date) AS s, max(usage_date) AS e FROM bd),
cal AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS d FROM span),
slots AS (SELECT DISTINCT {_LABELS[granularity]} AS bucket, source FROM cal,
 (SELECT DISTINCT source FROM bd)),
f AS (SELECT {_LABELS[granularity]} AS bucket, source, sum(total_tokens) AS t
 FROM (SELECT *, usage_date AS d FROM bd) GROUP BY ALL)
SELECT bucket, source, coalesce(t, 0)::BIGINT AS total_tokens FROM slots LEFT JOIN f
 USING (bucket, source)"""


def _trend(granularity: str, legacy: bool = False):
    def run(spark, sf):
        days = a.order_days(spark, sf)
        return shown(ser.trend(days, *ser.data_span(days), granularity, legacy_week=legacy))
    return run


for _name in ("daily", "weekly", "monthly", "yearly"):
    query(f"trend_{_name}", _trend_sql(_name))(_trend(_name))
query("trend_legacy_week", _trend_sql("legacy"))(_trend("weekly", True))


@query("trend", f"""{DAYS}, cal AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30',
 INTERVAL 1 DAY))::DATE AS d), slots AS (SELECT strftime(d, '%Y-%m-%d') AS bucket, source FROM cal,
 (SELECT DISTINCT source FROM du)),
f AS (SELECT usage_date::VARCHAR AS bucket, source, sum(total_tokens) AS t FROM du GROUP BY ALL)
SELECT bucket, source, coalesce(t, 0)::BIGINT AS total_tokens FROM slots LEFT JOIN f
 USING (bucket, source)""")
def trend(spark, sf):
    span = flt.range_span("30d", a.AS_OF)
    return shown(ser.trend(a.daily_usage(spark, sf), *span, default_granularity(30)))


@query("trend_field", f"""{ORDER_DAYS}, span AS (SELECT min(usage_date) AS s, max(usage_date) AS e FROM bd),
cal AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS d FROM span),
slots AS (SELECT DISTINCT {_LABELS['weekly']} AS bucket FROM cal),
f AS (SELECT {_LABELS['weekly']} AS bucket, sum(output_tokens) AS t
 FROM (SELECT *, usage_date AS d FROM bd) GROUP BY ALL)
SELECT bucket, coalesce(t, 0)::BIGINT AS value FROM slots LEFT JOIN f USING (bucket)""")
def trend_field(spark, sf):
    days = a.order_days(spark, sf)
    return shown(ser.trend_field(days, *ser.data_span(days), "weekly", "output_tokens"))


@query("activity_stats", f"""{ORDER_DAYS}, span AS (SELECT min(usage_date) AS s, max(usage_date) AS e FROM bd),
cal AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS d FROM span),
slots AS (SELECT d, source FROM cal, (SELECT DISTINCT source FROM bd)),
act AS (SELECT d, source, f.source IS NOT NULL AS active FROM slots LEFT JOIN
 (SELECT DISTINCT usage_date AS d, source FROM bd) f USING (d, source)),
runs AS (SELECT *, sum(active::INT) OVER (PARTITION BY source ORDER BY d) AS run FROM act),
per AS (SELECT source, run, sum(active::INT) AS n, sum((NOT active)::INT) AS gap FROM runs GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS active_buckets, max(gap)::BIGINT AS longest_gap FROM per
GROUP BY source""")
def activity_stats(spark, sf):
    days = a.order_days(spark, sf)
    return shown(ser.activity_stats(days, *ser.data_span(days), by="source"))


@query("activity_stats_weekly", f"""{ORDER_DAYS},
cal AS (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 1 DAY))::DATE AS d),
slots AS (SELECT DISTINCT {_LABELS['weekly']} AS bucket FROM cal),
f AS (SELECT DISTINCT {_LABELS['weekly']} AS bucket FROM (SELECT usage_date AS d FROM bd)),
act AS (SELECT bucket, f.bucket IS NOT NULL AS active FROM slots LEFT JOIN f USING (bucket)),
runs AS (SELECT *, sum(active::INT) OVER (ORDER BY bucket) AS run FROM act),
per AS (SELECT run, sum(active::INT) AS n, sum((NOT active)::INT) AS gap FROM runs GROUP BY ALL)
SELECT sum(n)::BIGINT AS active_buckets, max(gap)::BIGINT AS longest_gap FROM per""")
def activity_stats_weekly(spark, sf):
    span = date(1994, 1, 1), date(2002, 12, 31)
    return shown(ser.activity_stats(a.order_days(spark, sf), *span, "weekly"))


@query("hourly_24", f"""{DAYS}, f AS (SELECT hour, sum(request_count) AS requests,
 sum(cache_read_tokens) AS input_cached, sum(input_tokens) AS input_uncached,
 sum(output_tokens) AS output, sum(cost_usd) AS cost FROM hl
 WHERE model = 'gpt-5' AND usage_date = '2024-01-29' GROUP BY hour)
SELECT h AS hour, coalesce(requests, 0)::BIGINT AS requests,
 coalesce(input_cached, 0)::BIGINT AS input_cached,
 coalesce(input_uncached, 0)::BIGINT AS input_uncached, coalesce(output, 0)::BIGINT AS output,
 round(coalesce(cost, 0), 9) AS cost FROM range(24) t(h) LEFT JOIN f ON h = hour""")
def hourly_24(spark, sf):
    return shown(ser.hourly_24(a.hour_usage(spark, sf), "gpt-5", date(2024, 1, 29), a.TZ))


_MODEL_SERIES = f"""{DAYS}, f AS (SELECT usage_date, sum(request_count) AS requests,
 sum(cache_read_tokens) AS input_cached, sum(input_tokens) AS input_uncached,
 sum(output_tokens) AS output, sum(cost_usd) AS cost FROM du WHERE model = 'gpt-5' GROUP BY usage_date),
ms AS (SELECT d::DATE::VARCHAR AS usage_date, coalesce(requests, 0)::BIGINT AS requests,
 coalesce(input_cached, 0)::BIGINT AS input_cached,
 coalesce(input_uncached, 0)::BIGINT AS input_uncached, coalesce(output, 0)::BIGINT AS output,
 round(coalesce(cost, 0), 9) AS cost
 FROM generate_series(DATE '2023-11-02', DATE '2024-01-30', INTERVAL 1 DAY) t(d)
 LEFT JOIN f ON d = usage_date)"""


@query("model_daily_series", f"{_MODEL_SERIES} SELECT * FROM ms")
def model_daily_series(spark, sf):
    span = flt.detail_range("last90", a.AS_OF)
    return shown(ser.model_daily_series(a.daily_usage(spark, sf), "gpt-5", *span))


@query("series_headline", f"""{_MODEL_SERIES} SELECT sum(requests)::BIGINT AS requests,
 sum(input_cached + input_uncached + output)::BIGINT AS tokens, round(sum(cost), 9) AS cost FROM ms""")
def series_headline(spark, sf):
    span = flt.detail_range("last90", a.AS_OF)
    return shown(ser.series_headline(
        ser.model_daily_series(a.daily_usage(spark, sf), "gpt-5", *span)))


@query("model_daily_series_all", f"""{DAYS}, span AS (SELECT min(usage_date) AS s, max(usage_date) AS e
 FROM du WHERE model = 'claude-sonnet-4'), cal AS (SELECT unnest(generate_series(s, e,
 INTERVAL 1 DAY))::DATE AS d FROM span)
SELECT d::VARCHAR AS usage_date, coalesce(sum(request_count), 0)::BIGINT AS requests,
 coalesce(sum(cache_read_tokens), 0)::BIGINT AS input_cached,
 coalesce(sum(input_tokens), 0)::BIGINT AS input_uncached,
 coalesce(sum(output_tokens), 0)::BIGINT AS output, round(coalesce(sum(cost_usd), 0), 9) AS cost
FROM cal LEFT JOIN (SELECT * FROM du WHERE model = 'claude-sonnet-4') ON d = usage_date GROUP BY d""")
def model_daily_series_all(spark, sf):
    daily, model = a.daily_usage(spark, sf), "claude-sonnet-4"
    own = ser.data_span(daily.where(F.col("model") == model))
    return shown(ser.model_daily_series(daily, model, *own))


@query("calendar_heatmap", f"""{DAYS}, f AS (SELECT usage_date, sum(total_tokens) AS t FROM du
 GROUP BY usage_date),
c AS (SELECT d::DATE AS day, CASE WHEN d BETWEEN DATE '2023-01-31' AND DATE '2024-01-30'
 THEN coalesce(t, 0) END::BIGINT AS total_tokens,
 date_diff('day', DATE '2023-01-29', d::DATE) AS n
 FROM generate_series(DATE '2023-01-29', DATE '2024-02-03', INTERVAL 1 DAY) g(d)
 LEFT JOIN f ON usage_date = d)
SELECT day::VARCHAR AS usage_date, total_tokens, (n // 7)::BIGINT AS week_column,
 (n % 7)::BIGINT AS weekday, CASE WHEN total_tokens IS NULL THEN NULL WHEN total_tokens = 0 THEN 0
 WHEN total_tokens <= 10000 THEN 1 WHEN total_tokens <= 100000 THEN 2
 WHEN total_tokens <= 1000000 THEN 3 WHEN total_tokens <= 100000000 THEN 4 ELSE 5 END::BIGINT
 AS heat_level FROM c""")
def calendar_heatmap(spark, sf):
    return shown(ser.calendar_heatmap(a.daily_usage(spark, sf), a.AS_OF))


# Layered day views: hours of some sources, events of others, day rows of the rest

_DAY = date(2024, 1, 30)
_SPLIT = """he AS (SELECT * FROM hl WHERE source <> 'OpenCode' AND source <> 'OpenClaw'),
ee AS (SELECT *, (event_time + INTERVAL 8 HOURS)::DATE AS day,
 hour(event_time + INTERVAL 8 HOURS)::BIGINT AS local_hour FROM ue WHERE source <> 'OpenClaw')"""


def _layer_inputs(spark, sf):
    """Hour rows without two of the sources, events without one of them, all day rows."""
    hours = a.hour_usage(spark, sf)
    events = a.usage_events(spark, sf)
    return (hours.where(~F.col("source").isin("OpenCode", "OpenClaw")),
            events.where(F.col("source") != "OpenClaw"), rol.daily_rebuild(hours, a.TZ))


def _hour_first(spark, sf):
    at = ser.fallback_hour(_DAY, a.AS_OF, 15)
    return ser.hour_first_series(*_layer_inputs(spark, sf), _DAY, a.TZ, at)


@query("hour_first_series", f"""{DAYS}, {_SPLIT},
l AS (SELECT source, hour, {COLS}, cost_usd FROM he WHERE usage_date = '2024-01-30'
 UNION ALL SELECT source, local_hour, {COLS}, cost_usd FROM ee WHERE day = '2024-01-30'
 AND (source, local_hour) NOT IN (SELECT (source, hour) FROM he WHERE usage_date = '2024-01-30')
 UNION ALL SELECT source, 15, {COLS}, cost_usd FROM du WHERE usage_date = '2024-01-30'
 AND source NOT IN (SELECT source FROM he WHERE usage_date = '2024-01-30')
 AND source NOT IN (SELECT source FROM ee WHERE day = '2024-01-30'))
SELECT source, hour, {sums()}, round(sum(cost_usd), 9) AS cost_usd FROM l GROUP BY ALL""")
def hour_first_series(spark, sf):
    return shown(_hour_first(spark, sf))


_DRILL = f"""{DAYS}, {_SPLIT},
l AS (SELECT source, local_hour AS hour, model, total_tokens FROM ee WHERE day = '2024-01-30'
 UNION ALL SELECT source, hour, model, total_tokens FROM he WHERE usage_date = '2024-01-30'
 AND source NOT IN (SELECT source FROM ee WHERE day = '2024-01-30')
 UNION ALL SELECT source, 15, model, total_tokens FROM du WHERE usage_date = '2024-01-30'
 AND source NOT IN (SELECT source FROM ee WHERE day = '2024-01-30')
 AND source NOT IN (SELECT source FROM he WHERE usage_date = '2024-01-30'))"""


@query("event_first_drill", f"""{_DRILL} SELECT source, hour, model,
 sum(total_tokens)::BIGINT AS total_tokens FROM l GROUP BY ALL""")
def event_first_drill(spark, sf):
    at = ser.fallback_hour(_DAY, a.AS_OF, 15)
    rows = ser.event_first_drill(*_layer_inputs(spark, sf), _DAY, a.TZ, at)
    return shown(rows, "source", "hour", "model", TOTAL)


@query("day_drill", f"""{_DRILL}, t AS (SELECT model FROM du WHERE usage_date = '2024-01-30'
 GROUP BY model ORDER BY sum(total_tokens) DESC, model LIMIT 4),
n AS (SELECT hour, coalesce(t.model, '__other__') AS model, total_tokens FROM l LEFT JOIN t USING (model)),
f AS (SELECT * FROM n UNION ALL SELECT unnest(range(24)), model, 0 FROM (SELECT DISTINCT model FROM n))
SELECT hour, model, sum(total_tokens)::BIGINT AS total_tokens FROM f GROUP BY ALL""")
def day_drill(spark, sf):
    return shown(ser.day_drill(*_layer_inputs(spark, sf), _DAY, a.TZ, 15, n=4))


@query("day_summary", f"""{DAYS}, s AS (SELECT source, sum(total_tokens) AS n FROM du
 WHERE usage_date = '2024-01-30' GROUP BY source)
SELECT count(*) AS source_count, arg_min(source, (-n, source)) AS peak_source,
 max(n)::BIGINT AS peak_tokens, sum(n)::BIGINT AS day_total FROM s""")
def day_summary(spark, sf):
    return shown(ser.day_summary(a.daily_usage(spark, sf), _DAY))
