"""Named queries: conflict rules, devices, prices, manifests, quotas."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyhouse.operators import filters as flt
from tallyhouse.operators import manifest as man
from tallyhouse.operators import merge as mrg
from tallyhouse.operators import pricing as prc
from tallyhouse.operators import quota as quo
from tallyhouse.operators import ranking as rnk
from tallyhouse.operators import rollups as rol
from tallyhouse.plans import adapters as a
from tallyhouse.plans.oracle import (
    COLS, DAYS, EVENTS, HOURS, ORDER_DAYS, ORDERS, SUMS, TOKENS, sums, text_time,
)
from tallyhouse.plans.collect import UsageStore
from tallyhouse.plans.registry import query, shown
from tallyhouse.plans.report_queries import DAY_COLUMNS, HOUR_COLUMNS
from tallyhouse.schemas import (
    COST, DAILY_KEYS, EVENT_KEYS, MEASURES, RATES, REQUESTS, SESSION_KEYS, TOTAL,
)
from tallyhouse.session import cut_lineage, work_path

_RATES_OUT = ", ".join(f"round({r}, 9) AS {r}" for r in RATES)


def _next_device():
    """Device under which incoming rows partly meet stored ones: dev-N becomes dev-(N+2)."""
    number = F.substr("device", F.lit(5)).cast("int")
    return F.concat(F.lit("dev-"), (number + 2).cast("string"))


_MOVED = "'dev-' || (substr(device, 5)::INT + 2)"


# Usage layers

_LAST_EVENT = f"""le AS (SELECT device, source, event_key, arg_max(ub, (l_partkey, l_suppkey, l_shipdate,
 l_quantity, l_extendedprice)) AS r FROM ub GROUP BY ALL)"""


@query("upsert_events", f"""{ORDERS}, {_LAST_EVENT} SELECT device, source, event_key,
 r.usage_date::VARCHAR AS usage_date, r.model AS model, {', '.join(f'r.{c} AS {c}' for c in TOKENS)},
 r.total_tokens AS total_tokens, round(r.cost_usd, 6) AS cost_usd FROM le""")
def upsert_events(spark, sf):
    incoming = a.order_events(spark, sf)
    columns = [*EVENT_KEYS, "usage_date", "model", *MEASURES]
    empty = spark.createDataFrame([], incoming.select(*columns).schema)
    return shown(mrg.upsert_events(empty, incoming, a.ARRIVAL), digits=6)


@query("upsert_events_replace", f"""{EVENTS}, n AS (SELECT {_MOVED} AS device, source, event_key, model,
 input_tokens + 1 AS input_tokens FROM ue)
SELECT device, source, event_key, coalesce(n.model, ue.model) AS model,
 coalesce(n.input_tokens, ue.input_tokens) AS input_tokens
FROM ue FULL JOIN n USING (device, source, event_key)""")
def upsert_events_replace(spark, sf):
    stored = a.unpriced_events(spark, sf).select(*EVENT_KEYS, "model", "input_tokens")
    incoming = stored.withColumns({"device": _next_device(), "input_tokens": F.col("input_tokens") + 1})
    return shown(mrg.upsert_events(stored, incoming))


@query("upsert_hours", f"""{HOURS}, n AS (SELECT {_MOVED} AS device, source, usage_date, hour, model,
 input_tokens * 2 AS input_tokens, output_tokens // 2 AS output_tokens, cache_creation_tokens,
 cache_read_tokens, reasoning_output_tokens, total_tokens, cost_usd / 2 AS cost_usd, request_count FROM hu),
b AS (SELECT device, source, usage_date, hour, model, {COLS}, cost_usd, request_count FROM hu
 UNION ALL SELECT * FROM n)
SELECT device, source, usage_date::VARCHAR AS usage_date, hour, model,
 {', '.join(f'max({c}) AS {c}' for c in [*TOKENS, 'total_tokens', 'request_count'])},
 round(max(cost_usd), 9) AS cost_usd FROM b GROUP BY ALL""")
def upsert_hours(spark, sf):
    stored = a.hour_usage(spark, sf)
    incoming = stored.withColumns({
        "device": _next_device(), "input_tokens": F.col("input_tokens") * 2,
        "output_tokens": F.expr("output_tokens div 2"), COST: F.col(COST) / 2})
    return shown(mrg.upsert_hours(stored, incoming), *HOUR_COLUMNS)


@query("upsert_sessions", f"""{EVENTS}, s AS (SELECT device, source, session_id, max(event_time) AS last_activity,
 any_value(project_path) AS project_path, {SUMS} FROM ue GROUP BY ALL),
n AS (SELECT {_MOVED} AS device, source, session_id, last_activity - INTERVAL 1 DAY AS last_activity,
 'moved' AS project_path, input_tokens // 2 AS input_tokens, output_tokens * 3 AS output_tokens FROM s)
SELECT device, source, session_id, {text_time('coalesce(n.last_activity, s.last_activity)')} AS last_activity,
 coalesce(n.project_path, s.project_path) AS project_path,
 greatest(n.input_tokens, s.input_tokens) AS input_tokens,
 greatest(n.output_tokens, s.output_tokens) AS output_tokens
FROM s FULL JOIN n USING (device, source, session_id)""")
def upsert_sessions(spark, sf):
    stored = rol.session_rollup(a.usage_events(spark, sf))
    incoming = stored.withColumns({
        "device": _next_device(), "last_activity": F.col("last_activity") - F.expr("INTERVAL 1 DAY"),
        "project_path": F.lit("moved"), "input_tokens": F.expr("input_tokens div 2"),
        "output_tokens": F.col("output_tokens") * 3})
    return shown(mrg.upsert_sessions(stored, incoming), *SESSION_KEYS, "last_activity",
                 "project_path", "input_tokens", "output_tokens")


_LOCKED = f"""{DAYS}, o AS (SELECT *, CASE WHEN source = 'OpenClaw' THEN TIMESTAMP '2024-01-15 08:00:00' END
 AS lock FROM du),
n AS (SELECT {_MOVED} AS device, source, usage_date, model, total_tokens + 5 AS total_tokens,
 CASE WHEN source = 'OpenCode' THEN 0 ELSE cost_usd * 2 END AS cost_usd, request_count FROM du),
m AS (SELECT device, source, usage_date, model, coalesce(n.total_tokens, o.total_tokens) AS total_tokens,
 CASE WHEN o.model IS NULL THEN n.cost_usd WHEN n.model IS NULL THEN o.cost_usd
  WHEN usage_date < '2024-01-30' OR n.cost_usd = 0 THEN o.cost_usd ELSE n.cost_usd END AS cost_usd,
 coalesce(n.request_count, o.request_count) AS request_count,
 CASE WHEN n.model IS NULL THEN lock WHEN usage_date < '2024-01-30'
  THEN coalesce(lock, TIMESTAMP '2024-01-30 12:00:00') END AS pricing_locked_at
 FROM o FULL JOIN n USING (device, source, usage_date, model))
SELECT device, source, usage_date::VARCHAR AS usage_date, model, total_tokens,
 round(cost_usd, 9) AS cost_usd, request_count, {text_time('pricing_locked_at')} AS pricing_locked_at FROM m"""


@query("upsert_daily", _LOCKED)
def upsert_daily(spark, sf):
    days = a.daily_usage(spark, sf)
    early = F.lit("2024-01-15 08:00:00").cast("timestamp")
    stored = days.withColumn("pricing_locked_at", F.when(F.col("source") == "OpenClaw", early))
    incoming = days.withColumns({
        "device": _next_device(), TOTAL: F.col(TOTAL) + 5,
        COST: F.when(F.col("source") == "OpenCode", 0.0).otherwise(F.col(COST) * 2)})
    merged = mrg.upsert_daily(stored, incoming, a.AS_OF, a.LOCK_TIME)
    return shown(merged, *DAILY_KEYS, TOTAL, COST, REQUESTS, "pricing_locked_at")


_INCOMING_PRICES = """np AS (SELECT model_key, CASE n % 3 WHEN 0 THEN 0 ELSE input_rate * 2 END AS input_rate,
 CASE n % 3 WHEN 1 THEN -1 ELSE output_rate * 3 END AS output_rate, cache_read_rate,
 cache_write_rate + 1e-6 AS cache_write_rate FROM op)"""


def _fetched(spark, sf):
    """Prices fetched later: some rates are missing or invalid, and one key is new."""
    prices = a.order_prices(spark, sf)
    n = F.regexp_extract("model_key", "([0-9]+)$", 1).cast("int")
    changed = prices.withColumns({
        "input_rate": F.when(n % 3 == 0, 0.0).otherwise(F.col("input_rate") * 2),
        "output_rate": F.when(n % 3 == 1, -1.0).otherwise(F.col("output_rate") * 3),
        "cache_write_rate": F.col("cache_write_rate") + 1e-6,
        "fetched_at": F.lit("2024-02-01 00:00:00").cast("timestamp")})
    return changed.withColumn("model_key", F.when(n == 7, "model-new").otherwise(F.col("model_key")))


@query("upsert_prices", f"""{ORDERS}, {_INCOMING_PRICES},
nk AS (SELECT CASE WHEN model_key = 'model-7' THEN 'model-new' ELSE model_key END AS model_key,
 input_rate, output_rate, cache_read_rate, cache_write_rate FROM np)
SELECT model_key, {', '.join(f'round(CASE WHEN nk.{r} > 0 THEN nk.{r} ELSE coalesce(op.{r}, nk.{r}) END, 9) AS {r}'
 for r in RATES)}, CASE WHEN nk.input_rate IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END
 AS fetched_at FROM op FULL JOIN nk USING (model_key)""")
def upsert_prices(spark, sf):
    return shown(mrg.upsert_prices(a.order_prices(spark, sf), _fetched(spark, sf)))


@query("override_price", f"""{ORDERS}, {_INCOMING_PRICES},
nk AS (SELECT CASE WHEN model_key = 'model-7' THEN 'model-new' ELSE model_key END AS model_key,
 input_rate, output_rate, cache_read_rate, cache_write_rate FROM np)
SELECT model_key, {', '.join(f'round(coalesce(nk.{r}, op.{r}), 9) AS {r}' for r in RATES)},
 CASE WHEN op.input_rate IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS fetched_at
FROM op FULL JOIN nk USING (model_key)""")
def override_price(spark, sf):
    return shown(mrg.override_price(a.order_prices(spark, sf), _fetched(spark, sf)))


@query("delete_price", f"""{ORDERS} SELECT model_key, {_RATES_OUT} FROM op WHERE model_key NOT IN
 (SELECT 'model-' || s_suppkey FROM supplier)""")
def delete_price(spark, sf):
    keys = a.table(spark, sf, "supplier").select(
        F.concat(F.lit("model-"), F.col("s_suppkey").cast("string")).alias("model_key"))
    return shown(mrg.delete_price(a.order_prices(spark, sf), keys), "model_key", *RATES)


# Devices

_REMAP = """mp AS (SELECT 'dev-' || s_suppkey AS device, 'dev-' || (s_suppkey // 2) AS device_id
 FROM supplier WHERE s_suppkey % 4 <> 1)"""


def _mapping(spark, sf):
    n = F.col("s_suppkey")
    return a.table(spark, sf, "supplier").where(n % 4 != 1).select(
        F.concat(F.lit("dev-"), n.cast("string")).alias("device"),
        F.concat(F.lit("dev-"), F.expr("s_suppkey div 2").cast("string")).alias("device_id"))


@query("remap_devices", f"""{ORDER_DAYS}, {_REMAP}, x AS (SELECT bd.*, coalesce(device_id, device) AS target
 FROM bd LEFT JOIN mp USING (device)),
y AS (SELECT *, row_number() OVER (PARTITION BY target, source, usage_date, model
 ORDER BY target <> device, device) AS rn FROM x)
SELECT target AS device, source, usage_date::VARCHAR AS usage_date, model, {COLS},
 round(cost_usd, 6) AS cost_usd, request_count FROM y WHERE rn = 1""")
def remap_devices(spark, sf):
    moved = mrg.remap_devices(a.order_days(spark, sf), _mapping(spark, sf), DAILY_KEYS)
    return shown(moved, *DAY_COLUMNS, digits=6)


_DEVICES = """dv AS (SELECT 'dev-' || s_suppkey AS device_id, s_name AS hostname,
 CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Box ' || s_suppkey END AS display_name,
 s_suppkey = 0 AS is_local FROM supplier)"""


@query("with_device_name", f"""{ORDERS}, {_DEVICES} SELECT device, coalesce(nullif(display_name, ''),
 nullif(hostname, ''), device) AS device_name, {sums()} FROM ub0 LEFT JOIN dv ON device = device_id GROUP BY ALL""")
def with_device_name(spark, sf):
    named = mrg.with_device_name(a.unpriced_orders(spark, sf), a.devices(spark, sf))
    return shown(named.groupBy("device", "device_name").agg(
        *[F.sum(c).alias(c) for c in [*TOKENS, TOTAL]]))


def _imported_names(spark, sf):
    return a.table(spark, sf, "customer").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"),
        F.col("c_name").alias("name"))


@query("new_devices", f"""WITH {_DEVICES} SELECT 'dev-' || c_custkey AS device_id, '' AS hostname,
 c_name AS display_name, false AS is_local FROM customer
WHERE 'dev-' || c_custkey NOT IN (SELECT device_id FROM dv)""")
def new_devices(spark, sf):
    return mrg.new_devices(_imported_names(spark, sf), a.devices(spark, sf))


@query("rename_device", f"""WITH {_DEVICES} SELECT device_id, hostname, CASE WHEN device_id = 'dev-3'
 THEN 'Desk' ELSE display_name END AS display_name, is_local FROM dv""")
def rename_device(spark, sf):
    return mrg.rename_device(a.devices(spark, sf), "dev-3", "Desk")


@query("ordered_devices", f"WITH {_DEVICES} SELECT device_id, hostname, display_name, is_local FROM dv")
def ordered_devices(spark, sf):
    return flt.ordered_devices(a.devices(spark, sf))


# Import, reset and stored tables

@query("import_bundle", f"""{DAYS}, {_DEVICES}, n AS (SELECT {_MOVED} AS device, * EXCLUDE (device) FROM hu),
nd AS (SELECT {_MOVED} AS device, * EXCLUDE (device) FROM du),
s AS (SELECT device, source, session_id, sum(total_tokens) AS t FROM ue GROUP BY ALL),
ns AS (SELECT {_MOVED} AS device, * EXCLUDE (device) FROM s),
h2 AS (SELECT max(total_tokens) AS t FROM (SELECT device, source, usage_date, hour, model, total_tokens FROM hu
  UNION ALL SELECT device, source, usage_date, hour, model, total_tokens FROM n)
  GROUP BY device, source, usage_date, hour, model),
d2 AS (SELECT coalesce(nd.total_tokens, du.total_tokens) AS t FROM du FULL JOIN nd
  USING (device, source, usage_date, model)),
s2 AS (SELECT greatest(s.t, ns.t) AS t FROM s FULL JOIN ns USING (device, source, session_id))
SELECT 'daily' AS layer, (SELECT count(*) FROM nd) AS imported, count(*) AS n, sum(t)::BIGINT AS total_tokens FROM d2
UNION ALL SELECT 'devices', (SELECT count(*) FROM customer WHERE 'dev-' || c_custkey NOT IN
  (SELECT device_id FROM dv)), (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer WHERE
  'dev-' || c_custkey NOT IN (SELECT device_id FROM dv)), 0
UNION ALL SELECT 'hour', (SELECT count(*) FROM n), count(*), sum(t)::BIGINT FROM h2
UNION ALL SELECT 'session', (SELECT count(*) FROM ns), count(*), sum(t)::BIGINT FROM s2""")
def import_bundle(spark, sf):
    """A bundle imported twice into stored tables; the second time changes nothing."""
    events = a.usage_events(spark, sf)
    hours = cut_lineage(rol.hour_rollup(events))
    layers = {"hour": hours, "daily": rol.daily_rebuild(hours, a.TZ),
              "session": cut_lineage(rol.session_rollup(events))}
    store = UsageStore(spark, work_path(spark, "store"))
    store.write(devices=a.devices(spark, sf), **layers)
    bundle = {k: v.withColumn("device", _next_device()) for k, v in layers.items()}
    names = _imported_names(spark, sf)
    counts = store.import_usage(bundle, names, a.AS_OF, a.LOCK_TIME)
    store.import_usage(bundle, names, a.AS_OF, a.LOCK_TIME)
    parts = [store.read(n).agg(
        F.lit(n).alias("layer"), F.lit(counts[n]).alias("imported"),
        F.count("*").alias("n"),
        (F.sum(TOTAL) if n != "devices" else F.lit(0)).cast("bigint").alias(TOTAL))
        for n in ("hour", "daily", "session", "devices")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return shown(whole)


@query("reset_usage", """SELECT * FROM (VALUES ('daily', 0::BIGINT), ('event', 0), ('hour', 0),
 ('session', 0)) t(layer, n) UNION ALL SELECT 'devices', count(*) FROM supplier""")
def reset_usage(spark, sf):
    store = UsageStore(spark, work_path(spark, "store"))
    events = a.usage_events(spark, sf)
    hours = rol.hour_rollup(events)
    store.write(event=events, hour=hours, daily=rol.daily_rebuild(hours, a.TZ),
                session=rol.session_rollup(events), devices=a.devices(spark, sf))
    store.reset()
    parts = [store.read(n).agg(F.lit(n).alias("layer"), F.count("*").alias("n"))
             for n in ("event", "hour", "daily", "session", "devices")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_PAIRED = "'dev-' || (substr(device, 5)::INT // 2 * 2)"


def _survivors(rows: str, keys: str) -> str:
    """Rows of a layer under the paired ids: the row of the id that stays, else the one of the smallest id."""
    return f"""(SELECT * FROM (SELECT {_PAIRED} AS target, r.* FROM {rows} r)
 QUALIFY row_number() OVER (PARTITION BY target, {keys} ORDER BY target <> device, device) = 1)"""


@query("remap_store", f"""{DAYS}, {_DEVICES},
s AS (SELECT device, source, session_id, sum(total_tokens) AS total_tokens FROM ue GROUP BY ALL)
SELECT 'event' AS layer, target AS device, count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens
 FROM {_survivors("ue", "source, event_key")} GROUP BY ALL
UNION ALL SELECT 'hour', target, count(*), sum(total_tokens)::BIGINT
 FROM {_survivors("hu", "source, usage_date, hour, model")} GROUP BY ALL
UNION ALL SELECT 'daily', target, count(*), sum(total_tokens)::BIGINT
 FROM {_survivors("du", "source, usage_date, model")} GROUP BY ALL
UNION ALL SELECT 'session', target, count(*), sum(total_tokens)::BIGINT
 FROM {_survivors("s", "source, session_id")} GROUP BY ALL""")
def remap_store(spark, sf):
    """A store whose devices of odd number become the even one before them, mapped twice; the second time changes nothing."""
    events = cut_lineage(a.usage_events(spark, sf))
    hours = cut_lineage(rol.hour_rollup(events))
    store = UsageStore(spark, work_path(spark, "store"))
    store.write(event=events, hour=hours, event_hour=hours, daily=rol.daily_rebuild(hours, a.TZ),
                session=rol.session_rollup(events), session_part=rol.session_parts(events), devices=a.devices(spark, sf))
    number = F.substr("device", F.lit(5)).cast("int")
    paired = F.concat(F.lit("dev-"), (number - number % 2).cast("string"))
    mapping = cut_lineage(events.select("device").distinct().withColumn("device_id", paired))
    store.remap_devices(mapping)
    store.remap_devices(mapping)
    parts = [store.read(n).groupBy("device").agg(F.count("*").alias("n"), F.sum(TOTAL).cast("bigint").alias(TOTAL))
             .select(F.lit(n).alias("layer"), "device", "n", TOTAL) for n in ("event", "hour", "daily", "session")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return shown(whole)


# Prices

_EXPECTED_KEYS = """CASE n % 4 WHEN 0 THEN 'vendor/model-' || n WHEN 1 THEN 'openai/model-' || n
 WHEN 2 THEN 'Model-' || n ELSE 'model-' || n END AS price_key,
 CASE WHEN n % 4 = 0 THEN 'fuzzy' ELSE 'exact' END AS match"""


@query("resolve_prices", f"""{ORDERS} SELECT DISTINCT model, {_EXPECTED_KEYS}, {_RATES_OUT}
 FROM ub0 JOIN op USING (n)""")
def resolve_prices(spark, sf):
    models = prc.distinct_models(a.unpriced_orders(spark, sf))
    return shown(prc.resolve_prices(models, a.order_prices(spark, sf)))


@query("resolve_listed_prices", f"""{EVENTS} SELECT DISTINCT model, price_key, CASE WHEN model = 'gemini-2.5-pro'
 THEN 'fuzzy' ELSE 'exact' END AS match FROM ue0 JOIN rates USING (model)""")
def resolve_listed_prices(spark, sf):
    models = prc.distinct_models(a.unpriced_events(spark, sf))
    return prc.resolve_prices(models, a.listed_prices(spark)).select("model", "price_key", "match")


@query("price_events", f"""{EVENTS} SELECT event_key, model, round(cost_usd, 9) AS cost_usd FROM ue""")
def price_events(spark, sf):
    return shown(a.usage_events(spark, sf), "event_key", "model", COST)


@query("price_events_orders", f"""{ORDERS} SELECT event_key, model, l_partkey, l_suppkey, l_quantity,
 l_extendedprice, round(cost_usd, 6) AS cost_usd FROM ub""")
def price_events_orders(spark, sf):
    return shown(a.order_events(spark, sf), "event_key", "model", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", COST, digits=6)


@query("active_model_prices", f"""{ORDER_DAYS} SELECT model AS model_key, sum(total_tokens)::BIGINT AS total_tokens,
 any_value(round(input_rate, 9)) AS input_rate, any_value(round(output_rate, 9)) AS output_rate,
 any_value(round(cache_read_rate, 9)) AS cache_read_rate,
 any_value(round(cache_write_rate, 9)) AS cache_write_rate, any_value(input_rate) IS NOT NULL AS has_price
FROM bd LEFT JOIN op ON lower(regexp_replace(model_key, '^.*/', '')) = model GROUP BY model""")
def active_model_prices(spark, sf):
    ranking = rnk.model_ranking(a.order_days(spark, sf))
    return shown(prc.active_model_prices(ranking, a.order_prices(spark, sf)))


@query("price_meta", f"{ORDERS} SELECT '2024-01-01 00:00:00' AS fetched_at, count(*) AS price_count FROM op")
def price_meta(spark, sf):
    return shown(prc.price_meta(a.order_prices(spark, sf)))


@query("search_prices", f"{ORDERS} SELECT model_key, {_RATES_OUT} FROM op WHERE lower(model_key) LIKE '%model-1%'")
def search_prices(spark, sf):
    return shown(flt.search_prices(a.order_prices(spark, sf), " Model-1 "), "model_key", *RATES)


@query("ordered_prices", f"{ORDERS} SELECT model_key, {_RATES_OUT} FROM op")
def ordered_prices(spark, sf):
    return shown(flt.ordered_prices(a.order_prices(spark, sf)), "model_key", *RATES)


@query("load_price_catalog", """WITH k AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'GitHub_Copilot/p-'
  WHEN 1 THEN 'a/p-' ELSE 'p-' END || p_partkey AS model_key FROM part)
SELECT model_key, CASE WHEN p_size = 1 THEN 0 ELSE round(p_size / 1e6, 9) END AS input_rate,
 CASE WHEN p_size = 1 THEN 0 ELSE round(p_size / 5e5, 9) END AS output_rate, 0.0::DOUBLE AS cache_read_rate,
 round(1e-7, 9) AS cache_write_rate,
 CASE WHEN p_partkey % 2 = 0 THEN '2023-11-14 22:13:20' ELSE '2024-01-30 00:00:00' END AS fetched_at
FROM k WHERE p_partkey % 3 <> 0 AND p_size <> 1""")
def load_price_catalog(spark, sf):
    n, size = F.col("p_partkey"), F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size"))
    prefix = F.when(n % 3 == 0, "GitHub_Copilot/p-").when(n % 3 == 1, "a/p-").otherwise("p-")
    entry = F.struct((size / 1e6).alias("input_cost_per_token"),
                     (size / 5e5).alias("output_cost_per_token"),
                     F.lit(1e-7).alias("cache_creation_input_token_cost"),
                     F.lit("chat").alias("mode"))
    data = F.create_map(F.concat(prefix, n.cast("string")), entry)
    flat = F.to_json(data)
    wrapped = F.to_json(F.struct(F.lit(1700000000000).alias("fetchedAt"), data.alias("data")))
    docs = a.table(spark, sf, "part").select(F.when(n % 2 == 0, wrapped).otherwise(flat).alias("value"))
    return shown(prc.load_price_catalog(docs, "2024-01-30 00:00:00"))


# Manifest

_FILES = """l AS (SELECT '/x/' || (o_custkey % 50) || '/' || o_orderkey || '.jsonl' AS file_path,
 floor(o_totalprice)::BIGINT AS size, epoch_ms(o_orderdate) || ':' || floor(o_totalprice)::BIGINT AS fingerprint,
 o_orderkey AS n FROM orders),
m AS (SELECT file_path, CASE n % 4 WHEN 0 THEN fingerprint ELSE 'old' END AS fingerprint,
 CASE n % 4 WHEN 1 THEN size - 10 WHEN 2 THEN size + 10 ELSE size END AS last_offset FROM l WHERE n % 5 <> 0)"""


def _listing(spark, sf):
    size = F.floor("o_totalprice").cast("bigint")
    key = F.col("o_orderkey").cast("string")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return a.table(spark, sf, "orders").select(
        F.concat(F.lit("/x/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), key,
                 F.lit(".jsonl")).alias("file_path"),
        F.concat_ws(":", millis.cast("string"), size.cast("string")).alias("fingerprint"),
        size.alias("size"), F.col("o_orderkey").alias("n"))


def _manifest(spark, sf):
    n, size = F.col("n"), F.col("size")
    offset = F.when(n % 4 == 1, size - 10).when(n % 4 == 2, size + 10).otherwise(size)
    return _listing(spark, sf).where(n % 5 != 0).select(
        "file_path", F.when(n % 4 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"),
        offset.alias("last_offset"))


@query("changed_files", f"""WITH {_FILES} SELECT l.file_path, l.size, CASE WHEN l.fingerprint = m.fingerprint
 THEN 'CACHED' WHEN m.last_offset > 0 AND l.size > m.last_offset THEN 'INCREMENTAL' ELSE 'PARSE' END AS state,
 CASE WHEN l.fingerprint <> m.fingerprint AND m.last_offset > 0 AND l.size > m.last_offset
 THEN m.last_offset ELSE 0 END AS start_offset FROM l LEFT JOIN m USING (file_path)""")
def changed_files(spark, sf):
    states = man.changed_files(_listing(spark, sf), _manifest(spark, sf))
    return states.select("file_path", "size", "state", "start_offset")


@query("all_cached", f"""WITH {_FILES}, st AS (SELECT l.n, coalesce(l.fingerprint = m.fingerprint, false) AS same
 FROM l LEFT JOIN m USING (file_path))
SELECT 'listed' AS files, bool_and(same) AS all_cached FROM st
UNION ALL SELECT 'unchanged', bool_and(same) FROM st WHERE n % 4 = 0 AND n % 5 <> 0""")
def all_cached(spark, sf):
    """Over all files, of which some changed, and over those that did not."""
    listing, known = _listing(spark, sf), _manifest(spark, sf)
    parts = {"listed": listing, "unchanged": listing.where("n % 4 = 0 AND n % 5 <> 0")}
    shown_parts = [man.all_cached(man.changed_files(rows, known)).select(F.lit(name).alias("files"), "all_cached")
                   for name, rows in parts.items()]
    return shown_parts[0].unionByName(shown_parts[1])


@query("changed_dirs", f"""WITH {_FILES}, d AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir,
 max(n) AS top FROM l GROUP BY ALL)
SELECT file_path, size FROM l WHERE regexp_replace(file_path, '/[^/]*$', '') IN
 (SELECT dir FROM d WHERE top % 2 = 1)""")
def changed_dirs(spark, sf):
    listing = _listing(spark, sf)
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    dirs = listing.groupBy(folder.alias("file_path")).agg(F.max("n").alias("top"))
    now = dirs.select("file_path", F.concat(F.lit("f"), F.col("top").cast("string")).alias("fingerprint"))
    known = dirs.select("file_path", F.concat(
        F.lit("f"), (F.col("top") - F.col("top") % 2).cast("string")).alias("fingerprint"))
    return man.changed_dirs(listing, now, known).select("file_path", "size")


@query("prune_manifest", """WITH m AS (SELECT 'Codex CLI' AS source, '/f/' || o_orderkey AS file_path,
 o_orderdate AS updated_at FROM orders)
SELECT source, file_path, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM m
WHERE updated_at >= TIMESTAMP '1998-06-01' - INTERVAL 400 DAY
ORDER BY m.updated_at DESC, source, file_path LIMIT 500""")
def prune_manifest(spark, sf):
    rows = a.table(spark, sf, "orders").select(
        F.lit("Codex CLI").alias("source"),
        F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")).alias("file_path"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return shown(mrg.prune_manifest(rows, datetime(1998, 6, 1), 400, 500))


# Quotas

@query("quota_slots", """WITH u(unit, slot, slot_order) AS (VALUES (5, 'month', 2), (3, '5h', 0), (9, 'unit 9', 99))
SELECT 'q' || o_orderkey AS config_id, slot, (o_orderkey % 100 + unit)::BIGINT AS usage_pct,
 (CASE WHEN unit = 3 THEN -1 ELSE greatest(o_custkey - 500 + unit, 0) END)::BIGINT AS reset_sec,
 slot_order::BIGINT AS slot_order FROM orders, u""")
def quota_slots(spark, sf):
    now = 1_700_000_000_000
    n = F.col("o_orderkey")

    def limit(unit: int, resets: bool):
        at = F.lit(now) + (F.col("o_custkey") - 500 + unit) * 1000
        return F.struct(F.lit(unit).alias("unit"), (n % 100 + unit).alias("percentage"),
                        (at if resets else F.lit(None).cast("bigint")).alias("nextResetTime"))

    limits = F.array(limit(5, True), limit(3, False), limit(9, True))
    body = F.to_json(F.struct(F.lit(200).alias("code"), F.struct(limits.alias("limits")).alias("data")))
    responses = a.table(spark, sf, "orders").select(
        F.concat(F.lit("q"), n.cast("string")).alias("config_id"), body.alias("body"))
    return shown(quo.quota_slots(responses, now))


@query("quota_balances", """SELECT 'c' || c_custkey AS config_id, 0::BIGINT AS place, 'CNY' AS currency,
 round(c_acctbal, 2) AS total, 1.5::DOUBLE AS granted, 0.0::DOUBLE AS topped_up, true AS headline FROM customer
 WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'c' || c_custkey, 1, 'USD', c_nationkey, 0, 0, false FROM customer WHERE c_custkey % 10 <> 0""")
def quota_balances(spark, sf):
    def info(currency, total, granted, topped_up):
        return F.struct(F.lit(currency).alias("currency"), total.cast("string").alias("total_balance"),
                        F.lit(granted).alias("granted_balance"), F.lit(topped_up).alias("topped_up_balance"))

    infos = F.array(info("CNY", F.format_string("%.2f", F.col("c_acctbal")), "1.50", "x"),
                    info("USD", F.col("c_nationkey"), "0", ""))
    body = F.to_json(F.struct((F.col("c_custkey") % 10 != 0).alias("is_available"),
                              infos.alias("balance_infos")))
    responses = a.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("config_id"), body.alias("body"))
    return shown(quo.quota_balances(responses))


@query("quota_slots_text", """SELECT 'p' || p_partkey AS config_id, 0::BIGINT AS slot_order, '5h' AS slot,
 p_size::BIGINT AS usage_pct, p_partkey AS reset_sec FROM part
UNION ALL SELECT 'p' || p_partkey, 1, 'week', 7, 0 FROM part
UNION ALL SELECT 'p' || p_partkey, 2, 'month', 0, 0 FROM part""")
def quota_slots_text(spark, sf):
    body = F.format_string(
        '$R[1]={rollingUsage:$R[24]={status:"ok",resetInSec:%d,usagePercent:%d},weeklyUsage:$R[3]={usagePercent:7}}',
        F.col("p_partkey"), F.col("p_size"))
    responses = a.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("config_id"), body.alias("body"))
    return shown(quo.quota_slots_text(responses))
