"""Named queries: the scalar functions over whole tables."""

from pyspark.sql import functions as F

from tallyhouse.functions import identity, models, times, tokens
from tallyhouse.plans import adapters as a
from tallyhouse.plans.oracle import EVENTS, ORDERS, text_time
from tallyhouse.plans.registry import query, shown


def _pick(number, *texts):
    return F.element_at(F.array(*map(F.lit, texts)), (number % len(texts) + 1).cast("int"))


def _case(number: str, *texts: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE {number} % {len(texts)} {whens} END"


def _str(name):
    return F.col(name).cast("string")


# Model and provider names

_TIERS = ["", " (high)", "(minimal)", " ( xhigh )", " (foo)"]
_STEMS = ["Claude-Opus-4.1", "GPT-5.2", "gemini-2.5-pro", "x.claude.y"]
_PLAIN = ["claude-opus-4-1", "gpt-5.2", "gemini-2.5-pro", "x-claude-y"]


@query("normalize_model", f"""SELECT p_partkey, CASE WHEN p_size = 50 THEN 'unknown' ELSE
 {_case('p_partkey', *_PLAIN)} || CASE WHEN p_size % 2 = 0 AND p_size % 5 = 4 THEN '-20250514'
 ELSE '' END || CASE WHEN p_size % 5 = 4 THEN ' (foo)' ELSE '' END END AS model FROM part""")
def normalize_model(spark, sf):
    dated = F.when(F.col("p_size") % 2 == 0, "-20250514").otherwise("")
    raw = F.concat(F.lit(" "), _pick(F.col("p_partkey"), *_STEMS), dated,
                   _pick(F.col("p_size"), *_TIERS), F.lit("\t"))
    blank = F.when(F.col("p_size") == 50, "  ").otherwise(raw)
    return a.table(spark, sf, "part").select(
        "p_partkey", models.normalize_model(blank).alias("model"))


_RAW_PROVIDERS = ["X-AI", "unknown/Meta", "vertex/v2", "v2/Custom", "openai-codex", "9/8", "", "Mistral"]
_PROVIDERS = ["xai", "meta_llama", "anthropic", "custom", "openai", "", "", "mistralai"]


@query("canonical_provider",
       f"SELECT o_orderkey, {_case('o_orderkey', *_PROVIDERS)} AS provider FROM orders")
def canonical_provider(spark, sf):
    raw = _pick(F.col("o_orderkey"), *_RAW_PROVIDERS)
    return a.table(spark, sf, "orders").select(
        "o_orderkey", models.canonical_provider(raw).alias("provider"))


_MODELS = ["Claude-3", "my-gpt", "Gemini-x", "grok-4", "deepseek-r1", "MiMo-7b", "mixtral-8x7b",
           "llama-3", "qwen-max", "glm-4.6", "other"]
_GUESSES = ["anthropic", "openai", "google", "xai", "deepseek", "xiaomi", "mistral", "meta_llama",
            "qwen", "zai", ""]
_PREFIXES = ["anthropic", "openai", "google", "x-ai", "deepseek", "", "mistral", "meta-llama",
             "qwen", "", ""]


@query("infer_provider", f"SELECT o_orderkey, {_case('o_orderkey', *_GUESSES)} AS provider FROM orders")
def infer_provider(spark, sf):
    guess = models.infer_provider(_pick(F.col("o_orderkey"), *_MODELS))
    return a.table(spark, sf, "orders").select("o_orderkey", guess.alias("provider"))


@query("dataset_prefix", f"SELECT o_orderkey, {_case('o_orderkey', *_PREFIXES)} AS prefix FROM orders")
def dataset_prefix(spark, sf):
    guess = models.infer_provider(_pick(F.col("o_orderkey"), *_MODELS), catalogue=True)
    return a.table(spark, sf, "orders").select(
        "o_orderkey", models.dataset_prefix(guess).alias("prefix"))


@query("version_sep", """WITH v AS (SELECT o_orderkey, (o_orderkey % 12)::VARCHAR AS x, (o_custkey % 12)::VARCHAR AS y
 FROM orders) SELECT o_orderkey, CASE WHEN length(x) = 1 AND length(y) = 1 THEN 'm-' || x || '.' || y || '-z'
 END AS dotted FROM v""")
def version_sep(spark, sf):
    name = F.concat(F.lit("m-"), (F.col("o_orderkey") % 12).cast("string"), F.lit("-"),
                    (F.col("o_custkey") % 12).cast("string"), F.lit("-z"))
    return a.table(spark, sf, "orders").select("o_orderkey", models.version_sep(name).alias("dotted"))


@query("bare_model", """SELECT page_id, lower(trim(regexp_extract(url, '([^/]*)$', 1))) AS bare FROM pages""")
def bare_model(spark, sf):
    return a.table(spark, sf, "pages").select("page_id", models.bare_model(F.col("url")).alias("bare"))


@query("price_candidates", """WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name, ' .*$', '')) AS s,
 lower(replace(p_type, ' ', '_')) AS t, (p_partkey % 10)::VARCHAR AS d FROM part),
c AS (SELECT p_partkey, unnest([{'n': 1, 'c': 'v/' || s || '-' || t || '-' || d || 'k'},
 {'n': 2, 'c': s || '-' || t || '-' || d || 'k'}, {'n': 3, 'c': 'v/' || s || '-' || t},
 {'n': 4, 'c': 'v/' || s}, {'n': 5, 'c': s || '-' || t}, {'n': 6, 'c': s},
 {'n': 7, 'c': t || '-' || d || 'k'}, {'n': 8, 'c': t}, {'n': 9, 'c': d || 'k'}]) AS u FROM p)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY min(u.n)) AS place, u.c AS candidate
FROM c GROUP BY p_partkey, u.c""")
def price_candidates(spark, sf):
    first = F.lower(F.element_at(F.split("p_name", " "), 1))
    kind = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    name = F.concat(F.lit("v/"), first, F.lit("-"), kind, F.lit("-"),
                    (F.col("p_partkey") % 10).cast("string"), F.lit("k"))
    found = a.table(spark, sf, "part").select(
        "p_partkey", F.posexplode(models.price_candidates(name)).alias("place", "candidate"))
    return found.select("p_partkey", (F.col("place") + 1).cast("bigint").alias("place"), "candidate")


@query("fuzzy_score", f"""WITH k AS (SELECT p_partkey, {_case('p_partkey', 'openrouter/gpt-x', 'gpt/y', 'vertex_ai/z',
 'Bedrock/q', 'plain')} || p_partkey AS key FROM part)
SELECT p_partkey, (length(key) + CASE WHEN lower(key) LIKE 'gpt/%' THEN 10000 ELSE 0 END
 - CASE WHEN lower(key) LIKE 'openrouter/%' THEN 5000 ELSE 0 END
 - CASE WHEN lower(key) LIKE 'vertex\\_ai/%' ESCAPE '\\' OR lower(key) LIKE 'bedrock/%' THEN 2000 ELSE 0 END
 + CASE WHEN contains(key, '/') THEN 100 ELSE 0 END)::BIGINT AS score FROM k""")
def fuzzy_score(spark, sf):
    key = F.concat(_pick(F.col("p_partkey"), "openrouter/gpt-x", "gpt/y", "vertex_ai/z", "Bedrock/q", "plain"),
                   _str("p_partkey"))
    return shown(a.table(spark, sf, "part").select(
        "p_partkey", models.fuzzy_score(key, F.lit("gpt-5-mini")).alias("score")))


# Instants and calendar

@query("to_utc_ts", f"""SELECT event_id, CASE event_id % 7
 WHEN 0 THEN {text_time("ts")} WHEN 1 THEN {text_time("ts - INTERVAL 330 MINUTES")}
 WHEN 2 THEN {text_time("ts - INTERVAL 8 HOURS")} WHEN 3 THEN {text_time("ts::DATE - INTERVAL 8 HOURS")}
 WHEN 4 THEN {text_time("ts")} WHEN 5 THEN {text_time("ts")} END AS event_time FROM events""")
def to_utc_ts(spark, sf):
    time = F.col("ts").cast("timestamp")
    local = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    texts = [F.concat(local, F.lit(".25Z")), F.concat(local, F.lit("+05:30")),
             F.replace(local, F.lit("T"), F.lit(" ")), F.date_format(time, "yyyy-MM-dd"),
             F.unix_seconds(time).cast("string"), F.unix_millis(time).cast("string"),
             F.lit("not-a-time")]
    text = F.element_at(F.array(*texts), (F.col("event_id") % 7 + 1).cast("int"))
    return shown(a.table(spark, sf, "events").select(
        "event_id", times.to_utc_ts(text, a.TZ).alias("event_time")))


@query("epoch_to_utc", f"""SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN {text_time("ts")} END AS event_time
 FROM events""")
def epoch_to_utc(spark, sf):
    time = F.col("ts").cast("timestamp")
    number = F.when(F.col("event_id") % 3 == 0, F.unix_seconds(time)).when(
        F.col("event_id") % 3 == 1, F.unix_millis(time)).otherwise(F.lit(-5))
    return shown(a.table(spark, sf, "events").select(
        "event_id", times.epoch_to_utc(number).alias("event_time")))


@query("utc_date_hour", """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN ts::DATE::VARCHAR END AS usage_date,
 CASE WHEN event_id % 4 <> 0 THEN hour(ts) ELSE -1 END::BIGINT AS hour FROM events""")
def utc_date_hour(spark, sf):
    time = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    return shown(a.table(spark, sf, "events").select(
        "event_id", times.utc_date(time).alias("usage_date"), times.utc_hour(time).alias("hour")))


@query("bucket_round_trip", f"""{ORDERS} SELECT event_key, l_partkey, l_quantity, usage_date::VARCHAR AS usage_date,
 hour, (usage_date + to_hours(hour + 8))::DATE::VARCHAR AS local_date, (hour + 8) % 24 AS local_hour,
 CASE WHEN hour >= 12 THEN usage_date + 1 ELSE usage_date END::DATE::VARCHAR AS noon_next FROM ub0""".replace(
     "CASE WHEN hour >= 12 THEN usage_date + 1 ELSE usage_date END::DATE::VARCHAR AS noon_next",
     "usage_date::VARCHAR AS noon_local"))
def bucket_round_trip(spark, sf):
    local = times.bucket_to_local(F.col("usage_date"), F.col("hour"), a.TZ)
    rows = a.unpriced_orders(spark, sf).withColumn("hour", F.hour("event_time")).withColumn("l", local)
    back = times.bucket_to_utc(F.col("l.usage_date"), F.col("l.hour"), a.TZ)
    return shown(rows.withColumn("u", back).select(
        "event_key", "l_partkey", "l_quantity", "u.usage_date", "u.hour",
        F.col("l.usage_date").alias("local_date"), F.col("l.hour").alias("local_hour"),
        times.noon_localize(F.col("usage_date"), a.TZ).alias("noon_local")))


@query("normalize_date", """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 3 THEN NULL
 ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders""")
def normalize_date(spark, sf):
    day = F.to_date("o_orderdate")
    slashed = F.concat_ws("/", F.year(day).cast("string"), F.month(day).cast("string"),
                          F.dayofmonth(day).cast("string"))
    n = F.col("o_custkey") % 4
    text = F.when(n == 0, slashed).when(n == 1, F.concat(F.lit(" "), day.cast("string"))).when(
        n == 2, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "MMM d"))
    return shown(a.table(spark, sf, "orders").select(
        "o_orderkey", times.normalize_date(text).alias("day")))


@query("bucket_label", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS daily,
 isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS weekly,
 year(o_orderdate) || '-W' || lpad((weekofyear(o_orderdate) - 1)::VARCHAR, 2, '0') AS legacy_weekly,
 strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y') AS yearly FROM orders""")
def bucket_label(spark, sf):
    day = F.to_date("o_orderdate")
    labels = {g: times.bucket_label(day, g) for g in ("daily", "weekly", "monthly", "yearly")}
    labels["legacy_weekly"] = times.bucket_label(day, "weekly", legacy_week=True)
    return a.table(spark, sf, "orders").select("o_orderkey", *[v.alias(k) for k, v in labels.items()])


# Counters and ratios

@query("pos_int", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey
 WHEN 1 THEN floor(o_totalprice)::BIGINT ELSE 0 END AS n FROM orders""")
def pos_int(spark, sf):
    texts = [_str("o_custkey"), F.format_string("%.2f", F.col("o_totalprice")),
             F.concat(F.lit("-1"), _str("o_custkey")), F.lit("many")]
    text = F.element_at(F.array(*texts), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return a.table(spark, sf, "orders").select("o_orderkey", tokens.pos_int(text).alias("n"))


@query("normalize_gemini_cache", """WITH g AS (SELECT l_orderkey || ':' || l_linenumber AS event_key, l_partkey,
 l_quantity, l_partkey AS i, l_suppkey * 20 AS c, l_orderkey % 100 AS o, l_linenumber AS r,
 l_orderkey % 3 AS tool, l_orderkey % 4 AS m FROM lineitem), t AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 1 THEN i + o + r + tool
 WHEN 2 THEN i + o + r + tool + c ELSE 7 END AS total FROM g)
SELECT event_key, l_partkey, l_quantity, CASE WHEN total = 0 OR (c > 0 AND total = i + o + r + tool)
 THEN greatest(i - c, 0) ELSE i END::BIGINT AS net, c AS cached FROM t""")
def normalize_gemini_cache(spark, sf):
    order = F.split("event_key", ":")[0].cast("bigint")
    line = F.split("event_key", ":")[1].cast("bigint")
    given, cached = F.col("l_partkey"), F.col("l_suppkey") * 20
    out, tool = order % 100, order % 3
    whole = given + out + line + tool
    total = F.when(order % 4 == 0, 0).when(order % 4 == 1, whole).when(
        order % 4 == 2, whole + cached).otherwise(7)
    net, read = tokens.normalize_gemini_cache(given, cached, out, line, tool, total)
    return shown(a.unpriced_orders(spark, sf).select(
        "event_key", "l_partkey", "l_quantity", net.alias("net"), read.alias("cached")))


@query("delta_pct", """SELECT o_orderkey, round(CASE WHEN o_custkey % 9 <> 0
 THEN (o_orderkey - o_custkey % 9) / (o_custkey % 9)::DOUBLE * 100 END, 6) AS delta,
 round(CASE WHEN o_custkey % 9 <> 0 THEN o_orderkey / (o_custkey % 9)::DOUBLE * 100 ELSE 0 END, 6) AS hit
FROM orders""")
def delta_pct(spark, sf):
    base = F.col("o_custkey") % 9
    return shown(a.table(spark, sf, "orders").select(
        "o_orderkey", tokens.delta_pct(F.col("o_orderkey"), base).alias("delta"),
        tokens.cache_hit_rate(F.col("o_orderkey"), base).alias("hit")), digits=6)


@query("heat_level", """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL
 WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT * (o_orderkey % 1000) // 10 END AS t FROM orders)
SELECT o_orderkey, t AS total, CASE WHEN t IS NULL THEN NULL WHEN t = 0 THEN 0 WHEN t <= 10000 THEN 1
 WHEN t <= 100000 THEN 2 WHEN t <= 1000000 THEN 3 WHEN t <= 100000000 THEN 4 ELSE 5 END::BIGINT AS level FROM h""")
def heat_level(spark, sf):
    n = F.col("o_orderkey")
    scaled = F.expr("floor(o_totalprice) * (o_orderkey % 1000) div 10").cast("bigint")
    total = F.when(n % 10 == 0, None).when(n % 11 == 0, F.lit(0).cast("bigint")).otherwise(scaled)
    return shown(a.table(spark, sf, "orders").select("o_orderkey", total.alias("total")).select(
        "o_orderkey", "total", tokens.heat_level(F.col("total")).alias("level")))


@query("rate_per_million", """SELECT p_partkey, round(p_size / 1e6 * 1e6, 6) AS per_million,
 round(p_retailprice / 1e6, 9) AS per_token FROM part""")
def rate_per_million(spark, sf):
    return a.table(spark, sf, "part").select(
        "p_partkey", F.round(tokens.rate_per_million(F.col("p_size") / 1e6), 6).alias("per_million"),
        F.round(tokens.rate_per_token(F.col("p_retailprice")), 9).alias("per_token"))


# Keys and labels

@query("workspace_label", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '%2Fhome%2Fa+b' || c_custkey
 WHEN 1 THEN 'plain' || c_custkey WHEN 2 THEN '50%zz' || c_custkey WHEN 3 THEN 'C%3A%5Cw' || c_custkey
 ELSE '/elsewhere/x.jsonl' END AS key, CASE c_custkey % 5 WHEN 0 THEN '/home/a+b' || c_custkey
 WHEN 1 THEN 'plain' || c_custkey WHEN 2 THEN '50%zz' || c_custkey WHEN 3 THEN 'C:\\w' || c_custkey
 ELSE '/elsewhere/x.jsonl' END AS label FROM customer""")
def workspace_label(spark, sf):
    n = F.col("c_custkey")
    folder = F.concat(_pick(n, "%2Fhome%2Fa+b", "plain", "50%zz", "C%3A%5Cw", "-"), n.cast("string"))
    path = F.when(n % 5 == 4, "/elsewhere/x.jsonl").otherwise(
        F.concat(F.lit("file:/logs/projects/"), folder, F.lit("/deep/s.jsonl")))
    key = identity.workspace_key(path, "/logs/projects/")
    return a.table(spark, sf, "customer").select(
        "c_custkey", key.alias("key"), identity.workspace_label(key).alias("label"))


@query("source_from_app_type", f"""SELECT o_orderkey, {_case('o_orderkey', 'Claude Code', 'Claude Code', 'Claude Code',
 'Codex CLI', 'OpenCode', 'Cursor')} AS source FROM orders""")
def source_from_app_type(spark, sf):
    app = _pick(F.col("o_orderkey"), " Claude ", "claude-desktop", "Claude Desktop", "CODEX", "opencode",
                "Cursor")
    return a.table(spark, sf, "orders").select(
        "o_orderkey", identity.source_from_app_type(app).alias("source"))


@query("noon_localize", """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS near,
 (o_orderdate::DATE + 1)::DATE::VARCHAR AS far FROM orders""")
def noon_localize(spark, sf):
    day = F.to_date("o_orderdate")
    return shown(a.table(spark, sf, "orders").select(
        "o_orderkey", times.noon_localize(day, "+08:00").alias("near"),
        times.noon_localize(day, "+13:00").alias("far")))


@query("default_granularity", """WITH c AS (SELECT o_custkey,
 date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) + 1 AS days FROM orders GROUP BY ALL)
SELECT o_custkey, days, CASE WHEN days > 730 THEN 'yearly' WHEN days > 365 THEN 'monthly'
 WHEN days > 90 THEN 'weekly' ELSE 'daily' END AS granularity FROM c""")
def default_granularity(spark, sf):
    """Granularity of each customer's range of order dates."""
    day = F.to_date("o_orderdate")
    ranges = a.table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.date_diff(F.max(day), F.min(day)) + 1).cast("bigint").alias("days"))
    return ranges.withColumn("granularity", times.granularity_of(F.col("days")))
