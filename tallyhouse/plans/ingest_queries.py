"""Named queries: logs and tables of the sources, derived from the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.identity import event_key
from tallyhouse.functions.models import normalize_model
from tallyhouse.functions.times import normalize_date
from tallyhouse.functions.tokens import split_cached
from tallyhouse.operators import filters as flt
from tallyhouse.operators import rollups as rol
from tallyhouse.plans import adapters as a
from tallyhouse.plans.oracle import COLS, COST, DAYS, EVENTS, ORDERS, TOKENS, sums, text_time
from tallyhouse.plans.registry import query, shown
from tallyhouse.schemas import MEASURES, TOTAL
from tallyhouse.session import work_path
from tallyhouse.sources import claude, codex, dsh, gemini, tables, transfer
from tallyhouse.sources.files import file_listing, scan_jsonl_tree, scan_session_docs
from tallyhouse.sources.openclaw import parse_openclaw_log
from tallyhouse.sources.registry import union_collectors

EVENT = ["event_key", "event_time", "model", "project_path", "session_id", *TOKENS, TOTAL]
_ANY = " + ".join(TOKENS) + " > 0"
_STAMP = "strftime(event_time, '%Y-%m-%dT%H:%M:%SZ')"
_OUT = f"{text_time('event_time')} AS event_time, model, project_path, session_id, {COLS}"


def _every(n: int):
    return F.col("event_id") % n == 0


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _text(value):
    return F.lit(value)


# Claude Code

CLAUDE_ROOT = "/logs/projects"


def claude_lines(spark, sf):
    """Every message twice, with growing counters, among lines that carry no usage."""
    rows = a.raw_events(spark, sf).withColumn("stamp", a.stamp(F.col("event_time")))
    path = F.concat(F.lit(f"{CLAUDE_ROOT}/%2Fhome%2Fu"), (F.col("user_id") % 10).cast("string"),
                    F.lit("/s-"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    request = F.when(_every(2), F.concat(F.lit("r"), F.col("event_id").cast("string")))
    stamp = F.col("stamp")

    def message(model, **usage):
        return F.struct(
            F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), model.alias("model"),
            F.struct(*[v.alias(k) for k, v in usage.items()]).alias("usage"))

    def line(kind, body):
        return _json(type=_text(kind), timestamp=stamp, requestId=request, message=body)

    model, cached = F.col("raw_model"), F.col("cache_read_tokens")
    first = message(model, input_tokens=F.col("input_tokens"),
                    output_tokens=F.floor(F.col("output_tokens") / 2),
                    cache_read_input_tokens=cached.cast("string"))
    full = message(model, input_tokens=F.col("input_tokens"),
                   output_tokens=F.col("output_tokens").cast("double"),
                   cache_creation_input_tokens=F.col("cache_creation_tokens"),
                   reasoning_tokens=_text(-1), thinking_tokens=F.col("reasoning_output_tokens"))
    synthetic = message(_text("<synthetic>"), input_tokens=_text(9))
    return a.log_lines(rows, path, line("assistant", first), line("user", full),
                       line("assistant", full), line("assistant", synthetic),
                       _text('{"type":"assist'))


_CLAUDE = f"""{EVENTS}, c AS (SELECT * REPLACE ('/home/u' || (user_id % 10) AS project_path,
 's-' || user_id AS session_id), '/logs/projects/%2Fhome%2Fu' || (user_id % 10) || '/s-' || user_id
 || '.jsonl' AS path FROM ue WHERE {_ANY})"""


@query("parse_claude_log", f"""{_CLAUDE} SELECT path || ':' || {_STAMP} || ':' || model || ':'
 || (input_tokens + output_tokens) AS event_key, {_OUT} FROM c""")
def parse_claude_log(spark, sf):
    return shown(claude.parse_claude_log(claude_lines(spark, sf), CLAUDE_ROOT), *EVENT)


@query("dedup_merge_messages", f"""{_CLAUDE} SELECT path, CASE WHEN event_id % 2 = 0
 THEN 'm' || event_id || ':r' || event_id ELSE 'message:m' || event_id END AS message_key,
 {', '.join(TOKENS)} FROM c""")
def dedup_merge_messages(spark, sf):
    merged = claude.dedup_merge_messages(claude.claude_records(claude_lines(spark, sf)))
    return shown(flt.drop_zero_usage(merged), "path", "message_key", *TOKENS)


# Codex CLI

def codex_lines(spark, sf):
    """Totals that grow over a user's day and start again the next day; some are repeated, some
    come with the last usage."""
    rows = a.raw_events(spark, sf).withColumn("cached", F.col("cache_read_tokens") / 10)
    day = Window.partitionBy("user_id", "usage_date").orderBy("event_id")
    parts = {"input_tokens": "input_tokens", "output_tokens": "output_tokens",
             "cached_input_tokens": "cached", "reasoning_output_tokens": "reasoning_output_tokens"}
    so_far = {f"sum_{n}": F.sum(F.col(c).cast("bigint")).over(day) for n, c in parts.items()}
    rows = rows.withColumns({**so_far, "stamp": a.stamp(F.col("event_time"))})
    total = F.struct(*[F.col(f"sum_{n}").alias(n) for n in parts])
    last = F.when(_every(11), F.struct(*[F.col(c).cast("bigint").alias(n) for n, c in parts.items()]))
    stamp = F.col("stamp")

    def line(kind, payload):
        return _json(type=_text(kind), timestamp=stamp, payload=payload)

    info = F.struct(last.alias("last_token_usage"), total.alias("total_token_usage"))
    count = line("event_msg", F.struct(_text("token_count").alias("type"), info.alias("info")))
    named = F.struct(F.col("raw_model").alias("model"))
    slug = F.struct(F.struct(F.col("raw_model").alias("slug")).alias("model_info"))
    context = F.when(_every(10), line("turn_context", slug)).when(
        _every(5), line("turn_context", named))
    folder = F.concat(F.lit("/work/"), F.col("event_id").cast("string"))
    meta = F.when(_every(50), line("session_meta", F.struct(folder.alias("cwd"))))
    path = F.concat(F.lit("/codex/sessions/u-"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    other = line("event_msg", F.struct(_text("agent_message").alias("type")))
    return a.log_lines(rows, path, context, meta, other, count, F.when(_every(7), count))


_CODEX = f"""{EVENTS}, r AS (SELECT event_id, user_id, usage_date, event_time, model,
 input_tokens AS i, output_tokens AS o, cache_read_tokens // 10 AS c, reasoning_output_tokens AS r
 FROM ue), t AS (SELECT *, sum(i) OVER w::BIGINT AS ti, sum(o) OVER w::BIGINT AS tot,
 sum(c) OVER w::BIGINT AS tc, sum(r) OVER w::BIGINT AS tr FROM r
 WINDOW w AS (PARTITION BY user_id, usage_date ORDER BY event_id)),
p AS (SELECT *, lag(ti) OVER w AS pi, lag(tot) OVER w AS po, lag(tc) OVER w AS pc, lag(tr) OVER w AS pr,
 last_value(CASE WHEN event_id % 5 = 0 THEN model END IGNORE NULLS) OVER w AS cm,
 last_value(CASE WHEN event_id % 50 = 0 THEN '/work/' || event_id END IGNORE NULLS) OVER w AS cwd
 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CASE WHEN pi IS NOT NULL AND (ti, tot, tc, tr) = (pi, po, pc, pr) THEN NULL
 WHEN event_id % 11 = 0 THEN {{'i': i, 'o': o, 'c': c, 'r': r}}
 WHEN pi IS NULL THEN {{'i': ti, 'o': tot, 'c': tc, 'r': tr}}
 WHEN ti >= pi AND tot >= po AND tc >= pc AND tr >= pr
 THEN {{'i': ti - pi, 'o': tot - po, 'c': tc - pc, 'r': tr - pr}} END AS d FROM p),
x AS (SELECT *, '/codex/sessions/u-' || user_id || '.jsonl' AS path, 'u-' || user_id AS sid,
 d.i - least(d.c, d.i) AS net, least(d.c, d.i) AS cr FROM s WHERE d.i + d.o + d.c + d.r > 0)"""


@query("parse_codex_log", f"""{_CODEX} SELECT path || '::' || {_STAMP} || '::' || (net + d.o) AS event_key,
 {text_time('event_time')} AS event_time, coalesce(cm, 'unknown') AS model,
 coalesce(cwd, sid) AS project_path, sid AS session_id, net AS input_tokens, d.o AS output_tokens,
 0::BIGINT AS cache_creation_tokens, cr AS cache_read_tokens, d.r AS reasoning_output_tokens,
 net + d.o + cr AS total_tokens FROM x WHERE net + d.o + cr + d.r > 0""")
def parse_codex_log(spark, sf):
    return shown(codex.parse_codex_log(codex_lines(spark, sf)), *EVENT)


@query("cumulative_delta", f"""{_CODEX} SELECT path, event_id * 8 + 3 AS pos, d.i AS input_tokens,
 d.o AS output_tokens, d.c AS cached_input_tokens, d.r AS reasoning_output_tokens FROM x""")
def cumulative_delta(spark, sf):
    steps = codex.cumulative_delta(codex.ffill_model(codex.codex_states(codex_lines(spark, sf))))
    return shown(steps.select("path", "pos", "increase.*"))


@query("ffill_model", f"""{_CODEX}, n AS (SELECT '/codex/sessions/u-' || user_id || '.jsonl' AS path,
 event_id, coalesce(cm, 'unknown') AS model FROM p)
SELECT path, event_id * 8 + 3 AS pos, model FROM n
UNION ALL SELECT path, event_id * 8 + 4, model FROM n WHERE event_id % 7 = 0""")
def ffill_model(spark, sf):
    """The model in force at every token count, repeated counts included."""
    carried = codex.ffill_model(codex.codex_states(codex_lines(spark, sf)))
    return shown(carried.where("counts").select("path", "pos", normalize_model(F.col("model")).alias("model")))


@query("split_cached", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 l_partkey - least(l_suppkey * 20, l_partkey) AS net, least(l_suppkey * 20, l_partkey) AS cached
 FROM lineitem""")
def split_cached_query(spark, sf):
    net, cached = split_cached(F.col("l_partkey"), F.col("l_suppkey") * 20)
    return shown(a.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"),
        cached.alias("cached")))


# Gemini CLI

def gemini_lines(spark, sf):
    """Messages logged twice under one id, messages without id, statistics of both forms."""
    rows, user = a.raw_events(spark, sf), F.col("user_id").cast("string")
    stamp, path = a.stamp(F.col("event_time")), F.concat(F.lit("/gemini/u-"), user, F.lit(".jsonl"))
    given, out, thoughts = F.col("input_tokens"), F.col("output_tokens"), F.col("reasoning_output_tokens")
    cached, tool = (F.col("cache_read_tokens") / 10).cast("bigint"), F.col("event_id") % 3
    inclusive = given + out + thoughts + tool
    total = F.when(_every(2), inclusive).otherwise(inclusive + cached)
    tokens = F.struct(given.alias("input"), out.cast("string").alias("output"), cached.alias("cached"),
                      thoughts.alias("thoughts"), tool.alias("tool"), total.alias("total"))
    session = F.concat(F.lit("g-"), user, F.lit("-"), F.col("event_id").cast("string"))
    init = F.when(_every(9), _json(type=_text("init"), session_id=session, model=F.col("raw_model")))
    name = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    part = _json(type=_text("gemini"), id=name, timestamp=stamp,
                 tokens=F.struct(given.alias("input")))
    full = _json(type=_text("gemini"), id=name, timestamp=stamp, tokens=tokens,
                 model=F.when(_every(4), F.col("raw_model")))
    unnamed = F.when(_every(13), _json(type=_text("gemini"), timestamp=stamp, tokens=tokens))
    flat = F.struct(given.alias("input_tokens"), out.alias("output_tokens"),
                    cached.alias("cached_tokens"))
    per_model = F.struct(F.struct(
        F.struct(F.struct(given.alias("input"), cached.alias("cached")).alias("tokens")).alias("gemini-x"),
        F.struct(F.struct(_text(0).alias("input")).alias("tokens")).alias("gemini-0"),
    ).alias("models"))
    report = F.when(_every(17), _json(type=_text("result"), timestamp=stamp, stats=per_model))
    nested = F.when(_every(19), _json(type=_text("result"), timestamp=stamp,
                                      result=F.struct(flat.alias("stats"))))
    return a.log_lines(rows, path, init, part, full, unnamed, report, nested)


_GEMINI = f"""{EVENTS}, g AS (SELECT event_id, user_id, event_time, input_tokens AS i, output_tokens AS o,
 cache_read_tokens // 10 AS c, reasoning_output_tokens AS r, event_id % 3 AS tool,
 coalesce(last_value(CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN model END IGNORE NULLS) OVER w,
  'unknown') AS model, coalesce(last_value(CASE WHEN event_id % 9 = 0 THEN 'g-' || user_id || '-'
  || event_id END IGNORE NULLS) OVER w, 'u-' || user_id) AS sid
 FROM ue WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
msg AS (SELECT *, CASE WHEN (i + o + r + tool = 0 AND (event_id % 2 = 0 OR c = 0))
 OR (event_id % 2 = 0 AND c > 0) THEN i - least(c, i) ELSE i END + tool AS net FROM g),
em AS (SELECT sid, event_time, {_STAMP} AS stamp, model, net, o, c, r FROM msg
 UNION ALL SELECT sid, event_time, {_STAMP}, model, net, o, c, r FROM msg WHERE event_id % 13 = 0
 UNION ALL SELECT sid, NULL, '', CASE WHEN i + c > 0 THEN 'gemini-x' ELSE model END, i - least(c, i),
  0, c, 0 FROM g WHERE event_id % 17 = 0 AND i + c > 0
 UNION ALL SELECT sid, NULL, '', model, i - least(c, i), o, c, 0 FROM g
  WHERE event_id % 19 = 0 AND i + o + c > 0)"""


@query("parse_gemini_jsonl", f"""{_GEMINI} SELECT sid || ':' || stamp || ':' || (net + o) AS event_key,
 {text_time('event_time')} AS event_time, model, sid AS project_path, sid AS session_id,
 net AS input_tokens, o AS output_tokens, 0::BIGINT AS cache_creation_tokens, c AS cache_read_tokens,
 r AS reasoning_output_tokens, net + o + c AS total_tokens FROM em WHERE net + o + c + r > 0""")
def parse_gemini_jsonl(spark, sf):
    return shown(gemini.parse_gemini_jsonl(gemini_lines(spark, sf)), *EVENT)


@query("ffill_session_model", f"""{_GEMINI}, h AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN model ELSE
 coalesce(lag(model) OVER (PARTITION BY user_id ORDER BY event_id), 'unknown') END AS early FROM g),
k AS (SELECT unnest([[0, 9], [1, 1], [2, 1], [3, 13], [4, 17], [5, 19]]) AS k)
SELECT '/gemini/u-' || user_id || '.jsonl' AS path, event_id * 8 + k[1] AS pos, sid AS session,
 CASE WHEN k[1] < 2 THEN early ELSE model END AS model FROM h, k WHERE event_id % k[2] = 0""")
def ffill_session_model(spark, sf):
    """Session and model in force at every line."""
    carried = gemini.ffill_session_model(gemini_lines(spark, sf))
    return shown(carried.withColumn("model", normalize_model(F.col("model"))), "path", "pos", "session", "model")


@query("replace_by_id", """SELECT '/d/' || (l_suppkey % 8) AS path, 'k' || l_orderkey AS id,
 arg_max({'q': l_quantity, 'p': l_partkey}, (l_orderkey * 100 + l_linenumber, l_partkey,
 l_suppkey, l_extendedprice)).p AS part FROM lineitem GROUP BY ALL""")
def replace_by_id(spark, sf):
    order = ["l_partkey", "l_suppkey", "l_extendedprice"]
    rows = a.table(spark, sf, "lineitem").select(
        F.concat(F.lit("/d/"), (F.col("l_suppkey") % 8).cast("string")).alias("path"),
        F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("block"),
        F.lit(0).alias("chunk"), F.struct(*order).alias("pos"), F.col("l_partkey").alias("part"))
    return shown(gemini.replace_by_id(rows), "path", "id", "part")


def session_docs(spark, sf):
    """One session document per conversation; answers carry tokens by their size."""
    turn = F.col("turn").cast("string")
    stamp = F.concat(F.lit("2026-08-01T10:0"), turn, F.lit(":00+08:00"))
    size = F.octet_length("text").cast("bigint")
    tokens = F.struct(size.alias("input"), F.col("turn").alias("output"), (size / 2).cast("bigint")
                      .alias("cached"), (size + F.col("turn")).alias("total"))
    message = F.struct(
        F.col("turn").alias("n"),
        F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")).alias("type"),
        F.lit("gemini-2.5-pro").alias("model"), stamp.alias("timestamp"), tokens.alias("tokens"))
    return (
        a.table(spark, sf, "conversations").groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(message)).alias("messages"))
        .select(F.concat(F.lit("/g/chats/"), F.col("conv_id").cast("string"), F.lit(".json"))
                .alias("path"),
                _json(sessionId=F.concat(F.lit("c-"), F.col("conv_id").cast("string")),
                      messages=F.col("messages")).alias("value"))
    )


_DOCS = f"""WITH m AS (SELECT 'c-' || conv_id AS sid, turn, strlen(text) AS n FROM conversations
 WHERE role = 'assistant'), e AS (SELECT sid, turn, '2026-08-01T10:0' || turn || ':00+08:00' AS stamp,
 n - CASE WHEN n // 2 > 0 THEN n // 2 ELSE 0 END AS net, n // 2 AS c FROM m)
SELECT sid || ':' || stamp || ':' || (net + turn) AS event_key,
 '2026-08-01 02:0' || turn || ':00' AS event_time, 'gemini-2.5-pro' AS model, sid AS project_path,
 sid AS session_id, net AS input_tokens, turn AS output_tokens, 0::BIGINT AS cache_creation_tokens,
 c AS cache_read_tokens, 0::BIGINT AS reasoning_output_tokens, net + turn + c AS total_tokens
FROM e WHERE net + turn + c > 0"""


@query("parse_gemini_session", _DOCS)
def parse_gemini_session(spark, sf):
    return shown(gemini.parse_gemini_session(session_docs(spark, sf)), *EVENT)


@query("scan_session_docs", _DOCS)
def scan_session_docs_query(spark, sf):
    """Documents written one per file, as the tool keeps them, and scanned back."""
    root = work_path(spark, "sessions")
    _write_raw(session_docs(spark, sf), f"{root}/p0/chats", "json", maxRecordsPerFile=1)
    _, docs = scan_session_docs(spark, root)
    return shown(gemini.parse_gemini_session(docs), *EVENT)


@query("parse_gemini_stats", f"""{EVENTS}, g AS (SELECT event_id, input_tokens AS i, output_tokens AS o,
 cache_read_tokens AS c FROM ue),
e AS (SELECT event_id, 'm-a' AS model, i - least(c, i) AS net, 0 AS o, c FROM g
  WHERE event_id % 2 = 0 AND i + c > 0
 UNION ALL SELECT event_id, 'm-b', 0, o, 0 FROM g WHERE event_id % 2 = 0 AND o > 0
 UNION ALL SELECT event_id, 'unknown', i - least(c, i), o, c FROM g
  WHERE (event_id % 2 = 1 OR i + c + o = 0) AND i + o + c > 0)
SELECT 'st-' || event_id || '::' || (net + o) AS event_key, model, 'st-' || event_id AS session_id,
 net::BIGINT AS input_tokens, o::BIGINT AS output_tokens, c::BIGINT AS cache_read_tokens FROM e""")
def parse_gemini_stats(spark, sf):
    rows = a.raw_events(spark, sf)
    given, out, cached = F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens")

    def model(**tokens):
        return F.struct(F.struct(*[v.alias(k) for k, v in tokens.items()]).alias("tokens"))

    models = F.struct(model(input=given, cached=cached).alias("m-a"), model(output=out).alias("m-b"))
    stats = F.struct(F.when(_every(2), models).alias("models"), given.alias("input_tokens"),
                     out.alias("output_tokens"), cached.alias("cached_tokens"))
    path = F.concat(F.lit("/g/st-"), F.col("event_id").cast("string"), F.lit(".json"))
    docs = rows.select(path.alias("path"), _json(stats=stats).alias("value"))
    return shown(gemini.parse_gemini_stats(docs), "event_key", "model", "session_id",
                 "input_tokens", "output_tokens", "cache_read_tokens")


# OpenClaw, file scans

def openclaw_lines(spark, sf):
    rows = a.raw_events(spark, sf)
    usage = F.struct(
        F.col("input_tokens"), F.col("output_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
        F.col("reasoning_output_tokens").alias("reasoning_tokens"))
    line = _json(type=_text("assistant"), model=F.col("raw_model"),
                 timestamp=a.stamp(F.col("event_time")), usage=usage)
    path = F.concat(F.lit("/claw/a-"), (F.col("user_id") % 20).cast("string"), F.lit(".jsonl"))
    return a.log_lines(rows, path, line, _json(type=_text("user")))


_CLAW = """{0} SELECT {1} AS event_key, {2} AS event_time, model, input_tokens, output_tokens,
 cache_read_tokens, reasoning_output_tokens, input_tokens + output_tokens + cache_read_tokens
 AS total_tokens FROM ue WHERE input_tokens + output_tokens + cache_read_tokens
 + reasoning_output_tokens > 0"""
_CLAW_COLUMNS = ["event_time", "model", "input_tokens", "output_tokens", "cache_read_tokens",
                 "reasoning_output_tokens", TOTAL]


@query("parse_openclaw_log", _CLAW.format(EVENTS, f"""'/claw/a-' || (user_id % 20) || '.jsonl:'
 || {_STAMP} || ':' || (input_tokens + output_tokens)""", text_time("event_time")))
def parse_openclaw(spark, sf):
    return shown(parse_openclaw_log(openclaw_lines(spark, sf)), "event_key", *_CLAW_COLUMNS)


def _write_raw(lines, path: str, extension: str, by: str | None = None, **options) -> None:
    """Lines as they are, in files of the extension."""
    writer = lines.select("value", *([by] if by else [])).write
    writer = writer.partitionBy(by) if by else writer
    writer.options(extension=extension, quote="", escapeQuotes=False, sep="\u0001", **options).csv(path)


@query("scan_jsonl_tree", _CLAW.format(EVENTS, "''", text_time("event_time")).replace(
    "'' AS event_key, ", ""))
def scan_jsonl_tree_query(spark, sf):
    """Logs written as a tree of files and scanned back, with a root that does not exist."""
    root = work_path(spark, "tree")
    lines = openclaw_lines(spark, sf).withColumn("session", F.abs(F.hash("path")) % 20)
    _write_raw(lines, root, "jsonl", "session")
    found = scan_jsonl_tree(spark, [root, f"{root}-absent"])
    return shown(parse_openclaw_log(found), *_CLAW_COLUMNS)


@query("file_listing", "SELECT count(DISTINCT conv_id) AS files, 0::BIGINT AS empty FROM conversations")
def file_listing_query(spark, sf):
    root = work_path(spark, "listing")
    _write_raw(session_docs(spark, sf), root, "jsonl", maxRecordsPerFile=1)
    return file_listing(spark, [root]).agg(
        F.count("*").alias("files"), F.sum((F.col("size") == 0).cast("bigint")).alias("empty"))


# DeepSeek Harness

def dsh_lines(spark, sf):
    rows, user = a.raw_events(spark, sf), F.col("user_id").cast("string")
    path = F.concat(F.lit("/dsh/p/s-"), user, F.lit("/session.jsonl.zstd"))
    millis = F.unix_millis(F.date_trunc("second", "event_time"))
    head = F.when(_every(23), _json(
        type=_text("session"), id=F.concat(F.lit("h-"), user, F.lit("-"), F.col("event_id").cast("string")),
        cwd=F.when(_every(2), F.concat(F.lit("/w/"), user))))
    context = F.when(_every(6), _json(
        type=_text("request/context"), data=F.struct(F.col("raw_model").alias("model"))))
    config = F.struct(F.struct(F.col("raw_model").alias("model")).alias("config"))
    header = F.when(_every(5), _json(
        type=_text("request/header"), data=F.struct(config.alias("header"))))
    usage = F.struct(
        F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"),
        F.col("cache_read_tokens").alias("cacheReadTokens"),
        F.when(_every(3), F.col("cache_creation_tokens")).alias("cacheWriteTokens"),
        F.col("reasoning_output_tokens").alias("reasoningTokens"))
    answer = _json(type=_text("assistant/message"), seq=F.col("event_id"), time=millis,
                   data=F.struct(usage.alias("usage")))
    return a.log_lines(rows, path, head, context, header, answer)


def dsh_folders(spark, sf):
    """Project cache documents: the folder of every session that no header names."""
    user = (F.col("user_id") % 50).cast("string")
    entry = F.create_map(F.concat(F.lit("s-"), user), F.struct(
        F.struct(F.concat(F.lit("/cache/"), user).alias("cwd")).alias("identity")))
    docs = a.raw_events(spark, sf).select(
        _json(tables=F.struct(entry.alias("sessions"))).alias("value")).distinct()
    return dsh.project_folders(docs)


_DSH = f"""{EVENTS}, d AS (SELECT ue.* REPLACE (CASE WHEN event_id % 3 = 0 THEN cache_creation_tokens
  ELSE 0 END AS cache_creation_tokens),
 coalesce(last_value(CASE WHEN event_id % 6 = 0 OR event_id % 5 = 0 THEN model END IGNORE NULLS) OVER w,
  'unknown') AS m, coalesce(last_value(CASE WHEN event_id % 23 = 0 THEN 'h-' || user_id || '-'
  || event_id END IGNORE NULLS) OVER w, 's-' || user_id) AS sid,
 last_value(CASE WHEN event_id % 46 = 0 THEN '/w/' || user_id END IGNORE NULLS) OVER w AS cwd
 FROM ue WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
dd AS (SELECT * REPLACE (m AS model, sid AS session_id, input_tokens + output_tokens
 + cache_creation_tokens + cache_read_tokens AS total_tokens, coalesce(cwd, CASE WHEN sid = 's-' || user_id
 AND user_id % 50 = user_id THEN '/cache/' || user_id END) AS project_path)
 FROM d WHERE input_tokens <> 0 OR output_tokens <> 0)"""


@query("parse_dsh_log", f"""{_DSH} SELECT 'dsh::' || session_id || '::' || event_id AS event_key, {_OUT}
 FROM dd""")
def parse_dsh_log(spark, sf):
    return shown(dsh.parse_dsh_log(dsh_lines(spark, sf), dsh_folders(spark, sf)), *EVENT)


@query("ffill_dsh_state", f"""{_DSH} SELECT event_id AS seq, sid AS session, cwd FROM d""")
def ffill_dsh_state(spark, sf):
    carried = dsh.ffill_dsh_state(dsh.dsh_states(dsh_lines(spark, sf)))
    return shown(carried.where("answers"), "seq", "session", "cwd")


@query("with_session_cwd", f"""{_DSH} SELECT 'dsh::' || sid || '::' || event_id AS event_key, sid AS session_id,
 coalesce(cwd, CASE WHEN sid = 's-' || user_id AND user_id % 50 = user_id THEN '/cache/' || user_id END)
 AS project_path FROM d WHERE input_tokens <> 0 OR output_tokens <> 0""")
def with_session_cwd(spark, sf):
    events = dsh.parse_dsh_log(dsh_lines(spark, sf))
    named = dsh.with_session_cwd(events, dsh_folders(spark, sf))
    return shown(named, "event_key", "session_id", "project_path")


# Tables of other tools

def opencode_messages(spark, sf):
    tokens = F.struct(
        F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"),
        F.col("reasoning_output_tokens").alias("reasoning"),
        F.struct(F.col("cache_read_tokens").alias("read"),
                 F.col("cache_creation_tokens").alias("write")).alias("cache"))
    data = F.when(_every(10), _json(role=_text("user"))).when(
        _every(9), _text("not json")).otherwise(_json(modelID=F.col("raw_model"), tokens=tokens))
    return a.raw_events(spark, sf).select(
        F.concat(F.lit("msg"), F.col("event_id").cast("string")).alias("id"), "session_id",
        F.unix_millis("event_time").alias("time_created"), data.alias("data"))


@query("read_opencode_messages", f"""{EVENTS} SELECT 'msg' || event_id AS event_key,
 {text_time('event_time')} AS event_time, model, session_id, {COLS} FROM ue
 WHERE event_id % 10 <> 0 AND event_id % 9 <> 0 AND event_time >= TIMESTAMP '2024-01-08'
 AND (input_tokens <> 0 OR output_tokens <> 0)""")
def read_opencode_messages(spark, sf):
    since = 1704672000000
    rows = tables.read_opencode_messages(opencode_messages(spark, sf), since)
    return shown(rows, "event_key", "event_time", "model", "session_id", *TOKENS, TOTAL)


@query("next_cursor", "SELECT greatest(max(epoch_us(ts) // 1000), 5)::BIGINT AS cursor FROM events")
def next_cursor(spark, sf):
    return opencode_messages(spark, sf).agg(tables.next_cursor("time_created", 5))


@query("read_hermes_daily", f"""{ORDERS} SELECT usage_date::VARCHAR AS usage_date, model,
 input_tokens - least(cached, input_tokens) AS input_tokens, output_tokens,
 least(cached, input_tokens) AS cache_read_tokens, l_orderkey_n FROM (SELECT *, l_partkey + 1000 AS cached,
 l_suppkey AS l_orderkey_n FROM ub0)""".replace(", l_orderkey_n FROM (", " FROM ("))
def read_hermes_daily(spark, sf):
    rows = a.unpriced_orders(spark, sf).select(
        F.col("usage_date").cast("string").alias("date"), F.upper("model").alias("model"),
        "input_tokens", "output_tokens", (F.col("l_partkey") + 1000).alias("cached_tokens"))
    return shown(tables.read_hermes_daily(rows), "usage_date", "model", "input_tokens",
                 "output_tokens", "cache_read_tokens")


def proxy_requests(spark, sf):
    kinds = ["claude", " Codex", "opencode", "Claude-Desktop", "cursor"]
    app = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return a.raw_events(spark, sf).select(
        F.unix_seconds("event_time").alias("created_at"), app.alias("app_type"),
        F.col("raw_model").alias("model"),
        F.when(_every(7), "session").otherwise("proxy").alias("data_source"),
        F.when(_every(3), 500).otherwise(200 + (F.col("event_id") % 2) * 4).cast("int").alias("status_code"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
        F.lit("0").alias("total_cost_usd"), "event_id")


_PROXY = f"""{EVENTS}, pr AS (SELECT * REPLACE (CASE event_id % 5 WHEN 0 THEN 'Claude Code'
 WHEN 1 THEN 'Codex CLI' WHEN 2 THEN 'OpenCode' WHEN 3 THEN 'Claude Code' ELSE 'cursor' END AS source,
 0 AS reasoning_output_tokens) FROM ue0 WHERE event_id % 7 <> 0 AND event_id % 3 <> 0)"""


@query("read_ccswitch_requests", f"""{_PROXY} SELECT event_id, {COLS.replace(', reasoning_output_tokens', '')
    .replace(', total_tokens', '')} FROM pr WHERE epoch(event_time)::BIGINT > 1705276800""".replace(
        "epoch(event_time)::BIGINT", "floor(epoch(event_time))"))
def read_ccswitch_requests(spark, sf):
    rows = tables.read_ccswitch_requests(proxy_requests(spark, sf), 1705276800)
    return shown(rows, "event_id", *[t for t in TOKENS if t != "reasoning_output_tokens"])


@query("stale_cursor", f"{_PROXY} SELECT event_id FROM pr")
def stale_cursor(spark, sf):
    """A cursor beyond the newest request reads everything."""
    return tables.read_ccswitch_requests(proxy_requests(spark, sf), 9_999_999_999).select("event_id")


@query("ccswitch_hours", f"""{_PROXY}, ph AS (SELECT source, usage_date, hour, model, {sums()},
 count(*) AS request_count FROM pr GROUP BY ALL),
pc AS (SELECT ph.*, {COST} AS cost_usd FROM ph LEFT JOIN rates USING (model))
SELECT source, usage_date::VARCHAR AS usage_date, hour, model, {COLS}, round(cost_usd, 9) AS cost_usd,
 request_count FROM pc WHERE total_tokens <> 0 OR cost_usd <> 0""")
def ccswitch_hours(spark, sf):
    good = tables.read_ccswitch_requests(proxy_requests(spark, sf))
    return shown(rol.ccswitch_hours(good, a.listed_prices(spark), "dev-x")).drop("device")


def proxy_rollups(spark, sf):
    """Day rollups of lineitem, some dated Y/M/D and some not at all."""
    day = F.col("usage_date")
    slashed = F.concat_ws("/", F.year(day).cast("string"), F.month(day).cast("string"),
                          F.dayofmonth(day).cast("string"))
    n = F.col("l_partkey")
    text = F.when(n % 9 == 0, "soon").when(n % 2 == 0, slashed).otherwise(day.cast("string"))
    app = F.element_at(F.array(F.lit("claude"), F.lit("codex"), F.lit("other")),
                       (F.col("l_suppkey") % 3 + 1).cast("int"))
    return a.unpriced_orders(spark, sf).select(
        text.alias("date"), app.alias("app_type"), "model", "input_tokens", "output_tokens",
        "cache_read_tokens", "cache_creation_tokens", F.lit("0").alias("total_cost_usd"))


def local_days(spark, sf):
    """Local day rows that begin some years after the proxy's."""
    label = F.when(F.col("l_suppkey") % 2 == 0, K.CLAUDE_CODE).otherwise(K.CODEX_CLI)
    start = F.date_add("usage_date", F.when(F.col("l_suppkey") % 2 == 0, 1000).otherwise(2000))
    return a.unpriced_orders(spark, sf).select(label.alias("source"), start.alias("usage_date"))


_ROLLUPS = f"""{ORDERS}, ru AS (SELECT * REPLACE (CASE l_suppkey % 3 WHEN 0 THEN 'Claude Code'
  WHEN 1 THEN 'Codex CLI' ELSE 'other' END AS source, 0 AS reasoning_output_tokens) FROM ub0
 WHERE l_partkey % 9 <> 0),
lm AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Claude Code' ELSE 'Codex CLI' END AS source,
 min(usage_date + CASE WHEN l_suppkey % 2 = 0 THEN 1000 ELSE 2000 END) AS first_local FROM ub0 GROUP BY ALL),
rk AS (SELECT ru.* FROM ru LEFT JOIN lm USING (source)
 WHERE first_local IS NULL OR usage_date < first_local)"""


@query("read_ccswitch_rollups", f"""{_ROLLUPS} SELECT usage_date::VARCHAR AS usage_date, count(*) AS n
 FROM ub0 WHERE l_partkey % 9 <> 0 AND usage_date > '1998-06-30' GROUP BY ALL""")
def read_ccswitch_rollups(spark, sf):
    rows = tables.read_ccswitch_rollups(proxy_rollups(spark, sf), "1998-06-30")
    return shown(rows.groupBy(normalize_date(F.col("date")).alias("usage_date")).agg(F.count("*").alias("n")))


@query("rollups_before_local", f"""{_ROLLUPS} SELECT source, usage_date::VARCHAR AS usage_date, model,
 input_tokens, output_tokens FROM rk""")
def rollups_before_local(spark, sf):
    dated = rol.dated_rollups(proxy_rollups(spark, sf))
    kept = rol.rollups_before_local(dated, local_days(spark, sf))
    return shown(kept, "source", "usage_date", "model", "input_tokens", "output_tokens")


@query("ccswitch_rollup_daily", f"""{_ROLLUPS}, rd AS (SELECT source, usage_date, n, model, {sums()}
 FROM rk GROUP BY ALL)
SELECT source, usage_date::VARCHAR AS usage_date, model, {COLS}, round({COST}, 6) AS cost_usd
FROM rd LEFT JOIN op USING (n) WHERE total_tokens <> 0""")
def ccswitch_rollup_daily(spark, sf):
    rows = rol.ccswitch_rollup_daily(proxy_rollups(spark, sf), local_days(spark, sf),
                                     a.order_prices(spark, sf), "dev-x")
    return shown(rows, "source", "usage_date", "model", *MEASURES, digits=6)


@query("rollup_statistics", f"""{_ROLLUPS} SELECT (SELECT count(*) FROM ru) AS scanned,
 (SELECT count(*) FROM rk) AS included,
 (SELECT count(*) FROM ru) - (SELECT count(*) FROM rk) AS skipped""")
def rollup_statistics(spark, sf):
    return shown(rol.rollup_statistics(proxy_rollups(spark, sf), local_days(spark, sf)))


@query("union_collectors", f"""{EVENTS}, u AS (SELECT 'Claude Code' AS source, {', '.join(TOKENS)}, total_tokens
 FROM ue WHERE {_ANY} UNION ALL SELECT 'OpenClaw', input_tokens, output_tokens, 0, cache_read_tokens,
 reasoning_output_tokens, input_tokens + output_tokens + cache_read_tokens FROM ue
 WHERE input_tokens + output_tokens + cache_read_tokens + reasoning_output_tokens > 0)
SELECT 'here' AS device, source, count(*) AS events, {sums()} FROM u GROUP BY ALL""")
def union_collectors_query(spark, sf):
    parts = [claude.parse_claude_log(claude_lines(spark, sf), CLAUDE_ROOT),
             parse_openclaw_log(openclaw_lines(spark, sf))]
    return shown(union_collectors(parts, "here").groupBy("device", "source").agg(
        F.count("*").alias("events"), *[F.sum(c).alias(c) for c in [*TOKENS, TOTAL]]))


@query("quarantined", f"""{_GEMINI} SELECT 'Gemini CLI' AS source, count(*) AS events FROM em
 WHERE event_time IS NULL AND net + o + c + r > 0""")
def quarantined(spark, sf):
    return flt.quarantined(gemini.parse_gemini_jsonl(gemini_lines(spark, sf)))


@query("event_key", f"""{EVENTS} SELECT event_id, session_id || ':' || {_STAMP} || ':' || input_tokens
 AS event_key FROM ue""")
def event_key_query(spark, sf):
    key = event_key(F.col("session_id"), a.stamp(F.col("event_time")), F.col("input_tokens"))
    return shown(a.raw_events(spark, sf).select("event_id", key.alias("event_key")))


# Exchange files

@query("write_export_bundle", f"""{DAYS}, su AS (SELECT device, source, session_id, sum(total_tokens) AS t
 FROM ue GROUP BY ALL)
SELECT 'hourUsage' AS layer, count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens FROM hu
UNION ALL SELECT 'dailyUsage', count(*), sum(total_tokens)::BIGINT FROM du
UNION ALL SELECT 'sessionUsage', count(*), sum(t)::BIGINT FROM su
UNION ALL SELECT 'deviceNames', count(*), 0 FROM supplier""")
def write_export_bundle(spark, sf):
    events = a.usage_events(spark, sf)
    hours = rol.hour_rollup(events)
    path = work_path(spark, "bundle")
    transfer.write_export_bundle(path, hours, rol.daily_rebuild(hours, a.TZ),
                                 rol.session_rollup(events), a.devices(spark, sf), "2024-01-30T00:00:00Z")
    return _bundle_counts(transfer.load_export_bundle(spark, path))


def _bundle_counts(bundle):
    parts = [rows.agg(F.lit(layer).alias("layer"), F.count("*").alias("n"), (
        F.sum(TOTAL) if TOTAL in rows.columns else F.lit(0).cast("bigint")).alias(TOTAL))
        for layer, rows in bundle.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("load_export_bundle", f"""{DAYS} SELECT device, source, usage_date::VARCHAR AS usage_date, hour,
 model, {COLS}, round(cost_usd, 9) AS cost_usd, request_count FROM hu""")
def load_export_bundle(spark, sf):
    events = a.usage_events(spark, sf)
    hours = rol.hour_rollup(events)
    path = work_path(spark, "bundle")
    transfer.write_export_bundle(path, hours, rol.daily_rebuild(hours, a.TZ),
                                 rol.session_rollup(events), a.devices(spark, sf), "2024-01-30T00:00:00Z")
    return shown(transfer.load_export_bundle(spark, path)["hourUsage"])


@query("write_csv", """SELECT event_id::VARCHAR AS "Event", props AS "Properties, raw",
 event_type || '"x"' AS "Kind" FROM events""")
def write_csv(spark, sf):
    path = work_path(spark, "csv")
    rows = a.table(spark, sf, "events").withColumn("kind", F.concat("event_type", F.lit('"x"')))
    transfer.write_csv(rows, path, {"event_id": "Event", "props": "Properties, raw", "kind": "Kind"})
    return spark.read.options(header=True, escape='"').csv(path)


@query("write_usage_tables", f"""{DAYS} SELECT 'daily' AS name, usage_date::VARCHAR AS usage_date,
 count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens FROM du GROUP BY ALL
UNION ALL SELECT 'hour', usage_date::VARCHAR, count(*), sum(total_tokens)::BIGINT FROM hu GROUP BY ALL""")
def write_usage_tables(spark, sf):
    root = work_path(spark, "tables")
    hours = a.hour_usage(spark, sf)
    transfer.write_usage_tables(root, hour=hours, daily=rol.daily_rebuild(hours, a.TZ))
    parts = [spark.read.parquet(f"{root}/{n}").groupBy("usage_date").agg(
        F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(TOTAL).alias(TOTAL))
        for n in ("hour", "daily")]
    return shown(parts[0].unionByName(parts[1]))
