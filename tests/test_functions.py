"""Scalar functions against tables of values."""

from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import identity, models, times, tokens


def evaluate(spark, function, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v")).alias("r")).collect()]


def check(spark, function, table, kind="string"):
    assert evaluate(spark, function, list(table), kind) == list(table.values())


def test_normalize_model(spark):
    check(spark, models.normalize_model, {
        "Claude-Sonnet-4-20250514 (high)": "claude-sonnet-4", "claude-sonnet-4.5": "claude-sonnet-4-5",
        "gpt-5 (foo)": "gpt-5 (foo)", "(high)": "(high)", "-20250514": "-20250514", "": "unknown",
        None: "unknown", "  GPT-5.1 ( XHigh ) ": "gpt-5.1", "a-20250101-20250102": "a-20250101",
        "x (low) (high)": "x (low)", "\tglm-4.6\n": "glm-4.6",
    })


def test_canonical_provider(spark):
    check(spark, models.canonical_provider, {
        "": "", "X-AI": "xai", "unknown/anthropic": "anthropic", "gpt4/openai": "openai",
        "acme": "acme", "v1": "", "vertex-ai/claude3": "anthropic"})


def test_infer_provider(spark):
    check(spark, models.infer_provider, {"glm-4": "zai", "MiMo": "xiaomi", "gpt-llama": "openai", "x": ""})
    check(spark, lambda c: models.infer_provider(c, catalogue=True), {"glm-4": "", "MiMo": ""})


def test_version_sep(spark):
    check(spark, models.version_sep, {
        "claude-sonnet-4-5": "claude-sonnet-4.5", "1-2-3": "1.2.3", "2-10": None,
        "a-3-5-sonnet-20241022": "a-3.5-sonnet-20241022", "x": None})


def dotted(name):
    chars = list(name)
    for i in range(1, len(chars) - 1):
        near = name[i - 1].isdigit() and name[i + 1].isdigit()
        wide = (i >= 2 and chars[i - 2].isdigit()) or (i + 2 < len(name) and name[i + 2].isdigit())
        if name[i] == "-" and near and not wide:
            chars[i] = "."
    return "".join(chars) if "".join(chars) != name else None


def expected_candidates(name, prefix):
    """Brute force over the parts of a name."""
    bare = name.split("/")[-1]

    def tails(text):
        parts = text.split("-")
        cut = ["-".join(parts[:-n]) for n in range(1, min(len(parts) - 1, 4) + 1)]
        return [c for c in cut if len(c) >= 2]

    def heads(text):
        parts, out = text.split("-"), []
        for n in range(1, min(len(parts) - 1, 2) + 1):
            rest = "-".join(parts[n:])
            out += [rest, *tails(rest)] if len(rest) >= 2 else []
        return out

    own = [name, bare, dotted(name), dotted(bare), *tails(name), *tails(bare), *heads(name), *heads(bare)]
    own = [c for c in own if c]
    return list(dict.fromkeys(own + ([f"{prefix}/{c}" for c in own] if prefix else [])))


def test_price_candidates_against_brute_force(spark):
    names = {"claude-sonnet-4-5": "anthropic", "vendor/gpt-5-mini-2024-08": "openai", "a": "", "a-b": "",
             "llama-3-1-70b-instruct-fp8": "meta-llama", "grok-4": "x-ai", "x-1-2-3-4-5-6": "",
             "open-router/a-b/mixtral-8x7b": "mistral", "a--b": "", "qwen": "qwen"}
    got = evaluate(spark, models.price_candidates, list(names))
    assert got == [expected_candidates(n, p) for n, p in names.items()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[a-z0-9]{1,3}(-[a-z0-9]{1,2}){0,6}", fullmatch=True), min_size=20,
                max_size=40))
def test_price_candidates_of_any_name(spark, names):
    names = [f"zz{n}" for n in names]
    want = [expected_candidates(n, "") for n in names]
    known = ["claude", "gpt", "grok", "qwen", "llama"]
    pairs = [(g, w) for n, g, w in zip(names, evaluate(spark, models.price_candidates, names), want,
                                      strict=True) if not any(k in n for k in known)]
    assert all(g == w for g, w in pairs)


def test_to_utc_ts(spark):
    at = datetime(2023, 11, 14, 22, 13, 20)
    check(spark, lambda c: times.to_utc_ts(c, "Asia/Shanghai"), {
        "2026-08-01T10:00:00+08:00": datetime(2026, 8, 1, 2), "2026-08-01T10:00:00.123Z": datetime(2026, 8, 1, 10),
        "2026-08-01T10:00:00": datetime(2026, 8, 1, 2), "2026-08-01 10:00:00": datetime(2026, 8, 1, 2),
        "2026-08-01": datetime(2026, 7, 31, 16), "1700000000000": at, "1700000000": at,
        "not-a-time": None, None: None, "": None, "-5": None, "2026": datetime(1970, 1, 1, 0, 33, 46)})


def test_local_buckets_in_a_daylight_saving_zone(spark):
    zone = "America/New_York"
    frame = spark.createDataFrame(
        [(date(2024, 3, 10), h) for h in range(24)] + [(date(2024, 11, 3), h) for h in range(24)],
        "d date, h int")
    local = frame.select("d", "h", times.bucket_to_local(F.col("d"), F.col("h"), zone).alias("l"))
    got = {(r.d, r.h): (r.l.usage_date, r.l.hour) for r in local.collect()}
    assert got[date(2024, 3, 10), 6] == (date(2024, 3, 10), 1)
    assert got[date(2024, 3, 10), 7] == (date(2024, 3, 10), 3)
    assert got[date(2024, 11, 3), 5] == got[date(2024, 11, 3), 6][:1] + (1,)


@pytest.mark.parametrize("zone", ["+08:00", "Asia/Kolkata", "UTC"])
def test_bucket_round_trip(spark, zone):
    frame = spark.createDataFrame([(date(2024, 1, 31), h) for h in range(24)], "d date, h int")
    local = frame.withColumn("l", times.bucket_to_local(F.col("d"), F.col("h"), zone))
    back = local.select("d", "h", times.bucket_to_utc(F.col("l.usage_date"), F.col("l.hour"), zone).alias("u"))
    drift = 0 if zone != "Asia/Kolkata" else 1
    for r in back.collect():
        hours = (r.d - r.u.usage_date).days * 24 + r.h - r.u.hour
        assert 0 <= hours <= drift


def test_normalize_date(spark):
    check(spark, times.normalize_date, {
        "2024/1/5": date(2024, 1, 5), "2024-01-05": date(2024, 1, 5), " 2024/12/31 ": date(2024, 12, 31),
        "bad": None, "2024-1-5": None, "2024/13/1": None, "": None, "2024/011/1": None})


def test_bucket_label(spark):
    days = [date(2024, 1, 3), date(2024, 12, 30)]
    legacy = evaluate(spark, lambda c: times.bucket_label(c, "weekly", True), days, "date")
    assert legacy == ["2024-W00", "2024-W00"]
    assert evaluate(spark, lambda c: times.bucket_label(c, "weekly"), days, "date") == ["2024-W01", "2025-W01"]
    assert [times.default_granularity(n) for n in (None, 90, 91, 366, 731)] == [
        "daily", "daily", "weekly", "monthly", "yearly"]


def test_pos_int(spark):
    check(spark, tokens.pos_int, {"10": 10, "10.9": 10, "-3": 0, "x": 0, None: 0, "1e3": 1000})


def test_normalize_gemini_cache(spark):
    cases = [((100, 30, 20, 0, 0, 120), (70, 30)), ((100, 30, 20, 0, 0, 150), (100, 30)),
             ((10, 30, 0, 0, 0, 0), (0, 30)), ((-4, -5, 1, 0, 0, 9), (0, 0))]
    frame = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)],
                                  "n int, i long, c long, o long, r long, t long, total long")
    net, read = tokens.normalize_gemini_cache(*[F.col(x) for x in ("i", "c", "o", "r", "t", "total")])
    got = frame.orderBy("n").select(net.alias("a"), read.alias("b")).collect()
    assert [tuple(r) for r in got] == [c[1] for c in cases]


def test_heat_level(spark):
    check(spark, tokens.heat_level, {
        None: None, 0: 0, 10_000: 1, 10_001: 2, 1_000_000: 3, 100_000_000: 4, 100_000_001: 5}, "long")


def test_delta_and_hit_rate_on_a_zero_base(spark):
    frame = spark.createDataFrame([(5, 0), (5, 4), (5, None)], "a long, b long")
    got = frame.select(tokens.delta_pct(F.col("a"), F.col("b")).alias("d"),
                       tokens.cache_hit_rate(F.col("a"), F.col("b")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(None, 0.0), (25.0, 125.0), (None, 0.0)]


def test_workspace_label(spark):
    key = lambda c: identity.workspace_key(c, "file:///logs/projects")
    assert evaluate(spark, key, ["/logs/projects/a/b.jsonl", "file:/logs/projects/a/b", "/x/y"]) == ["a", "a", "/x/y"]
    check(spark, identity.workspace_label, {
        "%2Fhome%2Fme": "/home/me", "a%20b": "a%20b", "%2Fa+b%2": "/a+b%2", "C%3A%5Cw": "C:\\w", "plain": "plain"})
