"""Roll-ups, merges, prices and series on hand-written rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import filters, lookup, manifest, merge, pricing, quota, ranking, rollups, series
from tallyhouse.schemas import (
    COST, DAILY_USAGE, DEVICES, HOUR_USAGE, INPUT, MODEL_PRICING, OUTPUT, RATES, REQUESTS, TOKENS, TOTAL, USAGE_EVENT,
)


def usage(spark, schema, *given):
    """Rows with the given fields; counters default to 0 and texts to NULL."""
    def value(field, row):
        zero = {"LongType()": 0, "DoubleType()": 0.0, "IntegerType()": 0}
        return row.get(field.name, zero.get(str(field.dataType)))

    return spark.createDataFrame([tuple(value(f, r) for f in schema) for r in given], schema)


def hour(day, h, total, model="m", device="d", source="s", **more):
    return {"device": device, "source": source, "usage_date": day, "hour": h, "model": model,
            INPUT: total, TOTAL: total, **more}


def test_local_day_from_utc_hours(spark):
    hours = usage(spark, HOUR_USAGE, hour(date(2026, 8, 4), 16, 100), hour(date(2026, 8, 5), 0, 50),
                  hour(date(2026, 8, 5), 8, 30))
    (day,) = rollups.daily_rebuild(hours, "Asia/Shanghai").collect()
    assert (day.usage_date, day[TOTAL]) == (date(2026, 8, 5), 180)


@pytest.mark.parametrize("zone", ["UTC", "+08:00", "America/New_York", "Asia/Kolkata"])
def test_sums_are_conserved(spark, zone):
    data = [hour(date(2024, 3, 9 + n % 3), n % 24, n + 1, f"m{n % 2}", f"d{n % 3}", **{c: n for c in TOKENS})
            for n in range(100)]
    hours = usage(spark, HOUR_USAGE, *data)
    days = rollups.daily_rebuild(hours, zone)
    back = rollups.rebucket_local_to_utc(hours, zone)
    for frame in (days, back):
        sums = [F.sum(c) for c in [*TOKENS, TOTAL]]
        assert frame.agg(*sums).first() == hours.agg(*sums).first()


def test_session_rollup(spark):
    def event(key, model, total, at, project=None):
        return {"device": "d", "source": "s", "event_key": key, "event_time": at, "usage_date": at and at.date(),
                "model": model, "session_id": "x", "project_path": project, INPUT: total, TOTAL: total}

    events = usage(spark, USAGE_EVENT, event("1", "a", 5, datetime(2024, 1, 1, 1)),
                   event("2", "b", 9, datetime(2024, 1, 1, 3), "late"),
                   event("3", "a", 5, datetime(2024, 1, 1, 2), "early"), event("4", "b", 0, None))
    (row,) = rollups.session_rollup(events).collect()
    assert (row.model, row.project_path, row.last_activity, row[TOTAL]) == (
        "a", "early", datetime(2024, 1, 1, 3), 19)
    assert rollups.hour_rollup(events).agg(F.sum(REQUESTS)).first()[0] == 3


def test_hours_keep_the_highest_counter(spark):
    day = date(2024, 1, 1)
    old = usage(spark, HOUR_USAGE, {**hour(day, 1, 10), OUTPUT: 20})
    new = usage(spark, HOUR_USAGE, {**hour(day, 1, 15), OUTPUT: 5}, hour(day, 2, 1))
    got = {r.hour: (r[INPUT], r[OUTPUT]) for r in merge.upsert_hours(old, new).collect()}
    assert got == {1: (15, 20), 2: (1, 0)}


AS_OF, LOCKED = date(2024, 1, 10), datetime(2024, 1, 10, 9)


def daily(day, total, cost, lock=None):
    return {"device": "d", "source": "s", "usage_date": day, "model": "m", INPUT: total, TOTAL: total,
            COST: cost, "pricing_locked_at": lock}


@pytest.mark.parametrize(("old", "new", "want"), [
    ((date(2024, 1, 9), 9, 1.0, datetime(2024, 1, 9)), (5, 2.0), (5, 1.0, datetime(2024, 1, 9))),
    ((date(2024, 1, 9), 9, 1.0, None), (5, 2.0), (5, 1.0, LOCKED)),
    ((AS_OF, 9, 1.0, None), (5, 0.0), (5, 1.0, None)),
    ((AS_OF, 9, 1.0, None), (5, 2.0), (5, 2.0, None)),
    (None, (5, 2.0), (5, 2.0, None)),
    ((AS_OF, 9, 1.0, None), None, (9, 1.0, None)),
])
def test_price_lock(spark, old, new, want):
    day = old[0] if old else AS_OF
    stored = usage(spark, DAILY_USAGE, *([daily(*old)] if old else []))
    incoming = usage(spark, DAILY_USAGE, *([daily(day, *new)] if new else []))
    (row,) = merge.upsert_daily(stored, incoming, AS_OF, LOCKED).collect()
    assert (row[TOTAL], row[COST], row.pricing_locked_at) == want


def test_first_insert_of_a_past_day_is_locked(spark):
    (row,) = merge.upsert_daily(usage(spark, DAILY_USAGE), usage(spark, DAILY_USAGE, daily(date(2024, 1, 1), 1, 2.0)),
                                AS_OF, LOCKED).collect()
    assert row.pricing_locked_at == LOCKED


def prices(spark, *data):
    return spark.createDataFrame([(k, *map(float, r), datetime(2024, 1, 1)) for k, *r in data], MODEL_PRICING)


def test_prices_keep_positive_rates(spark):
    merged = merge.upsert_prices(prices(spark, ("a", 3, 15, 0, 0)), prices(spark, ("a", 0, 20, -1, 0), ("b", 0, 1, 0, 0)))
    assert {r.model_key: tuple(r[c] for c in RATES) for r in merged.collect()} == {
        "a": (3, 20, 0, 0), "b": (0, 1, 0, 0)}


def test_merge_takes_the_last_arrival(spark):
    empty = spark.createDataFrame([], "k string, v string, n int")
    incoming = spark.createDataFrame([("a", "x", 1), ("a", "z", 3), ("a", "y", 2), ("b", None, 1)], empty.schema)
    got = merge.merge_upsert(empty, incoming, ["k"], {"v": merge.REPLACE}, ["n"])
    assert sorted(map(tuple, got.collect())) == [("a", "z"), ("b", None)]


def test_device_remap_keeps_the_target_row(spark):
    schema = "device string, key string, v int"
    rows = spark.createDataFrame([("host", "dup", 1), ("uuid", "dup", 2), ("host", "new", 3), ("zz", "new", 4)], schema)
    mapping = spark.createDataFrame([("host", "uuid"), ("zz", "uuid")], "device string, device_id string")
    once = merge.remap_devices(rows, mapping, ["device", "key"])
    assert sorted(map(tuple, once.collect())) == [("uuid", "dup", 2), ("uuid", "new", 3)]
    assert sorted(map(tuple, merge.remap_devices(once, mapping, ["device", "key"]).collect())) == sorted(
        map(tuple, once.collect()))


def test_events_that_move_to_another_day(spark, tmp_path):
    def event(key, day, total):
        return {"device": "d", "source": "s", "event_key": key, "usage_date": day, INPUT: total, TOTAL: total}

    path, first, second = str(tmp_path / "event"), date(2024, 1, 1), date(2024, 1, 2)
    for batch in ([event("a", first, 1), event("b", second, 2), event("n", None, 3)],
                  [event("a", second, 5)], [event("n", first, 4)], [event("u", None, 8)], [event("v", None, 9)]):
        merge.merge_into_table(path, usage(spark, USAGE_EVENT, *batch), ["device", "source", "event_key"],
                               merge.upsert_events)
    got = sorted((r.event_key, str(r.usage_date), r[TOTAL]) for r in spark.read.schema(USAGE_EVENT).parquet(path).collect())
    assert got == [("a", "2024-01-02", 5), ("b", "2024-01-02", 2), ("n", "2024-01-01", 4), ("u", "None", 8),
                   ("v", "None", 9)]


LISTED = [("claude-sonnet-4", 3e-6, 15e-6, 0, 0), ("openai/gpt-5", 1, 2, 0, 0), ("gemini/gemini-2.5-pro", 1, 2, 0, 0),
          ("openrouter/gemini/gemini-2.5-pro", 1, 2, 0, 0), ("deepseek/deepseek-chat", 1, 2, 0, 0),
          ("Big-Model", 1, 2, 0, 0), ("b/zeta-one-9", 1, 2, 0, 0), ("a/zeta-one-9", 1, 2, 0, 0),
          ("github_copilot/only-here", 1, 2, 0, 0)]


def test_resolve_prices(spark):
    want = {
        "claude-sonnet-4": ("claude-sonnet-4", "exact"), "claude-sonnet-4-5": ("claude-sonnet-4", "exact"),
        "gpt-5": ("openai/gpt-5", "exact"), "gpt-5-mini-high": ("openai/gpt-5", "exact"),
        "deepseek-chat": ("deepseek/deepseek-chat", "exact"), "gemini-2.5-pro": ("gemini/gemini-2.5-pro", "fuzzy"),
        "big-model": ("Big-Model", "exact"), "zeta-one": ("a/zeta-one-9", "fuzzy"), "zeta-one-9-x": ("a/zeta-one-9", "fuzzy"),
        "zeta": None, "only-here": None, "my-local-model": None,
    }
    models = spark.createDataFrame([(m,) for m in want], "model string")
    got = {r.model: (r.price_key, r.match) for r in pricing.resolve_prices(models, prices(spark, *LISTED)).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_cost_ignores_invalid_rates_and_unknown_models(spark):
    rates = spark.createDataFrame([("a", 1.0, 2.0, float("nan"), -1.0), ("b", float("inf"), 1.0, 1.0, 1.0)],
                                  "model string, " + ", ".join(f"{r} double" for r in RATES))
    rows = usage(spark, HOUR_USAGE, *[{"model": m, **dict.fromkeys(TOKENS, 10)} for m in ("a", "b", "c")]).drop(COST)
    got = {r.model: r[COST] for r in pricing.price_events(rows, rates).collect()}
    assert got == {"a": 50.0, "b": 40.0, "c": 0.0}


def test_lookup_without_broadcast_gives_the_same(spark):
    facts = spark.range(1000).selectExpr("id % 7 AS k", "id")
    dim = spark.range(5).selectExpr("id AS k", "id * 10 AS v")
    hinted = lookup.sized_for_broadcast(dim)
    plain = lookup.sized_for_broadcast(dim, max_rows=3)
    assert sorted(facts.join(hinted, "k", "left").collect()) == sorted(facts.join(plain, "k", "left").collect())
    assert plain is dim and hinted is not dim


def test_global_rank_over_many_partitions(spark):
    frame = spark.range(5000).selectExpr("cast(id * 7919 % 977 as bigint) AS total", "id").repartition(13)
    ranked = ranking.with_global_rank(frame, F.desc("total"), F.asc("id")).orderBy("rank").collect()
    want = sorted(((n * 7919 % 977, n) for n in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.total, r.id) for r in ranked] == want
    assert [r["rank"] for r in ranked] == list(range(1, 5001))


def test_activity(spark):
    rows = usage(spark, DAILY_USAGE, *[daily(date(2024, 1, d), 1, 0.0) for d in (1, 2, 6)])
    (row,) = series.activity_stats(rows, date(2024, 1, 1), date(2024, 1, 7)).collect()
    assert (row.active_buckets, row.longest_gap) == (3, 3)
    (none,) = series.activity_stats(rows.where("false"), date(2024, 1, 1), date(2024, 1, 7)).collect()
    assert (none.active_buckets, none.longest_gap) == (0, 7)


def test_spans():
    day = date(2024, 3, 15)
    assert filters.range_span("lastMonth", day) == (date(2024, 2, 1), date(2024, 2, 29))
    assert filters.compare_span("month", *filters.range_span("month", day)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert filters.compare_span("7d", *filters.range_span("7d", day)) == (date(2024, 3, 2), date(2024, 3, 8))
    assert filters.compare_span("today", day, day) == (date(2024, 3, 14), date(2024, 3, 14))
    assert filters.detail_range("custom", day, (date(2024, 1, 1), date(2024, 1, 2))) == (date(2024, 1, 1), date(2024, 1, 2))
    assert filters.range_span("all", day) is None


def test_kpis_without_rows(spark):
    row = series.kpi_totals(usage(spark, DAILY_USAGE)).first()
    assert row[TOTAL] == 0 and row.cache_hit_pct == 0.0


def test_manifest_states(spark):
    listing = spark.createDataFrame([("same", "1:5", 5), ("grew", "2:9", 9), ("shrunk", "2:3", 3), ("new", "1:1", 1)],
                                    "file_path string, fingerprint string, size bigint")
    known = spark.createDataFrame([("same", "1:5", 5), ("grew", "1:5", 5), ("shrunk", "1:5", 5)],
                                  "file_path string, fingerprint string, last_offset bigint")
    states = manifest.changed_files(listing, known)
    assert {r.file_path: (r.state, r.start_offset) for r in states.collect()} == {
        "same": ("CACHED", 0), "grew": ("INCREMENTAL", 5), "shrunk": ("PARSE", 0), "new": ("PARSE", 0)}
    assert not manifest.all_cached(states).first()[0]
    assert manifest.all_cached(states.where("state = 'CACHED'")).first()[0]
    assert not manifest.all_cached(states.where("false")).first()[0]


def test_devices(spark):
    known = spark.createDataFrame([("a", "host", "", True)], DEVICES)
    names = spark.createDataFrame([("a", "x"), ("b", "y"), ("", "z")], "device_id string, name string")
    assert [tuple(r) for r in merge.new_devices(names, known).collect()] == [("b", "", "y", False)]
    rows = usage(spark, HOUR_USAGE, {"device": "a"}, {"device": "q"})
    assert {r.device: r.device_name for r in merge.with_device_name(rows, known).collect()} == {"a": "host", "q": "q"}


def test_quota_text_without_login(spark):
    bodies = spark.createDataFrame([("a", "see /auth/authorize"), ("b", "rollingUsage:$R[1]={usagePercent:5}")],
                                   "config_id string, body string")
    got = [(r.config_id, r.slot, r.usage_pct) for r in quota.quota_slots_text(bodies).collect()]
    assert got == [("b", "5h", 5), ("b", "week", 0), ("b", "month", 0)]
