"""Stored tables, exchange files, streams and manifests end to end."""

import json
from datetime import date, datetime

import pytest
import zstandard
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyhouse.operators import merge as mrg
from tallyhouse.operators.rollups import requests_of_touched_hours
from tallyhouse.plans import collect
from tallyhouse.plans.collect import UsageStore
from tallyhouse.plans.dashboard import Dashboard
from tallyhouse.schemas import DEVICES, INPUT, MODEL_PRICING, TOKENS, TOTAL
from tallyhouse.session import cut_lineage
from tallyhouse.sources import codex, transfer
from tallyhouse.sources.openclaw import parse_openclaw_log
from tallyhouse.streaming import jobs
from tallyhouse.streaming.cursors import follow
from tests.test_sources import CODEX, CODEX_EVENTS

NOW, AS_OF, TZ = datetime(2026, 8, 3, 9), date(2026, 8, 3), "+08:00"


@pytest.fixture
def store(spark, tmp_path):
    made = UsageStore(spark, str(tmp_path / "store"))
    made.write(prices=spark.createDataFrame([("gpt-5", 1.0, 1.0, 0.0, 0.0, NOW)], MODEL_PRICING))
    return made


def land(folder, name, texts, stamp=None):
    folder.mkdir(parents=True, exist_ok=True)
    file = folder / name
    file.write_text("".join(json.dumps(t) + "\n" for t in texts))


def stream(spark, tmp_path, store):
    jobs.collect_landed(spark, str(tmp_path / "landing"), str(tmp_path / "checkpoint"), store, jobs.CODEX, "dev", TZ, AS_OF, NOW)


def stamped(n, record):
    return {**record, "timestamp": f"2026-08-01T00:00:{n:02d}Z"}


def test_stream_equals_batch(spark, tmp_path, store):
    """Codex segments that land in three runs continue model and totals."""
    texts = [stamped(n, r) for n, r in enumerate(CODEX)]
    for n, part in enumerate((texts[:3], texts[3:5], texts[5:])):
        land(tmp_path / "landing" / "sess-1", f"{n:04d}.jsonl", part)
        stream(spark, tmp_path, store)
    got = store.read("event").select(
        INPUT, "output_tokens", "cache_read_tokens", "reasoning_output_tokens", "model").collect()
    assert sorted(map(tuple, got)) == sorted(CODEX_EVENTS)
    day = store.read("daily").groupBy("usage_date").agg(F.sum(TOTAL).alias("t"), F.sum("request_count").alias("n")).collect()
    assert [tuple(r) for r in day] == [(date(2026, 8, 1), sum(sum(e[:3]) for e in CODEX_EVENTS), 4)]
    assert store.read("session").count() == 1


def test_replayed_batch_starts_from_the_same_state(spark, tmp_path):
    """A stream that is stopped between a batch and its commit runs the batch again, from the state before it."""
    texts, seen = [stamped(n, r) for n, r in enumerate(CODEX)], []

    def run():
        def collect(batch, number):
            seen.append((number, sorted(map(tuple, jobs.CODEX.events(batch).select(INPUT, "output_tokens", "model").collect()))))

        lines = jobs.segment_lines(jobs.stream_lines(spark, str(tmp_path / "landing")))
        jobs.CODEX.states(lines).writeStream.foreachBatch(collect).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    land(tmp_path / "landing" / "s", "0.jsonl", texts[:4])
    run()
    land(tmp_path / "landing" / "s", "1.jsonl", texts[4:])
    run()
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert [n for n, _ in seen] == [0, 1, 1]
    assert seen[1] == seen[2] == (1, [(0, 5, "gpt-5-mini"), (10, 1, "gpt-5")])


def claw(n, total):
    return {"type": "assistant", "model": "gpt-5", "timestamp": f"2026-08-02T{n:02d}:00:00Z",
            "usage": {"input_tokens": total}}


def test_growing_files_are_read_again_whole(spark, tmp_path, store):
    logs = tmp_path / "logs"
    land(logs, "a.jsonl", [claw(1, 10)])
    land(logs, "b.jsonl", [claw(2, 20)])
    arguments = (spark, store, "OpenClaw", [str(logs)], parse_openclaw_log, "dev", TZ, AS_OF, NOW)
    assert jobs.collect_changed_files(*arguments, round_bytes=1).files == 2
    assert jobs.collect_changed_files(*arguments).files == 0
    land(logs, "a.jsonl", [claw(1, 10), claw(18, 5)])
    assert jobs.collect_changed_files(*arguments).files == 1
    days = {r.usage_date: (r[TOTAL], r.cost_usd) for r in store.read("daily").collect()}
    assert days == {date(2026, 8, 2): (30, 30.0), date(2026, 8, 3): (5, 5.0)}
    assert store.read("manifest").count() == 2


def bundle_source(spark, store):
    events = spark.createDataFrame(
        [("d", "Codex CLI", "k", datetime(2026, 8, 1, 1), "gpt-5", "s", 7, 7)],
        "device string, source string, event_key string, event_time timestamp, model string, session_id string, "
        "input_tokens bigint, total_tokens bigint").withColumns(
        {**{c: F.lit(0).cast("bigint") for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens",
                                                 "reasoning_output_tokens")},
         "usage_date": F.to_date("event_time"), "project_path": F.lit(None).cast("string")})
    store.collect(events, TZ, AS_OF, NOW)
    store.write(devices=spark.createDataFrame([("d", "host", "", True)], DEVICES))


def test_import_twice_changes_nothing(spark, tmp_path, store):
    bundle_source(spark, store)
    path = str(tmp_path / "bundle")
    transfer.write_export_bundle(path, store.read("hour"), store.read("daily"), store.read("session"),
                                 store.read("devices"), "2026-08-03T00:00:00Z")
    bundle = transfer.load_export_bundle(spark, path)
    layers = {"hour": bundle["hourUsage"], "daily": bundle["dailyUsage"], "session": bundle["sessionUsage"]}
    target = UsageStore(spark, str(tmp_path / "other"))
    first = target.import_usage(layers, bundle["deviceNames"], AS_OF, NOW)
    second = target.import_usage(layers, bundle["deviceNames"], AS_OF, NOW)
    assert first == {"hour": 1, "daily": 1, "session": 1, "devices": 1}
    assert second == {**first, "devices": 0}
    for name in ("hour", "daily", "session"):
        assert target.read(name).agg(F.count("*"), F.sum(TOTAL)).first() == (1, 7)
    assert target.read("devices").first().display_name == "host"
    target.reset()
    assert target.read("hour").count() == 0 and target.read("devices").count() == 1


def test_single_file_bundle_and_rejection(spark, tmp_path):
    row = {"device": "d", "source": "s", "usageDate": "2026-08-01", "hour": 3, "model": "m", "totalTokens": 4}
    good = {"format": "other-format", "version": 1, "deviceNames": {"d": "Desk"}, "hourUsage": [row, {**row, "hour": 4, "totalTokens": None, "costUsd": 0.25, "more": [1]}],
            "dailyUsage": None, "more": {"a": 1}}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(good, indent=2))
    bundle = transfer.load_export_bundle(spark, str(path), ("other-format",))
    hours = [(r.usage_date, r.hour, r.total_tokens) for r in bundle["hourUsage"].orderBy("hour").collect()]
    assert hours == [(date(2026, 8, 1), 3, 4), (date(2026, 8, 1), 4, None)]
    assert [tuple(r) for r in bundle["deviceNames"].collect()] == [("d", "Desk")]
    assert bundle["dailyUsage"].isEmpty() and bundle["sessionUsage"].isEmpty()
    plan = bundle["hourUsage"]._jdf.queryExecution().toString()
    assert "variant_explode" in plan and "parse_json" not in plan, "the stored document is not parsed again"
    for text in (json.dumps({**good, "format": "x"}), json.dumps({**good, "version": 2}), "not json"):
        path.write_text(text)
        with pytest.raises(transfer.BundleRejected):
            transfer.load_export_bundle(spark, str(path), ("other-format",))


def test_csv_quoting(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', 1), (None, 2)], "x string, y int")
    transfer.write_csv(rows, str(tmp_path / "csv"), {"x": "Name", "y": "N"})
    text = "".join(sorted(p.read_text() for p in (tmp_path / "csv").glob("part-*")))
    assert '"a,""b""",1' in text and ",2" in text and "Name,N" in text


def message_events(frame, cursor):
    kept = frame.where(F.col("time_created") >= cursor)
    zero = F.lit(0).cast("bigint")
    return kept.select(
        F.lit("d").alias("device"), F.lit("OpenCode").alias("source"), F.col("id").alias("event_key"),
        F.timestamp_millis("time_created").alias("event_time"),
        F.to_date(F.timestamp_millis("time_created")).alias("usage_date"), F.lit("gpt-5").alias("model"),
        F.lit(None).cast("string").alias("project_path"), F.lit("s").alias("session_id"),
        F.lit(3).cast("bigint").alias("input_tokens"), zero.alias("output_tokens"),
        zero.alias("cache_creation_tokens"), zero.alias("cache_read_tokens"),
        zero.alias("reasoning_output_tokens"), F.lit(3).cast("bigint").alias("total_tokens"))


def test_ranges_of_a_table_that_is_followed(spark, tmp_path):
    checkpoint = tmp_path / "progress"

    def new(*numbers, fail=False):
        seen = []

        def collect(low, high):
            seen.append((low, high))
            if fail:
                raise ValueError("lost")

        rows = spark.createDataFrame([(n,) for n in numbers], "n bigint")
        if fail:
            with pytest.raises(StreamingQueryException):
                follow(rows, F.col("n"), str(checkpoint), collect)
        else:
            assert follow(rows, F.col("n"), str(checkpoint), collect) == max([n for n in numbers if n is not None], default=None)
        return seen

    assert new() == [] and new(None) == []
    assert new(-3, 5, None) == [(None, 5)] and new(-3, 5, None) == []
    assert new(-3, 5, 5, None) == [(5, 5)], "one more row of the last number"
    assert new(-3, 5, 5, 9, fail=True) == [(5, 9)]
    assert new(-3, 5, 5, 9, 12) == [(5, 9), (9, 12)], "the range that failed comes again, then what arrived since"
    for name in ("3", ".3.crc"):
        (checkpoint / "commits" / name).unlink()
    assert new(-3, 5, 5, 9, 12) == [(9, 12)], "a driver lost before the commit"
    assert new() == []
    assert new(2, 4) == [(None, 4)], "a table that ends before the offset was replaced"
    assert new(2, 4, 7) == [(4, 7)]


def test_messages_are_collected_from_the_offset(spark, store):
    first, second = 1785542400000, 1785546000000
    seen = []

    def read(frame, cursor):
        seen.append(cursor)
        return message_events(frame, cursor)

    def collect(*messages):
        rows = spark.createDataFrame(list(messages), "id string, time_created bigint")
        newest = store.collect_table("opencode", rows, "time_created", read, TZ, AS_OF, NOW)
        return newest, store.read("event").count(), store.read("hour").agg(F.sum("total_tokens")).first()[0]

    assert collect(("m1", first)) == (first, 1, 3)
    assert collect(("m1", first), ("m2", first), ("far", 9_999_999_999_999)) == (9_999_999_999_999, 3, 9)
    store.reset()
    assert collect(("m8", first), ("m9", second)) == (second, 2, 6) and seen == [0, first, 0]


def test_requests_and_history_of_a_proxy_are_followed(spark, store):
    start = 1785542400
    columns = ("created_at bigint, app_type string, model string, data_source string, status_code int, input_tokens bigint,"
               " output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, total_cost_usd string")

    def collect(seconds, days):
        requests = spark.createDataFrame([(start + n, "claude", "gpt-5", "proxy", 200, 5, 0, 0, 0, "0") for n in seconds], columns)
        rollups = spark.createDataFrame(
            [(d, "cursor", "gpt-5", n, 0, 0, 0, "0") for d, n in days],
            "date string, app_type string, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint,"
            " cache_creation_tokens bigint, total_cost_usd string")
        store.collect_proxy(requests, rollups, "d", TZ, AS_OF, NOW)
        hours = {r.hour: (r.input_tokens, r.request_count) for r in store.read("hour").collect()}
        older = {r.usage_date.day: r.input_tokens for r in store.read("daily").where("usage_date < '2026-07-20'").collect()}
        return hours, older

    assert collect([0, 60], [("2026-07-01", 7)]) == ({0: (10, 2)}, {1: 7})
    # an hour split over two reads is whole, also by a request of the last second; days that were read are not read again
    assert collect([0, 60, 60, 120, 3600], [("2026-07-01", 100), ("2026/07/02", 8), ("never", 1)]) == (
        {0: (20, 4), 1: (5, 1)}, {1: 7, 2: 8})
    plan = requests_of_touched_hours(spark.createDataFrame([], columns), start + 60)._jdf.queryExecution().toString()
    assert str(start) in plan and "Join" not in plan


def test_codex_batch_is_the_reference_of_the_stream(spark):
    frame = spark.createDataFrame([("/s", 0, 0, i, json.dumps(t)) for i, t in enumerate(CODEX)],
                                  "path string, block bigint, chunk bigint, pos bigint, value string")
    assert codex.parse_codex_log(frame).count() == 4


def test_dashboard_views(spark, store):
    bundle_source(spark, store)
    board = Dashboard(store, AS_OF, TZ)
    assert board.daily().count() == board.model_ranking().count() == 1
    assert [(r.usage_date, r.hour) for r in board.hour_series().collect()] == [(date(2026, 8, 1), 9)]
    assert board.today_events().count() == 0 and board.sessions().count() == 1
    days, hours = board.model_series("gpt-5")
    assert (days.first()[TOTAL], hours.first().hour) == (7, 9)
    assert board.kpis("7d").first()[TOTAL] == board.kpis("all").first()[TOTAL] == 7
    assert board.in_range("7d", models=["none"]).count() == 0
    assert board.prices_in_use().first().has_price and board.heatmap().count() % 7 == 0
    board.override_price(spark.createDataFrame([("gpt-5", 9.0, 9.0, 0.0, 0.0, None)], MODEL_PRICING))
    assert [(r.model_key, r.input_rate, r.fetched_at) for r in board.prices("GPT").collect()] == [("gpt-5", 9.0, NOW)]
    board.delete_price(spark.createDataFrame([("gpt-5",)], "model_key string"))
    assert board.prices().count() == 0
    board.rename_device("d", "Desk")
    assert board.devices().first().display_name == "Desk"


def test_sessions_over_several_days_and_runs(spark, tmp_path, store):
    """A session that grows on another day is summed whole; other sessions stay."""
    logs = tmp_path / "landing" / "s-1"
    land(logs, "0.jsonl", [stamped(n, r) for n, r in enumerate(CODEX[:2])])
    stream(spark, tmp_path, store)
    later = [{**r, "timestamp": "2026-08-02T05:00:00Z"} for r in CODEX[2:]]
    land(logs, "1.jsonl", later)
    land(tmp_path / "landing" / "s-2", "0.jsonl", [stamped(n, r) for n, r in enumerate(CODEX[:2])])
    stream(spark, tmp_path, store)
    got = {r.project_path: (r[TOTAL], r.last_activity) for r in store.read("session").collect()}
    assert sorted(v[0] for v in got.values()) == [110, sum(sum(e[:3]) for e in CODEX_EVENTS)]
    assert max(v[1] for v in got.values()) == datetime(2026, 8, 2, 5)


def usage(rows):
    """Events of (key, time, model, session, tokens)."""
    out = []
    for key, time, model, session, n in rows:
        out.append(("d", "Codex CLI", key, time, time and time.date(), model, None, session, n, 0, 0, 0, 0, n))
    return out


USAGE = ("device string, source string, event_key string, event_time timestamp, usage_date date, model string, project_path string, "
         "session_id string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, "
         "reasoning_output_tokens bigint, total_tokens bigint")


def sums_of_layers(store):
    """Per layer what a key's tokens sum to."""
    def of(name, *keys):
        return {tuple(r)[:-1]: r[TOTAL] for r in store.read(name).groupBy(*keys).agg(F.sum(TOTAL).alias(TOTAL)).collect()}

    return of("hour", "usage_date", "hour", "model"), of("daily", "usage_date", "model"), of("session", "session_id")


@pytest.mark.parametrize("broken", [None, "session", "session_part"])
def test_moved_events_count_where_they_are(spark, store, monkeypatch, broken):
    """Events that change day, model, session or size, and one that loses its time; also after a rebuild that failed
    halfway and was repeated."""
    def at(day, hour):
        return datetime(2026, 8, day, hour)

    first = [("a", at(1, 1), "gpt-5", "s", 10), ("b", at(1, 1), "gpt-5", "s", 20), ("c", at(2, 2), "gpt-5", "s", 30),
             ("e", at(1, 5), "gpt-5", "r", 5), ("f", at(4, 5), "gpt-5", "q", 7)]
    store.collect(spark.createDataFrame(usage(first), USAGE), TZ, date(2026, 8, 1), NOW)
    again = [("a", at(3, 20), "gpt-5", "s", 10), ("b", at(1, 1), "gpt-5-mini", "s", 4), ("e", at(1, 5), "gpt-5", "t", 5),
             ("f", None, "gpt-5", "q", 7)]
    write = mrg.write_partitions

    def failing(rows, path, partition="usage_date"):
        if broken and path.endswith(f"/{broken}"):
            raise RuntimeError("lost")
        write(rows, path, partition)

    monkeypatch.setattr(mrg, "write_partitions", failing)
    moved = spark.createDataFrame(usage(again), USAGE)
    if broken:
        with pytest.raises(RuntimeError):
            store.collect(moved, TZ, date(2026, 8, 1), NOW)
        broken = None
        store.rebuild_pending(TZ, date(2026, 8, 1), NOW)
    else:
        store.collect(moved, TZ, date(2026, 8, 1), NOW)
    hours, days, sessions = sums_of_layers(store)
    d = date
    assert hours == {(d(2026, 8, 1), 1, "gpt-5-mini"): 4, (d(2026, 8, 1), 5, "gpt-5"): 5, (d(2026, 8, 2), 2, "gpt-5"): 30,
                     (d(2026, 8, 3), 20, "gpt-5"): 10}
    assert days == {(d(2026, 8, 1), "gpt-5-mini"): 4, (d(2026, 8, 1), "gpt-5"): 5, (d(2026, 8, 2), "gpt-5"): 30,
                    (d(2026, 8, 4), "gpt-5"): 10}
    assert sessions == {("s",): 44, ("t",): 5, ("q",): 7}
    assert store.read("pending").count() == 0
    back = [("f", at(4, 6), "gpt-5", "q", 7)]
    store.collect(spark.createDataFrame(usage(back), USAGE), TZ, date(2026, 8, 1), NOW)
    hours, days, sessions = sums_of_layers(store)
    assert hours[d(2026, 8, 4), 6, "gpt-5"] == 7 and days[d(2026, 8, 4), "gpt-5"] == 17 and sessions[("q",)] == 7


def test_usage_from_elsewhere_is_not_taken_back(spark, store):
    """An hour that a proxy counted higher keeps that value; days of sources without hours stay."""
    time = datetime(2026, 8, 1, 1)
    store.collect(spark.createDataFrame(usage([("a", time, "gpt-5", "s", 10), ("b", time, "gpt-5", "s", 1)]), USAGE), TZ, AS_OF, NOW)
    hours = store.read("hour").withColumn(INPUT, F.lit(50).cast("bigint")).withColumn(TOTAL, F.lit(50).cast("bigint"))
    store.merge_hours(cut_lineage(hours))
    days = store.read("daily").withColumn("source", F.lit("Hermes Agent"))
    store.merge_daily(cut_lineage(days), AS_OF, NOW)
    store.collect(spark.createDataFrame(usage([("a", datetime(2026, 8, 2, 1), "gpt-5", "s", 10)]), USAGE), TZ, AS_OF, NOW)
    hour = {r.usage_date: (r[TOTAL], r.request_count) for r in store.read("hour").collect()}
    assert hour == {date(2026, 8, 1): (50, 1), date(2026, 8, 2): (10, 1)}
    assert store.read("daily").where("source = 'Hermes Agent'").count() == 1


def test_an_unfinished_version_does_not_count(spark, store):
    """A small table that was being replaced when the driver was lost is as it was, and can be replaced again."""
    before = store.read("prices").collect()
    folder = store.path("prices")
    spark.createDataFrame([("lost", 1.0, 1.0, 0.0, 0.0, NOW)], MODEL_PRICING).write.parquet(f"{folder}/v-000000000002")
    mrg.remove_folder(spark, f"{folder}/v-000000000002/_SUCCESS")
    assert store.read("prices").collect() == before
    for n in (2.0, 3.0, 4.0):
        store.write(prices=spark.createDataFrame([("gpt-5", n, 1.0, 0.0, 0.0, NOW)], MODEL_PRICING))
        assert [r.input_rate for r in store.read("prices").collect()] == [n]
    assert len(store._versions("prices")) == 2 == len(store._versions("prices", complete=False))


def test_streams_start_anew_with_the_store(spark, tmp_path, store):
    land(tmp_path / "landing", "a.jsonl", [claw(1, 10)])
    arguments = (spark, str(tmp_path / "landing"), str(tmp_path / "checkpoint"), store, jobs.Increment(parse_openclaw_log), "dev", TZ, AS_OF, NOW)
    jobs.collect_landed(*arguments)
    assert store.read("event").count() == 1 and store.generation() == 0
    store.reset()
    assert store.generation() == 1 and store.read("event").count() == 0
    jobs.collect_landed(*arguments)
    assert store.read("event").count() == 1
    for name in ("event", "hour"):
        mrg.remove_folder(spark, store.path(name))
    jobs.collect_landed(*arguments)
    assert store.read("event").count() == 1 and store.generation() == 2


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    def part(n, rows):
        spark.createDataFrame(rows, "device string, source string, event_key string, event_time timestamp").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{n}"))

    part(0, [("d", "s", "a", datetime(2026, 8, 2))])
    read = spark.readStream.schema("device string, source string, event_key string, event_time timestamp").option(
        "recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with jobs.late_rows(spark) as late:
        for n in range(1, 4):
            query = jobs.deduplicated(read, "1 hour").writeStream.format("noop").option(
                "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert late.of(query) == (0 if n == 1 else 1)
            part(n, [("d", "s", f"late-{n}", datetime(2026, 8, 1)), ("d", "s", f"new-{n}", datetime(2026, 8, 2, 0, n))])


def test_no_file_is_lost(spark, tmp_path, store):
    """Names that look like patterns are read, a damaged file is reported and read again once repaired, and
    a round that has one still collects the others."""
    logs = tmp_path / "logs"
    names = ["a[id].jsonl", "b{1,2}.jsonl", "c*.jsonl", "d?.jsonl", "e%20+ f.jsonl", "f\\g.jsonl"]
    for n, name in enumerate(names):
        land(logs, name, [claw(n, 1)])
    pack = zstandard.ZstdCompressor()
    frames = [pack.compress((json.dumps(claw(10 + n, 100)) + "\n").encode()) for n in range(3)]
    whole, damaged = b"".join(frames), frames[0] + frames[1][:-6] + b"broken" + frames[2]
    (logs / "z.jsonl.zstd").write_bytes(damaged)
    arguments = (spark, store, "OpenClaw", [str(logs)], parse_openclaw_log, "dev", TZ, AS_OF, NOW, "*.jsonl*")
    first = jobs.collect_changed_files(*arguments)
    assert first.files == len(names) and [f.rsplit("/", 1)[-1] for f, _ in first.failed] == ["z.jsonl.zstd"]
    assert store.read("manifest").count() == len(names)
    assert store.read("event").where("total_tokens = 1").count() == len(names)
    again = jobs.collect_changed_files(*arguments)
    assert again.files == 0 and len(again.failed) == 1
    (logs / "z.jsonl.zstd").write_bytes(whole)
    assert jobs.collect_changed_files(*arguments) == jobs.Collected(1, [])
    assert store.read("event").where("total_tokens = 100").count() == 3
    assert jobs.collect_changed_files(*arguments) == jobs.Collected(0, [])


def test_a_round_notes_its_own_files_only(spark, tmp_path, store, monkeypatch):
    """The log of files grows by what a round read, keeps the newest state of a file, and is made one part now and then."""
    monkeypatch.setattr(collect, "LOG_PARTS", 4)
    schema = "source string, file_path string, fingerprint string, last_offset bigint, updated_at timestamp"

    def note(*names, mark="1"):
        store.note_files(spark.createDataFrame([("s", n, mark, 0, NOW) for n in names], schema))

    def parts():
        return {r.seq: r.n for r in store._log().groupBy("seq").agg(F.count("*").alias("n")).collect()}

    note(*map(str, range(50)))
    note("x", "y")
    note("x", mark="2")
    assert parts() == {1: 50, 2: 2, 3: 1}
    note("z")
    assert parts() == {5: 53} and store.read("manifest").count() == 53
    assert {r.file_path: r.fingerprint for r in store.read("manifest").where("file_path >= 'x'").collect()} == {"x": "2", "y": "1", "z": "1"}


def test_many_files_in_one_round(spark, tmp_path, store):
    logs = tmp_path / "logs"
    for n in range(300):
        land(logs / str(n % 7), f"{n}.jsonl", [claw(n % 24, n + 1)])
    arguments = (spark, store, "OpenClaw", [str(logs)], parse_openclaw_log, "dev", TZ, AS_OF, NOW)
    assert jobs.collect_changed_files(*arguments) == jobs.Collected(300, [])
    assert store.read("event").agg(F.sum(TOTAL)).first()[0] == 300 * 301 // 2


@pytest.mark.parametrize("broken", ["daily", "names"])
def test_a_failing_import_changes_nothing(spark, tmp_path, store, broken):
    bundle_source(spark, store)
    layers = {name: store.read(name) for name in ("hour", "daily", "session")}
    names = spark.createDataFrame([("new", "Desk")], "device_id string, name string")
    bad = {"daily": layers["daily"].withColumn("model", F.raise_error(F.lit("unreadable"))),
           "names": names.withColumn("name", F.raise_error(F.lit("unreadable")))}
    target = UsageStore(spark, str(tmp_path / "other"))
    target.write(devices=store.read("devices"))
    with pytest.raises(Exception, match="unreadable"):
        target.import_usage({**layers, **{k: v for k, v in bad.items() if k == broken}}, bad["names"] if broken == "names" else names,
                            AS_OF, NOW)
    assert [target.read(n).count() for n in ("hour", "daily", "session", "devices")] == [0, 0, 0, 1]
    assert target.import_usage(layers, names, AS_OF, NOW)["devices"] == 1
    assert [target.read(n).count() for n in ("hour", "daily", "session", "devices")] == [1, 1, 1, 2]


def test_notes_added_meanwhile_stay(spark, store, monkeypatch):
    bundle_source(spark, store)
    note = spark.createDataFrame([("d", "OpenClaw", date(2026, 8, 1))], "device string, source string, usage_date date")
    note.write.mode("append").parquet(store.path("pending"))
    rebuild = store.rebuild

    def slow(*arguments):
        note.write.mode("append").parquet(store.path("pending"))
        rebuild(*arguments)

    monkeypatch.setattr(store, "rebuild", slow)
    store.rebuild_pending(TZ, AS_OF, NOW)
    assert store.read("pending").count() == 1


@pytest.mark.parametrize("broken", [None, "daily", "event_hour"])
def test_devices_of_a_whole_store_are_mapped(spark, store, monkeypatch, broken):
    """Rows of the old id come under the new one, which keeps its own row of a key; other days are not written; a run that
    failed halfway is repeated, and a further one changes nothing."""
    def at(day):
        return datetime(2026, 8, day, 1)

    mine = usage([("a", at(1), "gpt-5", "s", 10), ("b", at(2), "gpt-5", "r", 20), ("n", None, "gpt-5", "q", 7)])
    new = [("uuid", *r[1:]) for r in usage([("a", at(3), "gpt-5", "s", 30), ("c", at(2), "gpt-5", "t", 4)])]
    other = [("else", *r[1:]) for r in usage([("a", at(9), "gpt-5", "u", 1)])]
    store.collect(spark.createDataFrame(mine + new + other, USAGE), TZ, date(2026, 8, 1), NOW)
    mapping = spark.createDataFrame([("d", "uuid"), ("else", "else")], "device string, device_id string")
    write, written = mrg.write_partitions, []

    def watched(rows, path, partition="usage_date"):
        if broken and path.endswith(f"/{broken}"):
            raise RuntimeError("lost")
        if partition == "usage_date":
            written.extend(r[0] for r in rows.select(partition).distinct().collect())
        write(rows, path, partition)

    monkeypatch.setattr(mrg, "write_partitions", watched)
    if broken:
        with pytest.raises(RuntimeError):
            store.remap_devices(mapping)
        broken = None
    for _ in range(2):
        store.remap_devices(mapping)
        events = {(r.device, r.event_key): r[TOTAL] for r in store.read("event").collect()}
        assert events == {("uuid", "a"): 30, ("uuid", "b"): 20, ("uuid", "c"): 4, ("uuid", "n"): 7, ("else", "a"): 1}
        hours = {(r.device, r.usage_date.day): r[TOTAL] for r in store.read("hour").collect()}
        assert hours == {("uuid", 1): 10, ("uuid", 2): 4, ("uuid", 3): 30, ("else", 9): 1}
        sessions = {(r.device, r.session_id): r[TOTAL] for r in store.read("session").collect()}
        assert sessions == {("uuid", "s"): 30, ("uuid", "r"): 20, ("uuid", "t"): 4, ("uuid", "q"): 7, ("else", "u"): 1}
        sums = {(r.device, r.usage_date and r.usage_date.day): r[TOTAL] for r in store.read("event_hour").collect()}
        assert {k: v for k, v in sums.items() if k[1]} == {("uuid", 2): 24, ("uuid", 3): 30, ("else", 9): 1}
        assert {r.device for r in store.read("session_part").collect()} == {"uuid", "else"}
        assert {r.device_id for r in store.read("devices").collect()} == {"uuid"}
    assert date(2026, 8, 9) not in written
    with pytest.raises(ValueError):
        store.remap_devices(spark.createDataFrame([("d", "uuid"), ("uuid", "x")], "device string, device_id string"))


def test_sources_of_a_run_are_merged_once(spark, store, monkeypatch):
    """Sources that share their days rewrite them once; of an event that two collectors give, the later one counts."""
    merges, stage = [], mrg.stage_merge

    def counted(path, *rest):
        merges.append(path.rsplit("/", 1)[-1])
        return stage(path, *rest)

    def usage(*events):
        rows = [("dev", source, key, datetime(2026, 8, 1, hour), date(2026, 8, 1), "gpt-5", "s", tokens) for source, key, hour, tokens in events]
        frame = spark.createDataFrame(rows, "device string, source string, event_key string, event_time timestamp, usage_date date, "
                                            "model string, session_id string, input_tokens bigint")
        zeros = {c: F.lit(0).cast("bigint") for c in TOKENS if c != INPUT}
        return lambda: frame.withColumns({**zeros, TOTAL: F.col(INPUT)})

    monkeypatch.setattr(mrg, "stage_merge", counted)
    broken = usage(("z", "1", 1, 5))().withColumn("event_key", F.raise_error(F.lit("damaged")).cast("string"))
    collectors = {"a": usage(("a", "1", 1, 10), ("a", "2", 2, 20)), "b": usage(("b", "1", 1, 7), ("a", "2", 3, 30)), "z": lambda: broken}
    rows = jobs.collect_run(store, collectors, TZ, AS_OF, NOW).drop("error").collect()
    assert merges.count("event") == 1
    assert sorted(map(tuple, rows)) == [("a", "ok", 3, 2, 1, 1), ("b", "ok", 1, 1, 1, 1), ("z", "error", 0, 0, 0, 0)]
    stored = store.read("event").select("source", "event_key", INPUT, "cost_usd").collect()
    assert sorted(map(tuple, stored)) == [("a", "1", 10, 10.0), ("a", "2", 30, 30.0), ("b", "1", 7, 7.0)]
