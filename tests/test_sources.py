"""Log parsers on hand-written logs and files."""

import json
from datetime import datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyhouse.operators import carry
from tallyhouse.schemas import CACHE_READ, INPUT, OUTPUT, REASONING, TOKENS, TOTAL
from tallyhouse.sources import claude, codex, dsh, files, gemini, registry
from tallyhouse.sources.openclaw import parse_openclaw_log


def lines(spark, texts, path="/logs/p/w/s-1.jsonl", chunk_rows=2):
    """Line frame cut into chunks of very few lines."""
    data = [(path, 0, i // chunk_rows, i, t if isinstance(t, str) else json.dumps(t))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "path string, block bigint, chunk bigint, pos bigint, value string")


CLAUDE = """
{"type":"assistant","timestamp":"2026-08-01T10:00:00+08:00","requestId":"r1","message":{"id":"m1","model":"claude-sonnet-4-20250514","usage":{"input_tokens":10,"output_tokens":5,"cache_read_input_tokens":100}}}
{"type":"assistant","timestamp":"2026-08-01T10:00:01+08:00","requestId":"r1","message":{"id":"m1","model":"claude-sonnet-4-20250514","usage":{"input_tokens":10,"output_tokens":8,"thinking_tokens":3}}}
{"type":"user","timestamp":"2026-08-01T10:00:02+08:00","message":{"id":"m2"}}
{"type":"assistant","timestamp":"2026-08-01T10:00:03+08:00","message":{"id":"m3","model":"<synthetic>","usage":{"input_tokens":9}}}
{"type":"assistant","timestamp":"2026-08-01T10:00:04+08:00","message":{"model":"x","usage":{"input_tokens":-5}}}
{"type":"assist
""".strip().splitlines()


def test_claude(spark):
    (event,) = claude.parse_claude_log(lines(spark, CLAUDE), "/logs/p").collect()
    assert (event.event_time, event.model) == (datetime(2026, 8, 1, 2), "claude-sonnet-4")
    assert [event[c] for c in TOKENS] == [10, 8, 0, 100, 3] and event[TOTAL] == 118
    assert (event.session_id, event.project_path) == ("s-1", "w")


def test_lines_that_name_no_assistant_are_not_parsed(spark):
    """They are left out by their text; an escaped name is found, since the parser reads it."""
    plain = json.loads(CLAUDE[0])
    escaped = json.dumps({**plain, "type": "?"}).replace("?", "\\u0061ssistant")
    records = claude.claude_records(lines(spark, [*CLAUDE, escaped]))
    assert records.count() == 4
    scan = records._jdf.queryExecution().optimizedPlan().toString().split("from_json")[1]
    assert "Contains(value" in scan


def usage(i, o, c, r):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "reasoning_output_tokens": r}


def count(total=None, last=None):
    info = {"total_token_usage": total and usage(*total), "last_token_usage": last and usage(*last)}
    return {"type": "event_msg", "timestamp": "2026-08-01T00:00:00Z",
            "payload": {"type": "token_count", "info": {k: v for k, v in info.items() if v}}}


CODEX = [
    {"type": "turn_context", "payload": {"model": "gpt-5"}}, count((100, 10, 40, 2)), count((100, 10, 40, 2)),
    count((150, 15, 60, 2)), count((20, 0, 0, 0)), count((30, 1, 0, 0)),
    {"type": "turn_context", "payload": {"model_info": {"slug": "gpt-5-mini"}}},
    count((35, 6, 9, 0), (5, 5, 9, 0)),
]
CODEX_EVENTS = [(60, 10, 40, 2, "gpt-5"), (30, 5, 20, 0, "gpt-5"), (10, 1, 0, 0, "gpt-5"),
                (0, 5, 5, 0, "gpt-5-mini")]


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 100])
def test_codex_in_chunks_of_any_size(spark, chunk_rows):
    events = codex.parse_codex_log(lines(spark, CODEX, chunk_rows=chunk_rows))
    got = sorted(tuple(r) for r in events.select(INPUT, OUTPUT, CACHE_READ, REASONING, "model").collect())
    assert got == sorted(CODEX_EVENTS)


def test_carry_forward_equals_a_plain_scan(spark):
    data = [(f"/f{n % 2}", 0, n // 3, n, "v" if n % 5 == 0 else None, n) for n in range(60)]
    frame = spark.createDataFrame(data, "path string, block bigint, chunk bigint, pos bigint, mark string, n int")
    frame = frame.withColumn("seen", F.when(F.col("mark").isNotNull(), F.col("n")))
    carried = carry.carry_forward(frame, {"upto": "seen"}, {"before": "seen"})
    for r in carried.collect():
        own = [m for p, _, _, m, mark, _ in data if p == r.path and mark]
        assert r.upto == max([m for m in own if m <= r.pos], default=None)
        assert r.before == max([m for m in own if m < r.pos], default=None)


def test_gemini_jsonl(spark):
    tokens = {"input": 100, "cached": "30", "output": 20, "total": 120}
    texts = [
        {"type": "init", "session_id": "g-1", "model": "gemini-2.5-pro"},
        {"type": "gemini", "id": "a", "timestamp": "2026-08-01T00:00:00Z", "tokens": {"input": 1}},
        {"type": "gemini", "id": "a", "timestamp": "2026-08-01T00:00:01Z", "tokens": tokens},
        {"type": "gemini", "timestamp": "2026-08-01T00:00:02Z", "tokens": {"output": 7}},
        {"type": "result", "stats": {"models": {"x": {"tokens": {"input": 5}}, "y": {"tokens": {}}}}},
        {"result": {"stats": {"input_tokens": 3, "cached_tokens": 9}}}, "{torn",
    ]
    got = sorted(tuple(r) for r in gemini.parse_gemini_jsonl(lines(spark, texts)).select(
        "session_id", "model", INPUT, OUTPUT, CACHE_READ).collect())
    assert got == [("g-1", "gemini-2.5-pro", 0, 0, 9), ("g-1", "gemini-2.5-pro", 0, 7, 0),
                   ("g-1", "gemini-2.5-pro", 70, 20, 30), ("g-1", "x", 5, 0, 0)]


def test_gemini_documents(spark, tmp_path):
    message = {"type": "gemini", "model": "Gemini-X", "timestamp": "2026-08-01T00:00:00Z",
               "tokens": {"input": 10, "output": 2, "tool": 1}}
    (tmp_path / "p" / "chats").mkdir(parents=True)
    (tmp_path / "p" / "chats" / "a.json").write_text(
        json.dumps({"sessionId": "s", "messages": [message, {"type": "user"}]}, indent=1))
    (tmp_path / "session-1.json").write_text(json.dumps({"stats": {"input_tokens": 4, "output_tokens": 1}}))
    (tmp_path / "other.json").write_text(json.dumps({"stats": {"input_tokens": 400}}))
    (tmp_path / "session-2.jsonl").write_text(json.dumps({**message, "session_id": "j"}) + "\n")
    found, docs = files.scan_session_docs(spark, str(tmp_path))
    assert [tuple(r) for r in gemini.parse_gemini_session(docs).select("session_id", "model", INPUT).collect()] == [
        ("s", "gemini-x", 11)]
    (stats,) = gemini.parse_gemini_stats(docs).collect()
    assert (stats.session_id, stats.model, stats[INPUT], stats.event_time) == ("session-1", "unknown", 4, None)
    assert [r.session_id for r in gemini.parse_gemini_jsonl(found).collect()] == ["j"]


def test_harness_frames_whole_and_cut_off(spark, tmp_path):
    """Answers before the first session header belong to the folder; headers, contexts and sessions switch in between, an
    empty folder name changes nothing, and a last frame that is cut off takes nothing else with it."""
    def answer(seq, **usage):
        return {"type": "assistant/message", "seq": seq, "time": 1754900000000 + 1000 * seq, "data": {"usage": usage}}

    def header(model):
        return {"type": "request/header", "data": {"header": {"config": {"model": model}}}}

    frames = [
        [header("alpha-reasoner"), answer(31, inputTokens=12, cacheReadTokens=640)],
        [{"type": "session", "id": "blue-lake", "cwd": "/srv/notes"}, answer(40, outputTokens=9), answer(41, cacheReadTokens=77)],
        [{"type": "request/context", "data": {"model": "beta-coder"}}, answer(55, inputTokens=3, outputTokens=4)],
        [{"type": "session", "id": "red-hill", "cwd": ""}],
        [answer(56, inputTokens=2, outputTokens=2), header("gamma-writer"), answer(60, inputTokens=8, outputTokens=1, reasoningTokens=5)],
    ]
    pack = zstandard.ZstdCompressor()
    packed = [pack.compress("".join(json.dumps(r) + "\n" for r in f).encode()) for f in frames]
    for name, content in {"whole": b"".join(packed), "cut": b"".join([*packed, packed[2][:-7]])}.items():
        folder = tmp_path / name / "team" / "night-run"
        folder.mkdir(parents=True)
        (folder / "Session.JSONL.zstd").write_bytes(content)
        events = dsh.parse_dsh_log(files.scan_zstd_tree(spark, [str(tmp_path / name)])).orderBy("event_time").collect()
        assert [(e.event_key, e.model, e.project_path) for e in events] == [
            ("dsh::night-run::31", "alpha-reasoner", None), ("dsh::blue-lake::40", "alpha-reasoner", "/srv/notes"),
            ("dsh::blue-lake::55", "beta-coder", "/srv/notes"), ("dsh::red-hill::56", "beta-coder", "/srv/notes"),
            ("dsh::red-hill::60", "gamma-writer", "/srv/notes")]
        assert [(e[INPUT], e.output_tokens, e.cache_read_tokens, e.reasoning_output_tokens) for e in events] == [
            (12, 0, 640, 0), (0, 9, 0, 0), (3, 4, 0, 0), (2, 2, 0, 0), (8, 1, 0, 5)]


def test_scan_order_over_many_splits(spark, tmp_path):
    (tmp_path / "a b%").mkdir()
    log = tmp_path / "a b%" / "Big.JSONL"
    log.write_text("".join(f'{{"n":{n},"pad":"{"x" * 90}"}}\n' for n in range(4000)))
    (tmp_path / "skip.txt").write_text("no\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.scan_jsonl_tree(spark, [str(tmp_path), str(tmp_path / "absent")])
        got = found.orderBy(*carry.LINE_ORDER).select(F.get_json_object("value", "$.n").cast("int")).collect()
        blocks = found.select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in got] == list(range(4000)) and blocks > 10
    assert found.select("path").distinct().first()[0].endswith("/a b%/Big.JSONL")


def test_absent_roots_read_as_empty(spark, tmp_path):
    assert files.scan_jsonl_tree(spark, [str(tmp_path / "no")]).count() == 0
    assert files.file_listing(spark, [str(tmp_path / "no")]).count() == 0


def test_collect_logs_of_several_kinds(spark, tmp_path):
    for kind, texts in {"claude": CLAUDE, "codex": [json.dumps(x) for x in CODEX]}.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "s.jsonl").write_text("\n".join(texts))
    events = registry.collect_logs(spark, {
        "Claude Code": [str(tmp_path / "claude")], "Codex CLI": [str(tmp_path / "codex")]}, "dev")
    got = {r.source: r.n for r in events.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {"Claude Code": 1, "Codex CLI": 4}


def test_collect_logs_knows_projects_documents_and_folders(spark, tmp_path):
    claude_root, gemini_root, home = (tmp_path / n for n in ("claude", "gemini", "harness"))
    (claude_root / "proj-a" / "deep").mkdir(parents=True)
    (claude_root / "proj-a" / "deep" / "s.jsonl").write_text("\n".join(CLAUDE))
    message = {"type": "gemini", "model": "Gemini-X", "timestamp": "2026-08-01 07:00:00", "tokens": {"input": 10, "output": 2}}
    (gemini_root / "p" / "chats").mkdir(parents=True)
    (gemini_root / "p" / "chats" / "a.json").write_text(json.dumps({"sessionId": "s", "messages": [message]}))
    (gemini_root / "session-1.json").write_text(json.dumps({"stats": {"input_tokens": 4, "output_tokens": 1}}))
    (home / "storages").mkdir(parents=True)
    (home / "storages" / "session_projcache.json").write_text(
        json.dumps({"tables": {"sessions": {"sess-9": {"identity": {"cwd": "/code/nine"}}}}}))
    (home / "logs" / "sess-9").mkdir(parents=True)
    answer = {"type": "assistant/message", "seq": 1, "time": 1785542400000, "data": {"usage": {"inputTokens": 6, "outputTokens": 1}}}
    (home / "logs" / "sess-9" / "log.jsonl.zstd").write_bytes(zstandard.compress((json.dumps(answer) + "\n").encode()))
    events = registry.collect_logs(spark, {
        "Claude Code": [str(claude_root)], "Gemini CLI": [str(gemini_root)],
        "DeepSeek Harness": [str(home)]}, "dev", "+08:00")
    got = sorted((r.source, r.project_path, r.session_id, r[TOTAL], str(r.event_time)) for r in events.collect())
    assert [g[:4] for g in got] == [("Claude Code", "proj-a", "s", 118), ("DeepSeek Harness", "/code/nine", "sess-9", 7),
                                    ("Gemini CLI", "s", "s", 12), ("Gemini CLI", "session-1", "session-1", 5)]
    assert got[2][4] == "2026-07-31 23:00:00"


def test_openclaw_keeps_repeats(spark):
    line = {"type": "assistant", "model": "x", "timestamp": "2026-08-01 01:00:00", "usage": {"input_tokens": "4"}}
    assert parse_openclaw_log(lines(spark, [line, line, {"type": "assistant"}])).count() == 2
