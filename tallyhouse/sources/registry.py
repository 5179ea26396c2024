"""Log kinds by source label: how to scan a tree and how to turn its lines into events."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.sources.claude import parse_claude_log
from tallyhouse.sources.codex import parse_codex_log
from tallyhouse.sources.dsh import parse_dsh_log, project_folders
from tallyhouse.sources.events import EVENT_COLUMNS
from tallyhouse.sources.files import (
    scan_documents, scan_jsonl_tree, scan_session_docs, scan_zstd_tree,
)
from tallyhouse.sources.gemini import parse_gemini_jsonl, parse_gemini_session, parse_gemini_stats
from tallyhouse.sources.openclaw import parse_openclaw_log


#: Events of the logs below one root; zone-less stamps are in the given time zone.
LogKind = Callable[[SparkSession, str, str], DataFrame]


def _claude(spark: SparkSession, root: str, tz: str) -> DataFrame:
    return parse_claude_log(scan_jsonl_tree(spark, [root]), root, tz)


def _codex(spark: SparkSession, root: str, tz: str) -> DataFrame:
    return parse_codex_log(scan_jsonl_tree(spark, [root]), tz)


def _gemini(spark: SparkSession, root: str, tz: str) -> DataFrame:
    lines, docs = scan_session_docs(spark, root)
    parts = [parse_gemini_jsonl(lines, tz), parse_gemini_session(docs, tz), parse_gemini_stats(docs, tz)]
    return reduce(DataFrame.unionByName, [p.select(*EVENT_COLUMNS) for p in parts])


def _openclaw(spark: SparkSession, root: str, tz: str) -> DataFrame:
    return parse_openclaw_log(scan_jsonl_tree(spark, [root]), tz)


def _harness(spark: SparkSession, root: str, tz: str) -> DataFrame:
    """The home folder of the tool also holds the folders of its sessions."""
    folders = project_folders(scan_documents(spark, [f"{root.rstrip('/')}/{K.HARNESS_PROJECTS}"]))
    return parse_dsh_log(scan_zstd_tree(spark, [root]), folders)


LOG_KINDS: dict[str, LogKind] = {
    K.CLAUDE_CODE: _claude, K.CODEX_CLI: _codex, K.GEMINI_CLI: _gemini, K.OPENCLAW: _openclaw,
    K.DEEPSEEK_HARNESS: _harness,
}


def register_log_kind(source: str, kind: LogKind) -> None:
    LOG_KINDS[source] = kind


def union_collectors(parts: list[DataFrame], device: str) -> DataFrame:
    """Events of all collectors of one device, in one frame."""
    shaped = [p.select(*EVENT_COLUMNS) for p in parts]
    return reduce(DataFrame.unionByName, shaped).withColumn("device", F.lit(device))


def collect_logs(
    spark: SparkSession, trees: dict[str, list[str]], device: str, tz: str = "UTC"
) -> DataFrame:
    """Events of log trees, given as source label -> roots. Every root is parsed by itself, because
    projects are named after the folders below it."""
    return union_collectors(
        [LOG_KINDS[source](spark, root, tz) for source, roots in trees.items() for root in roots], device)
