"""Scans of log trees into line frames."""

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.identity import plain_path
from tallyhouse.operators.carry import CHUNK_BITS

JSONL = "*.[jJ][sS][oO][nN][lL]"
ZSTD_JSONL = "*.[jJ][sS][oO][nN][lL].[zZ][sS][tT][dD]"
SESSION_DOC = "*.[jJ][sS][oO][nN]"

#: Listed files come from a listing just made; so many are not looked up one by one again.
MANY_PATHS = 100

_LINES = "path string, block bigint, chunk bigint, pos bigint, value string"


def literal(path: str) -> str:
    """The path as a pattern that names this path and no other."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _exists(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _read(spark: SparkSession, paths: list[str], glob: str, recursive: bool, **options) -> DataFrame | None:
    """One reader over all paths that exist; None if none does."""
    found = [p for p in paths if _exists(spark, p)] if len(paths) < MANY_PATHS else paths
    if not found:
        return None
    return spark.read.format("text").options(
        recursiveFileLookup=recursive, pathGlobFilter=glob, **options).load(found)


def _lines(raw: DataFrame) -> DataFrame:
    pos = F.monotonically_increasing_id()
    return raw.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"), pos.alias("pos"),
    ).select("path", "block", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "value")


def _scan(spark: SparkSession, paths: list[str], glob: str, recursive: bool = True, **options) -> DataFrame:
    raw = _read(spark, paths, glob, recursive, **options)
    return spark.createDataFrame([], _LINES) if raw is None else _lines(raw)


def scan_jsonl_tree(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of every ``*.jsonl`` below the paths. Absent paths are skipped; a file that cannot be
    read to its end fails the scan."""
    return _scan(spark, paths, JSONL)


def scan_zstd_tree(spark: SparkSession, paths: list[str], torn: bool = True, glob: str = ZSTD_JSONL) -> DataFrame:
    """Lines of compressed logs. Concatenated frames are read through. A log that is being written ends
    in a torn frame: with ``torn`` what comes before the damage is read, and at most an incomplete
    line remains, which the parsers drop; without it such a file fails the scan."""
    return _scan(spark, paths, glob, ignoreCorruptFiles=torn)


def scan_log_files(spark: SparkSession, names: list[str], torn: bool = False) -> DataFrame:
    """Lines of the named files, plain or compressed, by one reader. Names are taken as they are."""
    return _scan(spark, [literal(n) for n in names], "*", ignoreCorruptFiles=torn)


def scan_session_docs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines of ``.jsonl`` files, whole ``.json`` documents) of the two session layouts:
    ``<path>/*/chats/*`` and ``<path>/session-*``."""
    root = path.rstrip("/")
    lines = [f"{root}/*/chats/{JSONL}", f"{root}/session-{JSONL}"]
    docs = [f"{root}/*/chats/{SESSION_DOC}", f"{root}/session-{SESSION_DOC}"]
    return _scan(spark, lines, "*", recursive=False), _documents(spark, docs)


def _documents(spark: SparkSession, globs: list[str]) -> DataFrame:
    raw = _read(spark, globs, "*", False, wholetext=True)
    if raw is None:
        return spark.createDataFrame([], "path string, value string")
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")


def scan_documents(spark: SparkSession, names: list[str]) -> DataFrame:
    """The named files as whole documents; those that are absent are skipped."""
    return _documents(spark, [literal(n) for n in names])


def file_listing(spark: SparkSession, paths: list[str], glob: str = JSONL) -> DataFrame:
    """(file_path, fingerprint, size) of the files below the paths, without their content."""
    found = []
    for path in paths:
        try:
            found.append(
                spark.read.format("binaryFile")
                .options(recursiveFileLookup=True, pathGlobFilter=glob).load(path)
            )
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return spark.createDataFrame([], "file_path string, fingerprint string, size bigint")
    files = reduce(DataFrame.unionByName, found)
    stamp = F.concat_ws(":", F.unix_millis("modificationTime"), "length")
    return files.select(
        F.col("path").alias("file_path"), stamp.alias("fingerprint"), F.col("length").alias("size")
    )
