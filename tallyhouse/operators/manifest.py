"""Which log files changed since the last run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.identity import parent_dir


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listing with a state: CACHED (same fingerprint), INCREMENTAL (grew beyond the stored
    offset) or PARSE (new, shrunk or rewritten). ``manifest``: file_path, fingerprint, last_offset."""
    known = manifest.select(
        "file_path", F.col("fingerprint").alias("_known"), F.col("last_offset").alias("_offset")
    )
    grew = (F.col("_offset") > 0) & (F.col("size") > F.col("_offset"))
    state = F.when(F.col("fingerprint") == F.col("_known"), "CACHED").when(
        grew, "INCREMENTAL").otherwise("PARSE")
    return listing.join(known, "file_path", "left").withColumn("state", state).withColumn(
        "start_offset", F.when(F.col("state") == "INCREMENTAL", F.col("_offset")).otherwise(F.lit(0))
    ).drop("_known", "_offset")


def all_cached(states: DataFrame) -> DataFrame:
    """One row: whether there are files and every one is unchanged."""
    unchanged = F.coalesce(F.min((F.col("state") == "CACHED").cast("int")), F.lit(0)) == 1
    return states.agg(unchanged.alias("all_cached"))


def changed_dirs(listing: DataFrame, dir_listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files in directories whose fingerprint changed; the others need no look at their files.

    ``dir_listing``: file_path (of the directory), fingerprint.
    """
    dirs = dir_listing.select(F.col("file_path").alias("dir"), "fingerprint")
    known = manifest.select(F.col("file_path").alias("dir"), "fingerprint")
    changed = dirs.join(known, ["dir", "fingerprint"], "left_anti").select("dir")
    return listing.withColumn("dir", parent_dir(F.col("file_path"))).join(
        changed, "dir", "left_semi"
    )


def manifest_rows(listing: DataFrame, source: str, updated_at) -> DataFrame:
    """Manifest rows of files that were read to their end."""
    return listing.select(
        F.lit(source).alias("source"), "file_path", "fingerprint",
        F.col("size").alias("last_offset"), F.lit(updated_at).cast("timestamp").alias("updated_at"),
    )
