"""Merging incoming rows into the usage tables under each table's conflict rule."""

from datetime import date, datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.lookup import lookup_join, sized_for_broadcast
from tallyhouse.schemas import (
    COST, DAILY_KEYS, EVENT_KEYS, HOUR_KEYS, MEASURES, RATES, REQUESTS, SESSION_KEYS, TOKENS, TOTAL,
)
from tallyhouse.session import cut_lineage

REPLACE, GREATEST, POSITIVE = "replace", "greatest", "positive"


def key_hash(keys: list[str]) -> Column:
    """Put before grouping keys whose aggregates Spark sorts for: it compares numbers, and long keys only where these are equal."""
    return F.xxhash64(*keys).alias("_key_hash")


def merge_upsert(
    target: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str],
    arrival: list[str] | None = None,
) -> DataFrame:
    """Target after the incoming rows, one row per key.

    ``rules`` name what a conflict does to a column: REPLACE takes the newest row's value,
    GREATEST the largest, POSITIVE the newest positive one. ``arrival`` orders incoming rows of
    equal key. Rows of a frequent key are combined before the shuffle.
    """
    arrival = arrival or []
    columns = [*keys, *rules]
    nothing = [F.lit(None).cast(incoming.schema[c].dataType).alias(f"_{c}") for c in arrival]
    old = target.select(*columns, F.lit(0).alias("_side"), *nothing)
    new = incoming.select(*columns, F.lit(1).alias("_side"),
                          *[F.col(c).alias(f"_{c}") for c in arrival])
    newest = F.struct("_side", *[f"_{c}" for c in arrival])
    replaced = [c for c, rule in rules.items() if rule == REPLACE]
    aggregates = [F.max_by(F.struct(*replaced), newest).alias("_new")] if replaced else []
    for c, rule in rules.items():
        if rule == GREATEST:
            aggregates.append(F.max(c).alias(c))
        elif rule == POSITIVE:
            positive = F.max_by(c, F.when(F.col(c) > 0, newest))
            aggregates.append(F.coalesce(positive, F.min_by(c, newest)).alias(c))
    merged = old.unionByName(new).groupBy(key_hash(keys), *keys).agg(*aggregates)
    return merged.select(*[f"_new.{c}" if c in replaced else c for c in columns])


def upsert_events(
    target: DataFrame, incoming: DataFrame, arrival: list[str] | None = None
) -> DataFrame:
    """A repeated event replaces the stored one."""
    rules = {c: REPLACE for c in target.columns if c not in EVENT_KEYS}
    return merge_upsert(target, incoming, EVENT_KEYS, rules, arrival)


def upsert_hours(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each counter keeps its highest value, so native logs and proxy rows reconcile."""
    return merge_upsert(target, incoming, HOUR_KEYS, dict.fromkeys([*MEASURES, REQUESTS], GREATEST))


def retract_merge(
    target: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], measures: list[str],
    replaced: list[str] | None = None,
) -> DataFrame:
    """Target after rows summed from events were summed again, one row per key.

    ``before`` and ``after`` hold what the events of a key summed to and sum to now; a key that no event belongs to
    any more is in ``before`` alone. A counter that stands at its former sum, or below, came from the events and
    follows them, also down. One above it came from elsewhere (a proxy, an import) and keeps its highest value.
    ``replaced`` columns take the value of ``after`` where there is one. Rows left without any usage go. Doing it
    again changes nothing, also if the target already has the new values.
    """
    columns, replaced = target.columns, replaced or []
    sides = [target.select(*keys, F.struct(*[c for c in columns if c not in keys]).alias("_t"))]
    sides += [rows.select(*keys, F.struct(*measures, *(replaced if name == "_a" else [])).alias(name))
              for name, rows in (("_b", before), ("_a", after))]
    rows = sides[0].unionByName(sides[1], True).unionByName(sides[2], True)
    rows = rows.groupBy(key_hash(keys), *keys).agg(*[F.max(c).alias(c) for c in ("_t", "_b", "_a")])
    touched = F.col("_b").isNotNull() | F.col("_a").isNotNull()

    def counter(name: str) -> Column:
        zero = F.lit(0).cast(target.schema[name].dataType)
        stored, was, now = (F.coalesce(F.col(f"{side}.{name}"), zero) for side in ("_t", "_b", "_a"))
        slack = F.abs(was) * 1e-9 if name == COST else zero
        return F.when(~touched, F.col(f"_t.{name}")).when(stored <= was + slack, now).otherwise(F.greatest(stored, now))

    values = {c: counter(c) for c in measures}
    for c in columns:
        if c not in keys and c not in values:
            now = F.when(F.col("_a").isNotNull(), F.col(f"_a.{c}")) if c in replaced else F.lit(None)
            values[c] = F.coalesce(now, F.col(f"_t.{c}"))
    rows = rows.select(*keys, touched.alias("_touched"), *[v.alias(c) for c, v in values.items()])
    used = F.greatest(*[F.col(c).cast("double") for c in measures]) > 0
    return rows.where(~F.col("_touched") | used).select(*columns)


def upsert_sessions(
    target: DataFrame, incoming: DataFrame, arrival: list[str] | None = None
) -> DataFrame:
    rules = dict.fromkeys(["last_activity", "project_path", "model"], REPLACE)
    return merge_upsert(
        target, incoming, SESSION_KEYS, {**rules, **dict.fromkeys(MEASURES, GREATEST)}, arrival
    )


def upsert_daily(
    target: DataFrame, incoming: DataFrame, as_of: date, locked_at: datetime,
    arrival: list[str] | None = None,
) -> DataFrame:
    """Tokens are replaced; the cost of a past day is locked, and no cost is replaced by zero.

    ``as_of`` is today. A past day gets its lock time once, today's rows have none.
    """
    values = [*TOKENS, TOTAL, COST, REQUESTS]
    fields = F.struct(*values)
    lock = F.col("pricing_locked_at")
    old = target.select(*DAILY_KEYS, fields.alias("old"), lock.alias("old_lock"))
    order = F.struct(*arrival) if arrival else F.lit(0)
    new = incoming.select(*DAILY_KEYS, fields.alias("new"), order.alias("_order"))
    sides = old.unionByName(new, allowMissingColumns=True)
    rows = sides.groupBy(*DAILY_KEYS).agg(
        F.max("old").alias("old"), F.max("old_lock").alias("old_lock"),
        F.max_by("new", F.when(F.col("new").isNotNull(), F.col("_order"))).alias("new"),
    )
    was, now = F.col("old").isNotNull(), F.col("new").isNotNull()
    past = F.col("usage_date") < F.lit(as_of)
    keeps_cost = was & (~now | past | (F.col(f"new.{COST}") == 0))
    lock_now = F.when(past, F.coalesce("old_lock", F.lit(locked_at).cast("timestamp")))
    latest = F.when(now, F.col("new")).otherwise(F.col("old"))
    return rows.select(
        *DAILY_KEYS,
        *[latest[c].alias(c) for c in values if c not in (COST, REQUESTS)],
        F.when(keeps_cost, F.col(f"old.{COST}")).otherwise(F.col(f"new.{COST}")).alias(COST),
        latest[REQUESTS].alias(REQUESTS),
        F.when(now, lock_now).otherwise(F.col("old_lock")).alias("pricing_locked_at"),
    )


def upsert_prices(
    target: DataFrame, incoming: DataFrame, arrival: list[str] | None = None
) -> DataFrame:
    """A fetched rate replaces the stored one only if it is positive."""
    rules = {**dict.fromkeys(RATES, POSITIVE), "fetched_at": REPLACE}
    return merge_upsert(target, incoming, ["model_key"], rules, arrival)


def override_price(prices: DataFrame, edited: DataFrame) -> DataFrame:
    """User rates replace stored ones as they are; the fetch time of a known key stays."""
    key = "model_key"
    fetched = merge_upsert(edited.select(key, "fetched_at"), prices.select(key, "fetched_at"),
                           [key], {"fetched_at": REPLACE})
    return merge_upsert(prices, edited, [key], dict.fromkeys(RATES, REPLACE)).join(fetched, key)


def delete_price(prices: DataFrame, keys: DataFrame) -> DataFrame:
    return prices.join(keys.select("model_key"), "model_key", "left_anti")


def remap_devices(usage: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Usage under new device ids (``mapping``: device, device_id).

    Where a row of the new id already has the key, it survives; among several moved rows the
    one of the smallest old id does.
    """
    values = [c for c in usage.columns if c not in keys]
    moved = lookup_join(usage, mapping.select("device", "device_id"), "device")
    target = F.coalesce("device_id", "device")
    prefer = F.struct((target != F.col("device")).alias("moved"), F.col("device").alias("from"))
    others = [k for k in keys if k != "device"]
    return (
        moved.select(target.alias("_device"), *others, F.struct(*values).alias("_row"),
                     prefer.alias("_prefer"))
        .groupBy(F.col("_device").alias("device"), *others)
        .agg(F.min_by("_row", "_prefer").alias("_row"))
        .select(*keys, "_row.*").select(*usage.columns)
    )


def with_device_name(usage: DataFrame, devices: DataFrame) -> DataFrame:
    """Usage with the device's display name, else its host name, else its id."""
    def known(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column))

    names = devices.select(F.col("device_id").alias("device"),
                           F.coalesce(known("display_name"), known("hostname")).alias("_name"))
    return lookup_join(usage, names, "device").withColumn(
        "device_name", F.coalesce("_name", "device")
    ).drop("_name")


def new_devices(names: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices of an import (device_id, name) that are not registered yet."""
    fresh = names.where("device_id != ''").join(
        devices.select("device_id"), "device_id", "left_anti"
    )
    return fresh.groupBy("device_id").agg(F.max("name").alias("display_name")).select(
        "device_id", F.lit("").alias("hostname"), "display_name", F.lit(False).alias("is_local")
    )


def register_devices(names: DataFrame, devices: DataFrame) -> DataFrame:
    return devices.select("device_id", "hostname", "display_name", "is_local").unionByName(
        new_devices(names, devices)
    )


def rename_device(devices: DataFrame, device_id: str, display_name: str) -> DataFrame:
    named = F.when(F.col("device_id") == device_id, display_name).otherwise(F.col("display_name"))
    return devices.withColumn("display_name", named)


def prune_manifest(manifest: DataFrame, as_of: datetime, max_age_days: int, max_rows: int) -> DataFrame:
    """Manifest rows updated recently, the newest ``max_rows`` of them."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(max_age_days))
    recent = manifest.where(F.col("updated_at") >= oldest)
    return recent.orderBy(F.desc("updated_at"), "source", "file_path").limit(max_rows)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored usage table, empty before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_partitions(rows: DataFrame, path: str, partition: str = "usage_date") -> None:
    """Replace the partitions the rows belong to; a large day is split over several files."""
    (
        rows.hint("rebalance", F.col(partition)).write.mode("overwrite").partitionBy(partition)
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


MAX_LISTED_DAYS = 1000
NO_DAY_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the given days, so that only their partitions are read.

    Up to a thousand days become literals of the scan; more are joined.
    """
    days = days.where("usage_date IS NOT NULL").select("usage_date").distinct()
    listed = [r[0] for r in days.limit(MAX_LISTED_DAYS + 1).collect()]
    if len(listed) <= MAX_LISTED_DAYS:
        return rows.where(F.col("usage_date").isin(listed) if listed else F.lit(False))
    return rows.join(days, "usage_date", "left_semi")


class Staged(NamedTuple):
    """A merge that is computed and stored in the shared folder, and not yet in its table."""

    path: str
    incoming: DataFrame
    result: DataFrame
    partition: str
    emptied: list[str]
    #: (keys beside the day, day) of stored rows that the incoming ones replace, if the day is no key.
    replaced: DataFrame | None = None

    def commit(self) -> DataFrame:
        """Put the result into the table; gives the incoming rows, stored. Repeating it changes nothing."""
        write_partitions(self.result, self.path, self.partition)
        for folder in self.emptied:
            remove_folder(self.result.sparkSession, f"{self.path}/{folder}")
        return self.incoming


def emptied_folders(touched: DataFrame, result: DataFrame, partition: str = "usage_date") -> list[str]:
    """Partition folders of touched rows that the result has no row for; at most one per touched partition."""
    folder = F.coalesce(F.col(partition).cast("string"), F.lit(NO_DAY_FOLDER)).alias("folder")
    gone = touched.select(folder).distinct().join(result.select(folder).distinct(), "folder", "left_anti")
    return [f"{partition}={r[0]}" for r in gone.collect()]


def stage_merge(path: str, incoming: DataFrame, keys: list[str], merge) -> Staged:
    """Merge incoming rows with a table partitioned by usage_date, of which only touched days change.

    ``merge(target, incoming)`` gives the merged rows. Touched are the incoming days and, where
    the key does not contain the day, the days on which an incoming key is stored; rows without
    a day form a partition of their own. The result is stored in the shared folder first,
    because a plan cannot overwrite what it reads; a run that fails in between is repeated from
    the same inputs with the same result.
    """
    spark, day = incoming.sparkSession, "usage_date"
    incoming = cut_lineage(incoming)
    stored = read_table(spark, path, incoming.schema)
    days, left = incoming.select(day), None
    if day not in keys:
        again = sized_for_broadcast(incoming.select(*keys))
        left = cut_lineage(
            stored.select(*keys, day).join(again, keys, "left_semi").select(*keys[:-1], day).distinct())
        days = days.unionByName(left.select(day))
    touched = on_days(stored, days).unionByName(stored.where(F.col(day).isNull()))
    result = cut_lineage(merge(touched, incoming))
    return Staged(path, incoming, result, day, [] if left is None else emptied_folders(left, result), left)


def merge_into_table(path: str, incoming: DataFrame, keys: list[str], merge) -> DataFrame:
    """Merge incoming rows into a table; gives the incoming rows, stored."""
    return stage_merge(path, incoming, keys, merge).commit()


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
