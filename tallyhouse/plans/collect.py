"""The stored usage tables and the jobs that keep them: collect, rebuild, import, reset."""

from datetime import date, datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.times import normalize_date
from tallyhouse.operators import merge as mrg
from tallyhouse.operators.filters import drop_zero_usage
from tallyhouse.operators.lookup import lookup_join
from tallyhouse.operators.merge import on_days
from tallyhouse.operators.pricing import price_usage
from tallyhouse.operators.rollups import (
    ccswitch_hours, ccswitch_rollup_daily, daily_rebuild, hour_rollup, measure_sums,
    requests_of_touched_hours, session_parts, sessions_of_parts,
)
from tallyhouse.schemas import (
    COST, DAILY_KEYS, DAILY_USAGE, DEVICES, EVENT_KEYS, HOUR_KEYS, HOUR_USAGE, MANIFEST, MEASURES,
    MODEL_PRICING, PENDING, REQUESTS, SESSION_KEYS, SESSION_PART, SESSION_USAGE, TOKENS, TOTAL,
    USAGE_EVENT,
)
from tallyhouse.session import cut_lineage
from tallyhouse.streaming.cursors import follow

SCHEMAS = {
    "event": USAGE_EVENT, "hour": HOUR_USAGE, "daily": DAILY_USAGE, "session": SESSION_USAGE,
    "devices": DEVICES, "prices": MODEL_PRICING, "manifest": MANIFEST,
    "pending": PENDING, "generation": "number bigint", "session_part": SESSION_PART, "event_hour": HOUR_USAGE,
}
#: event_hour and session_part hold what the events summed to at the last rebuild, by hour and by session and day.
USAGE_LAYERS = ["event", "hour", "daily", "session", "session_part", "event_hour"]
SESSION_BUCKETS = 64
FILE_KEYS = ["source", "file_path"]
#: Small tables that are replaced whole, by a numbered version beside the old one, and the mark of a version that is complete.
VERSIONED = {"devices", "prices", "generation"}
#: Parts of the file log after which it is written anew as one.
LOG_PARTS = 64
COMPLETE = "_SUCCESS"


class UsageStore:
    """Parquet tables below one root; usage by day is partitioned by its date."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._watched: list[str] = []
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, sources: list[str]) -> list[tuple[str, Observation]]:
        """Count the rows per source that go into each layer from here on, as they are written."""
        self._watched, self._seen = sources, []
        return self._seen

    def _observed(self, layer: str, rows: DataFrame) -> DataFrame:
        if not self._watched:
            return rows
        self._seen.append((layer, Observation(f"{layer}-{len(self._seen)}")))
        return rows.observe(self._seen[-1][1], *[
            F.count_if(F.col("source") == F.lit(s)).alias(f"n{k}") for k, s in enumerate(self._watched)])

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        path = self.path(name)
        if name == "manifest":
            return self._newest_states()
        if name in VERSIONED:
            path = f"{path}/v-{max(self._versions(name), default=0):012d}"
        stored = mrg.read_table(self.spark, path, SCHEMAS[name])
        return stored if name == "generation" else stored.select(*SCHEMAS[name].names)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name]
        ])

    def _log(self) -> DataFrame:
        return mrg.read_table(self.spark, self.path("manifest"), T.StructType([*MANIFEST.fields, T.StructField("seq", T.LongType())]))

    def _newest_states(self) -> DataFrame:
        """The last noted state of every file."""
        state = F.max_by(F.struct(*[c for c in MANIFEST.names if c not in FILE_KEYS]), "seq").alias("s")
        return self._log().groupBy(*FILE_KEYS).agg(state).select(*FILE_KEYS, "s.*").select(*MANIFEST.names)

    def _log_parts(self) -> list[int]:
        files, folder = self._files(self.path("manifest"))
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n[4:]) for n in names if n.startswith("seq="))

    def note_files(self, rows: DataFrame) -> None:
        """Append states of files to the log, as a part of its own. Of a part whose write does not come to its end, the missing files
        are read again. After LOG_PARTS parts the newest states are appended as one, and the parts before it go."""
        parts = self._log_parts()
        number = max(parts, default=0) + 1
        self._shaped("manifest", rows).write.mode("overwrite").parquet(f"{self.path('manifest')}/seq={number}")
        if len(parts) + 1 >= LOG_PARTS:
            self.write(manifest=self._newest_states())

    def _replace_log(self, rows: DataFrame) -> None:
        parts = self._log_parts()
        rows.write.parquet(f"{self.path('manifest')}/seq={max(parts, default=0) + 1}")
        for part in parts:
            mrg.remove_folder(self.spark, f"{self.path('manifest')}/seq={part}")

    def write(self, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            shaped = self._shaped(name, rows)
            if name == "manifest":
                self._replace_log(shaped)
            elif name == "session":
                mrg.write_partitions(self._bucketed(shaped), self.path(name), "bucket")
            elif "usage_date" in shaped.columns:
                mrg.write_partitions(shaped, self.path(name))
            else:
                self._replace(name, shaped)

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _versions(self, name: str, complete: bool = True) -> list[int]:
        """Numbers of a small table's versions, newest first; those whose write came to its end have a mark."""
        files, folder = self._files(self.path(name))
        if not files.exists(folder):
            return []
        paths = [status.getPath() for status in files.listStatus(folder)]
        return sorted((int(p.getName()[2:]) for p in paths if p.getName().startswith("v-") and (
            not complete or files.exists(self._files(f"{p}/{COMPLETE}")[1]))), reverse=True)

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write rows, which may have been read from the table, as its newest version. It counts from the moment its mark is
        there, so a failure in between leaves the table as it was. The version before it stays for plans that still read it."""
        number = max(self._versions(name, complete=False), default=0) + 1
        path = f"{self.path(name)}/v-{number:012d}"
        rows.write.parquet(path)
        files, mark = self._files(f"{path}/{COMPLETE}")
        if not files.exists(mark):
            files.create(mark).close()
        kept = self._versions(name)[:2]
        for old in self._versions(name, complete=False):
            if old < min(kept):
                mrg.remove_folder(self.spark, f"{self.path(name)}/v-{old:012d}")

    def add_events(self, events: DataFrame) -> None:
        """Price and merge events, and note the dates whose hours, days and sessions are now stale: those that events
        come to, and those that they are moved from.

        Prices are those stored now; a later price change affects later events only. The notes are written first: one too
        many costs a rebuild, one too few would leave sums that no event stands for.
        """
        self.merge_staged_events([self.stage_events(events)])

    def stage_events(self, events: DataFrame) -> DataFrame:
        """Events in the shape of their table, not yet priced, stored in the shared folder."""
        return cut_lineage(self._observed("event", self._shaped("event", drop_zero_usage(events)).drop(COST)))

    def merge_staged_events(self, parts: list[DataFrame]) -> None:
        """Price and merge staged events in one merge; of an event that is in several parts the last one counts."""
        unpriced = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
        priced = price_usage(unpriced, self.read("prices"))
        incoming = priced.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["event"]], "_part")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return mrg.upsert_events(old.drop("_part"), new, ["_part"])

        staged = mrg.stage_merge(self.path("event"), incoming, EVENT_KEYS, merge)
        dates = ["device", "source", "usage_date"]
        stale = staged.incoming.select(*dates).unionByName(staged.replaced.select(*dates))
        stale.distinct().write.mode("append").parquet(self.path("pending"))
        staged.commit()

    def rebuild_pending(self, tz: str, as_of: date, locked_at: datetime) -> None:
        """Rebuild what noted dates made stale. One rebuild after all events of a run, because it
        locks the cost of past days. The notes that were read go last, so a failed rebuild is
        repeated, and notes that another run adds meanwhile stay."""
        notes = mrg.read_table(self.spark, self.path("pending"), SCHEMAS["pending"])
        files = notes.inputFiles()
        self.rebuild(cut_lineage(notes.distinct()), tz, as_of, locked_at)
        for file in files:
            mrg.remove_folder(self.spark, unquote(file))

    def _progress(self, name: str, layer: str) -> str:
        """Checkpoint of a source that is followed into a layer."""
        return self.stream_checkpoint(self.path(f"progress/{name}"), layer)

    def collect_table(
        self, name: str, rows: DataFrame, column: str, read, tz: str, as_of: date,
        locked_at: datetime,
    ) -> int:
        """Collect the rows of a table from where the last run ended; gives the highest number of the column.

        ``read(rows, cursor)`` gives the events of rows from the cursor on. A table that was replaced by
        one with smaller numbers starts from the beginning, as does a store whose events are gone.
        """
        def collect(low: int | None, high: int) -> None:
            self.add_events(read(rows.where(F.col(column) <= high), low or 0))

        newest = follow(rows, F.col(column), self._progress(name, "event"), collect)
        self.rebuild_pending(tz, as_of, locked_at)
        return newest or 0

    def _stage_hours(self, hours: DataFrame) -> mrg.Staged:
        return mrg.stage_merge(
            self.path("hour"), self._shaped("hour", hours), HOUR_KEYS, mrg.upsert_hours)

    def merge_hours(self, hours: DataFrame) -> None:
        self._stage_hours(hours).commit()

    def _stage_daily(
        self, daily: DataFrame, as_of: date, locked_at: datetime, gone: DataFrame | None = None
    ) -> mrg.Staged:
        """Days merged with the table, without those that are ``gone``: their hours have no usage left."""
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            merged = mrg.upsert_daily(old, new, as_of, locked_at)
            return self._shaped("daily", merged if gone is None else merged.join(gone, DAILY_KEYS, "left_anti"))

        if gone is None:
            return mrg.stage_merge(self.path("daily"), self._shaped("daily", daily), DAILY_KEYS, merge)
        gone = cut_lineage(gone)
        incoming = cut_lineage(self._shaped("daily", daily))
        touched = on_days(self.read("daily"), incoming.select("usage_date").union(gone.select("usage_date")))
        result = cut_lineage(merge(touched, incoming))
        return mrg.Staged(self.path("daily"), incoming, result, "usage_date", mrg.emptied_folders(touched, result))

    def merge_daily(self, daily: DataFrame, as_of: date, locked_at: datetime) -> None:
        self._stage_daily(daily, as_of, locked_at).commit()

    @staticmethod
    def _bucketed(sessions: DataFrame) -> DataFrame:
        bucket = F.pmod(F.hash("session_id"), F.lit(SESSION_BUCKETS))
        return sessions.withColumn("bucket", bucket)

    def _session_buckets(self, incoming: DataFrame) -> DataFrame:
        """Stored sessions in the buckets of the incoming ones."""
        buckets = [r[0] for r in incoming.select("bucket").distinct().collect()]
        schema = self._bucketed(self.read("session")).schema
        return mrg.read_table(self.spark, self.path("session"), schema).where(F.col("bucket").isin(buckets))

    def _stage_sessions(self, sessions: DataFrame) -> mrg.Staged:
        """Sessions merged with a table of buckets, of which only the touched change."""
        incoming = self._bucketed(cut_lineage(self._shaped("session", sessions)))
        touched = self._session_buckets(incoming).drop("bucket")
        merged = self._shaped("session", mrg.upsert_sessions(touched, incoming.drop("bucket")))
        return mrg.Staged(self.path("session"), incoming, cut_lineage(self._bucketed(merged)), "bucket", [])

    def merge_sessions(self, sessions: DataFrame) -> None:
        self._stage_sessions(sessions).commit()

    def rebuild(self, stale: DataFrame, tz: str, as_of: date, locked_at: datetime) -> None:
        """Bring hours, local days and sessions up to the stored events of the stale dates.

        What the events of those dates summed to at the last rebuild is taken back, and what they sum to now put in its
        place (``retract_merge``), so an event that was moved or changed counts where it is and nowhere else. A UTC date
        reaches the local days beside it, and those read the dates beside them. The former sums are replaced last: a
        rebuild that fails is repeated with the same result. The locked cost of a past day that keeps other usage stays.
        """
        def around(reach: int) -> DataFrame:
            shifted = [F.date_add("usage_date", n) for n in range(-reach, reach + 1)]
            return stale.select(F.explode(F.array(*shifted)).alias("usage_date"))

        events = self._of_dates("event", stale)
        before = cut_lineage(self._of_dates("event_hour", stale))
        after = cut_lineage(self._observed("hour", self._shaped("event_hour", hour_rollup(events))))
        self._stage_retracted_hours(before, after, stale).commit()
        days = cut_lineage(daily_rebuild(on_days(self.read("hour"), around(2)), tz))
        gone = daily_rebuild(before, tz).join(days, DAILY_KEYS, "left_anti").select(*DAILY_KEYS)
        reached = lookup_join(on_days(days, around(1)), stale.select("device", "source").distinct(), ["device", "source"], "left_semi")
        self._stage_daily(self._observed("daily", cut_lineage(reached)), as_of, locked_at, gone).commit()
        self._rebuild_sessions(events, stale)
        self._replace_dates("event_hour", after, stale)

    def _of_dates(self, name: str, stale: DataFrame) -> DataFrame:
        """Stored rows of the stale (device, source, date); of rows without a date only if some of them are stale."""
        stored = self.read(name)
        dates = lookup_join(on_days(stored, stale), stale, ["device", "source", "usage_date"], "left_semi")
        undated = stale.where("usage_date IS NULL").select("device", "source").distinct()
        if undated.isEmpty():
            return dates
        return dates.unionByName(
            lookup_join(stored.where("usage_date IS NULL"), undated, ["device", "source"], "left_semi"))

    def _replace_dates(self, name: str, rows: DataFrame, stale: DataFrame) -> None:
        """Put stored rows in the place of those of the stale (device, source, date)."""
        keys = ["device", "source", "usage_date"]
        touched = on_days(self.read(name), stale)
        if not stale.where("usage_date IS NULL").isEmpty():
            touched = touched.unionByName(self.read(name).where("usage_date IS NULL"))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        others = touched.alias("x").join(stale.alias("y"), same, "left_anti")
        result = cut_lineage(others.unionByName(rows))
        emptied = mrg.emptied_folders(touched, result)
        mrg.Staged(self.path(name), rows, result, "usage_date", emptied).commit()

    def _stage_retracted_hours(self, before: DataFrame, after: DataFrame, stale: DataFrame) -> mrg.Staged:
        touched = on_days(self.read("hour"), stale)
        result = cut_lineage(mrg.retract_merge(touched, before, after, HOUR_KEYS, [*MEASURES, REQUESTS]))
        return mrg.Staged(self.path("hour"), after, result, "usage_date", mrg.emptied_folders(touched, result))

    def _rebuild_sessions(self, events: DataFrame, stale: DataFrame) -> None:
        """Sum the parts of stale dates again, and the sessions that have or had one of them.

        Sessions are summed from their parts by day, so the events of other days are not read.
        Events without a day are a part of their own.
        """
        parts = cut_lineage(self._shaped("session_part", session_parts(events)))
        former = cut_lineage(self._of_dates("session_part", stale))
        sessions = cut_lineage(parts.select(*SESSION_KEYS).union(former.select(*SESSION_KEYS)).distinct())
        whole = cut_lineage(lookup_join(self.read("session_part"), sessions, SESSION_KEYS, "left_semi"))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("device", "source", "usage_date")]
        kept = whole.alias("x").join(stale.alias("y"), same, "left_anti")
        before, after = (self._shaped("session", sessions_of_parts(p)) for p in (whole, kept.unionByName(parts)))
        after = cut_lineage(self._observed("session", after))
        incoming = self._bucketed(sessions)
        touched = self._session_buckets(incoming)
        merged = mrg.retract_merge(touched.drop("bucket"), before, after, SESSION_KEYS, MEASURES,
                                   ["last_activity", "project_path", "model"])
        result = cut_lineage(self._bucketed(merged))
        mrg.Staged(self.path("session"), incoming, result, "bucket", mrg.emptied_folders(touched, result, "bucket")).commit()
        self._replace_dates("session_part", parts, stale)

    def collect(self, events: DataFrame, tz: str, as_of: date, locked_at: datetime) -> None:
        """Merge collected events and rebuild what depends on them."""
        self.add_events(events)
        self.rebuild_pending(tz, as_of, locked_at)

    def collect_days(self, rows: DataFrame, as_of: date, locked_at: datetime) -> None:
        """Merge day rows of sources that know no hours, priced per model."""
        sums = rows.groupBy(*DAILY_KEYS).agg(*measure_sums([*TOKENS, TOTAL]))
        priced = price_usage(cut_lineage(drop_zero_usage(sums)), self.read("prices"))
        self.merge_daily(priced.withColumn(REQUESTS, F.lit(0)), as_of, locked_at)

    def collect_proxy(
        self, requests: DataFrame, rollups: DataFrame | None, device: str, tz: str, as_of: date,
        locked_at: datetime,
    ) -> None:
        """Merge new proxied requests as hours, and new days of older history as days. Each is followed by itself: requests
        by their second, days by their date, and starts over if its table was replaced."""
        prices = self.read("prices")

        def hours(low: int | None, high: int) -> None:
            touched = requests_of_touched_hours(requests.where(F.col("created_at") <= high), low)
            sums = cut_lineage(ccswitch_hours(touched, prices, device))
            sums.select("device", "source", "usage_date").distinct().write.mode("append").parquet(self.path("pending"))
            self.merge_hours(sums)

        def days(low: int | None, high: int) -> None:
            new = rollups.where((day <= high) & (day > low if low is not None else F.lit(True)))
            sums = ccswitch_rollup_daily(new, self.read("daily"), prices, device)
            self.merge_daily(sums.withColumn(REQUESTS, F.lit(0)), as_of, locked_at)

        follow(requests, F.col("created_at"), self._progress("proxy_requests", "hour"), hours)
        if rollups is not None:
            day = F.unix_date(normalize_date(F.col("date")))
            follow(rollups, day, self._progress("proxy_rollups", "daily"), days)
        self.rebuild_pending(tz, as_of, locked_at)

    def import_usage(
        self, layers: dict[str, DataFrame], names: DataFrame, as_of: date, locked_at: datetime
    ) -> dict[str, int]:
        """Merge the layers of a bundle and register its devices; gives the rows per layer.

        Everything is computed and stored before the first table changes, so input that cannot be read
        changes none of them. The devices come last, and an import that is repeated changes nothing more.
        """
        known = self.read("devices")
        fresh = cut_lineage(mrg.new_devices(names, known))
        counts = {name: layers[name].count() for name in ("hour", "daily", "session")}
        counts["devices"] = fresh.count()
        devices = cut_lineage(known.unionByName(fresh))
        staged = [self._stage_hours(layers["hour"]), self._stage_daily(layers["daily"], as_of, locked_at),
                  self._stage_sessions(layers["session"])]
        for layer in staged:
            layer.commit()
        self._replace("devices", devices)
        return counts

    def remap_devices(self, mapping: DataFrame) -> None:
        """Put all stored usage of devices under other ids (``mapping``: device, device_id); where the new id has a row of
        the same key, that row survives.

        Only the days and buckets that hold an old id are rewritten, and for events the days on which the new id has one of
        their keys. Every layer is computed before the first changes; what events sum to follows last, and a run that
        fails is repeated with the same result. Stale dates have to be rebuilt before, and no new id may be an old one.
        """
        mapping = cut_lineage(mapping.where("device <> device_id").select("device", "device_id").distinct())
        old = mapping.select("device")
        if not mapping.select(F.col("device_id").alias("device")).join(old, "device", "left_semi").isEmpty():
            raise ValueError("a new device id is mapped itself")
        if not mrg.read_table(self.spark, self.path("pending"), SCHEMAS["pending"]).isEmpty():
            raise ValueError("rebuild the pending dates before devices are mapped")
        dates = ["device", "source", "usage_date"]
        held = [lookup_join(self.read(n), old, ["device"], "left_semi").select(*dates) for n in ("event", "event_hour", "session_part")]
        held = cut_lineage(held[0].unionByName(held[1]).unionByName(held[2]).distinct())
        moved = lookup_join(held, mapping, "device", "inner").select(F.col("device_id").alias("device"), "source", "usage_date")
        stale = cut_lineage(held.unionByName(moved).distinct())
        staged = [self._stage_remapped(n, mapping, k) for n, k in (("event", EVENT_KEYS), ("hour", HOUR_KEYS), ("daily", DAILY_KEYS))]
        sessions = cut_lineage(self._bucketed(lookup_join(self.read("session"), old, ["device"], "left_semi")))
        if not sessions.isEmpty():
            merged = mrg.remap_devices(self._session_buckets(sessions).drop("bucket"), mapping, SESSION_KEYS)
            staged.append(mrg.Staged(self.path("session"), sessions, cut_lineage(self._bucketed(merged)), "bucket", []))
        known = self.read("devices")
        fresh = mrg.new_devices(mapping.select("device_id", F.col("device").alias("name")), known)
        devices = cut_lineage(known.join(old.withColumnRenamed("device", "device_id"), "device_id", "left_anti").unionByName(fresh))
        for layer in staged:
            layer.commit()
        events = cut_lineage(self._of_dates("event", stale))
        self._replace_dates("session_part", cut_lineage(self._shaped("session_part", session_parts(events))), stale)
        self._replace_dates("event_hour", cut_lineage(self._shaped("event_hour", hour_rollup(events))), stale)
        self._replace("devices", devices)

    def _stage_remapped(self, name: str, mapping: DataFrame, keys: list[str]) -> mrg.Staged:
        """A layer's days that hold an old id, under the new ids."""
        stored, day = self.read(name), "usage_date"
        others = [c for c in dict.fromkeys([*keys, day]) if c != "device"]
        held = cut_lineage(lookup_join(stored.select("device", *others), mapping, "device", "inner"))
        days = held.select(day)
        if day not in keys:
            wanted = mrg.sized_for_broadcast(held.select(F.col("device_id").alias("device"), *[k for k in keys if k != "device"]))
            days = days.unionByName(cut_lineage(stored.select(*keys, day).join(wanted, keys, "left_semi").select(day).distinct()))
        touched = on_days(stored, days)
        if not days.where(f"{day} IS NULL").isEmpty():
            touched = touched.unionByName(stored.where(f"{day} IS NULL"))
        result = cut_lineage(mrg.remap_devices(touched, mapping, keys))
        return mrg.Staged(self.path(name), held, result, day, mrg.emptied_folders(touched, result))

    def generation(self) -> int:
        """How often the store was emptied."""
        return self.read("generation").agg(F.max("number")).first()[0] or 0

    def _new_generation(self) -> None:
        self._replace("generation", self.spark.createDataFrame([(self.generation() + 1,)], SCHEMAS["generation"]))

    def stream_checkpoint(self, base: str, layer: str = "event") -> str:
        """Where a stream into this store keeps its progress and state: a folder of its own for every generation of the store. If
        the stream has progress but the layer it fills has no rows (its tables were removed), a new generation starts here too."""
        path = f"{base.rstrip('/')}/generation-{self.generation()}"
        files, commits = self._files(f"{path}/commits")
        if files.exists(commits) and files.listStatus(commits) and not self.read(layer).take(1):
            self._new_generation()
            path = f"{base.rstrip('/')}/generation-{self.generation()}"
        return path

    def reset(self) -> None:
        """Empty the usage layers, the manifest and all progress, and let streams start anew; prices and devices stay."""
        self._new_generation()
        for name in [*USAGE_LAYERS, "manifest", "progress", "pending"]:
            mrg.remove_folder(self.spark, self.path(name))
