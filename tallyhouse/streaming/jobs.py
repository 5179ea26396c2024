"""Incremental collection: landed segments as a stream, growing files by manifest."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from datetime import date, datetime
from threading import Event
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyhouse.functions.identity import parent_dir, plain_path
from tallyhouse.operators.manifest import changed_files, manifest_rows
from tallyhouse.plans.collect import UsageStore
from tallyhouse.schemas import MEASURES, REQUESTS
from tallyhouse.session import cut_lineage
from tallyhouse.sources import codex, dsh
from tallyhouse.sources.events import EVENT_COLUMNS
from tallyhouse.sources.files import JSONL, file_listing, scan_log_files
from tallyhouse.streaming.state import carry_along_stream


class Increment(NamedTuple):
    """How new lines of sessions become events: ``states`` runs along the stream and may keep state by session, ``events`` in every
    micro-batch."""

    events: Callable[[DataFrame], DataFrame]
    states: Callable[[DataFrame], DataFrame] = lambda lines: lines


def stream_lines(
    spark: SparkSession, path: str, glob: str = JSONL, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of the lines of landed files. Files must not change after they land."""
    reader = spark.readStream.options(recursiveFileLookup=True, pathGlobFilter=glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"), "value")


def segment_lines(lines: DataFrame, session_of: Callable[[Column], Column] = parent_dir) -> DataFrame:
    """Line frame of a stream of lines. A session is a folder whose segments follow each other by
    name; ``session_of`` says otherwise. Lines of a block are ordered as they are read."""
    zero = F.lit(0).cast("bigint")
    return lines.select(session_of(F.col("file")).alias("path"), F.struct("file", "start").alias("block"),
                        zero.alias("chunk"), zero.alias("pos"), "value")


#: Codex events of new lines, each session continuing where it stood.
CODEX = Increment(lambda states: codex.codex_events(codex.cumulative_delta(states)),
                  lambda lines: carry_along_stream(codex.codex_states(lines), codex.UPTO, codex.BEFORE))
#: DeepSeek Harness events of new lines, each session continuing where it stood.
DSH = Increment(lambda states: dsh.dsh_events(dsh.named_by_folder(states)),
                lambda lines: carry_along_stream(dsh.dsh_states(lines), dsh.STATE))


def stream_events(
    spark: SparkSession, path: str, checkpoint: str, store: UsageStore, increment: Increment,
    device: str, rebuild: Callable[[], None] | None = None, files_per_batch: int | None = None,
    session_of: Callable[[Column], Column] = parent_dir, every: str | None = None,
):
    """Start collecting landed files into the store.

    Every micro-batch merges its events by key, so a replayed batch changes nothing. The query
    ends when all landed files are read, unless ``every`` gives an interval; ``rebuild`` then
    runs after each batch. Hours and days are recomputed for the dates touched, however late
    their lines are. Progress and state belong to the store's generation: after a reset all landed
    files are read again.
    """
    def collect(batch: DataFrame, number: int) -> None:
        events = increment.events(batch).withColumn("device", F.lit(device))
        store.add_events(events.select("device", *EVENT_COLUMNS))
        if rebuild is not None:
            rebuild()

    lines = segment_lines(stream_lines(spark, path, files_per_batch=files_per_batch), session_of)
    writer = increment.states(lines).writeStream.foreachBatch(collect)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", store.stream_checkpoint(checkpoint)).trigger(**trigger).start()


def collect_landed(
    spark: SparkSession, path: str, checkpoint: str, store: UsageStore, increment: Increment,
    device: str, tz: str, as_of: date, locked_at: datetime, files_per_batch: int | None = None,
    session_of: Callable[[Column], Column] = parent_dir,
) -> None:
    """Collect all files landed since the last call, then rebuild once."""
    stream_events(spark, path, checkpoint, store, increment, device, None, files_per_batch,
                  session_of).awaitTermination()
    store.rebuild_pending(tz, as_of, locked_at)


def stream_hours(events: DataFrame, delay: str) -> DataFrame:
    """Hour buckets of a stream of priced events with bounded state: events later than the delay
    are not counted. ``stream_events`` has no such bound."""
    hour = F.window("event_time", "1 hour").alias("hour_window")
    return (
        events.withWatermark("event_time", delay).groupBy(hour, "device", "source", "model")
        .agg(*[F.sum(c).alias(c) for c in MEASURES], F.count("*").alias(REQUESTS))
        .withColumns({"usage_date": F.to_date("hour_window.start"),
                      "hour": F.hour("hour_window.start")}).drop("hour_window")
    )


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """Stream of events without repeats of a key within the delay. Events later than the delay are dropped;
    ``late_rows`` counts them."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        ["device", "source", "event_key"])


class LateRows(StreamingQueryListener):
    """Counts the rows that a session's streams drop because they come later than their delay, as they are dropped."""

    def __init__(self) -> None:
        self._dropped: dict[str, int] = {}
        self._ended: dict[str, Event] = {}

    def _end_of(self, run: str) -> Event:
        return self._ended.setdefault(run, Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        self._dropped[run] = self._dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def of(self, query, seconds: float = 60.0) -> int:
        """Rows that this run of a query has dropped so far; of a query that ended, all of them."""
        if not query.isActive:
            self._end_of(str(query.runId)).wait(seconds)
        return self._dropped.get(str(query.runId), 0)


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[LateRows]:
    """Counts late rows of the streams that are started inside."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def write_stream_hours(hours: DataFrame, checkpoint: str, store: UsageStore):
    """Start keeping the store's hours up to date with a stream of hour buckets."""
    def save(batch: DataFrame, number: int) -> None:
        store.merge_hours(batch)

    return (
        hours.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


class Collected(NamedTuple):
    """Files read to their end, and (name, reason) of those that were not."""

    files: int
    failed: list[tuple[str, str]]


def _rounds(files: DataFrame, most_bytes: int, most_files: int) -> Iterator[list[str]]:
    """File names in rounds of bounded size and number, of which one at a time is held."""
    names, size = [], 0
    for row in files.select("file_path", "size").toLocalIterator():
        if names and (size + row.size > most_bytes or len(names) >= most_files):
            yield names
            names, size = [], 0
        names.append(row.file_path)
        size += row.size
    if names:
        yield names


def collect_changed_files(
    spark: SparkSession, store: UsageStore, source: str, paths: list[str],
    parse: Callable[[DataFrame], DataFrame], device: str, tz: str, as_of: date, now: datetime,
    glob: str = JSONL, round_bytes: int = 1 << 40, round_files: int = 10_000,
) -> Collected:
    """Collect logs that grow in place: read every changed file whole and merge by key.

    Files are read in rounds, each by one reader. A round's files enter the manifest only after its
    events are merged, so a failed round is read again; the rebuild follows the last round. A round
    with a file that cannot be read to its end is halved until that file is alone. What comes before
    the damage is merged, the file is reported, and it stays out of the manifest, so it is read again
    in the next run.
    """
    manifest = store.read("manifest").where(F.col("source") == source)
    states = changed_files(file_listing(spark, paths, glob), manifest).where("state <> 'CACHED'")
    pending = cut_lineage(states.select("file_path", "fingerprint", "size"))
    failed: list[tuple[str, str]] = []

    def merge(names: list[str], torn: bool) -> None:
        events = parse(scan_log_files(spark, names, torn)).withColumn("device", F.lit(device))
        store.add_events(events.select("device", *EVENT_COLUMNS))

    def collect(names: list[str]) -> int:
        try:
            merge(names, torn=False)
        except (PySparkException, Py4JJavaError) as error:
            if not _unreadable(error):
                raise
            if len(names) > 1:
                half = len(names) // 2
                return collect(names[:half]) + collect(names[half:])
            failed.append((names[0], str(error).split("\n", 1)[0][:300]))
            with suppress(PySparkException, Py4JJavaError):
                merge(names, torn=True)
            return 0
        done = pending.where(F.col("file_path").isin(names))
        store.note_files(manifest_rows(done, source, now))
        return len(names)

    read = sum(collect(names) for names in _rounds(pending, round_bytes, round_files))
    store.rebuild_pending(tz, as_of, now)
    return Collected(read, failed)


def _unreadable(error: Exception) -> bool:
    """Whether a file could not be read, as opposed to anything else that went wrong."""
    return any(word in str(error) for word in ("FAILED_READ_FILE", "PATH_NOT_FOUND", "FileNotFoundException"))


def collect_run(
    store: UsageStore, collectors: dict[str, Callable[[], DataFrame]], tz: str, as_of: date, locked_at: datetime
) -> DataFrame:
    """Collect several sources and rebuild once; gives source, status, error, and the rows per layer (event, hour, daily, session).

    Every source is read by itself, and those that could be read are merged together: the days of the stored events, which
    sources share, are rewritten once and not once a source. A source that cannot be read is reported with its error and does
    not keep the others from being collected. Rows are counted as they are written, without a pass of their own.
    """
    sources, layers = list(collectors), ["event", "hour", "daily", "session"]
    seen = store.watch(sources)
    counted: list[tuple[str, Observation]] = []
    errors: dict[str, str] = {}
    staged: list[DataFrame] = []
    try:
        for source, events in collectors.items():
            start = len(seen)
            try:
                staged.append(store.stage_events(events()))
                counted += seen[start:]
            except (PySparkException, Py4JJavaError) as error:
                errors[source] = str(error).split("\n", 1)[0][:300]
        if staged:
            store.merge_staged_events(staged)
        start = len(seen)
        store.rebuild_pending(tz, as_of, locked_at)
        counted += seen[start:]
    finally:
        store.watch([])
    counts = dict.fromkeys([(s, layer) for s in sources for layer in layers], 0)
    for layer, observation in counted:
        for k, source in enumerate(sources):
            counts[source, layer] += observation.get.get(f"n{k}") or 0
    rows = [(s, "error" if s in errors else "ok", errors.get(s), *[counts[s, layer] for layer in layers]) for s in sources]
    return store.spark.createDataFrame(rows, "source string, status string, error string, event bigint, hour bigint, daily bigint, session bigint")


def collect_summary(events: DataFrame) -> DataFrame:
    """Per source: events, (day, model) pairs and (session, model) pairs collected."""
    def pairs(*columns: str) -> Column:
        return F.count_distinct(F.struct(*columns))

    return events.groupBy("source").agg(
        F.count("*").alias("events"), pairs("usage_date", "model").alias("daily"),
        pairs("session_id", "model").alias("session_model"))
