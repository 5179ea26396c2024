"""Running state along the lines of sessions that arrive in pieces: Spark's keyed state, one value per session.

Lines are filled forward inside chunks, wherever the chunks are; a chunk then is one row of its closing values and its
lines in packed form. Only these rows are brought together by session, where the state before a chunk is the last value
of the chunks and micro-batches before it. So the lines of a large session are copied by its task, and worked on by others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Chunks of fewer bytes are packed as they are, since Spark's shuffle compresses them together.
_LEAST_COMPRESSED = 1 << 16
#: Unpacked lines that go back to Spark in one batch, at least.
_LINES_PER_BATCH = 10_000


def use_keyed_state(spark: SparkSession) -> None:
    """Queries started from here on keep their state in RocksDB, beside their checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    compression = "zstd" if batch.nbytes >= _LEAST_COMPRESSED else None
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _edges(batch: pa.RecordBatch, by: list[str]) -> list[int]:
    """Where runs of rows with equal values begin, and the number of rows; a null equals a null."""
    if not batch.num_rows:
        return [0]
    differs = np.zeros(batch.num_rows - 1, dtype=bool)
    for c in by:
        row, earlier = batch[c][1:], batch[c][:-1]
        known = pc.fill_null(pc.not_equal(row, earlier), False)
        differs |= pc.or_(known, pc.xor(row.is_null(), earlier.is_null())).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]


class LastValues(StatefulProcessor):
    """The state before each chunk of a session; the state is the last known value of every column.

    It works on plain rows and asks for the state once, since there may be as many sessions as chunks.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", T.StructType([T.StructField(c, T.StringType()) for c in self.columns]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        before = [None] * len(self.columns) if known is None else list(known)
        entering, last = Row("lines", *[f"in_{c}" for c in self.columns]), before
        out = []
        for chunk in sorted(rows, key=lambda r: (r.file, r.start, r.seq)):
            out.append(entering(chunk.lines, *last))
            closing = [chunk[f"out_{c}"] for c in self.columns]
            last = [old if new is None else new for old, new in zip(last, closing, strict=True)]
        if last != before:
            self.state.update(tuple(last))
        return iter(out)

    def close(self) -> None:
        pass


def carry_along_stream(states: DataFrame, upto: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    """A stream of ``states`` (path, block, others) with the last non-null values of columns, as ``carry_forward`` gives them over
    the whole session: ``upto`` includes the row, ``before`` does not.

    Rows of a block follow each other as they are read, blocks by file and start, micro-batches by number. The state after a
    batch is a version of its own in Spark's checkpoint, so a batch that is replayed starts where it did.
    """
    before = before or {}
    followed = {**upto, **before}
    text = {c: F.col(c) if isinstance(states.schema[c].dataType, T.StringType) else F.to_json(c) for c in dict.fromkeys(followed.values())}
    rows = states.select(*[c for c in states.columns if c not in ("block", "chunk", "pos")], F.col("block.file").alias("_file"),
                         F.col("block.start").alias("_start"), *[v.alias(f"_text_{c}") for c, v in text.items()])
    names = list(followed)
    closing = T.StructType([T.StructField("path", T.StringType()), T.StructField("file", T.StringType()), T.StructField(
        "start", T.LongType()), T.StructField("seq", T.LongType()), *[T.StructField(f"out_{n}", T.StringType()) for n in names],
        T.StructField("lines", T.BinaryType())])
    entering = T.StructType([T.StructField("lines", T.BinaryType()), *[T.StructField(f"in_{n}", T.StringType()) for n in names]])
    kept = [c for c in rows.columns if not c.startswith("_text_") and c not in ("_file", "_start")]
    filled = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(f"_new_{n}", T.StringType()) for n in names]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            edges = _edges(batch, ["path", "_file", "_start"])
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                ends, arrays = [], []
                for n in names:
                    value = pc.fill_null_forward(part[f"_text_{followed[n]}"])
                    ends.append(value[-1].as_py())
                    arrays.append(value if n in upto else pa.concat_arrays([pa.nulls(1, value.type), value[:-1]]))
                whole = pa.RecordBatch.from_arrays([*[part[c] for c in kept], *arrays], names=[*kept, *[f"_new_{n}" for n in names]])
                out.append([part["path"][0].as_py(), part["_file"][0].as_py(), part["_start"][0].as_py(), seq, *ends, _packed(whole)])
                seq += 1
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(names), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=closing.names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for part in pa.ipc.open_stream(row["lines"]):
                    arrays = [part[c] for c in kept]
                    for n in names:
                        value, entry = part[f"_new_{n}"], row[f"in_{n}"]
                        arrays.append(value if entry is None else pc.fill_null(value, pa.scalar(entry, value.type)))
                    parts.append(pa.RecordBatch.from_arrays(arrays, names=filled.names))
                    held += part.num_rows
                if held >= _LINES_PER_BATCH:
                    yield pa.concat_batches(parts)
                    parts, held = [], 0
        if parts:
            yield pa.concat_batches(parts)

    use_keyed_state(states.sparkSession)
    chunks = rows.mapInArrow(pack, closing).groupBy("path").transformWithState(
        LastValues(names), entering, "append", "none")
    # round robin, so that a large session's lines are unpacked by several tasks
    lines = chunks.repartition(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(unpack, filled)
    new = {n: F.col(f"_new_{n}") if isinstance(states.schema[c].dataType, T.StringType) else F.from_json(
        f"_new_{n}", states.schema[c].dataType) for n, c in followed.items()}
    return lines.select(*kept, *[v.alias(n) for n, v in new.items()])
