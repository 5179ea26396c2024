"""Tables that grow by a number, such as a time or a day, followed by a stream.

The stream carries ranges and not rows: its offsets say how far a table was read and live in its checkpoint,
and each micro-batch reads its range of the table by a filter that reaches the scan.
"""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Offset before the first read, below every number a table has.
_NOTHING_READ = {"high": -(1 << 62), "rows": -1}


@dataclass
class _Range(InputPartition):
    low: int | None
    high: int


class _Ranges(DataSourceStreamReader):
    """Offsets are the highest number of the table and its rows at that time, so that rows which arrive under the
    highest number are noticed."""

    def __init__(self, high: int, rows: int):
        self._latest = {"high": high, "rows": rows}

    def initialOffset(self) -> dict:
        return _NOTHING_READ

    def latestOffset(self) -> dict:
        return self._latest

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start == end:
            return []
        # a table that no longer reaches its offset was replaced, and is read from its beginning
        known = start["rows"] >= 0 and start["high"] <= end["high"]
        return [_Range(start["high"] if known else None, end["high"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.low, partition.high


class TableRanges(DataSource):
    """One row (low, high) for what a table gained since the last micro-batch; low is null at the beginning."""

    @classmethod
    def name(cls) -> str:
        return "table_ranges"

    def schema(self) -> str:
        return "low bigint, high bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Ranges(int(self.options["high"]), int(self.options["rows"]))


def follow(rows: DataFrame, number: Column, checkpoint: str, collect: Callable[[int | None, int], None]) -> int | None:
    """Call ``collect(low, high)`` for the range of a table that was not read yet, if there is one; gives the highest number.

    Low is the number that the last run ended with, whose rows may have become more, and None at the beginning, or if
    the table no longer reaches so far. The range counts as read after ``collect`` returns; a run that fails before is repeated
    with the same range. An empty table changes nothing.
    """
    spark = rows.sparkSession
    state = rows.agg(F.max(number).cast("bigint").alias("high"), F.count("*").alias("rows")).first()
    if state.high is None:
        return None

    ended: list[int] = []

    def each(batch: DataFrame, _: int) -> None:
        for low, high in batch.collect():  # one row
            collect(low, high)
            ended.append(high)

    def run() -> None:
        ranges = spark.readStream.format(TableRanges.name()).options(high=state.high, rows=state.rows).load()
        ranges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()

    spark.dataSource.register(TableRanges)
    run()
    if ended and ended[-1] != state.high:  # that was a range which failed before
        run()
    return state.high
