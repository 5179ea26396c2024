"""What the document operators share: whole texts, bounded slices of Arrow batches, tables, work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import work_folder

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bodies(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text) and the columns given in addition."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most ``most`` bytes of text, or one row that has more.
    Bounds what a task holds beside its batch; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(text)))
        row, before = 0, 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(row, stop - row)
            row, before = stop, int(ends[stop - 1])


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type)
                         else np.int64)[column.offset : column.offset + len(column) + 1]


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of every text of a column without nulls."""
    return np.diff(_offsets(column)).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts in one array, and where each text begins, with the end appended."""
    at = _offsets(column).astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


def work_table(rows: DataFrame, name: str) -> DataFrame:
    """Write rows as Parquet to the shared folder of the cluster and read them back: cuts lineage, and
    survives lost executors."""
    spark = rows.sparkSession
    path = f"{work_folder(spark)}/tallyhouse-llm/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def smallest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest values of ``by``, a 64-bit hash that is distinct per row.

    Rows beyond about four times as many are left out by their hash before they are sorted, so what
    comes together to be sorted does not grow with the table or its partitions.
    """
    n = rows.count()
    while n > 8 * most:
        few = rows.where(F.col(by) < -(2**63) + int(4 * most / n * 2**64))
        if few.count() >= most:
            rows = few
            break
        n //= 2
    return rows.orderBy(by).limit(most)
