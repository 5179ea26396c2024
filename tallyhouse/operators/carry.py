"""Running state along the lines of a log, without putting a whole log into one task.

A line frame has the columns ``path``, ``block``, ``chunk``, ``pos`` and ``value``: ``block``
orders the splits of a file, ``chunk`` cuts a split into bounded runs of lines, ``pos`` orders
the lines inside a chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16
LINE_ORDER = ["block", "chunk", "pos"]
CHUNK_KEYS = ["path", "block", "chunk"]


def line_order() -> Column:
    return F.struct(*LINE_ORDER)


def as_lines(df: DataFrame, path: Column, pos: Column, value: Column) -> DataFrame:
    """Line frame from rows that already know their file and position."""
    pos = pos.cast("bigint")
    return df.select(
        path.alias("path"), F.lit(0).cast("bigint").alias("block"),
        F.shiftright(pos, CHUNK_BITS).alias("chunk"), pos.alias("pos"), value.alias("value"),
    )


def carry_forward(
    lines: DataFrame,
    upto: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add the last non-null value of columns: ``upto`` includes the row, ``before`` does not.

    Both map a new column to the column it follows. The value inside a chunk comes from a
    window over that chunk; the value on entry to a chunk comes from one summary row per chunk.
    So a file with a third of all lines is spread over its chunks. ``initial`` (path + new
    columns) is the state a file had before these lines.
    """
    upto, before = upto or {}, before or {}
    followed = {**upto, **before}
    ordered = Window.partitionBy(*CHUNK_KEYS).orderBy("pos")
    frames = {
        **dict.fromkeys(upto, ordered.rowsBetween(Window.unboundedPreceding, 0)),
        **dict.fromkeys(before, ordered.rowsBetween(Window.unboundedPreceding, -1)),
    }
    inside = lines.withColumns(
        {f"_in_{new}": F.last(F.col(col), True).over(frames[new]) for new, col in followed.items()}
    )
    entering = chunk_entry(lines, followed)
    joined = inside.join(entering, CHUNK_KEYS, "left")
    sources = {new: [F.col(f"_in_{new}"), F.col(f"_entry_{new}")] for new in followed}
    if initial is not None:
        names = {new: f"_initial_{new}" for new in followed}
        joined = joined.join(initial.withColumnsRenamed(names), "path", "left")
        for new in followed:
            sources[new].append(F.col(f"_initial_{new}"))
    state = {new: F.coalesce(*cols) for new, cols in sources.items()}
    return joined.withColumns(state).drop(
        *[c for new in followed for c in (f"_in_{new}", f"_entry_{new}", f"_initial_{new}")]
    )


def chunk_entry(lines: DataFrame, followed: dict[str, str]) -> DataFrame:
    """State on entry to every chunk: the latest value among the earlier chunks of the file."""
    closing = lines.groupBy(*CHUNK_KEYS).agg(*[
        F.max_by(col, F.when(F.col(col).isNotNull(), F.col("pos"))).alias(f"_out_{new}")
        for new, col in followed.items()
    ])
    earlier = (
        Window.partitionBy("path").orderBy("block", "chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return closing.select(
        *CHUNK_KEYS,
        *[F.last(f"_out_{new}", True).over(earlier).alias(f"_entry_{new}") for new in followed],
    )
