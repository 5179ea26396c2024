"""Registry of the named queries and of the SQL that states the same result."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


def shown(rows: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Columns in plain types: whole numbers as bigint, times as text, rounded doubles."""
    def plain(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            value = F.round(value, digits)
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, T.IntegerType):
            value = value.cast("bigint")
        return value.alias(field.name)

    picked = rows.select(*columns) if columns else rows
    return picked.select(*[plain(f) for f in picked.schema])
