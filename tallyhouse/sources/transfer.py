"""Exchange between installations, CSV output and the stored usage tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import constants as K
from tallyhouse.operators.merge import write_partitions
from tallyhouse.schemas import BUNDLE, DAILY_USAGE, HOUR_USAGE, SESSION_USAGE, bundle_name
from tallyhouse.session import cut_lineage

_LAYERS = {"hourUsage": HOUR_USAGE, "dailyUsage": DAILY_USAGE, "sessionUsage": SESSION_USAGE}
_HEADER = "format string, version bigint, exportedAt string"
_NAMES = "device_id string, name string"


class BundleRejected(ValueError):
    """The input is not an export bundle of the supported version."""


def _check(header, formats: tuple[str, ...]) -> None:
    if header is None or header["format"] not in formats:
        raise BundleRejected(f"not a bundle of the formats {', '.join(formats)}")
    if header["version"] != K.BUNDLE_VERSION:
        raise BundleRejected(f"unsupported version {header['version']}")


def _row_schema(layer: str) -> T.StructType:
    return BUNDLE[layer].dataType.elementType


def _to_table(rows: DataFrame, layer: str) -> DataFrame:
    table = _LAYERS[layer]
    given = {bundle_name(f.name): f for f in table}
    return rows.select(*[
        (F.col(name).try_cast(f.dataType) if name in rows.columns else F.lit(None).cast(f.dataType))
        .alias(f.name) for name, f in given.items()
    ])


def load_export_bundle(
    spark: SparkSession, path: str, formats: tuple[str, ...] = (K.BUNDLE_FORMAT,)
) -> dict[str, DataFrame]:
    """The layers and ``deviceNames`` of a bundle, rejected unless format and version fit. ``formats``
    names the accepted formats, for instance that of the program a bundle was exported from.

    Reads the folder that ``write_export_bundle`` makes, or one JSON file with nested arrays, whose values are
    converted to the columns' types, null where they cannot be.
    """
    folder = _folder_header(spark, path)
    if folder is not None:
        _check(folder, formats)
        layers = {
            layer: _to_table(spark.read.schema(_row_schema(layer)).json(f"{path}/{layer}"), layer)
            for layer in _LAYERS
        }
        return {**layers, "deviceNames": spark.read.schema(_NAMES).json(f"{path}/deviceNames")}
    parsed = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("whole"))
    whole = cut_lineage(parsed)  # one document, parsed once for the header and all layers
    header = [F.try_variant_get("whole", f"$.{c}", t).alias(c) for c, t in (("format", "string"), ("version", "bigint"))]
    _check(whole.select(*header).first(), formats)
    layers = {
        layer: _to_table(_parts(whole, layer).select(*[
            F.try_variant_get("value", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
            for f in _row_schema(layer)]), layer) for layer in _LAYERS
    }
    names = _parts(whole, "deviceNames").select(
        F.col("key").alias("device_id"), F.try_variant_get("value", "$", "string").alias("name"))
    return {**layers, "deviceNames": names}


def _parts(whole: DataFrame, name: str) -> DataFrame:
    """(key, value) of the elements of an array or object in the document; none if it is absent or null."""
    part = F.try_variant_get(F.col("whole").outer(), f"$.{name}", "variant")
    return whole.lateralJoin(whole.sparkSession.tvf.variant_explode(part))


def _folder_header(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(_HEADER).json(f"{path}/header").first() if files.exists(folder) else None


def write_export_bundle(
    path: str, hour: DataFrame, daily: DataFrame, sessions: DataFrame, devices: DataFrame,
    exported_at: str,
) -> None:
    """A folder with one JSON directory per layer and, last, the header that makes it valid.

    Events, manifests and settings are not exported.
    """
    spark = hour.sparkSession
    for layer, rows in zip(_LAYERS, (hour, daily, sessions), strict=True):
        table = [f for f in _LAYERS[layer] if bundle_name(f.name) in _row_schema(layer).names]
        rows.select(*[
            F.col(f.name).cast(_row_schema(layer)[bundle_name(f.name)].dataType)
            .alias(bundle_name(f.name)) for f in table
        ]).write.mode("overwrite").json(f"{path}/{layer}")
    shown = F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), "hostname")
    devices.select("device_id", shown.alias("name")).write.mode("overwrite").json(
        f"{path}/deviceNames")
    header = [(K.BUNDLE_FORMAT, K.BUNDLE_VERSION, exported_at)]
    spark.createDataFrame(header, _HEADER).write.mode("overwrite").json(f"{path}/header")


def write_csv(rows: DataFrame, path: str, columns: dict[str, str]) -> None:
    """CSV with titled columns (column -> title); quotes are doubled inside quoted fields."""
    titled = rows.select(*[F.col(c).cast("string").alias(t) for c, t in columns.items()])
    titled.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", nullValue=""
    ).csv(path)


def write_usage_tables(root: str, **tables: DataFrame) -> None:
    """Usage tables below the root, partitioned by day where they have one."""
    for name, rows in tables.items():
        if "usage_date" in rows.columns:
            write_partitions(rows, f"{root}/{name}")
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                f"{root}/{name}")
