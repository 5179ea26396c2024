"""Rankings and shares per model and source."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.schemas import COST, REQUESTS, TOTAL
from tallyhouse.session import cut_lineage

_INDEX_MASK = (1 << 33) - 1


def model_ranking(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("model")
        .agg(*[F.sum(c).alias(c) for c in (TOTAL, COST, REQUESTS)])
        .orderBy(F.desc(TOTAL), "model")
    )


def with_global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows in the given order without gathering them in one task.

    The sorted rows keep their range partitions; a row's number is its index in the partition
    plus the rows of the partitions before, of which there is one count each.
    """
    placed = cut_lineage(rows.orderBy(*order)).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(_INDEX_MASK).alias("_index"),
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    number = F.col("_offset") + F.col("_index") + 1
    return placed.join(offsets, "_part").select(*rows.columns, number.alias(name))


def rank_models(ranking: DataFrame) -> DataFrame:
    return with_global_rank(ranking, F.desc(TOTAL), F.asc("model"))


def _top(usage: DataFrame, k: int) -> DataFrame:
    """The k models with most tokens, with total and cost; k rows at most."""
    return (
        usage.where("model != ''").groupBy("model")
        .agg(F.sum(TOTAL).alias(TOTAL), F.sum(COST).alias(COST))
        .orderBy(F.desc(TOTAL), "model").limit(k)
    )


def top_models(usage: DataFrame, all_daily: DataFrame, k: int = K.TOP_MODELS) -> DataFrame:
    """Top models with their sources, the largest first, and the days they were active in all data."""
    top = F.broadcast(_top(usage, k))
    names = top.select("model")
    per_source = usage.join(names, "model", "left_semi").groupBy("model", "source").agg(F.sum(TOTAL).alias("t"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), "source")))
    sources = per_source.groupBy("model").agg(F.transform(
        listed, lambda s: F.struct(s["source"].alias("source"), (-s["t"]).alias("total"))).alias("sources"))
    days = (
        all_daily.join(names, "model", "left_semi").where(F.col("usage_date").isNotNull())
        .select("model", "usage_date").distinct()
        .groupBy("model").agg(F.count("*").alias("active_days"))
    )
    return top.join(sources, "model", "left").join(days, "model", "left").select(
        "model", TOTAL, COST, F.get("sources", F.lit(0))["source"].alias("top_source"),
        F.size("sources").cast("bigint").alias("source_count"), "sources",
        F.coalesce("active_days", F.lit(0)).alias("active_days"),
    ).orderBy(F.desc(TOTAL), "model")


def model_source_share(usage: DataFrame, model: str | None = None) -> DataFrame:
    """Tokens and percentage of every source within a model, or within each model."""
    rows = usage.where(F.col("model") == model) if model is not None else usage
    per_source = rows.groupBy("model", "source").agg(F.sum(TOTAL).alias(TOTAL))
    whole = F.sum(TOTAL).over(Window.partitionBy("model"))
    share = F.col(TOTAL) / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return per_source.withColumn("share_pct", F.coalesce(share, F.lit(0.0)))


def top_n_other(usage: DataFrame, n: int = K.DRILL_MODELS) -> DataFrame:
    """Usage whose models outside the top n carry the common label for the rest."""
    top = F.broadcast(_top(usage, n).select("model", F.lit(True).alias("_top")))
    label = F.when(F.col("_top"), F.col("model")).otherwise(F.lit(K.OTHER_MODEL))
    return usage.join(top, "model", "left").withColumn("model_group", label).drop("_top")


def top_source_per_day(usage: DataFrame) -> DataFrame:
    totals = usage.groupBy("usage_date", "source").agg(F.sum(TOTAL).alias("t"))
    first = F.struct((-F.col("t")).alias("t"), "source")
    return totals.groupBy("usage_date").agg(
        F.min_by("source", first).alias("source"), F.max("t").alias(TOTAL)
    )
