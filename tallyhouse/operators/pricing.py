"""Price catalogue, price resolution per model, and cost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.models import (
    bare_model, comparable, dash_prefixes, fuzzy_score, price_candidates, trimmed,
)
from tallyhouse.functions.tokens import usage_cost
from tallyhouse.operators.lookup import lookup_join
from tallyhouse.schemas import COST, RATES, TOTAL
from tallyhouse.session import cut_lineage

_ENTRY = """struct<input_cost_per_token: double, output_cost_per_token: double,
    cache_read_input_token_cost: double, cache_creation_input_token_cost: double>"""


def is_excluded(key: Column) -> Column:
    return F.lower(key).startswith(K.EXCLUDED_PRICE_PREFIX)


def load_price_catalog(docs: DataFrame, fetched_at: str) -> DataFrame:
    """Price rows of catalogue documents in ``value``: {fetchedAt, data: {...}} or the bare map.

    ``fetched_at`` dates a document that does not date itself. Subscription keys and entries
    without input and output price are left out.
    """
    outer = F.from_json("value", "fetchedAt bigint, data string")
    wrapped = outer.data.isNotNull()
    body = F.when(wrapped, outer.data).otherwise(F.col("value"))
    stamp = F.when(wrapped & (outer.fetchedAt > 0), F.timestamp_millis(outer.fetchedAt))
    entries = F.from_json(body, "map<string, string>")
    rows = docs.select(
        F.date_trunc("second", F.coalesce(stamp, F.lit(fetched_at).cast("timestamp")))
        .alias("fetched_at"),
        F.explode(entries).alias("model_key", "entry"),
    ).withColumn("e", F.from_json("entry", _ENTRY.strip()))
    e, zero = F.col("e"), F.lit(0.0)
    return rows.select(
        "model_key",
        F.coalesce(e.input_cost_per_token, zero).alias("input_rate"),
        F.coalesce(e.output_cost_per_token, zero).alias("output_rate"),
        F.coalesce(e.cache_read_input_token_cost, zero).alias("cache_read_rate"),
        F.coalesce(e.cache_creation_input_token_cost, zero).alias("cache_write_rate"),
        "fetched_at",
    ).where(((F.col("input_rate") != 0) | (F.col("output_rate") != 0))
            & ~is_excluded(F.col("model_key")))


def distinct_models(usage: DataFrame) -> DataFrame:
    return usage.select("model").where(F.col("model").isNotNull()).distinct()


def _names_to_try(model_id: Column) -> Column:
    """Array of (way, rank, name): the candidates in order, and the model's own name and its
    "-" prefixes for the fuzzy search."""
    own = comparable(model_id)
    heads = F.concat(F.array(own), dash_prefixes(own))
    none = F.array().cast("array<struct<way: string, rank: int, name: string>>")
    candidates = F.transform(price_candidates(model_id), lambda name, rank: F.struct(
        F.lit("exact").alias("way"), rank.alias("rank"), name.alias("name")))
    extends_key = F.transform(heads, lambda name: F.struct(
        F.lit("extends").alias("way"), F.lit(0).alias("rank"), name.alias("name")))
    own_name = F.array(F.struct(
        F.lit("extended").alias("way"), F.lit(0).alias("rank"), own.alias("name")))
    fuzzy = F.octet_length(model_id) >= K.FUZZY_MIN_LENGTH
    return F.concat(candidates, F.when(fuzzy, F.concat(extends_key, own_name)).otherwise(none))


def _names_of_key(key: Column) -> Column:
    """Array of (way, tier, name) under which a catalogue key is found: as written, without
    ``openai/``, in lower case; for the fuzzy search its bare name and that name's prefixes."""
    def found(way: str, tier: int, name: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), F.lit(tier).alias("tier"), name.alias("name"))

    bare = comparable(bare_model(key))
    exact = F.array(
        found("exact", 0, key),
        found("exact", 1, F.when(key.startswith("openai/"), F.substr(key, F.lit(8)))),
        found("exact", 2, F.lower(key)),
    )
    fuzzy = F.concat(
        F.array(found("extends", 0, bare)),
        F.transform(dash_prefixes(bare), lambda name: found("extended", 0, name)),
    )
    none = F.array().cast("array<struct<way: string, tier: int, name: string>>")
    return F.concat(exact, F.when(is_excluded(key), none).otherwise(fuzzy))


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_key, match, rates) of the models that have a price.

    An exact match is the first candidate name with a price: as written, under ``openai/``, then
    in any case. Failing that, the best scored key that equals the model name, extends it or is
    extended by it at a "-". All are equal joins on names, so one join and one aggregation
    decide; equal scores go to the smallest key.
    """
    model_id = trimmed(F.lower("model"))
    tried = models.select("model", model_id.alias("id")).where("id != ''").select(
        "model", "id", F.inline(_names_to_try(F.col("id"))))
    listed = prices.select("model_key", *RATES, F.inline(_names_of_key(F.col("model_key"))))
    fuzzy = F.col("way") != "exact"
    rank = F.when(fuzzy, -fuzzy_score(F.col("model_key"), F.col("id"))).otherwise(F.col("rank"))
    order = F.struct(fuzzy, rank.alias("rank"), "tier", "model_key")
    match = F.when(fuzzy, "fuzzy").otherwise("exact").alias("match")
    return (
        tried.join(listed, ["way", "name"]).groupBy("model")
        .agg(F.min_by(F.struct(F.col("model_key").alias("price_key"), match, *RATES), order)
             .alias("hit"))
        .select("model", "hit.*")
    )


def price_events(usage: DataFrame, resolved: DataFrame) -> DataFrame:
    """Usage with its cost; the facts are not shuffled while the resolved models stay small."""
    rated = lookup_join(usage, resolved.select("model", *RATES), "model")
    return rated.withColumn(COST, usage_cost()).select(*usage.columns, COST)


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Resolve the models in use once, then price every row.

    The resolved models are stored, so the pass that finds the models runs once.
    """
    return price_events(usage, cut_lineage(resolve_prices(distinct_models(usage), prices)))


def active_model_prices(ranking: DataFrame, prices: DataFrame) -> DataFrame:
    """Models in use with the price listed under their full or bare name, if any.

    Among keys that share a name the last in key order counts.
    """
    key = F.lower("model_key")
    names = F.array_distinct(F.array(key, F.element_at(F.split(key, "/"), -1)))
    listed = (
        prices.select(F.explode(names).alias("name"), "model_key", *RATES)
        .groupBy("name").agg(F.max_by(F.struct("model_key", *RATES), "model_key").alias("p"))
    )
    used = ranking.where(F.col(TOTAL) > 0).withColumn("name", F.lower("model"))
    has_price = (F.col("p.input_rate") > 0) | (F.col("p.output_rate") > 0)
    return used.join(listed, "name", "left").select(
        F.col("model").alias("model_key"), TOTAL, *[F.col(f"p.{r}") for r in RATES],
        F.coalesce(has_price, F.lit(False)).alias("has_price"),
    ).orderBy("model_key")


def price_meta(prices: DataFrame) -> DataFrame:
    return prices.agg(
        F.max("fetched_at").alias("fetched_at"), F.count("*").alias("price_count")
    )
