"""Quota and balance snapshots from captured provider responses (config_id, body)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse import constants as K

_LIMITS = """code int, data struct<limits: array<struct<
    unit: int, percentage: int, nextResetTime: bigint>>>"""
_BALANCES = """is_available boolean, balance_infos array<struct<currency: string,
    total_balance: string, granted_balance: string, topped_up_balance: string>>"""


def quota_slots(responses: DataFrame, now_ms: int) -> DataFrame:
    """Usage windows of plan responses; reset_sec is -1 for a window not yet used."""
    limit = F.col("limit")
    until = F.floor((limit.nextResetTime - F.lit(now_ms)) / 1000)
    label, order = F.concat(F.lit("unit "), limit.unit.cast("string")), F.lit(99)
    for place, (unit, name) in reversed(list(enumerate(K.QUOTA_WINDOWS))):
        label = F.when(limit.unit == unit, name).otherwise(label)
        order = F.when(limit.unit == unit, place).otherwise(order)
    return (
        responses.select("config_id", F.from_json("body", _LIMITS).alias("j"))
        .where("j.code = 200").select("config_id", F.explode("j.data.limits").alias("limit"))
        .select(
            "config_id", label.alias("slot"), F.coalesce(limit.percentage, F.lit(0))
            .alias("usage_pct"),
            F.when(limit.nextResetTime > 0, F.greatest(until, F.lit(0))).otherwise(F.lit(-1))
            .cast("bigint").alias("reset_sec"), order.alias("slot_order"),
        ).orderBy("config_id", "slot_order")
    )


def _leading_number(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(text, r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?)", 1).try_cast("double"), F.lit(0.0)
    )


def quota_balances(responses: DataFrame) -> DataFrame:
    """Balances per currency; the first is the headline."""
    b = F.col("b")
    return (
        responses.select("config_id", F.from_json("body", _BALANCES).alias("j"))
        .where("j.is_available").select("config_id", F.posexplode("j.balance_infos").alias("place", "b"))
        .select(
            "config_id", "place", b.currency.alias("currency"),
            _leading_number(b.total_balance).alias("total"),
            _leading_number(b.granted_balance).alias("granted"),
            _leading_number(b.topped_up_balance).alias("topped_up"),
            (F.col("place") == 0).alias("headline"),
        )
    )


def quota_slots_text(responses: DataFrame) -> DataFrame:
    """Usage windows of script-like responses; a window that is not mentioned counts 0."""
    def number(inner: Column, key: str) -> Column:
        text = F.regexp_extract(inner, rf"{key}:([0-9]+)", 1)
        return F.coalesce(text.try_cast("bigint"), F.lit(0))

    def slot(place: int, key: str, name: str) -> Column:
        inner = F.regexp_extract("body", rf"{key}:\$R\[[0-9]+\]=\{{([^}}]*)\}}", 1)
        return F.struct(
            F.lit(place).alias("slot_order"), F.lit(name).alias("slot"),
            number(inner, "usagePercent").alias("usage_pct"),
            number(inner, "resetInSec").alias("reset_sec"),
        )

    slots = F.array(*[slot(p, k, n) for p, (k, n) in enumerate(K.QUOTA_SCRIPT_KEYS)])
    signed_in = ~F.col("body").contains("/auth/authorize")
    return responses.where(signed_in).select("config_id", F.inline(slots))
