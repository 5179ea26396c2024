"""The questions a usage dashboard asks, over the stored tables."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import filters, merge, pricing, ranking, series
from tallyhouse.plans.collect import UsageStore


class Dashboard:
    """Views for one day ``as_of`` and one display time zone."""

    def __init__(self, store: UsageStore, as_of: date, tz: str):
        self.store, self.as_of, self.tz = store, as_of, tz

    def daily(self) -> DataFrame:
        return filters.daily_series_all(self.store.read("daily"))

    def hour_series(self, days: int = 90) -> DataFrame:
        recent = filters.recent_hours(self.store.read("hour"), days, self.as_of, self.tz)
        return filters.ordered_hours(filters.localized_hours(recent, self.tz))

    def today_events(self) -> DataFrame:
        rows = filters.today_events(self.store.read("event"), self.as_of, self.tz)
        return filters.ordered_events(rows)

    def sessions(self) -> DataFrame:
        return filters.ordered_sessions(self.store.read("session"))

    def model_ranking(self) -> DataFrame:
        return ranking.model_ranking(self.store.read("daily"))

    def model_series(self, model: str) -> tuple[DataFrame, DataFrame]:
        """Day rows and localized hour rows of a model."""
        hours = filters.localized_hours(self.store.read("hour").where(F.col("model") == model), self.tz)
        return filters.model_daily(self.store.read("daily"), model), filters.ordered_hours(hours)

    def in_range(self, range_id: str, sources=(), devices=(), models=()) -> DataFrame:
        """Day rows of a named range; ``all`` takes every day."""
        span = filters.range_span(range_id, self.as_of) or (None, None)
        return filters.filter_daily(self.store.read("daily"), *span, sources, devices, models)

    def kpis(self, range_id: str) -> DataFrame:
        """Totals of a named range and of the span before it."""
        span = filters.range_span(range_id, self.as_of)
        if span is None:
            return series.kpi_totals(self.in_range("all"))
        before = filters.compare_span(range_id, *span)
        return series.kpi_compare(self.store.read("daily"), span, before)

    def heatmap(self) -> DataFrame:
        return series.calendar_heatmap(self.store.read("daily"), self.as_of)

    def prices(self, keyword: str = "") -> DataFrame:
        return filters.ordered_prices(filters.search_prices(self.store.read("prices"), keyword))

    def prices_in_use(self) -> DataFrame:
        return pricing.active_model_prices(self.model_ranking(), self.store.read("prices"))

    def update_prices(self, fetched: DataFrame) -> None:
        self.store.write(prices=merge.upsert_prices(self.store.read("prices"), fetched))

    def override_price(self, edited: DataFrame) -> None:
        self.store.write(prices=merge.override_price(self.store.read("prices"), edited))

    def delete_price(self, keys: DataFrame) -> None:
        self.store.write(prices=merge.delete_price(self.store.read("prices"), keys))

    def devices(self) -> DataFrame:
        return filters.ordered_devices(self.store.read("devices"))

    def rename_device(self, device_id: str, display_name: str) -> None:
        renamed = merge.rename_device(self.store.read("devices"), device_id, display_name)
        self.store.write(devices=renamed)
