"""Imports every module that registers queries."""

from importlib import import_module

MODULES = ["report_queries", "ingest_queries", "merge_queries", "scalar_queries", "stream_queries"]


def load() -> None:
    for module in MODULES:
        import_module(f"tallyhouse.plans.{module}")
