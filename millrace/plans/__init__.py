"""Plans that compose the operators, and the registered queries."""

import importlib

MODULES = ("reliability_queries", "order_queries", "feature_queries", "table_queries", "text_queries", "stream_queries", "store_queries", "measure_queries", "source_queries")


def registered():
    """The registry after every module of queries has been imported."""
    for name in MODULES:
        importlib.import_module(f"millrace.plans.{name}")
    return importlib.import_module("millrace.plans.registry")
