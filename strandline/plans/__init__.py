"""Named queries over the shared tables, and the rules behind them."""

from strandline.plans import cache_queries, compiled_queries, detail_queries, exchange_queries, gold_queries, ingest_queries, normalize_queries, record_queries, resolution, rule_queries, sleep_queries, stream_queries, window_queries  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
