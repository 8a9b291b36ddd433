"""Incremental daily refresh of returns (Structured Streaming, one state per symbol)."""

from .daily_refresh import compact, current_prices, current_returns, start_daily_refresh, write_daily_files

__all__ = ["start_daily_refresh", "current_prices", "current_returns", "compact", "write_daily_files"]
