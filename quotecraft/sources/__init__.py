"""Sources and sinks.

- ``fixtures``  market tables derived from the driver's tables (FIXTURES.md)
- ``loaders``   CSV readers with declared schemas, year-folder parquet, window reads
- ``tables``    table lifecycle on files: append, overwrite, store, view, drop
- ``exports``   calendar-preserving exports and wide CSV
- ``refresh``   stored views written in dependency order (stale until refreshed)
"""
