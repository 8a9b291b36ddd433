"""Operators: functions DataFrame -> DataFrame.

- ``calendar``     trading calendar, previous trading day, month ends, as-of join
- ``quality``      key / NOT NULL / foreign-key / length checks, cleaning, casts
- ``relational``   company-side joins, semi/anti joins, set operations, sorts
- ``aggregates``   counts, ranges, per-key statistics, calendar joins
- ``prices``       windows, UNION, completeness, exclusions, grid, LOCF, pivot
- ``returns``      strict (SQL) and grid (R) returns, extreme-return screens
- ``series``       row-position operators (head / tail / split) on dates
- ``performance``  statistics, distributions, annualised, CAPM, cumulative,
                   drawdown and box-plot tables
- ``portfolio``    universes, moments and minimum-variance solves per portfolio
"""
