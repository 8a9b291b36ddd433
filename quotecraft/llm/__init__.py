"""Operators for preparing training text, one module each.

Nothing else in the library imports this package.  Every operator takes
DataFrames and column names, selects only the columns it needs (further
columns, whatever their names, never reach it) and returns a DataFrame; the
checked queries in ``queries`` derive their digest columns from those results.
"""
