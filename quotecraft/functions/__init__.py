"""Column-level helpers (``columns``): float32 and integer division, numeric
rounding, date parts, day names, CASE forms."""
