"""Parameters of the study.

Fixed values of the reference study (its date window, thresholds, gap limit,
scale and held-out length) and the two test windows laid over the driver's
tables.  Operators take these as defaults; nothing below is data.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values of the reference study -----------------------------------
REF_FROM = "2015-12-31"          # seed day: last trading day before the study
REF_TO = "2021-03-26"
REF_INNER = ("2016-01-01", "2020-12-31")
COMPLETENESS = 0.99              # share of trading days a series must cover
MAX_GAP = 3                      # longest run of missing prices filled by LOCF
RETURN_LIMIT = 1.0               # a daily return above +100 % is an error
SCALE_DAILY = 252                # periods per year, daily
SCALE_MONTHLY = 12               # periods per year, monthly
TEST_ROWS = 58                   # held-out rows at the end of the series
DAYS_PER_YEAR = 252              # "companies with full data" divisor
BENCHMARK = "SP500TR"
REASON_MISSING = "More than 1% missing"
REASON_RETURN = "Return higher than 100%"
MARKETS = ("NASDAQ", "NYSE", "AMEX")
# fixed holidays of the test calendar as (month, day)
FIXED_HOLIDAYS = ((1, 1), (7, 4), (12, 25))


@dataclass(frozen=True)
class StudyWindow:
    """A date window with its seed day and the completeness threshold used."""

    start: str                     # seed day, inclusive
    end: str                       # inclusive
    inner: tuple[str, str]         # sub-window used by the first denominator
    threshold: float
    name: str = ""


# --- test windows over the driver's tables ---------------------------------
W_SHORT = StudyWindow("2023-12-29", "2024-01-30", ("2024-01-01", "2024-01-31"), 0.85, "short")
W_LONG = StudyWindow("1994-12-30", "2001-11-02", ("1995-01-01", "2000-12-31"), 0.60, "long")
W_REFERENCE = StudyWindow(REF_FROM, REF_TO, REF_INNER, COMPLETENESS, "reference")

# assets of the long-window portfolio checks
LONG_ASSETS = ("L1", "L2", "L3")
