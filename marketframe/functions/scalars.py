"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_days(start: Column, end: Column) -> Column:
    """Array of the weekdays from start to end, both included."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def last_business_days(end: Column, n: Column) -> Column:
    """Array of the last n weekdays up to and including ``end``."""
    back = F.date_sub(end, (F.ceil(n / F.lit(5.0)) * 7 + 2).cast("int"))
    return F.slice(F.reverse(business_days(back, end)), F.lit(1), n)


def scoring_dates(end: Column, horizon: Column) -> Column:
    """The last ``horizon`` weekdays up to ``end`` and the weekdays of the ``horizon`` days after it, sorted."""
    ahead = business_days(end, F.date_add(end, horizon))
    return F.array_sort(F.array_union(last_business_days(end, horizon), ahead))


def price_from_return(close: Column, log_return: Column) -> Column:
    return close * F.exp(log_return)


def confidence(rmse: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + rmse)


def model_key(*parts: Column) -> Column:
    """type_symbol_set_tuning_lookback_horizon_date"""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def finite(c: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when((F.abs(c) != float("inf")) & ~F.isnan(c), c)


def number_or(c: Column, default: float | None = None) -> Column:
    """Text as a number; the default, or NULL, where it is none."""
    n = c.try_cast("double")
    return n if default is None else F.coalesce(n, F.lit(default))


# Bounds and choices of a request.
LOOKBACK_DAYS = (365, 2000)
HORIZON_DAYS = (7, 60)
SYMBOL_LENGTH = (1, 6)
TUNINGS = ("LOW", "MEDIUM", "HIGH")
FEATURE_SET_NAMES = ("basic", "advanced")


def request_errors(symbol: Column, lookback: Column, horizon: Column, tuning: Column, feature_set: Column) -> Column:
    """Names of the fields of a request that are missing or out of bounds."""
    checks = {
        "symbol": F.length(symbol).between(*SYMBOL_LENGTH), "lookback": lookback.between(*LOOKBACK_DAYS),
        "horizon": horizon.between(*HORIZON_DAYS), "tuning": tuning.isin(*TUNINGS),
        "feature_set": feature_set.isin(*FEATURE_SET_NAMES),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]),
                    lambda x: x.isNotNull())
