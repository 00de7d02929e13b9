"""Forecasts of monthly shares: series preparation and one autoregression per series.

The unit of work is a series (one agent and status), with one row per period. There can be very
many series; each is short.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.functions import dates
from corpusaudit.operators import temporal
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

DEFAULT_LAGS = (1, 3, 6, 12, 24, 48)


def share_series(counts: DataFrame, value: str, statuses: Sequence[str]) -> DataFrame:
    """(agent, status, period, share in percent) with every status in every period."""
    shares = temporal.status_shares(counts, value, statuses)
    return shares.select("agent", "status", "period", (100 * F.col("share")).alias("share"))


def lag_features(
    series: DataFrame, keys: Sequence[str], period: str, value: str, lags: Sequence[int] = DEFAULT_LAGS
) -> DataFrame:
    """Add ``lag_k`` columns and drop rows where any of them is missing."""
    w = W.partitionBy(*keys).orderBy(period)
    out = series.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
    return out.dropna(subset=[f"lag_{k}" for k in lags])


def _autoregression(y: np.ndarray, lags: Sequence[int], steps: int) -> np.ndarray:
    """Least-squares autoregression with intercept, continued ``steps`` times.

    Lags that would leave fewer rows than coefficients are dropped, longest first; a series too
    short for any lag is continued with its last value.
    """
    used = sorted(lags)
    while used and len(y) - used[-1] < len(used) + 2:
        used.pop()
    if not used:
        return np.full(steps, y[-1] if len(y) else np.nan)
    rows = np.arange(used[-1], len(y))
    design = np.column_stack([np.ones(len(rows)), *[y[rows - k] for k in used]])
    beta, *_ = np.linalg.lstsq(design, y[rows], rcond=None)
    history = list(y)
    for _ in range(steps):
        history.append(float(beta[0] + sum(b * history[-k] for b, k in zip(beta[1:], used, strict=True))))
    return np.array(history[len(y):])


def forecast(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    steps: int = 6,
    lags: Sequence[int] = (1,),
    unit: str = "month",
) -> DataFrame:
    """(keys, period, forecast) for the ``steps`` periods after the last one of each series."""
    keys = list(keys)
    lags = tuple(lags)
    types = dict(series.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_last date, _step int, forecast double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("period")
        ahead = _autoregression(ordered[value].to_numpy(dtype=float), lags, steps)
        out = pd.DataFrame({k: [ordered[k].iloc[0]] * steps for k in keys})
        return out.assign(
            _last=ordered["period"].iloc[-1], _step=np.arange(1, steps + 1, dtype="int32"), forecast=ahead
        )

    narrow = series.select(*keys, "period", F.col(value).cast("double").alias(value))
    predicted = narrow.groupBy(*keys).applyInPandas(fit, schema)
    period = F.get(dates.next_periods(F.col("_last"), steps, unit), F.col("_step") - 1)
    return predicted.select(*keys, period.alias("period"), "forecast")


def renormalise(forecasts: DataFrame, group: Sequence[str], value: str = "forecast") -> DataFrame:
    """Clip forecasts at 0 and scale them to a sum of 1 per group (e.g. agent and period)."""
    clipped = F.greatest(F.col(value), F.lit(0.0))
    # a group holds one row per status
    total = F.sum(clipped).over(W.partitionBy(*group))
    return forecasts.withColumn(value, F.try_divide(clipped, total))


def align(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual and forecast values side by side; either may be missing."""
    return actual.join(predicted, list(keys), "outer")


def share_between(counts: DataFrame, restrictive: Column) -> DataFrame:
    """Restricted part of tokens per (period, agent), one conditional aggregate."""
    return counts.groupBy("period", "agent").agg(
        F.try_divide(F.sum(F.when(restrictive, F.col("tokens")).otherwise(0)), F.sum("tokens")).alias("share")
    )
