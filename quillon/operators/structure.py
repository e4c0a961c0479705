"""Volatility-scaled zigzag pivots, confirmed later than they occur, and the path features read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import log, safe_div
from quillon.functions.windows import Bars
from quillon.operators.relational import asof_backward

PIVOTS = "root string, event_time timestamp, confirm_time timestamp, pivot_type string, pivot_price double, direction int, duration_bars long, amp_sigma double, volume_at_confirm double"


def zigzag_step(state: tuple | None, at: int, x: float, limit: float) -> tuple[tuple, tuple | None]:
    """One bar of the walk. State: (leg, extreme, its bar, last pivot, its bar); leg 1 looks for a peak, -1 for a trough. Returns the new state and a pivot (type, level, bar) or None."""
    if state is None:
        return (1, x, at, x, at), None
    leg, best, best_at, pivot, pivot_at = state
    if leg * (x - best) >= 0:
        best, best_at = x, at
    if leg * (best - x) > limit:
        return (-leg, x, at, best, best_at), (leg, best, best_at, pivot, pivot_at)
    return (leg, best, best_at, pivot, pivot_at), None


def zigzag(bars: DataFrame, kappa: float = 2.0, n_ref: int = 12) -> DataFrame:
    """Pivots of each instrument. The walk is sequential, so it is a grouped map by instrument."""
    import math

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values("timestamp", kind="stable").reset_index(drop=True)
        state, out = None, []
        for i, (ok, close, sigma) in enumerate(zip(pdf["is_valid"], pdf["close"], pdf["sigma_hat"])):
            if not ok or not math.isfinite(close) or close <= 0 or sigma is None or not math.isfinite(sigma):
                continue
            state, pivot = zigzag_step(state, i, math.log(close), kappa * sigma * math.sqrt(n_ref))
            if pivot:
                leg, level, at, before, before_at = pivot
                bars_long = max(at - before_at, 1)
                out.append((pdf["root"][0], pdf["timestamp"][at], pdf["timestamp"][i], "peak" if leg > 0 else "trough", math.exp(level), leg, bars_long, abs(level - before) / max(sigma * math.sqrt(bars_long), 1e-12), pdf["volume"][i]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIVOTS.split(", ")])

    return bars.select("root", "timestamp", "is_valid", "close", "sigma_hat", "volume").groupBy("root").applyInPandas(walk, PIVOTS)


def structure_features(bars: DataFrame, kappa: float = 2.0, bar_seconds: int = 300) -> DataFrame:
    """trend_direction, retrace_ratio, time_ratio, pivot_volume_ratio and bars_since_confirm from the last three confirmed pivots, never dated back."""
    w, p = Bars("root", ["confirm_time", "event_time"]), F.col("pivot_price")
    one, two = w.lag(p), w.lag(p, 2)
    rising = F.when(F.col("pivot_type") == "peak", F.when(p > two, 1).otherwise(-1)).otherwise(F.when(p < two, -1).otherwise(1))
    read = zigzag(bars, kappa).select("root", "confirm_time", rising.alias("trend_direction"), safe_div(F.abs(log(p / one)), F.abs(log(one / two))).alias("retrace_ratio"),
        safe_div(F.col("duration_bars").cast("double"), w.lag(F.col("duration_bars")).cast("double")).alias("time_ratio"), safe_div(F.col("volume_at_confirm"), w.lag(F.col("volume_at_confirm"))).alias("pivot_volume_ratio")).where("retrace_ratio IS NOT NULL")
    found = asof_backward(bars, read.withColumn("seen", F.col("confirm_time")), ["root"], "timestamp", "seen", ["trend_direction", "retrace_ratio", "time_ratio", "pivot_volume_ratio", "confirm_time"])
    since = (F.unix_timestamp("timestamp") - F.unix_timestamp("confirm_time")) / bar_seconds
    return found.withColumn("bars_since_confirm", since).drop("confirm_time")
