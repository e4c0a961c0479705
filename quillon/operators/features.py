"""The bar-close feature set: 56 causal features in seven groups, for any three windows (fast, medium, slow).

Work is laid out in projections of equal depth, so every projection is one window node with one sort, whatever the number of features.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, indicator, log, safe_div
from quillon.functions.windows import Bars, ewms

# The names of the features, by group, and the windows by bar length.
GROUPS = {
    "vol_strength": ["rv_fast", "rv_med", "rv_slow", "rv_fast_slow", "rv_accel", "range_vol_fast", "body_vol_fast", "rv_surprise"],
    "vol_asymmetry": ["up_semivar_fast", "down_semivar_fast", "semivar_balance", "down_up_ratio", "negative_rate_med", "return_vol_corr_med", "upper_wick_med", "lower_wick_med"],
    "path_geometry": ["body_range", "close_location", "range_ratio", "open_gap_z", "vwap_distance", "above_prev_high", "below_prev_low", "reversal_from_high"],
    "trend": ["momentum_fast", "momentum_med", "momentum_slow", "momentum_z_med", "ema_fast_med", "ema_med_slow", "direction_alignment", "breakout_balance"],
    "efficiency": ["efficiency_fast", "efficiency_med", "sign_flip_med", "return_acf1_med", "variance_ratio_2", "choppiness_med", "sign_entropy_med", "path_range_ratio"],
    "participation": ["quote_rel_fast", "quote_rel_slow", "trades_rel_fast", "mean_trade_quote", "flow_imb_fast", "flow_imb_med", "flow_change", "impact_proxy"],
    "time_context": ["hour_sin", "hour_cos", "week_sin", "week_cos", "is_weekend", "asia_hours", "europe_hours", "america_hours"],
}
NAMES = [n for names in GROUPS.values() for n in names]
WINDOWS = {"5m": (12, 48, 288), "15m": (4, 16, 96), "1h": (4, 12, 24)}


def build_features(bars: DataFrame, windows: tuple[int, int, int] = WINDOWS["1h"], with_ema: bool = True) -> DataFrame:
    """bars: root, timestamp, open, high, low, close, quote, bar_count, taker_quote. Returns root, timestamp and the features."""
    fast, med, slow = windows
    w, c = Bars("root", "timestamp"), F.col
    o, h, low, close, q = (c(x) for x in ("open", "high", "low", "close", "quote"))
    before = w.lag(close)
    d = bars.select("root", "timestamp", "open", "high", "low", "close", "quote", "bar_count", "taker_quote").withColumns({
        "lc": log(close), "rng": h - low, "prev": before, "ret": w.diff(log(close)), "ret2": w.diff(log(close), 2),
        "tr": F.greatest(h - low, F.abs(h - before), F.abs(low - before)),
        "uw": safe_div(h - F.greatest(o, close), h - low), "lw": safe_div(F.least(o, close) - low, h - low), "tpq": (h + low + close) / 3 * q,
        "hl2": F.pow(log(h / low), F.lit(2)), "co2": F.pow(log(close / o), F.lit(2)),
    })
    r = c("ret")
    r2 = r * r
    d = d.withColumns({
        "rv_fast": w.sum(r2, fast), "rv_med": w.sum(r2, med), "rv_slow": w.sum(r2, slow), "up": w.sum(F.pow(clip(r, low=0.0), F.lit(2)), fast), "down": w.sum(F.pow(clip(r, high=0.0), F.lit(2)), fast),
        "abs_fast": w.sum(F.abs(r), fast), "abs_med": w.sum(F.abs(r), med), "m_fast": w.diff(c("lc"), fast), "m_med": w.diff(c("lc"), med), "m_slow": w.diff(c("lc"), slow),
        "neg": w.mean(indicator(r < 0), med), "pos": w.mean(indicator(r > 0), med), "flip": indicator(F.signum(r) * F.signum(w.lag(r)) < 0), "before_ret": w.lag(r),
        "q_fast": w.sum(q, fast), "q_med": w.sum(q, med), "q_slow": w.mean(q, slow), "b_fast": w.sum(c("taker_quote"), fast), "b_med": w.sum(c("taker_quote"), med),
        "t_fast": w.sum(c("bar_count").cast("double"), fast), "t_slow": w.mean(c("bar_count").cast("double"), slow),
        "ph": w.max(h, med, back=1), "pl": w.min(low, med, back=1), "hh": w.max(h, med), "ll": w.min(low, med), "tpq_med": w.sum(c("tpq"), med), "tr_med": w.sum(c("tr"), med),
        "v1": w.var(r, med), "v2": w.var(c("ret2"), med), "rng_fast": w.mean(c("rng"), fast), "rng_med": w.mean(c("rng"), med), "uw_med": w.mean(c("uw"), med), "lw_med": w.mean(c("lw"), med),
        "hl_fast": w.sum(c("hl2"), fast), "co_fast": w.sum(c("co2"), fast), "rr": r2,
    })
    d = d.withColumns({
        "rv_before": w.lag(c("rv_fast"), fast), "rv_mean": w.mean(c("rv_fast"), slow), "flip_med": w.mean(c("flip"), med), "corr_rv": w.corr(r, c("rr"), med), "acf": w.corr(r, c("before_ret"), med),
    })
    if with_ema:
        d = ewms(d, ["root"], ["timestamp"], {name: ("close", span, {"span": span}) for name, span in (("ema_fast", fast), ("ema_med", med), ("ema_slow", slow))})
    else:
        d = d.withColumns({x: F.lit(None).cast("double") for x in ("ema_fast", "ema_med", "ema_slow")})
    small = c("rv_slow") * (fast / slow) * 0.01 + 1e-12
    flow_fast, flow_med = 2 * safe_div(c("b_fast"), c("q_fast")) - 1, 2 * safe_div(c("b_med"), c("q_med")) - 1
    p = clip(c("pos"), 1e-8, 1 - 1e-8)
    hour = F.hour("timestamp") + F.minute("timestamp") / 60
    week = F.weekday("timestamp") + hour / 24
    above, below = safe_div(close - c("ph"), close), safe_div(c("pl") - close, close)
    out = {
        "rv_fast": c("rv_fast"), "rv_med": c("rv_med"), "rv_slow": c("rv_slow"), "rv_fast_slow": safe_div(c("rv_fast") / fast, c("rv_slow") / slow), "rv_accel": safe_div(c("rv_fast") - c("rv_before"), c("rv_slow")),
        "range_vol_fast": c("hl_fast"), "body_vol_fast": c("co_fast"), "rv_surprise": safe_div(c("rv_fast"), c("rv_mean")),
        "up_semivar_fast": c("up"), "down_semivar_fast": c("down"), "semivar_balance": safe_div(c("up") - c("down"), c("up") + c("down")), "down_up_ratio": log((c("down") + small) / (c("up") + small)),
        "negative_rate_med": c("neg"), "return_vol_corr_med": c("corr_rv"), "upper_wick_med": c("uw_med"), "lower_wick_med": c("lw_med"),
        "body_range": safe_div(close - o, c("rng")), "close_location": safe_div(close - low, c("rng")) * 2 - 1, "range_ratio": safe_div(c("rng_fast"), c("rng_med")),
        "open_gap_z": safe_div(log(o / c("prev")), F.sqrt(c("rv_med") / med)), "vwap_distance": log(safe_div(close, safe_div(c("tpq_med"), c("q_med")))),
        "above_prev_high": above * indicator(close > c("ph")), "below_prev_low": below * indicator(close < c("pl")), "reversal_from_high": safe_div(close - c("hh"), close),
        "momentum_fast": c("m_fast"), "momentum_med": c("m_med"), "momentum_slow": c("m_slow"), "momentum_z_med": safe_div(c("m_med"), F.sqrt(c("rv_med"))),
        "ema_fast_med": log(c("ema_fast") / c("ema_med")), "ema_med_slow": log(c("ema_med") / c("ema_slow")),
        "direction_alignment": (F.signum(c("m_fast")) + F.signum(c("m_med")) + F.signum(c("m_slow"))) / 3, "breakout_balance": above - below,
        "efficiency_fast": safe_div(F.abs(c("m_fast")), c("abs_fast")), "efficiency_med": safe_div(F.abs(c("m_med")), c("abs_med")), "sign_flip_med": c("flip_med"), "return_acf1_med": c("acf"),
        "variance_ratio_2": safe_div(c("v2"), 2 * c("v1")), "choppiness_med": safe_div(c("tr_med"), c("hh") - c("ll")), "sign_entropy_med": -(p * log(p) + (1 - p) * log(1 - p)),
        "path_range_ratio": safe_div(F.abs(c("m_med")), log(c("hh") / c("ll"))) * safe_div(F.abs(c("pos") - c("neg")), c("pos") + c("neg")),
        "quote_rel_fast": safe_div(c("q_fast") / fast, c("q_slow")), "quote_rel_slow": safe_div(c("q_med") / med, c("q_slow")), "trades_rel_fast": safe_div(c("t_fast") / fast, c("t_slow")),
        "mean_trade_quote": safe_div(c("q_fast"), c("t_fast")), "flow_imb_fast": flow_fast, "flow_imb_med": flow_med, "flow_change": flow_fast - flow_med, "impact_proxy": safe_div(c("abs_fast"), c("q_fast")),
        "hour_sin": F.sin(2 * pi * hour / 24), "hour_cos": F.cos(2 * pi * hour / 24), "week_sin": F.sin(2 * pi * week / 7), "week_cos": F.cos(2 * pi * week / 7),
        "is_weekend": indicator(F.weekday("timestamp") >= 5), "asia_hours": indicator(F.hour("timestamp").between(0, 7)), "europe_hours": indicator(F.hour("timestamp").between(8, 15)), "america_hours": indicator(F.hour("timestamp").between(16, 23)),
    }
    return d.select("root", "timestamp", *[out[n].cast("double").alias(n) for n in NAMES])


def snapshots(fine: DataFrame, coarse: DataFrame, stride: int, fine_minutes: int, coarse_minutes: int) -> DataFrame:
    """Every stride-th fine row with the coarse features that are available at the same time, as ``_fine`` and ``_coarse`` columns.

    A row is available when its bar has closed. Rows without a coarse match keep NULLs.
    """
    def at(df: DataFrame, minutes: int, suffix: str) -> DataFrame:
        return df.select("root", (F.col("timestamp") + F.expr(f"interval {minutes} minutes")).alias("available_at"), *[F.col(n).alias(f"{n}_{suffix}") for n in df.columns if n not in ("root", "timestamp")])

    numbered = fine.withColumn("q_n", Bars("root", "timestamp").number()).where(F.col("q_n") % stride == stride - 1).drop("q_n")
    return at(numbered, fine_minutes, "fine").join(at(coarse, coarse_minutes, "coarse"), ["root", "available_at"], "left")
