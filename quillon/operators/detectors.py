"""Event detectors: transforms from bars with context to (direction, magnitude) signals, by columns only.

A detector is a parameter set and a function of columns; ``signal`` applies one and checks the contract: direction in -1, 0, 1 and magnitude in [0, 1], 0 without a direction. Conditions that
can't be told are false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, log, safe_div, true
from quillon.functions.windows import Bars, expanding_quantiles


@dataclass(frozen=True)
class Detector:
    name: str
    horizon: int
    detect: Callable[[DataFrame, dict], DataFrame]
    params: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ("sigma_hat",)


# The default parameters, grids and horizons in the registrations below.
DETECTORS: dict[str, Detector] = {}


def _register(name: str, horizon: int, params: dict, grid: dict, needs: tuple[str, ...] = ("sigma_hat",)):
    def put(f):
        DETECTORS[name] = Detector(name, horizon, f, params, grid, needs)
        return f

    return put


def signal(name: str, bars: DataFrame, **params) -> DataFrame:
    """root, timestamp, detector, direction, magnitude, horizon."""
    d = DETECTORS[name]
    if missing := [c for c in d.needs if c not in bars.columns]:
        raise ValueError(f"{name} needs {missing}")
    x = d.detect(bars, d.params | params)
    direction = F.coalesce(F.col("direction"), F.lit(0)).cast("int")
    magnitude = F.coalesce(clip(F.col("magnitude"), 0.0, 1.0), F.lit(0.0))
    return x.select("root", "timestamp", F.lit(name).alias("detector"), direction.alias("direction"), F.when(direction != 0, magnitude).otherwise(0.0).alias("magnitude"), F.lit(d.horizon).alias("horizon"))


def _breakout(bars: DataFrame, p: dict) -> DataFrame:
    """Prior range, recent range, volume ratio, side and strength of a breach."""
    w, n, k = Bars("root", "timestamp"), p["lookback"], p["confirm"]
    x = bars.withColumns({
        "ref_high": w.max(F.col("high"), n, back=1), "ref_low": w.min(F.col("low"), n, back=1), "q_high": w.max(F.col("high"), k), "q_low": w.min(F.col("low"), k),
        "volume_ratio": safe_div(w.mean(F.col("volume"), k), w.mean(F.col("volume"), n, back=1)),
    })
    up, down, limit = (F.col("q_high") - F.col("ref_high")) / F.col("close"), (F.col("ref_low") - F.col("q_low")) / F.col("close"), p["alpha"] * F.col("sigma_hat")
    both = F.when(up.isNotNull() & down.isNotNull(), F.greatest(up, down))
    return x.withColumns({"side": F.when(up >= limit, 1).when(down >= limit, -1).otherwise(0), "strength": safe_div(both, limit)})


@_register("D01", 24, {"lookback": 48, "confirm": 4, "alpha": 0.3, "q_lo": 1.2}, {"lookback": [24, 48, 96], "alpha": [0.2, 0.3, 0.4]})
def sweep_reversal(bars: DataFrame, p: dict) -> DataFrame:
    """A breach of the prior range that closed back inside on little volume: against the breach."""
    x = _breakout(bars, p)
    back = ((F.col("side") == 1) & (F.col("close") < F.col("ref_high"))) | ((F.col("side") == -1) & (F.col("close") > F.col("ref_low")))
    on = true(back & (F.col("volume_ratio") < p["q_lo"]))
    size = clip(F.col("strength") - 1, 0.0, 2.0) / 2 * clip(safe_div(F.lit(p["q_lo"]), F.col("volume_ratio")), 0.0, 2.0) / 2
    return x.withColumns({"direction": F.when(on, -F.col("side")).otherwise(0), "magnitude": F.when(on, size)})


@_register("D02", 24, {"lookback": 48, "confirm": 4, "alpha": 0.3, "q_hi": 1.8}, {"lookback": [24, 48, 96], "q_hi": [1.5, 1.8, 2.2]})
def confirmed_breakout(bars: DataFrame, p: dict) -> DataFrame:
    """A breach that held outside on much volume: with the breach. Never at a bar of D01."""
    x = _breakout(bars, p)
    held = ((F.col("side") == 1) & (F.col("close") > F.col("ref_high"))) | ((F.col("side") == -1) & (F.col("close") < F.col("ref_low")))
    on = true(held & (F.col("volume_ratio") > p["q_hi"]))
    size = clip(F.col("strength") - 1, 0.0, 2.0) / 2 * clip(F.col("volume_ratio") / p["q_hi"] - 1, 0.0, 2.0) / 2
    return x.withColumns({"direction": F.when(on, F.col("side")).otherwise(0), "magnitude": F.when(on, size)})


@_register("D03", 24, {"kappa": 2.0, "retrace_lo": 0.3, "retrace_hi": 0.65, "time_ratio": 1.2, "volume_ratio": 0.85}, {"kappa": [1.5, 2.0, 2.5, 3.0], "retrace_hi": [0.55, 0.65, 0.75]})
def lazy_pullback(bars: DataFrame, p: dict) -> DataFrame:
    """A slow, quiet pullback two to four bars after its pivot was confirmed: with the trend."""
    from quillon.operators.structure import structure_features

    x = structure_features(bars, p["kappa"])
    on = true(F.col("bars_since_confirm").between(2, 4) & F.col("retrace_ratio").between(p["retrace_lo"], p["retrace_hi"]) & (F.col("time_ratio") > p["time_ratio"]) & (F.col("pivot_volume_ratio") < p["volume_ratio"]))
    size = clip(p["retrace_hi"] - F.col("retrace_ratio"), low=0.0) / (p["retrace_hi"] - p["retrace_lo"])
    return x.withColumns({"direction": F.when(on, F.col("trend_direction")).otherwise(0), "magnitude": F.when(on, size)})


@_register("D04", 24, {"v_lo": 0.8, "persist": 6, "lookback": 24, "range_window": 120, "range_least": 40, "range_pct": 0.25, "alpha": 0.3}, {"v_lo": [0.7, 0.8, 0.9], "lookback": [12, 24, 48], "range_pct": [0.2, 0.25, 0.3]}, ("sigma_hat", "vol_ratio"))
def compression_break(bars: DataFrame, p: dict) -> DataFrame:
    """A close beyond the range after steadily low volatility and a narrow range."""
    w = Bars("root", "timestamp")
    x = bars.withColumns({"q_calm": true(w.max(F.col("vol_ratio"), p["persist"], back=1) < p["v_lo"]), "q_high": w.max(F.col("high"), p["lookback"], back=1), "q_low": w.min(F.col("low"), p["lookback"], back=1)})
    x = x.withColumn("q_width", log(F.col("q_high") / F.col("q_low"))).withColumn("q_rank", w.share_below(F.col("q_width"), p["range_window"], p["range_least"]))
    limit = p["alpha"] * F.col("sigma_hat")
    above, below = log(F.col("close") / F.col("q_high")), log(F.col("q_low") / F.col("close"))
    base = F.col("q_calm") & (F.col("q_rank") < p["range_pct"])
    up, down = true(base & (above > limit)), true(base & (below > limit))
    return x.withColumns({"direction": F.when(up, 1).when(down, -1).otherwise(0), "magnitude": F.when(up | down, (safe_div(F.greatest(above, below), limit) - 1) / 2)})


@_register("D05", 12, {"confirm_bars": 3, "small_z": 0.5, "large_z": 1.5, "cash_minute": 570, "cash_step": 5, "cash_roots": ()}, {"confirm_bars": [2, 3, 4], "small_z": [0.4, 0.5, 0.6], "large_z": [1.2, 1.5, 1.8]}, ("sigma_hat", "bar_in_session", "session_id"))
def open_repricing(bars: DataFrame, p: dict) -> DataFrame:
    """Small moves since the open revert, large ones go on; the base is the last close of the session before, or of the bars before the cash open."""
    w, k = Bars("root", "timestamp"), p["confirm_bars"]
    changed = ~true(F.col("session_id") == w.lag(F.col("session_id")))
    x = bars.withColumn("q_base", F.when(changed, w.lag(F.col("close"))))
    x = x.withColumns({"q_base": w.ffill(F.col("q_base")), "q_cash_base": w.lag(F.col("close"), k)})
    opening = true(F.col("bar_in_session") == k - 1)
    cash = true(F.col("root").isin(*p["cash_roots"]) & (F.col("local_minute") == p["cash_minute"] + (k - 1) * p["cash_step"])) if p["cash_roots"] else F.lit(False)
    z = safe_div(log(F.col("close") / F.when(opening, F.col("q_base")).otherwise(F.col("q_cash_base"))), F.col("sigma_hat") * F.sqrt(F.lit(float(k))))
    x = x.withColumn("z", z).withColumn("q_on", opening | cash)
    small, large = true(F.col("q_on") & (F.abs("z") < p["small_z"])), true(F.col("q_on") & (F.abs("z") > p["large_z"]))
    return x.withColumns({
        "direction": F.when(small, -F.signum("z")).when(large, F.signum("z")).otherwise(0),
        "magnitude": F.when(small, (p["small_z"] - F.abs("z")) / p["small_z"]).when(large, clip((F.abs("z") - p["large_z"]) / p["large_z"], 0.0, 1.0)),
    })


@_register("D06", 12, {"k": 1, "tail_q": 0.15, "min_bars": 1000, "follower": "HSI"}, {"k": [1, 2, 3, 6, 12], "tail_q": [0.1, 0.15, 0.2]}, ("sigma_hat", "es_ret_z", "ret"))
def leader_residual(bars: DataFrame, p: dict) -> DataFrame:
    """The follower's move beyond its lagged expanding beta to the leader's: against it, in the lagged expanding tails.

    Expanding quantiles are exact, over one instrument's history, by a growing sorted list.
    """
    w, n, k = Bars("root", "timestamp"), p["min_bars"], p["k"]
    x = bars.where(F.col("root") == p["follower"]).withColumns({"own": w.sum(safe_div(F.col("ret"), F.col("sigma_hat")), k), "es": w.sum(F.col("es_ret_z"), k)})
    past = w.w.rowsBetween(W.unboundedPreceding, -1)
    both = F.when(F.col("own").isNotNull() & F.col("es").isNotNull(), 1)
    cov = F.when(F.count(both).over(past) >= n, F.covar_samp("own", "es").over(past))
    x = x.withColumn("residual", F.col("own") - safe_div(cov, w.expanding(F.var_samp, F.col("es"), n, back=1)) * F.col("es"))
    r = F.col("residual")
    x = expanding_quantiles(x, ["root"], ["timestamp"], "residual", {"q_lo": p["tail_q"], "q_hi": 1 - p["tail_q"]}, n)
    on = true((r < F.col("q_lo")) | (r > F.col("q_hi")))
    found = x.select("root", "timestamp", F.when(on, -F.signum(r)).otherwise(0).alias("direction"), F.when(on, safe_div(F.abs(r), (F.col("q_hi") - F.col("q_lo")) / 2) - 1).alias("magnitude"))
    return bars.select("root", "timestamp").join(found, ["root", "timestamp"], "left")


@_register("D07", 12, {"d_lo": 0.8, "d_hi": 2.0, "slope_window": 12, "flat_slope": 0.15}, {"d_lo": [0.5, 0.8], "d_hi": [1.5, 2.0, 2.5], "slope_window": [6, 12, 24]}, ("sigma_hat", "bar_in_session", "session_id"))
def session_vwap(bars: DataFrame, p: dict) -> DataFrame:
    """Far from a flat session VWAP: back to it. Apart from it in the direction of its slope: on."""
    s = Bars(["root", "session_id"], "timestamp")
    v = F.when(F.col("is_valid"), F.col("volume")).otherwise(0.0)
    x = bars.withColumn("vwap", safe_div(s.running(F.sum, F.col("wap") * v), s.running(F.sum, v)))
    x = x.withColumns({"dev": safe_div(log(F.col("close") / F.col("vwap")), F.col("sigma_hat") * F.sqrt(F.col("bar_in_session") + 1.0)), "slope": safe_div(log(F.col("vwap") / s.lag(F.col("vwap"), p["slope_window"])), F.col("sigma_hat") * F.sqrt(F.lit(float(p["slope_window"]))))})
    a = F.abs("dev")
    back, on = true((a > p["d_hi"]) & (F.abs("slope") < p["flat_slope"])), true(a.between(p["d_lo"], p["d_hi"]) & (F.signum("dev") == F.signum("slope")))
    return x.withColumns({"direction": F.when(back, -F.signum("dev")).when(on, F.signum("dev")).otherwise(0), "magnitude": F.when(back, clip((a - p["d_hi"]) / p["d_hi"], 0.0, 1.0)).when(on, (a - p["d_lo"]) / (p["d_hi"] - p["d_lo"]))})


@_register("D08", 12, {"z_threshold": 0.8, "event_minute": 930, "roots": ("ES", "NQ", "RTY")}, {"z_threshold": [0.5, 0.8, 1.1], "event_minute": [900, 930, 945]}, ("sigma_hat", "ret", "local_minute", "is_month_end", "is_quarter_end", "is_half_day"))
def close_rebalance(bars: DataFrame, p: dict) -> DataFrame:
    """A large session move shortly before the close: against it, more so at month and quarter ends."""
    s = Bars(["root", "session_id"], "timestamp")
    x = bars.withColumn("z", s.running(F.sum, F.coalesce(safe_div(F.col("ret"), F.col("sigma_hat")), F.lit(0.0))))
    on = true(F.col("root").isin(*p["roots"]) & (F.col("local_minute") == p["event_minute"]) & ~F.col("is_half_day") & (F.abs("z") > p["z_threshold"]))
    boost = 1 + 0.25 * F.col("is_month_end").cast("double") + 0.25 * F.col("is_quarter_end").cast("double")
    return x.withColumns({"direction": F.when(on, -F.signum("z")).otherwise(0), "magnitude": F.when(on, clip((F.abs("z") - p["z_threshold"]) / 2, 0.0, 1.0) * boost)})


def detector_gate(name: str, low: float = 0.2, high: float = 1.5) -> Column:
    """How favourable the regime is to a detector: a logistic of the mean of its signed components, in [low, high]."""
    er = 2 * clip(F.col("er_20"), 0.0, 1.0) - 1
    grow = F.tanh(log(F.when(F.col("vol_ratio").isNotNull(), F.greatest("vol_ratio", F.lit(1e-6)))) / 0.4)
    low_sigma, mid_sigma = 1 - 2 * clip(F.col("sigma_pct"), 0.0, 1.0), 1 - 4 * clip(F.abs(F.col("sigma_pct") - 0.5), 0.0, 0.5)
    usual, liquid = 1 - 2 * clip(F.abs("liq_z") / 3.0, 0.0, 1.0), F.tanh(F.col("liq_z") / 2)
    edge = F.when(F.col("session_phase").isin("US_OPEN", "US_CLOSE"), -1.0).otherwise(1.0)
    lunch = F.when(F.col("session_phase") == "US_LUNCH", 1.0).otherwise(-0.25)
    parts = {
        "D01": [-er, -grow, mid_sigma, usual, edge], "D02": [er, grow, liquid], "D03": [er, mid_sigma, liquid], "D04": [low_sigma, grow, usual], "D05": [usual, mid_sigma], "D06": [usual, mid_sigma],
        "D07": [(-er - grow + lunch) / 3, usual],
        "D08": [F.greatest(F.least(F.col("is_month_end").cast("double") + F.col("is_quarter_end").cast("double") - 0.5, F.lit(1.0)), F.lit(-1.0)), usual],
    }[name]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in parts), F.lit(0))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)) / F.nullif(n, F.lit(0))
    return low + (high - low) / (1 + F.exp(-F.coalesce(mean, F.lit(0.0))))
