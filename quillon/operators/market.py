"""Calendars, forensics, spreads and market context: bars in, bars with observable state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import add_business_days, clip, log, logistic, safe_div, true
from quillon.functions.windows import Bars, ewm, ewms, expanding_quantiles


def add_calendar(df: DataFrame, zones: DataFrame, phases: list[tuple[str, int, int]], default: str = "OUTSIDE_SESSION", opens: int = 18 * 60) -> DataFrame:
    """local_minute, local_date, session_id and session_phase.

    zones: root, zone (IANA), one row a root: a small dimension. A session is the next day's from the opening minute on. Phases are left-closed minute intervals that may
    wrap at midnight; the first that holds wins.
    """
    local = F.from_utc_timestamp("timestamp", F.col("zone"))
    df = df.join(zones, "root", "left").withColumn("q_local", local)
    minute = F.hour("q_local") * 60 + F.minute("q_local")
    phase = None
    for name, a, b in phases:
        inside = (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)
        phase = F.when(inside, name) if phase is None else phase.when(inside, name)
    session = F.when(minute >= opens, F.date_add(F.to_date("q_local"), 1)).otherwise(F.to_date("q_local"))
    return df.withColumns({"local_minute": minute, "local_date": F.to_date("q_local"), "session_id": session, "session_phase": phase.otherwise(default)}).drop("q_local", "zone")


def add_session_positions(df: DataFrame, expected: int) -> DataFrame:
    """bar_in_session, phi (share of the expected session that has passed) and is_truncated (a session of fewer bars than expected)."""
    s = Bars(["root", "session_id"], "timestamp")
    n = F.count("*").over(W.partitionBy("root", "session_id"))
    at = s.number()
    return df.withColumns({"bar_in_session": at.cast("int"), "phi": F.least(at / (expected - 1), F.lit(1.0)), "is_truncated": n < expected})


def infer_sessions(df: DataFrame) -> DataFrame:
    """Usual first and last minute of an instrument's day: medians, and the last minute's 95th percentile (nearest value), as an aggregate of an aggregate."""
    day = df.groupBy("root", F.to_date("timestamp").alias("day")).agg(F.min(F.hour("timestamp") * 60 + F.minute("timestamp")).alias("a"), F.max(F.hour("timestamp") * 60 + F.minute("timestamp")).alias("b"))
    return day.groupBy("root").agg(F.percentile("a", 0.5).alias("opens"), F.percentile("b", 0.5).alias("closes"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY b)").alias("last"), F.count("*").alias("days"))


def roll_table(df: DataFrame) -> DataFrame:
    """Changes of contract: symbols, times, gap in minutes and jump in basis points."""
    w = Bars("root", "timestamp")
    x = df.withColumns({"previous_symbol": w.lag(F.col("local_symbol")), "previous_timestamp": w.lag(F.col("timestamp")), "previous_close": w.lag(F.col("close"))})
    x = x.where(F.col("previous_symbol") != F.col("local_symbol"))
    gap = (F.unix_timestamp("timestamp") - F.unix_timestamp("previous_timestamp")) / 60
    return x.select("root", "previous_symbol", F.col("local_symbol").alias("next_symbol"), "previous_timestamp", F.col("timestamp").alias("next_timestamp"), gap.cast("long").alias("gap_minutes"), (log(F.col("open") / F.col("previous_close")) * 10000).alias("jump_bp"))


def ohlc_violation() -> Column:
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return ~true((F.col("low") <= low) & (low <= high) & (high <= F.col("high")) & F.col("wap").between(F.col("low"), F.col("high")))


def anomalies(df: DataFrame, window: int = 390, least: int = 60, threshold: float = 8.0, step_minutes: int = 1) -> DataFrame:
    """Bars whose return is far from the lagged rolling median in lagged rolling MADs, with the next return and how much of the move it took back."""
    w, r = Bars("root", "timestamp"), F.col("r")
    next_to = F.unix_timestamp("timestamp") - F.unix_timestamp(w.lag(F.col("timestamp"))) == 60 * step_minutes
    fine = true(next_to & (F.col("local_symbol") == w.lag(F.col("local_symbol"))) & ~F.col("is_filled") & ~w.lag(F.col("is_filled")))
    x = df.withColumn("r", F.when(fine, log(F.col("close") / w.lag(F.col("close")))))
    x = x.withColumn("med", w.median(r, window, back=1, least=least)).withColumn("dev", F.abs(r - F.col("med")))
    x = x.withColumns({"mad": w.median(F.col("dev"), window, back=1, least=least), "next_r": w.lag(r, -1)})
    x = x.withColumn("robust_score", safe_div(F.col("dev"), 1.4826 * F.col("mad")))
    return x.where(F.col("robust_score") > threshold).select("root", "timestamp", (r * 10000).alias("ret_bp"), (F.col("next_r") * 10000).alias("next_ret_bp"), safe_div(F.abs(r + F.col("next_r")), F.abs(r)).alias("round_trip_ratio"), "robust_score")


def gap_summary(df: DataFrame) -> DataFrame:
    """How many gaps of each size, a row an instrument."""
    valid = df.where(~F.col("is_filled"))
    gap = (F.unix_timestamp("timestamp") - F.unix_timestamp(Bars("root", "timestamp").lag(F.col("timestamp")))) / 60
    names = ["1m", "2-30m", "30m-1d", ">1d"]
    size = F.when(F.col("g") <= 1, names[0]).when(F.col("g") <= 30, names[1]).when(F.col("g") <= 1440, names[2]).otherwise(names[3])
    return valid.select("root", gap.alias("g")).where("g >= 0").withColumn("size", size).groupBy("root").pivot("size", names).count().fillna(0)


def inventory(df: DataFrame) -> DataFrame:
    """One row an instrument: bars, missing prices, violations, repeated times and gaps."""
    w = Bars("root", "timestamp")
    x = df.withColumns({"q_gap": F.unix_timestamp("timestamp") - F.unix_timestamp(w.lag(F.col("timestamp"))), "q_bad": ohlc_violation()})
    return x.groupBy("root").agg(F.count("*").alias("rows"), F.count_if(F.col("close").isNull()).alias("nulls"), F.count_if("q_bad").alias("violations"), F.count_if(F.col("q_gap") == 0).alias("duplicates"), F.count_if(F.col("q_gap") > 3600).alias("gaps"), F.max("q_gap").alias("longest_gap"))


def chl_products(df: DataFrame) -> DataFrame:
    """Adds chl: the product of close-to-mid-range distances of a bar and the next of its session, if both are valid."""
    s = Bars(["root", "session_id"], "timestamp")
    x = df.withColumn("eta", (log(F.col("high")) + log(F.col("low"))) / 2)
    both = true(F.col("is_valid") & s.lag(F.col("is_valid"), -1))
    return x.withColumn("chl", F.when(both, (log(F.col("close")) - F.col("eta")) * (log(F.col("close")) - s.lag(F.col("eta"), -1))))


def chl_spread(df: DataFrame, ticks: DataFrame) -> DataFrame:
    """Spread by instrument and hour in basis points, one tick at least. ticks: root, tick_bp."""
    curve = chl_products(df).groupBy("root", F.floor(F.col("local_minute") / 60).cast("int").alias("local_hour")).agg(F.avg("chl").alias("chl_mean"), F.count("chl").alias("valid_pairs"))
    raw = 2 * F.sqrt(F.greatest("chl_mean", F.lit(0.0))) * 10000
    return curve.withColumn("chl_raw_bp", F.when(F.col("chl_mean").isNotNull(), raw)).join(ticks.select("root", "tick_bp"), "root", "left").withColumn("spread_bp", F.greatest("chl_raw_bp", "tick_bp"))


def cost_model(curve: DataFrame, commission_bp: Column, multiplier: float = 1.5, slip_ticks: float = 0.5) -> DataFrame:
    return curve.withColumn("round_trip_cost_bp", (F.col("spread_bp") + 2 * slip_ticks * F.col("tick_bp") + 2 * commission_bp) * multiplier)


def causal_chl_spread(df: DataFrame, ticks: DataFrame, least: int = 20) -> DataFrame:
    """spread_bp from the pairs that a bar's close completes or earlier ones did.

    A pair counts for its first bar's hour but is seen at its second bar, and a bar reads its own hour: so pairs and readings are rows of one table, summed
    over (instrument, hour) with pairs first at equal times.
    """
    pairs = chl_products(df).withColumn("q_seen", Bars(["root", "session_id"], "timestamp").lag(F.col("timestamp"), -1))
    hour = F.floor(F.col("local_minute") / 60).cast("int").alias("hour")
    events = pairs.where("chl IS NOT NULL").select("root", hour, F.col("q_seen").alias("at"), F.lit(0).alias("side"), "chl", F.col("timestamp"))
    reads = df.select("root", hour, F.col("timestamp").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("chl"), "timestamp")
    w = W.partitionBy("root", "hour").orderBy("at", "side", "timestamp").rowsBetween(W.unboundedPreceding, 0)
    x = events.unionByName(reads).withColumns({"n": F.count("chl").over(w), "mean": F.avg("chl").over(w)}).where("side = 1")
    raw = F.when(F.col("n") >= least, 2 * F.sqrt(F.greatest("mean", F.lit(0.0))) * 10000).otherwise(0.0)
    return x.join(ticks.select("root", "tick_bp"), "root").select("root", "timestamp", F.greatest(raw, F.col("tick_bp")).alias("spread_bp"))


def session_percentile(sessions: DataFrame, value: str, window: int = 60, least: int = 5) -> DataFrame:
    """sigma_pct: share of up to ``window`` earlier sessions at or below a session's value. At the grain of sessions."""
    w = Bars("root", "session_id")
    earlier = F.filter(F.collect_list(value).over(w.frame(-window, -1)), lambda v: v.isNotNull())
    share = F.size(F.filter(earlier, lambda v: v <= F.col(value))) / F.size(earlier)
    return sessions.withColumn("sigma_pct", F.when((F.size(earlier) >= least) & F.col(value).isNotNull(), share))


def efficiency_ratio(w: Bars, r: Column, n: int) -> Column:
    return clip(safe_div(F.abs(w.sum(r, n)), w.sum(F.abs(r), n)), 0.0, 1.0)


def add_context(df: DataFrame, ticks: DataFrame, q: int = 5, fast: int = 12, slow: int = 96, vr_window: int = 120, least_liquidity: int = 20, spread_pairs: int = 20) -> DataFrame:
    """The market state known at each bar's close.

    df: root, timestamp, ret, sigma_hat, sigma_day, volume, bar_count, session_id, session_phase, local_minute, OHLC, is_valid, expiry (date). The two exponential means are the only
    sequential part; everything else is windows.
    """
    w, z = Bars("root", "timestamp"), F.col("z")
    sessions = session_percentile(df.groupBy("root", "session_id").agg(F.min_by("sigma_day", "timestamp").alias("sigma_day")), "sigma_day").select("root", "session_id", "sigma_pct")
    x = df.join(sessions, ["root", "session_id"], "left").withColumn("z", safe_div(F.col("ret"), F.col("sigma_hat"))).withColumn("zz", z * z)
    x = ewms(x, ["root"], ["timestamp"], {"q_fast": ("zz", fast, {"halflife": fast}), "q_slow": ("zz", min(24, slow), {"halflife": slow})})
    x = x.withColumns({"er_20": efficiency_ratio(w, F.col("ret"), 20), "er_60": efficiency_ratio(w, F.col("ret"), 60), "q_sum": w.sum(z, q), "lv": F.log1p("volume")})
    x = x.withColumns({"vr_5": safe_div(w.var(F.col("q_sum"), vr_window), q * w.var(z, vr_window))})
    key = (["root", "session_phase"], ["timestamp"])
    x = expanding_quantiles(x, *key, "lv", {"q_med": 0.5}, least_liquidity).withColumn("q_dev", F.abs(F.col("lv") - F.col("q_med")))
    x = expanding_quantiles(x, *key, "q_dev", {"q_mad": 0.5}, least_liquidity).withColumn("liq_z", clip(safe_div(F.col("lv") - F.col("q_med"), 1.4826 * F.col("q_mad")), -8.0, 8.0))
    x = x.join(causal_chl_spread(df, ticks, spread_pairs), ["root", "timestamp"]).join(ticks.select("root", "tick_bp"), "root")
    thin = F.coalesce(F.greatest(-F.col("liq_z"), F.lit(0.0)), F.lit(0.0))
    day = F.col("session_id")
    to_expiry = F.datediff(F.col("expiry"), day)
    month_end = F.month(add_business_days(day, 2)) != F.month(day)
    x = x.withColumns({"vol_ratio": safe_div(F.col("q_fast"), F.col("q_slow")), "spread_bp": F.col("spread_bp") * (1 + 0.25 * thin), "avg_trade_size": safe_div(F.col("volume"), F.col("bar_count").cast("double"))})
    parts = [F.tanh(F.col("liq_z") / 2), -F.tanh(log(F.greatest("vol_ratio", F.lit(1e-6)))), 1 - 2 * F.col("sigma_pct"), -F.tanh(log(F.col("spread_bp") / F.col("tick_bp")))]
    parts[1] = F.when(F.col("vol_ratio").isNotNull(), parts[1])
    score = sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)) / 4
    return x.withColumns({
        "gate_score": 0.2 + 1.3 * logistic(score), "is_roll_week": true(to_expiry.between(0, 7)), "is_month_end": month_end, "is_quarter_end": month_end & F.month(day).isin(3, 6, 9, 12),
    }).drop("z", "zz", "q_fast", "q_slow", "q_sum", "lv", "q_med", "q_dev", "q_mad", "tick_bp")


def bipower(df: DataFrame, by: list[str], order: str, r: str) -> DataFrame:
    """Realised variance, bipower variation and jump share by group, on the returns that are there."""
    x = df.where(F.col(r).isNotNull()).withColumn("q_p", F.abs(Bars(by, order).lag(F.col(r))) * F.abs(F.col(r)))
    n = F.count("*")
    bv = F.lit(1.5707963267948966) * n / F.nullif(n - 1, F.lit(0)) * F.sum("q_p")
    return x.groupBy(*by).agg(F.sum(F.pow(r, F.lit(2))).alias("rv"), bv.alias("bv"), n.alias("n_returns")).withColumns({"continuous_var": F.least("rv", "bv"), "jump_var": F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0))})


def session_variation(df: DataFrame, offsets: int = 5, least: int = 10) -> DataFrame:
    """Session variance averaged over offset subsamples; the jump part from the bipower variation of the first.

    df: root, session_id, timestamp, close. Returns of each subsample are taken inside it.
    """
    x = df.withColumn("k", Bars(["root", "session_id"], "timestamp").number() % offsets)
    x = x.withColumn("r", log(F.col("close") / Bars(["root", "session_id", "k"], "timestamp").lag(F.col("close"))))
    each = bipower(x, ["root", "session_id", "k"], "timestamp", "r")
    out = each.groupBy("root", "session_id").agg(F.avg("rv").alias("rv"), F.max(F.when(F.col("k") == 0, F.col("bv"))).alias("bv"), F.sum("n_returns").alias("n_returns"))
    enough = F.col("n_returns") >= least
    return out.withColumns({"continuous_var": F.when(enough, F.least("rv", "bv")), "jump_var": F.when(enough & F.col("bv").isNotNull(), F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))})


def har_records(sessions: DataFrame, week: int = 5, month: int = 22) -> DataFrame:
    """Daily, weekly and monthly log variance, jumps and negative returns, with the next session's log variance as target. No session is left out before the shift."""
    w = Bars("root", "session_id")
    c = F.when(F.col("continuous_var").isNotNull(), F.greatest("continuous_var", F.lit(2.2250738585072014e-308)))
    return sessions.select("root", "session_id", log(c).alias("log_c"), log(w.mean(c, week)).alias("log_c_w"), log(w.mean(c, month)).alias("log_c_m"), F.log1p("jump_var").alias("log1p_j"), clip(F.col("session_ret"), high=0.0).alias("r_neg"), log(w.lag(c, -1)).alias("target_log_c"), w.lag(F.col("session_id"), -1).alias("target_session"))


def finalize_sigma(df: DataFrame, keep: float = 0.97, theta: float = 0.4, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """sigma_hat = session sigma x seasonality x a slow residual scale known before the bar."""
    base = F.col("sigma_day") * F.col("seas")
    x = ewm(df.withColumn("q_r2", F.pow(safe_div(F.col("ret"), base), F.lit(2))), ["root"], ["timestamp"], "q_r2", "q_v", 5, alpha=1 - keep)
    before = Bars("root", "timestamp").lag(F.col("q_v"))
    u = F.coalesce(clip(F.pow(before, F.lit(theta / 2)), low, high), F.lit(1.0))
    return x.withColumn("u", u).withColumn("sigma_hat", base * F.col("u")).drop("q_r2", "q_v")


def har_oos(daily: DataFrame) -> DataFrame:
    """Out-of-sample R squared of har_log_var against the expanding mean, by instrument."""
    w = Bars("root", "session_id")
    x = daily.withColumn("actual", log(F.col("continuous_var")))
    x = x.withColumn("mean", w.expanding(F.avg, F.col("actual"), 1, back=1)).dropna(subset=["har_log_var", "actual", "mean"])
    return x.groupBy("root").agg((1 - F.sum(F.pow(F.col("actual") - F.col("har_log_var"), F.lit(2))) / F.sum(F.pow(F.col("actual") - F.col("mean"), F.lit(2)))).alias("oos_r2"), F.count("*").alias("n_oos"))
