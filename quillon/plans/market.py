"""Bars, returns, labels and features as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import safe_div
from quillon.functions.windows import Bars
from quillon.operators import bars as B
from quillon.operators.features import NAMES, WINDOWS, build_features
from quillon.plans.sql import BARS, RETURNS, W, ewm, lag, ln, rounded, strict

BAR_COLUMNS = ["open", "high", "low", "close", "volume", "quote", "taker_quote", "wap"]


def rnd(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Both engines round alike; sums of doubles differ in their last bits only."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def bars_1h(spark, d):
    return rnd(B.bars_of(spark, d), BAR_COLUMNS).withColumn("session_id", F.col("session_id").cast("string"))


def valid_mask(spark, d):
    return B.valid_mask(B.bars_of(spark, d)).select("root", "timestamp", "is_real", "is_flat", "is_filled")


def grid_1h(spark, d):
    return rnd(B.on_grid(B.bars_of(spark, d)), ["open", "high", "low", "close", "wap"])


def returns_1h(spark, d):
    return rnd(B.add_returns(B.bars_of(spark, d)).select("root", "timestamp", "is_roll_boundary", "ret", "overnight_ret"), ["ret", "overnight_ret"], 9)


def labels_1h(spark, d):
    bars = B.add_returns(B.bars_of(spark, d)).withColumn("sigma_hat", F.lit(0.01))
    out = B.add_labels(bars, (6, 12, 24))
    names = [f"{p}_{h}" for h in (6, 12, 24) for p in ("fwd_ret", "fwd_ret_z")]
    return rnd(out.select("root", "timestamp", *names, *[f"label_valid_{h}" for h in (6, 12, 24)]), names)


def vol_expansion(spark, d):
    """The flagship: is an instrument's realised volatility expanding, hour by hour?"""
    w = Bars("root", "timestamp")
    r = B.add_returns(B.bars_of(spark, d)).withColumn("r2", F.pow("ret", F.lit(2.0)))
    r = r.select("root", "timestamp", w.sum(F.col("r2"), 4, least=2).alias("rv_fast"), w.sum(F.col("r2"), 24, least=12).alias("rv_slow"))
    return rnd(r.withColumn("ratio", safe_div(F.col("rv_fast") / 4, F.col("rv_slow") / 24)), ["rv_fast", "rv_slow", "ratio"])


def features_1h(spark, d):
    return rnd(build_features(B.bars_of(spark, d)), NAMES, 5)


def minutes_to_bars(spark, d):
    minutes = B.resample(B.ticks(spark.read.parquet(f"{d}/events.parquet")), "1 minute").withColumn("local_symbol", F.col("root"))
    out = B.resample_minutes(minutes, "1 hour")
    return rnd(out.select("root", "timestamp", "local_symbol", "open", "high", "low", "close", "wap", "volume", "bar_count", "n_valid", "is_valid"), ["wap"])


F_, M_, S_ = WINDOWS["1h"]
_LABEL_SQL = ", ".join(
    f"""round(CASE WHEN ok_{h} THEN ln(lead(close, {h}) OVER ({W}) / close) END, 6) + 0.0 AS fwd_ret_{h},
        round(CASE WHEN ok_{h} THEN ln(lead(close, {h}) OVER ({W}) / close) / (0.01 * sqrt({h})) END, 6) + 0.0 AS fwd_ret_z_{h}, ok_{h} AS label_valid_{h}"""
    for h in (6, 12, 24)
)
_OK_SQL = ", ".join(
    f"""coalesce(lead(close, {h}) OVER ({W}) IS NOT NULL AND sum(is_valid::INT) OVER ({W} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) >= 0.6 * {h + 1}
        AND sum(is_roll_boundary::INT) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = 0 AND sum(chg) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) <= 1, false) AS ok_{h}"""
    for h in (6, 12, 24)
)
_div = lambda a, b: f"({a}) / nullif({b}, 0)"
_corr = lambda x, y, n: f"""CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n}
    AND NOT isnan(corr({x}, {y}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) THEN corr({x}, {y}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"""  # noqa: E731
_FEATURE_SQL = f"""
    WITH {BARS},
    a AS (SELECT *, ln(close) AS lc, high - low AS rng, {lag('close')} AS prev, ln(close) - {lag('ln(close)')} AS ret, ln(close) - {lag('ln(close)', 2)} AS ret2, row_number() OVER ({W}) - 1 AS t,
          CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr,
          (high - greatest(open, close)) / nullif(high - low, 0) AS uw, (least(open, close) - low) / nullif(high - low, 0) AS lw, (high + low + close) / 3 * quote AS tpq,
          ln(high / low) ** 2 AS hl2, ln(close / open) ** 2 AS co2, hour(timestamp) + minute(timestamp) / 60.0 AS hr, isodow(timestamp) - 1 AS dow FROM bars),
    b AS (SELECT *, ret * ret AS rr, CASE WHEN ret IS NOT NULL THEN least(ret, 0) ** 2 END AS down2, CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END AS is_neg,
          CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS is_pos, CASE WHEN sign(ret) * sign({lag('ret')}) < 0 THEN 1.0 ELSE 0.0 END AS flip, {lag('ret')} AS before_ret, abs(ret) AS ar FROM a),
    c AS (SELECT *, {strict('sum', 'rr', F_)} AS rv_fast, {strict('sum', 'rr', M_)} AS rv_med, {strict('sum', 'rr', S_)} AS rv_slow,
          {strict('sum', 'CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) ** 2 END', F_)} AS up, {strict('sum', 'down2', F_)} AS down,
          {strict('sum', 'ar', F_)} AS abs_fast, {strict('sum', 'ar', M_)} AS abs_med, lc - {lag('lc', F_)} AS m_fast, lc - {lag('lc', M_)} AS m_med, lc - {lag('lc', S_)} AS m_slow,
          {strict('avg', 'is_neg', M_)} AS neg, {strict('avg', 'is_pos', M_)} AS pos, {strict('sum', 'quote', F_)} AS q_fast, {strict('sum', 'quote', M_)} AS q_med, {strict('avg', 'quote', S_)} AS q_slow,
          {strict('sum', 'taker_quote', F_)} AS b_fast, {strict('sum', 'taker_quote', M_)} AS b_med, {strict('sum', 'bar_count', F_)} AS t_fast, {strict('avg', 'bar_count', S_)} AS t_slow,
          {strict('max', 'high', M_, 1)} AS ph, {strict('min', 'low', M_, 1)} AS pl, {strict('max', 'high', M_)} AS hh, {strict('min', 'low', M_)} AS ll,
          {strict('sum', 'tpq', M_)} AS tpq_med, {strict('sum', 'tr', M_)} AS tr_med, {strict('var_samp', 'ret', M_)} AS v1, {strict('var_samp', 'ret2', M_)} AS v2,
          {strict('avg', 'rng', F_)} AS rng_fast, {strict('avg', 'rng', M_)} AS rng_med, {strict('avg', 'uw', M_)} AS uw_med, {strict('avg', 'lw', M_)} AS lw_med,
          {strict('sum', 'hl2', F_)} AS hl_fast, {strict('sum', 'co2', F_)} AS co_fast, {strict('avg', 'flip', M_)} AS flip_med, {_corr('ret', 'rr', M_)} AS corr_rv, {_corr('ret', 'before_ret', M_)} AS acf,
          {ewm('close', f'(2.0 / {F_ + 1})', F_)} AS ema_fast, {ewm('close', f'(2.0 / {M_ + 1})', M_)} AS ema_med, {ewm('close', f'(2.0 / {S_ + 1})', S_)} AS ema_slow FROM b),
    d AS (SELECT *, {lag('rv_fast', F_)} AS rv_before, {strict('avg', 'rv_fast', S_)} AS rv_mean, rv_slow * {F_ / S_} * 0.01 + 1e-12 AS small, CASE WHEN pos IS NOT NULL THEN least(greatest(pos, 1e-8), 1 - 1e-8) END AS p,
          2 * b_fast / nullif(q_fast, 0) - 1 AS ff, 2 * b_med / nullif(q_med, 0) - 1 AS fm, (close - ph) / close AS above, (pl - close) / close AS below FROM c),
    e AS (SELECT root, timestamp, rv_fast, rv_med, rv_slow, {_div(f'rv_fast / {F_}', f'rv_slow / {S_}')} AS rv_fast_slow, {_div('rv_fast - rv_before', 'rv_slow')} AS rv_accel, hl_fast AS range_vol_fast, co_fast AS body_vol_fast,
          {_div('rv_fast', 'rv_mean')} AS rv_surprise, up AS up_semivar_fast, down AS down_semivar_fast, {_div('up - down', 'up + down')} AS semivar_balance, ln((down + small) / (up + small)) AS down_up_ratio,
          neg AS negative_rate_med, corr_rv AS return_vol_corr_med, uw_med AS upper_wick_med, lw_med AS lower_wick_med, {_div('close - open', 'rng')} AS body_range, {_div('close - low', 'rng')} * 2 - 1 AS close_location,
          {_div('rng_fast', 'rng_med')} AS range_ratio, {_div('ln(open / prev)', f'sqrt(rv_med / {M_})')} AS open_gap_z, ln(close / (tpq_med / q_med)) AS vwap_distance,
          above * CASE WHEN close > ph THEN 1.0 ELSE 0.0 END AS above_prev_high, below * CASE WHEN close < pl THEN 1.0 ELSE 0.0 END AS below_prev_low, (close - hh) / close AS reversal_from_high,
          m_fast AS momentum_fast, m_med AS momentum_med, m_slow AS momentum_slow, {_div('m_med', 'sqrt(rv_med)')} AS momentum_z_med, ln(ema_fast / ema_med) AS ema_fast_med, ln(ema_med / ema_slow) AS ema_med_slow,
          (sign(m_fast) + sign(m_med) + sign(m_slow)) / 3.0 AS direction_alignment, above - below AS breakout_balance, {_div('abs(m_fast)', 'abs_fast')} AS efficiency_fast, {_div('abs(m_med)', 'abs_med')} AS efficiency_med,
          flip_med AS sign_flip_med, acf AS return_acf1_med, {_div('v2', '2 * v1')} AS variance_ratio_2, {_div('tr_med', 'hh - ll')} AS choppiness_med, -(p * ln(p) + (1 - p) * ln(1 - p)) AS sign_entropy_med,
          {_div('abs(m_med)', ln('hh / ll'))} * {_div('abs(pos - neg)', 'pos + neg')} AS path_range_ratio, {_div(f'q_fast / {F_}', 'q_slow')} AS quote_rel_fast, {_div(f'q_med / {M_}', 'q_slow')} AS quote_rel_slow,
          {_div(f't_fast / {float(F_)}', 't_slow')} AS trades_rel_fast, {_div('q_fast', 't_fast')} AS mean_trade_quote, ff AS flow_imb_fast, fm AS flow_imb_med, ff - fm AS flow_change, {_div('abs_fast', 'q_fast')} AS impact_proxy,
          sin(2 * pi() * hr / 24) AS hour_sin, cos(2 * pi() * hr / 24) AS hour_cos, sin(2 * pi() * (dow + hr / 24) / 7) AS week_sin, cos(2 * pi() * (dow + hr / 24) / 7) AS week_cos,
          (dow >= 5)::INT::DOUBLE AS is_weekend, (hour(timestamp) BETWEEN 0 AND 7)::INT::DOUBLE AS asia_hours, (hour(timestamp) BETWEEN 8 AND 15)::INT::DOUBLE AS europe_hours, (hour(timestamp) >= 16)::INT::DOUBLE AS america_hours FROM d)
    SELECT root, timestamp, {rounded(NAMES, 5)} FROM e"""

_VALID = "NOT (NOT (bar_count > 0 AND volume > 0) OR (open = high AND high = low AND low = close AND volume = 0))"
SQL = {
    "vol_expansion": f"""WITH {RETURNS}, a AS (SELECT *, ret * ret AS r2 FROM bars_r),
        b AS (SELECT root, timestamp, {strict('sum', 'r2', 4, least=2)} AS rv_fast, {strict('sum', 'r2', 24, least=12)} AS rv_slow FROM a)
        SELECT root, timestamp, {rounded(['rv_fast', 'rv_slow'])}, round((rv_fast / 4) / nullif(rv_slow / 24, 0), 6) + 0.0 AS ratio FROM b""",
    "bars_1h": f"WITH {BARS} SELECT root, timestamp, {rounded(BAR_COLUMNS)}, bar_count, is_valid, session_id::VARCHAR AS session_id, local_symbol FROM bars",
    "valid_mask": f"""WITH {BARS} SELECT root, timestamp, bar_count > 0 AND volume > 0 AS is_real, open = high AND high = low AND low = close AS is_flat, NOT {_VALID} AS is_filled FROM bars""",
    "grid_1h": f"""WITH {BARS}, g AS (SELECT root, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM bars GROUP BY root),
        j AS (SELECT g.root, g.timestamp, b.* EXCLUDE (root, timestamp) FROM g LEFT JOIN bars b ON g.root = b.root AND g.timestamp = b.timestamp)
        SELECT root, timestamp, {', '.join(f"round(last_value({p} IGNORE NULLS) OVER ({W}), 6) + 0.0 AS {p}" for p in ('open', 'high', 'low', 'close', 'wap'))},
               coalesce(volume, 0.0) AS volume, coalesce(bar_count, 0) AS bar_count, coalesce(is_valid, false) AS is_valid FROM j""",
    "returns_1h": f"WITH {RETURNS} SELECT root, timestamp, is_roll_boundary, {rounded(['ret', 'overnight_ret'], 9)} FROM bars_r",
    "labels_1h": f"""WITH {RETURNS}, x AS (SELECT *, CASE WHEN session_id = {lag('session_id')} THEN 0 ELSE 1 END AS chg FROM bars_r), y AS (SELECT *, {_OK_SQL} FROM x)
        SELECT root, timestamp, {_LABEL_SQL} FROM y""",
    "features_1h": _FEATURE_SQL,
    "minutes_to_bars": """WITH t AS (SELECT event_type AS root, ts, event_id, 100.0 + value AS price, (1 + user_id % 5)::DOUBLE AS volume FROM events)
        SELECT root, date_trunc('hour', ts) AS timestamp, root AS local_symbol, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
               round(sum(price * volume) / sum(volume), 6) + 0.0 AS wap, sum(volume) AS volume, count(*) AS bar_count, count(DISTINCT date_trunc('minute', ts)) AS n_valid,
               count(DISTINCT date_trunc('minute', ts)) >= 2 AS is_valid FROM t GROUP BY root, date_trunc('hour', ts)""",
}
QUERIES = {f.__name__: f for f in (vol_expansion, bars_1h, valid_mask, grid_1h, returns_1h, labels_1h, features_1h, minutes_to_bars)}
