"""Calendar, forensics, spread, context, volatility and detectors as queries, over hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.scalars import log, safe_div
from quillon.functions.windows import Bars
from quillon.operators import bars as B
from quillon.operators import detectors as D
from quillon.operators import market as M
from quillon.operators.structure import structure_features, zigzag
from quillon.plans.market import rnd
from quillon.plans.sql import BARS, W, ewm, lag, strict

ROOTS = ["click", "error", "purchase", "signup", "view"]
SMALL = {
    "D01": {"lookback": 12, "confirm": 2, "q_lo": 1.2, "alpha": 0.3}, "D02": {"lookback": 12, "confirm": 2, "q_hi": 1.05, "alpha": 0.3}, "D03": {"kappa": 0.5}, "D04": {"v_lo": 1.6, "persist": 2, "lookback": 6, "range_window": 40, "range_least": 12, "range_pct": 0.5},
    "D05": {}, "D06": {"min_bars": 100, "follower": "view", "k": 2}, "D07": {"slope_window": 3, "flat_slope": 0.5, "d_lo": 0.2, "d_hi": 0.6}, "D08": {"event_minute": 900, "roots": ("click", "view", "error"), "z_threshold": 0.3},
}


def ticks(bars):
    return bars.groupBy("root").agg((F.lit(0.01) / F.percentile("close", 0.5) * 10000).alias("tick_bp"))


def state(spark, d):
    """Hourly bars with the columns that context and detectors need."""
    w, s = Bars("root", "timestamp"), Bars(["root", "session_id"], "timestamp")
    m = log(F.col("close") / F.col("open"))
    hour = F.hour("timestamp")
    x = B.add_returns(B.bars_of(spark, d)).withColumn("m2", F.pow(m, F.lit(2.0)))
    x = x.withColumns({
        "ret": log(F.col("close") / w.lag(F.col("close"))), "sigma_hat": F.sqrt(w.mean(F.col("m2"), 24, back=1, least=12)), "local_minute": hour * 60, "bar_in_session": s.number().cast("int"),
        "session_phase": F.when(hour < 8, "ASIA").when(hour < 16, "EUROPE").otherwise("AMERICA"), "is_half_day": F.lit(False),
        "expiry": F.date_add(F.lit("2024-01-01").cast("date"), (F.floor((F.dayofmonth("timestamp") - 1) / 10.0).cast("int") + 1) * 10),
    }).drop("m2")
    day = s.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumn("sigma_day", F.first("sigma_hat").over(day))


def context(spark, d):
    x = state(spark, d)
    return M.add_context(x, ticks(x), fast=12, slow=24, vr_window=24, least_liquidity=10, spread_pairs=5)


CONTEXT = ["sigma_hat", "sigma_pct", "vol_ratio", "er_20", "er_60", "vr_5", "liq_z", "spread_bp", "avg_trade_size", "gate_score"]


def context_1h(spark, d):
    return rnd(context(spark, d).select("root", "timestamp", *CONTEXT, "is_roll_week", "is_month_end", "is_quarter_end"), CONTEXT, 5)


def calendar_ny(spark, d):
    zones = spark.createDataFrame([(r, "America/New_York" if r < "n" else "Asia/Hong_Kong") for r in ROOTS], "root string, zone string")
    phases = [("NIGHT", 18 * 60, 3 * 60), ("MORNING", 9 * 60 + 30, 12 * 60), ("LUNCH", 12 * 60, 14 * 60), ("CLOSE", 15 * 60, 16 * 60)]
    x = M.add_calendar(B.bars_of(spark, d).drop("session_id"), F.broadcast(zones), phases)
    x = M.add_session_positions(x, 24)
    return rnd(x.select("root", "timestamp", F.col("local_minute").cast("int").alias("local_minute"), F.col("session_id").cast("string").alias("session_id"), "session_phase", "bar_in_session", "phi", "is_truncated"), ["phi"])


def session_hours(spark, d):
    return rnd(M.infer_sessions(B.ticks(spark.read.parquet(f"{d}/events.parquet")).withColumnRenamed("ts", "timestamp")).withColumn("last", F.col("last").cast("double")), ["opens", "closes", "last"])


def roll_table(spark, d):
    return rnd(M.roll_table(B.bars_of(spark, d)), ["jump_bp"])


def ohlc_violations(spark, d):
    x = B.bars_of(spark, d).withColumn("high", F.when(F.hour("timestamp") == 5, F.col("close") - 1).otherwise(F.col("high")))
    return x.where(M.ohlc_violation()).select("root", "timestamp", "high", "close")


def anomalies(spark, d):
    x = B.valid_mask(B.bars_of(spark, d)).withColumn("local_symbol", F.col("root"))
    return rnd(M.anomalies(x, 48, 6, 2.0, 60), ["ret_bp", "next_ret_bp", "round_trip_ratio", "robust_score"], 4)


def gap_summary(spark, d):
    return M.gap_summary(B.valid_mask(B.bars_of(spark, d)))


def raw_inventory(spark, d):
    return M.inventory(B.bars_of(spark, d))


def chl_spread(spark, d):
    x = state(spark, d)
    out = M.cost_model(M.chl_spread(x, ticks(x)), F.lit(0.05))
    return rnd(out.select("root", "local_hour", "valid_pairs", "chl_raw_bp", "spread_bp", "round_trip_cost_bp"), ["chl_raw_bp", "spread_bp", "round_trip_cost_bp"], 4)


def causal_spread(spark, d):
    x = state(spark, d)
    return rnd(M.causal_chl_spread(x, ticks(x), 5), ["spread_bp"], 4)


def session_variation(spark, d):
    return rnd(M.session_variation(B.bars_of(spark, d), 3, 8).withColumn("session_id", F.col("session_id").cast("string")), ["rv", "bv", "continuous_var", "jump_var"])


def _daily(spark, d):
    v = M.session_variation(B.bars_of(spark, d), 3, 8)
    r = B.bars_of(spark, d).groupBy("root", "session_id").agg(F.ln(F.max_by("close", "timestamp") / F.min_by("open", "timestamp")).alias("session_ret"))
    return v.join(r, ["root", "session_id"])


def har_records(spark, d):
    x = M.har_records(_daily(spark, d))
    names = ["log_c", "log_c_w", "log_c_m", "log1p_j", "r_neg", "target_log_c"]
    return rnd(x.withColumns({"session_id": F.col("session_id").cast("string"), "target_session": F.col("target_session").cast("string")}), names)


def har_oos(spark, d):
    x = _daily(spark, d).withColumn("har_log_var", Bars("root", "session_id").lag(log(F.col("continuous_var"))))
    return rnd(M.har_oos(x), ["oos_r2"])


def finalized_sigma(spark, d):
    x = state(spark, d).withColumn("seas", 1 + F.hour("timestamp") / 100.0)
    return rnd(M.finalize_sigma(x).select("root", "timestamp", "u", "sigma_hat"), ["u", "sigma_hat"])


def detector_frame(spark, d):
    z = safe_div(F.col("ret"), F.col("sigma_hat"))


    lead = F.max(F.when(F.col("root") == "purchase", F.col("z"))).over(Window.partitionBy("timestamp"))
    return context(spark, d).withColumn("z", z).withColumn("es_ret_z", lead).drop("z")


def _detector(name):
    def run(spark, d):
        x = state(spark, d) if name in ("D01", "D02", "D03", "D05", "D07") else detector_frame(spark, d)
        return rnd(D.signal(name, x, **SMALL[name]).select("root", "timestamp", "direction", "magnitude"), ["magnitude"], 5)

    run.__name__ = f"detector_{name.lower()}"
    return run


def gates(spark, d):
    x = context(spark, d)
    return rnd(x.select("root", "timestamp", *[D.detector_gate(n).alias(f"gate_{n.lower()}") for n in ("D01", "D02", "D04", "D05", "D08")]), [f"gate_{n}" for n in ("d01", "d02", "d04", "d05", "d08")], 5)


def zigzag_pivots(spark, d):
    return rnd(zigzag(state(spark, d), 0.5, 4), ["pivot_price", "amp_sigma"])


def structure_1h(spark, d):
    names = ["retrace_ratio", "time_ratio", "pivot_volume_ratio", "bars_since_confirm"]
    return rnd(structure_features(state(spark, d), 0.5, 3600).select("root", "timestamp", "trend_direction", *names), names)


STATE = f"""{BARS},
s0 AS (SELECT *, ln(close / open) ** 2 AS m2, ln(close / {lag('close')}) AS ret, (hour(timestamp) * 60)::INT AS local_minute, (row_number() OVER (PARTITION BY root, session_id ORDER BY timestamp) - 1)::INT AS bar_in_session,
       CASE WHEN hour(timestamp) < 8 THEN 'ASIA' WHEN hour(timestamp) < 16 THEN 'EUROPE' ELSE 'AMERICA' END AS session_phase, false AS is_half_day,
       DATE '2024-01-01' + ((floor((day(timestamp) - 1) / 10.0)::INT + 1) * 10) AS expiry FROM bars),
s1 AS (SELECT *, sqrt({strict('avg', 'm2', 24, 1, 12)}) AS sigma_hat FROM s0),
st AS (SELECT *, first_value(sigma_hat) OVER (PARTITION BY root, session_id ORDER BY timestamp) AS sigma_day FROM s1),
tk AS (SELECT root, 0.01 / median(close) * 10000 AS tick_bp FROM bars GROUP BY root)"""
_S = "PARTITION BY root, session_id ORDER BY timestamp"
_CHL = f"""ch0 AS (SELECT *, (ln(high) + ln(low)) / 2 AS eta FROM st),
ch AS (SELECT *, CASE WHEN is_valid AND coalesce(lead(is_valid) OVER ({_S}), false) THEN (ln(close) - eta) * (ln(close) - lead(eta) OVER ({_S})) END AS chl, lead(timestamp) OVER ({_S}) AS seen FROM ch0)"""
_CAUSAL = f"""{_CHL},
ev AS (SELECT root, local_minute // 60 AS hr, seen AS at_, 0 AS side, chl, timestamp FROM ch WHERE chl IS NOT NULL UNION ALL SELECT root, local_minute // 60, timestamp, 1, NULL, timestamp FROM st),
es AS (SELECT *, count(chl) OVER w AS n, avg(chl) OVER w AS mean FROM ev WINDOW w AS (PARTITION BY root, hr ORDER BY at_, side, timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cs AS (SELECT root, timestamp, greatest(CASE WHEN n >= 5 THEN 2 * sqrt(greatest(mean, 0.0)) * 10000 ELSE 0.0 END, tick_bp) AS spread_bp FROM es JOIN tk USING (root) WHERE side = 1)"""
_EW = lambda x, h, least: f"SELECT root, timestamp, {ewm(x, f'(1 - exp(-ln(2.0) / {h}))', least)} AS y FROM (SELECT *, row_number() OVER ({W}) - 1 AS t FROM zz WHERE zz IS NOT NULL)"
_CONTEXT = f"""{STATE}, {_CAUSAL},
ses0 AS (SELECT root, session_id, any_value(sigma_day) AS sd, row_number() OVER (PARTITION BY root ORDER BY session_id) AS i FROM st GROUP BY root, session_id),
ses AS (SELECT root, session_id, CASE WHEN count(sd) OVER w >= 5 AND sd IS NOT NULL THEN list_sum(list_transform(list_filter(list(sd) OVER w, lambda v: v IS NOT NULL), lambda v: (v <= sd)::INT)) / count(sd) OVER w END AS sigma_pct
        FROM ses0 WINDOW w AS (PARTITION BY root ORDER BY session_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
zz AS (SELECT root, timestamp, ret / sigma_hat AS z, (ret / sigma_hat) ** 2 AS zz, ln(1 + volume) AS lv, abs(ret) AS ar, st.* EXCLUDE (root, timestamp) FROM st),
ef AS ({_EW('zz', 12, 12)}), el AS ({_EW('zz', 24, 24)}),
c1 AS (SELECT *, least(greatest(abs({strict('sum', 'ret', 20)}) / nullif({strict('sum', 'ar', 20)}, 0), 0), 1) AS e20, least(greatest(abs({strict('sum', 'ret', 60)}) / nullif({strict('sum', 'ar', 60)}, 0), 0), 1) AS e60,
       {strict('sum', 'ret', 20)} AS s20, {strict('sum', 'ret', 60)} AS s60, {strict('sum', 'z', 5)} AS qs, CASE WHEN count(lv) OVER p >= 10 THEN median(lv) OVER p END AS med FROM zz WINDOW p AS (PARTITION BY root, session_phase ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, {strict('var_samp', 'qs', 24)} / nullif(5 * {strict('var_samp', 'z', 24)}, 0) AS vr_5, abs(lv - med) AS dev FROM c1),
c3 AS (SELECT *, CASE WHEN count(dev) OVER p >= 10 THEN median(dev) OVER p END AS mad FROM c2 WINDOW p AS (PARTITION BY root, session_phase ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c4 AS (SELECT *, CASE WHEN (lv - med) / nullif(1.4826 * mad, 0) IS NOT NULL THEN least(greatest((lv - med) / nullif(1.4826 * mad, 0), -8), 8) END AS liq_z FROM c3),
c5 AS (SELECT c4.*, sigma_pct, ef.y / nullif(el.y, 0) AS vol_ratio, CASE WHEN s20 IS NOT NULL THEN e20 END AS er_20, CASE WHEN s60 IS NOT NULL THEN e60 END AS er_60,
       cs.spread_bp * (1 + 0.25 * coalesce(greatest(-liq_z, 0), 0)) AS spread_bp, tick_bp, volume / bar_count AS avg_trade_size,
       isodow(session_id) AS dow FROM c4 LEFT JOIN ses USING (root, session_id) LEFT JOIN ef USING (root, timestamp) LEFT JOIN el USING (root, timestamp) JOIN cs USING (root, timestamp) JOIN tk USING (root)),
cx AS (SELECT *, 0.2 + 1.3 / (1 + exp(-(coalesce(tanh(liq_z / 2), 0) + coalesce(CASE WHEN vol_ratio IS NOT NULL THEN -tanh(ln(greatest(vol_ratio, 1e-6))) END, 0) + coalesce(1 - 2 * sigma_pct, 0) + coalesce(-tanh(ln(spread_bp / tick_bp)), 0)) / 4)) AS gate_score,
       (expiry - session_id) BETWEEN 0 AND 7 AS is_roll_week, month(session_id + CASE WHEN dow > 5 THEN 2 - (dow - 5) + 0 + 0 WHEN dow > 3 THEN 4 ELSE 2 END::INT + CASE WHEN dow > 5 THEN 0 + 0 ELSE 0 END::INT) AS m_next FROM c5)"""
# A weekend day counts from its Friday: two business days on is the Tuesday after, 3 days from Saturday and 2 from Sunday.
_CONTEXT = _CONTEXT.replace("CASE WHEN dow > 5 THEN 2 - (dow - 5) + 0 + 0 WHEN dow > 3 THEN 4 ELSE 2 END::INT + CASE WHEN dow > 5 THEN 0 + 0 ELSE 0 END::INT", "(CASE dow WHEN 6 THEN 3 WHEN 7 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 2 END)::INT")


def _sig(cte: str, direction: str, magnitude: str, base: str = STATE) -> str:
    return f"""WITH {base}, {cte}, zz_ AS (SELECT root, timestamp, coalesce({direction}, 0)::INT AS direction, {magnitude} AS mag FROM fx)
        SELECT root, timestamp, direction, round(CASE WHEN direction <> 0 THEN coalesce(least(greatest(mag, 0), 1), 0) ELSE 0 END, 5) + 0.0 AS magnitude FROM zz_"""


_BRK = f"""br AS (SELECT *, {strict('max', 'high', 12, 1)} AS rh, {strict('min', 'low', 12, 1)} AS rl, {strict('max', 'high', 2)} AS qh, {strict('min', 'low', 2)} AS ql, {strict('avg', 'volume', 2)} / nullif({strict('avg', 'volume', 12, 1)}, 0) AS vr FROM st),
bs AS (SELECT *, (qh - rh) / close AS up, (rl - ql) / close AS dn, 0.3 * sigma_hat AS lim FROM br),
fx AS (SELECT *, CASE WHEN up >= lim THEN 1 WHEN dn >= lim THEN -1 ELSE 0 END AS side, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN greatest(up, dn) / nullif(lim, 0) END AS strength FROM bs)"""
_D1 = "coalesce(((side = 1 AND close < rh) OR (side = -1 AND close > rl)) AND vr < 1.2, false)"
_D2 = "coalesce(((side = 1 AND close > rh) OR (side = -1 AND close < rl)) AND vr > 1.05, false)"
SQL = {
    "context_1h": f"WITH {_CONTEXT} SELECT root, timestamp, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in CONTEXT)}, is_roll_week, m_next <> month(session_id) AS is_month_end, m_next <> month(session_id) AND month(session_id) IN (3, 6, 9, 12) AS is_quarter_end FROM cx",
    "calendar_ny": f"""WITH {BARS}, a AS (SELECT root, timestamp, timezone(CASE WHEN root < 'n' THEN 'America/New_York' ELSE 'Asia/Hong_Kong' END, timestamp::TIMESTAMP AT TIME ZONE 'UTC') AS loc FROM bars),
        b AS (SELECT *, (hour(loc) * 60 + minute(loc))::INT AS lm FROM a), c AS (SELECT *, CASE WHEN lm >= 1080 THEN loc::DATE + 1 ELSE loc::DATE END AS sid FROM b),
        e AS (SELECT *, row_number() OVER (PARTITION BY root, sid ORDER BY timestamp) - 1 AS pos, count(*) OVER (PARTITION BY root, sid) AS n FROM c)
        SELECT root, timestamp, lm AS local_minute, sid::DATE::VARCHAR AS session_id, CASE WHEN lm >= 1080 OR lm < 180 THEN 'NIGHT' WHEN lm >= 570 AND lm < 720 THEN 'MORNING' WHEN lm >= 720 AND lm < 840 THEN 'LUNCH' WHEN lm >= 900 AND lm < 960 THEN 'CLOSE' ELSE 'OUTSIDE_SESSION' END AS session_phase,
               pos::INT AS bar_in_session, round(least(pos / 23.0, 1.0), 6) + 0.0 AS phi, n < 24 AS is_truncated FROM e""",
    "session_hours": """WITH y AS (SELECT event_type AS root, ts::DATE AS day, min(hour(ts) * 60 + minute(ts)) AS a, max(hour(ts) * 60 + minute(ts)) AS b FROM events GROUP BY ALL)
        SELECT root, round(quantile_cont(a, 0.5), 6) + 0.0 AS opens, round(quantile_cont(b, 0.5), 6) + 0.0 AS closes, quantile_disc(b, 0.95)::DOUBLE AS last, count(*) AS days FROM y GROUP BY root""",
    "roll_table": f"""WITH {BARS}, x AS (SELECT *, {lag('local_symbol')} AS ps, {lag('timestamp')} AS pt, {lag('close')} AS pc FROM bars)
        SELECT root, ps AS previous_symbol, local_symbol AS next_symbol, pt AS previous_timestamp, timestamp AS next_timestamp, (date_diff('second', pt, timestamp) / 60)::BIGINT AS gap_minutes, round(ln(open / pc) * 10000, 6) + 0.0 AS jump_bp FROM x WHERE ps <> local_symbol""",
    "ohlc_violations": f"""WITH {BARS}, x AS (SELECT root, timestamp, open, low, close, wap, CASE WHEN hour(timestamp) = 5 THEN close - 1 ELSE high END AS high FROM bars)
        SELECT root, timestamp, high, close FROM x WHERE NOT (low <= least(open, close) AND greatest(open, close) <= high AND wap BETWEEN low AND high)""",
    "anomalies": f"""WITH {BARS}, a AS (SELECT *, NOT (bar_count > 0 AND volume > 0) AS filled FROM bars),
        b AS (SELECT *, CASE WHEN date_diff('second', {lag('timestamp')}, timestamp) = 3600 AND NOT filled AND NOT {lag('filled')} THEN ln(close / {lag('close')}) END AS r FROM a),
        c AS (SELECT *, {strict('median', 'r', 48, 1, 6)} AS med FROM b), e AS (SELECT *, abs(r - med) AS dev FROM c), f AS (SELECT *, {strict('median', 'dev', 48, 1, 6)} AS mad, lead(r) OVER ({W}) AS nr FROM e)
        SELECT root, timestamp, round(r * 10000, 4) + 0.0 AS ret_bp, round(nr * 10000, 4) + 0.0 AS next_ret_bp, round(abs(r + nr) / nullif(abs(r), 0), 4) + 0.0 AS round_trip_ratio, round(dev / nullif(1.4826 * mad, 0), 4) + 0.0 AS robust_score
        FROM f WHERE dev / nullif(1.4826 * mad, 0) > 2""",
    "gap_summary": f"""WITH {BARS}, g AS (SELECT root, date_diff('second', {lag('timestamp')}, timestamp) / 60 AS g FROM bars)
        SELECT root, count(*) FILTER (g <= 1) AS "1m", count(*) FILTER (g > 1 AND g <= 30) AS "2-30m", count(*) FILTER (g > 30 AND g <= 1440) AS "30m-1d", count(*) FILTER (g > 1440) AS ">1d" FROM g WHERE g IS NOT NULL GROUP BY root""",
    "raw_inventory": f"""WITH {BARS}, x AS (SELECT *, date_diff('second', {lag('timestamp')}, timestamp) AS g FROM bars)
        SELECT root, count(*) AS rows, count(*) FILTER (close IS NULL) AS nulls, count(*) FILTER (NOT (low <= least(open, close) AND greatest(open, close) <= high AND wap BETWEEN low AND high)) AS violations,
               count(*) FILTER (g = 0) AS duplicates, count(*) FILTER (g > 3600) AS gaps, max(g) AS longest_gap FROM x GROUP BY root""",
    "chl_spread": f"""WITH {STATE}, {_CHL}, c AS (SELECT root, (local_minute // 60)::INT AS local_hour, avg(chl) AS m, count(chl) AS valid_pairs FROM ch GROUP BY ALL),
        r AS (SELECT *, CASE WHEN m IS NOT NULL THEN 2 * sqrt(greatest(m, 0)) * 10000 END AS raw FROM c JOIN tk USING (root))
        SELECT root, local_hour, valid_pairs, round(raw, 4) + 0.0 AS chl_raw_bp, round(greatest(raw, tick_bp), 4) + 0.0 AS spread_bp, round((greatest(raw, tick_bp) + tick_bp + 0.1) * 1.5, 4) + 0.0 AS round_trip_cost_bp FROM r""",
    "causal_spread": f"WITH {STATE}, {_CAUSAL} SELECT root, timestamp, round(spread_bp, 4) + 0.0 AS spread_bp FROM cs",
}
_VAR = f"""{BARS}, k AS (SELECT *, (row_number() OVER ({_S}) - 1) % 3 AS k FROM bars), kr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY root, session_id, k ORDER BY timestamp)) AS r FROM k),
kp AS (SELECT *, abs(lag(r) OVER (PARTITION BY root, session_id, k ORDER BY timestamp)) * abs(r) AS p FROM kr WHERE r IS NOT NULL),
ke AS (SELECT root, session_id, k, sum(r * r) AS rv, pi() / 2 * count(*) / nullif(count(*) - 1, 0) * sum(p) AS bv, count(*) AS n FROM kp GROUP BY ALL),
sv AS (SELECT root, session_id, avg(rv) AS rv, max(CASE WHEN k = 0 THEN bv END) AS bv, sum(n)::BIGINT AS n_returns FROM ke GROUP BY ALL),
sw AS (SELECT *, CASE WHEN n_returns >= 8 THEN least(rv, bv) END AS continuous_var, CASE WHEN n_returns >= 8 AND bv IS NOT NULL THEN greatest(rv - bv, 0) END AS jump_var FROM sv),
sx AS (SELECT sw.*, session_ret FROM sw JOIN (SELECT root, session_id, ln(last(close ORDER BY timestamp) / first(open ORDER BY timestamp)) AS session_ret FROM bars GROUP BY ALL) USING (root, session_id))"""
_D = "PARTITION BY root ORDER BY session_id"
SQL |= {
    "session_variation": f"WITH {_VAR} SELECT root, session_id::VARCHAR AS session_id, round(rv, 6) + 0.0 AS rv, round(bv, 6) + 0.0 AS bv, n_returns, round(continuous_var, 6) + 0.0 AS continuous_var, round(jump_var, 6) + 0.0 AS jump_var FROM sw",
    "har_records": f"""WITH {_VAR} SELECT root, session_id::VARCHAR AS session_id, round(ln(continuous_var), 6) + 0.0 AS log_c, round(ln({strict('avg', 'continuous_var', 5, w=_D)}), 6) + 0.0 AS log_c_w, round(ln({strict('avg', 'continuous_var', 22, w=_D)}), 6) + 0.0 AS log_c_m,
        round(ln(1 + jump_var), 6) + 0.0 AS log1p_j, round(least(session_ret, 0), 6) + 0.0 AS r_neg, round(ln(lead(continuous_var) OVER ({_D})), 6) + 0.0 AS target_log_c, lead(session_id) OVER ({_D})::VARCHAR AS target_session FROM sx""",
    "har_oos": f"""WITH {_VAR}, a AS (SELECT *, ln(continuous_var) AS y, lag(ln(continuous_var)) OVER ({_D}) AS f FROM sx), b AS (SELECT *, avg(y) OVER ({_D} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a)
        SELECT root, round(1 - sum((y - f) ** 2) / sum((y - m) ** 2), 6) + 0.0 AS oos_r2, count(*) AS n_oos FROM b WHERE y IS NOT NULL AND f IS NOT NULL AND m IS NOT NULL GROUP BY root""",
    "detector_d01": _sig(_BRK, f"CASE WHEN {_D1} THEN -side END", "least(greatest(strength - 1, 0), 2) / 2 * least(greatest(1.2 / nullif(vr, 0), 0), 2) / 2"),
    "detector_d02": _sig(_BRK, f"CASE WHEN {_D2} THEN side END", "least(greatest(strength - 1, 0), 2) / 2 * least(greatest(vr / 1.05 - 1, 0), 2) / 2"),
    "detector_d04": _sig(
        f"""q0 AS (SELECT *, coalesce({strict('max', 'vol_ratio', 2, 1)} < 1.6, false) AS calm, {strict('max', 'high', 6, 1)} AS qh, {strict('min', 'low', 6, 1)} AS ql FROM cx), q1 AS (SELECT *, ln(qh / ql) AS width FROM q0),
        q2 AS (SELECT *, CASE WHEN width IS NOT NULL AND count(width) OVER ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) >= 12 THEN list_sum(list_transform(list_filter(list(width) OVER h, lambda v: v IS NOT NULL), lambda v: (v <= width)::INT)) / nullif(count(width) OVER h, 0) END AS rk,
               ln(close / qh) AS above, ln(ql / close) AS below FROM q1 WINDOW h AS ({W} ROWS BETWEEN 39 PRECEDING AND 1 PRECEDING)), fx AS (SELECT *, 0.3 * sigma_hat AS lim FROM q2)""",
        "CASE WHEN calm AND rk < 0.5 AND above > lim THEN 1 WHEN calm AND rk < 0.5 AND below > lim THEN -1 END", "(greatest(above, below) / nullif(lim, 0) - 1) / 2", _CONTEXT,
    ),
    "detector_d05": _sig(
        f"""q0 AS (SELECT *, CASE WHEN session_id = {lag('session_id')} THEN NULL ELSE {lag('close')} END AS b0 FROM st), q1 AS (SELECT *, last_value(b0 IGNORE NULLS) OVER ({W}) AS base FROM q0),
        fx AS (SELECT *, bar_in_session = 2 AS on_, ln(close / base) / nullif(sigma_hat * sqrt(3), 0) AS z FROM q1)""",
        "CASE WHEN on_ AND abs(z) < 0.5 THEN -sign(z) WHEN on_ AND abs(z) > 1.5 THEN sign(z) END", "CASE WHEN abs(z) < 0.5 THEN (0.5 - abs(z)) / 0.5 ELSE (abs(z) - 1.5) / 1.5 END",
    ),
    "detector_d07": _sig(
        f"""q0 AS (SELECT *, sum(wap * CASE WHEN is_valid THEN volume ELSE 0 END) OVER ({_S}) / nullif(sum(CASE WHEN is_valid THEN volume ELSE 0 END) OVER ({_S}), 0) AS vw FROM st),
        fx AS (SELECT *, ln(close / vw) / nullif(sigma_hat * sqrt(bar_in_session + 1), 0) AS dv, ln(vw / lag(vw, 3) OVER ({_S})) / nullif(sigma_hat * sqrt(3), 0) AS sl FROM q0)""",
        "CASE WHEN abs(dv) > 0.6 AND abs(sl) < 0.5 THEN -sign(dv) WHEN abs(dv) BETWEEN 0.2 AND 0.6 AND sign(dv) = sign(sl) THEN sign(dv) END", "CASE WHEN abs(dv) > 0.6 AND abs(sl) < 0.5 THEN (abs(dv) - 0.6) / 0.6 ELSE (abs(dv) - 0.2) / 0.4 END",
    ),
    "detector_d08": _sig(
        f"fx AS (SELECT *, sum(coalesce(ret / nullif(sigma_hat, 0), 0)) OVER ({_S}) AS zc, m_next <> month(session_id) AS me FROM cx)",
        "CASE WHEN root IN ('click', 'view', 'error') AND local_minute = 900 AND abs(zc) > 0.3 THEN -sign(zc) END", "least(greatest((abs(zc) - 0.3) / 2, 0), 1) * (1 + 0.25 * me::INT + 0.25 * (me AND month(session_id) IN (3, 6, 9, 12))::INT)", _CONTEXT,
    ),
}
_CLIP = lambda x, a, b: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {a}), {b}) END"
_GATE = {
    "d01": ["-er", "-grow", "mid", "usual", "1.0"], "d02": ["er", "grow", "liquid"], "d04": ["low", "grow", "usual"], "d05": ["usual", "mid"], "d08": ["month", "usual"],
}
SQL |= {
    "gates": f"""WITH {_CONTEXT}, g0 AS (SELECT root, timestamp, 2 * ({_CLIP('er_20', 0, 1)}) - 1 AS er, tanh(ln(CASE WHEN vol_ratio IS NOT NULL THEN greatest(vol_ratio, 1e-6) END) / 0.4) AS grow, 1 - 2 * ({_CLIP('sigma_pct', 0, 1)}) AS low,
            1 - 4 * ({_CLIP('abs(sigma_pct - 0.5)', 0, 0.5)}) AS mid, 1 - 2 * ({_CLIP('abs(liq_z) / 3', 0, 1)}) AS usual, tanh(liq_z / 2) AS liquid,
            least(greatest((m_next <> month(session_id))::INT + (m_next <> month(session_id) AND month(session_id) IN (3, 6, 9, 12))::INT - 0.5, -1.0), 1.0)::DOUBLE AS month FROM cx)
        SELECT root, timestamp, {', '.join(f"round(0.2 + 1.3 / (1 + exp(-coalesce(list_avg([{', '.join(f'({p})::DOUBLE' for p in v)}]), 0))), 5) + 0.0 AS gate_{k}" for k, v in _GATE.items())} FROM g0""",
    "finalized_sigma": f"""WITH {STATE}, z AS (SELECT *, sigma_day * (1 + hour(timestamp) / 100.0) AS base FROM st), q AS (SELECT *, (ret / nullif(base, 0)) ** 2 AS q FROM z),
        y AS (SELECT root, timestamp, {ewm('q', '(1 - 0.97)', 5)} AS y FROM (SELECT *, row_number() OVER ({W}) - 1 AS t FROM q WHERE q IS NOT NULL)),
        v AS (SELECT q.root, q.timestamp, base, lag(y) OVER (PARTITION BY q.root ORDER BY q.timestamp) AS before FROM q LEFT JOIN y ON y.root = q.root AND y.timestamp = q.timestamp),
        u AS (SELECT *, coalesce({_CLIP('pow(before, 0.2)', 0.5, 2.5)}, 1.0) AS u FROM v) SELECT root, timestamp, round(u, 6) + 0.0 AS u, round(base * u, 6) + 0.0 AS sigma_hat FROM u""",
    "detector_d06": _sig(
        f"""q0 AS (SELECT *, ret / nullif(sigma_hat, 0) AS z FROM st), q1 AS (SELECT *, max(CASE WHEN root = 'purchase' THEN z END) OVER (PARTITION BY timestamp) AS ez FROM q0),
        q2 AS (SELECT *, {strict('sum', 'z', 2)} AS own, {strict('sum', 'ez', 2)} AS es FROM q1 WHERE root = 'view'),
        q3 AS (SELECT *, own - CASE WHEN count(own + es) OVER p >= 100 THEN covar_samp(own, es) OVER p END / nullif(CASE WHEN count(es) OVER p >= 100 THEN var_samp(es) OVER p END, 0) * es AS r
               FROM q2 WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        q4 AS (SELECT *, CASE WHEN count(r) OVER p >= 100 THEN quantile_cont(r, 0.15) OVER p END AS lo, CASE WHEN count(r) OVER p >= 100 THEN quantile_cont(r, 0.85) OVER p END AS hi FROM q3 WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        fx AS (SELECT st.root, st.timestamp, r, lo, hi FROM st LEFT JOIN q4 USING (root, timestamp))""",
        "CASE WHEN r < lo OR r > hi THEN -sign(r) END", "abs(r) / nullif((hi - lo) / 2, 0) - 1",
    ),
}
_ALL = (context_1h, calendar_ny, session_hours, roll_table, ohlc_violations, anomalies, gap_summary, raw_inventory, chl_spread, causal_spread, session_variation, har_records, har_oos, finalized_sigma, gates, zigzag_pivots, structure_1h, *(_detector(n) for n in SMALL))
QUERIES = {f.__name__: f for f in _ALL}
