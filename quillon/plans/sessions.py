"""Session hours, positions, the day's shape and pooled variance forecasts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import bars as B
from quillon.operators import market as M
from quillon.operators import sessions as S
from quillon.plans.market import rnd
from quillon.plans.sql import BARS, strict
from quillon.plans.state import _D, _VAR, STATE, _daily, state

ANCHOR, POOLS = 0, {"a": ["click", "error", "view"], "b": ["purchase", "signup"]}


def moved_bars(spark, d):
    """Hourly bars with their local minute; from the sixteenth on click, error and purchase open a quarter of an hour later."""
    late = (F.col("root") < "r") & (F.dayofmonth("timestamp") > 15)
    return B.bars_of(spark, d).withColumn("local_minute", F.hour("timestamp") * 60 + F.when(late, 15).otherwise(0))


def _specs(x):
    return S.session_specs(S.session_edges(x, F.lit(ANCHOR)))


def session_specs(spark, d):
    x = _specs(moved_bars(spark, d))
    return x.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


def dated_positions(spark, d):
    """The fifth of the month is a half day of twelve bars for all, the ninth one of twenty bars for view."""
    x = moved_bars(spark, d)
    days = x.select("root", "session_id").distinct()
    special = days.where(F.dayofmonth("session_id") == 5).select("root", "session_id", F.lit(12).alias("expected"), F.lit(True).alias("half"))
    special = special.unionByName(days.where((F.dayofmonth("session_id") == 9) & (F.col("root") == "view")).select("root", "session_id", F.lit(20).alias("expected"), F.lit(False).alias("half")))
    out = S.dated_positions(x, _specs(x), special, 60, F.lit(ANCHOR))
    return rnd(out.select("root", "timestamp", "bar_in_session", "phi", "is_half_day", "is_truncated"), ["phi"])


def _z(spark, d):
    no = F.datediff("session_id", F.lit("2024-01-01").cast("date"))
    return state(spark, d).select("root", no.alias("session_no"), F.hour("timestamp").alias("slot"), F.abs(F.col("ret") / F.col("sigma_hat")).alias("abs_z"))


def seasonal_curves(spark, d):
    return rnd(S.seasonal_curves(_z(spark, d), 5, 10), ["median", "mean"])


def seasonality(spark, d):
    return S.seasonality(S.seasonal_curves(_z(spark, d), 5, 10), 0.3, events=(8, 14), event_roots=("click", "view"))


def har_forecast(spark, d):
    x = S.pooled_har(M.har_records(_daily(spark, d), 3, 8), POOLS, 8)
    return rnd(x.withColumn("session_id", F.col("session_id").cast("string")), ["har_log_var"], 4)


_MV = f"{BARS}, mv AS (SELECT *, hour(timestamp) * 60 + CASE WHEN root < 'r' AND day(timestamp) > 15 THEN 15 ELSE 0 END AS local_minute FROM bars)"
_SPEC = f"""{_MV}, da AS (SELECT root, session_id, min(local_minute) AS a, max(local_minute) AS b FROM mv GROUP BY ALL), dq AS (SELECT *, a <= 30 AS ok, (round_even(a / 15.0, 0) * 15)::INT AS o FROM da),
dt AS (SELECT *, sum(ok::INT) OVER (PARTITION BY root ORDER BY session_id DESC) AS tail FROM dq), la AS (SELECT root, first(o ORDER BY n DESC, o) AS last FROM (SELECT root, o, count(*) AS n FROM dt WHERE ok AND tail <= 10 GROUP BY ALL) GROUP BY root),
sv AS (SELECT root, count(DISTINCT o) > 1 AS several FROM dq WHERE ok GROUP BY root),
ds AS (SELECT dt.*, several, last, sum((ok AND o = last)::INT) OVER (PARTITION BY dt.root ORDER BY session_id DESC) AS same FROM dt LEFT JOIN la USING (root) LEFT JOIN sv USING (root)),
df AS (SELECT *, min(CASE WHEN several AND ok AND o = last AND tail >= 5 AND same >= 0.9 * tail THEN session_id END) OVER (PARTITION BY root) AS change, min(session_id) OVER (PARTITION BY root) AS start FROM ds),
dg AS (SELECT *, CASE WHEN coalesce(session_id >= change AND change > start, false) THEN 1 ELSE 0 END AS segment FROM df),
de AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY root, segment ORDER BY b, session_id) = round_even((count(*) OVER (PARTITION BY root, segment) - 1) * 0.95, 0) + 1 THEN b END AS e FROM dg),
sp AS (SELECT root, segment, min(session_id) AS valid_from, max(session_id) AS valid_to, count(*) AS sessions, floor(quantile_cont(CASE WHEN ok THEN a END, 0.5))::INT % 1440 AS start_minute, (max(e) + 1)::INT % 1440 AS end_minute FROM de GROUP BY ALL)"""
_HAR_P = 8  # the constant, five features and two levels
_F = ["1.0", "log_c", "log_c_w", "log_c_m", "log1p_j", "r_neg", "lv1", "lv2"]
_HS = f"""{_VAR}, hr AS (SELECT root, ln(continuous_var) AS log_c, ln({strict('avg', 'continuous_var', 3, w=_D)}) AS log_c_w, ln({strict('avg', 'continuous_var', 8, w=_D)}) AS log_c_m, ln(1 + jump_var) AS log1p_j, least(session_ret, 0) AS r_neg,
    ln(lead(continuous_var) OVER ({_D})) AS y, lead(session_id) OVER ({_D}) AS ts, CASE WHEN root IN ('click', 'error', 'view') THEN 'a' ELSE 'b' END AS pool, (root IN ('error', 'signup'))::INT::DOUBLE AS lv1, (root = 'view')::INT::DOUBLE AS lv2 FROM sx),
hc AS (SELECT * FROM hr WHERE log_c IS NOT NULL AND log_c_w IS NOT NULL AND log_c_m IS NOT NULL AND log1p_j IS NOT NULL AND r_neg IS NOT NULL AND ts IS NOT NULL),
dy AS (SELECT c.pool, c.ts FROM (SELECT DISTINCT pool, ts FROM hc) c JOIN hc h ON h.pool = c.pool AND h.ts < c.ts AND h.y IS NOT NULL GROUP BY ALL HAVING count(DISTINCT h.ts) >= 8),
ms AS (SELECT dy.pool, dy.ts, {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 1e-12 THEN stddev_samp({c}) ELSE 1 END AS s_{c}' for c in _F[1:6])} FROM dy JOIN hc h ON h.pool = dy.pool AND h.ts < dy.ts AND y IS NOT NULL GROUP BY ALL),
zz AS (SELECT ms.pool, ms.ts, h.y, [1.0, {', '.join(f'({c} - m_{c}) / s_{c}' for c in _F[1:6])}, lv1, lv2]::DOUBLE[] AS z FROM ms JOIN hc h ON h.pool = ms.pool AND h.ts < ms.ts AND y IS NOT NULL),
ab AS (SELECT pool, ts, [{', '.join('[' + ', '.join(f'sum(z[{i}] * z[{j}])' for j in range(1, _HAR_P + 1)) + ']' for i in range(1, _HAR_P + 1))}] AS a, [{', '.join(f'sum(z[{i}] * y)' for i in range(1, _HAR_P + 1))}] AS b FROM zz GROUP BY ALL),
cd AS (SELECT pool, ts, 0 AS k, [0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS x, a, b FROM ab
       UNION ALL SELECT pool, ts, k + 1, list_transform(x, lambda v, i: CASE WHEN i <> k % {_HAR_P} + 1 THEN v WHEN a[i][i] = 0 THEN 0 WHEN i IN (2, 3, 4, 5) THEN greatest((b[i] - list_inner_product(a[i], x) + a[i][i] * x[i]) / a[i][i], 0)
            WHEN i = 6 THEN least((b[i] - list_inner_product(a[i], x) + a[i][i] * x[i]) / a[i][i], 0) ELSE (b[i] - list_inner_product(a[i], x) + a[i][i] * x[i]) / a[i][i] END), a, b FROM cd WHERE k < 8 * 600)"""
SQL = {
    "session_specs": f"WITH {_SPEC} SELECT root, segment, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, sessions, start_minute, end_minute FROM sp",
    "dated_positions": f"""WITH {_SPEC}, sl AS (SELECT root, session_id, CASE WHEN day(session_id) = 5 THEN 12 WHEN day(session_id) = 9 AND root = 'view' THEN 20 ELSE floor(((end_minute - start_minute + 1440) % 1440) / 60) END AS bars, end_minute, day(session_id) = 5 AS is_half_day FROM da JOIN sp USING (root) WHERE session_id BETWEEN valid_from AND valid_to),
        x AS (SELECT mv.*, bars, end_minute, is_half_day, row_number() OVER (PARTITION BY root, session_id ORDER BY timestamp) - 1 AS n, max(session_id) OVER (PARTITION BY root) AS last, max(local_minute) OVER (PARTITION BY root, session_id) AS closes, max(session_id) OVER (PARTITION BY root, local_symbol) AS until,
            last_value(local_symbol) OVER (PARTITION BY root ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cur FROM mv JOIN sl USING (root, session_id))
        SELECT root, timestamp, n::INT AS bar_in_session, round(least(n / nullif(bars - 1, 0), 1), 6) + 0.0 AS phi, is_half_day, session_id < last AND NOT is_half_day AND NOT (session_id = until AND local_symbol <> cur) AND closes < (end_minute - 1 + 1440) % 1440 - 5 AS is_truncated FROM x""",
    "seasonal_curves": f"""WITH {STATE}, z AS (SELECT root, date_diff('day', DATE '2024-01-01', session_id) AS n, hour(timestamp)::INT AS slot, abs(ret / nullif(sigma_hat, 0)) AS z FROM st), r AS (SELECT (10 + 5 * i)::INT AS refit FROM range(0, 1000) t(i) WHERE 10 + 5 * i <= (SELECT max(n) + 1 FROM z))
        SELECT root, refit, slot, round(quantile_cont(z, 0.5), 6) + 0.0 AS median, round(avg(z), 6) + 0.0 AS mean FROM z JOIN r ON n < refit WHERE z IS NOT NULL GROUP BY ALL""",
    "har_forecast": f"""WITH RECURSIVE {_HS}, fi AS (SELECT pool, ts, x FROM cd WHERE k = 8 * 600)
        SELECT root, hc.ts::VARCHAR AS session_id, round(list_inner_product(x, [1.0, {', '.join(f'({c} - m_{c}) / s_{c}' for c in _F[1:6])}, lv1, lv2]::DOUBLE[]), 4) + 0.0 AS har_log_var FROM hc JOIN ms ON ms.pool = hc.pool AND ms.ts = hc.ts JOIN fi ON fi.pool = hc.pool AND fi.ts = hc.ts""",
}
QUERIES = {f.__name__: f for f in (session_specs, dated_positions, seasonal_curves, seasonality, har_forecast)}
