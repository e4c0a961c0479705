"""States split for several outcomes, and their forecasts, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import stumps as S
from quillon.plans.market import rnd
from quillon.plans.prototypes import _LB, COORDS, _labelled
from quillon.sources.lineage import cut

TARGETS = {"gain": 1.0, "size": 0.5}
FIT = {"least_early": 100, "least_late": 30, "least_leaf": 20, "least_days": 3, "steps": 9}


def _rows(spark, d):
    move = F.col("q_later") - F.col("q_now")
    return _labelled(spark, d).dropna(subset=COORDS).select("root", "timestamp", F.to_date("timestamp").alias("day"), "state", *COORDS, move.alias("gain"), F.abs(move).alias("size"))


def _evidence(x):
    return cut(S.certified_splits(x, "state", COORDS, TARGETS, "day", **FIT))


def stump_splits(spark, d):
    x = _rows(spark, d).where(F.dayofmonth("day") <= 22)
    return rnd(rnd(_evidence(x), ["threshold"]), ["before", "after"], 6)


def stump_forecasts(spark, d):
    """All rows by the tables of the first 22 days."""
    x = cut(_rows(spark, d))
    seen = x.where(F.dayofmonth("day") <= 22)
    fitted = S.fit_stumps(seen, _evidence(seen), "state", COORDS, TARGETS, FIT["least_leaf"], steps=FIT["steps"])
    out = S.predict_stumps(x, fitted, "state", COORDS, list(TARGETS))
    return rnd(out.select("root", "timestamp", "state", "leaf", "forecast_gain", "forecast_size"), ["forecast_gain", "forecast_size"])


def _best(name: str, rows: str) -> str:
    """name: state, feature, threshold of the best split of each state of rows."""
    probs = ", ".join(str((i + 1) / 10) for i in range(9))
    long = " UNION ALL ".join(f"SELECT state, '{c}' AS feature, {c} AS v, gain, size FROM {rows}" for c in COORDS)
    part = lambda t: f"(sum({t}) FILTER (v <= threshold)) ** 2 / count(*) FILTER (v <= threshold) + (sum({t}) FILTER (v > threshold)) ** 2 / count(*) FILTER (v > threshold) - sum({t}) ** 2 / count(*)"
    return f"""{name}_l AS ({long}), {name}_g AS (SELECT DISTINCT state, feature, unnest(quantile_cont(v, [{probs}])) AS threshold FROM {name}_l GROUP BY state, feature),
        {name}_s AS (SELECT state, feature, threshold, count(*) FILTER (v <= threshold) AS nl, count(*) FILTER (v > threshold) AS nr, round({part('gain')} + 0.25 * ({part('size')}), 12) AS fit FROM {name}_l JOIN {name}_g USING (state, feature) GROUP BY ALL),
        {name} AS (SELECT state, feature, threshold FROM {name}_s WHERE least(nl, nr) >= greatest(20, floor((nl + nr) * 0.12)) AND fit > 0 QUALIFY row_number() OVER (PARTITION BY state ORDER BY fit DESC, feature, threshold) = 1)"""


_SIDE = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in COORDS) + " END <= threshold"
_EV = f"""{_LB}, ro AS (SELECT root, timestamp, timestamp::DATE AS day, state, {', '.join(COORDS)}, q_later - q_now AS gain, abs(q_later - q_now) AS size FROM lb WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COORDS)}),
se AS (SELECT * FROM ro WHERE day(day) <= 22), dn AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM se)), cu AS (SELECT day AS cut FROM dn WHERE i = greatest(1, floor(n * 0.7)::INT - 1) + 1),
ea AS (SELECT se.*, day <= cut AS early FROM se, cu), eo AS (SELECT * FROM ea WHERE early), gl AS (SELECT avg(gain) AS gg, avg(size) AS gs FROM se), {_best('b1', 'eo')},
sd AS (SELECT ea.*, feature, threshold, {_SIDE} AS l FROM ea JOIN b1 USING (state)),
pm AS (SELECT state, (sum(gain) FILTER (early) + 200 * any_value(gg)) / (count(*) FILTER (early) + 200) AS pg, (sum(size) FILTER (early) + 200 * any_value(gs)) / (count(*) FILTER (early) + 200) AS ps FROM sd, gl GROUP BY state),
em AS (SELECT state, l, (coalesce(sum(gain) FILTER (early), 0) + 250 * any_value(pg)) / (count(*) FILTER (early) + 250) AS eg, (coalesce(sum(size) FILTER (early), 0) + 250 * any_value(ps)) / (count(*) FILTER (early) + 250) AS es FROM sd JOIN pm USING (state) GROUP BY ALL),
ev AS (SELECT state, feature, threshold, count(*) FILTER (early) AS early_rows, count(*) FILTER (NOT early) AS late_rows, avg(((gain - pg) ** 2 + (size - ps) ** 2) / 2) FILTER (NOT early) AS before, avg(((gain - eg) ** 2 + (size - es) ** 2) / 2) FILTER (NOT early) AS after
       FROM sd JOIN pm USING (state) JOIN em USING (state, l) GROUP BY ALL),
dd AS (SELECT state, min(d) AS least_days, count(*) AS cells FROM (SELECT state, l, early, count(DISTINCT day) AS d FROM sd GROUP BY ALL) GROUP BY state),
ac AS (SELECT ev.*, least_days, coalesce(cells = 4 AND least_days >= 3 AND early_rows >= 100 AND late_rows >= 30 AND after < before, false) AS accepted FROM ev JOIN dd USING (state))"""
SQL = {
    "stump_splits": f"WITH {_EV} SELECT state, feature, round(threshold, 6) + 0.0 AS threshold, early_rows, late_rows, least_days, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after, accepted FROM ac",
    "stump_forecasts": f"""WITH {_EV}, ke AS (SELECT se.* FROM se JOIN ac USING (state) WHERE accepted), {_best('b2', 'ke')}, s2 AS (SELECT se.*, feature, threshold, {_SIDE} AS l FROM se LEFT JOIN b2 USING (state)),
        p2 AS (SELECT state, any_value(feature) AS feature, any_value(threshold) AS threshold, (sum(gain) + 500 * any_value(gg)) / (count(*) + 500) AS mg, (sum(size) + 500 * any_value(gs)) / (count(*) + 500) AS ms FROM s2, gl GROUP BY state),
        e2 AS (SELECT state, l, (sum(gain) + 250 * any_value(mg)) / (count(*) + 250) AS eg, (sum(size) + 250 * any_value(ms)) / (count(*) + 250) AS es FROM s2 JOIN p2 USING (state) WHERE l IS NOT NULL GROUP BY ALL),
        f AS (SELECT ro.*, p2.feature, threshold, mg, ms, {_SIDE.replace('feature', 'p2.feature')} AS l FROM ro LEFT JOIN p2 USING (state))
        SELECT root, timestamp, state, CASE WHEN feature IS NULL THEN -1 WHEN f.l THEN 0 ELSE 1 END AS leaf, round(coalesce(eg, mg), 6) + 0.0 AS forecast_gain, round(coalesce(es, ms), 6) + 0.0 AS forecast_size FROM f LEFT JOIN e2 ON e2.state = f.state AND e2.l = f.l""",
}
SQL["stump_forecasts"] = SQL["stump_forecasts"].replace("SELECT root, timestamp, state,", "SELECT root, timestamp, f.state,")
QUERIES = {f.__name__: f for f in (stump_splits, stump_forecasts)}
