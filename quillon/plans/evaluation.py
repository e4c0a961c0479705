"""Statistics, selection, fusion, sizing, policies and ledgers as queries, on a simple reversal signal over hourly bars."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.scalars import log, safe_div, uniform
from quillon.functions.windows import Bars, equal_bins
from quillon.operators import portfolio as P
from quillon.operators import stats as T
from quillon.plans.market import rnd
from quillon.plans.sql import W
from quillon.plans.state import _CONTEXT, STATE, context, state

SEED = 11


def signals(spark, d):
    """root, timestamp, session_phase, direction, magnitude, x, outcome (z of the next four bars), raw, and the state's columns."""
    w = Bars("root", "timestamp")
    x = state(spark, d).withColumn("x", safe_div(F.col("ret"), F.col("sigma_hat"))).withColumn("raw", log(w.lag(F.col("close"), -4) / F.col("close")))
    direction = F.coalesce(F.when(F.col("x") > 1, -1).when(F.col("x") < -1, 1), F.lit(0))
    return x.withColumns({"direction": direction, "magnitude": F.coalesce(F.least(F.abs("x") / 3, F.lit(1.0)), F.lit(0.0)), "outcome": safe_div(F.col("raw"), F.col("sigma_hat") * 2)})


def triggers(spark, d):
    x = signals(spark, d).where("direction <> 0 AND outcome IS NOT NULL")
    return x.withColumns({"signed_z": F.col("direction") * F.col("outcome"), "signed_raw": F.col("direction") * F.col("raw")})


def stat_card(spark, d):
    out = T.card(triggers(spark, d), ["root"], "signed_z", "signed_raw", F.lit(0.001))
    return rnd(out, [c for c in out.columns if c not in ("root", "n")])


def full_card(spark, d):
    out = T.full_card(triggers(spark, d), ["root"], ["timestamp"], "signed_z", "signed_raw", F.lit(0.001), 4, 20.0, 40, SEED).drop("stationary_t")
    return rnd(out, [c for c in out.columns if c not in ("root", "n")])


def newey_west(spark, d):
    return rnd(T.newey_west_t(triggers(spark, d), ["root"], ["timestamp"], "signed_z", 4), ["nw_t"])


def stationary_bootstrap(spark, d):
    draws = T.stationary_bootstrap(triggers(spark, d), ["root"], ["timestamp"], "signed_z", 20.0, 40, SEED)
    return rnd(T.interval(draws, ["root"]), ["ci_low", "ci_high", "se"])


def daily_outcome(spark, d):
    return triggers(spark, d).groupBy("session_id").agg(F.sum("signed_raw").alias("net")).withColumn("all", F.lit("all"))


def day_block_bootstrap(spark, d):
    return rnd(T.interval(T.block_bootstrap(daily_outcome(spark, d), ["all"], ["session_id"], "net", 7, 100, SEED), ["all"]), ["ci_low", "ci_high", "se"])


def matched_null(spark, d):
    x = signals(spark, d).where("outcome IS NOT NULL")
    return rnd(T.shifted_null(x, ["root", "session_phase"], ["timestamp"], "direction", "outcome", 50, SEED), ["mean"])


def null_percentile(spark, d):
    actual = triggers(spark, d).agg(F.avg("signed_z").alias("actual"))
    x = signals(spark, d).where("outcome IS NOT NULL")
    return rnd(T.percentile_of(T.shifted_null(x, ["root", "session_phase"], ["timestamp"], "direction", "outcome", 50, SEED), actual), ["percentile"])


def _cells(spark, d):
    keys = ["root", "timestamp"]
    return T.categorize(triggers(spark, d).join(context(spark, d).select(*keys, "er_20", "sigma_pct", "vol_ratio", "liq_z"), keys))


DIMENSIONS = ["structure", "efficiency", "volatility", "vol_direction", "liquidity", "phase"]


def categories(spark, d):
    return _cells(spark, d).groupBy(*DIMENSIONS).agg(F.count("*").alias("n"))


def shrinkage(spark, d):
    out = T.decomposition(_cells(spark, d), "signed_z", ["structure", "efficiency", "vol_direction", "phase"])
    return rnd(out.select("term_order", "variables", "level", "n", "raw_effect", "tau2", "confidence", "posterior_effect"), ["raw_effect", "tau2", "confidence", "posterior_effect"])


def root_shrinkage(spark, d):
    return rnd(T.root_hierarchy(triggers(spark, d), "signed_z"), ["raw_mean", "pooled_mean", "tau2_root", "confidence", "posterior_mean"])


def causal_posterior(spark, d):
    w = Bars("root", "timestamp")
    ready = signals(spark, d).withColumn("outcome_available_time", w.lag(F.col("timestamp"), -4)).where("direction <> 0 AND outcome IS NOT NULL")
    x = ready.withColumns({"event_id": F.concat_ws("@", "root", F.col("timestamp").cast("string")), "structure": F.when(F.col("direction") > 0, "long").otherwise("short")})
    return rnd(T.causal_posterior(x, ["structure", "session_phase"]), ["posterior_mean", "confidence"])


def economic_weight(spark, d):
    x = T.root_hierarchy(triggers(spark, d), "signed_z")
    return rnd(x.select("root", T.quality_weight(F.col("posterior_mean") + 0.3, F.lit(0.2), F.lit(0.05), F.col("confidence") + 0.5, F.col("n") > 10).alias("weight")), ["weight"], 5)


def purged_splits(spark, d):
    times = signals(spark, d).select("timestamp").distinct()
    return T.purged_splits(times, ["timestamp"], 4, 0.4, 24).groupBy("split", "part").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _grid(spark, d):
    x = triggers(spark, d).withColumn("fold", F.expr("(day(timestamp) - 1) div 6"))
    grid = x.select("root", "fold", "x", "signed_raw", F.explode(F.array(F.lit(1.0), F.lit(1.2), F.lit(1.4))).alias("a")).select("*", F.explode(F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0))).alias("b"))
    return grid.where((F.abs("x") >= F.col("a")) & (F.abs("x") <= F.col("b")))


def walk_forward(spark, d):
    out = T.plateau(T.walk_forward(_grid(spark, d), ["a", "b"], "signed_raw", 20), ["a", "b"])
    return rnd(out, ["mean_net", "median_fold_net", "positive_fold_rate", "fold_dispersion", "worst_root_net", "plateau_rate"])


def drawdowns(spark, d):
    return rnd(T.drawdowns(daily_outcome(spark, d), ["all"], "session_id", "net"), ["max_drawdown"])


def performance(spark, d):
    out = T.performance(daily_outcome(spark, d).withColumn("net", F.col("net") * 0.001 - 0.011), ["all"], "net", trials=20)
    return rnd(out, [c for c in out.columns if c != "all"], 4)


def concentration(spark, d):
    out = T.concentration(daily_outcome(spark, d).withColumn("day", F.col("session_id").cast("string")), ["all"], "net")
    return rnd(out, [c for c in out.columns if c != "all"])


def _scores(spark, d):
    p = 1 / (1 + F.exp(-0.3 * F.col("x")))
    return signals(spark, d).where("x IS NOT NULL AND raw IS NOT NULL").select("root", "timestamp", p.alias("p"), (F.col("raw") > 0).cast("int").alias("y"), F.col("session_phase").alias("phase"))


def calibration(spark, d):
    return rnd(T.calibration(_scores(spark, d), "p", "y"), ["mean_p", "rate"])


def calibration_scores(spark, d):
    return rnd(T.calibration_scores(_scores(spark, d), "p", "y"), ["ece", "brier", "log_loss"])


def quantile_calibration(spark, d):
    x = _scores(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("p", "timestamp"))).withColumn("n", F.count("*").over(Window.partitionBy("root")))
    return rnd(x.groupBy("root", equal_bins(F.col("r"), F.col("n"), 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate")), ["mean_p", "rate"])


def adjusted_rand(spark, d):
    return rnd(T.adjusted_rand(spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.when(F.element_at("embedding", 1) > 0, 1).otherwise(0).alias("half")), "label", "half"), ["ari"])


def _signal_table(spark, d):
    x = signals(spark, d)
    s = x.select("root", "timestamp", F.lit("R1").alias("detector"), "direction", "magnitude", F.lit(6).alias("horizon"), F.lit(0.6).alias("confidence"), F.lit(1.0).alias("gate_score"), "x")
    t = s.withColumns({"detector": F.lit("R2"), "direction": F.when(F.abs("x") > 1.5, F.col("direction")).otherwise(0), "horizon": F.lit(3), "confidence": F.lit(0.9)})
    u = s.withColumns({"detector": F.lit("R3"), "direction": F.when(F.hour("timestamp") % 5 == 0, -F.col("direction")).otherwise(0), "horizon": F.lit(2), "confidence": F.lit(0.4)})
    return s.unionByName(t).unionByName(u)


def active_votes(spark, d):
    return rnd(P.active_votes(_signal_table(spark, d), signals(spark, d)).select("root", "detector", "timestamp", "num", "den", "mass"), ["num", "den", "mass"])


def dependence(spark, d):
    return rnd(P.dependence(_signal_table(spark, d), 10), ["rho", "common"])


def fusion(spark, d):
    bars = signals(spark, d)
    s = _signal_table(spark, d)
    return rnd(P.fuse(P.active_votes(s, bars), bars, P.causal_clusters(s, 10)), ["mu", "active_horizon", "confidence_mass"])


def sizing(spark, d):
    x = context(spark, d).select("root", "timestamp", "sigma_hat", "sigma_pct", "spread_bp", (F.hour("timestamp") / 24.0 - 0.5).alias("mu"), F.lit(6.0).alias("active_horizon"))
    return rnd(P.size_targets(x, 252 * 24.0, least=50).select("root", "timestamp", "target", "band", "sigma_ann", "breaker"), ["target", "band", "sigma_ann"])


def _weights(spark, d):
    w = Bars("root", "timestamp")
    x = signals(spark, d).withColumns({"next": w.lag(F.col("close"), -1)})
    full = F.count("*").over(Window.partitionBy("timestamp"))
    x = x.withColumn("full", full).where("full = 5 AND next IS NOT NULL")
    return x.select("root", "timestamp", (F.col("direction") * 0.15).alias("weight"), ((F.col("next") - F.col("close")) / F.col("close") * 0.01).alias("simple"))


def weight_ledger(spark, d):
    return rnd(P.ledger(_weights(spark, d), 4.0), ["gross_return", "turnover", "net_return", "gross_wealth", "net_wealth"])


def buy_and_hold(spark, d):
    return rnd(P.buy_and_hold(state(spark, d).select("root", "timestamp", F.col("close").alias("price"))), ["wealth"])


def strategy_costs(spark, d):
    x = signals(spark, d).withColumn("position", F.col("direction").cast("double"))
    out = P.strategy_costs(x.withColumn("ret", F.coalesce("ret", F.lit(0.0))), [0, 2, 5])
    return rnd(out.withColumn("day", F.col("day").cast("string")), ["net", "gross", "turnover"])


def held_sign(spark, d):
    return P.held_sign(signals(spark, d).where("x IS NOT NULL"), ["root"], ["timestamp"], "x", 1.0, 0.2).select("root", "timestamp", "position")


def thinned_events(spark, d):
    return P.thin_events(triggers(spark, d).select("root", "timestamp", "direction"), ["root"], "timestamp", 4 * 3600).select("root", "timestamp", "direction")


def best_pairs(spark, d):
    x = signals(spark, d).where("x IS NOT NULL").select("timestamp", "root", F.col("x").alias("score"), (1 + F.hour("timestamp") % 3 * 0.25).alias("beta"))
    return rnd(P.best_pairs(x), ["pair_score", "long_weight", "short_weight"])


def _backtest(spark, d):
    x = signals(spark, d)
    before = Bars("root", "timestamp").lag(F.col("local_symbol"))
    x = x.withColumns({"target": F.col("direction") * F.col("magnitude"), "band": F.lit(0.05), "signal_active": F.col("direction") != 0, "round_trip_cost_bp": F.lit(2.0), "overnight_ret": F.lit(None).cast("double")})
    return P.event_backtest(x.withColumn("is_roll_boundary", before.isNotNull() & (before != F.col("local_symbol"))))


def event_backtest(spark, d):
    out = _backtest(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    return rnd(rnd(out, ["position", "gross_return", "turnover"]), ["cost", "net_return"], 9)


def backtest_days(spark, d):
    return rnd(P.daily_portfolio(_backtest(spark, d)).withColumn("day", F.col("day").cast("string")), ["gross", "cost", "net", "turnover"])


def holding_periods(spark, d):
    return P.holding_periods(_backtest(spark, d)).select("root", "side", "bars", "opened")


def hash_draws(spark, d):
    """The draws themselves, bit for bit."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", uniform(SEED, F.col("o_orderkey"), F.lit("u")).alias("u"))


SIG = f"""{STATE},
sg0 AS (SELECT *, ret / nullif(sigma_hat, 0) AS x, ln(lead(close, 4) OVER ({W}) / close) AS raw FROM st),
sg AS (SELECT *, CASE WHEN x > 1 THEN -1 WHEN x < -1 THEN 1 ELSE 0 END AS direction, coalesce(least(abs(x) / 3, 1.0), 0.0) AS magnitude, raw / nullif(sigma_hat * 2, 0) AS outcome FROM sg0),
tr AS (SELECT *, direction * outcome AS signed_z, direction * raw AS signed_raw FROM sg WHERE direction <> 0 AND outcome IS NOT NULL),
dy AS (SELECT session_id, sum(signed_raw) AS net FROM tr GROUP BY session_id)"""
_U = lambda *p: "(('0x' || substr(md5(" + " || '|' || ".join(p) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_R = lambda x, k=6: f"round({x}, {k}) + 0.0 AS {x}"
_NULL = f"""b AS (SELECT root, session_phase, direction, outcome, row_number() OVER (PARTITION BY root, session_phase ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY root, session_phase) AS n FROM sg WHERE outcome IS NOT NULL),
t AS (SELECT *, unnest(range(50)) AS draw FROM b WHERE direction <> 0), m AS (SELECT t.root, t.session_phase, draw, direction, (i + floor({_U("'11'", 't.root', 't.session_phase', 'draw')} * n)::BIGINT) % n AS j FROM t),
nl AS (SELECT m.draw, avg(m.direction * b.outcome) AS mean, count(*) AS n FROM m JOIN b ON b.root = m.root AND b.session_phase = m.session_phase AND b.i = m.j GROUP BY m.draw)"""
_AUTO = " + ".join(f"{2 * (1 - k / 5)} * coalesce(e * lag(e, {k}) OVER ({W}), 0)" for k in range(1, 5))
_CELL = f"""{_CONTEXT}, sg0 AS (SELECT *, ret / nullif(sigma_hat, 0) AS x, ln(lead(close, 4) OVER ({W}) / close) AS raw FROM cx),
sg AS (SELECT *, CASE WHEN x > 1 THEN -1 WHEN x < -1 THEN 1 ELSE 0 END AS direction, raw / nullif(sigma_hat * 2, 0) AS outcome FROM sg0),
ce AS (SELECT *, direction * outcome AS y, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS structure, CASE WHEN er_20 <= 0.33 THEN 'low' WHEN er_20 <= 0.66 THEN 'mid' WHEN er_20 IS NOT NULL THEN 'high' ELSE 'nan' END AS efficiency,
       CASE WHEN sigma_pct <= 0.33 THEN 'low' WHEN sigma_pct <= 0.66 THEN 'mid' WHEN sigma_pct IS NOT NULL THEN 'high' ELSE 'nan' END AS volatility, CASE WHEN vol_ratio <= 0.8 THEN 'contract' WHEN vol_ratio <= 1.2 THEN 'normal' WHEN vol_ratio IS NOT NULL THEN 'expand' ELSE 'nan' END AS vol_direction,
       CASE WHEN liq_z <= -1 THEN 'low' WHEN liq_z <= 1 THEN 'normal' WHEN liq_z IS NOT NULL THEN 'high' ELSE 'nan' END AS liquidity, session_phase AS phase FROM sg WHERE direction <> 0 AND outcome IS NOT NULL)"""
_DIM4 = ["structure", "efficiency", "vol_direction", "phase"]
_MAIN = " UNION ALL ".join(f"SELECT '{v}' AS v, {v} AS l, count(*) AS n, avg(y) - (SELECT mu0 FROM al) AS e FROM ce GROUP BY {v}" for v in _DIM4)
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}x{b}' AS v, ce.{a} || '|' || ce.{b} AS l, count(*) AS n, avg(y) - (SELECT mu0 FROM al) - any_value(p.e) - any_value(q.e) AS e FROM ce JOIN mn p ON p.v = '{a}' AND p.l = ce.{a} JOIN mn q ON q.v = '{b}' AND q.l = ce.{b} GROUP BY ce.{a}, ce.{b}"
    for i, a in enumerate(_DIM4)
    for b in _DIM4[i + 1 :]
)
_VOTES = f"""s3 AS (SELECT root, timestamp, 'R1' AS detector, direction, magnitude, 6 AS h, 0.6 AS c FROM sg UNION ALL SELECT root, timestamp, 'R2', CASE WHEN abs(x) > 1.5 THEN direction ELSE 0 END, magnitude, 3, 0.9 FROM sg
       UNION ALL SELECT root, timestamp, 'R3', CASE WHEN hour(timestamp) % 5 = 0 THEN -direction ELSE 0 END, magnitude, 2, 0.4 FROM sg),
ix AS (SELECT root, timestamp, row_number() OVER ({W}) - 1 AS i FROM sg), ex AS (SELECT s3.*, i, unnest(range(h)) AS k FROM s3 JOIN ix USING (root, timestamp) WHERE direction <> 0 AND magnitude > 0),
vt AS (SELECT root, detector, i + k AS i, sum(c * (1 - k / h::DOUBLE) * direction * magnitude) AS num, sum(c * (1 - k / h::DOUBLE)) AS den, sum(c * (1 - k / h::DOUBLE) * h) AS mass FROM ex GROUP BY root, detector, i + k)"""
_WT = f"""wt AS (SELECT root, timestamp, direction * 0.15 AS weight, (nx - close) / close * 0.01 AS simple FROM (SELECT *, lead(close) OVER ({W}) AS nx, count(*) OVER (PARTITION BY timestamp) AS f FROM sg) WHERE f = 5 AND nx IS NOT NULL),
gr AS (SELECT timestamp, sum(weight * simple) AS g FROM wt GROUP BY timestamp), dr AS (SELECT wt.*, g, lag(weight * (1 + simple) / (1 + g)) OVER (PARTITION BY root ORDER BY timestamp) AS drift FROM wt JOIN gr USING (timestamp)),
lg AS (SELECT timestamp, any_value(g) AS gross_return, sum(abs(weight - coalesce(drift, 0))) AS turnover FROM dr GROUP BY timestamp), ln_ AS (SELECT *, (1 - turnover * 4 / 1e4) * (1 + gross_return) - 1 AS net_return FROM lg)"""
SQL = {
    "stat_card": f"""WITH {SIG} SELECT root, count(*) AS n, round(avg(signed_z), 6) + 0.0 AS mean_z, round(avg(signed_z) / (stddev_samp(signed_z) / sqrt(count(*))), 6) + 0.0 AS raw_t, round(avg(signed_z) / stddev_samp(signed_z), 6) + 0.0 AS event_sharpe,
        round(avg((signed_z > 0)::INT), 6) + 0.0 AS win_rate, round(avg(signed_z) FILTER (signed_z > 0) / abs(avg(signed_z) FILTER (signed_z < 0)), 6) + 0.0 AS payoff_ratio, round(avg(signed_raw), 6) + 0.0 AS mean_raw, round(avg(signed_raw - 0.001), 6) + 0.0 AS mean_net FROM tr GROUP BY root""",
    "newey_west": f"""WITH {SIG}, a AS (SELECT *, signed_z - avg(signed_z) OVER (PARTITION BY root) AS e FROM tr), b AS (SELECT root, signed_z, e * e + {_AUTO} AS p FROM a)
        SELECT root, count(*) AS n, round(CASE WHEN count(*) >= 10 AND sum(p) > 0 THEN avg(signed_z) / (sqrt(sum(p)) / count(*)) END, 6) + 0.0 AS nw_t FROM b GROUP BY root""",
    "stationary_bootstrap": f"""WITH {SIG}, b AS (SELECT root, signed_z, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM tr), s AS (SELECT *, unnest(range(40)) AS draw FROM b),
        r AS (SELECT root, draw, i, n, i = 0 OR {_U("'11'", 'root', 'draw', 'i', "'restart'")} < 0.05 AS re, floor({_U("'11'", 'root', 'draw', 'i', "'at'")} * n)::BIGINT AS fresh FROM s),
        q AS (SELECT root, draw, i, n, last_value(CASE WHEN re THEN i END IGNORE NULLS) OVER w AS i0, last_value(CASE WHEN re THEN fresh END IGNORE NULLS) OVER w AS f0 FROM r WINDOW w AS (PARTITION BY root, draw ORDER BY i)),
        m AS (SELECT q.root, draw, avg(b.signed_z) AS mean FROM q JOIN b ON b.root = q.root AND b.i = (f0 + q.i - i0) % q.n GROUP BY q.root, draw)
        SELECT root, round(quantile_cont(mean, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS ci_high, round(stddev_samp(mean), 6) + 0.0 AS se FROM m GROUP BY root""",
    "day_block_bootstrap": f"""WITH {SIG}, b AS (SELECT net, row_number() OVER (ORDER BY session_id) - 1 AS i, count(*) OVER () AS n FROM dy), s AS (SELECT i, n, unnest(range(100)) AS draw FROM b),
        p AS (SELECT draw, (floor({_U("'11'", "'all'", 'draw', '(i // 7)')} * n)::BIGINT + i % 7) % n AS i FROM s), m AS (SELECT draw, avg(net) AS mean FROM p JOIN b USING (i) GROUP BY draw)
        SELECT 'all' AS "all", round(quantile_cont(mean, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS ci_high, round(stddev_samp(mean), 6) + 0.0 AS se FROM m""",
    "matched_null": f"WITH {SIG}, {_NULL} SELECT draw::INT AS draw, round(mean, 6) + 0.0 AS mean, n FROM nl",
    "null_percentile": f"WITH {SIG}, {_NULL} SELECT round(avg((mean <= (SELECT avg(signed_z) FROM tr))::INT), 6) + 0.0 AS percentile FROM nl",
    "categories": f"WITH {_CELL} SELECT {', '.join(DIMENSIONS)}, count(*) AS n FROM ce GROUP BY ALL",
    "shrinkage": f"""WITH {_CELL}, al AS (SELECT avg(y) AS mu0, var_samp(y) AS s2 FROM ce), mn AS ({_MAIN}), pr AS ({_PAIRS}), u AS (SELECT 1 AS term_order, * FROM mn UNION ALL SELECT 2, * FROM pr),
        t AS (SELECT u.*, s2, coalesce(greatest(var_samp(e) OVER (PARTITION BY v) - avg(s2 / n) OVER (PARTITION BY v), 0), 0) AS tau2 FROM u, al), c AS (SELECT *, CASE WHEN tau2 > 0 THEN n * tau2 / (n * tau2 + s2) ELSE 0 END AS confidence FROM t)
        SELECT term_order, v AS variables, l AS level, n, round(e, 6) + 0.0 AS raw_effect, round(tau2, 6) + 0.0 AS tau2, round(confidence, 6) + 0.0 AS confidence, round(confidence * e, 6) + 0.0 AS posterior_effect FROM c""",
    "root_shrinkage": f"""WITH {SIG}, al AS (SELECT avg(signed_z) AS mu0, var_samp(signed_z) AS s2 FROM tr), g AS (SELECT root, count(*) AS n, avg(signed_z) AS m FROM tr GROUP BY root),
        t AS (SELECT *, least(greatest(var_samp(m - mu0) OVER () - avg(s2 / n) OVER (), 0), s2 / 100) AS tau FROM g, al), c AS (SELECT *, CASE WHEN tau > 0 THEN n * tau / (n * tau + s2) ELSE 0 END AS w FROM t)
        SELECT root, n, round(m, 6) + 0.0 AS raw_mean, round(mu0, 6) + 0.0 AS pooled_mean, round(tau, 6) + 0.0 AS tau2_root, round(w, 6) + 0.0 AS confidence, round(mu0 + w * (m - mu0), 6) + 0.0 AS posterior_mean FROM c""",
    "purged_splits": f"""WITH {SIG}, a AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM sg)), g AS (SELECT unnest(range(4)) AS split),
        p AS (SELECT *, ceil(n * 0.4)::BIGINT AS f, greatest((n - ceil(n * 0.4)::BIGINT) // 4, 1) AS z FROM a, g),
        q AS (SELECT *, CASE WHEN i < greatest(f + split * z - 24, 0) THEN 'train' WHEN i >= f + split * z AND i < CASE WHEN split = 3 THEN n ELSE least(n, f + (split + 1) * z) END THEN 'validation' END AS part FROM p)
        SELECT split::INT AS split, part, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM q WHERE part IS NOT NULL GROUP BY ALL""",
    "walk_forward": f"""WITH {SIG}, gd AS (SELECT root, (day(timestamp) - 1) // 6 AS fold, signed_raw, a, b FROM tr, (SELECT unnest([1.0, 1.2, 1.4])::DOUBLE AS a), (SELECT unnest([2.0, 3.0, 4.0])::DOUBLE AS b) WHERE abs(x) >= a AND abs(x) <= b),
        fo AS (SELECT a, b, median(m) AS median_fold_net, avg((m > 0)::INT) AS positive_fold_rate, stddev_samp(m) AS fold_dispersion FROM (SELECT a, b, fold, avg(signed_raw) AS m FROM gd GROUP BY ALL) GROUP BY ALL),
        ro AS (SELECT a, b, count(*) FILTER (m > 0) AS positive_roots, min(m) AS worst_root_net FROM (SELECT a, b, root, avg(signed_raw) AS m FROM gd GROUP BY ALL) GROUP BY ALL),
        su AS (SELECT a, b, count(*) AS triggers, avg(signed_raw) AS mean_net FROM gd GROUP BY ALL), al AS (SELECT *, triggers >= 20 AND median_fold_net > 0 AND positive_fold_rate >= 0.6 AND positive_roots >= 2 AS base_pass FROM su JOIN fo USING (a, b) JOIN ro USING (a, b)),
        rk AS (SELECT *, dense_rank() OVER (ORDER BY a) AS ra, dense_rank() OVER (ORDER BY b) AS rb FROM al),
        nb AS (SELECT p.a, p.b, count(*) AS neighbor_count, avg((q.median_fold_net >= 0.8 * p.median_fold_net)::INT) AS rate FROM rk p JOIN rk q ON abs(p.ra - q.ra) + abs(p.rb - q.rb) = 1 GROUP BY ALL),
        fi AS (SELECT al.*, coalesce(neighbor_count, 0) AS neighbor_count, CASE WHEN neighbor_count > 0 AND median_fold_net > 0 THEN rate ELSE 0 END AS plateau_rate FROM al LEFT JOIN nb USING (a, b))
        SELECT a, b, triggers, positive_roots, base_pass, neighbor_count, {', '.join(_R(c) for c in ('mean_net', 'median_fold_net', 'positive_fold_rate', 'fold_dispersion', 'worst_root_net', 'plateau_rate'))}, base_pass AND neighbor_count >= 2 AND plateau_rate >= 0.5 AS robust_pass FROM fi""",
    "drawdowns": f"""WITH {SIG}, a AS (SELECT session_id, row_number() OVER o - 1 AS i, exp(sum(net) OVER o) AS w FROM dy WINDOW o AS (ORDER BY session_id)), b AS (SELECT *, w / max(w) OVER (ORDER BY i) - 1 AS dd FROM a),
        c AS (SELECT *, sum((dd >= 0)::INT) OVER (ORDER BY i) AS blk FROM b), t AS (SELECT min(dd) AS dd, first(i ORDER BY dd, i) AS t FROM b)
        SELECT 'all' AS "all", round(t.dd, 6) + 0.0 AS max_drawdown, coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM c WHERE dd < 0 GROUP BY blk)), 0) AS max_drawdown_duration, (SELECT min(b.i - t.t) FROM b WHERE b.i > t.t AND b.dd >= 0) AS recovery FROM t""",
    "concentration": f"""WITH {SIG}, r AS (SELECT *, row_number() OVER (ORDER BY net DESC, session_id) AS r FROM dy)
        SELECT 'all' AS "all", round(sum(net), 6) + 0.0 AS total, {', '.join(f'round(sum(net) FILTER (r > {k}), 6) + 0.0 AS without_{k}' for k in (1, 5, 10))} FROM r""",
    "calibration": f"""WITH {SIG}, p AS (SELECT 1 / (1 + exp(-0.3 * x)) AS p, (raw > 0)::INT AS y FROM sg WHERE x IS NOT NULL AND raw IS NOT NULL) SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(y), 6) + 0.0 AS rate FROM p GROUP BY ALL""",
    "calibration_scores": f"""WITH {SIG}, p AS (SELECT 1 / (1 + exp(-0.3 * x)) AS p, (raw > 0)::INT AS y FROM sg WHERE x IS NOT NULL AND raw IS NOT NULL), b AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS r FROM p GROUP BY least(floor(p * 10), 9))
        SELECT round((SELECT sum(n * abs(m - r)) / sum(n) FROM b), 6) + 0.0 AS ece, round(avg((p - y) ** 2), 6) + 0.0 AS brier, round(avg(-ln(least(greatest(CASE WHEN y > 0 THEN p ELSE 1 - p END, 1e-8), 1))), 6) + 0.0 AS log_loss FROM p""",
    "quantile_calibration": f"""WITH {SIG}, p AS (SELECT root, timestamp, 1 / (1 + exp(-0.3 * x)) AS p, (raw > 0)::INT AS y FROM sg WHERE x IS NOT NULL AND raw IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p, timestamp) AS r, count(*) OVER (PARTITION BY root) AS c FROM p)
        SELECT root, greatest(((r - 1) * 10 + c - 2) // greatest(c - 1, 1) - 1, 0)::INT AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(y), 6) + 0.0 AS rate FROM r GROUP BY ALL""",
    "adjusted_rand": """WITH e AS (SELECT label, (embedding[1] > 0)::INT AS half FROM embeddings), c AS (SELECT label, half, count(*)::DOUBLE AS n FROM e GROUP BY ALL), k AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
        a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY half))
        SELECT round((s - sa * sb / (t * (t - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2), 0), 6) + 0.0 AS ari FROM k, a, b""",
    "active_votes": f"WITH {SIG}, {_VOTES} SELECT vt.root, detector, timestamp, {_R('num')}, {_R('den')}, {_R('mass')} FROM vt JOIN ix USING (root, i)",
    "dependence": f"""WITH {SIG}, {_VOTES}, o AS (SELECT root, timestamp, detector, direction::DOUBLE AS d FROM s3 WHERE direction <> 0), n AS (SELECT detector, count(*) AS n FROM o GROUP BY ALL),
        m AS (SELECT p.detector AS l, q.detector AS r, count(*) AS joint, corr(p.d, q.d) AS rho FROM o p JOIN o q ON p.root = q.root AND p.timestamp = q.timestamp AND p.detector < q.detector GROUP BY ALL)
        SELECT a.detector AS "left", b.detector AS "right", coalesce(joint, 0) AS joint, round(CASE WHEN coalesce(joint, 0) >= 10 AND rho IS NOT NULL AND NOT isnan(rho) THEN rho ELSE 0 END, 6) + 0.0 AS rho, round(coalesce(joint, 0) / nullif(a.n + b.n - coalesce(joint, 0), 0), 6) + 0.0 AS common
        FROM n a JOIN n b ON a.detector < b.detector LEFT JOIN m ON m.l = a.detector AND m.r = b.detector""",
    "sizing": f"""WITH {_CONTEXT}, a AS (SELECT *, hour(timestamp) / 24.0 - 0.5 AS mu, sigma_hat * sqrt(6048) AS sa, CASE WHEN count(spread_bp) OVER p >= 50 THEN quantile_cont(spread_bp, 0.95) OVER p END AS lim FROM cx WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT *, least(greatest(CASE WHEN sa > 0 THEN 0.1 / sa ELSE 0.0 END * tanh(mu / 0.25), -2.0), 2.0) AS raw, 0.25 * 0.1 / sqrt(252) / greatest(sigma_hat * sqrt(6), 1e-12) AS cap, coalesce(sigma_pct > 0.99, false) OR coalesce(spread_bp > lim, false) AS breaker FROM a)
        SELECT root, timestamp, round(greatest(least(raw, cap), -cap) * CASE WHEN breaker THEN 0.3 ELSE 1 END, 6) + 0.0 AS target, round(least(0.05 * sqrt(greatest(spread_bp, 0) * 1e-4 / greatest(sigma_hat ** 2 * 6, 1e-12)), 2), 6) + 0.0 AS band, round(sa, 6) + 0.0 AS sigma_ann, breaker FROM b""",
    "weight_ledger": f"""WITH {SIG}, {_WT} SELECT timestamp, {_R('gross_return')}, {_R('turnover')}, {_R('net_return')}, round(exp(sum(ln(1 + gross_return)) OVER o), 6) + 0.0 AS gross_wealth, round(exp(sum(ln(1 + net_return)) OVER o), 6) + 0.0 AS net_wealth FROM ln_ WINDOW o AS (ORDER BY timestamp)""",
    "buy_and_hold": f"WITH {STATE}, r AS (SELECT timestamp, close / first_value(close) OVER ({W}) AS rel FROM st) SELECT timestamp, round(avg(rel), 6) + 0.0 AS wealth FROM r GROUP BY timestamp",
    "strategy_costs": f"""WITH {SIG}, t AS (SELECT *, abs(direction - coalesce(lag(direction) OVER ({W}), 0))::DOUBLE AS turn, coalesce(ret, 0) AS r FROM sg), c AS (SELECT *, unnest([0.0, 2.0, 5.0])::DOUBLE AS cost_bp FROM t)
        SELECT cost_bp, timestamp::DATE::VARCHAR AS day, round(sum(direction * r - turn * cost_bp / 1e4), 6) + 0.0 AS net, round(sum(direction * r), 6) + 0.0 AS gross, round(sum(turn), 6) + 0.0 AS turnover FROM c GROUP BY ALL""",
    "held_sign": f"""WITH RECURSIVE {SIG}, v AS (SELECT root, timestamp, x, row_number() OVER ({W}) AS i FROM sg WHERE x IS NOT NULL),
        h AS (SELECT root, timestamp, i, CASE WHEN x >= 1 THEN 1 WHEN x <= -1 THEN -1 ELSE 0 END AS position FROM v WHERE i = 1
              UNION ALL SELECT v.root, v.timestamp, v.i, CASE WHEN x >= 1 THEN 1 WHEN x <= -1 THEN -1 WHEN h.position * x > 0.2 THEN h.position ELSE 0 END FROM h JOIN v ON v.root = h.root AND v.i = h.i + 1) SELECT root, timestamp, position FROM h""",
    "thinned_events": f"""WITH RECURSIVE {SIG}, v AS (SELECT root, timestamp, direction FROM tr), h AS (SELECT root, min(timestamp) AS timestamp FROM v GROUP BY root
              UNION ALL SELECT h.root, (SELECT min(v.timestamp) FROM v WHERE v.root = h.root AND v.timestamp >= h.timestamp + INTERVAL 4 HOUR) FROM h WHERE h.timestamp IS NOT NULL)
        SELECT v.root, v.timestamp, v.direction FROM h JOIN v ON v.root = h.root AND v.timestamp = h.timestamp""",
    "best_pairs": f"""WITH {SIG}, s AS (SELECT timestamp, root, x AS score, 1 + hour(timestamp) % 3 * 0.25 AS beta FROM sg WHERE x IS NOT NULL),
        p AS (SELECT a.timestamp, a.root AS long, b.root AS short, (b.beta * a.score - a.beta * b.score) / (a.beta + b.beta) AS ps, b.beta / (a.beta + b.beta) AS lw, -a.beta / (a.beta + b.beta) AS sw FROM s a JOIN s b ON a.timestamp = b.timestamp AND a.root <> b.root)
        SELECT timestamp, long, short, round(ps, 6) + 0.0 AS pair_score, round(lw, 6) + 0.0 AS long_weight, round(sw, 6) + 0.0 AS short_weight FROM p QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY ps DESC, long, short) = 1""",
    "hash_draws": f"SELECT o_orderkey, {_U("'11'", 'o_orderkey', "'u'")} AS u FROM orders",
}
_CDF = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 - {_TAIL(x)} WHEN {x} < 0 THEN {_TAIL(x)} END)"
_T = lambda x: f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
_TAIL = lambda x: f"({_T(x)} * (0.254829592 + {_T(x)} * (-0.284496736 + {_T(x)} * (1.421413741 + {_T(x)} * (-1.453152027 + {_T(x)} * 1.061405429)))) * exp(-({x}) * ({x}) / 2) / 2)"
_SR0 = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (20 * 2.718281828459045))
_PERF = ["annualized_return", "cumulative_return", "annualized_volatility", "downside_volatility", "var_95", "var_99", "skewness", "kurtosis", "sortino", "hit_rate", "payoff_ratio", "sharpe", "sharpe_se", "sharpe_ci_low", "sharpe_ci_high", "deflated_sharpe"]


def backtest_ctes(source: str) -> str:
    """The event backtest of a table with root, timestamp, session_id, target and the bars' columns. Every bar has the order of the bar before, so the position alone is carried."""
    return f"""b0 AS (SELECT *, coalesce(lag(local_symbol) OVER ({W}) <> local_symbol, false) AS rolls FROM {source}),
b1 AS (SELECT *, row_number() OVER ({W}) AS i, coalesce(ret, 0) AS total, lag(coalesce(target, 0)) OVER ({W}) AS want, lag(coalesce(target, 0) <> 0) OVER ({W}) AS active, is_valid AND NOT bool_or(rolls) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trade,
       bar_in_session < 2 OR bar_in_session > max(bar_in_session) OVER (PARTITION BY root, session_id) - 2 AS edge, 0.05 * coalesce(volume, 0) AS cap FROM b0),
hp AS (SELECT root, i, 0.0::DOUBLE AS old, 0.0::DOUBLE AS position, false AS volume_limited FROM b1 WHERE i = 1
  UNION ALL SELECT m.root, m.i, m.old, m.old + CASE WHEN abs(m.mv) > m.cap THEN sign(m.mv) * m.cap ELSE m.mv END, abs(m.mv) > m.cap FROM (
    SELECT b1.root, b1.i, b1.cap, hp.position AS old, CASE WHEN want IS NULL OR NOT trade OR (abs(want) > abs(hp.position) + 1e-12 OR hp.position * want < 0) AND edge OR active AND abs(want - hp.position) <= 0.05 THEN 0.0 ELSE want - hp.position END AS mv
    FROM hp JOIN b1 ON b1.root = hp.root AND b1.i = hp.i + 1) m),
bt0 AS (SELECT b1.*, old, position, volume_limited, CASE WHEN old <> position AND wap > 0 AND close > 0 THEN ln(close / wap) END AS after FROM b1 JOIN hp USING (root, i)),
bt AS (SELECT *, CASE WHEN after IS NOT NULL THEN old * (total - after) + position * after ELSE old * total END AS gross_return, 0.0003 * (0.5 * abs(position - old) + CASE WHEN rolls THEN abs(old) ELSE 0 END) AS cost,
       abs(position - old) + 2 * CASE WHEN rolls THEN abs(old) ELSE 0 END AS turnover, old <> position AS executed FROM bt0)"""


_BT = f"{SIG}, tg AS (SELECT *, direction * magnitude AS target FROM sg), {backtest_ctes('tg')}"
SQL |= {
    "causal_posterior": f"""WITH {SIG}, rd AS (SELECT root || '@' || timestamp::VARCHAR AS event_id, timestamp, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS structure, session_phase, outcome AS y, av
            FROM (SELECT *, lead(timestamp, 4) OVER ({W}) AS av FROM sg) WHERE direction <> 0 AND outcome IS NOT NULL),
        kn AS (SELECT t.event_id, o.structure, o.session_phase, count(*) AS k, sum(o.y) AS s, sum(o.y * o.y) AS sq FROM rd t JOIN rd o ON o.av <= t.timestamp AND o.av > o.timestamp GROUP BY ALL),
        gl AS (SELECT event_id, sum(k) AS n, sum(s) AS total, sum(sq) AS square FROM kn GROUP BY event_id), sp AS (SELECT event_id, count(*) AS c, var_samp(s / k) AS v, avg(1.0 / k) AS inv FROM kn WHERE k >= 2 GROUP BY event_id),
        a AS (SELECT rd.event_id, rd.timestamp, n, total / n AS mean, CASE WHEN n > 1 THEN greatest((square - total * total / n) / (n - 1), 1e-12) ELSE 1.0 END AS s2, c, v, inv, coalesce(k, 0) AS k, s
              FROM rd LEFT JOIN gl USING (event_id) LEFT JOIN sp USING (event_id) LEFT JOIN kn ON kn.event_id = rd.event_id AND kn.structure = rd.structure AND kn.session_phase = rd.session_phase),
        b AS (SELECT *, CASE WHEN c > 1 THEN greatest(v - s2 * inv, 0) ELSE 0 END AS tau FROM a), w AS (SELECT *, CASE WHEN k > 0 AND tau > 0 THEN k * tau / (k * tau + s2) ELSE 0.0 END AS w FROM b)
        SELECT event_id, timestamp, round(CASE WHEN w > 0 THEN w * s / k + (1 - w) * mean ELSE mean END, 6) + 0.0 AS posterior_mean, round(w, 6) + 0.0 AS confidence, k::INT AS prior_cell_n FROM w""",
    "economic_weight": f"""WITH {SIG}, al AS (SELECT avg(signed_z) AS mu0, var_samp(signed_z) AS s2 FROM tr), g AS (SELECT root, count(*) AS n, avg(signed_z) AS m FROM tr GROUP BY root),
        t AS (SELECT *, least(greatest(var_samp(m - mu0) OVER () - avg(s2 / n) OVER (), 0), s2 / 100) AS tau FROM g, al), c AS (SELECT *, CASE WHEN tau > 0 THEN n * tau / (n * tau + s2) ELSE 0 END AS w FROM t),
        z AS (SELECT *, (mu0 + w * (m - mu0) + 0.3 - 0.05) / 0.2 AS z FROM c)
        SELECT root, round(least(greatest(w + 0.5, 0), 1) * least(greatest(({_CDF('z')} - 0.6) / 0.4, 0), 1) * (n > 10)::INT, 5) + 0.0 AS weight FROM z""",
    "performance": f"""WITH {SIG}, pf AS (SELECT net * 0.001 - 0.011 AS net FROM dy), a AS (SELECT count(net) AS n, sum(net) AS s, avg(net) AS m, stddev_samp(net) AS sd, skewness(net) AS skewness, kurtosis(net) AS kurtosis, -quantile_cont(net, 0.05) AS var_95, -quantile_cont(net, 0.01) AS var_99,
            sqrt(avg(least(net, 0) ** 2)) AS down, avg((net > 0)::INT) AS hit_rate, avg(net) FILTER (net > 0) / abs(avg(net) FILTER (net < 0)) AS payoff_ratio FROM pf),
        b AS (SELECT *, m / sd * sqrt(252) AS sharpe, sqrt(greatest(1 - skewness * m / sd + (kurtosis + 2) * (m / sd) ** 2 / 4, 0) / (n - 1)) * sqrt(252) AS sharpe_se FROM a),
        c AS (SELECT *, exp(s * 252 / n) - 1 AS annualized_return, exp(s) - 1 AS cumulative_return, sd * sqrt(252) AS annualized_volatility, down * sqrt(252) AS downside_volatility, m * 252 / nullif(down * sqrt(252), 0) AS sortino, sharpe - 1.96 * sharpe_se AS sharpe_ci_low,
              sharpe + 1.96 * sharpe_se AS sharpe_ci_high, (sharpe - sharpe_se * {_SR0!r}) / sharpe_se AS zz FROM b), d AS (SELECT *, {_CDF('zz')} AS deflated_sharpe FROM c) SELECT 'all' AS "all", {', '.join(_R(c, 4) for c in _PERF)} FROM d""",
    "fusion": f"""WITH {SIG}, {_VOTES}, o AS (SELECT root, timestamp, detector, direction::DOUBLE AS d FROM s3 WHERE direction <> 0), dd AS (SELECT DISTINCT timestamp::DATE AS day FROM sg),
        jn AS (SELECT p.timestamp::DATE AS day, p.detector || q.detector AS pair, p.d AS x, q.d AS y FROM o p JOIN o q ON p.root = q.root AND p.timestamp = q.timestamp AND p.detector < q.detector),
        rh AS (SELECT dd.day, pair, CASE WHEN count(*) >= 10 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN round(abs(corr(x, y)), 9) ELSE 0 END AS r FROM dd JOIN jn ON jn.day < dd.day GROUP BY ALL),
        ab AS (SELECT dd.day, coalesce(max(r) FILTER (pair = 'R1R2'), 0) AS a, coalesce(max(r) FILTER (pair = 'R1R3'), 0) AS b, coalesce(max(r) FILTER (pair = 'R2R3'), 0) AS c FROM dd LEFT JOIN rh ON rh.day = dd.day GROUP BY dd.day),
        mg AS (SELECT day, CASE WHEN greatest(a, b, c) < 0.6 THEN 0 WHEN least(a, b, c) >= 0.6 THEN 4 WHEN a = greatest(a, b, c) THEN 1 WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END AS m FROM ab),
        cl AS (SELECT day, detector, CASE detector WHEN 'R1' THEN 1 WHEN 'R2' THEN CASE WHEN m IN (1, 4) THEN 1 ELSE 2 END ELSE CASE m WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 3 THEN 2 ELSE 3 END END AS k FROM mg, (SELECT unnest(['R1', 'R2', 'R3']) AS detector)),
        cs AS (SELECT *, count(*) OVER (PARTITION BY day, k) AS size FROM cl),
        v AS (SELECT vt.root, ix.timestamp, k, sum(num) / any_value(size) AS num, sum(den) / any_value(size) AS den, sum(mass) / any_value(size) AS mass FROM vt JOIN ix USING (root, i) JOIN cs ON cs.day = ix.timestamp::DATE AND cs.detector = vt.detector GROUP BY ALL),
        t AS (SELECT root, timestamp, sum(num) AS num, sum(den) AS den, sum(mass) AS mass, count(*) AS n FROM v GROUP BY ALL)
        SELECT sg.root, sg.timestamp, round(coalesce(num, 0) / (coalesce(den, 0) + 0.5), 6) + 0.0 AS mu, round(coalesce(mass / nullif(den, 0), 1), 6) + 0.0 AS active_horizon, round(coalesce(den, 0), 6) + 0.0 AS confidence_mass, coalesce(n, 0)::INT AS active_clusters FROM sg LEFT JOIN t USING (root, timestamp)""",
    "event_backtest": f"""WITH RECURSIVE {_BT} SELECT root, timestamp, session_id::VARCHAR AS session_id, {_R('position')}, {_R('gross_return')}, {_R('cost', 9)}, round(gross_return - cost, 9) + 0.0 AS net_return, {_R('turnover')}, executed, volume_limited FROM bt""",
    "backtest_days": f"""WITH RECURSIVE {_BT} SELECT timestamp::DATE::VARCHAR AS day, round(sum(gross_return), 6) + 0.0 AS gross, round(sum(cost), 6) + 0.0 AS cost, round(sum(gross_return - cost), 6) + 0.0 AS net, round(sum(turnover), 6) + 0.0 AS turnover, count_if(executed)::BIGINT AS fills FROM bt GROUP BY ALL""",
    "holding_periods": f"""WITH RECURSIVE {_BT}, sd AS (SELECT root, timestamp, sign(position)::INT AS side, row_number() OVER ({W}) - row_number() OVER (PARTITION BY root, sign(position) ORDER BY timestamp) AS run FROM bt)
        SELECT root, side, count(*) AS bars, min(timestamp) AS opened FROM sd WHERE side <> 0 GROUP BY root, side, run""",
}
SQL["full_card"] = f"SELECT c.*, n.nw_t, b.ci_low, b.ci_high FROM ({SQL['stat_card']}) c JOIN ({SQL['newey_west']}) n USING (root) JOIN ({SQL['stationary_bootstrap']}) b USING (root)"
_ALL = (
    stat_card, full_card, newey_west, stationary_bootstrap, day_block_bootstrap, matched_null, null_percentile, categories, shrinkage, root_shrinkage, causal_posterior, economic_weight, purged_splits, walk_forward, drawdowns, performance, concentration,
    calibration, calibration_scores, quantile_calibration, adjusted_rand, active_votes, dependence, fusion, sizing, weight_ledger, buy_and_hold, strategy_costs, held_sign, thinned_events, best_pairs, event_backtest, backtest_days, holding_periods, hash_draws,
)
QUERIES = {f.__name__: f for f in _ALL}
