"""Candidates, hold-outs, gates, intervals, rejection, soft tables, market positions and slow coordinates as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.windows import Bars
from quillon.operators import portfolio as P
from quillon.operators import selection as C
from quillon.operators import stats as T
from quillon.operators.prototypes import quantile_knots
from quillon.plans import evaluation as E
from quillon.plans.evaluation import _R, _U, SEED, SIG, daily_outcome, signals, triggers
from quillon.plans.market import rnd
from quillon.plans.prototypes import _CO, _DI, _SH, _WE, _e, _labelled, _member, coordinates, shares
from quillon.plans.sql import W, lag, strict
from quillon.plans.state import ROOTS, STATE, state
from quillon.sources.lineage import cut

BONUS = 0.02


def path_changes(spark, d):
    x = C.add_path(coordinates(spark, d).select("root", "timestamp", "activity", "trend"), ["activity", "trend"], 16)
    names = ["activity__lag", "activity__delta", "trend__lag", "trend__delta"]
    return rnd(x.select("root", "timestamp", *names), names)


def annual_bootstrap(spark, d):
    x = daily_outcome(spark, d).withColumn("net", F.col("net") * 0.001 - 0.011)
    draws = C.annualised(T.stationary_bootstrap(x, ["all"], ["session_id"], "net", 5.0, 100, SEED))
    return rnd(draws.select("draw", "annualized_return", "sharpe"), ["annualized_return", "sharpe"], 5)


def selected_candidate(spark, d):
    """The reversal with a bonus of 0.02, so that some candidates of the grid stand on a plateau and some don't."""
    grid = E._grid(spark, d).withColumn("signed_raw", F.col("signed_raw") + BONUS)
    x = T.plateau(T.walk_forward(grid, ["a", "b"], "signed_raw", 20), ["a", "b"])
    return rnd(C.select_candidate(x, "robust_pass", ["a", "b"]).select("a", "b", "triggers", "median_fold_net"), ["median_fold_net"])


def day_reliability(spark, d):
    x = triggers(spark, d).withColumns({"side": F.when(F.col("direction") > 0, "long").otherwise("short"), "net": F.col("signed_raw") - 0.15})
    return rnd(C.day_reliability(x, ["root", "side"], "net"), ["mean", "sem", "recent", "reliability"])


def cost_measures(spark, d):
    out = P.cost_measures(cut(E._backtest(spark, d)))
    return rnd(out, [c for c in out.columns if c != "executions"], 5)


def leave_one_out(spark, d):
    names = ["holdout_mean", "development_mean", "full_mean", "loi_ratio"]
    return rnd(C.leave_one_out(triggers(spark, d), "signed_z"), names)


def gate_table(spark, d):
    """Both sides, the long side without one instrument (which then has no triggers), and a detector that one instrument judges."""
    x = signals(spark, d).where("outcome IS NOT NULL")
    up, down = F.col("direction") > 0, F.col("direction") < 0
    masks = {"long": up, "short": down, "partial": up & (F.col("root") != "click"), "follower": up & (F.col("root") == "view")}
    own = x.withColumn("side", F.explode(F.array(*[F.when(m, n) for n, m in masks.items()]))).where("side IS NOT NULL")
    own = cut(own.withColumns({"signed_z": F.col("direction") * F.col("outcome"), "net": F.col("direction") * F.col("raw") - 0.001}))
    draws = [T.shifted_null(x.withColumn("direction", F.when(m, F.col("direction")).otherwise(0)), ["root", "session_phase"], ["timestamp"], "direction", "outcome", 50, SEED).withColumn("side", F.lit(n)) for n, m in masks.items()]
    strong = [F.avg(F.when(F.abs("x") >= k, F.col("signed_z"))) > 0 for k in (1.0, 1.1, 1.2, 1.3, 1.4)]
    steady = own.groupBy("side").agg((sum((s.cast("double") for s in strong), F.lit(0.0)) / len(strong)).alias("stability"))
    out = C.gate_table(own, "side", "signed_z", "net", ROOTS, reduce(DataFrame.unionByName, draws), steady, 100, 10, 2, {"follower": "view"}, 0.6, 0.5)
    return rnd(out, ["mean_z", "mean_net", "top10_session_share", "stability", "null_percentile"])


def paired_interval(spark, d):
    x = E._scores(spark, d).withColumns({"day": F.to_date("timestamp"), "own": F.pow(F.col("p") - F.col("y"), F.lit(2.0)), "half": F.lit(0.25)})
    return rnd(C.paired_interval(x, "own", "half", "day", 7, 200, SEED), ["mean", "low", "high"])


def state_intervals(spark, d):
    x = _labelled(spark, d).withColumns({"day": F.to_date("timestamp"), "value": F.col("q_later") - F.col("q_now")})
    return rnd(C.state_intervals(x, "state", "value", "day", 7, 200, SEED), ["mean", "low", "high", "largest_share"])


def seasonality_flatness(spark, d):
    x = state(spark, d).select("root", F.hour("timestamp").alias("slot"), F.abs(F.col("ret") / F.col("sigma_hat")).alias("abs_z"))
    return rnd(C.flatness(x, "slot", "abs_z", 10), ["range_over_mean"])


def market_weights(spark, d):
    x = signals(spark, d).groupBy("timestamp").agg(F.avg("x").alias("score"), F.max("magnitude").alias("risk")).withColumn("market", F.lit("all"))
    out = C.market_weights(x.where("score IS NOT NULL"), ["market"], "timestamp", "score", 0.5, 0.1, 5, F.col("risk") > 0.9)
    return out.select("timestamp", F.round("weight", 6).alias("weight"))


def frozen_map(spark, d):
    """Knots of the first twenty days, applied to all rows."""
    x = coordinates(spark, d).select("root", "timestamp", "activity", "trend")
    names = ["activity", "trend"]
    knots = quantile_knots(x.where(F.dayofmonth("timestamp") <= 20), names).groupBy().pivot("name", names).agg(F.first("knots"))
    wide = x.crossJoin(F.broadcast(knots.select(*[C.knot_shares(F.col(n)).alias(f"k_{n}") for n in names])))  # one row of knots
    return rnd(wide.select("root", "timestamp", *[C.frozen_mid_rank(F.col(n), F.col(f"k_{n}")).alias(n) for n in names]), names)


def dynamic_weights(spark, d):
    x = shares(spark, d).select("timestamp", F.pow(F.col("move") - 0.8, F.lit(2.0)).alias("path"), F.pow(F.col("activity") - 0.6, F.lit(2.0)).alias("flow"), (F.col("q_now") - F.col("q_later")).alias("y"))
    return rnd(C.dynamic_weights(x.where("path IS NOT NULL AND flow IS NOT NULL"), {"path": 2.0, "flow": 1.0}, "y", "timestamp", scale=0.1), ["weight"], 5)


def _radius_parts(spark, d):
    from quillon.operators.states import distributions

    e = _e(spark, d).withColumn("y", F.col("vec_id").cast("int") % 3)
    back = e.groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"))
    return distributions(e, "label", "y", 3, 5.0), T.beside(back, e.agg(F.count("*").alias("a"))).select("label", (F.col("n") / F.col("a")).alias("probability"))


def state_rejection(spark, d):
    member = _member(spark, d)
    table, back = _radius_parts(spark, d)
    return rnd(C.predict_states(member, C.radii(member), table, back, "vec_id"), ["probability"], 5)


def region_probabilities(spark, d):
    w = _member(spark, d).select("vec_id", F.posexplode("weights").alias("region", "weight"))
    rows = _e(spark, d).select("vec_id", (F.col("vec_id").cast("int") % 3).alias("label"))
    return rnd(C.region_probabilities(w, rows, "vec_id", 3, 50.0), ["probability"], 5)


def slow_coordinates(spark, d):
    w = Bars("root", "timestamp")
    x = state(spark, d).withColumns({"lc": F.ln("close"), "r2": F.pow("ret", F.lit(2.0))})
    x = x.withColumns({"rv": F.coalesce(w.sum(F.col("r2"), 24), F.lit(0.0)), "beta": 0.5 + F.hour("timestamp") / 24.0})
    names = ["relative_short", "relative_long", "market_trend_short", "market_trend_long", "signed_efficiency", "rv_ratio"]
    return rnd(C.slow_coordinates(x, 24, 96).select("root", "timestamp", *names), names, 5)


def scaled_portfolio(spark, d):
    x = cut(E.sizing(spark, d).select("root", "timestamp", "target", "sigma_ann").where("target IS NOT NULL AND sigma_ann IS NOT NULL"))  # read five times
    roots = x.select(F.col("root").alias("a")).distinct()
    corr = roots.join(roots.withColumnRenamed("a", "b"), F.lit(True)).withColumn("corr", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.3))  # a few instruments
    return rnd(P.scale_portfolio(x, corr, 0.1, 1.0).select("root", "timestamp", "target"), ["target"], 6)


def outcome_heat(spark, d):
    """Counts, means and quartiles of outcomes by hour and weekday, as a chart of them needs."""
    q = F.percentile("outcome", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    x = signals(spark, d).where("outcome IS NOT NULL").groupBy(F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("weekday"))
    x = x.agg(F.count("*").alias("n"), F.avg("outcome").alias("mean"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))
    return rnd(x, ["mean", "q25", "q50", "q75"])


_DAYS = lambda draws: f"""nd AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM da), dr AS (SELECT i, n, unnest(range({draws})) AS draw FROM nd),
pk AS (SELECT draw, (floor({_U(f"'{SEED}'", "'days'", 'draw', '(i // 7)')} * n)::BIGINT + i % 7) % n AS i FROM dr)"""  # noqa: E731
_MID = lambda c: f"""(CASE WHEN {c} IS NULL THEN 0.5 ELSE list_transform([{{'lo': list_last(list_filter(k_{c}, lambda k: k.v <= {c})), 'hi': list_first(list_filter(k_{c}, lambda k: k.v >= {c}))}}],
    lambda z: CASE WHEN z.lo IS NULL THEN z.hi.p WHEN z.hi IS NULL THEN z.lo.p WHEN z.lo.v = z.hi.v THEN z.lo.p ELSE z.lo.p + ({c} - z.lo.v) / (z.hi.v - z.lo.v) * (z.hi.p - z.lo.p) END)[1] END)"""  # noqa: E731
_KNOT = lambda c: f"""(SELECT list({{'v': v, 'p': CASE WHEN one THEN 0.5 ELSE p END}} ORDER BY v) FROM (SELECT v, (min(j) + max(j)) / 2 / 100.0 AS p, count(*) OVER () = 1 AS one
    FROM (SELECT unnest(k) AS v, generate_subscripts(k, 1) - 1 AS j FROM (SELECT quantile_cont({c}, [{', '.join(str(i / 100) for i in range(101))}]) AS k FROM co WHERE day(timestamp) <= 20)) GROUP BY v))"""  # noqa: E731
_RAD = f"""{_DI}, nr AS (SELECT vec_id, first(id ORDER BY round(d, 9), id) AS state, first(d ORDER BY round(d, 9), id) AS d FROM di GROUP BY vec_id), ra AS (SELECT state, quantile_cont(d, 0.9) AS radius FROM nr GROUP BY state),
e AS (SELECT label AS state, (vec_id % 3)::INT AS y FROM embeddings), g AS (SELECT unnest(range(3))::INT AS label), bk AS (SELECT y AS label, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY y),
pr AS (SELECT label, (count(y) + 1) / (sum(count(y)) OVER () + 3) AS prior FROM g LEFT JOIN e ON y = label GROUP BY label), c AS (SELECT s.state, label, prior, count(y) AS n FROM (SELECT DISTINCT state FROM e) s CROSS JOIN pr LEFT JOIN e ON e.state = s.state AND y = label GROUP BY ALL),
t AS (SELECT state, label, (n + 5 * prior) / (sum(n) OVER (PARTITION BY state) + 5) AS p FROM c), ac AS (SELECT nr.*, d <= radius AS accepted FROM nr JOIN ra USING (state))"""
_LIFT = " UNION ALL ".join(f"SELECT '{n}' AS name, {w} AS prior, timestamp < mid AS early, {n} AS d, y FROM dw, md WHERE y IS NOT NULL" for n, w in (("path", 2.0), ("flow", 1.0)))
_SLOW = ", ".join(
    f"least(greatest((lc - {lag('lc', h)} - beta * (m - {lag('m', h)})) / sqrt(greatest(rv, 1e-9) * {h} / 24), -5), 5) AS relative_{n}, least(greatest((m - {lag('m', h)}) / sqrt(greatest(mrv, 1e-9) * {h} / 24), -5), 5) AS market_trend_{n}"
    for h, n in ((24, "short"), (96, "long"))
)
_SLOW_NAMES = ("relative_short", "relative_long", "market_trend_short", "market_trend_long", "signed_efficiency", "rv_ratio")
_LAB = f"""{_CO}, lb AS (SELECT *, (CASE WHEN move > 0 THEN 1 ELSE 0 END + 2 * (hour(timestamp) % 3))::INT AS state, timestamp::DATE AS day, q_later - q_now AS value FROM co WHERE q_later IS NOT NULL AND sigma_hat IS NOT NULL)"""
SQL = {
    "path_changes": f"""WITH {_CO} SELECT root, timestamp, {', '.join(f"round({lag(c, 16)}, 6) + 0.0 AS {c}__lag, round({c} - {lag(c, 16)}, 6) + 0.0 AS {c}__delta" for c in ('activity', 'trend'))} FROM co""",
    "annual_bootstrap": f"""WITH {SIG}, b AS (SELECT net * 0.001 - 0.011 AS net, row_number() OVER (ORDER BY session_id) - 1 AS i, count(*) OVER () AS n FROM dy), s AS (SELECT *, unnest(range(100)) AS draw FROM b),
        r AS (SELECT draw, i, n, i = 0 OR {_U("'11'", "'all'", 'draw', 'i', "'restart'")} < 0.2 AS re, floor({_U("'11'", "'all'", 'draw', 'i', "'at'")} * n)::BIGINT AS fresh FROM s),
        q AS (SELECT draw, i, n, last_value(CASE WHEN re THEN i END IGNORE NULLS) OVER w AS i0, last_value(CASE WHEN re THEN fresh END IGNORE NULLS) OVER w AS f0 FROM r WINDOW w AS (PARTITION BY draw ORDER BY i)),
        m AS (SELECT draw, avg(net) AS mean, stddev_samp(net) AS sd FROM q JOIN b ON b.i = (f0 + q.i - i0) % q.n GROUP BY draw)
        SELECT draw::INT AS draw, round(exp(mean * 252) - 1, 5) + 0.0 AS annualized_return, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252) END, 5) + 0.0 AS sharpe FROM m""",
    "selected_candidate": E.SQL["walk_forward"].replace("fold, signed_raw, a, b FROM tr", f"fold, signed_raw + {BONUS} AS signed_raw, a, b FROM tr").rsplit("SELECT a, b, triggers, positive_roots", 1)[0]
    + "SELECT a, b, triggers, round(median_fold_net, 6) + 0.0 AS median_fold_net FROM fi WHERE base_pass AND neighbor_count >= 2 AND plateau_rate >= 0.5 ORDER BY fi.median_fold_net DESC, fi.positive_fold_rate DESC, fi.worst_root_net DESC, a, b LIMIT 1",
    "day_reliability": f"""WITH {SIG}, x AS (SELECT *, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, signed_raw - 0.15 AS net, epoch_us(timestamp) AS t FROM tr),
        d AS (SELECT root, side, stddev_samp(m) / sqrt(count(*)) AS sem, count(*) AS days FROM (SELECT root, side, timestamp::DATE AS day, avg(net) AS m FROM x GROUP BY ALL) GROUP BY ALL), k AS (SELECT root, side, quantile_cont(t, 0.5) AS mid, avg(net) AS mean, count(*) AS events FROM x GROUP BY ALL),
        r AS (SELECT x.root, x.side, avg(net) AS recent FROM x JOIN k ON k.root = x.root AND k.side = x.side AND t >= mid GROUP BY ALL)
        SELECT root, side, {_R('mean')}, round(CASE WHEN days > 1 THEN sem END, 6) + 0.0 AS sem, {_R('recent')}, events, days,
               round(CASE WHEN days > 1 THEN greatest(mean, 0) / (abs(mean) + sem + 0.0005) * least(1, events / 150) * CASE WHEN recent <= 0 THEN 0.2 ELSE 1 END ELSE 0 END, 6) + 0.0 AS reliability FROM k JOIN d USING (root, side) JOIN r USING (root, side)""",
    "cost_measures": f"""WITH RECURSIVE {E._BT}, dd AS (SELECT sum(gross_return - cost) AS net, sum(turnover) AS t FROM bt GROUP BY timestamp::DATE), a AS (SELECT sum(gross_return) AS gross, sum(cost) AS total_cost, count_if(executed)::BIGINT AS executions, sum(turnover) AS qt, avg(volume_limited::INT) AS volume_limited_fraction,
            avg((position <> 0)::INT) AS active_bar_fraction, avg(turnover) FILTER (turnover > 0) AS mean_trade_size FROM bt), y AS (SELECT avg(t) * 252 AS annualized_turnover, stddev_samp(net) * sqrt(252) AS vol FROM dd)
        SELECT round(gross, 5) + 0.0 AS gross, round(total_cost, 5) + 0.0 AS total_cost, round(CASE WHEN gross > 0 THEN total_cost / gross END, 5) + 0.0 AS cost_to_gross, round(annualized_turnover, 5) + 0.0 AS annualized_turnover, executions,
               round(CASE WHEN qt > 0 THEN total_cost / qt END * 1e4, 5) + 0.0 AS cost_per_turnover_bp, round(CASE WHEN vol > 0 THEN total_cost / vol END, 5) + 0.0 AS cost_to_volatility, round(volume_limited_fraction, 5) + 0.0 AS volume_limited_fraction,
               round(active_bar_fraction, 5) + 0.0 AS active_bar_fraction, round(mean_trade_size, 5) + 0.0 AS mean_trade_size FROM a, y""",
    "leave_one_out": f"""WITH {SIG}, a AS (SELECT sum(signed_z) AS s, count(signed_z) AS n FROM tr), r AS (SELECT root, sum(signed_z) AS rs, count(signed_z) AS rn FROM tr GROUP BY root)
        SELECT root AS holdout_root, round(rs / rn, 6) + 0.0 AS holdout_mean, round((s - rs) / nullif(n - rn, 0), 6) + 0.0 AS development_mean, round(s / n, 6) + 0.0 AS full_mean, round(CASE WHEN s / n > 0 THEN rs / rn / (s / n) END, 6) + 0.0 AS loi_ratio FROM r, a""",
    "gate_table": f"""WITH {SIG}, si AS (SELECT unnest(['long', 'short', 'partial', 'follower']) AS side), ds AS (SELECT sg.*, side, direction * outcome AS signed_z, direction * raw - 0.001 AS net FROM sg, si WHERE outcome IS NOT NULL AND
            CASE side WHEN 'long' THEN direction > 0 WHEN 'short' THEN direction < 0 WHEN 'partial' THEN direction > 0 AND root <> 'click' ELSE direction > 0 AND root = 'view' END),
        b AS (SELECT root, session_phase, timestamp, direction, outcome, row_number() OVER (PARTITION BY root, session_phase ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY root, session_phase) AS n FROM sg WHERE outcome IS NOT NULL),
        t AS (SELECT b.*, side, unnest(range(50)) AS draw FROM b JOIN (SELECT root, timestamp, side FROM ds) USING (root, timestamp)), m AS (SELECT t.root, t.session_phase, side, draw, direction, (i + floor({_U("'11'", 't.root', 't.session_phase', 'draw')} * n)::BIGINT) % n AS j FROM t),
        nl AS (SELECT side, m.draw, avg(m.direction * b.outcome) AS mean FROM m JOIN b ON b.root = m.root AND b.session_phase = m.session_phase AND b.i = m.j GROUP BY ALL),
        r AS (SELECT side, min(n) AS least_root, count(*) FILTER (m > 0) AS positive_roots FROM (SELECT si.side, ro.root, count(ds.root) AS n, avg(signed_z) AS m FROM si CROSS JOIN (SELECT DISTINCT root FROM sg) ro LEFT JOIN ds ON ds.side = si.side AND ds.root = ro.root GROUP BY ALL) GROUP BY side),
        tp AS (SELECT side, sum(n) AS top FROM (SELECT side, count(*) AS n FROM ds GROUP BY side, session_id QUALIFY row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, session_id) <= 10) GROUP BY side),
        a AS (SELECT side, count(*) AS triggers, avg(signed_z) AS mean_z, avg(net) AS mean_net, count(*) FILTER (root = 'view') AS nv, avg(signed_z) FILTER (root = 'view') AS mv, ({' + '.join(f"(avg(signed_z) FILTER (abs(x) >= {k}) > 0)::INT" for k in (1.0, 1.1, 1.2, 1.3, 1.4))}) / 5 AS stability FROM ds GROUP BY side),
        p AS (SELECT side, avg((mean <= mean_z)::INT) AS null_percentile FROM nl JOIN a USING (side) GROUP BY side),
        g AS (SELECT *, CASE WHEN side = 'follower' THEN nv >= 100 ELSE triggers >= 100 AND least_root >= 10 END AS trigger_gate, CASE WHEN side = 'follower' THEN mv > 0 ELSE positive_roots >= 2 END AS sign_gate, stability >= 0.6 AS stability_gate, null_percentile >= 0.5 AS null_gate, mean_net > 0 AS net_gate
              FROM a JOIN r USING (side) JOIN tp USING (side) JOIN p USING (side))
        SELECT side, triggers, {_R('mean_z')}, {_R('mean_net')}, least_root, positive_roots, {_R('null_percentile')}, {_R('stability')}, trigger_gate, sign_gate, stability_gate, null_gate, net_gate, round(top / triggers, 6) + 0.0 AS top10_session_share,
               trigger_gate AND sign_gate AND stability_gate AND null_gate AND net_gate AS passed FROM g""",
    "paired_interval": f"""WITH {SIG}, da AS (SELECT timestamp::DATE AS day, avg((1 / (1 + exp(-0.3 * x)) - (raw > 0)::INT) ** 2) - 0.25 AS d FROM sg WHERE x IS NOT NULL AND raw IS NOT NULL GROUP BY ALL), {_DAYS(200)},
        m AS (SELECT draw, avg(d) AS m FROM pk JOIN nd USING (i) GROUP BY draw) SELECT round((SELECT avg(d) FROM da), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m""",
    "state_intervals": f"""WITH {_LAB}, da AS (SELECT DISTINCT day FROM lb), {_DAYS(200)}, ds AS (SELECT state, day, sum(value) AS s, count(value) AS c FROM lb GROUP BY ALL),
        m AS (SELECT state, draw, sum(s) / sum(c) AS m FROM pk JOIN nd USING (i) JOIN ds USING (day) GROUP BY ALL), k AS (SELECT 0.05 / count(DISTINCT state) / 2 AS a FROM lb),
        b AS (SELECT state, quantile_cont(m, {0.05 / 6 / 2!r}) AS low, quantile_cont(m, {1 - 0.05 / 6 / 2!r}) AS high FROM m GROUP BY state),
        l AS (SELECT state, max(n) / sum(n) AS largest_share FROM (SELECT state, root, count(value) AS n FROM lb GROUP BY ALL) GROUP BY state), o AS (SELECT state, count(value) AS rows, count(DISTINCT day) AS days, avg(value) AS mean FROM lb GROUP BY state)
        SELECT state, rows, days, {_R('mean')}, {_R('low')}, {_R('high')}, {_R('largest_share')} FROM o JOIN b USING (state) JOIN l USING (state)""",
    "seasonality_flatness": f"""WITH {STATE}, c AS (SELECT root, avg(abs(ret / sigma_hat)) AS m FROM st WHERE ret / sigma_hat IS NOT NULL GROUP BY root, hour(timestamp) HAVING count(*) >= 10)
        SELECT root, round((max(m) - min(m)) / avg(m), 6) + 0.0 AS range_over_mean, count(*) AS slots FROM c GROUP BY root""",
    "market_weights": f"""WITH RECURSIVE {SIG}, v AS (SELECT timestamp, avg(x) AS x, max(magnitude) > 0.9 AS off, row_number() OVER (ORDER BY timestamp) AS i FROM sg GROUP BY timestamp HAVING avg(x) IS NOT NULL),
        h AS (SELECT timestamp, i, CASE WHEN off THEN 0 WHEN x >= 0.5 THEN 1 WHEN x <= -0.5 THEN -1 ELSE 0 END AS s FROM v WHERE i = 1
              UNION ALL SELECT v.timestamp, v.i, CASE WHEN off THEN 0 WHEN x >= 0.5 THEN 1 WHEN x <= -0.5 THEN -1 WHEN h.s * x > 0.1 THEN h.s ELSE 0 END FROM h JOIN v ON v.i = h.i + 1) SELECT timestamp, round(s / 5, 6) + 0.0 AS weight FROM h""",
    "frozen_map": f"""WITH {_CO}, kk AS (SELECT {_KNOT('activity')} AS k_activity, {_KNOT('trend')} AS k_trend) SELECT root, timestamp, round({_MID('activity')}, 6) + 0.0 AS activity, round({_MID('trend')}, 6) + 0.0 AS trend FROM co, kk""",
    "dynamic_weights": f"""WITH {_SH}, dw AS (SELECT sh.timestamp, (sh.move - 0.8) ** 2 AS path, (sh.activity - 0.6) ** 2 AS flow, co.q_now - co.q_later AS y FROM sh JOIN co ON co.root = sh.root AND co.timestamp = sh.timestamp WHERE sh.move IS NOT NULL AND sh.activity IS NOT NULL),
        md AS (SELECT to_timestamp(quantile_cont(epoch(timestamp), 0.5))::TIMESTAMP AS mid FROM dw), lo AS ({_LIFT}), q AS (SELECT name, early, quantile_cont(d, 0.08) AS q, avg(y) AS m, count(*) AS n FROM lo GROUP BY ALL),
        li AS (SELECT name, prior, early, CASE WHEN any_value(n) >= 100 THEN avg(y) FILTER (d <= q) - any_value(m) ELSE 0 END AS lift FROM lo JOIN q USING (name, early) GROUP BY ALL)
        SELECT name, round(prior * (0.75 + 0.5 * tanh((CASE WHEN count(*) = 2 THEN greatest(min(lift), 0) ELSE 0 END) / 0.1)), 5) + 0.0 AS weight FROM li GROUP BY name, prior""",
    "state_rejection": f"""WITH {_RAD} SELECT vec_id, ac.state, accepted, label, round(p, 5) + 0.0 AS probability FROM ac JOIN t USING (state) WHERE accepted UNION ALL SELECT vec_id, state, accepted, label, round(p, 5) + 0.0 FROM ac, bk WHERE NOT accepted""",
    "region_probabilities": f"""WITH {_WE}, y AS (SELECT vec_id, (vec_id % 3)::INT AS label FROM embeddings), b AS (SELECT label, (count(*) + 1) / (SELECT count(*) + 3 FROM y) AS p FROM y GROUP BY label), t AS (SELECT id, sum(w) AS tw FROM we GROUP BY id), c AS (SELECT id, label, sum(w) AS cw FROM we JOIN y USING (vec_id) GROUP BY ALL)
        SELECT t.id::INT AS region, b.label, round((coalesce(cw, 0) + 50 * p) / (tw + 50), 5) + 0.0 AS probability FROM t CROSS JOIN b LEFT JOIN c ON c.id = t.id AND c.label = b.label""",
    "slow_coordinates": f"""WITH {STATE}, a AS (SELECT *, ln(close) AS lc, ret * ret AS r2, 0.5 + hour(timestamp) / 24.0 AS beta FROM st), b AS (SELECT *, coalesce({strict('sum', 'r2', 24)}, 0) AS rv FROM a),
        c AS (SELECT *, avg(lc) OVER (PARTITION BY timestamp) AS m, avg(rv) OVER (PARTITION BY timestamp) AS mrv, greatest(rv, 1e-9) AS v, abs(lc - {lag('lc')}) AS ar, row_number() OVER ({W}) - 1 AS i FROM b),
        f AS (SELECT root, timestamp, i, {_SLOW}, least(greatest((lc - {lag('lc', 24)}) / greatest({strict('sum', 'ar', 24)}, 1e-8), -1), 1) AS signed_efficiency, least(greatest(ln(({strict('avg', 'v', 24)} + 1e-9) / ({strict('avg', 'v', 96)} + 1e-9)), -3), 3) AS rv_ratio FROM c)
        SELECT root, timestamp, {', '.join(f'round(CASE WHEN i >= 96 THEN {n} END, 5) + 0.0 AS {n}' for n in _SLOW_NAMES)} FROM f""",
    "scaled_portfolio": f"""WITH z AS (SELECT root, timestamp, target, sigma_ann FROM ({E.SQL['sizing']}) WHERE target IS NOT NULL AND sigma_ann IS NOT NULL),
        v AS (SELECT a.timestamp, sum(a.target * a.sigma_ann * b.target * b.sigma_ann * CASE WHEN a.root = b.root THEN 1 ELSE 0.3 END) AS v FROM z a JOIN z b ON a.timestamp = b.timestamp GROUP BY a.timestamp),
        s AS (SELECT timestamp, sum(greatest(target, 0)) AS l, sum(greatest(-target, 0)) AS h FROM z GROUP BY timestamp)
        SELECT root, z.timestamp, round(target * least(1, coalesce(0.1 / nullif(sqrt(greatest(v, 0)), 0), 1)) * least(1, coalesce(1.0 / nullif(CASE WHEN target > 0 THEN l ELSE h END, 0), 1)), 6) + 0.0 AS target FROM z JOIN v ON v.timestamp = z.timestamp JOIN s ON s.timestamp = z.timestamp""",
    "outcome_heat": f"""WITH {SIG} SELECT hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS weekday, count(*) AS n, round(avg(outcome), 6) + 0.0 AS mean, {', '.join(f'round(quantile_cont(outcome, 0.{q}), 6) + 0.0 AS q{q}' for q in (25, 50, 75))} FROM sg WHERE outcome IS NOT NULL GROUP BY ALL""",
}
_ALL = (
    path_changes, annual_bootstrap, selected_candidate, day_reliability, cost_measures, leave_one_out, gate_table, paired_interval, state_intervals, seasonality_flatness, market_weights, frozen_map, dynamic_weights, state_rejection, region_probabilities, slow_coordinates,
    scaled_portfolio, outcome_heat,
)
QUERIES = {f.__name__: f for f in _ALL}
