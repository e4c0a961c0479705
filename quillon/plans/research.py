"""Future paths, regimes, betas, thresholds, further nulls, seasonality, forecasts and splits as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.scalars import log
from quillon.functions.windows import Bars
from quillon.operators import bars as B
from quillon.operators import relational as L
from quillon.operators import research as R
from quillon.operators.features import snapshots
from quillon.plans.evaluation import _R, _U, SEED, SIG, backtest_ctes, signals
from quillon.plans.market import rnd
from quillon.plans.prototypes import _DI, _LB, COORDS, _labelled, _member, coordinates
from quillon.plans.sql import BARS, W, strict
from quillon.plans.state import state


def path_labels(spark, d):
    x = R.path_labels(state(spark, d).select("root", "timestamp", "close"), "close", [4, 12])
    x = x.withColumn("balance", R.semivariance_direction(F.col("up_4"), F.col("down_4")))
    names = ["ret_4", "up_4", "down_4", "ret_12", "up_12", "down_12", "balance"]
    return rnd(x.select("root", "timestamp", *names), names)


def _reg(spark, d):
    w = Bars("root", "timestamp")
    x = state(spark, d).withColumn("r2", F.pow("ret", F.lit(2.0)))
    x = x.withColumns({"rv": w.sum(F.col("r2"), 12), "trend": w.sum(F.col("ret"), 12)})
    return x.withColumn("regime", R.regime(F.col("rv"), F.col("trend"), 3.0, 6.0))


def regimes(spark, d):
    return rnd(_reg(spark, d).select("root", "timestamp", "rv", "regime"), ["rv"])


def market_residuals(spark, d):
    return rnd(R.market_residual(state(spark, d).select("root", "timestamp", "ret"), "ret"), ["ret", "residual"])


def past_betas(spark, d):
    return rnd(R.past_beta(state(spark, d).select("root", "timestamp", "ret"), "ret", 48, 24), ["ret", "market", "beta"])


def trailing_thresholds(spark, d):
    return rnd(R.trailing_thresholds(_reg(spark, d), "volume", "regime", 7, 14, 0.8, 60, 100), ["threshold"])


def day_shift_null(spark, d):
    return rnd(R.day_shift_null(signals(spark, d).where("outcome IS NOT NULL"), "direction", "outcome", 24, 30, SEED), ["mean"])


def stratified_null(spark, d):
    x = signals(spark, d).where("outcome IS NOT NULL").withColumn("week", F.expr("(day(timestamp) - 1) div 7"))
    return rnd(R.stratified_null(x, ["root", "week", "session_phase"], "direction", "outcome", 20, SEED), ["mean"])


def attributions(spark, d):
    x = signals(spark, d).where("direction <> 0 AND raw IS NOT NULL").withColumns({"side": F.when(F.col("direction") > 0, "long").otherwise("short"), "week": F.expr("(day(timestamp) - 1) div 7"), "pnl": F.col("direction") * F.col("raw")})
    m = {"n": F.count("*"), "pnl": F.sum("pnl"), "hit": F.avg((F.col("pnl") > 0).cast("double"))}
    return rnd(L.grouped_reports(x, [["root"], ["side"], ["session_phase"], ["week"], ["root", "side"]], m).select("report", "root", "side", "session_phase", "week", "n", "pnl", "hit"), ["pnl", "hit"])


def parameter_surface(spark, d):
    """Mean signed outcome of a breakout rule over a grid of windows and widths."""
    w, out = Bars("root", "timestamp"), None
    x = signals(spark, d).where("outcome IS NOT NULL")
    for n in (6, 12, 24):
        part = x.select("root", F.lit(n).alias("lookback"), "outcome", (log(F.col("close") / w.max(F.col("high"), n, back=1)) / F.col("sigma_hat")).alias("z"))
        out = part if out is None else out.unionByName(part)
    grid = out.withColumn("width", F.explode(F.array(*[F.lit(v) for v in (-0.5, -0.25, 0.0)]))).where("z > width")
    return rnd(grid.groupBy("lookback", "width").agg(F.count("*").alias("n"), F.avg("outcome").alias("mean_z")), ["mean_z"])


def dual_snapshots(spark, d):
    fine = B.bars_of(spark, d).select("root", "timestamp", "close")
    coarse = B.bars_of(spark, d, "4 hours").select("root", "timestamp", "close")
    return snapshots(fine, coarse, 4, 60, 240)


def state_medoids(spark, d):
    return rnd(R.medoids(_member(spark, d), "state", "distance", ["vec_id"]), ["distance"], 5)


def ranked_scores(spark, d):
    p = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.2), F.lit(0.1))
    x = _labelled(spark, d).withColumn("rps", R.ranked_probability_score(p, F.col("y")))
    return rnd(x.groupBy("root").agg(F.avg("rps").alias("rps"), F.count("*").alias("n")), ["rps"])


def feature_audit(spark, d):
    x = coordinates(spark, d).withColumn("twin", F.col("move") * 2 + 0.001)
    return rnd(R.feature_audit(x, [*COORDS, "twin"]), ["available"])


SIGNATURE = ["alpha_4", "alpha_12", "balance_4", "balance_12", "variance_ratio_4", "variance_ratio_12", "best", "worst"]


def outcome_signature(spark, d):
    x = state(spark, d).select("root", "timestamp", "close", (F.pow("sigma_hat", F.lit(2.0)) * 24).alias("rv"), (0.5 + F.hour("timestamp") / 24.0).alias("beta")).where("rv IS NOT NULL")
    return rnd(R.outcome_signature(x, "close", "beta", "rv", 4, 12).select("root", "timestamp", *SIGNATURE), SIGNATURE, 5)


def shrunk_correlations(spark, d):
    roots = ["click", "error", "purchase", "signup", "view"]
    daily = B.bars_of(spark, d).groupBy(F.col("session_id").alias("day")).pivot("root", roots).agg(F.ln(F.max_by("close", "timestamp") / F.min_by("open", "timestamp")))
    return rnd(R.shrunk_correlations(daily, roots, 20, 8.0).withColumn("day", F.col("day").cast("string")), ["corr"])


def certified_stumps(spark, d):
    x = _labelled(spark, d).withColumn("target", F.col("q_later") - F.col("q_now"))
    return rnd(R.certified_stumps(x, "state", COORDS, "target", "timestamp", 3), ["threshold", "gain"])


def whitening(spark, d):
    return R.whitening(coordinates(spark, d), COORDS)


def shuffled_backtests(spark, d):
    """The event backtest with targets moved on around each instrument's series, by draw."""
    from quillon.operators import portfolio as P
    from quillon.operators.stats import numbered
    from quillon.functions.scalars import uniform

    x = signals(spark, d)
    before = Bars("root", "timestamp").lag(F.col("local_symbol"))
    x = numbered(x.withColumns({"target": F.col("direction") * F.col("magnitude"), "is_roll_boundary": before.isNotNull() & (before != F.col("local_symbol"))}), ["root"], ["timestamp"])
    spread = x.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = (F.col("i") + F.floor(uniform(F.lit(SEED), F.col("root"), F.col("draw")) * F.col("n")).cast("long")) % F.col("n")
    moved = spread.drop("target").withColumn("j", at).join(x.select("root", F.col("i").alias("j"), "target"), ["root", "j"])
    # The draw is part of the key, so draws run in parallel.
    keyed = moved.withColumns({"root": F.concat_ws("#", "root", F.col("draw").cast("string")), "band": F.lit(0.05), "signal_active": F.col("target") != 0, "round_trip_cost_bp": F.lit(2.0), "overnight_ret": F.lit(None).cast("double")})
    out = P.event_backtest(keyed)
    return rnd(out.groupBy(F.substring_index("root", "#", -1).cast("int").alias("draw")).agg(F.sum("net_return").alias("net"), F.sum("turnover").alias("turnover")), ["net", "turnover"])


_CUM = [0.1, 0.3, 0.7, 0.9, 1.0]
_RPS = " + ".join(f"({c} - (y < {k + 1})::INT) ** 2" for k, c in enumerate(_CUM))
_C3 = [*COORDS, "twin"]
_REDUNDANT = " UNION ALL ".join(f"SELECT '{a}' AS name, round(avg(({a} IS NOT NULL)::INT), 6) + 0.0 AS available, ({' + '.join(f'(abs(corr({a}, {b})) > 0.95)::INT' for b in _C3 if b != a)})::INT AS redundant FROM au" for a in _C3)
_REG = f"""rg AS (SELECT *, CASE WHEN rv >= 6 THEN 3 WHEN rv < 3 AND trend < 0 THEN 0 WHEN rv < 3 AND trend >= 0 THEN 1 ELSE 2 END AS regime FROM (SELECT *, {strict('sum', 'r2', 12)} AS rv, {strict('sum', 'ret', 12)} AS trend FROM (SELECT *, ret * ret AS r2 FROM st)))"""
_F = lambda n: f"OVER ({W} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
_PL = ", ".join(f"CASE WHEN count(r) {_F(h)} = {h} THEN sum(r) {_F(h)} END AS ret_{h}, CASE WHEN count(r) {_F(h)} = {h} THEN sum(greatest(r, 0) ** 2 * (r IS NOT NULL)::INT) {_F(h)} END AS up_{h}, CASE WHEN count(r) {_F(h)} = {h} THEN sum(CASE WHEN r IS NOT NULL THEN least(r, 0) ** 2 END) {_F(h)} END AS down_{h}" for h in (4, 12))
_SURF = " UNION ALL ".join(f"SELECT {n} AS lookback, outcome, ln(close / {strict('max', 'high', n, 1)}) / sigma_hat AS z FROM sg WHERE outcome IS NOT NULL" for n in (6, 12, 24))
SQL = {
    "path_labels": f"""WITH {SIG}, a AS (SELECT root, timestamp, ln(lead(close) OVER ({W}) / close) AS r FROM st), b AS (SELECT root, timestamp, {_PL} FROM a)
        SELECT root, timestamp, {', '.join(_R(c) for c in ('ret_4', 'up_4', 'down_4', 'ret_12', 'up_12', 'down_12'))}, round((up_4 - down_4) / (up_4 + down_4 + 1e-12), 6) + 0.0 AS balance FROM b""",
    "regimes": f"WITH {SIG}, {_REG} SELECT root, timestamp, {_R('rv')}, regime FROM rg",
    "market_residuals": f"WITH {SIG} SELECT root, timestamp, {_R('ret')}, round(ret - (sum(ret) OVER t - ret) / nullif(count(ret) OVER t - 1, 0), 6) + 0.0 AS residual FROM st WINDOW t AS (PARTITION BY timestamp)",
    "past_betas": f"""WITH {SIG}, a AS (SELECT root, timestamp, ret, avg(ret) OVER (PARTITION BY timestamp) AS market FROM st), b AS (SELECT *, CASE WHEN count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER w >= 24 THEN covar_samp(ret, market) OVER w / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN market END) OVER w, 0) END AS raw
        FROM a WINDOW w AS ({W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) SELECT root, timestamp, {_R('ret')}, {_R('market')}, round(CASE WHEN raw IS NULL THEN 1.0 ELSE least(greatest(raw, 0.2), 2.5) END, 6) + 0.0 AS beta FROM b""",
    "trailing_thresholds": f"""WITH {SIG}, {_REG}, x AS (SELECT regime, volume, timestamp::DATE - DATE '2024-01-01' AS dd FROM rg), p AS (SELECT unnest(range(1, 8))::INT AS period), y AS (SELECT * FROM x JOIN p ON dd < period * 7 AND dd >= period * 7 - 14),
        o AS (SELECT period, regime, count(*) AS n, quantile_cont(volume, 0.8) AS q FROM y GROUP BY ALL), a AS (SELECT period, count(*) AS n, quantile_cont(volume, 0.8) AS q FROM y GROUP BY ALL)
        SELECT o.period, o.regime, round(CASE WHEN o.n >= 60 THEN o.q WHEN a.n >= 100 THEN a.q END, 6) + 0.0 AS threshold FROM o JOIN a ON a.period = o.period""",
    "day_shift_null": f"""WITH {SIG}, b AS (SELECT root, direction, outcome, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM sg WHERE outcome IS NOT NULL), t AS (SELECT *, unnest(range(30)) AS draw FROM b WHERE direction <> 0),
        m AS (SELECT root, draw, direction, (i + (1 + floor({_U("'11'", "'day'", 'draw')} * (greatest(n // 24, 1) - 1))::BIGINT) * 24) % n AS j FROM t)
        SELECT draw::INT AS draw, round(avg(m.direction * b.outcome), 6) + 0.0 AS mean, count(*) AS n FROM m JOIN b ON b.root = m.root AND b.i = m.j GROUP BY draw""",
    "stratified_null": f"""WITH {SIG}, b AS (SELECT root, (day(timestamp) - 1) // 7 AS week, session_phase, direction, outcome, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY root, (day(timestamp) - 1) // 7, session_phase) AS n FROM sg WHERE outcome IS NOT NULL
            WINDOW s AS (PARTITION BY root, (day(timestamp) - 1) // 7, session_phase ORDER BY root, timestamp)), t AS (SELECT *, unnest(range(20)) AS draw FROM b WHERE direction <> 0),
        m AS (SELECT root, week, session_phase, draw, direction, floor({_U("'11'", 'root', 'week', 'session_phase', 'i', 'draw')} * n)::BIGINT AS j FROM t)
        SELECT draw::INT AS draw, round(avg(m.direction * b.outcome), 6) + 0.0 AS mean, count(*) AS n FROM m JOIN b ON b.root = m.root AND b.week = m.week AND b.session_phase = m.session_phase AND b.i = m.j GROUP BY draw""",
    "attributions": f"""WITH {SIG}, x AS (SELECT root, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, session_phase, (day(timestamp) - 1) // 7 AS week, direction * raw AS pnl FROM sg WHERE direction <> 0 AND raw IS NOT NULL)
        SELECT CASE WHEN grouping(root) = 0 AND grouping(side) = 0 THEN 'rootxside' WHEN grouping(root) = 0 THEN 'root' WHEN grouping(side) = 0 THEN 'side' WHEN grouping(week) = 0 THEN 'week' ELSE 'session_phase' END AS report, root, side, session_phase, week,
               count(*) AS n, round(sum(pnl), 6) + 0.0 AS pnl, round(avg((pnl > 0)::INT), 6) + 0.0 AS hit FROM x GROUP BY GROUPING SETS ((root), (side), (session_phase), (week), (root, side))""",
    "parameter_surface": f"WITH {SIG}, z AS ({_SURF}), g AS (SELECT *, unnest([-0.5, -0.25, 0.0])::DOUBLE AS width FROM z) SELECT lookback, width, count(*) AS n, round(avg(outcome), 6) + 0.0 AS mean_z FROM g WHERE z > width GROUP BY ALL",
    "dual_snapshots": f"""WITH {BARS}, c AS (SELECT root, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS t4, last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY ALL), f AS (SELECT root, timestamp + INTERVAL 1 HOUR AS available_at, close, row_number() OVER ({W}) - 1 AS i FROM bars)
        SELECT f.root, f.available_at, f.close AS close_fine, c.close AS close_coarse FROM f LEFT JOIN c ON c.root = f.root AND c.t4 + INTERVAL 4 HOUR = f.available_at WHERE i % 4 = 3""",
    "state_medoids": f"""WITH {_DI}, r AS (SELECT vec_id, id, d FROM di QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), id) = 1)
        SELECT id AS state, count(*) AS members, first(vec_id ORDER BY d, vec_id) AS vec_id, round(min(d), 5) + 0.0 AS distance FROM r GROUP BY id""",
    "ranked_scores": f"WITH {_LB} SELECT root, round(avg({_RPS}), 6) + 0.0 AS rps, count(*) AS n FROM lb GROUP BY root",
    "feature_audit": f"WITH {_LB}, au AS (SELECT *, move * 2 + 0.001 AS twin FROM co) {_REDUNDANT}",
}
_SIDE = {"ll": "NOT late AND v <= threshold", "lr": "NOT late AND v > threshold", "vl": "late AND v <= threshold", "vr": "late AND v > threshold"}
_SUMS = ", ".join(f"count(*) FILTER ({c}) AS n_{k}, coalesce(sum(y) FILTER ({c}), 0) AS s_{k}, count(DISTINCT dd) FILTER ({c}) AS d_{k}" for k, c in _SIDE.items())
_SAVED = " + ".join(f"2 * s_v{k} * (m{k} - m) - n_v{k} * (m{k} * m{k} - m * m)" for k in "lr")
SQL["certified_stumps"] = f"""WITH {_LB}, x AS (SELECT state, (timestamp::DATE - DATE '2024-01-01')::INT AS dd, {', '.join(COORDS)}, q_later - q_now AS y FROM lb WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COORDS)}),
    cu AS (SELECT state, quantile_cont(dd::DOUBLE, 2 / 3.0) AS cut FROM x GROUP BY state), lg AS ({' UNION ALL '.join(f"SELECT state, dd, dd >= cut AS late, y, '{c}' AS feature, {c} AS v FROM x JOIN cu USING (state)" for c in COORDS)}),
    gq AS (SELECT state, feature, quantile_cont(v, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS q FROM lg WHERE NOT late GROUP BY ALL), gr AS (SELECT DISTINCT state, feature, unnest(q) AS threshold FROM gq),
    s AS (SELECT state, feature, threshold, {_SUMS} FROM lg JOIN gr USING (state, feature) GROUP BY ALL), t AS (SELECT *, s_ll / nullif(n_ll, 0) AS ml, s_lr / nullif(n_lr, 0) AS mr, (s_ll + s_lr) / nullif(n_ll + n_lr, 0) AS m FROM s),
    u AS (SELECT *, n_ll * ml * ml + n_lr * mr * mr - (n_ll + n_lr) * m * m AS fit, {_SAVED} AS gain FROM t)
    SELECT state, feature, round(threshold, 6) + 0.0 AS threshold, round(gain, 6) + 0.0 AS gain FROM (SELECT * FROM u WHERE least(d_ll, d_lr) >= 3 AND fit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY state ORDER BY fit DESC, feature, threshold) = 1) WHERE gain > 0"""
_AHEAD = lambda agg, v, a, b: f"CASE WHEN count({v}) OVER ({W} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING) = {b - a + 1} THEN {agg}({v}) OVER ({W} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING) END"
_5 = lambda e, n: f"round(least(greatest({e}, -5), 5), 5) + 0.0 AS {n}"
SQL["outcome_signature"] = f"""WITH {SIG}, a AS (SELECT root, timestamp, ln(close) AS lc, sigma_hat ** 2 * 24 AS rv, 0.5 + hour(timestamp) / 24.0 AS beta, ln(lead(close) OVER ({W}) / close) AS r FROM st WHERE sigma_hat IS NOT NULL),
    b AS (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(r, 0) ** 2 END AS u, CASE WHEN r IS NOT NULL THEN least(r, 0) ** 2 END AS n FROM a), c AS (SELECT *, {', '.join(f"{_AHEAD('sum', v, 0, h - 1)} AS {v}{h}" for h in (4, 12) for v in ('r', 'u', 'n'))}, {_AHEAD('max', 'lc', 1, 12)} - lc AS top, {_AHEAD('min', 'lc', 1, 12)} - lc AS low FROM b),
    e AS (SELECT *, {', '.join(f'avg(r{h}) OVER (PARTITION BY timestamp) AS m{h}, sqrt(greatest(rv * {h} / 24, 1e-9)) AS s{h}' for h in (4, 12))} FROM c)
    SELECT root, timestamp, {', '.join(f"CASE WHEN r{h} IS NOT NULL THEN {_5(f'(r{h} - beta * m{h}) / s{h}', f'alpha_{h}').rsplit(' AS ', 1)[0]} END AS alpha_{h}, round((u{h} - n{h}) / (u{h} + n{h} + 1e-12), 5) + 0.0 AS balance_{h}, CASE WHEN u{h} IS NOT NULL THEN {_5(f'ln((u{h} + n{h} + 1e-10) / (rv * {h} / 24 + 1e-10))', 'v').rsplit(' AS ', 1)[0]} END AS variance_ratio_{h}" for h in (4, 12))},
           CASE WHEN top IS NOT NULL THEN {_5('top / s12', 'b').rsplit(' AS ', 1)[0]} END AS best, CASE WHEN low IS NOT NULL THEN {_5('low / s12', 'w').rsplit(' AS ', 1)[0]} END AS worst FROM e"""
SQL["shrunk_correlations"] = f"""WITH {BARS}, dr AS (SELECT session_id AS day, root, ln(last(close ORDER BY timestamp) / first(open ORDER BY timestamp)) AS v FROM bars GROUP BY ALL), dx AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM dr)),
    ok AS (SELECT day, i FROM dx JOIN dr USING (day) WHERE v IS NOT NULL GROUP BY day, i HAVING count(*) = 5), aw AS (SELECT n.day, n.i AS now, o.i, o.day AS past, pow(0.5, (n.i - o.i) / 8.0) AS e FROM dx n JOIN ok o ON o.i BETWEEN n.i - 20 AND n.i - 1),
    wt AS (SELECT *, e / sum(e) OVER (PARTITION BY now) AS w, count(*) OVER (PARTITION BY now) AS k FROM aw), cv AS (SELECT wt.day, now, i, w, root, v - sum(w * v) OVER (PARTITION BY now, root) AS c FROM wt JOIN dr ON dr.day = past WHERE k >= 5),
    pr AS (SELECT a.day, a.now, a.i, a.w, a.root AS a, b.root AS b, a.c * b.c AS p FROM cv a JOIN cv b ON a.now = b.now AND a.i = b.i), sm AS (SELECT *, sum(w * p) OVER (PARTITION BY now, a, b) AS s FROM pr),
    st AS (SELECT day, now, a, b, any_value(s) AS s FROM sm GROUP BY ALL), mu AS (SELECT now, sum(s) FILTER (a = b) / 5 AS mu FROM st GROUP BY now), d2 AS (SELECT now, any_value(mu) AS mu, sum((s - CASE WHEN a = b THEN mu ELSE 0 END) ** 2) / 5 AS d2 FROM st JOIN mu USING (now) GROUP BY now),
    b2 AS (SELECT now, sum(w ** 2 * (p - s) ** 2) / 5 AS b2 FROM sm GROUP BY now), sh AS (SELECT day, now, a, b, CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 1 END * CASE WHEN a = b THEN mu ELSE 0 END + CASE WHEN d2 > 0 THEN (1 - least(b2, d2) / d2) * s ELSE 0 END AS s FROM st JOIN d2 USING (now) JOIN b2 USING (now))
    SELECT x.day::VARCHAR AS day, x.a, x.b, round(x.s / sqrt(p.s * q.s), 6) + 0.0 AS corr FROM sh x JOIN sh p ON p.now = x.now AND p.a = x.a AND p.b = x.a JOIN sh q ON q.now = x.now AND q.a = x.b AND q.b = x.b"""
SQL["shuffled_backtests"] = f"""WITH RECURSIVE {SIG}, nb AS (SELECT *, direction * magnitude AS t0, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM sg), dw AS (SELECT *, unnest(range(5)) AS draw FROM nb),
    mv AS (SELECT a.root || '#' || a.draw AS root, a.timestamp, a.session_id, a.local_symbol, a.ret, a.is_valid, a.bar_in_session, a.volume, a.wap, a.close, b.t0 AS target FROM dw a JOIN nb b ON b.root = a.root AND b.i = (a.i + floor({_U(f"'{SEED}'", 'a.root', 'a.draw')} * a.n)::BIGINT) % a.n),
    {backtest_ctes('mv')} SELECT split_part(root, '#', 2)::INT AS draw, round(sum(gross_return - cost), 6) + 0.0 AS net, round(sum(turnover), 6) + 0.0 AS turnover FROM bt GROUP BY ALL"""
_ALL = (
    path_labels, regimes, market_residuals, past_betas, trailing_thresholds, day_shift_null, stratified_null, attributions, parameter_surface, dual_snapshots, state_medoids, ranked_scores, feature_audit, outcome_signature, shrunk_correlations,
    certified_stumps, whitening, shuffled_backtests,
)
QUERIES = {f.__name__: f for f in _ALL}
