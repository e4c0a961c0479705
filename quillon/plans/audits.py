"""Audits of policies and of the number of states, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillon.operators import audits as A
from quillon.operators import pathstates as S
from quillon.operators import policies as P
from quillon.operators.states import memberships
from quillon.plans.market import rnd
from quillon.plans.pathstates import _BIN, _RE, TEMPERATURE, X1_CENTRES, memberships_of
from quillon.plans.policies import SQL as POLICY_SQL
from quillon.plans.policies import _scores, positions_hysteretic
from quillon.plans.selection import _DAYS
from quillon.plans.sql import BARS
from quillon.plans.state import state
from quillon.sources.lineage import cut

SEED = 11


def holding_survival(spark, d):
    return rnd(A.survival(A.spells(positions_hysteretic(spark, d)), ["root"]), ["survival"])


def same_entries(spark, d):
    names = ["own_exit", "fixed_exit", "opposite_side", "mean_bars"]
    return rnd(A.same_entries(A.spells(positions_hysteretic(spark, d)), state(spark, d), 16), names)


def gap_bins(spark, d):
    """Times by the gap between the highest and the lowest score: how often a pair is held then, and what the best pair promises."""
    x = _scores(spark, d)
    gap = x.groupBy("timestamp").agg((F.max("score") - F.min("score")).alias("gap"))
    held = P.pair_policy(x, 1.0, 0.2, 2, 24, 0.5).select("timestamp").distinct().withColumn("held", F.lit(1.0))
    from quillon.operators.portfolio import best_pairs

    best = best_pairs(x).select("timestamp", "pair_score")
    y = gap.join(held, "timestamp", "left").join(best, "timestamp", "left")
    return rnd(A.gap_bins(y, "gap", {"held_share": F.coalesce("held", F.lit(0.0)), "mean_best": F.col("pair_score")}, ["timestamp"]), ["mean_gap", "held_share", "mean_best"])


def state_resolution(spark, d):
    """Log loss of 1, 2 and 3 soft states from the fifteenth to the twentieth, fitted on the days before."""
    base = cut(memberships_of(spark, d).where(F.col("y").isNotNull() & (F.dayofmonth("timestamp") <= 20)).select("root", "timestamp", "y", "x"))
    fit, parts = F.dayofmonth("timestamp") <= 14, []
    for k in (1, 2, 3):
        member = memberships(base, spark.createDataFrame(X1_CENTRES[:k], "id int, centre array<double>"), "x", TEMPERATURE)
        member = cut(member)
        weights = member.where(fit).select("root", "timestamp", F.posexplode("weights").alias("region", "weight"))
        general, local = S.region_tables(weights, member.where(fit).select("root", "timestamp", F.col("y").alias("label")), ["root", "timestamp"], 5, 50.0, 30.0)
        p = S.region_forecasts(member.where(~fit), ["root", "timestamp"], general, local)
        hit = p.join(member.where(~fit).select("root", "timestamp", F.col("y").alias("label")), ["root", "timestamp", "label"])
        parts.append(hit.select(F.lit(k).alias("k"), F.to_date("timestamp").alias("day"), (-F.ln(F.greatest("probability", F.lit(1e-8)))).alias("loss")))
    return rnd(A.smallest_within(reduce(lambda a, b: a.unionByName(b), parts), 2, 200, SEED), ["loss", "difference", "low", "high"])


_HELD = f"po AS ({POLICY_SQL['positions_hysteretic']}), pr AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY timestamp) - row_number() OVER (PARTITION BY root, position ORDER BY timestamp) AS g FROM po), " \
    "sp AS (SELECT root, position AS side, g, count(*) AS bars, min(timestamp) AS opened, max(timestamp) AS closed FROM pr WHERE position <> 0 GROUP BY ALL), la AS (SELECT root, max(timestamp) AS last FROM po GROUP BY root), hs AS (SELECT sp.*, closed = last AS censored FROM sp JOIN la USING (root))"  # fmt: skip


#: The pair policy's tables up to its recursion: v (scores), tt (times with the best pair).
_PAIRS = POLICY_SQL["pair_policy"].split("h AS (SELECT -1")[0].rstrip().rstrip(",").replace("WITH RECURSIVE", "WITH")


def _loss(k: int) -> str:
    """Daily losses of k states, as ls{k}."""
    c, n = X1_CENTRES[:k], str(k)
    return f"""ka{n} AS (SELECT root, timestamp, y, (unnest(range({k})))::INT AS region, unnest(list_transform(ds{n}, lambda v: exp(-(v - list_min(ds{n})) / {TEMPERATURE}))) AS e FROM (SELECT *, [{', '.join(f'list_distance(x1, {v}::DOUBLE[])' for _, v in c)}] AS ds{n} FROM fm)),
        kw{n} AS (SELECT *, e / sum(e) OVER (PARTITION BY root, timestamp) AS w FROM ka{n}), ks{n} AS (SELECT * FROM kw{n} WHERE day(timestamp) <= 14),
        kb{n} AS (SELECT label, (count(region) + 1) / ((SELECT count(*) FROM ks{n} WHERE region = 0) + 5) AS p FROM lg LEFT JOIN ks{n} ON y = label AND region = 0 GROUP BY label),
        kg{n} AS (SELECT t.region, b.label, (coalesce(q.w, 0) + 50 * b.p) / (t.w + 50) AS p FROM (SELECT region, sum(w) AS w FROM ks{n} GROUP BY region) t CROSS JOIN kb{n} b LEFT JOIN (SELECT region, y, sum(w) AS w FROM ks{n} GROUP BY ALL) q ON q.region = t.region AND q.y = b.label),
        kl{n} AS (SELECT t.root, t.region, g.label, (coalesce(q.w, 0) + 30 * g.p) / (t.w + 30) AS p FROM (SELECT root, region, sum(w) AS w FROM ks{n} GROUP BY ALL) t JOIN kg{n} g USING (region) LEFT JOIN (SELECT root, region, y, sum(w) AS w FROM ks{n} GROUP BY ALL) q ON q.root = t.root AND q.region = t.region AND q.y = g.label),
        kp{n} AS (SELECT w.root, w.timestamp, sum(w.w * l.p) AS p FROM kw{n} w JOIN kl{n} l ON l.root = w.root AND l.region = w.region AND l.label = w.y WHERE day(timestamp) > 14 GROUP BY ALL), ls{n} AS (SELECT {k} AS k, timestamp::DATE AS day, avg(-ln(greatest(p, 1e-8))) AS l FROM kp{n} GROUP BY ALL)"""


SQL = {
    "holding_survival": f"""WITH {_HELD}, ag AS (SELECT root, bars AS age, count(*) AS n, count(*) FILTER (NOT censored) AS ended FROM hs GROUP BY ALL), ar AS (SELECT *, sum(n) OVER (PARTITION BY root ORDER BY age DESC) AS at_risk FROM ag),
        sv AS (SELECT *, product(1 - ended / at_risk) OVER (PARTITION BY root ORDER BY age) AS s FROM ar) SELECT root, age, at_risk::BIGINT AS at_risk, ended, round(s, 6) + 0.0 AS survival FROM sv WHERE ended > 0""",
    "same_entries": f"""WITH {_HELD}, {BARS}, pq AS (SELECT root, timestamp, ln(close) AS lc, lead(ln(close)) OVER w AS nx, lead(ln(close), 16) OVER w AS fa FROM bars WINDOW w AS (PARTITION BY root ORDER BY timestamp)),
        en AS (SELECT hs.root, bars, side * (b.nx - a.lc) AS own, side * (a.fa - a.lc) AS fx FROM hs JOIN pq a ON a.root = hs.root AND a.timestamp = opened JOIN pq b ON b.root = hs.root AND b.timestamp = closed WHERE b.nx IS NOT NULL AND a.fa IS NOT NULL)
        SELECT root, count(*) AS entries, round(avg(own), 6) + 0.0 AS own_exit, round(avg(fx), 6) + 0.0 AS fixed_exit, round(avg(-own), 6) + 0.0 AS opposite_side, round(avg(bars), 6) + 0.0 AS mean_bars FROM en GROUP BY root""",
    "gap_bins": f"""WITH sc AS (SELECT * FROM ({_PAIRS} SELECT timestamp, max(score) - min(score) AS gap FROM v GROUP BY timestamp)), he AS (SELECT DISTINCT timestamp FROM ({POLICY_SQL['pair_policy']})),
        bp AS (SELECT * FROM ({_PAIRS} SELECT timestamp, b.w AS best FROM tt)), rk AS (SELECT sc.*, row_number() OVER (ORDER BY gap, timestamp) AS r, count(*) OVER () AS c FROM sc)
        SELECT (greatest(((r - 1) * 5 + c - 2) // greatest(c - 1, 1) - 1, 0) + 1)::INT AS bin, count(*) AS rows, round(avg(gap), 6) + 0.0 AS mean_gap, round(avg((he.timestamp IS NOT NULL)::INT), 6) + 0.0 AS held_share, round(avg(best), 6) + 0.0 AS mean_best
        FROM rk LEFT JOIN he USING (timestamp) LEFT JOIN bp USING (timestamp) GROUP BY bin""",
    "state_resolution": f"""WITH {_RE}, fm AS (SELECT root, timestamp, x1, {_BIN('(q_later - q_now) / sqrt(greatest(sigma_hat ** 2 * 4, 1e-10))')} AS y FROM re WHERE q_later IS NOT NULL AND sigma_hat IS NOT NULL AND day(timestamp) <= 20), lg AS (SELECT unnest(range(5))::INT AS label),
        {', '.join(map(_loss, (1, 2, 3)))}, al AS ({' UNION ALL '.join(f'FROM ls{k}' for k in (1, 2, 3))}), me AS (SELECT k, avg(l) AS loss FROM al GROUP BY k), be AS (SELECT k AS bk, loss AS bl FROM me ORDER BY round(loss, 12), k LIMIT 1),
        da AS (SELECT DISTINCT day FROM al), {_DAYS(200).replace('// 7', '// 2').replace('% 7', '% 2')}, di AS (SELECT a.k, a.day, a.l - b.l AS d FROM al a JOIN be ON true JOIN al b ON b.k = bk AND b.day = a.day),
        dm AS (SELECT k, draw, avg(d) AS m FROM pk JOIN nd USING (i) JOIN di USING (day) GROUP BY ALL), iv AS (SELECT k, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM dm GROUP BY k)
        SELECT me.k, round(loss, 6) + 0.0 AS loss, round(loss - bl, 6) + 0.0 AS difference, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, me.k = bk AS best, me.k = (SELECT min(k) FROM iv WHERE low <= 0) AS chosen FROM me JOIN iv USING (k) JOIN be ON true""",
}
QUERIES = {f.__name__: f for f in (holding_survival, same_entries, gap_bins, state_resolution)}
