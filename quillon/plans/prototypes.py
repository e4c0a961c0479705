"""Quantile maps, prototypes, states and models as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.scalars import log
from quillon.functions.windows import Bars
from quillon.operators import prototypes as Q
from quillon.operators import states as S
from quillon.plans.market import rnd
from quillon.plans.sql import W, strict
from quillon.plans.state import STATE, state

COORDS = ["move", "activity", "trend"]
SEED = {"move": 0.9, "activity": 0.8, "trend": 0.7}
EDGES = [-1.0, -0.3, 0.3, 1.0]


def coordinates(spark, d):
    w = Bars("root", "timestamp")
    return state(spark, d).select("root", "timestamp", log(F.col("close") / F.col("open")).alias("move"), F.log1p("volume").alias("activity"), w.sum(F.col("ret"), 6).alias("trend"), F.col("sigma_hat"), w.lag(log(F.col("close")), -4).alias("q_later"), log(F.col("close")).alias("q_now"))


def shares(spark, d):
    x = coordinates(spark, d)
    return Q.mapped(x, Q.quantile_knots(x, COORDS, 21), COORDS)


def quantile_map(spark, d):
    return rnd(shares(spark, d).select("root", "timestamp", *COORDS), COORDS)


def prototype_similarity(spark, d):
    x = shares(spark, d).select("root", "timestamp", Q.similarity({"move": (0.8, 0.1, 1.0), "activity": (0.5, 0.2, 0.5), "trend": (0.6, 0.15, 1.5)}).alias("similarity"))
    return rnd(x, ["similarity"])


def mid_rank_map(spark, d):
    return rnd(Q.mid_rank(coordinates(spark, d).select("root", "timestamp", "trend"), ["root"], "trend", "share").select("root", "timestamp", "share", "share_missing"), ["share"])


def anchors(spark, d):
    return rnd(Q.anchors(shares(spark, d), SEED, 0.05, 50).select("root", "timestamp", "score"), ["score"])


def fitted_prototype(spark, d):
    return rnd(Q.fit_prototype(Q.anchors(shares(spark, d), SEED, 0.05, 50), COORDS), ["centre", "width"])


def weighted_prototype(spark, d):
    mixed = shares(spark, d).withColumn("mix", (2 * F.col("move") + F.col("trend")) / 3)
    out = Q.weighted_prototype(Q.anchors(mixed, SEED, 0.05, 50), mixed, {"path": ["move", "trend", "mix"], "flow": ["activity"]})
    return rnd(out, ["centre", "width", "contrast", "redundancy"])


def prototype_match(spark, d):
    c, width = {"move": 0.8, "activity": 0.6, "trend": 0.7}, {"move": 0.2, "activity": 0.3, "trend": 0.25}
    x = Q.group_distance(shares(spark, d), {"path": ["move", "trend"], "flow": ["activity"]}, c, width, {"path": 2.0, "flow": 1.0})
    return rnd(x.select("root", "timestamp", "loss_path", "loss_flow", "match"), ["loss_path", "loss_flow", "match"])


def _e(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def cosine_to_centre(spark, d):
    e = _e(spark, d)
    x = e.join(F.broadcast(S.centres_of(e, "label", "embedding")), F.col("label") == F.col("id"))
    return rnd(x.select("vec_id", Q.cosine(F.col("embedding"), F.col("centre")).alias("cosine")), ["cosine"], 5)


def _member(spark, d):
    e = _e(spark, d).select("vec_id", "embedding", "label")
    return S.memberships(e, S.centres_of(e, "label", "embedding"), "embedding", 0.5)


def state_assignment(spark, d):
    return rnd(_member(spark, d).select("vec_id", "state", "distance", "margin"), ["distance", "margin"], 5)


def soft_membership(spark, d):
    x = _member(spark, d).select("vec_id", F.posexplode("weights").alias("i", "weight"))
    return rnd(x, ["weight"], 5)


def _labelled(spark, d):
    x = coordinates(spark, d).where("q_later IS NOT NULL AND sigma_hat IS NOT NULL")
    y = S.outcome_label(F.col("q_later") - F.col("q_now"), F.pow("sigma_hat", F.lit(2)) * 4, EDGES)
    return x.withColumns({"y": y, "state": F.when(F.col("move") > 0, 1).otherwise(0) + 2 * (F.hour("timestamp") % 3)})


def state_distributions(spark, d):
    return rnd(S.distributions(_labelled(spark, d), "state", "y", 5, 20.0), ["probability"])


def soft_forecast(spark, d):
    table = S.distributions(_e(spark, d).withColumn("y", F.col("vec_id").cast("int") % 3), "label", "y", 3, 5.0)
    return rnd(S.soft_predict(_member(spark, d), "vec_id", "weights", table, list(range(10))), ["probability"], 5)


def ridge_regression(spark, d):
    x = coordinates(spark, d).withColumn("target", F.col("q_later") - F.col("q_now"))
    return rnd(S.ridge(x, ["move", "activity"], "target", 10.0, ["root"]), ["coefficient"])


def walk_forward_ridge(spark, d):
    x = coordinates(spark, d).withColumn("target", F.col("q_later") - F.col("q_now")).dropna(subset=["target", "trend", "move"])
    out = S.walk_forward_ridge(x, ["move", "trend"], "target", "timestamp", 12, 6, 10.0)
    return rnd(S.r_squared(out, ["fold"], "target", "prediction", "train_mean"), ["r2"], 5)


def kmeans_states(spark, d):
    e = _e(spark, d).select("vec_id", "embedding")
    return S.memberships(e, S.fit_centres(e, "embedding", 8), "embedding", 0.5).select("vec_id", "state", "distance")


def _split(spark, d):
    x = _labelled(spark, d).dropna(subset=["trend", "move"])
    early = F.dayofmonth("timestamp") <= 20
    return x.where(early), x.where(~early)


def forest_heads(spark, d):
    train, test = _split(spark, d)
    return S.tree_heads(train, test, COORDS, "y").select("root", "timestamp", "y", "prediction", "probability")


def boosted_regression(spark, d):
    train, test = (x.withColumn("target", F.col("q_later") - F.col("q_now")) for x in _split(spark, d))
    return S.tree_heads(train, test, COORDS, "target", "boost").select("root", "timestamp", "target", "prediction")


def isotonic_gate(spark, d):
    x = _labelled(spark, d)
    curve = S.isotonic_curve(x.select(F.col("activity").alias("x"), (F.col("q_later") - F.col("q_now")).alias("r")), "x", "r")
    return rnd(curve.select("bin", "mean_x", "mean_y", "n", "isotonic"), ["mean_x", "mean_y", "isotonic"])


_CO = f"""{STATE}, co AS (SELECT root, timestamp, ln(close / open) AS move, ln(1 + volume) AS activity, {strict('sum', 'ret', 6)} AS trend, sigma_hat, lead(ln(close), 4) OVER ({W}) AS q_later, ln(close) AS q_now FROM st)"""
_KN = "kn AS (SELECT " + ", ".join(f"quantile_cont({c}, [{', '.join(str(i / 20) for i in range(21))}]) AS k_{c}" for c in COORDS) + " FROM co)"


def _ip(c: str) -> str:
    k = f"k_{c}"
    b = f"len(list_filter({k}, lambda v: v < {c}))"
    low, high = f"{k}[greatest({b}, 1)]", f"{k}[least({b} + 1, 21)]"
    first = f"(list_position({k}, {low}) - 1)"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= {k}[1] THEN 0.0 WHEN {c} > {k}[21] THEN 1.0 WHEN {c} = {high} THEN (list_position({k}, {high}) - 1) / 20.0 ELSE ({first} + ({c} - {low}) / nullif({high} - {low}, 0) * ({b} - {first})) / 20.0 END"


_SH = f"{_CO}, {_KN}, sh AS (SELECT root, timestamp, {', '.join(f'{_ip(c)} AS {c}' for c in COORDS)} FROM co, kn)"
_SIM = " + ".join(f"{w} * ((greatest(abs({c} - {m}) - {h}, 0) / 0.2) ** 2 + 0.02 * (abs({c} - {m}) / {h}) ** 2)" for c, m, h, w in (("move", 0.8, 0.1, 1.0), ("activity", 0.5, 0.2, 0.5), ("trend", 0.6, 0.15, 1.5)))
_SCORE = "-((move - 0.9) ** 2 + (activity - 0.8) ** 2 + (trend - 0.7) ** 2) / 3"
_AN = f"an AS (SELECT *, {_SCORE} AS score FROM sh WHERE {_SCORE} IS NOT NULL ORDER BY score DESC, root, timestamp LIMIT (SELECT greatest(50, (count(*) * 0.05)::DOUBLE // 1)::BIGINT FROM sh))"
_CE = "ce AS (SELECT id, list(v ORDER BY i) AS c FROM (SELECT label AS id, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY id)"
_DI = f"{_CE}, di AS (SELECT vec_id, id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]) ** 2))) AS d FROM embeddings, ce)"
_WE = f"{_DI}, we AS (SELECT vec_id, id, exp(-(d - min(d) OVER p) / 0.5) / sum(exp(-(d - m) / 0.5)) OVER p AS w FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS m FROM di) WINDOW p AS (PARTITION BY vec_id))"
_LB = f"""{_CO}, lb AS (SELECT *, (z >= -1)::INT + (z >= -0.3)::INT + (z >= 0.3)::INT + (z >= 1)::INT AS y, (CASE WHEN move > 0 THEN 1 ELSE 0 END + 2 * (hour(timestamp) % 3))::INT AS state
        FROM (SELECT *, (q_later - q_now) / sqrt(greatest(sigma_hat ** 2 * 4, 1e-10)) AS z FROM co WHERE q_later IS NOT NULL AND sigma_hat IS NOT NULL))"""
SQL = {
    "quantile_map": f"WITH {_SH} SELECT root, timestamp, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in COORDS)} FROM sh",
    "prototype_similarity": f"WITH {_SH} SELECT root, timestamp, round(CASE WHEN move IS NOT NULL AND activity IS NOT NULL AND trend IS NOT NULL THEN exp(-({_SIM}) / 3) END, 6) + 0.0 AS similarity FROM sh",
    "mid_rank_map": f"""WITH {_CO} SELECT root, timestamp, round(CASE WHEN trend IS NOT NULL THEN (rank() OVER (PARTITION BY root ORDER BY trend NULLS LAST) - 1 + count(*) OVER (PARTITION BY root, trend) / 2) / count(trend) OVER (PARTITION BY root) ELSE 0.5 END, 6) + 0.0 AS share,
        trend IS NULL AS share_missing FROM co""",
    "anchors": f"WITH {_SH}, {_AN} SELECT root, timestamp, round(score, 6) + 0.0 AS score FROM an",
    "fitted_prototype": f"WITH {_SH}, {_AN} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(quantile_cont({c}, 0.5), 6) + 0.0 AS centre, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) + 0.0 AS width FROM an" for c in COORDS),
    "weighted_prototype": f"WITH {_SH}, {_AN}, am AS (SELECT *, (2 * move + trend) / 3 AS mix FROM an), sm AS (SELECT coalesce(move, 0.5) AS move, coalesce(trend, 0.5) AS trend, coalesce((2 * move + trend) / 3, 0.5) AS mix FROM sh), "
    "rd AS (SELECT greatest(abs(corr(move, trend)) - 0.7, 0) AS mt, greatest(abs(corr(move, mix)) - 0.7, 0) AS mm, greatest(abs(corr(trend, mix)) - 0.7, 0) AS tm FROM sm), pc AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, '{g}' AS grp, quantile_cont({c}, 0.5) AS c, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w, 1 / (1 + {r}) AS r FROM am, rd GROUP BY mt, mm, tm" for c, g, r in (("move", "path", "mt + mm"), ("trend", "path", "mt + tm"), ("mix", "path", "mm + tm"), ("activity", "flow", "0.0")))
    + ") SELECT name, grp AS \"group\", round(c, 6) + 0.0 AS centre, round(greatest(0.07, w * 0.55), 6) + 0.0 AS width, round(0.25 + 2.5 * abs(c - 0.5), 6) + 0.0 AS contrast, round(r, 6) + 0.0 AS redundancy FROM pc",
    "prototype_match": f"""WITH {_SH}, l AS (SELECT root, timestamp, (((move - 0.8) / 0.2) ** 2 + ((trend - 0.7) / 0.25) ** 2) / 2 AS loss_path, ((activity - 0.6) / 0.3) ** 2 AS loss_flow FROM sh)
        SELECT root, timestamp, round(loss_path, 6) + 0.0 AS loss_path, round(loss_flow, 6) + 0.0 AS loss_flow, round(exp(-(2 * loss_path + loss_flow) / 3), 6) + 0.0 AS match FROM l""",
    "cosine_to_centre": f"WITH {_CE} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 5) + 0.0 AS cosine FROM embeddings JOIN ce ON id = label",
    "state_assignment": f"""WITH {_DI}, r AS (SELECT vec_id, list({{'d': d, 'id': id}} ORDER BY round(d, 9), id) AS x FROM di GROUP BY vec_id) SELECT vec_id, x[1].id AS state, round(x[1].d, 5) + 0.0 AS distance, round(x[2].d - x[1].d, 5) + 0.0 AS margin FROM r""",
    "soft_membership": f"WITH {_WE} SELECT vec_id, id AS i, round(w, 5) + 0.0 AS weight FROM we",
    "state_distributions": f"""WITH {_LB}, g AS (SELECT unnest(range(5))::INT AS label), pr AS (SELECT label, (count(y) + 1) / (sum(count(y)) OVER () + 5) AS prior FROM g LEFT JOIN lb ON y = label GROUP BY label),
        c AS (SELECT s.state, label, prior, count(y) AS n FROM (SELECT DISTINCT state FROM lb) s CROSS JOIN pr LEFT JOIN lb ON lb.state = s.state AND y = label GROUP BY ALL)
        SELECT state, label, round((n + 20 * prior) / (sum(n) OVER (PARTITION BY state) + 20), 6) + 0.0 AS probability FROM c""",
    "soft_forecast": f"""WITH {_WE}, e AS (SELECT label AS state, (vec_id % 3)::INT AS y FROM embeddings), g AS (SELECT unnest(range(3))::INT AS label), pr AS (SELECT label, (count(y) + 1) / (sum(count(y)) OVER () + 3) AS prior FROM g LEFT JOIN e ON y = label GROUP BY label),
        c AS (SELECT s.state, label, prior, count(y) AS n FROM (SELECT DISTINCT state FROM e) s CROSS JOIN pr LEFT JOIN e ON e.state = s.state AND y = label GROUP BY ALL), t AS (SELECT state, label, (n + 5 * prior) / (sum(n) OVER (PARTITION BY state) + 5) AS p FROM c)
        SELECT vec_id, label, round(sum(w * p), 5) + 0.0 AS probability FROM we JOIN t ON t.state = we.id GROUP BY ALL""",
    "isotonic_gate": f"""WITH {_LB}, r AS (SELECT activity AS x, q_later - q_now AS y, row_number() OVER (ORDER BY activity, q_later - q_now) AS r, count(*) OVER () AS c FROM lb WHERE activity IS NOT NULL),
        b AS (SELECT greatest(((r - 1) * 10 + c - 2) // greatest(c - 1, 1) - 1, 0)::INT AS bin, avg(x) AS mean_x, avg(y) AS mean_y, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
        m AS (SELECT p.bin AS a, q.bin AS z, sum(s.mean_y * s.n) / sum(s.n) AS m FROM b p JOIN b q ON q.bin >= p.bin JOIN b s ON s.bin BETWEEN p.bin AND q.bin GROUP BY ALL),
        f AS (SELECT bin, max(lo) AS isotonic FROM (SELECT b.bin, m.a, min(m.m) AS lo FROM b JOIN m ON m.a <= b.bin AND m.z >= b.bin GROUP BY ALL) GROUP BY bin)
        SELECT bin, round(mean_x, 6) + 0.0 AS mean_x, round(mean_y, 6) + 0.0 AS mean_y, n, round(isotonic, 6) + 0.0 AS isotonic FROM b JOIN f USING (bin)""",
    "walk_forward_ridge": f"""WITH {_CO}, x AS (SELECT timestamp, date_diff('day', (SELECT min(timestamp) FROM co WHERE q_later IS NOT NULL AND trend IS NOT NULL AND move IS NOT NULL)::DATE, timestamp::DATE) AS dd, move AS a, trend AS b, q_later - q_now AS y
            FROM co WHERE q_later IS NOT NULL AND trend IS NOT NULL AND move IS NOT NULL), sp AS (SELECT ((epoch(max(timestamp)) - epoch(min(timestamp))) // 86400)::INT AS days FROM x), fo AS (SELECT unnest(range(((days - 12) // 6 + 1)::BIGINT)) AS fold FROM sp),
        m AS (SELECT fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM fo JOIN x ON dd >= fold * 6 AND dd < fold * 6 + 12 GROUP BY fold),
        s AS (SELECT *, n + 10.0 AS p, n * ab / (sa * sb) AS q, n * ay / sa AS u, n * by_ / sb AS v FROM m), k AS (SELECT *, (p * u - q * v) / (p * p - q * q) / sa AS ka, (p * v - q * u) / (p * p - q * q) / sb AS kb FROM s),
        t AS (SELECT k.fold, y, my + ka * (a - ma) + kb * (b - mb) AS f, my FROM x JOIN k ON k.fold = (dd - 12) // 6 WHERE dd >= 12)
        SELECT fold::INT AS fold, round(1 - sum((y - f) ** 2) / nullif(sum((y - my) ** 2), 0), 5) + 0.0 AS r2, count(*) AS n FROM t GROUP BY fold""",
    "ridge_regression": f"""WITH {_CO}, x AS (SELECT root, move AS a, activity AS b, q_later - q_now AS y FROM co WHERE q_later IS NOT NULL AND move IS NOT NULL),
        m AS (SELECT root, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM x GROUP BY root),
        s AS (SELECT *, n + 10.0 AS p, n * ab / (sa * sb) AS q, n * ay / sa AS u, n * by_ / sb AS v FROM m), k AS (SELECT *, (p * u - q * v) / (p * p - q * q) / sa AS ka, (p * v - q * u) / (p * p - q * q) / sb AS kb FROM s)
        SELECT root, 'move' AS name, round(ka, 6) + 0.0 AS coefficient FROM k UNION ALL SELECT root, 'activity', round(kb, 6) + 0.0 FROM k UNION ALL SELECT root, 'intercept', round(my - ka * ma - kb * mb, 6) + 0.0 FROM k""",
}
_ALL = (
    quantile_map, prototype_similarity, mid_rank_map, anchors, fitted_prototype, weighted_prototype, prototype_match, cosine_to_centre, state_assignment, soft_membership, state_distributions, soft_forecast, ridge_regression, walk_forward_ridge, kmeans_states,
    forest_heads, boosted_regression, isotonic_gate,
)
QUERIES = {f.__name__: f for f in _ALL}
