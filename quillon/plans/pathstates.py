"""Path representations and states with confirmed splits as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.scalars import digitize
from quillon.functions.windows import Bars
from quillon.operators import pathstates as S
from quillon.operators.states import fit_centres, memberships
from quillon.plans.market import rnd
from quillon.plans.prototypes import _CO, EDGES, coordinates
from quillon.plans.sql import W, lag
from quillon.sources.lineage import cut

GROUPS = {"trend": ["move", "trend"], "flow": ["activity"], "risk": ["sigma_hat"]}
PATHS = {"trend": ["trend"], "flow": ["activity"]}
NAMES = [n for g in GROUPS.values() for n in g]
TASKS = {"y4": 5, "y12": 5, "wide": 2}
#: Given centres of the oracles' states, in the scale of x0: two of the trend, each with children by the flow.
CENTRES = [(0, [0.3, 0.3, 0.2, 0.0]), (1, [-0.3, -0.3, 0.2, 0.0]), (2, [0.0, 0.0, -0.6, 0.4])]
CHILDREN = [(0, [0.3, 0.3, 0.6, 0.0], [0.3, 0.3, -0.2, 0.0]), (1, [-0.3, -0.5, 0.2, 0.0], [-0.3, -0.1, 0.2, 0.0]), (2, [0.0, 0.0, -0.6, 0.8], [0.0, 0.0, -0.6, 0.0])]
STRENGTH, SYMBOL_STRENGTH = 20.0, 10.0
LIMITS = {"least_fit": 60, "least_later": 20, "least_gain": 0.0005, "least_days": 5}


def _seen():
    return F.dayofmonth("timestamp") <= 20


def _represented(spark, d):
    x = coordinates(spark, d)
    return S.represent(x, S.fit_maps(x, NAMES, _seen()), GROUPS, PATHS)


def reference_maps(spark, d):
    """Each instrument's points of the first twenty days."""
    x = S.fit_maps(coordinates(spark, d), NAMES, _seen()).select("root", "name", F.posexplode("table").alias("i", "q"))
    return rnd(x.select("root", "name", "i", F.col("q.v").alias("value"), F.col("q.p").alias("share")), ["value", "share"])


def path_representation(spark, d):
    x = _represented(spark, d)
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("x")) for n in ("x0", "x1", "x2")])
    x = x.select("root", "timestamp", "missing_count", F.explode(levels).alias("q")).select("root", "timestamp", "missing_count", "q.level", F.posexplode("q.x").alias("i", "value"))
    return rnd(x, ["value"], 5)


def labelled(spark, d):
    """x0 with labels of the next 4 and 12 hours; days up to 14 fit, those up to 20 judge."""
    w = Bars("root", "timestamp")
    x = _represented(spark, d).withColumn("q_far", w.lag(F.col("q_now"), -12)).where("q_later IS NOT NULL AND q_far IS NOT NULL AND sigma_hat IS NOT NULL")
    risk = lambda h: F.sqrt(F.greatest(F.pow("sigma_hat", F.lit(2.0)) * h, F.lit(1e-10)))
    near, far = F.col("q_later") - F.col("q_now"), F.col("q_far") - F.col("q_now")
    x = x.withColumns({"y4": digitize(near / risk(4), EDGES), "y12": digitize(far / risk(12), EDGES), "wide": (F.abs(near) > risk(4)).cast("int"), "day": F.to_date("timestamp"), "fit": F.dayofmonth("timestamp") <= 14})
    return x.select("root", "timestamp", "day", "fit", *TASKS, F.col("x0").alias("x"))


def _placed(spark, d):
    """All rows at the given centres, and those of the first twenty days."""
    x = memberships(labelled(spark, d), spark.createDataFrame(CENTRES, "id int, centre array<double>"), "x", 1.0).drop("margin", "weights")
    x = cut(S.with_children(x, spark.createDataFrame(CHILDREN, "state int, c0 array<double>, c1 array<double>")))
    return x, x.where(_seen())


def state_splits(spark, d):
    return rnd(S.split_evidence(_placed(spark, d)[1], TASKS, strength=STRENGTH, **LIMITS), ["gain"])


def _leaves(spark, d):
    x, seen = _placed(spark, d)
    evidence = cut(S.split_evidence(seen, TASKS, strength=STRENGTH, **LIMITS))
    return S.with_leaves(x, evidence), S.with_leaves(seen, evidence)


def leaf_tables(spark, d):
    t = S.leaf_tables(_leaves(spark, d)[1], TASKS, STRENGTH, SYMBOL_STRENGTH)
    none = F.lit(None)
    parts = [t["state"].select(F.lit("state").alias("kind"), F.col("state").alias("id"), none.cast("string").alias("root"), "task", "label", "probability"), t["leaf"].select(F.lit("leaf"), "leaf", none, "task", "label", "probability"),
             t["leaf_symbol"].select(F.lit("leaf_symbol"), "leaf", "root", "task", "label", "probability"), t["background"].select(F.lit("background"), none.cast("int"), "root", "task", "label", "probability")]
    x = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rnd(x, ["probability"])


def leaf_cards(spark, d):
    return rnd(S.leaf_cards(_leaves(spark, d)[1]), ["radius"])


def leaf_forecasts(spark, d):
    """Forecasts of the days after the twentieth."""
    x, seen = _leaves(spark, d)
    tables = {k: cut(t) for k, t in S.leaf_tables(seen, TASKS, STRENGTH, SYMBOL_STRENGTH).items()}
    out = S.predict_leaves(x.where(~_seen()), cut(S.leaf_cards(seen)), tables, ["root", "timestamp"])
    return rnd(out, ["probability"])


def fitted_states(spark, d):
    """States fitted on the first twenty days, from k-means to accepted splits: the evidence of each."""
    x = cut(labelled(spark, d).where(_seen()))
    _, evidence, _, _ = S.fit_states(x, fit_centres(x.where("fit"), "x", 3), TASKS, ["root", "timestamp"], STRENGTH, SYMBOL_STRENGTH, **LIMITS)
    return rnd(evidence, ["gain"])


X1_CENTRES = [(0, [0.3, 0.3, 0.1, 0.2, 0.0, 0.0]), (1, [-0.3, -0.3, -0.1, 0.2, 0.0, 0.0]), (2, [0.0, 0.0, 0.2, -0.4, -0.2, 0.4])]
TEMPERATURE, REGION, BY_REGION = 0.3, 50.0, 30.0


def compact_features(spark, d):
    x = S.compact_features(_represented(spark, d).withColumn("variance", F.pow("sigma_hat", F.lit(2.0))), GROUPS, PATHS, "variance")
    return rnd(x.select("root", "timestamp", *COMPACT), COMPACT, 5)


COMPACT = [f"{g}_{k}" for g in GROUPS for k in ("current", "change_far", "change_near") if k == "current" or g in PATHS] + [f"market_{g}" for g in GROUPS] + [f"clock_{n}_{k}" for n in ("hour", "week") for k in ("sin", "cos")] + ["log_past_variance"]


def memberships_of(spark, d):
    """Memberships of all bars in the given states of x1, with the label y of the next four hours."""
    w = Bars("root", "timestamp")
    x = _represented(spark, d).withColumn("y", digitize((F.col("q_later") - F.col("q_now")) / F.sqrt(F.greatest(F.pow("sigma_hat", F.lit(2.0)) * 4, F.lit(1e-10))), EDGES))
    x = x.withColumn("y", F.when(w.lag(F.col("q_now"), -4).isNotNull() & F.col("sigma_hat").isNotNull(), F.col("y")))
    return memberships(x.select("root", "timestamp", "y", F.col("x1").alias("x")), spark.createDataFrame(X1_CENTRES, "id int, centre array<double>"), "x", TEMPERATURE)


def frozen_parts(spark, d):
    """Memberships of all bars, and the label shares of the first twenty days."""
    member = cut(memberships_of(spark, d))
    seen = member.where(_seen() & F.col("y").isNotNull())
    weights = seen.select("root", "timestamp", F.posexplode("weights").alias("region", "weight"))
    return member, S.region_tables(weights, seen.select("root", "timestamp", F.col("y").alias("label")), ["root", "timestamp"], 5, REGION, BY_REGION)


def frozen_forecasts(spark, d):
    """Forecasts of the days after the twentieth by tables of the days before."""
    member, (general, local) = frozen_parts(spark, d)
    return rnd(S.region_forecasts(member.where(~_seen()), ["root", "timestamp"], general, local), ["probability"])


def _points(n: str) -> str:
    probs = ", ".join(str(i / 100) for i in range(101))
    return f"""SELECT root, '{n}' AS name, v, CASE WHEN count(*) OVER (PARTITION BY root) = 1 THEN 0.5 ELSE (min(j) + max(j)) / 2 / 100.0 END AS p
        FROM (SELECT root, unnest(k) AS v, generate_subscripts(k, 1) - 1 AS j FROM (SELECT root, quantile_cont({n}, [{probs}]) AS k FROM co WHERE day(timestamp) <= 20 GROUP BY root HAVING count({n}) > 0)) GROUP BY root, v"""


_PT = f"{_CO}, pt AS ({' UNION ALL '.join(map(_points, NAMES))})"
_TB = f"{_PT}, tb AS (SELECT root, {', '.join(f'''list({{'v': v, 'p': p}} ORDER BY v) FILTER (name = '{n}') AS k_{n}''' for n in NAMES)} FROM pt GROUP BY root)"


def _share(c: str) -> str:
    k = f"k_{c}"
    return f"""round(CASE WHEN {c} IS NULL OR {k} IS NULL OR len({k}) = 1 THEN 0.5 WHEN {c} < {k}[1].v THEN 0.0 WHEN {c} > {k}[len({k})].v THEN 1.0 ELSE
        list_transform([{{'lo': list_last(list_filter({k}, lambda k: k.v <= {c})), 'hi': list_first(list_filter({k}, lambda k: k.v >= {c}))}}],
        lambda z: CASE WHEN z.lo.v = z.hi.v THEN z.lo.p ELSE z.lo.p + ({c} - z.lo.v) / (z.hi.v - z.lo.v) * (z.hi.p - z.lo.p) END)[1] END, 9)"""


def _vectors() -> dict[str, str]:
    past = lambda n, k: f"coalesce({lag(f's_{n}', k)}, 0.5)"
    out: dict[str, list[str]] = {"x0": [], "x1": [], "x2": []}
    for group, own in GROUPS.items():
        now, path = [f"s_{n}" for n in own], PATHS.get(group, [])
        nodes = [f"[{', '.join([*(past(n, k) for k in S.LAGS), f's_{n}'])}]" for n in path]
        ends = [f"(list_position({v}, list_{m}({v})) - 1) / 4.0" for m in ("max", "min") for v in nodes]
        for level, cols in {"x0": now, "x1": now + [past(n, 16) for n in path], "x2": now + [past(n, k) for k in S.LAGS for n in path] + ends}.items():
            out[level] += [f"({c} - 0.5) * {2 / len(cols) ** 0.5!r}" for c in cols]
    return {k: f"[{', '.join(v)}]" for k, v in out.items()}


_RE = f"""{_TB}, sh AS (SELECT co.*, {', '.join(f'{_share(n)} AS s_{n}' for n in NAMES)}, {' + '.join(f'({n} IS NULL)::INT' for n in NAMES)} AS missing_count FROM co LEFT JOIN tb USING (root)),
re AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _vectors().items())}, lead(q_now, 12) OVER ({W}) AS q_far FROM sh)"""
_BIN = lambda z: " + ".join(f"({z} >= {e})::INT" for e in EDGES)
_DIST = lambda a, b: f"list_sum(list_transform(range(1, 5), lambda i: ({a}[i] - {b}[i]) ** 2))"
_AT = lambda i, rows, c: f"CASE state {' '.join(f'WHEN {r[0]} THEN {r[i]}' for r in rows)} END"
_LB = f"""{_RE}, lb AS (SELECT root, timestamp, timestamp::DATE AS day, day(timestamp) <= 14 AS fit, {_BIN('(q_later - q_now) / sqrt(greatest(sigma_hat ** 2 * 4, 1e-10))')} AS y4, {_BIN('(q_far - q_now) / sqrt(greatest(sigma_hat ** 2 * 12, 1e-10))')} AS y12,
    (abs(q_later - q_now) > sqrt(greatest(sigma_hat ** 2 * 4, 1e-10)))::INT AS wide, x0 AS x FROM re WHERE q_later IS NOT NULL AND q_far IS NOT NULL AND sigma_hat IS NOT NULL),
ds AS (SELECT *, {', '.join(f'sqrt({_DIST("x", c)}) AS d{i}' for i, c in CENTRES)} FROM lb),
ns AS (SELECT *, CASE WHEN round(d0, 9) <= round(d1, 9) AND round(d0, 9) <= round(d2, 9) THEN 0 WHEN round(d1, 9) <= round(d2, 9) THEN 1 ELSE 2 END AS state FROM ds),
cs AS (SELECT *, CASE state WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS distance, {_DIST('x', f'({_AT(1, CHILDREN, 0)})')} AS e0, {_DIST('x', f'({_AT(2, CHILDREN, 0)})')} AS e1 FROM ns),
al AS (SELECT *, (round(e1, 9) < round(e0, 9))::INT AS child, sqrt(least(e0, e1)) AS child_distance FROM cs), pl AS (SELECT * FROM al WHERE day(timestamp) <= 20),
lo AS (SELECT state, child, root, fit, task, label FROM (UNPIVOT pl ON y4, y12, wide INTO NAME task VALUE label)),
ce AS (SELECT state, child, task, label, count(*) FILTER (fit) AS f, count(*) FILTER (NOT fit) AS v FROM lo GROUP BY ALL),
ba AS (SELECT *, (sum(f) OVER (PARTITION BY task, label) + 1) / (sum(f) OVER (PARTITION BY task) + CASE task WHEN 'wide' THEN 2 ELSE 5 END) AS back FROM ce),
pa AS (SELECT *, (sum(f) OVER (PARTITION BY state, task, label) + {STRENGTH} * back) / (sum(f) OVER (PARTITION BY state, task) + {STRENGTH}) AS parent FROM ba),
ow AS (SELECT *, (f + {STRENGTH} * parent) / (sum(f) OVER (PARTITION BY state, child, task) + {STRENGTH}) AS own FROM pa),
ga AS (SELECT state, sum(v * (ln(least(greatest(own, 1e-8), 1)) - ln(least(greatest(parent, 1e-8), 1)))) / sum(v) AS gain FROM ow GROUP BY state),
si AS (SELECT state, {', '.join(f"count(*) FILTER (child = {i} AND {'fit' if k == 'fit' else 'NOT fit'}) AS {k}_{i}" for k in ('fit', 'later') for i in (0, 1))}, {', '.join(f'count(DISTINCT day) FILTER (child = {i} AND NOT fit) AS days_{i}' for i in (0, 1))} FROM pl GROUP BY state),
ev AS (SELECT *, CASE WHEN fit_0 + fit_1 < 120 OR later_0 + later_1 < 40 THEN 'insufficient_support' WHEN least(fit_0, fit_1) < 60 OR least(later_0, later_1) < 20 THEN 'small_child' WHEN gain <= 0.0005 OR least(days_0, days_1) < 5 THEN 'no_gain' END AS reason FROM si JOIN ga USING (state))"""
_LV = f"""{_LB}, lv AS (SELECT al.*, CASE WHEN reason IS NULL THEN al.state * 2 + child + 100 ELSE al.state END AS leaf, CASE WHEN reason IS NULL THEN child_distance ELSE distance END AS leaf_distance FROM al JOIN ev USING (state)),
sl AS (SELECT * FROM lv WHERE day(timestamp) <= 20), ll AS (SELECT state, leaf, root, task, label FROM (UNPIVOT sl ON y4, y12, wide INTO NAME task VALUE label)),
gr AS (SELECT 'y4' AS task, unnest(range(5))::INT AS label UNION ALL SELECT 'y12', unnest(range(5))::INT UNION ALL SELECT 'wide', unnest(range(2))::INT),
wh AS (SELECT gr.task, gr.label, (count(leaf) + 1) / ((SELECT count(*) FROM sl) + CASE gr.task WHEN 'wide' THEN 2 ELSE 5 END) AS p FROM gr LEFT JOIN ll ON ll.task = gr.task AND ll.label = gr.label GROUP BY gr.task, gr.label)"""


def _shrunk(name: str, by: str, prior: str, on: str, strength: float) -> str:
    keys = by.split(", ")
    match = " AND ".join(f"l.{k} = s.{k}" for k in keys)
    join = " AND ".join(["p.task = gr.task", "p.label = gr.label", *([f"p.{on} = s.{on}"] if on else [])])
    return f"""{name} AS (SELECT {', '.join(f's.{k}' for k in keys)}, gr.task, gr.label, (count(l.label) + {strength} * any_value(p.p)) / (any_value(s.n) + {strength}) AS p
        FROM (SELECT {by}, count(*) / 3 AS n FROM ll GROUP BY {by}) s CROSS JOIN gr JOIN {prior} p ON {join} LEFT JOIN ll l ON {match} AND l.task = gr.task AND l.label = gr.label GROUP BY {', '.join(f's.{k}' for k in keys)}, gr.task, gr.label)"""


_TA = f"{_LV}, {_shrunk('sp', 'state', 'wh', '', STRENGTH)}, {_shrunk('lp', 'state, leaf', 'sp', 'state', STRENGTH)}, {_shrunk('ls', 'leaf, root', 'lp', 'leaf', SYMBOL_STRENGTH)}, {_shrunk('bg', 'root', 'wh', '', SYMBOL_STRENGTH)}"
_CA = """ca AS (SELECT leaf, count(*) AS support_rows, count(DISTINCT day) AS support_days, quantile_cont(leaf_distance, 0.9) AS radius, first({'r': root, 't': timestamp} ORDER BY round(leaf_distance, 9), root, timestamp) AS m FROM sl GROUP BY leaf)"""
_P = "round(p, 6) + 0.0 AS probability"
SQL = {
    "reference_maps": f"WITH {_PT} SELECT root, name, (row_number() OVER (PARTITION BY root, name ORDER BY v) - 1)::INT AS i, round(v, 6) + 0.0 AS value, round(p, 6) + 0.0 AS share FROM pt",
    "path_representation": f"WITH {_RE} "
    + " UNION ALL ".join(f"SELECT root, timestamp, missing_count, '{k}' AS level, (unnest(range(len({k}))))::INT AS i, round(unnest({k}), 5) + 0.0 AS value FROM re" for k in ("x0", "x1", "x2")),
    "state_splits": f"WITH {_LB} SELECT state, fit_0, fit_1, later_0, later_1, days_0, days_1, round(gain, 6) + 0.0 AS gain, reason, reason IS NULL AS accepted FROM ev",
    "leaf_tables": f"""WITH {_TA} SELECT 'state' AS kind, state AS id, NULL AS root, task, label, {_P} FROM sp UNION ALL SELECT 'leaf', leaf, NULL, task, label, {_P} FROM lp
        UNION ALL SELECT 'leaf_symbol', leaf, root, task, label, {_P} FROM ls UNION ALL SELECT 'background', NULL, root, task, label, {_P} FROM bg""",
    "leaf_cards": f"WITH {_LV}, {_CA} SELECT leaf, support_rows, support_days, round(radius, 6) + 0.0 AS radius, m.r AS medoid_root, m.t AS medoid_timestamp FROM ca",
    "leaf_forecasts": f"""WITH {_TA}, {_CA}, te AS (SELECT lv.*, coalesce(leaf_distance <= radius, false) AS accepted FROM lv LEFT JOIN ca USING (leaf) WHERE day(timestamp) > 20)
        SELECT te.root, te.timestamp, te.leaf, accepted, lp.task, lp.label, round(coalesce(ls.p, lp.p), 6) + 0.0 AS probability FROM te JOIN lp USING (leaf) LEFT JOIN ls ON ls.leaf = te.leaf AND ls.root = te.root AND ls.task = lp.task AND ls.label = lp.label WHERE accepted
        UNION ALL SELECT te.root, te.timestamp, leaf, accepted, task, label, {_P} FROM te JOIN bg USING (root) WHERE NOT accepted""",
}
_FC = f"""{_RE}, fm AS (SELECT root, timestamp, CASE WHEN q_later IS NOT NULL AND sigma_hat IS NOT NULL THEN {_BIN('(q_later - q_now) / sqrt(greatest(sigma_hat ** 2 * 4, 1e-10))')} END AS y, [{', '.join(f'list_distance(x1, {c}::DOUBLE[])' for _, c in X1_CENTRES)}] AS ds FROM re),
ws AS (SELECT root, timestamp, y, (unnest(range(3)))::INT AS region, unnest(list_transform(ds, lambda v: exp(-(v - list_min(ds)) / {TEMPERATURE}))) AS e FROM fm), wt AS (SELECT *, e / sum(e) OVER (PARTITION BY root, timestamp) AS w FROM ws),
sn AS (SELECT * FROM wt WHERE day(timestamp) <= 20 AND y IS NOT NULL), lg AS (SELECT unnest(range(5))::INT AS label),
bk AS (SELECT label, (count(region) + 1) / ((SELECT count(*) FROM sn WHERE region = 0) + 5) AS p FROM lg LEFT JOIN sn ON y = label AND region = 0 GROUP BY label),
gn AS (SELECT t.region, bk.label, (coalesce(k.w, 0) + {REGION} * bk.p) / (t.w + {REGION}) AS p FROM (SELECT region, sum(w) AS w FROM sn GROUP BY region) t CROSS JOIN bk LEFT JOIN (SELECT region, y, sum(w) AS w FROM sn GROUP BY ALL) k ON k.region = t.region AND k.y = bk.label),
lc AS (SELECT t.root, t.region, gn.label, (coalesce(k.w, 0) + {BY_REGION} * gn.p) / (t.w + {BY_REGION}) AS p FROM (SELECT root, region, sum(w) AS w FROM sn GROUP BY ALL) t JOIN gn USING (region)
    LEFT JOIN (SELECT root, region, y, sum(w) AS w FROM sn GROUP BY ALL) k ON k.root = t.root AND k.region = t.region AND k.y = gn.label)"""
_CF = {"trend_current": "(x2[1] + x2[2]) / 2", "trend_change_far": "x2[2] - x2[3]", "trend_change_near": "x2[2] - x2[6]", "flow_current": "x2[9]", "flow_change_far": "x2[9] - x2[10]", "flow_change_near": "x2[9] - x2[13]", "risk_current": "x2[16]"}
_HR, _WK = "hour(timestamp) / 24.0", "((isodow(timestamp) - 1) + hour(timestamp) / 24.0) / 7"
_CF |= {f"market_{g}": f"avg({_CF[f'{g}_current']}) OVER (PARTITION BY timestamp)" for g in GROUPS} | {f"clock_{n}_{k}": f"{k}(2 * pi() * {t})" for n, t in (("hour", _HR), ("week", _WK)) for k in ("sin", "cos")}
_CF["log_past_variance"] = "ln(greatest(sigma_hat ** 2, 1e-10))"
SQL["compact_features"] = f"WITH {_RE} SELECT root, timestamp, {', '.join(f'round(CASE WHEN sigma_hat IS NOT NULL OR {int(n != COMPACT[-1])} = 1 THEN {e} END, 5) + 0.0 AS {n}' for n, e in _CF.items())} FROM re"
SQL["frozen_forecasts"] = f"WITH {_FC} SELECT wt.root, timestamp, label, round(sum(w * p), 6) + 0.0 AS probability FROM wt JOIN lc ON lc.root = wt.root AND lc.region = wt.region WHERE day(timestamp) > 20 GROUP BY ALL"
QUERIES = {f.__name__: f for f in (compact_features, frozen_forecasts, reference_maps, path_representation, state_splits, leaf_tables, leaf_cards, leaf_forecasts, fitted_states)}
