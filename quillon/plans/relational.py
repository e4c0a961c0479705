"""Joins, sets, groupings and ranks as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import log, safe_div
from quillon.functions.windows import Bars, average_rank, equal_bins, runs
from quillon.operators import bars as B
from quillon.operators import relational as R
from quillon.plans.market import rnd
from quillon.plans.sql import BARS, RETURNS
from quillon.plans.sql import W as OVER
from quillon.sources.lineage import numbered_rows


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def join_one_to_one(spark, d):
    bars = B.bars_of(spark, d)
    return R.join_checked(bars.select("root", "timestamp", "close"), bars.select("root", "timestamp", "volume"), ["root", "timestamp"])


def join_dimension(spark, d):
    sessions = B.bars_of(spark, d).groupBy("root", "session_id").agg(F.count("*").alias("n_bars"), F.max("high").alias("session_high"))
    out = R.join_checked(B.bars_of(spark, d).select("root", "timestamp", "session_id", "high"), sessions, ["root", "session_id"], "left", "many_to_one")
    return out.select("root", "timestamp", "n_bars", (F.col("high") == F.col("session_high")).alias("at_high"))


def asof_backward(spark, d):
    bars = B.bars_of(spark, d)
    marks = bars.where("bar_count >= 4").select("root", (F.col("timestamp") + F.expr("interval 30 minutes")).alias("seen"), F.col("close").alias("mark"), F.when(F.col("volume") > 12, F.col("volume")).alias("mark_volume"))
    return R.asof_backward(bars.select("root", "timestamp", "close"), marks, ["root"], "timestamp", "seen", ["mark", "mark_volume"])


def exact_offset(spark, d):
    bars = B.bars_of(spark, d).select("root", "timestamp", "open")
    return R.exact_offset(bars, ["root"], "timestamp", "open", "1 hour", 4, "1 hour").select("root", "timestamp", "entry", "exit")


def synchronous_leader(spark, d):
    """The leader's return beside every instrument at the same time, without a join."""
    r = B.add_returns(B.bars_of(spark, d))
    lead = F.max(F.when(F.col("root") == "purchase", F.col("ret"))).over(W.partitionBy("timestamp"))
    return rnd(r.select("root", "timestamp", "ret", lead.alias("leader_ret")), ["ret", "leader_ret"], 9)


def semi_join(spark, d):
    big = _t(spark, d, "orders").where("o_totalprice > 200000")
    return _t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def outer_alignment(spark, d):
    """Two series on the union of their keys, missing as zero."""
    bars = B.bars_of(spark, d)
    a = bars.where("root = 'click'").select("timestamp", F.col("volume").alias("click"))
    b = bars.where("root = 'view'").select("timestamp", F.col("volume").alias("view"))
    return a.join(b, "timestamp", "full_outer").select("timestamp", F.coalesce("click", F.lit(0.0)).alias("click"), F.coalesce("view", F.lit(0.0)).alias("view"))


def pair_scores(spark, d):
    """All ordered pairs of instruments by spread of mean return per bar; a dimension of five rows."""
    m = B.add_returns(B.bars_of(spark, d)).groupBy("root").agg(F.avg("ret").alias("m"))
    a, b = m.select(F.col("root").alias("long"), F.col("m").alias("ma")), m.select(F.col("root").alias("short"), F.col("m").alias("mb"))
    return rnd(a.join(b, F.col("long") != F.col("short")).select("long", "short", (F.col("ma") - F.col("mb")).alias("spread")), ["spread"], 9)


def self_pairs(spark, d):
    """Joint and common activity of unordered pairs of instruments over hours."""
    on = B.bars_of(spark, d).where("bar_count >= 4").select("root", "timestamp")
    pairs = on.alias("a").join(on.alias("b"), (F.col("a.timestamp") == F.col("b.timestamp")) & (F.col("a.root") < F.col("b.root")))
    both = pairs.groupBy(F.col("a.root").alias("a"), F.col("b.root").alias("b")).agg(F.count("*").alias("joint"))
    n = on.groupBy("root").agg(F.count("*").alias("n"))
    out = both.join(n.select(F.col("root").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("root").alias("b"), F.col("n").alias("nb")), "b")
    return rnd(out.select("a", "b", "joint", (F.col("joint") / (F.col("na") + F.col("nb") - F.col("joint"))).alias("jaccard")), ["jaccard"])


def knn_join(spark, d):
    e = _t(spark, d, "embeddings")
    return rnd(R.knn(e.where("vec_id % 20 = 0"), e, 5, "label").select("query_id", "vec_id", "rank", "distance"), ["distance"], 4)


def set_operations(spark, d):
    bars = B.bars_of(spark, d)
    hours = {r: bars.where(F.col("root") == r).select("timestamp") for r in ("click", "view", "error")}
    parts = {"union": hours["click"].union(hours["view"]).distinct(), "both": hours["click"].intersect(hours["view"]), "only": hours["click"].subtract(hours["error"])}
    out = [p.select(F.lit(k).alias("op"), "timestamp") for k, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def replace_partition(spark, d):
    """A recomputed instrument takes the place of its rows."""
    bars = B.bars_of(spark, d).select("root", "timestamp", "volume")
    fresh = bars.where("root = 'error'").withColumn("volume", F.col("volume") * 2)
    return bars.join(fresh.select("root").distinct(), "root", "left_anti").unionByName(fresh)


def missing_days(spark, d):
    """Weekdays between an instrument's first and last session without a valid bar."""
    seen = B.bars_of(spark, d).where("bar_count >= 6").select("root", "session_id").distinct()
    span = seen.groupBy("root").agg(F.min("session_id").alias("a"), F.max("session_id").alias("b"))
    every = span.select("root", F.explode(F.sequence("a", "b")).alias("session_id")).where(F.weekday("session_id") < 5)
    return every.join(seen, ["root", "session_id"], "left_anti").select("root", F.col("session_id").cast("string").alias("session_id"))


def session_summary(spark, d):
    b = B.add_returns(B.bars_of(spark, d))
    q = F.percentile("close", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = b.groupBy("root", F.col("session_id").cast("string").alias("session_id")).agg(
        F.count("*").alias("n"), F.countDistinct(F.hour("timestamp")).alias("hours"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), q[0].alias("p10"), q[1].alias("p50"), q[2].alias("p90"),
        safe_div(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vw"), (F.exp(F.sum("ret")) - 1).alias("compound"), F.avg((F.col("ret") > 0).cast("double")).alias("up_share"),
    )
    return rnd(out, ["mean", "sd", "p10", "p50", "p90", "vw", "compound", "up_share"])


def mode_smallest(spark, d):
    n = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_quantity"))
    return n.withColumn("r", best).where("r = 1").select("l_returnflag", F.col("l_quantity").alias("mode"), "n")


def grouping_reports(spark, d):
    li = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    m = {"n": F.count("*"), "mean_price": F.avg("l_extendedprice"), "share_big": F.avg((F.col("l_quantity") > 25).cast("double"))}
    out = R.grouped_reports(li, [["l_returnflag"], ["l_linestatus"], ["month"], ["l_returnflag", "l_linestatus"]], m)
    return rnd(out.select("report", "l_returnflag", "l_linestatus", "month", "n", "mean_price", "share_big"), ["mean_price", "share_big"], 4)


def pivot_fill(spark, d):
    return B.bars_of(spark, d).groupBy(F.hour("timestamp").alias("hour")).pivot("root", ["click", "error", "purchase", "signup", "view"]).count().fillna(0)


def unpivot_prices(spark, d):
    return B.bars_of(spark, d).unpivot(["root", "timestamp"], ["open", "high", "low", "close"], "field", "price")


def correlations(spark, d):
    return rnd(R.correlation_matrix(B.bars_of(spark, d).select(F.col("bar_count").cast("double").alias("bar_count"), "volume", "wap", "high"), ["bar_count", "volume", "wap", "high"]), ["corr"])


def effective_count(spark, d):
    wide = B.add_returns(B.bars_of(spark, d)).withColumn("ret", F.col("close") - F.col("open")).groupBy("timestamp").pivot("root", ["click", "error", "purchase", "signup", "view"]).agg(F.first("ret"))
    return rnd(R.effective_count(R.correlation_matrix(wide, ["click", "error", "purchase", "signup", "view"]), 5), ["n_eff", "sharpe_se"])


def lead_lag(spark, d):
    """Correlation of one instrument's moves with another's, for lags -10 to 10 on the complete-case grid."""
    wide = B.bars_of(spark, d).withColumn("m", F.col("close") - F.col("open")).groupBy("timestamp").pivot("root", ["click", "view"]).agg(F.first("m")).dropna()
    numbered, _ = numbered_rows(wide, ["timestamp"])
    moved = numbered.select(F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("lag"), "i", "click").withColumn("i", F.col("i") + F.col("lag"))
    return rnd(moved.join(numbered.select("i", "view"), "i").groupBy("lag").agg(F.corr("click", "view").alias("correlation"), F.count("*").alias("n")), ["correlation"])


def tick_sizes(spark, d):
    b = B.bars_of(spark, d)
    points = b.select("root", F.explode(F.array("open", "high", "low", "close")).alias("p"))
    ticks = R.grid_gcd(points, "root", F.col("p"))
    return rnd(ticks.join(b.groupBy("root").agg(F.percentile("close", 0.5).alias("median_close")), "root").withColumn("tick_bp", F.col("tick_size") / F.col("median_close") * 10000), ["tick_size", "median_close", "tick_bp"])


def sampled_rows(spark, d):
    return R.sample_rows(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 20, "o_orderkey")


def strided(spark, d):
    return R.stride(B.bars_of(spark, d).select("root", "timestamp", "close"), ["root"], "timestamp", 2, 3)


def rank_bins(spark, d):
    b = B.bars_of(spark, d).select("root", "timestamp", "volume")
    w = W.partitionBy("root")
    r = b.withColumns({"first_rank": F.row_number().over(w.orderBy("volume", "timestamp")), "avg_rank": average_rank(F.col("volume"), ["root"]), "n": F.count("*").over(w)})
    return rnd(r.select("root", "timestamp", "first_rank", "avg_rank", (F.col("avg_rank") / F.col("n")).alias("pct"), equal_bins(F.col("first_rank"), F.col("n"), 5).cast("int").alias("bin"), F.least(F.floor(F.col("avg_rank") / F.col("n") * 10), F.lit(9)).cast("int").alias("decile")), ["pct"])


def rank_correlation(spark, d):
    """Spearman correlation of volume and range by day, across instruments and hours, and top-two minus bottom-two spread."""
    b = B.bars_of(spark, d).withColumn("rng", F.col("high") - F.col("low")).withColumn("day", F.col("session_id").cast("string"))
    r = b.select("day", "rng", average_rank(F.col("volume"), ["day"]).alias("rv"), average_rank(F.col("rng"), ["day"]).alias("rr"), F.row_number().over(W.partitionBy("day").orderBy("volume", "root", "timestamp")).alias("i"), F.count("*").over(W.partitionBy("day")).alias("n"))
    spread = F.avg(F.when(F.col("i") > F.col("n") - 2, F.col("rng"))) - F.avg(F.when(F.col("i") <= 2, F.col("rng")))
    return rnd(r.groupBy("day").agg(F.corr("rv", "rr").alias("ic"), spread.alias("spread")), ["ic", "spread"])


def spells(spark, d):
    b = B.bars_of(spark, d).select("root", "timestamp", (F.col("close") > F.col("open")).alias("up"))
    return runs(b, ["root"], ["timestamp"], "up").select("root", "timestamp", "up", F.col("run").cast("long").alias("run"), F.col("age").cast("long").alias("age"))


def running_state(spark, d):
    """Session VWAP, wealth, drawdown, session number and fill-forward of the last busy price."""
    b = B.add_returns(B.bars_of(spark, d))
    w, s = Bars("root", "timestamp"), Bars(["root", "session_id"], "timestamp")
    x = b.select("root", "timestamp", F.col("close"), s.running(F.sum, F.col("quote")).alias("q"), s.running(F.sum, F.col("volume")).alias("v"), w.running(F.sum, F.coalesce("ret", F.lit(0.0))).alias("lw"), F.dense_rank().over(W.partitionBy("root").orderBy("session_id")).alias("session_no"), s.number().alias("bar_no"), w.ffill(F.when(F.col("bar_count") >= 6, F.col("close"))).alias("busy_close"))
    x = x.withColumn("wealth", F.exp("lw")).withColumn("peak", w.running(F.max, F.col("wealth")))
    return rnd(x.select("root", "timestamp", (F.col("q") / F.col("v")).alias("vwap"), "wealth", (F.col("wealth") / F.col("peak") - 1).alias("drawdown"), F.col("session_no").cast("long").alias("session_no"), F.col("bar_no").cast("long").alias("bar_no"), "busy_close"), ["vwap", "wealth", "drawdown", "busy_close"])


def rolling_robust(spark, d):
    """Lagged rolling median and MAD, and the share of the last values at or below the current one."""
    b = B.bars_of(spark, d)
    w, x = Bars("root", "timestamp"), F.col("x")
    a = b.select("root", "timestamp", log(F.col("close")).alias("x")).withColumn("med", w.median(x, 12, back=1, least=6)).withColumn("dev", F.abs(x - F.col("med")))
    a = a.select("root", "timestamp", "med", w.median(F.col("dev"), 12, back=1, least=6).alias("mad"), w.share_below(x, 24, 10).alias("share"), w.expanding(lambda y: F.percentile(y, 0.5), x, 20, back=1).alias("expanding_median"))
    return rnd(a, ["med", "mad", "share", "expanding_median"])


def future_extremes(spark, d):
    b = B.bars_of(spark, d)
    w = Bars("root", "timestamp")
    up = log(w.ahead(F.max, F.col("high"), 1, 12) / F.col("close"))
    down = log(w.ahead(F.min, F.col("low"), 1, 12) / F.col("close"))
    return rnd(b.select("root", "timestamp", up.alias("mfe"), down.alias("mae")), ["mfe", "mae"])


def top_rows(spark, d):
    """The 25 largest bars, each with its neighbours two bars before and after."""
    b = B.bars_of(spark, d).select("root", "timestamp", "quote").withColumn("i", Bars("root", "timestamp").number())
    top = b.orderBy(F.desc("quote"), "root", "timestamp").limit(25).select("root", F.col("i").alias("centre"))
    near = top.withColumn("i", F.explode(F.sequence(F.col("centre") - 2, F.col("centre") + 2)))
    return rnd(near.join(b, ["root", "i"]).select("root", F.col("centre").cast("long").alias("centre"), (F.col("i") - F.col("centre")).cast("long").alias("offset"), "timestamp", "quote"), ["quote"])


def last_per_group(spark, d):
    b = B.bars_of(spark, d)
    return b.groupBy("root").agg(F.max_by("close", "timestamp").alias("last_close"), F.min_by("open", "timestamp").alias("first_open"), F.max_by("timestamp", F.struct("quote", "timestamp")).alias("busiest"))


_HOURS = "SELECT timestamp FROM bars WHERE root = "
_PIV = ", ".join(f"count(*) FILTER (root = '{r}') AS {r}" for r in ("click", "error", "purchase", "signup", "view"))
_NAMES4 = ["bar_count", "volume", "wap", "high"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0 AS corr FROM bars" for i, a in enumerate(_NAMES4) for b in _NAMES4[i:])
_R5 = ["click", "error", "purchase", "signup", "view"]
_WIDE = ", ".join(f"max(close - open) FILTER (root = '{r}') AS {r}" for r in _R5)
_SUMSQ = " + ".join(f"{1 if a == b else 2} * corr({a}, {b}) ** 2" for i, a in enumerate(_R5) for b in _R5[i:])
SQL = {
    "join_one_to_one": f"WITH {BARS} SELECT root, timestamp, close, volume FROM bars",
    "join_dimension": f"WITH {BARS} SELECT root, timestamp, count(*) OVER s AS n_bars, high = max(high) OVER s AS at_high FROM bars WINDOW s AS (PARTITION BY root, session_id)",
    "asof_backward": f"""WITH {BARS}, m AS (SELECT root, timestamp + INTERVAL 30 MINUTE AS seen, close AS mark, CASE WHEN volume > 12 THEN volume END AS mark_volume FROM bars WHERE bar_count >= 4)
        SELECT b.root, b.timestamp, b.close, m.mark, m.mark_volume FROM bars b ASOF LEFT JOIN m ON b.root = m.root AND b.timestamp >= m.seen""",
    "exact_offset": f"""WITH {BARS} SELECT b.root, b.timestamp, e.open AS entry, x.open AS exit FROM bars b LEFT JOIN bars e ON e.root = b.root AND e.timestamp = b.timestamp + INTERVAL 1 HOUR
        LEFT JOIN bars x ON x.root = b.root AND x.timestamp = b.timestamp + INTERVAL 5 HOUR""",
    "synchronous_leader": f"""WITH {RETURNS} SELECT a.root, a.timestamp, round(a.ret, 9) + 0.0 AS ret, round(l.ret, 9) + 0.0 AS leader_ret FROM bars_r a
        LEFT JOIN (SELECT timestamp, ret FROM bars_r WHERE root = 'purchase') l USING (timestamp)""",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)",
    "outer_alignment": f"""WITH {BARS} SELECT timestamp, coalesce(max(volume) FILTER (root = 'click'), 0.0) AS click, coalesce(max(volume) FILTER (root = 'view'), 0.0) AS view
        FROM bars WHERE root IN ('click', 'view') GROUP BY timestamp""",
    "pair_scores": f"""WITH {RETURNS}, m AS (SELECT root, avg(ret) AS m FROM bars_r GROUP BY root)
        SELECT a.root AS long, b.root AS short, round(a.m - b.m, 9) + 0.0 AS spread FROM m a JOIN m b ON a.root <> b.root""",
    "self_pairs": f"""WITH {BARS}, o AS (SELECT root, timestamp FROM bars WHERE bar_count >= 4), n AS (SELECT root, count(*) AS n FROM o GROUP BY root),
        j AS (SELECT x.root AS a, y.root AS b, count(*) AS joint FROM o x JOIN o y ON x.timestamp = y.timestamp AND x.root < y.root GROUP BY ALL)
        SELECT a, b, joint, round(joint / (p.n + q.n - joint), 6) + 0.0 AS jaccard FROM j JOIN n p ON p.root = a JOIN n q ON q.root = b""",
    "knn_join": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label <> b.label WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM p)
        SELECT query_id, vec_id, rank, round(dist, 4) + 0.0 AS distance FROM r WHERE rank <= 5""",
    "set_operations": f"""WITH {BARS}, u AS ({_HOURS}'click' UNION {_HOURS}'view'), i AS ({_HOURS}'click' INTERSECT {_HOURS}'view'), e AS ({_HOURS}'click' EXCEPT {_HOURS}'error')
        SELECT 'union' AS op, timestamp FROM u UNION ALL SELECT 'both', timestamp FROM i UNION ALL SELECT 'only', timestamp FROM e""",
    "replace_partition": f"WITH {BARS} SELECT root, timestamp, CASE WHEN root = 'error' THEN volume * 2 ELSE volume END AS volume FROM bars",
    "missing_days": f"""WITH {BARS}, s AS (SELECT DISTINCT root, session_id FROM bars WHERE bar_count >= 6),
        e AS (SELECT root, unnest(generate_series(min(session_id), max(session_id), INTERVAL 1 DAY))::DATE AS session_id FROM s GROUP BY root)
        SELECT root, session_id::VARCHAR AS session_id FROM e WHERE isodow(session_id) < 6 AND (root, session_id) NOT IN (SELECT (root, session_id) FROM s)""",
    "session_summary": f"""WITH {RETURNS} SELECT root, session_id::VARCHAR AS session_id, count(*) AS n, count(DISTINCT hour(timestamp)) AS hours, round(avg(close), 6) + 0.0 AS mean, round(stddev_samp(close), 6) + 0.0 AS sd,
        round(quantile_cont(close, 0.1), 6) + 0.0 AS p10, round(quantile_cont(close, 0.5), 6) + 0.0 AS p50, round(quantile_cont(close, 0.9), 6) + 0.0 AS p90, round(sum(close * volume) / sum(volume), 6) + 0.0 AS vw,
        round(exp(sum(ret)) - 1, 6) + 0.0 AS compound, round(avg((ret > 0)::INT), 6) + 0.0 AS up_share FROM bars_r GROUP BY root, session_id""",
    "mode_smallest": """WITH n AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, l_quantity AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) = 1""",
    "grouping_reports": """WITH l AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
        SELECT CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(l_returnflag) = 0 AND grouping(l_linestatus) = 0 THEN 'l_returnflagxl_linestatus' WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS report,
               l_returnflag, l_linestatus, month, count(*) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean_price, round(avg((l_quantity > 25)::INT), 4) + 0.0 AS share_big
        FROM l GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (month), (l_returnflag, l_linestatus))""",
    "pivot_fill": f"WITH {BARS} SELECT hour(timestamp)::INT AS hour, {_PIV} FROM bars GROUP BY hour(timestamp)",
    "unpivot_prices": f"WITH {BARS} " + " UNION ALL ".join(f"SELECT root, timestamp, '{f}' AS field, {f} AS price FROM bars" for f in ("open", "high", "low", "close")),
    "correlations": f"WITH {BARS} {_CORR}",
    "effective_count": f"""WITH {BARS}, w AS (SELECT timestamp, {_WIDE} FROM bars GROUP BY timestamp), c AS (SELECT * FROM w WHERE {' AND '.join(f'{r} IS NOT NULL' for r in _R5)}),
        n AS (SELECT 25.0 / ({_SUMSQ}) AS n_eff FROM c) SELECT round(n_eff, 6) + 0.0 AS n_eff, round(sqrt(2 / n_eff), 6) + 0.0 AS sharpe_se FROM n""",
    "lead_lag": f"""WITH {BARS}, w AS (SELECT timestamp, max(close - open) FILTER (root = 'click') AS x, max(close - open) FILTER (root = 'view') AS y FROM bars GROUP BY timestamp),
        c AS (SELECT *, row_number() OVER (ORDER BY timestamp) AS i FROM w WHERE x IS NOT NULL AND y IS NOT NULL), g AS (SELECT unnest(range(-10, 11)) AS lag)
        SELECT lag::INT AS lag, round(corr(a.x, b.y), 6) + 0.0 AS correlation, count(*) AS n FROM g, c a JOIN c b ON b.i = a.i + lag GROUP BY lag""",
    "tick_sizes": f"""WITH {BARS}, p AS (SELECT DISTINCT root, round(unnest([open, high, low, close]) * 100)::BIGINT AS v FROM bars), q AS (SELECT root, v - lag(v) OVER (PARTITION BY root ORDER BY v) AS g FROM p),
        t AS (SELECT root, list_reduce(list(g), lambda a, b: gcd(a, b)) / 100 AS tick_size FROM q WHERE g > 0 GROUP BY root)
        SELECT root, round(tick_size, 6) + 0.0 AS tick_size, round(m, 6) + 0.0 AS median_close, round(tick_size / m * 10000, 6) + 0.0 AS tick_bp FROM t JOIN (SELECT root, median(close) AS m FROM bars GROUP BY root) USING (root)""",
    "sampled_rows": """SELECT o_orderkey, o_orderpriority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY ('0x' || substr(md5('7|' || o_orderkey), 1, 8))::BIGINT, o_orderkey) <= 20""",
    "strided": f"WITH {BARS}, n AS (SELECT root, timestamp, close, row_number() OVER ({OVER}) - 1 AS i FROM bars) SELECT root, timestamp, close FROM n WHERE i >= 2 AND (i - 2) % 3 = 0",
    "rank_bins": f"""WITH {BARS}, r AS (SELECT root, timestamp, row_number() OVER (PARTITION BY root ORDER BY volume, timestamp) AS first_rank,
            rank() OVER (PARTITION BY root ORDER BY volume) + (count(*) OVER (PARTITION BY root, volume) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY root) AS n FROM bars)
        SELECT root, timestamp, first_rank, avg_rank, round(avg_rank / n, 6) + 0.0 AS pct, greatest(((first_rank - 1) * 5 + n - 2) // greatest(n - 1, 1) - 1, 0)::INT AS bin, least(floor(avg_rank / n * 10), 9)::INT AS decile FROM r""",
    "rank_correlation": f"""WITH {BARS}, b AS (SELECT *, high - low AS rng, session_id::VARCHAR AS day FROM bars),
        r AS (SELECT day, rng, rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0 AS rv,
              rank() OVER (PARTITION BY day ORDER BY rng) + (count(*) OVER (PARTITION BY day, rng) - 1) / 2.0 AS rr, row_number() OVER (PARTITION BY day ORDER BY volume, root, timestamp) AS i, count(*) OVER (PARTITION BY day) AS n FROM b)
        SELECT day, round(corr(rv, rr), 6) + 0.0 AS ic, round(avg(rng) FILTER (i > n - 2) - avg(rng) FILTER (i <= 2), 6) + 0.0 AS spread FROM r GROUP BY day""",
    "spells": f"""WITH {BARS}, a AS (SELECT root, timestamp, close > open AS up FROM bars), b AS (SELECT *, CASE WHEN lag(up) OVER ({OVER}) = up THEN 0 ELSE 1 END AS new FROM a),
        c AS (SELECT *, sum(new) OVER ({OVER})::BIGINT AS run FROM b) SELECT root, timestamp, up, run, row_number() OVER (PARTITION BY root, run ORDER BY timestamp) - 1 AS age FROM c""",
    "running_state": f"""WITH {RETURNS}, a AS (SELECT *, sum(quote) OVER s / sum(volume) OVER s AS vwap, exp(sum(coalesce(ret, 0)) OVER w) AS wealth, dense_rank() OVER (PARTITION BY root ORDER BY session_id) AS session_no,
            row_number() OVER s - 1 AS bar_no, last_value(CASE WHEN bar_count >= 6 THEN close END IGNORE NULLS) OVER w AS busy_close
            FROM bars_r WINDOW s AS (PARTITION BY root, session_id ORDER BY timestamp), w AS ({OVER}))
        SELECT root, timestamp, round(vwap, 6) + 0.0 AS vwap, round(wealth, 6) + 0.0 AS wealth, round(wealth / max(wealth) OVER ({OVER}) - 1, 6) + 0.0 AS drawdown, session_no, bar_no, round(busy_close, 6) + 0.0 AS busy_close FROM a""",
    "rolling_robust": f"""WITH {BARS}, a AS (SELECT root, timestamp, ln(close) AS x, row_number() OVER ({OVER}) AS i FROM bars),
        b AS (SELECT *, CASE WHEN count(x) OVER f >= 6 THEN median(x) OVER f END AS med, CASE WHEN count(x) OVER e >= 20 THEN median(x) OVER e END AS em,
              CASE WHEN least(i, 24) >= 10 THEN list_sum(list_transform(list(x) OVER h, lambda v: (v <= x)::INT)) / least(i - 1, 23) END AS share
              FROM a WINDOW f AS ({OVER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), e AS ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS ({OVER} ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, abs(x - med) AS dev FROM b)
        SELECT root, timestamp, round(med, 6) + 0.0 AS med, round(CASE WHEN count(dev) OVER f >= 6 THEN median(dev) OVER f END, 6) + 0.0 AS mad, round(share, 6) + 0.0 AS share, round(em, 6) + 0.0 AS expanding_median
        FROM c WINDOW f AS ({OVER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "future_extremes": f"""WITH {BARS} SELECT root, timestamp, round(CASE WHEN count(*) OVER f = 12 THEN ln(max(high) OVER f / close) END, 6) + 0.0 AS mfe, round(CASE WHEN count(*) OVER f = 12 THEN ln(min(low) OVER f / close) END, 6) + 0.0 AS mae
        FROM bars WINDOW f AS ({OVER} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""",
    "top_rows": f"""WITH {BARS}, n AS (SELECT root, timestamp, quote, row_number() OVER ({OVER}) - 1 AS i FROM bars), t AS (SELECT root, i AS centre FROM n ORDER BY quote DESC, root, timestamp LIMIT 25)
        SELECT root, centre, i - centre AS "offset", timestamp, round(quote, 6) + 0.0 AS quote FROM t JOIN n USING (root) WHERE i BETWEEN centre - 2 AND centre + 2""",
    "last_per_group": f"""WITH {BARS} SELECT root, last(close ORDER BY timestamp) AS last_close, first(open ORDER BY timestamp) AS first_open, last(timestamp ORDER BY quote, timestamp) AS busiest FROM bars GROUP BY root""",
}
QUERIES = {n: globals()[n] for n in SQL}
