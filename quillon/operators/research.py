"""Labels of future paths, slow coordinates, thresholds, further nulls, seasonality, variance forecasts and certified splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalars import clip, log, safe_div, uniform
from quillon.functions.windows import Bars
from quillon.operators.stats import numbered


def path_labels(df: DataFrame, price: str, horizons: list[int]) -> DataFrame:
    """For each horizon the return and the up and down semivariance of the following bars; NULL unless all are there."""
    w = Bars("root", "timestamp")
    x = df.withColumn("q_r", log(w.lag(F.col(price), -1) / F.col(price)))
    out = {}
    for h in horizons:
        span = lambda v, h=h: w.ahead(F.sum, v, 0, h - 1)
        out |= {f"ret_{h}": span(F.col("q_r")), f"up_{h}": span(F.pow(clip(F.col("q_r"), low=0.0), F.lit(2))), f"down_{h}": span(F.pow(clip(F.col("q_r"), high=0.0), F.lit(2)))}
    return x.withColumns(out).drop("q_r")


def semivariance_direction(up: Column, down: Column) -> Column:
    return (up - down) / (up + down + 1e-12)


def outcome_signature(df: DataFrame, price: str, beta: str, variance: str, short: int, long: int, day: int = 24, bound: float = 5.0) -> DataFrame:
    """df with eight outcomes of the following bars: returns beyond beta times the market's over two horizons, the balance of up and down semivariance over both, the logs of realised over past variance of both, and the best and the worst
    excursion of the longer one, all but the balances in units of past volatility and within ``bound``. The market is the mean of the instruments that are there. variance: of a day, known at the bar. NULL unless the bars ahead are all there.
    """
    w, c = Bars("root", "timestamp"), F.col
    x = path_labels(df, price, [short, long]).withColumn("q_lc", log(c(price)))
    x = x.withColumns({"q_top": w.ahead(F.max, c("q_lc"), 1, long) - c("q_lc"), "q_low": w.ahead(F.min, c("q_lc"), 1, long) - c("q_lc")} | {f"q_m{h}": F.avg(f"ret_{h}").over(W.partitionBy("timestamp")) for h in (short, long)})
    scale = {h: F.sqrt(F.greatest(c(variance) * h / day, F.lit(1e-9))) for h in (short, long)}
    b = lambda v: clip(v, -bound, bound)
    out = {f"alpha_{h}": b((c(f"ret_{h}") - c(beta) * c(f"q_m{h}")) / scale[h]) for h in (short, long)}
    out |= {f"balance_{h}": semivariance_direction(c(f"up_{h}"), c(f"down_{h}")) for h in (short, long)}
    out |= {f"variance_ratio_{h}": b(F.ln((c(f"up_{h}") + c(f"down_{h}") + 1e-10) / (c(variance) * h / day + 1e-10))) for h in (short, long)}
    out |= {"best": b(c("q_top") / scale[long]), "worst": b(c("q_low") / scale[long])}
    return x.withColumns(out).select(*df.columns, *out)


def regime(rv: Column, trend: Column, low: float, high: float) -> Column:
    """0 calm and falling, 1 calm and rising, 2 ordinary, 3 stressed."""
    return F.when(rv >= high, 3).when((rv < low) & (trend < 0), 0).when((rv < low) & (trend >= 0), 1).otherwise(2)


def market_residual(df: DataFrame, value: str, out: str = "residual") -> DataFrame:
    """A value less the mean of all other instruments at its time."""
    w = W.partitionBy("timestamp")
    others = safe_div(F.sum(value).over(w) - F.col(value), (F.count(value).over(w) - 1).cast("double"))
    return df.withColumn(out, F.col(value) - others)


def past_beta(df: DataFrame, ret: str, n: int, least: int, low: float = 0.2, high: float = 2.5) -> DataFrame:
    """beta: rolling covariance with the market (mean over instruments) by its variance, clipped; 1 until there is enough history."""
    x = df.withColumn("market", F.avg(ret).over(W.partitionBy("timestamp")))
    w = Bars("root", "timestamp").frame(-(n - 1), 0)
    both = F.count(F.when(F.col(ret).isNotNull() & F.col("market").isNotNull(), 1)).over(w)
    raw = safe_div(F.covar_samp(ret, "market").over(w), F.var_samp(F.when(F.col(ret).isNotNull(), F.col("market"))).over(w))
    return x.withColumn("beta", F.coalesce(clip(F.when(both >= least, raw), low, high), F.lit(1.0)))


def trailing_thresholds(df: DataFrame, value: str, regime_col: str, period_days: int, history_days: int, q: float, least: int, least_all: int) -> DataFrame:
    """(period, regime, threshold): a quantile of the days before each period, of the regime if it has enough rows, else of all, else NULL.

    Rows are exploded to the few periods whose history holds them, so no range join is needed.
    """
    origin = F.lit("2024-01-01").cast("date")
    day = F.datediff(F.to_date("timestamp"), origin)
    x = df.where(F.col(value).isNotNull()).withColumn("q_d", day)
    first, last = F.floor(F.col("q_d") / period_days) + 1, F.floor((F.col("q_d") + history_days) / period_days)
    x = x.where(first <= last).withColumn("period", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    x = x.where((F.col("q_d") < F.col("period") * period_days) & (F.col("q_d") >= F.col("period") * period_days - history_days))
    own = x.groupBy("period", F.col(regime_col).alias("regime")).agg(F.count("*").alias("n"), F.percentile(value, q).alias("local"))
    whole = x.groupBy("period").agg(F.count("*").alias("n_all"), F.percentile(value, q).alias("overall"))
    return own.join(whole, "period").select("period", "regime", F.when(F.col("n") >= least, F.col("local")).when(F.col("n_all") >= least_all, F.col("overall")).alias("threshold"))


def day_shift_null(df: DataFrame, direction: str, outcome: str, steps_a_day: int, draws: int, seed: int) -> DataFrame:
    """Mean signed outcome with all instruments moved on by one common number of whole days, around the sample."""
    base = numbered(df, ["root"], ["timestamp"])
    fired = base.where(F.col(direction) != 0).select("root", "i", "n", direction, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    days = F.greatest(F.expr(f"n div {steps_a_day}"), F.lit(1))
    off = (1 + F.floor(uniform(F.lit(seed), F.lit("day"), F.col("draw")) * (days - 1)).cast("long")) * steps_a_day
    moved = fired.select("root", "draw", direction, ((F.col("i") + off) % F.col("n")).alias("i"))
    return moved.join(base.select("root", "i", outcome), ["root", "i"]).groupBy("draw").agg(F.avg(F.col(direction) * F.col(outcome)).alias("mean"), F.count("*").alias("n"))


def stratified_null(df: DataFrame, strata: list[str], direction: str, outcome: str, draws: int, seed: int) -> DataFrame:
    """Mean signed outcome with each trigger's outcome replaced by that of a random row of its stratum."""
    base = numbered(df, strata, ["root", "timestamp"])
    fired = base.where(F.col(direction) != 0).select(*strata, "i", "n", direction, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.floor(uniform(F.lit(seed), *[F.col(c) for c in strata], F.col("i"), F.col("draw")) * F.col("n")).cast("long")
    moved = fired.select(*strata, "draw", direction, pick.alias("i"))
    return moved.join(base.select(*strata, "i", outcome), [*strata, "i"]).groupBy("draw").agg(F.avg(F.col(direction) * F.col(outcome)).alias("mean"), F.count("*").alias("n"))


def ranked_probability_score(probabilities: Column, label: Column) -> Column:
    """Sum of squared differences of the cumulative forecast and outcome."""
    steps = F.sequence(F.lit(1), F.size(probabilities))
    below = lambda k: F.aggregate(F.slice(probabilities, 1, k), F.lit(0.0), lambda s, p: s + p)
    return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.pow(below(k) - F.when(label < k, 1.0).otherwise(0.0), F.lit(2)))


def medoids(df: DataFrame, state: str, distance: str, key: list[str]) -> DataFrame:
    """Each state's row closest to its centre; ties by key."""
    best = F.struct(F.col(distance), *[F.col(k) for k in key])
    return df.groupBy(state).agg(F.min(best).alias("q_b"), F.count("*").alias("members")).select(state, "members", *[F.col(f"q_b.{k}").alias(k) for k in key], F.col(f"q_b.{distance}").alias(distance))


def shrunk_correlations(daily: DataFrame, names: list[str], window: int = 60, halflife: float = 20.0, least: int = 5) -> DataFrame:
    """day, a, b, corr: exponentially weighted correlations of the days before, shrunk towards the identity by the Ledoit-Wolf intensity.

    daily: day, one column an instrument. Weighted moments are gathered for each day from rows exploded to the days they serve; matrices are of a few instruments.
    """
    n = len(names)
    base = daily.withColumn("i", (F.row_number().over(W.orderBy("day")) - 1).cast("int"))  # one row a day

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i").dropna(subset=names)
        if len(pdf) < least:
            return pd.DataFrame([(0, "", "", 0.0)], columns=["at", "a", "b", "corr"])[:0]
        w = 0.5 ** ((pdf["at"].iloc[0] - pdf["i"].to_numpy()) / halflife)
        w /= w.sum()
        x = pdf[names].to_numpy(float)
        x = x - w @ x
        s = (x * w[:, None]).T @ x
        mu = np.trace(s) / n
        d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
        b2 = min(sum(wi**2 * ((np.outer(v, v) - s) ** 2).sum() for wi, v in zip(w, x)) / n, d2)
        s = (b2 / d2 if d2 > 0 else 1.0) * mu * np.eye(n) + (1 - b2 / d2 if d2 > 0 else 0.0) * s
        sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
        c = s / np.outer(sd, sd)
        return pd.DataFrame([(int(pdf["at"].iloc[0]), a, b, float(c[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], columns=["at", "a", "b", "corr"])

    spread = base.withColumn("at", F.explode(F.sequence(F.col("i") + 1, F.col("i") + window)))
    found = spread.select("at", "i", *names).groupBy("at").applyInPandas(one, "at int, a string, b string, corr double")
    return found.join(base.select(F.col("i").alias("at"), "day"), "at").select("day", "a", "b", "corr")


def certified_stumps(df: DataFrame, parent: str, features: list[str], target: str, time: str, least_days: int = 5, steps: int = 9) -> DataFrame:
    """parent, feature, threshold, gain: the best single split of each parent on its earlier two thirds, kept if it lowers the squared error on the later third with enough days on both sides.

    Candidate splits are quantiles; every (parent, feature, threshold) is scored by one aggregate, so no group is gathered.
    """
    day = F.datediff(F.to_date(time), F.lit("2024-01-01").cast("date"))
    x = df.dropna(subset=[target, *features]).withColumn("q_d", day)
    when = x.groupBy(parent).agg(F.percentile("q_d", 2 / 3).alias("q_cut"))
    x = x.join(F.broadcast(when), parent).withColumn("q_late", F.col("q_d") >= F.col("q_cut"))
    probs = F.array(*[F.lit((i + 1) / (steps + 1)) for i in range(steps)])
    grid = x.where(~F.col("q_late")).groupBy(parent).agg(*[F.percentile(f, probs).alias(f) for f in features])
    grid = grid.select(parent, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("t")) for f in features])).alias("g")).select(parent, "g.feature", F.explode("g.t").alias("threshold")).distinct()
    value = F.create_map(*[y for f in features for y in (F.lit(f), F.col(f).cast("double"))])
    long = x.join(F.broadcast(grid), parent).withColumn("q_left", value[F.col("feature")] <= F.col("threshold"))
    early, left, y = ~F.col("q_late"), F.col("q_left"), F.col(target)
    cells = {"ll": early & left, "lr": early & ~left, "vl": ~early & left, "vr": ~early & ~left}
    sums = [a for k, c in cells.items() for a in (F.count(F.when(c, 1)).alias(f"n_{k}"), F.sum(F.when(c, y)).alias(f"s_{k}"), F.count_distinct(F.when(c, F.col("q_d"))).alias(f"d_{k}"))]
    s = long.groupBy(parent, "feature", "threshold").agg(*sums)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean_l, mean_r = safe_div(z("s_ll"), z("n_ll")), safe_div(z("s_lr"), z("n_lr"))
    mean = safe_div(z("s_ll") + z("s_lr"), z("n_ll") + z("n_lr"))
    fit = z("n_ll") * mean_l * mean_l + z("n_lr") * mean_r * mean_r - (z("n_ll") + z("n_lr")) * mean * mean
    # Squared error saved on later rows by the two means instead of the one.
    saved = lambda n, t, m: 2 * z(t) * (m - mean) - z(n) * (m * m - mean * mean)
    s = s.withColumns({"q_fit": fit, "gain": saved("n_vl", "s_vl", mean_l) + saved("n_vr", "s_vr", mean_r), "q_days": F.least("d_ll", "d_lr")})
    best = s.where((F.col("q_days") >= least_days) & F.col("q_fit").isNotNull()).withColumn("q_r", F.row_number().over(W.partitionBy(parent).orderBy(F.desc("q_fit"), "feature", "threshold")))
    return best.where("q_r = 1 AND gain > 0").select(parent, "feature", "threshold", "gain")


def whitening(df: DataFrame, names: list[str], shrink: float = 0.1) -> DataFrame:
    """a, b, weight: the inverse square root of the shrunk covariance of a group of coordinates, from one aggregate; the matrix has a few rows."""
    row = df.dropna(subset=names).agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n = len(names)
    s = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    s = (1 - shrink) * s + shrink * np.trace(s) / n * np.eye(n)
    v, q = np.linalg.eigh(s)
    m = q @ np.diag(1 / np.sqrt(np.maximum(v, 1e-12))) @ q.T
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("weight", T.DoubleType())]))


def feature_audit(df: DataFrame, names: list[str], least: float = 0.95) -> DataFrame:
    """name, available (share not missing), redundant (features it is correlated with beyond ``least``), from one aggregate."""
    aggs = [F.avg(F.col(n).isNotNull().cast("double")).alias(f"a{i}") for i, n in enumerate(names)] + [F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    row = df.agg(*aggs)
    out = []
    for i, n in enumerate(names):
        pairs = [F.abs(F.col(f"c{min(i, j)}_{max(i, j)}")) for j in range(len(names)) if j != i]
        out.append(F.struct(F.lit(n).alias("name"), F.col(f"a{i}").alias("available"), sum((F.when(~F.isnan(p) & (p > least), 1).otherwise(0) for p in pairs), F.lit(0)).alias("redundant")))
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")
