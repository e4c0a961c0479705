"""Cards, nulls, bootstraps, shrinkage, selection and performance measures as aggregates and windows.

Random draws come from a hash of (seed, draw, position), so a resample is a plain projection: the same in any plan, and spread over draws.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, cut, normal_cdf, normal_quantile, safe_div, uniform
from quillon.functions.windows import Bars
from quillon.sources.lineage import cut as kept
from quillon.sources.lineage import numbered_rows


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Each row with the columns of ``one``, an ungrouped aggregate, which always has one row."""
    return df.crossJoin(F.broadcast(one))


def card(df: DataFrame, by: list[str], z: str, raw: str, cost: Column) -> DataFrame:
    """Signed outcomes of triggers: n, mean, t, event Sharpe, win rate, payoff, raw and net means."""
    x, sd, n = F.col(z), F.stddev_samp(z), F.count(z)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(x).alias("mean_z"), safe_div(F.avg(x), sd / F.sqrt(n.cast("double"))).alias("raw_t"), safe_div(F.avg(x), sd).alias("event_sharpe"), F.avg((x > 0).cast("double")).alias("win_rate"),
        safe_div(F.avg(F.when(x > 0, x)), F.abs(F.avg(F.when(x < 0, x)))).alias("payoff_ratio"), F.avg(raw).alias("mean_raw"), F.avg(F.col(raw) - cost).alias("mean_net"),
    )


def newey_west_t(df: DataFrame, by: list[str], order: list[str], x: str, lags: int) -> DataFrame:
    """t of a mean with Bartlett-weighted autocovariances, in closed form: no regression."""
    v = F.col("q_e")
    centred = df.withColumn("q_e", F.col(x) - F.avg(x).over(W.partitionBy(*by)))
    w = Bars(by, order)
    products = sum((2 * (1 - k / (lags + 1)) * F.coalesce(v * w.lag(v, k), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    out = centred.withColumn("q_p", v * v + products).groupBy(*by).agg(F.avg(x).alias("mean"), F.count(x).alias("n"), F.sum("q_p").alias("q_s"))
    return out.select(*by, "n", F.when((F.col("n") >= max(10, lags + 2)) & (F.col("q_s") > 0), F.col("mean") / (F.sqrt("q_s") / F.col("n"))).alias("nw_t"))


def full_card(df: DataFrame, by: list[str], order: list[str], z: str, raw: str, cost: Column, lags: int, block: float, draws: int, seed: int) -> DataFrame:
    """``card`` with the t of autocorrelated outcomes, and the interval and t of stationary bootstrap means with blocks of ``block`` rows on average."""
    drawn = interval(stationary_bootstrap(df, by, order, z, block, draws, seed), by)
    x = card(df, by, z, raw, cost).join(newey_west_t(df, by, order, z, lags).drop("n"), by).join(drawn.select(*by, "ci_low", "ci_high", "se"), by)
    return x.withColumn("stationary_t", safe_div(F.col("mean_z"), F.when(F.col("se") > 0, F.col("se")))).drop("se")


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds i (0, 1, ...) and n of each group."""
    return df.withColumn("i", Bars(by, order).number().cast("long")).withColumn("n", F.count("*").over(W.partitionBy(*by)))


def stationary_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, block: float, draws: int, seed: int) -> DataFrame:
    """Mean of each draw: positions restart at random with chance 1 / block and else go on; the walk between restarts is arithmetic, so no loop is needed."""
    base = numbered(df, by, order)
    spread = base.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("draw"), F.col("i")]
    fresh = F.floor(uniform(*key, F.lit("at")) * F.col("n")).cast("long")
    restart = (F.col("i") == 0) | (uniform(*key, F.lit("restart")) < 1.0 / block)
    last = Bars([*by, "draw"], "i").ffill(F.when(restart, F.struct(F.col("i").alias("i"), fresh.alias("at"))))
    picked = spread.withColumn("q_s", last).select(*by, "draw", ((F.col("q_s.at") + F.col("i") - F.col("q_s.i")) % F.col("n")).alias("i"))
    return picked.join(base.select(*by, "i", x), [*by, "i"]).groupBy(*by, "draw").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def block_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, block: int, draws: int, seed: int) -> DataFrame:
    """Mean of each draw of circular blocks of days."""
    base = numbered(df, by, order)
    spread = base.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    b = F.expr(f"i div {block}")
    start = F.floor(uniform(F.lit(seed), *[F.col(c) for c in by], F.col("draw"), b) * F.col("n")).cast("long")
    picked = spread.select(*by, "draw", ((start + F.col("i") % block) % F.col("n")).alias("i"))
    return picked.join(base.select(*by, "i", x), [*by, "i"]).groupBy(*by, "draw").agg(F.avg(x).alias("mean"))


def interval(draws: DataFrame, by: list[str], x: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = F.percentile(x, F.array(F.lit(low), F.lit(high)))
    return draws.groupBy(*by).agg(q[0].alias("ci_low"), q[1].alias("ci_high"), F.stddev_samp(x).alias("se"))


def shifted_null(df: DataFrame, strata: list[str], order: list[str], direction: str, outcome: str, draws: int, seed: int) -> DataFrame:
    """Mean signed outcome of each draw, with every stratum's triggers moved on by one random offset around the stratum's candidates."""
    base = numbered(df, strata, order)
    triggers = base.where(F.col(direction) != 0).select(*strata, "i", "n", direction, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    offset = F.floor(uniform(F.lit(seed), *[F.col(c) for c in strata], F.col("draw")) * F.col("n")).cast("long")
    moved = triggers.select(*strata, "draw", direction, ((F.col("i") + offset) % F.col("n")).alias("i"))
    return moved.join(base.select(*strata, "i", outcome), [*strata, "i"]).groupBy("draw").agg(F.avg(F.col(direction) * F.col(outcome)).alias("mean"), F.count("*").alias("n"))


def percentile_of(draws: DataFrame, actual: DataFrame, x: str = "mean") -> DataFrame:
    """Share of draws at or below the one actual value."""
    return beside(draws, actual).agg(F.avg((F.col(x) <= F.col("actual")).cast("double")).alias("percentile"))


def categorize(df: DataFrame) -> DataFrame:
    """Six context dimensions by fixed right-closed cuts; what is missing is a level of its own."""
    thirds = [0.33, 0.66]
    return df.withColumns({
        "structure": F.when(F.col("direction") > 0, "long").otherwise("short"), "efficiency": cut(F.col("er_20"), thirds, ["low", "mid", "high"]), "volatility": cut(F.col("sigma_pct"), thirds, ["low", "mid", "high"]),
        "vol_direction": cut(F.col("vol_ratio"), [0.8, 1.2], ["contract", "normal", "expand"]), "liquidity": cut(F.col("liq_z"), [-1.0, 1.0], ["low", "normal", "high"]), "phase": F.col("session_phase"),
    })


def _weights(effects: DataFrame, by: str, sigma2: Column) -> DataFrame:
    """effects: rows of (by, n, raw_effect). Adds tau2 and confidence."""
    w = W.partitionBy(by)
    tau2 = F.when(F.count("*").over(w) > 1, F.greatest(F.var_samp("raw_effect").over(w) - F.avg(sigma2 / F.greatest("n", F.lit(1))).over(w), F.lit(0.0))).otherwise(0.0)
    x = effects.withColumn("tau2", F.coalesce(tau2, F.lit(0.0)))
    return x.withColumn("confidence", F.when(F.col("tau2") > 0, F.col("n") * F.col("tau2") / (F.col("n") * F.col("tau2") + sigma2)).otherwise(0.0))


def decomposition(df: DataFrame, outcome: str, dimensions: list[str]) -> DataFrame:
    """Main and pair effects with empirical-Bayes shrinkage. All group means come from one pass over GROUPING SETS; effects are joined from that small table."""
    data = df.dropna(subset=[outcome, *dimensions])
    pairs = list(combinations(dimensions, 2))
    sets = [[], *[[d] for d in dimensions], *[list(p) for p in pairs]]
    # The overall variance rides along in the empty grouping.
    stats = data.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions).agg(F.grouping_id().alias("g"), F.count(outcome).alias("n"), F.avg(outcome).alias("m"), F.var_samp(outcome).alias("v"))
    stats = kept(stats)  # a row for each level and pair of levels of a few categories; filters on the grouping would otherwise be pushed below it and repeat the pass
    bit = {d: 1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions)}
    every = (1 << len(dimensions)) - 1
    whole = stats.where(F.col("g") == every).select(F.col("m").alias("mu0"), F.col("v").alias("sigma2"))
    label = lambda s: every - sum(bit[d] for d in s)
    # What each grouping stands for, by its number.
    one = F.create_map(*[y for d in dimensions for y in (F.lit(label([d])).cast("long"), F.struct(F.lit(d).alias("v"), F.col(d).alias("l")))])[F.col("g")]
    main = stats.withColumn("q", one).where("q IS NOT NULL").select(F.col("q.v").alias("variables"), F.col("q.l").alias("level"), "n", "m")
    main = beside(main, whole).withColumn("raw_effect", F.col("m") - F.col("mu0"))
    two = F.create_map(*[y for a, b in pairs for y in (F.lit(label([a, b])).cast("long"), F.struct(F.lit(a).alias("va"), F.col(a).alias("la"), F.lit(b).alias("vb"), F.col(b).alias("lb")))])[F.col("g")]
    both = stats.withColumn("q", two).where("q IS NOT NULL").select("q.*", "n", "m")
    both = both.withColumns({"variables": F.concat_ws("x", "va", "vb"), "level": F.concat_ws("|", "la", "lb")})
    effect = kept(main.select(F.col("variables").alias("v"), F.col("level").alias("l"), F.col("raw_effect").alias("e")))
    both = beside(both, whole).join(effect.select(F.col("v").alias("va"), F.col("l").alias("la"), F.col("e").alias("ea")), ["va", "la"]).join(effect.select(F.col("v").alias("vb"), F.col("l").alias("lb"), F.col("e").alias("eb")), ["vb", "lb"])
    both = both.withColumn("raw_effect", F.col("m") - F.col("mu0") - F.col("ea") - F.col("eb"))
    cols = ["variables", "level", "n", "mu0", "sigma2", "raw_effect"]
    out = main.select(F.lit(1).alias("term_order"), *cols).unionByName(both.select(F.lit(2).alias("term_order"), *cols))
    return _weights(out, "variables", F.col("sigma2")).withColumn("posterior_effect", F.col("confidence") * F.col("raw_effect"))


def root_hierarchy(df: DataFrame, outcome: str) -> DataFrame:
    """Instrument means shrunk to the pool, under a strong prior of little difference."""
    data = df.dropna(subset=[outcome, "root"])
    whole = data.agg(F.avg(outcome).alias("pooled_mean"), F.var_samp(outcome).alias("sigma2"))
    x = data.groupBy("root").agg(F.count(outcome).alias("n"), F.avg(outcome).alias("raw_mean"))
    x = beside(x, whole).withColumn("raw_effect", F.col("raw_mean") - F.col("pooled_mean")).withColumn("q_all", F.lit(1))
    x = _weights(x, "q_all", F.col("sigma2")).withColumn("tau2_root", F.least("tau2", F.col("sigma2") / 100))
    c = F.when(F.col("tau2_root") > 0, F.col("n") * F.col("tau2_root") / (F.col("n") * F.col("tau2_root") + F.col("sigma2"))).otherwise(0.0)
    return x.withColumn("confidence", c).select("root", "n", "raw_mean", "pooled_mean", "tau2_root", "confidence", (F.col("pooled_mean") + F.col("confidence") * F.col("raw_effect")).alias("posterior_mean"))


def causal_posterior(df: DataFrame, cell: list[str], outcome: str = "outcome", available: str = "outcome_available_time") -> DataFrame:
    """Each trigger's cell mean, shrunk by what was known at its time: posterior_mean, confidence, prior_cell_n.

    df: event_id, timestamp, the cell's columns, the outcome and when it was there. An outcome that was there no later than its own trigger is never used. Shrinkage needs the spread of all cells' running means; an arriving outcome
    changes one cell's mean, so it changes the number of cells with two outcomes and more, their sum of means and of squared means, and their sum of 1 / n by differences that the cell alone knows. These are summed up
    by days first and inside each day, so no task sees more than one cell's outcomes or one day's events.
    """
    key = [F.col(c) for c in cell]
    used = df.where(F.col(outcome).isNotNull() & (F.col(available) > F.col("timestamp")))
    none = F.lit(None).cast("double")
    events = used.select(F.col(available).alias("q_at"), F.lit(0).alias("q_side"), "event_id", "timestamp", *key, F.col(outcome).cast("double").alias("q_y"))
    events = events.unionByName(df.select(F.col("timestamp").alias("q_at"), F.lit(1).alias("q_side"), "event_id", "timestamp", *key, none.alias("q_y")))
    order = ["q_at", "q_side", "event_id", "timestamp"]
    own = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    k, y = F.col("q_k"), F.col("q_y")
    x = events.withColumns({"q_k": F.count("q_y").over(own), "q_s": F.coalesce(F.sum("q_y").over(own), F.lit(0.0))})
    now, before = safe_div(F.col("q_s"), k), safe_div(F.col("q_s") - y, k - 1)
    came, grew = k == 2, k > 2
    change = lambda f: F.when(y.isNull(), 0.0).when(came, f(now, k)).when(grew, f(now, k) - f(before, k - 1)).otherwise(0.0)
    parts = {
        "q_n": F.when(y.isNull(), 0.0).otherwise(1.0), "q_total": F.coalesce(y, F.lit(0.0)), "q_square": F.coalesce(y * y, F.lit(0.0)),
        "q_cells": F.when(y.isNotNull() & came, 1.0).otherwise(0.0), "q_m1": change(lambda m, n: m), "q_m2": change(lambda m, n: m * m), "q_inv": change(lambda m, n: safe_div(F.lit(1.0), n)),
    }
    x = x.withColumns(parts).withColumn("q_day", F.to_date("q_at"))
    days = x.groupBy("q_day").agg(*[F.sum(c).alias(f"{c}_d") for c in parts])
    earlier = W.orderBy("q_day").rowsBetween(W.unboundedPreceding, -1)  # one row a day
    days = days.select("q_day", *[F.coalesce(F.sum(f"{c}_d").over(earlier), F.lit(0.0)).alias(f"{c}_d") for c in parts])
    inside = W.partitionBy("q_day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = x.join(days, "q_day").withColumns({c: F.col(f"{c}_d") + F.sum(c).over(inside) for c in parts}).where("q_side = 1")
    n, cells = F.col("q_n"), F.round("q_cells")
    mean = safe_div(F.col("q_total"), n)
    sigma2 = F.when(n > 1, F.greatest(safe_div(F.col("q_square") - F.col("q_total") * mean, n - 1), F.lit(1e-12))).otherwise(1.0)
    spread = safe_div(F.col("q_m2") - safe_div(F.col("q_m1") * F.col("q_m1"), cells), cells - 1) - safe_div(sigma2 * F.col("q_inv"), cells)
    tau2 = F.when(cells > 1, F.greatest(spread, F.lit(0.0))).otherwise(0.0)
    x = x.withColumns({"q_mean": mean, "q_sigma2": sigma2, "q_tau2": tau2})
    weight = F.when((k > 0) & (F.col("q_tau2") > 0), safe_div(k * F.col("q_tau2"), k * F.col("q_tau2") + F.col("q_sigma2"))).otherwise(0.0)
    posterior = F.when(n > 0, F.when(weight > 0, weight * safe_div(F.col("q_s"), k) + (1 - weight) * F.col("q_mean")).otherwise(F.col("q_mean")))
    return x.select("event_id", "timestamp", posterior.alias("posterior_mean"), F.when(n > 0, weight).otherwise(0.0).alias("confidence"), F.when(n > 0, k).otherwise(0).cast("int").alias("prior_cell_n"))


def quality_weight(mean: Column, se: Column, cost: Column, reliability: Column, qualified: Column, least: float = 0.6) -> Column:
    """How sure an edge clears its cost, times how sure its estimate is; never negative."""
    p = normal_cdf((mean - cost) / F.greatest(se, F.lit(1e-12)))
    return clip(reliability, 0.0, 1.0) * clip((p - least) / (1 - least), 0.0, 1.0) * qualified.cast("double")


def purged_splits(df: DataFrame, order: list[str], splits: int = 4, train: float = 0.4, embargo: int = 96) -> DataFrame:
    """(i, split, part): anchored training rows up to the embargo and the validation rows of each split. One row a timestamp is expected; rows are numbered in sorted ranges."""
    x, n = numbered_rows(df, order)
    first = -int(-n * train // 1)
    size = max((n - first) // splits, 1)
    spans = [(s, max(first + s * size - embargo, 0), first + s * size, n if s == splits - 1 else min(n, first + (s + 1) * size)) for s in range(splits)]
    i = F.col("i")
    parts = [F.struct(F.lit(s).alias("split"), F.when(i < stop, "train").when((i >= a) & (i < b), "validation").alias("part")) for s, stop, a, b in spans if stop > 0 and a < b]
    if not parts:
        return x.select("*", F.lit(None).cast("int").alias("split"), F.lit(None).cast("string").alias("part")).where(F.lit(False))
    return x.select("*", F.explode(F.array(*parts)).alias("q")).where("q.part IS NOT NULL").select(*x.columns, "q.split", "q.part")


def walk_forward(df: DataFrame, candidate: list[str], outcome: str, least: int = 150) -> DataFrame:
    """Fold and instrument consistency of parameter candidates."""
    data = df.dropna(subset=[*candidate, "fold", "root", outcome])
    fold = data.groupBy(*candidate, "fold").agg(F.avg(outcome).alias("m")).groupBy(*candidate).agg(F.percentile("m", 0.5).alias("median_fold_net"), F.avg((F.col("m") > 0).cast("double")).alias("positive_fold_rate"), F.stddev_samp("m").alias("fold_dispersion"))
    root = data.groupBy(*candidate, "root").agg(F.avg(outcome).alias("m")).groupBy(*candidate).agg(F.count_if(F.col("m") > 0).alias("positive_roots"), F.min("m").alias("worst_root_net"))
    out = data.groupBy(*candidate).agg(F.count("*").alias("triggers"), F.avg(outcome).alias("mean_net")).join(fold, candidate).join(root, candidate)
    ok = (F.col("triggers") >= least) & (F.col("median_fold_net") > 0) & (F.col("positive_fold_rate") >= 0.6) & (F.col("positive_roots") >= 2)
    return out.withColumn("base_pass", ok)


def plateau(summary: DataFrame, params: list[str], score: str = "median_fold_net", floor: float = 0.8) -> DataFrame:
    """Neighbours on the parameter grid (one level apart in one parameter) that keep most of a candidate's score."""
    ranked = summary.withColumns({f"q_{p}": F.dense_rank().over(W.orderBy(p)) for p in params})  # one row a candidate
    a, b = ranked.alias("a"), ranked.alias("b")
    apart = sum((F.abs(F.col(f"a.q_{p}") - F.col(f"b.q_{p}")) for p in params), F.lit(0)) == 1
    good = F.avg((F.col(f"b.{score}") >= floor * F.col(f"a.{score}")).cast("double"))
    near = a.join(b, apart).groupBy(*[F.col(f"a.{p}").alias(p) for p in params]).agg(F.count("*").alias("neighbor_count"), good.alias("q_rate"))
    out = summary.join(near, params, "left").withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0).cast("long")))
    out = out.withColumn("plateau_rate", F.when((F.col("neighbor_count") > 0) & (F.col(score) > 0), F.col("q_rate")).otherwise(0.0)).drop("q_rate")
    return out.withColumn("robust_pass", F.col("base_pass") & (F.col("neighbor_count") >= 2) & (F.col("plateau_rate") >= 0.5))


def drawdowns(df: DataFrame, by: list[str], order: str, ret: str) -> DataFrame:
    """max_drawdown, longest spell under water and rows from the trough to recovery (NULL if none)."""
    w = Bars(by, order)
    x = df.withColumn("q_w", F.exp(w.running(F.sum, F.coalesce(ret, F.lit(0.0))))).withColumn("q_i", w.number())
    x = x.withColumn("dd", F.col("q_w") / w.running(F.max, F.col("q_w")) - 1).withColumn("q_under", F.col("dd") < 0)
    x = x.withColumn("q_block", w.running(F.sum, F.when(F.col("q_under"), 0).otherwise(1)))
    spell = x.where("q_under").groupBy(*by, "q_block").agg(F.count("*").alias("k")).groupBy(*by).agg(F.max("k").alias("max_drawdown_duration"))
    trough = x.groupBy(*by).agg(F.min("dd").alias("max_drawdown"), F.min_by("q_i", F.struct("dd", "q_i")).alias("q_t"))
    back = x.join(trough, by).where((F.col("q_i") > F.col("q_t")) & (F.col("dd") >= 0)).groupBy(*by).agg(F.min(F.col("q_i") - F.col("q_t")).alias("recovery"))
    return trough.drop("q_t").join(spell, by, "left").join(back, by, "left").withColumn("max_drawdown_duration", F.coalesce("max_drawdown_duration", F.lit(0).cast("long")))


def performance(df: DataFrame, by: list[str], ret: str, year: int = 252, trials: int = 1) -> DataFrame:
    """Return, risk, tail, shape and Sharpe measures of a return series, with the Sharpe's non-normal error and its deflated probability."""
    x, n = F.col(ret), F.count(ret).cast("double")
    a = df.groupBy(*by).agg(
        n.alias("n"), F.sum(x).alias("s"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.percentile(x, F.array(F.lit(0.05), F.lit(0.01))).alias("q"),
        F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))).alias("down"), F.avg((x > 0).cast("double")).alias("hit_rate"), safe_div(F.avg(F.when(x > 0, x)), F.abs(F.avg(F.when(x < 0, x)))).alias("payoff_ratio"),
    )
    c = F.col
    skew = F.sqrt(c("n") * (c("n") - 1)) / (c("n") - 2) * c("g1")
    kurt = (c("n") - 1) / ((c("n") - 2) * (c("n") - 3)) * ((c("n") + 1) * c("g2") + 6)
    daily = safe_div(c("m"), c("sd"))
    se = F.sqrt(F.greatest(1 - skew * daily + (kurt + 2) * daily * daily / 4, F.lit(0.0)) / (c("n") - 1)) * year**0.5
    euler = 0.5772156649015329
    sr0 = F.lit(0.0) if trials <= 1 else se * ((1 - euler) * normal_quantile(F.lit(1 - 1 / trials)) + euler * normal_quantile(F.lit(1 - 1 / (trials * 2.718281828459045))))
    sharpe = daily * year**0.5
    return a.select(
        *by, (F.exp(c("s") * year / c("n")) - 1).alias("annualized_return"), (F.exp("s") - 1).alias("cumulative_return"), (c("sd") * year**0.5).alias("annualized_volatility"), (c("down") * year**0.5).alias("downside_volatility"),
        (-c("q")[0]).alias("var_95"), (-c("q")[1]).alias("var_99"), skew.alias("skewness"), kurt.alias("kurtosis"), safe_div(c("m") * year, c("down") * year**0.5).alias("sortino"), "hit_rate", "payoff_ratio",
        sharpe.alias("sharpe"), se.alias("sharpe_se"), (sharpe - 1.96 * se).alias("sharpe_ci_low"), (sharpe + 1.96 * se).alias("sharpe_ci_high"), normal_cdf(safe_div(sharpe - sr0, se)).alias("deflated_sharpe"),
    )


def log_loss(p: Column) -> Column:
    return -F.ln(clip(p, 1e-8, 1.0))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Reliability by equal-width bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_scores(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error, Brier score and log loss."""
    b = calibration(df, p, y, bins)
    ece = b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    yy = F.col(y).cast("double")
    return beside(ece, df.agg(F.avg(F.pow(F.col(p) - yy, F.lit(2))).alias("brier"), F.avg(log_loss(F.when(yy > 0, F.col(p)).otherwise(1 - F.col(p)))).alias("log_loss")))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance, from their contingency counts."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = F.col("n")
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    one = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs(n).alias(f"s_{k}"))
    x = beside(beside(cells.agg(pairs(n).alias("s"), F.sum("n").alias("t")), one(a)), one(b))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("t") * (F.col("t") - 1) / 2)
    return x.select(safe_div(F.col("s") - expected, (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected).alias("ari"))


def concentration(df: DataFrame, by: list[str], x: str, drops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Totals without the best days."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(x), "day"))
    return df.withColumn("r", r).groupBy(*by).agg(F.sum(x).alias("total"), *[F.sum(F.when(F.col("r") > k, F.col(x))).alias(f"without_{k}") for k in drops])
