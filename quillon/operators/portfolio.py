"""Fusion, sizing, policies, ledgers and the event backtest.

What needs only the row before is a window. Policies that carry a decision are step functions in a grouped map by series: a few floats of state, no history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, log, safe_div, true
from quillon.functions.windows import Bars, expanding_quantiles
from quillon.operators.stats import beside


def active_votes(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Each trigger's vote on the bars of its horizon, decaying linearly: num, den and horizon mass by (root, detector, bar).

    Triggers are exploded over their horizon and summed; nothing is carried from bar to bar.
    """
    at = bars.select("root", "timestamp").withColumn("i", Bars("root", "timestamp").number())
    fired = signals.where((F.col("direction") != 0) & (F.col("confidence") > 0) & (F.col("magnitude") > 0)).join(at, ["root", "timestamp"])
    spread = fired.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1))).withColumn("decay", 1 - F.col("k") / F.col("horizon"))
    p = F.col("confidence") * F.col("decay")
    votes = spread.groupBy("root", "detector", (F.col("i") + F.col("k")).alias("i")).agg(F.sum(p * F.col("direction") * F.col("magnitude") * F.col("gate_score")).alias("num"), F.sum(p).alias("den"), F.sum(p * F.col("horizon")).alias("mass"))
    return votes.join(at, ["root", "i"])


def dependence(signals: DataFrame, least: int = 25) -> DataFrame:
    """Direction correlation on joint triggers, and common-trigger rate, of each pair of detectors."""
    on = signals.where("direction <> 0").select("root", "timestamp", "detector", F.col("direction").cast("double").alias("d"))
    a, b = on.alias("a"), on.alias("b")
    joint = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.timestamp") == F.col("b.timestamp")) & (F.col("a.detector") < F.col("b.detector")))
    met = joint.groupBy(F.col("a.detector").alias("left"), F.col("b.detector").alias("right")).agg(F.count("*").alias("joint"), F.corr("a.d", "b.d").alias("rho"))
    n = on.groupBy("detector").agg(F.count("*").alias("n"))
    names = n.select(F.col("detector").alias("left"), F.col("n").alias("nl"))
    pairs = names.join(n.select(F.col("detector").alias("right"), F.col("n").alias("nr")), F.col("left") < F.col("right")).join(met, ["left", "right"], "left")
    j = F.coalesce("joint", F.lit(0))
    rho = F.when((j >= least) & F.col("rho").isNotNull() & ~F.isnan("rho"), F.col("rho")).otherwise(0.0)
    return pairs.select("left", "right", j.alias("joint"), rho.alias("rho"), (j / F.nullif(F.col("nl") + F.col("nr") - j, F.lit(0))).alias("common"))


def complete_linkage(names: list[str], rho: dict[tuple[str, str], float], threshold: float = 0.6) -> dict[str, int]:
    """Clusters of a handful of detectors in which every pair's |rho| is at least the threshold, merged closest first."""
    groups = [[n] for n in names]
    far = lambda a, b: max(1 - abs(rho.get((min(x, y), max(x, y)), 0.0)) for x in a for y in b)
    while len(groups) > 1:
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > 1 - threshold:
            break
        groups[i] += groups.pop(j)
    return {n: k for k, g in enumerate(sorted(groups, key=lambda g: min(map(names.index, g))), 1) for n in g}


def causal_clusters(signals: DataFrame, least: int = 25, threshold: float = 0.6) -> DataFrame:
    """day, detector, cluster, size: complete-linkage clusters of each day by the joint triggers of the days before, for every day that has signals.

    Joint triggers are summed by day and pair, the sums run on over days (a row for each day and pair of a few detectors), and each day's few pairs are clustered by themselves.
    """
    on = signals.where("direction <> 0").select("root", "timestamp", "detector", F.col("direction").cast("double").alias("d"))
    a, b = on.alias("a"), on.alias("b")
    joint = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.timestamp") == F.col("b.timestamp")) & (F.col("a.detector") < F.col("b.detector")))
    x, y = F.col("a.d"), F.col("b.d")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    each = joint.groupBy(F.to_date("a.timestamp").alias("day"), F.col("a.detector").alias("left"), F.col("b.detector").alias("right")).agg(*[v.alias(k) for k, v in sums.items()])
    days, names = signals.select(F.to_date("timestamp").alias("day")).distinct(), signals.select("detector").distinct()
    pairs = names.select(F.col("detector").alias("left")).join(names.select(F.col("detector").alias("right")), F.col("left") <= F.col("right"))
    past = W.partitionBy("left", "right").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    table = pairs.join(days, F.lit(True))  # a row for each day and pair of a few detectors
    table = table.join(each, ["day", "left", "right"], "left").select("day", "left", "right", *[F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(c) for c in sums])
    c = F.col
    rho = (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt((c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy")))
    free = (c("n") * c("sxx") > c("sx") * c("sx")) & (c("n") * c("syy") > c("sy") * c("sy"))
    table = table.select("day", "left", "right", F.when((c("n") >= least) & free, F.round(rho, 9)).otherwise(0.0).alias("rho"))  # rounded, so that ties are ties

    def cluster(pdf):
        import pandas as pd

        found = complete_linkage(sorted(set(pdf["left"]) | set(pdf["right"])), dict(zip(zip(pdf["left"], pdf["right"]), pdf["rho"])), threshold)
        size = pd.Series(found).value_counts()
        return pd.DataFrame([(pdf["day"].iloc[0], n, k, int(size[k])) for n, k in found.items()], columns=["day", "detector", "cluster", "size"])

    return table.groupBy("day").applyInPandas(cluster, "day date, detector string, cluster int, size int")


def fuse(votes: DataFrame, bars: DataFrame, clusters: DataFrame, tau: float = 0.5) -> DataFrame:
    """mu = sum of numerators / (sum of weights + tau), with the detectors of a day's cluster averaged first. clusters: what ``causal_clusters`` gives."""
    v = votes.withColumn("day", F.to_date("timestamp")).join(clusters, ["day", "detector"])
    v = v.groupBy("root", "timestamp", "cluster").agg(*[(F.sum(c) / F.first("size")).alias(c) for c in ("num", "den", "mass")])
    total = v.groupBy("root", "timestamp").agg(*[F.sum(c).alias(c) for c in ("num", "den", "mass")], F.count("*").cast("int").alias("active_clusters"))
    x = bars.select("root", "timestamp").join(total, ["root", "timestamp"], "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select("root", "timestamp", (z("num") / (z("den") + tau)).alias("mu"), F.coalesce(safe_div(F.col("mass"), F.col("den")), F.lit(1.0)).alias("active_horizon"), z("den").alias("confidence_mass"), F.coalesce("active_clusters", F.lit(0)).alias("active_clusters"))


def size_targets(
    df: DataFrame, bars_a_year: float, vol: float = 0.10, eta: float = 0.25, most: float = 2.0, bet_share: float = 0.25, sigma_breaker: float = 0.99, spread_breaker: float = 0.95, least: int = 100, brake: float = 0.3, zeta: float = 0.05
) -> DataFrame:
    """target, band and breaker from mu and the state: volatility target, bet cap, breakers by volatility and lagged expanding spread quantile, cost band."""
    sigma, h = F.col("sigma_hat"), F.greatest("active_horizon", F.lit(1.0))
    annual = sigma * bars_a_year**0.5
    raw = clip(F.when(annual > 0, vol / annual).otherwise(0.0) * F.tanh(F.col("mu") / eta), -most, most)
    cap = bet_share * vol / 252**0.5 / F.greatest(sigma * F.sqrt(h), F.lit(1e-12))
    x = df.withColumns({"q_raw": F.when(raw.isNotNull(), F.greatest(F.least(raw, cap), -cap)), "sigma_ann": annual})
    x = expanding_quantiles(x, ["root"], ["timestamp"], "spread_bp", {"q_limit": spread_breaker}, least)
    breaker = true(F.col("sigma_pct") > sigma_breaker) | true(F.col("spread_bp") > F.col("q_limit"))
    band = F.least(zeta * F.sqrt(F.greatest("spread_bp", F.lit(0.0)) * 1e-4 / F.greatest(F.pow(sigma, F.lit(2)) * h, F.lit(1e-12))), F.lit(most))
    return x.withColumns({"breaker": breaker, "target": F.col("q_raw") * F.when(breaker, brake).otherwise(1.0), "band": band}).drop("q_raw", "q_limit")


def scale_portfolio(targets: DataFrame, correlations: DataFrame, vol: float = 0.10, same_side: float = 5.0) -> DataFrame:
    """Targets scaled to at most the portfolio volatility and a cap on the gross of either side.

    targets: root, timestamp, target, sigma_ann; correlations: a, b, corr (both orders and the diagonal), a table of a few instruments.
    """
    a = targets.select("timestamp", F.col("root").alias("a"), (F.col("target") * F.col("sigma_ann")).alias("xa"))
    b = targets.select("timestamp", F.col("root").alias("b"), (F.col("target") * F.col("sigma_ann")).alias("xb"))
    var = a.join(b, "timestamp").join(correlations, ["a", "b"]).groupBy("timestamp").agg(F.sum(F.col("xa") * F.col("xb") * F.col("corr")).alias("q_var"))
    side = targets.groupBy("timestamp").agg(F.sum(F.greatest("target", F.lit(0.0))).alias("q_long"), F.sum(F.greatest(-F.col("target"), F.lit(0.0))).alias("q_short"))
    x = targets.join(var, "timestamp", "left").join(side, "timestamp", "left")
    scale = F.least(F.lit(1.0), F.coalesce(safe_div(F.lit(vol), F.sqrt(F.greatest("q_var", F.lit(0.0)))), F.lit(1.0)))
    capped = F.least(F.lit(1.0), F.coalesce(safe_div(F.lit(same_side), F.when(F.col("target") > 0, F.col("q_long")).otherwise(F.col("q_short"))), F.lit(1.0)))
    return x.withColumn("target", F.col("target") * scale * capped).drop("q_var", "q_long", "q_short")


def ledger(weights: DataFrame, fee_bp: float, order: str = "timestamp") -> DataFrame:
    """Marked-to-market account of target weights: turnover against drifted weights, gross and net return and wealth, by time.

    weights: timestamp, root, weight, simple (the asset's return until the next row). The drift needs only the row before, so it is a lag.
    """
    gross = weights.groupBy(order).agg(F.sum(F.col("weight") * F.col("simple")).alias("gross_return"))
    w = Bars("root", order)
    x = weights.join(gross, order).withColumn("q_drift", F.coalesce(w.lag(F.col("weight") * (1 + F.col("simple")) / (1 + F.col("gross_return"))), F.lit(0.0)))
    each = x.groupBy(order).agg(F.first("gross_return").alias("gross_return"), F.sum(F.abs(F.col("weight") - F.col("q_drift"))).alias("turnover"))
    each = each.withColumn("net_return", (1 - F.col("turnover") * fee_bp / 1e4) * (1 + F.col("gross_return")) - 1)
    run = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # one row a time
    return each.withColumns({"gross_wealth": F.exp(F.sum(F.log1p("gross_return")).over(run)), "net_wealth": F.exp(F.sum(F.log1p("net_return")).over(run))})


def buy_and_hold(prices: DataFrame, order: str = "timestamp") -> DataFrame:
    """Equal money in every asset at the start, never rebalanced."""
    w = Bars("root", order)
    x = prices.withColumn("rel", F.col("price") / F.first("price").over(w.w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(order).agg(F.avg("rel").alias("wealth"))


def strategy_costs(df: DataFrame, costs_bp: list[float], position: str = "position", ret: str = "ret") -> DataFrame:
    """Daily net results of positions at several costs a side."""
    w = Bars("root", "timestamp")
    x = df.withColumn("q_turn", F.abs(F.col(position) - F.coalesce(w.lag(F.col(position)), F.lit(0.0))))
    x = x.withColumn("cost_bp", F.explode(F.array(*[F.lit(float(c)) for c in costs_bp])))
    net = F.col(position) * F.col(ret) - F.col("q_turn") * F.col("cost_bp") / 1e4
    return x.groupBy("cost_bp", F.to_date("timestamp").alias("day")).agg(F.sum(net).alias("net"), F.sum(F.col(position) * F.col(ret)).alias("gross"), F.sum("q_turn").alias("turnover"))


def hysteresis_step(value: float, old: int, enter: float, leave: float) -> int:
    """A sign beyond ``enter`` is taken; a held one lasts while it is beyond ``leave`` on its side."""
    if abs(value) >= enter:
        return 1 if value > 0 else -1
    return old if old * value > leave else 0


def held_sign(df: DataFrame, by: list[str], order: list[str], value: str, enter: float, leave: float, out: str = "position") -> DataFrame:
    """The policy of ``hysteresis_step`` along each series, in the JVM: a fold over the series' ordered values with one integer of state.

    Signs beyond ``enter`` reset the state, so a fold is needed only between them: the state is the last reset, if no value since then was at or below ``leave`` on its side.
    """
    w, v = Bars(by, order), F.col(value)
    reset = F.when(F.abs(v) >= enter, F.signum(v))
    x = df.withColumn("q_reset", w.ffill(reset)).withColumn("q_k", w.running(F.sum, F.when(reset.isNotNull(), 1).otherwise(0)))
    s = Bars([*by, "q_k"], order)
    broken = s.running(F.max, F.when(true(F.abs(v) >= enter) | true(F.col("q_reset") * v > leave), 0).otherwise(1))
    return x.withColumn(out, F.coalesce(F.when(broken == 0, F.col("q_reset")), F.lit(0.0)).cast("int")).drop("q_reset", "q_k")


def thin_events(df: DataFrame, by: list[str], at: str, gap_seconds: int) -> DataFrame:
    """The first event of each refractory gap, in time order. A key's distinct times, sorted, are jumped through by binary search, a step for each event that is kept; only times travel."""

    def keep(pdf):
        import numpy as np

        t, i, kept = np.sort(pdf["q_at"].to_numpy()), 0, []
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + gap_seconds))
        return pdf[by].iloc[:1].loc[np.zeros(len(kept), int) + pdf.index[0]].reset_index(drop=True).assign(q_at=t[kept])

    marked = df.withColumn("q_at", F.unix_timestamp(at))
    times = marked.select(*by, "q_at").where("q_at IS NOT NULL").distinct()
    found = times.groupBy(*by).applyInPandas(keep, times.schema)
    first = F.row_number().over(W.partitionBy(*by, "q_at").orderBy(at))
    return marked.join(found, [*by, "q_at"]).withColumn("q_r", first).where("q_r = 1").drop("q_at", "q_r")


def best_pairs(scores: DataFrame) -> DataFrame:
    """For each time the ordered pair with the best forecast of the weights that would be held. scores: timestamp, root, score, beta of a few instruments; ties go to the first names."""
    a = scores.select("timestamp", F.col("root").alias("long"), F.col("score").alias("sa"), F.col("beta").alias("ba"))
    b = scores.select("timestamp", F.col("root").alias("short"), F.col("score").alias("sb"), F.col("beta").alias("bb"))
    x = a.join(b, "timestamp").where("long <> short").withColumn("pair_score", (F.col("bb") * F.col("sa") - F.col("ba") * F.col("sb")) / (F.col("ba") + F.col("bb")))
    r = F.row_number().over(W.partitionBy("timestamp").orderBy(F.desc("pair_score"), "long", "short"))
    return x.withColumn("r", r).where("r = 1").select("timestamp", "long", "short", "pair_score", (F.col("bb") / (F.col("ba") + F.col("bb"))).alias("long_weight"), (-F.col("ba") / (F.col("ba") + F.col("bb"))).alias("short_weight"))


def event_backtest(df: DataFrame, delay: int = 1, edge: int = 2, roll_bars: int = 3, cost_multiplier: float = 1.5, participation: float = 0.05, price: str = "wap") -> DataFrame:
    """Decisions at the close, fills at the benchmark of a later bar that is valid and away from rolls.

    df: root, timestamp, close, the benchmark column, ret, overnight_ret, is_valid, bar_in_session, session_id, is_roll_boundary, volume, target, band, signal_active, round_trip_cost_bp. The newest
    decision whose delay has passed is the order; it fills now or waits. Near session edges no order may open risk. The band holds an active signal's small changes back, and the volume
    caps a fill. The old position earns up to the fill and the new one after it; a roll costs a round trip of what is carried. Everything but the position itself is columns;
    the position is a fold with one float of state, in a grouped map by instrument.
    """
    w = Bars("root", "timestamp")
    s = W.partitionBy("root", "session_id")
    near = F.max(F.when(F.col("is_roll_boundary"), 1).otherwise(0)).over(w.frame(-roll_bars, roll_bars)) == 1
    last = F.max("bar_in_session").over(s)
    x = df.withColumns({
        "q_total": F.coalesce("ret", "overnight_ret", F.lit(0.0)), "q_target": w.lag(F.coalesce("target", F.lit(0.0)), delay), "q_band": w.lag(F.coalesce("band", F.lit(0.0)), delay), "q_active": w.lag(true(F.col("signal_active")), delay),
        "q_trade": true(F.col("is_valid")) & ~near, "q_edge": (F.col("bar_in_session") < edge) | (F.col("bar_in_session") > last - edge), "q_cap": participation * F.coalesce("volume", F.lit(0.0)),
    })

    def walk(pdf):
        pdf = pdf.sort_values("timestamp", kind="stable")
        held, olds, news, limited = 0.0, [], [], []
        waiting = None
        for target, band, active, trade, at_edge, cap in zip(pdf["q_target"], pdf["q_band"], pdf["q_active"], pdf["q_trade"], pdf["q_edge"], pdf["q_cap"]):
            old, short = held, False
            if target == target and target is not None:
                waiting = (target, band, active)
            if waiting and trade:
                want, band, active = waiting
                move = want - old
                opens = abs(want) > abs(old) + 1e-12 or old * want < 0
                if opens and at_edge or active and abs(move) <= band:
                    move = 0.0
                if abs(move) > cap:
                    move, short = (cap if move > 0 else -cap), True
                held = old + move
                waiting = None
            olds.append(old)
            news.append(held)
            limited.append(short)
        return pdf[["root", "timestamp"]].assign(q_old=olds, position=news, volume_limited=limited)

    moved = x.select("root", "timestamp", "q_target", "q_band", "q_active", "q_trade", "q_edge", "q_cap").groupBy("root").applyInPandas(walk, "root string, timestamp timestamp, q_old double, position double, volume_limited boolean")
    x = x.join(moved, ["root", "timestamp"])
    old, new, cost = F.col("q_old"), F.col("position"), F.col("round_trip_cost_bp") * 1e-4 * cost_multiplier
    after = F.when((old != new) & (F.col(price) > 0) & (F.col("close") > 0), log(F.col("close") / F.col(price)))
    gross = F.when(after.isNotNull(), old * (F.col("q_total") - after) + new * after).otherwise(old * F.col("q_total"))
    rolled = F.when(F.col("is_roll_boundary"), F.abs(old)).otherwise(0.0)
    paid = F.coalesce(0.5 * cost * F.abs(new - old) + cost * rolled, F.lit(0.0))
    out = x.withColumns({"gross_return": gross, "cost": paid, "turnover": F.abs(new - old) + 2 * rolled, "executed": old != new})
    return out.select("root", "timestamp", "session_id", "position", "gross_return", "cost", (F.col("gross_return") - F.col("cost")).alias("net_return"), "turnover", "executed", "volume_limited")


def daily_portfolio(backtest: DataFrame) -> DataFrame:
    """Instrument rows to portfolio days."""
    return backtest.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("gross_return").alias("gross"), F.sum("cost").alias("cost"), F.sum("net_return").alias("net"), F.sum("turnover").alias("turnover"), F.count_if("executed").alias("fills"))


def cost_measures(backtest: DataFrame, year: int = 252) -> DataFrame:
    """One row: what the trades of a backtest cost against what they earn. Ratios are null where their base is not positive; the yearly volatility is that of daily net returns."""
    days = daily_portfolio(backtest).agg((F.avg("turnover") * year).alias("annualized_turnover"), (F.stddev_samp("net") * year**0.5).alias("q_vol"))
    x = backtest.agg(
        F.sum("gross_return").alias("gross"), F.sum("cost").alias("total_cost"), F.count_if("executed").alias("executions"), F.sum("turnover").alias("q_t"), F.avg(F.col("volume_limited").cast("double")).alias("volume_limited_fraction"),
        F.avg((F.col("position") != 0).cast("double")).alias("active_bar_fraction"), F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))).alias("mean_trade_size"),
    )
    x = beside(x, days)
    over = lambda base: F.col("total_cost") / F.when(F.col(base) > 0, F.col(base))
    return x.select("gross", "total_cost", over("gross").alias("cost_to_gross"), "annualized_turnover", "executions", (over("q_t") * 1e4).alias("cost_per_turnover_bp"), over("q_vol").alias("cost_to_volatility"), "volume_limited_fraction", "active_bar_fraction", "mean_trade_size")


def holding_periods(backtest: DataFrame) -> DataFrame:
    """Spells of one sign of the position: instrument, side, bars."""
    from quillon.functions.windows import runs

    x = runs(backtest.withColumn("side", F.signum("position").cast("int")), ["root"], ["timestamp"], "side").where("side <> 0")
    return x.groupBy("root", "run", "side").agg(F.count("*").alias("bars"), F.min("timestamp").alias("opened"))


def day_shares(daily: DataFrame, value: str) -> DataFrame:
    """Each day's share of the total."""
    return beside(daily, daily.agg(F.sum(value).alias("q_total"))).withColumn("share", safe_div(F.col(value), F.col("q_total"))).drop("q_total")
