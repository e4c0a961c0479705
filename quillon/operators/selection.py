"""Choosing and judging: candidates, hold-outs, gates, paired intervals, rejection by radius, soft region tables, reliability weights, market positions and slow coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, log, safe_div, true, uniform
from quillon.functions.windows import Bars
from quillon.operators.stats import beside, numbered


def add_path(df: DataFrame, names: list[str], steps: int) -> DataFrame:
    """Each column's value ``steps`` rows before, as name__lag, and the change since, as name__delta."""
    w = Bars("root", "timestamp")
    before = {n: w.lag(F.col(n), steps) for n in names}
    return df.withColumns({f"{n}__lag": b for n, b in before.items()} | {f"{n}__delta": F.col(n) - b for n, b in before.items()})


def annualised(draws: DataFrame, year: int = 252) -> DataFrame:
    """Annual return and Sharpe of bootstrap draws that have a mean and an sd."""
    return draws.withColumns({"annualized_return": F.exp(F.col("mean") * year) - 1, "sharpe": safe_div(F.col("mean"), F.when(F.col("sd") > 0, F.col("sd"))) * year**0.5})


def select_candidate(summary: DataFrame, passed: str, params: list[str]) -> DataFrame:
    """The best of the candidates that passed: by fold median, share of positive folds, worst instrument, then parameters. No row if none passed."""
    order = [F.desc(c) for c in ("median_fold_net", "positive_fold_rate", "worst_root_net")]
    return summary.where(passed).orderBy(*order, *params).limit(1)


def day_reliability(events: DataFrame, by: list[str], value: str, time: str = "timestamp", full: int = 150, noise: float = 0.0005, faded: float = 0.2) -> DataFrame:
    """by, mean, sem (of the daily means), recent (mean of the later half by the median time), events, days, reliability.

    Reliability is the positive part of the mean over itself, its error and ``noise``, in proportion to the events below ``full``, and times ``faded`` where the recent mean isn't positive. It is 0 with one day, and never negative: bad evidence isn't turned round.
    """
    x = events.where(F.col(value).isNotNull()).withColumn("q_t", F.unix_micros(F.col(time).cast("timestamp_ltz")))
    daily = x.groupBy(*by, F.to_date(time).alias("q_d")).agg(F.avg(value).alias("q_m")).groupBy(*by).agg((F.stddev_samp("q_m") / F.sqrt(F.count("*").cast("double"))).alias("sem"), F.count("*").alias("days"))
    middle = x.groupBy(*by).agg(F.percentile("q_t", 0.5).alias("q_mid"), F.avg(value).alias("mean"), F.count("*").alias("events"))
    recent = x.join(middle.select(*by, "q_mid"), by).where("q_t >= q_mid").groupBy(*by).agg(F.avg(value).alias("recent"))
    out = middle.join(daily, by).join(recent, by)
    base = F.greatest("mean", F.lit(0.0)) / (F.abs("mean") + F.col("sem") + noise) * F.least(F.lit(1.0), F.col("events") / full)
    value_of = F.when(F.col("days") > 1, base * F.when(F.col("recent") <= 0, faded).otherwise(1.0)).otherwise(0.0)
    return out.withColumn("sem", F.when(F.col("days") > 1, F.col("sem"))).withColumn("reliability", value_of).select(*by, "mean", "sem", "recent", "events", "days", "reliability")


def leave_one_out(triggers: DataFrame, outcome: str) -> DataFrame:
    """For each instrument its mean, the mean of all others and the whole mean, and how much of the whole it keeps."""
    each = triggers.groupBy("root").agg(F.count(outcome).alias("n"), F.sum(outcome).alias("s"))
    x = beside(each, triggers.agg(F.count(outcome).alias("q_n"), F.sum(outcome).alias("q_s")))
    mean, rest, full = safe_div(F.col("s"), F.col("n")), safe_div(F.col("q_s") - F.col("s"), F.col("q_n") - F.col("n")), safe_div(F.col("q_s"), F.col("q_n"))
    return x.select(F.col("root").alias("holdout_root"), mean.alias("holdout_mean"), rest.alias("development_mean"), full.alias("full_mean"), F.when(full > 0, mean / full).alias("loi_ratio"))


def gate_table(triggers: DataFrame, detector: str, outcome: str, net: str, roots: list[str], nulls: DataFrame, stability: DataFrame, least: int, least_root: int, least_positive: int = 2, single: dict[str, str] | None = None, least_stability: float = 0.6,
               least_percentile: float = 0.95) -> DataFrame:
    """One row a detector: triggers, least triggers and positive means among ``roots``, share of the ten fullest sessions, stability, null percentile, and the gates on them.

    Every instrument of ``roots`` must have ``least_root`` triggers; one that has none has 0. A detector in ``single`` is judged by that one instrument's number (``least``) and mean alone. nulls: detector, draw, mean of
    matched draws, of which ``least_percentile`` must be at or below the actual mean; stability: detector, stability (null counts as failed).
    """
    c, lone = F.col, single or {}
    names = triggers.select(detector).distinct()
    each = triggers.groupBy(detector, "root").agg(F.count("*").alias("n"), F.avg(outcome).alias("m"))
    grid = names.withColumn("root", F.explode(F.array(*[F.lit(r) for r in roots]))).join(each, [detector, "root"], "left")
    root = grid.groupBy(detector).agg(F.min(F.coalesce("n", F.lit(0))).alias("least_root"), F.count_if(c("m") > 0).alias("positive_roots"))
    one = F.create_map(*[F.lit(v) for kv in lone.items() for v in kv]) if lone else F.lit(None)
    own = each.where(c("root") == one[c(detector)]).select(detector, c("n").alias("q_n"), c("m").alias("q_m")) if lone else names.select(detector, F.lit(None).cast("long").alias("q_n"), F.lit(None).cast("double").alias("q_m"))
    session = triggers.groupBy(detector, "session_id").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy(detector).orderBy(F.desc("n"), "session_id"))
    top = session.withColumn("r", first).groupBy(detector).agg(F.sum(F.when(c("r") <= 10, c("n")).otherwise(0)).alias("q_top"))
    x = triggers.groupBy(detector).agg(F.count("*").alias("triggers"), F.avg(outcome).alias("mean_z"), F.avg(net).alias("mean_net")).join(root, detector).join(top, detector).join(own, detector, "left")
    below = nulls.join(x.select(detector, c("mean_z").alias("q_z")), detector).groupBy(detector).agg(F.avg((c("mean") <= c("q_z")).cast("double")).alias("null_percentile"))
    x = x.join(below, detector, "left").join(stability.select(detector, "stability"), detector, "left")
    alone = c(detector).isin(*lone) if lone else F.lit(False)
    gates = {
        "trigger_gate": F.when(alone, F.coalesce("q_n", F.lit(0)) >= least).otherwise((c("triggers") >= least) & (c("least_root") >= least_root)), "sign_gate": F.when(alone, true(c("q_m") > 0)).otherwise(c("positive_roots") >= least_positive),
        "stability_gate": true(c("stability") >= least_stability), "null_gate": true(c("null_percentile") >= least_percentile), "net_gate": true(c("mean_net") > 0),
    }
    x = x.withColumns(gates | {"top10_session_share": c("q_top") / c("triggers")})
    return x.withColumn("passed", c("trigger_gate") & c("sign_gate") & c("stability_gate") & c("null_gate") & c("net_gate")).drop("q_top", "q_n", "q_m")


def block_sums(daily: DataFrame, values: list[str], day: str, block: int, draws: int, seed: int) -> DataFrame:
    """draw and the sums of ``values`` over circular blocks of days; every key of a draw sees the same days. daily: one row a day."""
    base = numbered(daily.withColumn("q_all", F.lit("all")), ["q_all"], [day])
    spread = base.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    start = F.floor(uniform(F.lit(seed), F.lit("days"), F.col("draw"), F.expr(f"i div {block}")) * F.col("n")).cast("long")
    picked = spread.select("draw", ((start + F.col("i") % block) % F.col("n")).alias("i"))
    return picked.join(base.select("i", *values), "i").groupBy("draw").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("days"))


def paired_interval(df: DataFrame, a: str, b: str, day: str, block: int, draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Mean daily difference of two scores and its interval by blocks of days."""
    daily = df.groupBy(day).agg((F.avg(a) - F.avg(b)).alias("d"))
    sums = block_sums(daily, ["d"], day, block, draws, seed)
    q = F.percentile(F.col("d") / F.col("days"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return beside(daily.agg(F.avg("d").alias("mean")), sums.agg(q[0].alias("low"), q[1].alias("high")))


def state_intervals(df: DataFrame, state: str, value: str, day: str, block: int, draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Each state's mean with an interval by blocks of days at alpha over the number of states (Bonferroni), and its largest instrument's share.

    Days without rows of a state count with sum and number zero; draws without any row of it have no mean.
    """
    states = [r[0] for r in df.select(state).distinct().orderBy(state).collect()]  # a few tens
    cells = [a for i, s in enumerate(states) for a in (F.coalesce(F.sum(F.when(F.col(state) == s, F.col(value))), F.lit(0.0)).alias(f"s{i}"), F.count(F.when(F.col(state) == s, F.col(value))).alias(f"n{i}"))]
    daily = df.groupBy(day).agg(*cells)
    sums = block_sums(daily, [f"{k}{i}" for i in range(len(states)) for k in "sn"], day, block, draws, seed)
    means = F.array(*[F.struct(F.lit(s).alias(state), safe_div(F.col(f"s{i}"), F.col(f"n{i}").cast("double")).alias("m")) for i, s in enumerate(states)])
    share = alpha / max(len(states), 1) / 2
    q = F.percentile("m", F.array(F.lit(share), F.lit(1 - share)))
    bands = sums.select(F.explode(means).alias("x")).select("x.*").groupBy(state).agg(q[0].alias("low"), q[1].alias("high"))
    largest = df.groupBy(state, "root").agg(F.count(value).alias("n")).groupBy(state).agg((F.max("n") / F.sum("n")).alias("largest_share"))
    own = df.groupBy(state).agg(F.count(value).alias("rows"), F.count_distinct(day).alias("days"), F.avg(value).alias("mean"))
    return own.join(bands, state).join(largest, state)


def flatness(df: DataFrame, slot: str, value: str, least: int) -> DataFrame:
    """Range of the slot means over their mean, by instrument, of slots with enough rows: 0 where the day's shape is gone."""
    curve = df.where(F.col(value).isNotNull()).groupBy("root", slot).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where(F.col("n") >= least)
    return curve.groupBy("root").agg(((F.max("m") - F.min("m")) / F.avg("m")).alias("range_over_mean"), F.count("*").alias("slots"))


def market_weights(df: DataFrame, by: list[str], order: str, score: str, enter: float, leave: float, names: int, risk: Column | None = None) -> DataFrame:
    """df with ``weight``: a held sign of the score, shared equally by ``names`` instruments and given up where ``risk`` is true. leave must not be negative.

    As in ``held_sign`` the state is the last reset (a strong score, or a risk that empties it) unless a value since then let it go.
    """
    v, w = F.col(score), Bars(by, order)
    off = true(risk) if risk is not None else F.lit(False)
    reset = F.when(off, 0.0).when(F.abs(v) >= enter, F.signum(v))
    x = df.withColumn("q_reset", w.ffill(reset)).withColumn("q_k", w.running(F.sum, F.when(reset.isNotNull(), 1).otherwise(0)))
    broken = Bars([*by, "q_k"], order).running(F.max, F.when(reset.isNotNull() | true(F.col("q_reset") * v > leave), 0).otherwise(1))
    return x.withColumn("weight", F.coalesce(F.when(broken == 0, F.col("q_reset")), F.lit(0.0)) / names + F.lit(0.0)).drop("q_reset", "q_k")


def knot_shares(knots: Column) -> Column:
    """Array of (value, share) of ascending knots at equal steps: each value once, tied knots at the middle of their shares; one value alone is at 0.5."""
    n = F.size(knots)
    last = lambda v: n - F.array_position(F.reverse(knots), v)
    one = F.size(F.array_distinct(knots)) == 1
    share = lambda v: F.when(one, 0.5).otherwise((F.array_position(knots, v) - 1 + last(v)) / 2 / (n - 1))
    return F.transform(F.array_distinct(knots), lambda v: F.struct(v.alias("v"), share(v).alias("p")))


def frozen_mid_rank(x: Column, table: Column) -> Column:
    """Linear between the table's points, its end shares outside, 0.5 for a missing value. table: what ``knot_shares`` gives."""
    below, above = F.filter(table, lambda k: k.v <= x), F.filter(table, lambda k: k.v >= x)
    low, high = F.element_at(below, -1), F.element_at(above, 1)
    inside = F.when(low.v == high.v, low.p).otherwise(low.p + safe_div(x - low.v, high.v - low.v) * (high.p - low.p))
    return F.when(x.isNull(), 0.5).when(F.size(below) == 0, F.element_at(table, 1).p).when(F.size(above) == 0, F.element_at(table, -1).p).otherwise(inside)


def dynamic_weights(df: DataFrame, prior: dict[str, float], outcome: str, time: str, near: float = 0.08, least: int = 100, scale: float = 0.001) -> DataFrame:
    """name, weight: prior weights of distance columns, raised where the nearest rows' outcome beats the mean in both halves of time. 0.75 and 0.5 of the weight, the share 0.08, the scale 0.001."""
    half = beside(df.withColumn("q_t", F.unix_timestamp(time)), df.agg(F.percentile(F.unix_timestamp(time), 0.5).alias("q_mid"))).withColumn("q_early", F.col("q_t") < F.col("q_mid"))
    long = half.where(F.col(outcome).isNotNull()).select("q_early", F.col(outcome).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("prior"), F.col(n).alias("d")) for n, w in prior.items()])).alias("g"))
    long = long.select("q_early", "y", "g.*")
    limit = long.groupBy("name", "q_early").agg(F.percentile("d", near).alias("q_d"), F.avg("y").alias("q_m"), F.count("*").alias("q_n"))
    close = long.join(limit, ["name", "q_early"]).groupBy("name", "prior", "q_early").agg(F.when(F.first("q_n") >= least, F.avg(F.when(F.col("d") <= F.col("q_d"), F.col("y"))) - F.first("q_m")).otherwise(0.0).alias("lift"))
    both = close.groupBy("name", "prior").agg(F.when(F.count("*") == 2, F.greatest(F.min("lift"), F.lit(0.0))).otherwise(0.0).alias("q_p"))
    return both.select("name", (F.col("prior") * (0.75 + 0.5 * F.tanh(F.col("q_p") / scale))).alias("weight"))


def radii(member: DataFrame, state: str = "state", distance: str = "distance", q: float = 0.9) -> DataFrame:
    """state, radius: the quantile of the members' distances, beyond which a row is no member."""
    return member.groupBy(state).agg(F.percentile(distance, q).alias("radius"))


def predict_states(member: DataFrame, radius: DataFrame, table: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """key, state, accepted, label, probability: the state's distribution within its radius, the background's beyond it or where a state has no radius.

    table: state, label, probability; background: label, probability.
    """
    x = member.select(key, "state", "distance").join(radius, "state", "left").withColumn("accepted", true(F.col("distance") <= F.col("radius")))
    own = x.where("accepted").join(table, "state").select(key, "state", "accepted", "label", "probability")
    rest = x.where("NOT accepted").join(F.broadcast(background), F.lit(True)).select(key, "state", "accepted", "label", "probability")  # a row a label
    return own.unionByName(rest)


def region_probabilities(weights: DataFrame, rows: DataFrame, key: str, classes: int, strength: float) -> DataFrame:
    """region, label, probability from soft memberships: weighted label counts, shrunk to the labels' own shares (smoothed by one).

    weights: key, region, weight; rows: key, label.
    """
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label")).join(n, "label", "left")
    back = beside(grid, rows.agg(F.count("*").alias("q_all"))).select("label", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("q_all") + classes)).alias("background"))
    met = weights.join(rows, key)
    total = weights.join(rows.select(key), key).groupBy("region").agg(F.sum("weight").alias("total"))
    seen = met.groupBy("region", "label").agg(F.sum("weight").alias("w"))
    x = total.join(F.broadcast(back), F.lit(True)).join(seen, ["region", "label"], "left")  # a row for each region and label
    return x.select("region", "label", ((F.coalesce("w", F.lit(0.0)) + strength * F.col("background")) / (F.col("total") + strength)).alias("probability"))


def slow_coordinates(df: DataFrame, short: int, long: int, day: int = 24) -> DataFrame:
    """Slow position of each instrument and of the market: relative moves over two horizons against past beta, signed efficiency, market trends and the ratio of variances.

    df: root, timestamp, lc (log price), rv, beta. Every instrument is expected at every time; the market is the mean of those that are there. Fixed values: the bounds 5, 1 and 3, the floors 1e-9 and 1e-8.
    """
    t, w, c = W.partitionBy("timestamp"), Bars("root", "timestamp"), F.col
    x = df.withColumns({"q_rv": F.greatest("rv", F.lit(1e-9)), "q_m": F.avg("lc").over(t), "q_mrv": F.greatest(F.avg("rv").over(t), F.lit(1e-9)), "q_r": F.abs(w.diff(c("lc")))})
    out = {}
    for h, name in ((short, "short"), (long, "long")):
        move = w.diff(c("q_m"), h)
        out[f"relative_{name}"] = clip((w.diff(c("lc"), h) - c("beta") * move) / F.sqrt(c("q_rv") * h / day), -5.0, 5.0)
        out[f"market_trend_{name}"] = clip(move / F.sqrt(c("q_mrv") * h / day), -5.0, 5.0)
    out["signed_efficiency"] = clip(w.diff(c("lc"), short) / F.greatest(w.sum(c("q_r"), short), F.lit(1e-8)), -1.0, 1.0)
    out["rv_ratio"] = clip(log((w.mean(c("q_rv"), short) + 1e-9) / (w.mean(c("q_rv"), long) + 1e-9)), -3.0, 3.0)
    full = w.number() >= long
    return x.withColumns({n: F.when(full, v) for n, v in out.items()}).drop("q_rv", "q_m", "q_mrv", "q_r")
