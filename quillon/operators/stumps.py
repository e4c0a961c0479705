"""States split by one threshold for several outcomes at once, where a later span confirms it, and the forecasts read from the fitted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.stats import beside
from quillon.sources.lineage import cut


def _add(cols: list[Column]) -> Column:
    return reduce(Column.__add__, cols)


def _below(thresholds: str, x: str) -> Column:
    return F.filter(thresholds, lambda t: t < F.col(x))


def best_splits(df: DataFrame, parent: str, features: list[str], targets: dict[str, float], least: int, share: float, steps: int) -> DataFrame:
    """parent, feature, threshold: the split of each parent that lowers the weighted squared error of all targets most, with at least ``share`` of its rows, and ``least``, on either side.

    Candidates are quantiles at equal steps. A row falls into one bin of each feature, so one aggregate by bin, with running sums over the bins, scores all thresholds; ties go to the first feature, then the
    lower threshold.
    """
    probs = F.array(*[F.lit((i + 1) / (steps + 1)) for i in range(steps)])
    grid = df.groupBy(parent).agg(*[F.array_distinct(F.percentile(f, probs)).alias(f"q_{f}") for f in features])
    bins = [F.struct(F.lit(f).alias("feature"), F.size(_below(f"q_{f}", f)).alias("bin")) for f in features]
    names = list(targets)
    long = df.join(grid, parent).select(parent, *names, F.explode(F.array(*bins)).alias("q")).select(parent, *names, "q.feature", "q.bin")
    cells = long.groupBy(parent, "feature", "bin").agg(F.count("*").alias("n"), *[F.sum(t).alias(f"s_{t}") for t in names])
    run, whole = W.partitionBy(parent, "feature").orderBy("bin"), W.partitionBy(parent, "feature")
    x = cells.withColumns({"nl": F.sum("n").over(run), "nn": F.sum("n").over(whole)} | {f"l_{t}": F.sum(f"s_{t}").over(run) for t in names} | {f"a_{t}": F.sum(f"s_{t}").over(whole) for t in names})
    at = F.create_map(*[v for f in features for v in (F.lit(f), F.col(f"q_{f}"))])
    x = x.join(grid, parent).withColumn("threshold", F.get(at[F.col("feature")], F.col("bin")))
    nl, nr, n = F.col("nl"), F.col("nn") - F.col("nl"), F.col("nn")
    side = lambda t: F.col(f"l_{t}") * F.col(f"l_{t}") / nl + (F.col(f"a_{t}") - F.col(f"l_{t}")) * (F.col(f"a_{t}") - F.col(f"l_{t}")) / nr - F.col(f"a_{t}") * F.col(f"a_{t}") / n
    floor = F.greatest(F.lit(least), F.floor(n * share))
    x = x.where(F.col("threshold").isNotNull() & (nl >= floor) & (nr >= floor)).withColumn("fit", F.round(_add([w * w * side(t) for t, w in targets.items()]), 12))
    first = F.row_number().over(W.partitionBy(parent).orderBy(F.desc("fit"), "feature", "threshold"))
    return x.withColumn("q_r", first).where("q_r = 1 AND fit > 0").select(parent, "feature", "threshold")


def _left(features: list[str]) -> Column:
    value = F.create_map(*[v for f in features for v in (F.lit(f), F.col(f).cast("double"))])
    return value[F.col("feature")] <= F.col("threshold")


def certified_splits(df: DataFrame, parent: str, features: list[str], targets: dict[str, float], day: str, early: float = 0.7, least_early: int = 800, least_late: int = 300, least_leaf: int = 160, share: float = 0.12, least_days: int = 20,
                     certify: list[str] | None = None, steps: int = 32, strength: float = 200.0, leaf_strength: float = 250.0) -> DataFrame:
    """parent, feature, threshold, before, after, accepted: each parent's best split on the early days, and the mean squared error of the certifying targets on the later days without it and with it.

    Means are shrunk: the parent's to all rows', the sides' to the parent's. A split is accepted if the error falls and both sides have ``least_days`` days in both spans, and the parent enough rows.
    """
    names, judged = list(targets), certify or list(targets)
    days = df.select(F.col(day).alias("q_day")).distinct()
    n_days = days.count()
    last = days.withColumn("q_i", F.row_number().over(W.orderBy("q_day"))).where(F.col("q_i") == max(1, int(n_days * early) - 1) + 1).select(F.col("q_day").alias("q_cut"))  # a row a day
    whole = df.agg(*[F.avg(t).alias(f"g_{t}") for t in names])
    x = cut(beside(beside(df, last), whole).withColumn("q_early", F.col(day) <= F.col("q_cut")))
    splits = best_splits(x.where("q_early"), parent, features, targets, least_leaf, share, steps)
    y = x.join(splits, parent).withColumn("q_left", _left(features))
    sums = [a for t in names for a in (F.sum(t).alias(f"s_{t}"), F.sum(F.col(t) * F.col(t)).alias(f"ss_{t}"), F.first(f"g_{t}").alias(f"g_{t}"))]
    c = cut(y.groupBy(parent, "feature", "threshold", "q_left", "q_early").agg(F.count("*").alias("n"), F.count_distinct(day).alias("days"), *sums))  # four rows a parent
    own = W.partitionBy(parent)
    of = lambda col, cond: F.sum(F.when(cond, F.col(col)).otherwise(0)).over(own)
    n_early = of("n", F.col("q_early"))
    c = c.withColumns({f"p_{t}": (of(f"s_{t}", F.col("q_early")) + strength * F.col(f"g_{t}")) / (n_early + strength) for t in names})
    pair = W.partitionBy(parent, "q_left")
    c = c.withColumns({f"e_{t}": (F.sum(F.when(F.col("q_early"), F.col(f"s_{t}")).otherwise(0)).over(pair) + leaf_strength * F.col(f"p_{t}")) / (F.sum(F.when(F.col("q_early"), F.col("n")).otherwise(0)).over(pair) + leaf_strength) for t in names})
    error = lambda p: _add([F.col(f"ss_{t}") - 2 * F.col(f"{p}_{t}") * F.col(f"s_{t}") + F.col("n") * F.col(f"{p}_{t}") * F.col(f"{p}_{t}") for t in judged])
    late = ~F.col("q_early")
    out = c.groupBy(parent, "feature", "threshold").agg(
        F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("early_rows"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late_rows"), F.count("*").alias("q_cells"), F.min("days").alias("least_days"),
        (F.sum(F.when(late, error("p"))) / F.sum(F.when(late, F.col("n"))) / len(judged)).alias("before"), (F.sum(F.when(late, error("e"))) / F.sum(F.when(late, F.col("n"))) / len(judged)).alias("after"),
    )
    ok = (F.col("q_cells") == 4) & (F.col("least_days") >= least_days) & (F.col("early_rows") >= least_early) & (F.col("late_rows") >= least_late) & (F.col("after") < F.col("before"))
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("q_cells")


def fit_stumps(df: DataFrame, evidence: DataFrame, parent: str, features: list[str], targets: dict[str, float], least_leaf: int = 160, share: float = 0.12, steps: int = 32, parent_strength: float = 500.0, leaf_strength: float = 250.0) -> DataFrame:
    """One row a parent, the fitted table: parent, feature, threshold (null without an accepted split) and for each target its mean (shrunk to all rows'), left and right (shrunk to the parent's), from all rows."""
    names = list(targets)
    kept = df.join(evidence.where("accepted").select(parent), parent, "left_semi")
    splits = best_splits(kept, parent, features, targets, least_leaf, share, steps)
    x = beside(df.join(splits, parent, "left"), df.agg(*[F.avg(t).alias(f"g_{t}") for t in names]))
    left = F.col("feature").isNotNull() & _left(features)
    right = F.col("feature").isNotNull() & ~_left(features)
    sums = [F.count("*").alias("n"), F.count(F.when(left, 1)).alias("nl"), F.count(F.when(right, 1)).alias("nr")]
    sums += [a for t in names for a in (F.sum(t).alias(f"s_{t}"), F.sum(F.when(left, F.col(t)).otherwise(0.0)).alias(f"l_{t}"), F.sum(F.when(right, F.col(t)).otherwise(0.0)).alias(f"r_{t}"), F.first(f"g_{t}").alias(f"g_{t}"))]
    c = x.groupBy(parent, "feature", "threshold").agg(*sums).withColumns({f"mean_{t}": (F.col(f"s_{t}") + parent_strength * F.col(f"g_{t}")) / (F.col("n") + parent_strength) for t in names})
    side = lambda k, n, t: F.when(F.col("feature").isNotNull(), (F.col(f"{k}_{t}") + leaf_strength * F.col(f"mean_{t}")) / (F.col(n) + leaf_strength))
    c = c.withColumns({f"left_{t}": side("l", "nl", t) for t in names} | {f"right_{t}": side("r", "nr", t) for t in names})
    return c.select(parent, "feature", "threshold", *[f"{k}_{t}" for k in ("mean", "left", "right") for t in names])


def predict_stumps(df: DataFrame, fitted: DataFrame, parent: str, features: list[str], targets: list[str]) -> DataFrame:
    """df with leaf (-1 no split, 0 left, 1 right) and a forecast of each target. Rows only read the fitted table, so new rows are assigned alike; a parent it doesn't know has no forecast."""
    x = df.join(fitted, parent, "left")
    split, left = F.col("feature").isNotNull(), F.coalesce(_left(features), F.lit(False))
    leaf = F.when(~split, -1).when(left, 0).otherwise(1)
    value = lambda t: F.when(~split, F.col(f"mean_{t}")).when(left, F.col(f"left_{t}")).otherwise(F.col(f"right_{t}"))
    out = x.withColumns({"leaf": leaf} | {f"forecast_{t}": value(t) for t in targets})
    return out.select(*df.columns, "leaf", *[f"forecast_{t}" for t in targets])
