"""Distribution-valued states: centres, memberships, label distributions and the forecasts read from them; models from MLlib and normal equations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalars import digitize, safe_div
from quillon.sources.lineage import cut, numbered_rows


def centres_of(df: DataFrame, label: str, vector: str) -> DataFrame:
    """id, centre: the mean vector of each label, as one aggregate by (label, position)."""
    flat = df.select(F.col(label).alias("id"), F.posexplode(vector).alias("i", "v")).groupBy("id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return flat.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x.v).alias("centre"))


def fit_centres(df: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """id, centre by k-means (MLlib, k-means||)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="q_v").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("q_v")))
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "id int, centre array<double>")


def memberships(df: DataFrame, centres: DataFrame, vector: str, temperature: float) -> DataFrame:
    """df with state (nearest centre, lowest id on a tie), distance, margin to the second nearest, and weights (softmax of -distance / temperature).

    Centres are a model table of some tens of rows, sent to every task; one matrix product serves a batch.
    """
    table = centres.orderBy("id").collect()
    ids, c = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    at, names = df.columns.index(vector), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v, float) for v in b.column(at).to_pylist()])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))
            near = np.round(d, 9).argmin(axis=1)
            two = np.partition(d, min(1, d.shape[1] - 1), axis=1)[:, : min(2, d.shape[1])]
            w = np.exp(-(d - d.min(axis=1, keepdims=True)) / temperature)
            w /= w.sum(axis=1, keepdims=True)
            cols = [pa.array(ids[near].astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(two[:, -1] - two[:, 0]), pa.array(list(w), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "state", "distance", "margin", "weights"])

    extra = [T.StructField("state", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def outcome_label(ret: Column, past_rv: Column, edges: list[float]) -> Column:
    """Left-closed bin of a return in units of past volatility."""
    return digitize(ret / F.sqrt(F.greatest(past_rv, F.lit(1e-10))), edges)


def distributions(df: DataFrame, state: str, label: str, classes: int, strength: float) -> DataFrame:
    """state, label, probability: a state's label shares, shrunk to the overall ones (which are smoothed by one). Every class has a row."""
    whole = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    total = W.partitionBy()
    prior = grid.join(whole, "label", "left").select("label", ((F.coalesce("n", F.lit(0)) + 1) / (F.sum(F.coalesce("n", F.lit(0))).over(total) + classes)).alias("prior"))
    seen = df.groupBy(F.col(state).alias("state"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = df.select(F.col(state).alias("state")).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    x = every.join(seen, ["state", "label"], "left").join(F.broadcast(prior), "label")
    n = F.coalesce("n", F.lit(0))
    return x.select("state", "label", ((n + strength * F.col("prior")) / (F.sum(n).over(W.partitionBy("state")) + strength)).alias("probability"))


def soft_predict(df: DataFrame, key: str, weights: str, table: DataFrame, order: list[int]) -> DataFrame:
    """key, label, probability: each row's membership-weighted mean of the states' distributions. order: the states in the order of the weights."""
    ids = F.array(*[F.lit(i) for i in order])
    flat = df.select(key, F.posexplode(weights).alias("i", "w")).select(key, "w", F.element_at(ids, F.col("i") + 1).alias("state"))
    return flat.join(F.broadcast(table), "state").groupBy(key, "label").agg(F.sum(F.col("w") * F.col("probability")).alias("probability"))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """(by, name, coefficient): standardised ridge regression with an intercept, by normal equations.

    One pass of sums of products (a row of about p squared / 2 numbers a group); the p x p systems are solved on the driver.
    """
    names = [*features, target]
    data = df.dropna(subset=names)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]]
    rows = data.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in names], *sums).collect()
    out = []
    for r in rows:
        n, p = r["n"], len(features)
        mean = np.array([r[a] for a in names]) / n
        cross = np.array([[r[f"{a}|{b}"] if f"{a}|{b}" in r else r[f"{b}|{a}"] for b in names] for a in names]) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cross)[:p], 1e-300))
        x = cross[:p, :p] / np.outer(sd, sd)
        beta = np.linalg.solve(x * n + alpha * np.eye(p), cross[:p, p] / sd * n) / sd
        key = [r[b] for b in by or []]
        out += [(*key, f, float(v)) for f, v in zip(features, beta)] + [(*key, "intercept", float(mean[p] - beta @ mean[:p]))]
    schema = T.StructType([*[data.schema[b] for b in by or []], T.StructField("name", T.StringType()), T.StructField("coefficient", T.DoubleType())])
    return df.sparkSession.createDataFrame(out, schema)


def walk_forward_ridge(df: DataFrame, features: list[str], target: str, time: str, train_days: int, test_days: int, alpha: float) -> DataFrame:
    """Out-of-sample predictions of rolling folds: df's rows of each test span with fold, prediction and the training mean.

    Rows are exploded to the folds they train, so all folds are fitted in one aggregate.
    """
    first, last = df.agg(F.min(time), F.max(time)).first()
    folds = max(int(((last - first).days - train_days) // test_days) + 1, 0) if first is not None else 0
    day = F.datediff(F.col(time), F.lit(first))
    begin = F.greatest(F.ceil((day - train_days + 1) / test_days), F.lit(0))
    end = F.least(F.floor(day / test_days), F.lit(folds - 1))
    train = df.withColumn("q_d", day).where(begin <= end).withColumn("fold", F.explode(F.sequence(begin.cast("int"), end.cast("int"))))
    train = train.where((F.col("q_d") >= F.col("fold") * test_days) & (F.col("q_d") < F.col("fold") * test_days + train_days))
    fitted = ridge(train, features, target, alpha, ["fold"]).groupBy("fold").pivot("name", [*features, "intercept"]).agg(F.first("coefficient"))
    fitted = fitted.select("fold", *[F.col(f).alias(f"b_{f}") for f in [*features, "intercept"]])
    mean = train.groupBy("fold").agg(F.avg(target).alias("train_mean"))
    test = df.withColumn("fold", F.floor((day - train_days) / test_days).cast("int")).where((day >= train_days) & (F.col("fold") < folds))
    x = test.join(F.broadcast(fitted), "fold").join(F.broadcast(mean), "fold")
    return x.withColumn("prediction", sum((F.col(f) * F.col(f"b_{f}") for f in features), F.col("b_intercept"))).drop(*[f"b_{f}" for f in [*features, "intercept"]])


def tree_heads(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str = "forest", seed: int = 7) -> DataFrame:
    """test with ``prediction`` (and ``probability`` of a classifier) from MLlib: a random forest for labels, boosted trees for numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    head = RandomForestClassifier(labelCol=label, featuresCol="q_f", numTrees=20, maxDepth=4, seed=seed) if kind == "forest" else GBTRegressor(labelCol=label, featuresCol="q_f", maxIter=10, maxDepth=3, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="q_f", handleInvalid="skip"), head]).fit(train)
    out = model.transform(test)
    out = out.withColumn("probability", vector_to_array("probability")) if kind == "forest" else out
    return out.drop("q_f", "rawPrediction")


def isotonic_curve(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-count bins of x with means and their weighted isotonic fit (MLlib). Ranks are numbers in sorted ranges."""
    from pyspark.ml.regression import IsotonicRegression

    from quillon.functions.windows import equal_bins

    r, n = numbered_rows(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), [x, y], "q_r")
    curve = r.groupBy(equal_bins(F.col("q_r") + 1, F.lit(n), bins).cast("int").alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count("*").cast("double").alias("n"))
    model = IsotonicRegression(featuresCol="mean_x", labelCol="mean_y", weightCol="n").fit(curve)
    return model.transform(curve).withColumnRenamed("prediction", "isotonic")


#: Turns in which half of the nodes may move, before neighbours move one at a time.
TURNS = 40


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation over a neighbour graph, up to a fixed point: no label is more frequent around a node than its own.

    edges: a, b in one direction. ``rounds`` synchronous rounds (the most frequent label around a node, the smallest on a tie) come first. They may swing for ever, so
    afterwards a node moves only to a strictly more frequent label, and a hash of node and turn lets one half of the nodes move at a time. After ``TURNS`` such turns, of neighbours that want to move
    only the first by the hash does: each move then makes more edges join equal labels, so the turns end. The state is one label a node; lineage is cut each round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    best = F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("x")
    turn = 0
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a", "label").agg(F.count("*").alias("n"))
        if turn < rounds:
            labels = cut(around.groupBy("a").agg(best).select(F.col("a").alias("node"), "x.label"))
            turn += 1
            continue
        own = around.join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a").groupBy("a", "own")
        seen = own.agg(best, F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("n"))), F.lit(0)).alias("n_own"))
        draw = F.xxhash64("a", F.lit(turn))
        wish = cut(seen.select(F.col("a").alias("node"), F.col("own").alias("label"), F.when(F.col("x.n") > F.col("n_own"), F.col("x.label")).alias("to"), F.struct(draw, "a").alias("at"), (draw % 2 == 0).alias("goes")))
        if not wish.where("to IS NOT NULL").take(1):
            return wish.select("node", F.col("label").alias("community"))
        if turn >= rounds + TURNS:
            first = both.join(wish.where("to IS NOT NULL").select(F.col("node").alias("b"), F.col("at").alias("q_at")), "b").groupBy("a").agg(F.min("q_at").alias("q_at"))
            wish = cut(wish.join(first, wish["node"] == first["a"], "left").withColumn("goes", F.col("q_at").isNull() | (F.col("at") < F.col("q_at"))).select(*wish.columns))
        labels = wish.select("node", F.when(F.col("goes") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("label")).alias("label"))
        turn += 1


def r_squared(df: DataFrame, by: list[str], y: str, prediction: str, baseline: str) -> DataFrame:
    """Out-of-sample R squared against a baseline prediction."""
    sq = lambda p: F.sum(F.pow(F.col(y) - F.col(p), F.lit(2)))
    return df.groupBy(*by).agg((1 - safe_div(sq(prediction), sq(baseline))).alias("r2"), F.count("*").alias("n"))
