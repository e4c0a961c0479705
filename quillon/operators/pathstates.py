"""States of market paths: frozen maps by instrument, path representations, states split where a later span confirms it, and their forecasts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import true
from quillon.functions.windows import Bars
from quillon.operators.prototypes import quantile_knots
from quillon.operators.selection import frozen_mid_rank, knot_shares
from quillon.operators.states import memberships
from quillon.operators.stats import beside
from quillon.sources.lineage import cut

#: Lags of a path, oldest first, in bars.
LAGS = (16, 12, 8, 4)
SPLIT_IDS = 100  # children are numbered from here on


def fit_maps(df: DataFrame, names: list[str], seen: Column, by: str = "root", knots: int = 101) -> DataFrame:
    """by, name, table: each instrument's points (value, share) of every column, from the rows of ``seen`` alone. What comes later is mapped by them and never changes them."""
    known = quantile_knots(df.where(seen), names, knots, [by]).where("knots IS NOT NULL")
    return known.select(by, "name", knot_shares(F.col("knots")).alias("table"))


def frozen_share(x: Column, table: Column) -> Column:
    """A value's share on its table: 0 below and 1 above all points, 0.5 where it is missing or the table has one point."""
    low, high = F.element_at(table, 1), F.element_at(table, -1)
    return F.when(x.isNull() | table.isNull() | (F.size(table) == 1), 0.5).when(x < low.v, 0.0).when(x > high.v, 1.0).otherwise(frozen_mid_rank(x, table))


def represent(df: DataFrame, maps: DataFrame, groups: dict[str, list[str]], paths: dict[str, list[str]], lags: tuple[int, ...] = LAGS, by: str = "root", order: str = "timestamp") -> DataFrame:
    """df with the vectors x0 (now), x1 (now and the oldest lag) and x2 (all lags, and the places of the path's highest and lowest point), and missing_count.

    Columns are mapped by their instrument's frozen table; before an instrument's first bars a path is at 0.5. Each group of columns has a total scale of one, however long its path is. Of equal
    extremes the oldest counts, judged on nine digits.
    """
    names = [n for g in groups.values() for n in g]
    wide = maps.groupBy(by).pivot("name", names).agg(F.first("table")).select(by, *[F.col(n).alias(f"q_{n}") for n in names])
    x = df.join(wide, by, "left").withColumns({f"q_{n}": F.round(frozen_share(F.col(n), F.col(f"q_{n}")), 9) for n in names})
    w = Bars(by, order)
    moved = sorted({n for p in paths.values() for n in p})
    x = x.withColumns({f"q_{n}_{k}": F.coalesce(w.lag(F.col(f"q_{n}"), k), F.lit(0.5)) for n in moved for k in lags})
    parts: dict[str, list[Column]] = {"x0": [], "x1": [], "x2": []}
    for group, own in groups.items():
        now, path = [F.col(f"q_{n}") for n in own], paths.get(group, [])
        at = lambda k, path=path: [F.col(f"q_{n}_{k}") for n in path]
        nodes = [F.array(*[F.col(f"q_{n}_{k}") for k in lags], F.col(f"q_{n}")) for n in path]
        place = lambda agg, nodes=nodes: [(F.array_position(v, agg(v)) - 1) / len(lags) for v in nodes]
        levels = {"x0": now, "x1": now + at(lags[0]), "x2": now + [c for k in lags for c in at(k)] + place(F.array_max) + place(F.array_min)}
        for level, cols in levels.items():
            parts[level] += [(c - 0.5) * (2 / len(cols) ** 0.5) for c in cols]
    missing = reduce(Column.__add__, [F.col(n).isNull().cast("int") for n in names])
    x = x.withColumns({level: F.array(*cols) for level, cols in parts.items()} | {"missing_count": missing})
    return x.select(*df.columns, *parts, "missing_count")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def with_children(df: DataFrame, children: DataFrame, state: str = "state", vector: str = "x") -> DataFrame:
    """df with child (0 or 1, the nearer centre of its state, 0 on a tie) and child_distance. children: state, c0, c1; rows of other states have none."""
    d = [squared_distance(F.col(vector), F.col(c)) for c in ("c0", "c1")]
    x = df.join(children, state, "left").withColumns({"q_d0": d[0], "q_d1": d[1]})
    nearer = F.round("q_d1", 9) < F.round("q_d0", 9)
    return x.withColumns({"child": F.when(F.col("c0").isNotNull(), nearer.cast("int")), "child_distance": F.sqrt(F.least("q_d0", "q_d1"))}).drop("c0", "c1", "q_d0", "q_d1")


def fit_children(df: DataFrame, order: list[str], state: str = "state", vector: str = "x", rounds: int = 50, tolerance: float = 1e-5) -> DataFrame:
    """state, c0, c1: two-way k-means inside every state at once.

    A state's first centre is its row farthest from the mean, the second the row farthest from the first (ties by ``order``). Each round is one assignment and one aggregate of vectors for all
    states; what moves through the driver is two centres a state.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = cut(df.select(F.col(state).alias("state"), F.col(vector).cast("array<double>").alias("x"), *order))
    mean = lambda x, *by: x.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("c"))
    far = lambda c: F.max_by("x", F.struct(F.round(squared_distance(F.col("x"), F.col(c)), 9), *[F.col(o) for o in order]))
    first = rows.join(mean(rows, "state"), "state").groupBy("state").agg(far("c").alias("c0"))
    now = rows.join(first, "state").groupBy("state").agg(F.first("c0").alias("c0"), far("c0").alias("c1"))
    schema = "state int, c0 array<double>, c1 array<double>"
    centres = {r["state"]: [list(r["c0"]), list(r["c1"])] for r in now.collect()}  # two centres a state
    for _ in range(rounds):
        table = df.sparkSession.createDataFrame([(s, *c) for s, c in centres.items()], schema)
        shift = 0.0
        for r in mean(with_children(rows, table), "state", "child").collect():
            old = centres[r["state"]][r["child"]]
            shift = max(shift, *(abs(a - b) for a, b in zip(old, r["c"])))
            centres[r["state"]][r["child"]] = list(r["c"])
        if shift < tolerance:
            break
    return df.sparkSession.createDataFrame([(s, *c) for s, c in sorted(centres.items())], schema)


def _long(df: DataFrame, tasks: dict[str, int], *keep: str) -> DataFrame:
    """A row for each task of each row: task, label."""
    cells = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("label")) for t in tasks])
    return df.select(*keep, F.explode(cells).alias("q")).select(*keep, "q.task", "q.label")


def split_evidence(df: DataFrame, tasks: dict[str, int], fit: str = "fit", least_fit: int = 0, least_later: int = 0, least_gain: float = 0.0005, least_days: int = 20, strength: float = 0.0, day: str = "day") -> DataFrame:
    """One row a state: may its two children stay?

    df: state, child, fit (true: rows that fit, false: the later span that judges), day and a label for each task. The children's label distributions are shrunk to their state's and these to all rows';
    ``gain`` is how much the mean log loss on the later span falls. A split needs enough rows on both sides in both spans, a gain above ``least_gain`` and ``least_days`` days a side.

    All of it is one aggregate of label counts; the rest is arithmetic on a row for each state, child, task and label.
    """
    n, c = lambda x: F.coalesce(x, F.lit(0)), F.col
    sides = df.groupBy("state").pivot("child", [0, 1]).agg(F.count_if(fit).alias("fit"), F.count_if(~c(fit)).alias("later"), F.count_distinct(F.when(~c(fit), c(day))).alias("days"))
    sides = sides.select("state", *[n(c(f"{i}_{k}")).alias(f"{k}_{i}") for k in ("fit", "later", "days") for i in (0, 1)])
    cells = _long(df, tasks, "state", "child", fit).groupBy("state", "child", "task", "label").agg(F.count_if(fit).alias("f"), F.count_if(~c(fit)).alias("v"))
    total = lambda x, *by: F.sum(x).over(W.partitionBy(*by))
    classes = reduce(lambda a, t: a.when(c("task") == t, tasks[t]), tasks, F)
    back = (total("f", "task", "label") + 1) / (total("f", "task") + classes)
    x = cells.withColumn("parent", (total("f", "state", "task", "label") + strength * back) / (total("f", "state", "task") + strength))
    x = x.withColumn("own", (c("f") + strength * c("parent")) / (total("f", "state", "child", "task") + strength))
    loss = lambda p: F.ln(F.least(F.greatest(c(p), F.lit(1e-8)), F.lit(1.0)))
    gains = x.groupBy("state").agg((F.sum(c("v") * (loss("own") - loss("parent"))) / F.sum("v")).alias("gain"))
    out = sides.join(gains, "state")
    support = (c("fit_0") + c("fit_1") >= 2 * least_fit) & (c("later_0") + c("later_1") >= 2 * least_later)
    small = (F.least("fit_0", "fit_1") < least_fit) | (F.least("later_0", "later_1") < least_later) | (F.least("fit_0", "fit_1") == 0)
    passed = true(c("gain") > least_gain) & (F.least("days_0", "days_1") >= least_days)
    reason = F.when(~support, "insufficient_support").when(small, "small_child").when(~passed, "no_gain")
    return out.withColumns({"reason": reason, "accepted": reason.isNull()})


def with_leaves(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """df (state, distance, child, child_distance) with leaf and leaf_distance: the child where its state's split was accepted, the state elsewhere."""
    x = df.join(evidence.select("state", F.col("accepted").alias("q_split")), "state", "left")
    split = true(F.col("q_split")) & F.col("child").isNotNull()
    leaf = F.when(split, F.col("state") * 2 + F.col("child") + SPLIT_IDS).otherwise(F.col("state"))
    return x.withColumns({"leaf": leaf.cast("int"), "leaf_distance": F.when(split, F.col("child_distance")).otherwise(F.col("distance"))}).drop("q_split")


def _shrunk(long: DataFrame, by: list[str], prior: DataFrame, on: list[str], strength: float, grid: DataFrame) -> DataFrame:
    """by, task, label, probability: label shares of each group, shrunk to those of its prior (on, task, label, probability). Every class has a row."""
    size = long.groupBy(*by, "task").agg(F.count("*").alias("q_n"))
    seen = long.groupBy(*by, "task", "label").agg(F.count("*").alias("q_k"))
    x = size.join(grid, "task").join(seen, [*by, "task", "label"], "left").join(prior.withColumnRenamed("probability", "q_p"), [*on, "task", "label"])
    return x.select(*by, "task", "label", ((F.coalesce("q_k", F.lit(0)) + strength * F.col("q_p")) / (F.col("q_n") + strength)).alias("probability"))


def leaf_tables(df: DataFrame, tasks: dict[str, int], strength: float, symbol_strength: float, by: str = "root") -> dict[str, DataFrame]:
    """The forecasts of states: tables ``state``, ``leaf`` (shrunk to its state's), ``leaf_symbol`` (shrunk to the leaf's) and ``background`` (each instrument's, shrunk to all rows')."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, i) for t, n in tasks.items() for i in range(n)], "task string, label int")
    long = cut(_long(df, tasks, "state", "leaf", by))
    whole = beside(grid.join(long.groupBy("task", "label").agg(F.count("*").alias("q_k")), ["task", "label"], "left"), df.agg(F.count("*").alias("q_n")))
    classes = reduce(lambda a, t: a.when(F.col("task") == t, tasks[t]), tasks, F)
    whole = cut(whole.select("task", "label", ((F.coalesce("q_k", F.lit(0)) + 1) / (F.col("q_n") + classes)).alias("probability")))
    state = cut(_shrunk(long, ["state"], whole, [], strength, grid))
    leaf = cut(_shrunk(long, ["state", "leaf"], state, ["state"], strength, grid).drop("state"))
    symbol = _shrunk(long, ["leaf", by], leaf, ["leaf"], symbol_strength, grid)
    return {"state": state, "leaf": leaf, "leaf_symbol": symbol, "background": _shrunk(long, [by], whole, [], symbol_strength, grid)}


def leaf_cards(df: DataFrame, q: float = 0.9, by: str = "root", time: str = "timestamp", day: str = "day") -> DataFrame:
    """leaf, support_rows, support_days, radius (quantile of the members' distances) and the medoid: the member nearest to its centre, ties by instrument and time."""
    near = F.min_by(F.struct(by, time), F.struct(F.round("leaf_distance", 9), by, time))
    x = df.groupBy("leaf").agg(F.count("*").alias("support_rows"), F.count_distinct(day).alias("support_days"), F.percentile("leaf_distance", q).alias("radius"), near.alias("m"))
    return x.select("leaf", "support_rows", "support_days", "radius", F.col(f"m.{by}").alias("medoid_root"), F.col(f"m.{time}").alias("medoid_timestamp"))


def predict_leaves(df: DataFrame, cards: DataFrame, tables: dict[str, DataFrame], key: list[str], by: str = "root") -> DataFrame:
    """key, leaf, accepted, task, label, probability: within its leaf's radius a row has the leaf's forecast for its instrument, or the leaf's own for an instrument the leaf never had; beyond it, or where no
    leaf is known, the instrument's background."""
    x = df.select(*dict.fromkeys([*key, by]), "leaf", "leaf_distance").join(cards.select("leaf", "radius"), "leaf", "left")
    x = x.withColumn("accepted", true(F.col("leaf_distance") <= F.col("radius")))
    keep = [*dict.fromkeys([*key, by]), "leaf", "accepted"]
    own = tables["leaf_symbol"].withColumnRenamed("probability", "q_own")
    inside = x.where("accepted").join(tables["leaf"], "leaf").join(own, ["leaf", by, "task", "label"], "left").withColumn("probability", F.coalesce("q_own", "probability"))
    outside = x.where("NOT accepted").join(tables["background"], by)
    return inside.select(*keep, "task", "label", "probability").unionByName(outside.select(*keep, "task", "label", "probability"))


def fit_states(df: DataFrame, centres: DataFrame, tasks: dict[str, int], order: list[str], strength: float = 0.0, symbol_strength: float = 0.0, by: str = "root", **limits) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """children's centres, evidence, forecast tables and cards of states with the given centres. df: order's columns, x, fit, day, by, tasks' labels."""
    at = cut(memberships(df, centres, "x", 1.0).drop("margin", "weights"))
    children = fit_children(at.where("fit"), order)
    at = cut(with_children(at, children))
    evidence = cut(split_evidence(at, tasks, strength=strength, **limits))
    leaves = cut(with_leaves(at, evidence))
    return children, evidence, leaf_tables(leaves, tasks, strength, symbol_strength, by), leaf_cards(leaves, by=by)


def compact_features(df: DataFrame, groups: dict[str, list[str]], paths: dict[str, list[str]], variance: str, lags: tuple[int, ...] = LAGS, time: str = "timestamp") -> DataFrame:
    """df (x2, ``represent``) with a few features a row: of each group its mean now and, where it has a path, the mean change over the longest and the shortest lag; each group's mean over all instruments of the
    time; sine and cosine of the hour and of the place in the week; the log of the past variance."""
    own: dict[str, Column] = {}
    at = 0
    x = lambda i: F.element_at("x2", i + 1)
    mean = lambda cols: reduce(Column.__add__, cols) / len(cols)
    for group, names in groups.items():
        path = paths.get(group, [])
        now = {n: x(at + i) for i, n in enumerate(names)}
        own[f"{group}_current"] = mean(list(now.values()))
        past = at + len(names)
        if path:
            for name, k in (("far", 0), ("near", len(lags) - 1)):
                own[f"{group}_change_{name}"] = mean([now[n] - x(past + k * len(path) + i) for i, n in enumerate(path)])
        at = past + len(path) * (len(lags) + 2)
    out = df.withColumns(own)
    out = out.withColumns({f"market_{g}": F.avg(f"{g}_current").over(W.partitionBy(time)) for g in groups})
    hour = F.hour(time) + F.minute(time) / 60
    turns = {"hour": hour / 24, "week": (F.weekday(time) + hour / 24) / 7}
    clock = {f"clock_{n}_{k}": f(t * (2 * math.pi)) for n, t in turns.items() for k, f in (("sin", F.sin), ("cos", F.cos))}
    return out.withColumns(clock | {"log_past_variance": F.when(F.col(variance).isNotNull(), F.ln(F.greatest(F.col(variance), F.lit(1e-10))))})


def region_tables(weights: DataFrame, rows: DataFrame, key: list[str], classes: int, strength: float, by_strength: float, by: str = "root") -> tuple[DataFrame, DataFrame]:
    """Label shares of soft regions: (region, label, probability), shrunk to all labels' shares, and (by, region, label, probability), each instrument's shrunk to the former.

    weights: key, region, weight; rows: key (with ``by``), label.
    """
    grid = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    seen = beside(grid.join(rows.groupBy("label").agg(F.count("*").alias("q_k")), "label", "left"), rows.agg(F.count("*").alias("q_n")))
    back = seen.select("label", ((F.coalesce("q_k", F.lit(0)) + 1) / (F.col("q_n") + classes)).alias("q_p"))
    met = cut(weights.join(rows, key).groupBy(by, "region", "label").agg(F.sum("weight").alias("w")))  # a row for each instrument, region and label

    def shrunk(groups: list[str], prior: DataFrame, on: list[str], s: float) -> DataFrame:
        total = met.groupBy(*groups).agg(F.sum("w").alias("q_t"))
        own = met.groupBy(*groups, "label").agg(F.sum("w").alias("q_w"))
        x = total.join(prior, on) if on else total.join(prior, F.lit(True))
        x = x.join(own, [*groups, "label"], "left")
        return x.select(*groups, "label", ((F.coalesce("q_w", F.lit(0.0)) + s * F.col("q_p")) / (F.col("q_t") + s)).alias("probability"))

    whole = cut(shrunk(["region"], back, [], strength))
    return whole, shrunk([by, "region"], whole.withColumnRenamed("probability", "q_p"), ["region"], by_strength)


def region_forecasts(member: DataFrame, key: list[str], general: DataFrame, local: DataFrame, by: str = "root") -> DataFrame:
    """key, label, probability: membership-weighted shares of the row's instrument, or of all where the instrument was never seen. member: key (with ``by``), weights."""
    flat = member.select(*key, F.posexplode("weights").alias("region", "w"))
    x = flat.join(general.withColumnRenamed("probability", "q_g"), "region").join(local.withColumnRenamed("probability", "q_l"), [by, "region", "label"], "left")
    return x.groupBy(*key, "label").agg(F.sum(F.col("w") * F.coalesce("q_l", "q_g")).alias("probability"))


class FrozenStates:
    """What inference needs, as small tables in memory: every instrument's maps, centres and regions' label shares. ``step`` reads the last snapshots of one instrument and nothing else.

    maps: ``fit_maps``; centres: id, centre in the space of x1; general and local: ``region_tables``.
    """

    def __init__(self, maps: DataFrame, groups: dict[str, list[str]], paths: dict[str, list[str]], centres: DataFrame, temperature: float, general: DataFrame, local: DataFrame, lags: tuple[int, ...] = LAGS, by: str = "root"):
        self.groups, self.paths, self.lags, self.temperature = groups, paths, lags, temperature
        self.names = [n for g in groups.values() for n in g]
        self.maps = {(r[by], r["name"]): (np.array([k.v for k in r["table"]]), np.array([k.p for k in r["table"]])) for r in maps.collect()}
        self.centres = np.array([r["centre"] for r in centres.orderBy("id").collect()])
        labels = 1 + general.agg(F.max("label")).first()[0]
        self.general = np.zeros((len(self.centres), labels))
        for r in general.collect():
            self.general[r["region"], r["label"]] = r["probability"]
        self.local: dict[str, np.ndarray] = {}
        for r in local.collect():
            self.local.setdefault(r[by], self.general.copy())[r["region"], r["label"]] = r["probability"]

    @property
    def depth(self) -> int:
        """Snapshots that are kept of an instrument."""
        return max(self.lags) + 1

    def shares(self, root: str, values: list[float | None]) -> list[float]:
        """A snapshot by its instrument's maps."""
        out = []
        for n, x in zip(self.names, values):
            v, p = self.maps.get((root, n), (np.zeros(1), np.zeros(1)))
            out.append(0.5 if x is None or x != x or len(v) == 1 else round(float(np.interp(x, v, p, left=0.0, right=1.0)), 9))
        return out

    def step(self, root: str, ring: list[list[float]], values: list[float | None]) -> tuple[list[list[float]], np.ndarray, np.ndarray, float]:
        """The ring after a snapshot, the labels' probabilities, x1, and the distance to the nearest centre. ring: shares of the last snapshots, oldest first, ``depth`` at most."""
        ring = [*ring, self.shares(root, values)][-self.depth :]
        at = {n: i for i, n in enumerate(self.names)}
        past = lambda n, k: ring[-1 - k][at[n]] if len(ring) > k else 0.5
        x1 = []
        for group, own in self.groups.items():
            cols = [past(n, 0) for n in own] + [past(n, self.lags[0]) for n in self.paths.get(group, [])]
            x1 += [(c - 0.5) * (2 / len(cols) ** 0.5) for c in cols]
        x = np.array(x1)
        d = np.sqrt(((x - self.centres) ** 2).sum(axis=1))
        w = np.exp(-(d - d.min()) / self.temperature)
        return ring, (w / w.sum()) @ self.local.get(root, self.general), x, float(d.min())
