"""Quantile maps, prototype similarity, anchors and fitted prototypes. Fitted objects are small tables of knots, centres and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import safe_div


def quantile_knots(df: DataFrame, names: list[str], knots: int = 101, by: list[str] | None = None) -> DataFrame:
    """(by, name, knots): exact quantiles at equal steps, all columns in one aggregate."""
    probs = F.array(*[F.lit(i / (knots - 1)) for i in range(knots)])
    row = df.groupBy(*(by or [])).agg(*[F.percentile(n, probs).alias(n) for n in names])
    return row.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("knots")) for n in names])).alias("x")).select(*(by or []), "x.*")


def interpolate(x: Column, knots: Column) -> Column:
    """The share of a value on ascending knots at equal steps: linear between knots, the first of equal knots, clamped at the ends, NULL stays."""
    n = F.size(knots)
    at = lambda i: F.element_at(knots, i.cast("int"))
    below = F.size(F.filter(knots, lambda k: k < x))
    low, high = at(F.greatest(below, F.lit(1))), at(F.least(below + 1, n))
    # The lower knot's share is that of the first knot with its value.
    first = F.array_position(knots, low) - 1
    inside = (first + safe_div(x - low, high - low) * (below - first)) / (n - 1)
    return F.when(x <= F.element_at(knots, 1), 0.0).when(x > F.element_at(knots, -1), 1.0).when(x == high, (F.array_position(knots, high) - 1) / (n - 1)).otherwise(inside)


def mapped(df: DataFrame, maps: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns replaced by their quantile shares. maps: quantile_knots' table, a row for each column (and key)."""
    wide = maps.groupBy(*(by or [])).pivot("name", names).agg(F.first("knots"))
    wide = wide.select(*(by or []), *[F.col(n).alias(f"q_{n}") for n in names])
    joined = df.join(F.broadcast(wide), by) if by else df.crossJoin(F.broadcast(wide))  # one row of knots
    return joined.withColumns({n: interpolate(F.col(n), F.col(f"q_{n}")) for n in names}).drop(*[f"q_{n}" for n in names])


def similarity(prototype: dict[str, tuple[float, float, float]], scale: float = 0.2) -> Column:
    """exp(-distance) to a prototype {coordinate: (centre, half width, weight)}: flat inside the width but for a little curvature; NULL if a coordinate is missing."""
    total, weight = F.lit(0.0), 0.0
    for name, (centre, half, w) in prototype.items():
        away = F.abs(F.col(name) - centre)
        total = total + w * (F.pow(F.greatest(away - half, F.lit(0.0)) / scale, F.lit(2)) + 0.02 * F.pow(away / max(half, 1e-6), F.lit(2)))
        weight += w
    known = F.lit(True)
    for name in prototype:
        known = known & F.col(name).isNotNull()
    return F.when(known, F.exp(-total / weight))


def mid_rank(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Share of a key's values below, ties counting half; a missing value is 0.5 with a flag."""
    w = W.partitionBy(*by)
    n = F.count(x).over(w)
    share = (F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) - 1 + F.count("*").over(W.partitionBy(*by, x)) / 2) / n
    return df.withColumns({out: F.when(F.col(x).isNotNull(), share).otherwise(0.5), f"{out}_missing": F.col(x).isNull()})


def anchors(df: DataFrame, seed: dict[str, float], share: float = 0.008, least: int = 200) -> DataFrame:
    """The rows closest to a seed by mean squared deviation, as many as a share of all (at least ``least``), with their score; ties by root and time."""
    score = -sum((F.pow(F.col(n) - v, F.lit(2)) for n, v in seed.items()), F.lit(0.0)) / len(seed)
    x = df.withColumn("score", score).where("score IS NOT NULL")
    return x.orderBy(F.desc("score"), "root", "timestamp").limit(max(least, int(df.count() * share)))


def fit_prototype(anchored: DataFrame, names: list[str]) -> DataFrame:
    """name, centre (median), width (interquartile range) of the anchors."""
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    row = anchored.agg(*[F.percentile(n, q).alias(n) for n in names])
    x = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("q")) for n in names])).alias("x"))
    return x.select("x.name", F.element_at("x.q", 2).alias("centre"), (F.element_at("x.q", 3) - F.element_at("x.q", 1)).alias("width"))


def weighted_prototype(anchored: DataFrame, sample: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """name, group, centre, width, contrast, redundancy of quantile-mapped coordinates.

    Width is 0.55 interquartile ranges of the anchors, 0.07 at least; contrast grows with the centre's distance from the middle; a coordinate's redundancy is 1 / (1 + how far its correlations with the others of its group, over
    the sample, exceed 0.7), where a missing value counts as the middle. Fixed values: 0.55, 0.07, 0.25, 2.5, 0.7.
    """
    names = [n for g in groups.values() for n in g]
    of = F.create_map(*[F.lit(x) for g, own in groups.items() for n in own for x in (n, g)])
    pairs = [(a, b) for own in groups.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    middle = lambda n: F.coalesce(F.col(n), F.lit(0.5))
    far = {(a, b): F.greatest(F.abs(F.coalesce(F.nanvl(F.corr(middle(a), middle(b)), F.lit(0.0)), F.lit(0.0))) - 0.7, F.lit(0.0)) for a, b in pairs}
    row = sample.agg(*[(1 / (1 + sum((v for p, v in far.items() if n in p), F.lit(0.0)))).alias(n) for n in names])
    shares = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("redundancy")) for n in names])).alias("x")).select("x.*")
    x = fit_prototype(anchored, names).join(shares, "name")
    return x.select("name", of[F.col("name")].alias("group"), "centre", F.greatest(F.lit(0.07), F.col("width") * 0.55).alias("width"), (0.25 + 2.5 * F.abs(F.col("centre") - 0.5)).alias("contrast"), "redundancy")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def group_distance(df: DataFrame, groups: dict[str, list[str]], centre: dict[str, float], width: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """Mean squared scaled deviation of each group of coordinates, and exp(-weighted mean) as ``match``."""
    losses = {f"loss_{g}": sum((F.pow((F.col(n) - centre[n]) / max(width[n], 1e-6), F.lit(2)) for n in names), F.lit(0.0)) / len(names) for g, names in groups.items()}
    x = df.withColumns(losses)
    total = sum((weights[g] * F.col(f"loss_{g}") for g in groups), F.lit(0.0)) / sum(weights[g] for g in groups)
    return x.withColumn("match", F.exp(-total))
