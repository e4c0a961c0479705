"""Joins, as-of matching, nearest neighbours, grouping and rank operators that bar research needs beyond plain Spark."""

from __future__ import annotations

from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import uniform
from quillon.operators.bars import DataContractError


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", relation: str = "one_to_one") -> DataFrame:
    """A join whose cardinality is asserted first: one_to_one or many_to_one."""
    for side, df in (("left", left), ("right", right)):
        if (side == "right" or relation == "one_to_one") and df.groupBy(*on).count().where("count > 1").limit(1).count():
            raise DataContractError(f"{on} repeats on the {side}")
    return left.join(right, on, how)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, payload: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it: one union, one shuffle, no range join and nothing exploded.

    The payload travels as a struct, so a NULL in it stays; at equal times the right row sorts first, as the match is inclusive.
    """
    keep = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, F.col(on).alias("q_at"), F.lit(1).alias("q_side"), F.struct(*[F.col(c) for c in keep]).alias("q_left"))
    b = right.select(*by, F.col(right_on).alias("q_at"), F.lit(0).alias("q_side"), F.struct(*payload).alias("q_right"))
    w = W.partitionBy(*by).orderBy("q_at", "q_side").rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b, allowMissingColumns=True).withColumn("q_found", F.last("q_right", ignorenulls=True).over(w)).where("q_side = 1")
    return met.select(*by, F.col("q_at").alias(on), "q_left.*", *[F.col(f"q_found.{c}").alias(c) for c in payload])


def exact_offset(df: DataFrame, by: list[str], on: str, value: str, delay: str, bars: int, step: str) -> DataFrame:
    """entry: value exactly ``delay`` after a row's time; exit: value ``bars`` steps after that. Two equi-joins on computed times."""
    at = df.select(*by, F.col(on).alias("q_t"), F.col(value).alias("q_v"))
    entry = at.select(*by, F.col("q_t").alias("entry_at"), F.col("q_v").alias("entry"))
    leave = at.select(*by, F.col("q_t").alias("exit_at"), F.col("q_v").alias("exit"))
    timed = df.withColumns({"entry_at": F.col(on) + F.expr(f"interval {delay}"), "exit_at": F.col(on) + F.expr(f"interval {delay}") + F.expr(f"interval {step}") * bars})
    return timed.join(entry, [*by, "entry_at"], "left").join(leave, [*by, "exit_at"], "left")


#: Rows to a block of ``knn``, of the base or of the queries, and distances that a task holds at a time.
BLOCK_ROWS, HELD = 1 << 16, 1 << 21


def knn(queries: DataFrame, base: DataFrame, k: int, group: str | None = None, blocks: int | None = None, query_blocks: int | None = None) -> DataFrame:
    """Exact k nearest of ``base`` (vec_id, embedding) for each query: query_id, vec_id, distance, rank.

    Each of ``query_blocks`` blocks of queries meets each of ``blocks`` blocks of the base, so a task holds one block of either; without these numbers there are as many as keep a block at ``BLOCK_ROWS``
    rows, so a task's memory doesn't grow with the tables (the work, all pairs, grows with their product). Queries go to every block of the base in a block-by-block join; inside a block one matrix product gives ``HELD`` distances, and only k rows a query leave the block. With ``group``
    rows of the query's own group don't count.
    """
    import numpy as np

    extra = [group] if group else []
    blocks = blocks or max(16, -(-base.count() // BLOCK_ROWS))
    query_blocks = query_blocks or max(1, -(-queries.count() // BLOCK_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    packed = base.withColumns({"q_b": dealt(blocks), "q_q": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    sent = queries.withColumns({"q_q": dealt(query_blocks), "q_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def nearest(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})
        y, ids = np.stack(b["embedding"]).astype(float), b["vec_id"].to_numpy()
        out, step = [], max(1, HELD // len(b))
        for i in range(0, len(a), step):
            part = a.iloc[i : i + step]
            x = np.stack(part["a_embedding"]).astype(float)
            d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
            banned = part["a_vec_id"].to_numpy()[:, None] == ids
            if group:
                banned |= part[f"a_{group}"].to_numpy()[:, None] == b[group].to_numpy()
            d[banned] = np.inf
            d = np.round(d, 9)
            if d.shape[1] > k:  # all at or below the k-th distance, of which ties are resolved
                near = np.where(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k], d, np.inf)
            else:
                near = d
            at, col = np.nonzero(np.isfinite(near))
            order = np.lexsort((ids[col], near[at, col], at))
            at, col = at[order], col[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, col = at[place < k], col[place < k]
            out.append(pd.DataFrame({"query_id": part["a_vec_id"].to_numpy()[at], "vec_id": ids[col], "distance": np.sqrt(d[at, col])}))
        return pd.concat(out)

    cols = ["vec_id", "embedding", *extra]
    left = sent.select(F.col("q_b").alias("a_b"), F.col("q_q").alias("a_q"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = packed.select("q_b", "q_q", *cols)
    found = left.groupBy("a_b", "a_q").cogroup(right.groupBy("q_b", "q_q")).applyInPandas(nearest, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def grid_gcd(df: DataFrame, by: str, value: Column, scale: int = 100) -> DataFrame:
    """Greatest common divisor of the gaps between distinct rounded values. Distinct values are combined map-side; each key's fold sees gaps only."""
    points = df.select(by, F.rint(value * scale).cast("long").alias("v")).distinct()
    gaps = points.withColumn("g", F.col("v") - F.lag("v").over(W.partitionBy(by).orderBy("v"))).where("g > 0").select(by, "g").distinct()

    @F.pandas_udf("long")
    def fold(values: pd.Series) -> int:
        return reduce(gcd, (int(v) for v in values))

    return gaps.groupBy(by).agg(fold("g").alias("gcd")).select(by, (F.col("gcd") / scale).alias("tick_size"))


def sample_rows(df: DataFrame, by: list[str], n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows of each group, the same in every run: the first by a hash of seed and key."""
    draw = uniform(seed, F.col(key))
    return df.withColumn("q_r", F.row_number().over(W.partitionBy(*by).orderBy(draw, key))).where(F.col("q_r") <= n).drop("q_r")


def stride(df: DataFrame, by: list[str], order: str, first: int, step: int) -> DataFrame:
    """Every step-th row of a group from number ``first`` on."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    return df.withColumn("q_n", n).where((F.col("q_n") >= first) & ((F.col("q_n") - first) % step == 0)).drop("q_n")


def grouped_reports(df: DataFrame, keys: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """The same measures over several groupings in one pass (GROUPING SETS); ``report`` names the grouping."""
    every = list(dict.fromkeys(k for ks in keys for k in ks))
    out = df.groupingSets([[F.col(k) for k in ks] for ks in keys], *[F.col(k) for k in every]).agg(F.grouping_id().alias("q_id"), *[m.alias(n) for n, m in measures.items()])
    names = {sum(0 if k in ks else 1 << (len(every) - 1 - i) for i, k in enumerate(every)): "x".join(ks) or "all" for ks in keys}
    label = F.create_map(*[x for i, n in names.items() for x in (F.lit(i).cast("long"), F.lit(n))])
    return out.withColumn("report", label[F.col("q_id")]).drop("q_id")


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr for all pairs on complete cases, in one aggregate."""
    whole = df.dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = whole.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def effective_count(matrix: DataFrame, n: int) -> DataFrame:
    """Participation ratio n^2 / sum of squared correlations, and the Sharpe error it implies. matrix: a, b, corr with a <= b."""
    total = F.sum(F.when(F.col("a") == F.col("b"), F.pow("corr", F.lit(2))).otherwise(2 * F.pow("corr", F.lit(2))))
    return matrix.agg((F.lit(float(n * n)) / total).alias("n_eff")).withColumn("sharpe_se", F.sqrt(2 / F.col("n_eff")))
