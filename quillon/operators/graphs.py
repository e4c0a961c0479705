"""Neighbour graphs with exact pruning, votes with rejection, and communities by modularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import true
from quillon.sources.lineage import cut, stored

#: Pivots at most (a row each is sent to all tasks), rows of a cell or queries that meet in one group, cells that every query looks into first.
PIVOTS, GROUP_ROWS, PROBES = 4096, 2048, 8
DIGITS = 9  # distances are compared on so many digits, ties by key


class Cells:
    """An index of vectors: every row in the cell of its nearest pivot, each cell with its radius.

    df: key, vector and more thin columns. Pivots are rows drawn by a hash of the key, as many as four times the root of the rows, ``pivots`` at most. Cells of many rows are cut into groups, so no group is large.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, pivots: int = PIVOTS):
        import numpy as np

        self.key, self.vector = key, vector
        rows = cut(df.withColumn("q_v", F.col(vector).cast("array<double>")))
        n = rows.count()
        drawn = rows.orderBy(F.xxhash64(key), key).limit(min(pivots, max(1, int(4 * n**0.5)))).select("q_v").collect()
        self.pivots = np.array([r[0] for r in drawn])
        self.rows = cut(self._placed(rows, 1).withColumn("cell", F.element_at("q_cells", 1).cell).withColumn("q_d", F.element_at("q_cells", 1).d).drop("q_cells"))
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("size"), F.max("q_d").alias("radius"))
        self.sizes = {r["cell"]: (r["size"], r["radius"]) for r in sizes.collect()}  # a row a pivot
        self.n = n

    def _placed(self, df: DataFrame, least: int | None) -> DataFrame:
        """df with q_cells: array of (cell, d), the ``least`` nearest pivots (all if None), nearest first."""
        import numpy as np
        import pyarrow as pa

        pivots, names, at = self.pivots, df.columns, df.columns.index("q_v")

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    x = np.array(part.column(at).to_pylist(), float)
                    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
                    order = np.argsort(d, axis=1, kind="stable")[:, :least]
                    ends = pa.array((np.arange(len(x) + 1) * order.shape[1]).astype(np.int32))
                    cells = pa.StructArray.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["cell", "d"])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, cells)], names=[*names, "q_cells"])

        schema = df.withColumn("q_cells", F.lit(None).cast("array<struct<cell:int,d:double>>")).schema
        return df.mapInArrow(run, schema)

    def _bounds(self) -> Column:
        return F.create_map(*[F.lit(x) for c, (_, r) in sorted(self.sizes.items()) for x in (c, float(r))])

    def _groups(self) -> Column:
        return F.create_map(*[F.lit(x) for c, (n, _) in sorted(self.sizes.items()) for x in (c, -(-n // GROUP_ROWS))])

    def visits(self, queries: DataFrame, k: int, apart: str | None = None, span: str | None = None, hours: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """q_key, key, distance of the rows that can be among each query's k nearest, and (q_key, cell) of all that was looked into. A query's own row is none of its neighbours; nor is a row with the
        same ``apart`` less than ``hours`` away by ``span``.

        First the nearest cells are searched; their k-th distance then rules out every cell whose pivot is farther than that and the cell's radius together.
        """
        keep = [c for c in (apart, span) if c]
        q = cut(self._placed(queries.select(F.col(self.key).alias("q_key"), F.col(self.vector).cast("array<double>").alias("q_v"), *[F.col(c).alias(f"q_{c}") for c in keep]), None))
        near = lambda c: F.slice(c, 1, PROBES)
        first = cut(self._searched(q.withColumn("q_at", F.transform(near("q_cells"), lambda c: c.cell)), k, apart, span, hours))
        bound = first.groupBy("q_key").agg(F.when(F.count("*") >= k, F.array_max(F.slice(F.array_sort(F.collect_list("distance")), k, 1))).alias("q_far"))
        radius = self._bounds()
        rest = F.filter(F.slice("q_cells", PROBES + 1, len(self.pivots)), lambda c: F.element_at(radius, c.cell).isNotNull() & (F.col("q_far").isNull() | (c.d - F.element_at(radius, c.cell) <= F.col("q_far") + 1e-9)))
        more = q.join(bound, "q_key", "left").withColumn("q_at", F.transform(rest, lambda c: c.cell))
        seen = q.select("q_key", F.explode(F.transform(near("q_cells"), lambda c: c.cell)).alias("cell")).unionByName(more.select("q_key", F.explode("q_at").alias("cell")))
        return first.unionByName(self._searched(more, k, apart, span, hours)), seen

    def _searched(self, q: DataFrame, k: int, apart: str | None, span: str | None, hours: float) -> DataFrame:
        """q_key, key, distance: of each group that a query meets its k nearest. A group is some rows of a cell with some of the queries that look into it."""
        import numpy as np

        keep, key = [c for c in (apart, span) if c], self.key
        own = [f"q_{c}" for c in keep]
        groups, size = self._groups(), self.n
        draw = lambda c, n: F.pmod(F.xxhash64(c), n)
        asked = q.select("q_key", "q_v", *own, F.explode("q_at").alias("cell")).withColumn("q_n", F.element_at(groups, F.col("cell"))).where("q_n IS NOT NULL")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1))).withColumn("chunk", draw("q_key", F.lit(max(1, size // (8 * GROUP_ROWS)))))
        held = self.rows.withColumn("block", draw(key, F.element_at(groups, F.col("cell"))).cast("int")).select(F.col(key).alias("key"), F.col("q_v").alias("v"), *keep, "cell", "block")
        met = asked.select("cell", "block", "chunk").distinct()
        held = held.join(met, ["cell", "block"])
        held = held.select(*[F.col(c).alias(c) for c in held.columns])  # columns of their own, for the cogroup

        def nearest(a, b):
            import pandas as pd

            out = []
            if len(a) and len(b):
                y = np.stack(b["v"].to_numpy())
                ids = b["key"].to_numpy()
                for i in range(0, len(a), 256):
                    part = a.iloc[i : i + 256]
                    x = np.stack(part["q_v"].to_numpy())
                    d = np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(2), 0)) if len(y) * len(x) * x.shape[1] < 1 << 24 else np.stack([np.sqrt(((y - r) ** 2).sum(1)) for r in x])
                    d = np.round(d, DIGITS)
                    d[part["q_key"].to_numpy()[:, None] == ids[None, :]] = np.inf
                    if apart:
                        same = part[f"q_{apart}"].to_numpy()[:, None] == b[apart].to_numpy()[None, :]
                        away = np.abs((part[f"q_{span}"].to_numpy()[:, None] - b[span].to_numpy()[None, :]) / np.timedelta64(1, "s"))
                        d[same & (away < hours * 3600)] = np.inf
                    rank = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                    best = np.take_along_axis(d, rank, 1)
                    ok = np.isfinite(best)
                    out.append(pd.DataFrame({"q_key": np.repeat(part["q_key"].to_numpy(), ok.sum(1)), "key": ids[rank][ok], "distance": best[ok]}))
            return pd.concat(out) if out else pd.DataFrame({"q_key": [], "key": [], "distance": []})

        by = ["cell", "block", "chunk"]
        kind = self.rows.schema[key].dataType.simpleString()
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(nearest, f"q_key {kind}, key {kind}, distance double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """q_key, key, distance, rank of each query's k nearest of what ``visits`` found; equal distances by key."""
    r = F.row_number().over(W.partitionBy("q_key").orderBy("distance", "key"))
    return found.withColumn("rank", r).where(F.col("rank") <= k)


def weighted_vote(near: DataFrame, member: DataFrame, least_distance: float = 0.05) -> DataFrame:
    """q_key, state, distance: the state with most votes among the neighbours, each of weight 1 / distance, and the farthest neighbour's distance. member: key, state; ties go to the smallest state."""
    x = near.join(member, "key").groupBy("q_key", "state").agg(F.sum(1 / F.greatest("distance", F.lit(least_distance))).alias("votes"), F.max("distance").alias("d"))
    best = F.max_by("state", F.struct(F.round("votes", 9), -F.col("state"))).alias("state")
    return x.groupBy("q_key").agg(best, F.max("d").alias("distance"))


def accepted_votes(votes: DataFrame, fitted: DataFrame, sizes: DataFrame, least: int = 100, q: float = 0.9) -> DataFrame:
    """votes with radius and accepted: the state has ``least`` members and the vote's distance is within the quantile of its fitted votes' distances. sizes: state, size."""
    radius = fitted.groupBy("state").agg(F.percentile("distance", q).alias("radius"))
    x = votes.join(radius, "state", "left").join(sizes, "state", "left")
    return x.withColumn("accepted", true((F.col("size") >= least) & (F.col("distance") <= F.col("radius")))).drop("size")


def _totals(edges: DataFrame, label: DataFrame) -> tuple[DataFrame, float, float]:
    """Each community's total weight, and the modularity. edges: a, b, w in both directions, loops once with twice their weight."""
    named = edges.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    tot = stored(named.groupBy("la").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inner")))
    all_w, inner, squares = tot.agg(F.sum("tot"), F.sum("inner"), F.sum(F.col("tot") * F.col("tot"))).first()
    return tot, all_w, inner / all_w - squares / all_w / all_w


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """Modularity of labels (node, label) on undirected edges (a, b, w), each given once."""
    return _totals(_both(edges), label)[2]


def _both(edges: DataFrame) -> DataFrame:
    x = edges.select("a", "b", F.col("w").cast("double").alias("w"))
    turned = x.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return x.withColumn("w", F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).unionByName(turned).groupBy("a", "b").agg(F.sum("w").alias("w"))


def louvain(edges: DataFrame, least_gain: float = 1e-5, least_share: float = 1 / 32) -> tuple[DataFrame, list[float]]:
    """node, community (the smallest node of it), and the modularity after every turn, which never falls.

    edges: a, b (long), w, undirected, each once. A turn finds for every node the neighbouring community with the greatest gain, all nodes at once from sums of weights by (node, community); a hash
    lets a share of the nodes that gain move together. As moves made together can undo each other's gain, modularity is summed after the turn; a turn that doesn't raise it by ``least_gain`` is dropped and the share halved.
    When no share moves on, or no node would gain, communities become the nodes of the next level, with summed weights, until a level changes nothing.
    """
    level = stored(_both(edges))
    member = stored(level.select(F.col("a").alias("node")).distinct().withColumn("top", F.col("node")))
    history: list[float] = []
    while True:
        label = stored(level.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
        weight = stored(level.groupBy("a").agg(F.sum("w").alias("k")))
        tot, all_w, now = _totals(level, label)
        history, share, turn, moved = history or [now], 0.5, 0, False
        while share >= least_share:
            linked = level.where("a <> b").join(label.select(F.col("node").alias("b"), F.col("label").alias("c")), "b").groupBy("a", "c").agg(F.sum("w").alias("kc"))
            own = label.select(F.col("node").alias("a"), F.col("label").alias("own"))
            x = linked.join(own, "a").join(weight, "a").join(tot.select(F.col("la").alias("c"), "tot"), "c")
            rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            x = x.withColumn("worth", F.round(F.col("kc") - F.col("k") * rest / all_w, 9))
            best = x.groupBy("a", "own", "k").agg(F.max(F.struct("worth", -F.col("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("worth"))).alias("here"))
            stay = tot.select(F.col("la").alias("own"), F.col("tot").alias("own_tot"))
            best = best.join(stay, "own").withColumn("here", F.coalesce("here", F.round(-F.col("k") * (F.col("own_tot") - F.col("k")) / all_w, 9)))
            wish = stored(best.where(F.col("best.worth") > F.col("here") + 1e-9).select(F.col("a").alias("node"), (-F.col("best.col2")).alias("to")))
            if not wish.take(1):
                break
            turn += 1
            to = wish.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) < int(share * (1 << 20)))
            tried = stored(label.join(to, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
            tot_new, _, then = _totals(level, tried)
            if then > now + least_gain:
                label, tot, now, moved = tried, tot_new, then, True
                history.append(now)
            else:
                share /= 2
        if not moved:
            names = member.groupBy("top").agg(F.min("node").alias("community"))
            return member.join(names, "top").select("node", "community"), history
        up = label.select(F.col("node").alias("top"), F.col("label").alias("next"))
        member = stored(member.join(up, "top").select("node", F.col("next").alias("top")))
        a, b = (label.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab")
        level = stored(level.join(a, "a").join(b, "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
