"""Neighbour graphs of market paths, votes and communities as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import graphs as G
from quillon.operators.states import memberships
from quillon.plans import pathstates as P
from quillon.plans.market import rnd
from quillon.plans.pathstates import _RE, CENTRES
from quillon.plans.state import ROOTS
from quillon.sources.lineage import cut

APART = {"apart": "root", "span": "timestamp", "hours": 4.0}


def paths(spark, d):
    """key, root, timestamp, x0, x1 of every bar; the key counts by time, then instrument."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROOTS]), F.col("root"))
    return cut(P._represented(spark, d).select((F.unix_timestamp("timestamp") * 8 + place).alias("key"), "root", "timestamp", "x0", "x1"))


def neighbour_graph(spark, d):
    x = paths(spark, d)
    found, _ = G.Cells(x, "key", "x1").visits(x, 8, **APART)
    return rnd(G.nearest(found, 8), ["distance"])


def _states(spark, x):
    return memberships(x, spark.createDataFrame(CENTRES, "id int, centre array<double>"), "x0", 1.0).select("key", "state")


def neighbour_vote(spark, d):
    """States of the days after the twentieth, voted by their 8 nearest bars of the days before."""
    x = paths(spark, d)
    old = x.where(P._seen())
    index, member = G.Cells(old, "key", "x1"), _states(spark, old)
    vote = lambda q: G.weighted_vote(G.nearest(index.visits(q, 8)[0], 8), member)
    out = G.accepted_votes(vote(x.where(~P._seen())), vote(old), member.groupBy("state").agg(F.count("*").alias("size")))
    return rnd(out, ["distance", "radius"])


def neighbour_communities(spark, d):
    """Communities of the graph of 16 neighbours over all bars."""
    x = paths(spark, d)
    near = G.nearest(G.Cells(x, "key", "x1").visits(x, 16, **APART)[0], 16)
    edges = near.select(F.least("q_key", "key").alias("a"), F.greatest("q_key", "key").alias("b")).distinct().withColumn("w", F.lit(1.0))
    found, _ = G.louvain(edges, least_gain=1e-3, least_share=1 / 8)
    return x.select(F.col("key").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


_KEY = f"(epoch(timestamp)::BIGINT * 8 + list_position([{', '.join(repr(r) for r in ROOTS)}], root))"
_PT = f"{_RE}, pa AS (SELECT {_KEY} AS key, root, timestamp, x0, x1 FROM re)"
_NEAR = lambda a, b, k, more: f"""SELECT a.key AS q_key, b.key, round(list_distance(a.x1, b.x1), 9) AS distance, row_number() OVER (PARTITION BY a.key ORDER BY round(list_distance(a.x1, b.x1), 9), b.key) AS rank
        FROM {a} a JOIN {b} b ON a.key <> b.key{more} QUALIFY rank <= {k}"""  # noqa: E731
_VOTE = lambda near: f"""SELECT q_key, first(state ORDER BY round(votes, 9) DESC, state) AS state, max(d) AS distance FROM
        (SELECT q_key, state, sum(1 / greatest(distance, 0.05)) AS votes, max(distance) AS d FROM {near} JOIN me USING (key) GROUP BY ALL) GROUP BY q_key"""  # noqa: E731
_ND = [f"round(list_distance(x0, {c}::DOUBLE[]), 9)" for _, c in CENTRES]
SQL = {
    "neighbour_graph": f"WITH {_PT}, n AS ({_NEAR('pa', 'pa', 8, ' AND NOT (a.root = b.root AND abs(epoch(a.timestamp) - epoch(b.timestamp)) < 14400)')}) SELECT q_key, key, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM n",
    "neighbour_vote": f"""WITH {_PT}, ol AS (SELECT * FROM pa WHERE day(timestamp) <= 20), nw AS (SELECT * FROM pa WHERE day(timestamp) > 20),
        me AS (SELECT key, CASE WHEN {_ND[0]} <= {_ND[1]} AND {_ND[0]} <= {_ND[2]} THEN 0 WHEN {_ND[1]} <= {_ND[2]} THEN 1 ELSE 2 END AS state FROM ol), n1 AS ({_NEAR('nw', 'ol', 8, '')}), n2 AS ({_NEAR('ol', 'ol', 8, '')}),
        v1 AS ({_VOTE('n1')}), v2 AS ({_VOTE('n2')}), ra AS (SELECT state, quantile_cont(distance, 0.9) AS radius FROM v2 GROUP BY state), si AS (SELECT state, count(*) AS size FROM me GROUP BY state)
        SELECT q_key, v1.state::INT AS state, round(distance, 6) + 0.0 AS distance, round(radius, 6) + 0.0 AS radius, coalesce(size >= 100 AND distance <= radius, false) AS accepted FROM v1 LEFT JOIN ra USING (state) LEFT JOIN si USING (state)""",
}
QUERIES = {f.__name__: f for f in (neighbour_graph, neighbour_vote, neighbour_communities)}
