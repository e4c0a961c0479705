"""Stateful policies as queries, with recursive SQL as their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import policies as P
from quillon.plans.evaluation import SIG, signals
from quillon.plans.market import rnd
from quillon.plans.prototypes import _SH, shares

ENTER, RELIABILITY, DIRECTION, LEAVE = [0.85, 0.85, 0.9], [0.9, 0.8, 1.0], [1, -1, 1], (0.5, 0.5, 0.6)


def _scores(spark, d):
    hour = F.hour("timestamp")
    x = signals(spark, d).where("x IS NOT NULL").select("timestamp", "root", F.round("x", 9).alias("score"), (1 + hour % 3 * 0.25).alias("beta"))
    return x.withColumns({"enter": 0.8 + hour % 2 * 0.4, "leave": 0.2 * (1 + hour % 3)})


def pair_policy(spark, d):
    return rnd(P.pair_policy(_scores(spark, d), 1.0, 0.2, 2, 24, 0.5), ["weight"])


def adaptive_pairs(spark, d):
    """Thresholds by the hour, a review every third hour, sizes that follow the score, changes below 0.15 left out."""
    return rnd(P.adaptive_pair_weights(_scores(spark, d), F.col("enter"), F.col("leave"), 3, 24, 0.3, 3, 0.15), ["weight"])


def prototype_candidates(spark, d):
    near = lambda c, m: F.coalesce(F.round(1 - F.abs(F.col(c) - m), 6), F.lit(0.0))
    x = shares(spark, d).select("root", "timestamp", F.array(near("move", 0.8), near("move", 0.2), near("trend", 0.7)).alias("scores"))
    return P.candidates(x, "scores", ENTER, RELIABILITY, DIRECTION)


def candidate_signals(spark, d):
    return rnd(prototype_candidates(spark, d).select("root", "timestamp", "signal", "selected", "conflicting", "strength"), ["strength"])


def positions_fixed(spark, d):
    return P.held_positions(prototype_candidates(spark, d), "scores", P.Holding(LEAVE, fixed=16)).select("root", "timestamp", "position")


def positions_hysteretic(spark, d):
    return P.held_positions(prototype_candidates(spark, d), "scores", P.Holding(LEAVE)).select("root", "timestamp", "position")


def _pairs(enter: str, leave: str, least: int, most: int, hurdle: float, review: int, deadband: float, sized: bool) -> str:
    """Common tables up to h: i, l, s, age, wa, wb, ch (a weight was set) after each time."""
    scale = f"least(1, greatest(CASE WHEN fresh THEN b.w ELSE o END, 0) / greatest(e * 1.5, 0.0003))" if sized else "1.0"
    return f"""{SIG}, v AS (SELECT timestamp, root, round(x, 9) AS score, 1 + hour(timestamp) % 3 * 0.25 AS beta FROM sg WHERE x IS NOT NULL), ti AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i FROM (SELECT DISTINCT timestamp FROM v)),
        pw AS (SELECT i, a.root AS l, c.root AS s, (c.beta * a.score - a.beta * c.score) / (a.beta + c.beta) AS w, c.beta / (a.beta + c.beta) AS fa, a.beta / (a.beta + c.beta) AS fb FROM v a JOIN v c ON a.timestamp = c.timestamp AND a.root <> c.root JOIN ti ON ti.timestamp = a.timestamp),
        be AS (SELECT i, first({{'l': l, 's': s, 'w': w, 'fa': fa, 'fb': fb}} ORDER BY w DESC, l, s) AS b FROM pw GROUP BY i),
        tt AS (SELECT ti.i, timestamp, b, {enter} AS e, {leave} AS lv, ti.i % {review} <> 0 AS rest FROM ti LEFT JOIN be USING (i)),
        h AS (SELECT -1::BIGINT AS i, NULL::VARCHAR AS l, NULL::VARCHAR AS s, 0 AS age, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, false AS ch
          UNION ALL SELECT i, nl, ns, na, CASE WHEN nl IS NULL THEN 0 WHEN waits OR near THEN wa ELSE ta END, CASE WHEN nl IS NULL THEN 0 WHEN waits OR near THEN wb ELSE tb END, nl IS NOT NULL AND (waits OR NOT off)
          FROM (SELECT *, NOT off AND ch AND nl = l AND ns = s AND abs(ta - wa) + abs(tb - wb) < {deadband} AS near FROM (SELECT *, CASE WHEN off THEN 0 ELSE sc * CASE WHEN fresh THEN b.fa ELSE fa END END AS ta, CASE WHEN off THEN 0 ELSE sc * CASE WHEN fresh THEN b.fb ELSE fb END END AS tb
            FROM (SELECT *, sc < 0.05 AS off FROM (SELECT *, {scale} AS sc, CASE WHEN waits THEN l WHEN rest AND l IS NULL THEN NULL WHEN fresh THEN b.l WHEN keep THEN l END AS nl, CASE WHEN waits THEN s WHEN rest AND l IS NULL THEN NULL WHEN fresh THEN b.s WHEN keep THEN s END AS ns,
                CASE WHEN waits THEN age + 1 WHEN rest AND l IS NULL THEN 0 WHEN fresh THEN 1 WHEN keep THEN age + 1 ELSE 0 END AS na
              FROM (SELECT *, coalesce(b.w > 0 AND ((NOT keep AND b.w >= e) OR (keep AND age + 1 >= {least} AND b.w > greatest(e, o + {hurdle}))), false) AS fresh
                FROM (SELECT tt.i, b, e, lv, rest, h.l, h.s, h.age, h.wa, h.wb, h.ch, pw.w AS o, pw.fa, pw.fb, h.l IS NOT NULL AND rest AND h.age < {most} AS waits, coalesce(h.l IS NOT NULL AND pw.w > 0 AND h.age + 1 < {most} AND NOT (h.age + 1 >= {least} AND pw.w < lv), false) AS keep
                  FROM h JOIN tt ON tt.i = h.i + 1 LEFT JOIN pw ON pw.i = tt.i AND pw.l = h.l AND pw.s = h.s)))))))"""


_HOURS = ("0.8 + hour(timestamp) % 2 * 0.4", "0.2 * (1 + hour(timestamp) % 3)")
_SIDES = "SELECT timestamp, l AS root, round(wa, 6) + 0.0 AS weight{m} FROM h JOIN tt USING (i) WHERE l IS NOT NULL AND (wa <> 0 OR wb <> 0) UNION ALL SELECT timestamp, s, round(-wb, 6) + 0.0{m} FROM h JOIN tt USING (i) WHERE l IS NOT NULL AND (wa <> 0 OR wb <> 0)"
_UP = lambda k: f"least(greatest(s{k} - {ENTER[k]}, 0) / {max(1 - ENTER[k], 0.02)!r} * {RELIABILITY[k]}, 1)"
_CD = f"""{_SH}, sc AS (SELECT root, timestamp, coalesce(round(1 - abs(move - 0.8), 6), 0) AS s0, coalesce(round(1 - abs(move - 0.2), 6), 0) AS s1, coalesce(round(1 - abs(trend - 0.7), 6), 0) AS s2 FROM sh),
up AS (SELECT *, [{_UP(0)}, 0, {_UP(2)}]::DOUBLE[] AS lo, [0, {_UP(1)}, 0]::DOUBLE[] AS sh FROM sc), bs AS (SELECT *, list_max(lo) AS lb, list_max(sh) AS sb FROM up),
sg1 AS (SELECT *, CASE WHEN lb > sb * 1.25 THEN 1 WHEN sb > lb * 1.25 THEN -1 ELSE 0 END AS signal FROM bs),
cd AS (SELECT *, CASE signal WHEN 1 THEN list_position(lo, lb) - 1 WHEN -1 THEN list_position(sh, sb) - 1 ELSE -1 END AS selected, lb + sb AS strength, lb > 0 AND sb > 0 AND signal = 0 AS conflicting, row_number() OVER (PARTITION BY root ORDER BY timestamp) AS n FROM sg1)"""
_OWN = "CASE h.proto WHEN 0 THEN s0 < 0.5 WHEN 1 THEN s1 < 0.5 WHEN 2 THEN s2 < 0.6 END"
SQL = {
    "pair_policy": f"WITH RECURSIVE {_pairs('1.0', '0.2', 2, 24, 0.5, 1, 0.0, False)} {_SIDES.format(m='')}",
    "adaptive_pairs": f"WITH RECURSIVE {_pairs(*_HOURS, 3, 24, 0.3, 3, 0.15, True)} {_SIDES.format(m=', age')}",
    "candidate_signals": f"WITH {_CD} SELECT root, timestamp, signal::INT AS signal, selected::INT AS selected, conflicting, round(strength, 6) + 0.0 AS strength FROM cd",
    "positions_fixed": f"""WITH RECURSIVE {_CD}, h AS (SELECT root, 0::BIGINT AS n, NULL::TIMESTAMP AS timestamp, 0 AS pos, 0 AS age FROM (SELECT DISTINCT root FROM cd)
        UNION ALL SELECT root, n, timestamp, p, CASE WHEN p = 0 THEN 0 WHEN kept THEN age + 1 ELSE 1 END FROM (SELECT cd.root, cd.n, cd.timestamp, h.age, h.pos <> 0 AND h.age < 16 AS kept, CASE WHEN h.pos <> 0 AND h.age < 16 THEN h.pos ELSE signal END AS p FROM h JOIN cd ON cd.root = h.root AND cd.n = h.n + 1))
        SELECT root, timestamp, pos::INT AS position FROM h WHERE n > 0""",
    "positions_hysteretic": f"""WITH RECURSIVE {_CD}, h AS (SELECT root, 0::BIGINT AS n, NULL::TIMESTAMP AS timestamp, 0 AS pos, 0 AS age, -1 AS proto FROM (SELECT DISTINCT root FROM cd)
        UNION ALL SELECT root, n, timestamp, CASE WHEN kept THEN pos ELSE signal END, CASE WHEN kept THEN age + 1 ELSE 0 END, CASE WHEN kept THEN proto WHEN signal <> 0 THEN selected ELSE -1 END
        FROM (SELECT cd.root, cd.n, cd.timestamp, h.pos, h.age, h.proto, signal, selected, h.pos <> 0 AND NOT (h.age + 1 >= 32 OR (h.age + 1 >= 4 AND {_OWN}) OR (signal = -h.pos AND strength > 0)) AS kept FROM h JOIN cd ON cd.root = h.root AND cd.n = h.n + 1))
        SELECT root, timestamp, pos::INT AS position FROM h WHERE n > 0""",
}
QUERIES = {f.__name__: f for f in (pair_policy, adaptive_pairs, candidate_signals, positions_fixed, positions_hysteretic)}
