"""Pair policies by composed blocks against a walk, positions in batch and stream."""

import random

import numpy as np
import pytest

from tests.test_core import T0, timedelta


def scores(spark, n=400, seed=2):
    r, rows = random.Random(seed), []
    level = dict.fromkeys("ABC", 0.0)
    for t in range(n):
        for root in "ABC":
            level[root] = 0.9 * level[root] + r.gauss(0, 0.5)
            if r.random() < 0.95:
                rows.append((T0 + timedelta(hours=t), root, level[root], 0.5 + r.random(), 0.2 + 0.3 * (t % 2), 0.05 * (t % 3)))
    return spark.createDataFrame(rows, "timestamp timestamp, root string, score double, beta double, enter double, leave double"), rows


def walked(rows, least, most, hurdle, review, deadband, floor=0.05, risk=0.0003):
    """The policy as one loop over all times."""
    by = {}
    for t, root, s, b, e, low in rows:
        by.setdefault(t, ({}, e, low))[0][root] = (s, b)
    held, age, last, out = None, 0, None, []
    for i, t in enumerate(sorted(by)):
        v, e, low = by[t]

        def worth(p, v=v):
            if p[0] not in v or p[1] not in v:
                return None
            (sa, ba), (sb, bb) = v[p[0]], v[p[1]]
            return (bb * sa - ba * sb) / (ba + bb)

        if i % review:
            if held and age < most:
                age += 1
                out.append((t, held, age, last[1]))
                last = (held, last[1])
                continue
            if not held:
                last = None
                continue
        pairs = [(worth((a, b)), (a, b)) for a in sorted(v) for b in sorted(v) if a != b]
        best = max(pairs, key=lambda p: p[0]) if pairs else (-np.inf, None)
        own = None
        if held:
            age, own = age + 1, worth(held)
            if own is None or own <= 0 or age >= most or (age >= least and own < low):
                held, age = None, 0
        if held is None and best[0] >= e and best[0] > 0:
            held, age, own = best[1], 1, best[0]
        elif held and age >= least and best[0] > max(e, own + hurdle):
            held, age, own = best[1], 1, best[0]
        now = None
        if held:
            size = min(1.0, max(0.0, own) / max(e * 1.5, risk))
            if size >= floor:
                ba, bb = v[held[0]][1], v[held[1]][1]
                w = (size * bb / (ba + bb), -size * ba / (ba + bb))
                if last and last[0] == held and sum(abs(x - y) for x, y in zip(w, last[1])) < deadband:
                    w = last[1]
                out.append((t, held, age, w))
                now = (held, w)
        last = now
    return {(t, r): (w, age) for t, p, age, ws in out for r, w in zip(p, ws) if w}


@pytest.mark.parametrize("block", [2048, 16])
def test_adaptive_pairs_equal_the_walk(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    from quillon.operators import policies as P

    monkeypatch.setattr(P, "BLOCK", block)
    df, rows = scores(spark)
    for least, most, hurdle, review, deadband in ((3, 30, 0.1, 1, 0.0), (2, 12, 0.0, 4, 0.2)):
        got = P.adaptive_pair_weights(df, F.col("enter"), F.col("leave"), least, most, hurdle, review, deadband, least_scale=0.0)
        got = {(r.timestamp, r.root): (r.weight, r.age) for r in got.collect()}
        want = walked(rows, least, most, hurdle, review, deadband, floor=0.0)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_pairs_are_held_without_one_group_for_all_times(spark, monkeypatch):
    from quillon.operators import policies as P

    df, _ = scores(spark, 120)
    whole = sorted(map(tuple, P.pair_policy(df, 0.4, 0.1, 2, None, 0.2).collect()))
    monkeypatch.setattr(P, "BLOCK", 7)
    parts = P.pair_policy(df, 0.4, 0.1, 2, None, 0.2)
    assert sorted(map(tuple, parts.collect())) == whole and len(whole) > 50
    assert "1 AS series" not in parts._jdf.queryExecution().toString()


def frame(n=300):
    r, rows = random.Random(4), []
    for root in "AB":
        for t in range(n):
            rows.append((root, T0 + timedelta(hours=t), [round(r.random(), 3) for _ in range(3)]))
    return rows


def test_positions_hold_and_let_go(spark):
    from quillon.operators import policies as P

    rows = [("A", T0 + timedelta(hours=t), [s]) for t, s in enumerate([0.95, 0.9, 0.2, 0.2, 0.2, 0.2, 0.95] + [0.2] * 20)]
    x = P.candidates(spark.createDataFrame(rows, "root string, timestamp timestamp, scores array<double>"), "scores", [0.9], [1.0], [1])
    keep = lambda rules: [r.position for r in P.held_positions(x, "scores", rules).orderBy("timestamp").collect()]
    assert keep(P.Holding((0.5,))) == [1] * 4 + [0, 0] + [1] * 4 + [0] * 17  # faded after four bars
    assert keep(P.Holding((0.5,), fixed=16)) == [1] * 16 + [0] * 11


def test_positions_stream_as_in_batch(spark, tmp_path):
    from quillon.operators import policies as P
    from quillon.streaming.bars import stream_positions

    schema = "root string, timestamp timestamp, scores array<double>"
    rows = frame()
    make = lambda df: P.candidates(df, "scores", [0.8, 0.8, 0.9], [1.0, 0.9, 0.8], [1, -1, 1])
    for k in range(3):
        spark.createDataFrame([x for x in rows if (x[1] - T0).days * 3 // 13 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = P.Holding((0.4, 0.4, 0.5))
    batch = sorted(map(tuple, P.held_positions(make(spark.createDataFrame(rows, schema)), "scores", rules).collect()))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    q = stream_positions(stream, rules).writeStream.format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("positions").collect())) == batch and any(x[2] for x in batch)
