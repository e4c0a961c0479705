"""Opening hours, positions, the day's shape, pooled forecasts, splits, audits and frozen inference against loops."""

import random
from datetime import date

import numpy as np
import pandas as pd
import pytest

from tests.test_core import T0, timedelta

D0 = date(2024, 1, 1)


def test_a_planted_change_of_the_opening_is_found(spark):
    from quillon.operators.sessions import session_specs

    r, rows = random.Random(1), []
    for i in range(40):
        day = D0 + timedelta(days=i)
        rows.append(("A", day, (15 if i >= 22 else 0) + r.randint(0, 4), 600 + r.randint(0, 9), 10, 60))
        rows.append(("B", day, r.choice([0, 15, 30]), 600, 10, 60))  # no regime
        rows.append(("C", day, 0 if i != 30 else 200, 600, 10, 60))  # one late day changes nothing
    daily = spark.createDataFrame(rows, "root string, session_id date, start_elapsed int, end_elapsed int, bars int, anchor int")
    got = {(x.root, x.segment): x for x in session_specs(daily).collect()}
    assert got["A", 0].valid_to == D0 + timedelta(days=21) and got["A", 1].valid_from == D0 + timedelta(days=22)
    assert 60 <= got["A", 0].start_minute < 65 and 75 <= got["A", 1].start_minute < 80
    ends = sorted(e for root, d, _, e, *_ in rows if root == "A" and d < D0 + timedelta(days=22))
    assert got["A", 0].end_minute == 60 + ends[round(21 * 0.95)] + 1
    assert ("B", 1) not in got and ("C", 1) not in got


def test_short_days_and_expiring_symbols_are_not_truncated(spark):
    from pyspark.sql import functions as F

    from quillon.operators.sessions import dated_positions, session_edges, session_specs

    rows = []
    for day in range(8):
        bars = {2: 3, 4: 3, 5: 3, 7: 3}.get(day, 10)  # 2: short day, 4: a symbol's last, 5: truncated, 7: the last session
        rows += [("A", T0 + timedelta(days=day, hours=h), D0 + timedelta(days=day), 60 * h, "old" if day <= 4 else "new") for h in range(bars)]
    df = spark.createDataFrame(rows, "root string, timestamp timestamp, session_id date, local_minute int, local_symbol string")
    special = spark.createDataFrame([("A", D0 + timedelta(days=2), 3, True)], "root string, session_id date, expected int, half boolean")
    specs = session_specs(session_edges(df, F.lit(0)))
    out = dated_positions(df, specs, special, 60, F.lit(0)).toPandas()
    cut = out[out.is_truncated].session_id.unique().tolist()
    assert cut == [D0 + timedelta(days=5)]
    assert out[out.is_half_day].session_id.unique().tolist() == [D0 + timedelta(days=2)] and out[out.is_half_day].phi.max() == 1
    assert out[out.session_id == D0].phi.tolist() == pytest.approx([h / 8 for h in range(9)] + [1.0])


def test_curves_by_a_loop(spark):
    from quillon.operators.sessions import seasonal_curves, seasonality

    r = random.Random(3)
    rows = [("A", n, s, r.random() if s != 3 or n < 8 else None) for n in range(21) for s in range(5)]
    df = spark.createDataFrame(rows, "root string, session_no int, slot int, abs_z double")
    curves = seasonal_curves(df, 4, 6)
    got = {(x.refit, x.slot): (x.median, x.mean) for x in curves.collect()}
    assert {k for k, _ in got} == {6, 10, 14, 18}
    for (refit, slot), (m, a) in got.items():
        z = [v for _, n, s, v in rows if s == slot and n < refit and v is not None]
        assert m == pytest.approx(np.median(z)) and a == pytest.approx(np.mean(z))
    seas = seasonality(curves, 0.5, events=(2,), event_roots=("A",)).toPandas()
    for _, own in seas.groupby("refit"):
        assert np.sqrt((own.seas**2).mean()) == pytest.approx(1)


def test_pooled_forecasts_equal_refits(spark):
    from quillon.operators.sessions import HAR, SIGNS, pooled_har

    g = np.random.default_rng(4)
    rows = [(root, D0 + timedelta(days=i), *map(float, g.normal(size=5)), float(g.normal()) if i < 29 else None) for i in range(30) for root in "ABC"]
    x = pd.DataFrame(rows, columns=["root", "target_session", *HAR, "target_log_c"])
    got = pooled_har(spark.createDataFrame(rows, f"root string, target_session date, {', '.join(f'{h} double' for h in HAR)}, target_log_c double"), {"p": ["A", "B"], "q": ["C"]}, 9)
    got = {(r.root, r.session_id): r.har_log_var for r in got.collect()}
    assert len(got) == 3 * 21
    for roots in (["A", "B"], ["C"]):
        own = x[x.root.isin(roots)]
        for i in (9, 15, 29):
            day = D0 + timedelta(days=i)
            past, now = own[own.target_session < day], own[own.target_session == day]
            m, s = past[list(HAR)].mean(), past[list(HAR)].std()
            design = lambda t, m=m, s=s, roots=roots: np.column_stack([np.ones(len(t)), ((t[list(HAR)] - m) / s).to_numpy(), *[(t.root == r).to_numpy(float) for r in roots[1:]]])
            a, y = design(past), past.target_log_c.to_numpy()
            beta = np.zeros(a.shape[1])
            for _ in range(5000):  # cyclic descent within the bounds
                for j in range(len(beta)):
                    v = beta[j] + a[:, j] @ (y - a @ beta) / (a[:, j] @ a[:, j])
                    sign = SIGNS[j - 1] if 1 <= j <= 5 else 0
                    beta[j] = max(v, 0) if sign > 0 else min(v, 0) if sign < 0 else v
            for root, value in zip(now.root, design(now) @ beta):
                assert got[root, day] == pytest.approx(value, abs=1e-6)


def test_splits_are_kept_where_later_days_agree(spark):
    from quillon.operators.stumps import certified_splits, fit_stumps, predict_stumps

    r, rows = random.Random(6), []
    for i in range(4000):
        s, a, b = i % 2, r.random(), r.random()
        day = D0 + timedelta(days=i // 40)
        sign = 1.0 if a > 0.5 else -1.0
        y = sign if s == 0 else sign * (1 if i < 2800 else -1)  # the second state turns round later
        rows.append((day, s, a, b, y + r.gauss(0, 0.1), 2 * y))
    df = spark.createDataFrame(rows, "day date, state int, a double, b double, u double, v double")
    args = {"least_early": 100, "least_late": 50, "least_leaf": 20, "least_days": 10, "steps": 19}
    e = {x.state: x for x in certified_splits(df, "state", ["a", "b"], {"u": 1.0, "v": 0.5}, "day", **args).collect()}
    assert e[0].accepted and e[0].feature == "a" and abs(e[0].threshold - 0.5) < 0.05 and not e[1].accepted
    assert e[0].after < e[0].before and e[1].after > e[1].before
    evidence = spark.createDataFrame(list(e.values()))
    fitted = fit_stumps(df, evidence, "state", ["a", "b"], {"u": 1.0, "v": 0.5}, 20, steps=19)
    new = spark.createDataFrame([(0, 0.9, 0.1), (0, 0.1, 0.1), (1, 0.9, 0.9), (7, 0.5, 0.5)], "state int, a double, b double")
    got = [(x.leaf, x.forecast_u, x.forecast_v) for x in predict_stumps(new, fitted, "state", ["a", "b"], ["u", "v"]).orderBy("state", "a").collect()]
    assert got[0][0] == 0 and got[0][1] < -0.5 and got[1][0] == 1 and got[1][2] > 1 and got[2][0] == -1 and got[3][1] is None
    rows0 = [x for x in rows if x[1] == 0]
    mean = (sum(x[4] for x in rows0) + 500 * sum(x[4] for x in rows) / len(rows)) / (len(rows0) + 500)
    t = fitted.where("state = 0").first()
    left = [x[4] for x in rows0 if x[2] <= t.threshold]
    assert t.left_u == pytest.approx((sum(left) + 250 * mean) / (len(left) + 250))


def test_survival_counts_censored_holdings_at_risk(spark):
    from quillon.operators.audits import spells, survival

    pos = {"A": [1, 1, 0, -1, -1, -1, 1, 0, 1, 1], "B": [0, 1, 1, 1, 0, 0, 0, 0, 0, 0]}
    rows = [(k, T0 + timedelta(hours=i), p) for k, v in pos.items() for i, p in enumerate(v)]
    held = spells(spark.createDataFrame(rows, "root string, timestamp timestamp, position int"))
    assert sorted((x.root, x.side, x.bars, x.censored) for x in held.collect()) == [("A", -1, 3, False), ("A", 1, 1, False), ("A", 1, 2, False), ("A", 1, 2, True), ("B", 1, 3, False)]
    got = {x.age: (x.at_risk, x.ended, round(x.survival, 6)) for x in survival(held.where("root = 'A'"), ["root"]).collect()}
    assert got == {1: (4, 1, 0.75), 2: (3, 1, 0.5), 3: (1, 1, 0.0)}


def test_smallest_number_of_states_within_the_interval(spark):
    from quillon.operators.audits import smallest_within

    g = np.random.default_rng(2)
    rows = []
    for i in range(60):
        day, base = D0 + timedelta(days=i), g.normal(1.0, 0.1)
        rows += [(1, day, base + 0.2), (2, day, base + float(g.normal(0.0005, 0.01))), (4, day, base)]
    got = {x.k: x for x in smallest_within(spark.createDataFrame(rows, "k int, day date, loss double"), 5, 200, 3).collect()}
    best = min(got.values(), key=lambda x: x.loss)
    assert best.best and sum(x.best for x in got.values()) == 1 and got[2].chosen and sum(x.chosen for x in got.values()) == 1
    assert got[1].low > 0 and got[2].low <= 0


def test_a_stream_of_snapshots_equals_batch(spark, tmp_path):
    """Frozen inference reads the last 17 snapshots of an instrument and gives what the whole history gives."""
    from pyspark.sql import functions as F

    from quillon.operators import pathstates as S
    from quillon.operators.states import memberships
    from quillon.streaming.paths import stream_forecasts
    from tests.test_states import GROUPS, PATHS, panel

    df = panel(spark)
    seen = F.col("timestamp") < F.lit(T0 + timedelta(hours=80))
    maps = S.fit_maps(df, ["a", "b", "c"], seen)
    centres = spark.createDataFrame([(0, [0.2, 0.1, 0.3, 0.0, 0.1]), (1, [-0.4, 0.2, 0.0, 0.3, -0.2])], "id int, centre array<double>")
    x = S.represent(df, maps, GROUPS, PATHS).select("root", "timestamp", F.col("x1").alias("x"))
    member = memberships(x, centres, "x", 0.4)
    labels = member.where(seen).select("root", "timestamp", (F.hour("timestamp") % 3).alias("label"))
    weights = member.where(seen).select("root", "timestamp", F.posexplode("weights").alias("region", "weight"))
    general, local = S.region_tables(weights, labels, ["root", "timestamp"], 3, 20.0, 10.0)
    batch = {(r.root, r.timestamp, r.label): r.probability for r in S.region_forecasts(member, ["root", "timestamp"], general, local).collect()}
    frozen = S.FrozenStates(maps, GROUPS, PATHS, centres, 0.4, general, local)
    assert frozen.depth == 17
    for k in range(4):
        df.where((F.col("timestamp") >= F.lit(T0 + timedelta(hours=30 * k))) & (F.col("timestamp") < F.lit(T0 + timedelta(hours=30 * k + 30)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_forecasts(stream, frozen).writeStream.format("memory").queryName("forecasts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.root, r.timestamp, k): p for r in spark.table("forecasts").collect() for k, p in enumerate(r.probabilities)}
    assert got.keys() == batch.keys() and max(abs(got[k] - batch[k]) for k in got) < 1e-12
