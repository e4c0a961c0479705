"""Bar research operators on small closed-form cases, and prefix invariance."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

T0 = datetime(2024, 1, 1)


def frame(spark, closes, root="A", **more):
    n = len(closes)
    d = {"root": [root] * n, "timestamp": [T0 + timedelta(hours=i) for i in range(n)], "open": closes, "high": [c + 1 for c in closes], "low": [c - 1 for c in closes], "close": closes, "wap": closes, "volume": [10.0] * n, "bar_count": [3] * n, "is_valid": [True] * n, "session_id": [(T0 + timedelta(hours=i)).date() for i in range(n)], "local_symbol": ["A-0"] * n}
    return spark.createDataFrame(pd.DataFrame(d | more))


def walk(n=400, seed=3):
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n))))


def assert_prefix_invariant(spark, make, n=240, at=150):
    """What is known at a time doesn't change when later bars come."""
    closes = walk(n)
    full, part = make(frame(spark, closes)), make(frame(spark, closes[:at]))
    end = T0 + timedelta(hours=at)
    a = full.where(full["timestamp"] < end).toPandas().sort_values("timestamp").reset_index(drop=True)
    b = part.toPandas().sort_values("timestamp").reset_index(drop=True)[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-8)


def test_minutes_to_five(spark):
    from quillon.operators.bars import resample_minutes

    m = [(0, 10, 12, 9, 11, 5, 3, 10.5), (1, 11, 13, 10, 12, 10, 2, 11.5), (2, 99, 99, 99, 99, 0, 0, 99), (5, 7, 7, 7, 7, 0, 0, 7)]
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=t), "s", *map(float, (o, h, low, c, v)), n, float(w)) for t, o, h, low, c, v, n, w in m], "root string, timestamp timestamp, local_symbol string, open double, high double, low double, close double, volume double, bar_count long, wap double")
    a, b = resample_minutes(df).orderBy("timestamp").collect()
    assert (a.open, a.high, a.low, a.close, a.volume, a.n_valid, a.is_valid) == (10, 13, 9, 12, 15, 2, True) and a.wap == pytest.approx((10.5 * 5 + 11.5 * 10) / 15)
    assert (b.open, b.close, b.volume, b.is_valid) == (10, 12, 0, False)  # carried forward


def test_returns_stop_at_rolls_and_sessions(spark):
    from quillon.operators.bars import add_returns

    df = frame(spark, [100.0, 110.0, 121.0, 120.0], local_symbol=["a", "a", "b", "b"], session_id=[T0.date()] * 3 + [T0.date() + timedelta(days=1)])
    r = add_returns(df).orderBy("timestamp").collect()
    assert r[1].ret == pytest.approx(np.log(1.1)) and r[2].ret is None and r[2].is_roll_boundary and r[3].ret is None and r[3].overnight_ret == pytest.approx(np.log(120 / 121))


def test_labels_need_future(spark):
    from pyspark.sql import functions as F

    from quillon.operators.bars import add_labels, add_returns

    df = add_returns(frame(spark, [100.0 + i for i in range(8)])).withColumn("sigma_hat", F.lit(0.1))
    r = add_labels(df, (2,)).orderBy("timestamp").collect()
    assert r[0].fwd_ret_2 == pytest.approx(np.log(102 / 100)) and r[0].label_valid_2 and not r[7].label_valid_2 and r[7].fwd_ret_2 is None


def test_features_are_causal(spark):
    from pyspark.sql import functions as F

    from quillon.operators.features import NAMES, build_features

    assert len(NAMES) == 56
    assert_prefix_invariant(spark, lambda b: build_features(b.withColumns({"quote": F.col("wap") * F.col("volume"), "taker_quote": F.col("wap") * 4})))


def test_ewm_rule(spark):
    from quillon.functions.windows import ewm

    x = [None, 1.0, None, None, 2.0, 4.0, None]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = [r.y for r in ewm(df, ["k"], ["i"], "x", "y", 1, halflife=5).orderBy("i").collect()]
    want = pd.Series(x).ewm(halflife=5, adjust=False, min_periods=1).mean()
    assert [g is None for g in got] == list(want.isna()) and np.allclose([g for g in got if g is not None], want.dropna())


def test_detectors_keep_their_contract_and_are_causal(spark):
    from pyspark.sql import functions as F

    from quillon.functions.windows import Bars
    from quillon.operators.detectors import DETECTORS, signal

    def state(b):
        w = Bars("root", "timestamp")
        r = F.ln(F.col("close") / w.lag(F.col("close")))
        b = b.withColumns({"ret": r, "bar_in_session": F.hour("timestamp"), "local_minute": F.hour("timestamp") * 60, "is_half_day": F.lit(False), "is_month_end": F.lit(False), "is_quarter_end": F.lit(True), "vol_ratio": F.lit(0.5)})
        return b.withColumns({"sigma_hat": w.strict(F.stddev_samp, F.col("ret"), 12), "es_ret_z": F.sin(F.hour("timestamp").cast("double"))})

    small = {"D01": {"lookback": 12}, "D02": {"lookback": 12, "q_hi": 0.9}, "D04": {"lookback": 6, "range_window": 30, "range_least": 10, "range_pct": 0.9}, "D06": {"min_bars": 40, "follower": "A"}, "D07": {"slope_window": 3, "flat_slope": 5.0, "d_hi": 0.3, "d_lo": 0.1}, "D08": {"event_minute": 720, "roots": ("A",), "z_threshold": 0.1}}
    for name in DETECTORS:
        s = signal(name, state(frame(spark, walk())), **small.get(name, {})).toPandas()
        assert len(s) == 400 and s.direction.isin([-1, 0, 1]).all() and s.magnitude.between(0, 1).all() and (s.magnitude[s.direction == 0] == 0).all()
        assert_prefix_invariant(spark, lambda b, n=name: signal(n, state(b), **small.get(n, {})).select("timestamp", "direction", "magnitude"))
    both = [signal(n, state(frame(spark, walk())), lookback=12).where("direction <> 0").select("timestamp") for n in ("D01", "D02")]
    assert both[0].intersect(both[1]).count() == 0


def test_zigzag_never_dates_back(spark):
    from pyspark.sql import functions as F

    from quillon.operators.structure import zigzag

    closes = [100.0, 104, 110, 103, 96, 90, 97, 105, 112, 101]
    p = zigzag(frame(spark, closes).withColumn("sigma_hat", F.lit(0.01)), 2.0, 4).orderBy("confirm_time").toPandas()
    assert list(p.pivot_type) == ["peak", "trough", "peak"] and np.allclose(p.pivot_price, [110, 90, 112]) and (p.confirm_time > p.event_time).all()


def test_asof_keeps_null_payload(spark):
    from quillon.operators.relational import asof_backward

    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 7.0), ("a", 5, None)], "k string, u int, v double")
    assert sorted(map(tuple, asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()), key=str) == sorted([("a", 1, 7.0), ("a", 5, None), ("b", 5, None)], key=str)


def test_held_sign_follows_its_step(spark):
    from quillon.operators.portfolio import held_sign, hysteresis_step

    x = np.random.default_rng(5).normal(0, 1, 300).tolist()
    got = [r.position for r in held_sign(spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i int, v double"), ["k"], ["i"], "v", 1.0, 0.2).orderBy("i").collect()]
    old, want = 0, []
    for v in x:
        old = hysteresis_step(v, old, 1.0, 0.2)
        want.append(old)
    assert got == want


def test_backtest_splits_the_fill_bar(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillon.operators.portfolio import event_backtest

    df = frame(spark, [100.0, 100.0, 110.0, 121.0, 121.0], wap=[100.0, 100.0, 105.0, 121.0, 121.0], volume=[1e6] * 5)
    df = df.withColumns({"ret": F.ln(F.col("close") / F.lag("close").over(Window.orderBy("timestamp"))), "overnight_ret": F.lit(None).cast("double"), "bar_in_session": F.lit(5), "is_roll_boundary": F.lit(False), "target": F.when(F.hour("timestamp") >= 1, 1.0).otherwise(0.0), "band": F.lit(0.0), "signal_active": F.lit(True), "round_trip_cost_bp": F.lit(10.0)})
    r = event_backtest(df, edge=0).orderBy("timestamp").collect()
    assert [x.position for x in r] == [0, 0, 1, 1, 1] and r[2].gross_return == pytest.approx(np.log(110 / 105)) and r[3].gross_return == pytest.approx(np.log(1.1))
    assert r[2].cost == pytest.approx(0.5 * 1.5 * 10e-4) and r[2].executed and not r[3].executed


def test_complete_linkage():
    from quillon.operators.portfolio import complete_linkage

    assert complete_linkage(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.7, ("a", "c"): 0.2}) == {"a": 1, "b": 1, "c": 2}


def test_causal_posterior_waits_for_outcomes(spark):
    from quillon.operators.stats import causal_posterior

    rows = [(str(i), T0 + timedelta(hours=i), "x" if i % 2 else "y", float(i % 2), T0 + timedelta(hours=i + 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp, cell string, outcome double, outcome_available_time timestamp")
    full = causal_posterior(df, ["cell"]).orderBy("timestamp").toPandas()
    assert full.posterior_mean[:3].isna().all() and full.posterior_mean[3] == 0.0 and full.prior_cell_n[39] == 18
    part = causal_posterior(df.limit(25), ["cell"]).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(part, full[:25])


def test_validation(spark):
    from quillon.operators.bars import DataContractError, validate

    ok = spark.createDataFrame([("a", 1)], "root string, t int")
    validate(ok, ok.schema, ["root", "t"], ["a"])
    for bad in (ok.union(ok), spark.createDataFrame([(None, 1)], "root string, t int"), spark.createDataFrame([("z", 1)], "root string, t int"), ok.select("t", "root")):
        with pytest.raises(DataContractError):
            validate(bad, ok.schema, ["root", "t"], ["a"])


def test_normal_functions(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from quillon.functions.scalars import add_business_days, normal_cdf, normal_quantile

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    for r in df.select("p", normal_quantile(F.col("p")).alias("q")).withColumn("c", normal_cdf(F.col("q"))).collect():
        assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7) and r.c == pytest.approx(r.p, abs=1e-6)
    days = spark.createDataFrame([((T0 + timedelta(days=i)).date(),) for i in range(21)], "d date")
    for r in days.select("d", add_business_days(F.col("d"), 2).alias("e")).collect():
        assert r.e == (pd.Timestamp(r.d) + pd.offsets.BDay(2)).date()


def test_streams_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillon.operators.bars import resample, ticks
    from quillon.operators.portfolio import held_sign
    from quillon.streaming.bars import stream_bars, stream_held_sign, stream_thinned

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = src.agg(F.expr("percentile(unix_timestamp(ts), 0.5)")).first()[0]
    for name, part in (("0", src.where(F.unix_timestamp("ts") < cut)), ("1", src.where(F.unix_timestamp("ts") >= cut))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_bars(stream, late="0 seconds").writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("bars_out"), resample(ticks(src))
    assert got.count() > 0.9 * want.count() and got.select("root", "timestamp", "close", "bar_count").exceptAll(want.select("root", "timestamp", "close", "bar_count")).count() == 0
    x = src.select(F.col("event_type").alias("root"), F.col("ts").alias("timestamp"), ((F.col("value") % 7) - 3).alias("value")).orderBy("timestamp")
    x.coalesce(1).write.parquet(f"{tmp_path}/x")
    s = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/x")
    for name, df in (("held_out", stream_held_sign(s, 2.0, 0.5)), ("thin_out", stream_thinned(s.select("root", "timestamp"), 7200))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("held_out").exceptAll(held_sign(x, ["root"], ["timestamp"], "value", 2.0, 0.5).select("root", "timestamp", "position")).count() == 0 and spark.table("held_out").count() == x.count()
    assert 0 < spark.table("thin_out").count() < x.count()


def test_io(spark, tmp_path, capsys):
    import json

    from quillon.sources import io

    df = frame(spark, walk(30)).select("root", "timestamp", "close")
    io.save(df, f"{tmp_path}/t", ["root"])
    got = io.scan(spark, f"{tmp_path}/t", ["timestamp", "close"], until="2024-01-01 10:00:00")
    assert got.count() == 10
    got.explain("formatted")
    assert "PushedFilters: [IsNotNull(timestamp), LessThan" in capsys.readouterr().out
    m = json.loads(io.manifest(spark, f"{tmp_path}/t", {"a": 1}))
    assert m["inputs"] and all(len(f["sha256"]) == 64 for f in m["inputs"])
    io.save_csv(df.limit(3), f"{tmp_path}/c")
    assert io.load_csv(spark, f"{tmp_path}/c", "root string, timestamp timestamp, close double").count() == 3
    assert io.markdown(df.limit(1)).count("\n") == 2


def test_entry_and_names(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert e.entry(spark).count() > 0


def test_communities_of_all_rows_at_a_fixed_point(spark):
    from pyspark.sql import functions as F

    from quillon.operators.relational import knn
    from quillon.operators.states import communities

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 8)) + 6 * np.eye(8)[np.arange(60) % 3]
    e = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    near = knn(e, e, 16, blocks=3, query_blocks=2)
    got = {r.node: r.community for r in communities(near.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b")), 5).collect()}
    assert set(got) == set(range(60))
    d = ((vectors[:, None] - vectors) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    edges = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:16]}
    star = {(0, 1), (0, 2)}  # synchronous rounds swing on it
    for links, label in ((edges, got), (star, {r.node: r.community for r in communities(spark.createDataFrame(sorted(star), "a long, b long"), 5).collect()})):
        for i in label:
            around = [label[j] for j in {y for x, y in links if x == i} | {x for x, y in links if y == i}]
            assert around.count(label[i]) == max(map(around.count, around))


def test_nearest_rows_in_bounded_blocks(spark, monkeypatch):
    from quillon.operators import relational

    monkeypatch.setattr(relational, "BLOCK_ROWS", 10)
    monkeypatch.setattr(relational, "HELD", 40)
    rng = np.random.default_rng(9)
    x, label = rng.integers(0, 4, size=(203, 3)).astype(float), rng.integers(0, 3, 203)
    e = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    near = relational.knn(e.where("vec_id % 5 = 0"), e, 4, "label")
    plan = near._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 20," in plan and "sequence(0, 4," in plan  # 21 blocks of the base, 5 of the queries
    want = set()
    for i in range(0, 203, 5):
        d = ((x - x[i]) ** 2).sum(1)
        best = sorted((d[j], j) for j in range(203) if label[j] != label[i])[:4]
        want |= {(i, j, r, round(float(v) ** 0.5, 6)) for r, (v, j) in enumerate(best, 1)}
    assert {(r.query_id, r.vec_id, r.rank, round(r.distance, 6)) for r in near.collect()} == want


def test_expanding_quantiles_are_those_of_all_earlier_rows(spark):
    from quillon.functions.windows import Ordered, expanding_quantiles

    rng = np.random.default_rng(3)
    seen, held = [], Ordered()
    for x in rng.normal(size=6000).round(2):
        seen.append(x)
        held.add(float(x))
        if len(seen) % 997 == 0:
            assert all(np.isclose(held.quantile(q), np.quantile(seen, q)) for q in (0, 0.15, 0.5, 0.97, 1))
    rows = [(f"r{i % 2}", i, None if i % 7 == 0 else float(rng.normal())) for i in range(60)]
    got = expanding_quantiles(spark.createDataFrame(rows, "root string, i int, x double"), ["root"], ["i"], "x", {"lo": 0.1, "mid": 0.5}, 5).collect()
    assert len(got) == len(rows)
    for g in got:
        past = [x for r, i, x in rows if r == g.root and i < g.i and x is not None]
        if len(past) < 5:
            assert g.lo is None and g.mid is None
        else:
            assert np.isclose(g.lo, np.quantile(past, 0.1)) and np.isclose(g.mid, np.median(past))


def test_clusters_of_a_day_know_only_the_days_before(spark):
    from pyspark.sql import functions as F

    from quillon.operators.portfolio import causal_clusters

    day = lambda k, h: f"2024-01-{k:02d} {h:02d}:00:00"
    rng = np.random.default_rng(1)
    rows = []
    for k in range(1, 9):
        for h in range(20):
            a = int(rng.choice([-1, 1]))
            rows += [("x", day(k, h), "A", a), ("x", day(k, h), "B", a if k <= 4 else int(rng.choice([-1, 1]))), ("x", day(k, h), "C", int(rng.choice([-1, 1])))]
    make = lambda r: spark.createDataFrame(r, "root string, timestamp string, detector string, direction int").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    key = lambda d: {(str(x.day), x.detector): (x.cluster, x.size) for x in d.collect()}
    whole = key(causal_clusters(make(rows), 30))
    part = key(causal_clusters(make([r for r in rows if r[1] < "2024-01-05"]), 30))
    assert part == {k: v for k, v in whole.items() if k[0] < "2024-01-05"}
    assert whole["2024-01-01", "A"][1] == 1 and whole["2024-01-04", "A"] == whole["2024-01-04", "B"] == (1, 2)
    assert whole["2024-01-04", "C"][1] == 1


def test_detector_d06_on_a_long_series(spark):
    from pyspark.sql import functions as F

    from quillon.operators.detectors import signal

    n = 25_000
    x = spark.range(n).select(F.lit("HSI").alias("root"), F.timestamp_seconds(F.col("id") * 300).alias("timestamp"), (F.rand(1) - 0.5).alias("ret"), F.lit(0.3).alias("sigma_hat"), (F.rand(2) - 0.5).alias("es_ret_z"))
    got = signal("D06", x).groupBy("direction").count().collect()
    assert sum(g["count"] for g in got) == n and {g["direction"] for g in got} == {-1, 0, 1}
