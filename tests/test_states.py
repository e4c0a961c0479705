"""Path representations, split states, neighbour graphs and communities against loops."""

import math
import random

import numpy as np
import pytest

from tests.test_core import T0, timedelta


def panel(spark, n=120, shift=0.0, roots=("A", "B")):
    r = random.Random(5)
    rows = []
    for root in roots:
        for i in range(n):
            late = shift if i >= 80 else 0.0
            rows.append((root, T0 + timedelta(hours=i), None if r.random() < 0.05 else r.gauss(0, 1) + late, float(r.randint(0, 3)), r.random()))
    return spark.createDataFrame(rows, "root string, timestamp timestamp, a double, b double, c double")


GROUPS, PATHS = {"g": ["a", "b"], "h": ["c"]}, {"g": ["a"], "h": ["c"]}


def represented(spark, df):
    from pyspark.sql import functions as F

    from quillon.operators import pathstates as S

    maps = S.fit_maps(df, ["a", "b", "c"], F.col("timestamp") < F.lit(T0 + timedelta(hours=80)))
    return maps, S.represent(df, maps, GROUPS, PATHS).toPandas().sort_values(["root", "timestamp"]).reset_index(drop=True)


def test_later_rows_leave_maps_alone(spark):
    one, two = (represented(spark, panel(spark, shift=s)) for s in (0.0, 5.0))
    assert one[0].orderBy("root", "name").collect() == two[0].orderBy("root", "name").collect()
    early = one[1].timestamp < T0 + timedelta(hours=80)
    assert one[1][early].x2.map(tuple).tolist() == two[1][early].x2.map(tuple).tolist()
    assert two[1][~early].x0.map(lambda x: x[0]).max() == pytest.approx(1 / math.sqrt(2))  # beyond all knots


def test_representation_by_a_loop(spark):
    df = panel(spark)
    _, got = represented(spark, df)
    raw = df.toPandas().sort_values(["root", "timestamp"]).reset_index(drop=True)
    for root, own in raw.groupby("root"):
        mapped = {}
        for c in "abc":
            seen = own[c][: 80].dropna()
            k = np.quantile(seen, np.linspace(0, 1, 101))
            u, first, n = np.unique(k, return_index=True, return_counts=True)
            p = np.linspace(0, 1, 101)
            mapped[c] = np.where(own[c].isna(), 0.5, np.interp(own[c].fillna(0), u, (p[first] + p[first + n - 1]) / 2, left=0, right=1))
        for i in (0, 3, 17, 60, 119):
            at = lambda c, lag, i=i, m=mapped: m[c][i - lag] if i >= lag else 0.5
            want = []
            for now, path in ((["a", "b"], "a"), (["c"], "c")):
                nodes = [at(path, k) for k in (16, 12, 8, 4, 0)]
                v = [at(c, 0) for c in now] + nodes[:4] + [int(np.argmax(np.round(nodes, 9))) / 4, int(np.argmin(np.round(nodes, 9))) / 4]
                want += [(x - 0.5) * 2 / math.sqrt(len(v)) for x in v]
            row = got[(got.root == root)].iloc[i]
            assert row.x2 == pytest.approx(want, abs=1e-8)
            assert len(row.x0) == 3 and len(row.x1) == 5


def blobs(spark, n=600):
    """Three states, of which the first two have two halves each; only the halves of the first tell what comes."""
    r, rows = random.Random(1), []
    for i in range(n):
        s, half = i % 3, r.randint(0, 1)
        x = [4.0 * s + r.gauss(0, 0.1), (half * 2.0 if s < 2 else 0.0) + r.gauss(0, 0.1)]
        label = half if s == 0 and r.random() < 0.9 else (i // 3) % 2
        rows.append((i, "A" if i % 2 else "B", T0 + timedelta(hours=i), i < 400, (T0 + timedelta(hours=i)).date(), x, label))
    return spark.createDataFrame(rows, "i int, root string, timestamp timestamp, fit boolean, day date, x array<double>, y int"), rows


def test_states_split_where_later_rows_agree(spark):
    from quillon.operators import pathstates as S

    df, rows = blobs(spark)
    centres = spark.createDataFrame([(s, [4.0 * s, 1.0 if s < 2 else 0.0]) for s in range(3)], "id int, centre array<double>")
    children, evidence, tables, cards = S.fit_states(df, centres, {"y": 2}, ["root", "timestamp"], 10.0, 5.0, least_days=3, least_gain=0.05)
    c = {r.state: sorted(round(v[1]) for v in (r.c0, r.c1)) for r in children.collect()}
    assert c[0] == [0, 2] and c[1] == [0, 2]
    e = {r.state: r for r in evidence.collect()}
    assert e[0].accepted and not e[1].accepted and e[1].reason == "no_gain"
    # The gain of the first state, by a loop.
    own = [x for k, x in enumerate(rows) if k % 3 == 0]
    half = lambda x: int(x[5][1] > 1)
    share = lambda xs, prior: [(sum(x[6] == v for x in xs) + 10 * prior[v]) / (len(xs) + 10) for v in (0, 1)]
    fit = [x for x in rows if x[3]]
    back = [(sum(x[6] == v for x in fit) + 1) / (len(fit) + 2) for v in (0, 1)]
    parent = share([x for x in own if x[3]], back)
    child = [share([x for x in own if x[3] and half(x) == h], parent) for h in (0, 1)]
    later = [x for x in own if not x[3]]
    gain = sum(math.log(child[half(x)][x[6]]) - math.log(parent[x[6]]) for x in later) / len(later)
    assert e[0].gain == pytest.approx(gain)
    leaf = {r.leaf: r for r in cards.collect()}
    assert sorted(leaf) == [1, 2, 100, 101] and sum(r.support_rows for r in leaf.values()) == len(rows)
    p = {(r.leaf, r.label): r.probability for r in tables["leaf"].collect()}
    assert abs(p[100, 0] - p[101, 0]) > 0.6 and abs(p[100, 0] + p[100, 1] - 1) < 1e-9


def test_forecasts_beyond_the_radius_are_the_background(spark):
    from quillon.operators import pathstates as S

    df, _ = blobs(spark)
    centres = spark.createDataFrame([(0, [0.0, 1.0]), (1, [4.0, 1.0]), (2, [8.0, 0.0])], "id int, centre array<double>")
    from quillon.operators.states import memberships

    at = memberships(df, centres, "x", 1.0).withColumnsRenamed({"state": "leaf", "distance": "leaf_distance"}).selectExpr("*", "leaf AS state")
    tables, cards = S.leaf_tables(at, {"y": 2}, 10.0, 5.0), S.leaf_cards(at)
    far = at.limit(1).selectExpr("root", "timestamp", "leaf", "99.0D AS leaf_distance")
    got = {r.label: r for r in S.predict_leaves(far, cards, tables, ["root", "timestamp"]).collect()}
    back = {(r.root, r.label): r.probability for r in tables["background"].collect()}
    assert len(got) == 2 and all(not r.accepted and r.probability == back[r.root, r.label] for r in got.values())
    near = S.predict_leaves(at.selectExpr("root", "timestamp", "leaf", "0.0D AS leaf_distance").limit(1), cards, tables, ["root", "timestamp"]).collect()
    assert all(r.accepted for r in near)


def test_neighbours_equal_brute_force_and_skip_most_pairs(spark):
    from pyspark.sql import functions as F

    from quillon.operators import graphs as G

    g = np.random.default_rng(3)
    n = 1500
    x = np.round(g.random((n, 2)), 3)
    x[:40] = x[0]  # many equal rows
    rows = [(i, "AB"[i % 2], T0 + timedelta(hours=int(i % 300)), x[i].tolist(), 7) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, root string, timestamp timestamp, x array<double>, cell int")
    index = G.Cells(df.drop("cell"), "id", "x")
    found, seen = index.visits(df.drop("cell"), 5, apart="root", span="timestamp", hours=4)
    got = {(r.q_key, r.rank): (r.distance, r.key) for r in G.nearest(found, 5).collect()}
    for i in range(0, n, 37):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        far = [j for j in range(n) if j != i and not (j % 2 == i % 2 and abs(j % 300 - i % 300) < 4)]
        want = sorted((d[j], j) for j in far)[:5]
        assert [got[i, k] for k in range(1, 6)] == want
    sizes = spark.createDataFrame([(c, s) for c, (s, _) in index.sizes.items()], "cell int, size int")
    assert seen.join(sizes, "cell").agg(F.sum("size")).first()[0] < 0.2 * n * n


def test_votes(spark):
    from quillon.operators import graphs as G

    near = spark.createDataFrame([(1, 10, 0.01), (1, 11, 0.1), (1, 12, 0.1), (2, 10, 0.5), (2, 12, 0.5)], "q_key long, key long, distance double")
    member = spark.createDataFrame([(10, 3), (11, 1), (12, 1)], "key long, state int")
    got = {r.q_key: (r.state, r.distance) for r in G.weighted_vote(near, member).collect()}
    assert got == {1: (1, 0.1), 2: (1, 0.5)}  # ties go to the smaller state


def test_louvain_finds_planted_groups(spark):
    from quillon.operators import graphs as G

    r, edges = random.Random(3), []
    for i in range(40):
        for j in range(i):
            if r.random() < (0.7 if i % 4 == j % 4 else 0.02):
                edges.append((j, i, 1.0))
    found, history = G.louvain(spark.createDataFrame(edges, "a long, b long, w double"))
    got = {x.node: x.community for x in found.collect()}
    assert all(b >= a for a, b in zip(history, history[1:]))
    m = sum(w for *_, w in edges)
    k = {v: sum(w for a, b, w in edges if v in (a, b)) for v in got}
    q = sum(w for a, b, w in edges if got[a] == got[b]) / m - sum(sum(k[v] for v in got if got[v] == c) ** 2 for c in set(got.values())) / (2 * m) ** 2
    assert history[-1] == pytest.approx(q) and 4 <= len(set(got.values())) <= 6
    planted = sum(w for a, b, w in edges if a % 4 == b % 4) / m - sum(sum(k[v] for v in got if v % 4 == c) ** 2 for c in range(4)) / (2 * m) ** 2
    assert q >= 0.95 * planted and all(c == min(v for v in got if got[v] == c) for c in set(got.values()))
