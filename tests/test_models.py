"""What SQL does not say: fitted trees, optimal stopping, hand-computed policies."""

import math

import duckdb
import numpy as np
import pytest

from tidemark.operators import boosting, evaluation, gates, planning, policies
from tidemark.plans import catalog, learned, more, rest  # noqa: F401


def test_value_iteration_is_the_fixed_point(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    p, r = np.zeros((5, 5)), np.zeros((5, 5))
    for state, nxt, moves, reward in con.sql(catalog.ORACLE["mdp_tables"]).fetchall():
        p[state, nxt], r[state, nxt] = moves, reward
    p /= np.maximum(1, p.sum(1, keepdims=True))
    got = {x["state"]: x for x in catalog.QUERIES["value_iteration"](spark, sf).collect()}
    hold = np.array([got[i]["hold_value"] for i in range(5)])
    assert hold == pytest.approx((p * (r + 0.99 * np.maximum(0, hold))).sum(1), abs=1e-4)  # stopping brings nothing more
    assert [got[i]["hold"] for i in range(5)] == (hold > 0).tolist()


@pytest.mark.parametrize("discount", [0.0, 0.95])
def test_stopping_values_are_the_fixed_point(spark, discount):
    """Random moves, states that stay, that only end, that have no moves, and one that all others lead to."""
    rng = np.random.default_rng(5)
    n, end = 40, 40  # the last column is the end
    count = rng.integers(0, 4, (n, n + 1)) * (rng.random((n, n + 1)) < 0.1)
    count[:, 0] += 50
    count[3] = count[4] = 0
    count[3, 3], count[5, :n] = 900, 0
    reward, stop = rng.normal(size=(n, n + 1)).round(3), rng.normal(size=n).round(3)
    moves = [(i, j if j < end else None, int(count[i, j]), float(reward[i, j])) for i, j in zip(*np.nonzero(count), strict=True)]
    table = planning.solve(spark.createDataFrame(list(zip(range(n), stop.tolist(), strict=True)), "state int, stop double"), spark.createDataFrame([tuple(int(x) if isinstance(x, np.integer) else x for x in m) for m in moves], "state int, nxt int, n long, reward double"), discount, 1e-7)
    p = count / np.maximum(1, count.sum(1, keepdims=True))
    v = stop.copy()
    for _ in range(3000):
        hold = (p * reward).sum(1) + discount * p[:, :n] @ v
        v = np.maximum(stop, hold)
    got = {r["state"]: r for r in table.collect()}
    assert len(got) == n and [got[i]["hold"] for i in range(n)] == pytest.approx(hold.tolist(), abs=1e-6)
    assert all(got[i]["sell"] == (stop[i] >= hold[i]) for i in range(n) if abs(stop[i] - hold[i]) > 1e-6)


def test_stopping_by_a_table(spark):
    rows = spark.createDataFrame([(1, 0, 7, 0.1), (1, 1, 8, 0.3), (1, 2, 7, 0.2), (2, 0, 7, -0.1), (2, 1, 9, -0.2), (3, 0, 8, 0.5)], "key int, i int, state int, gain double")
    table = spark.createDataFrame([(7, False), (8, True)], "state int, sell boolean")
    assert sorted(map(tuple, planning.first_stop(rows, table, "i").collect())) == [(1, 1, 0.3, False), (2, 1, -0.2, True), (3, 0, 0.5, False)]
    states, moves = planning.tables(rows, "i")
    assert {tuple(r)[:1] + tuple(r)[2:] for r in states.collect()} == {(7, 3), (8, 2), (9, 1)}
    assert sorted((r["state"], r["nxt"] or 0, r["n"], r["reward"]) for r in moves.collect()) == [(7, 0, 1, 0.2), (7, 8, 1, 0.0), (7, 9, 1, 0.0), (8, 0, 1, 0.5), (8, 7, 1, 0.0), (9, 0, 1, -0.2)]
    assert planning.first_stop(rows.limit(0), table, "i").count() == 0 and planning.solve(states.limit(0), moves.limit(0), 0.9).count() == 0


def test_boosted_trees_hold_out(spark, sf):
    (row,) = catalog.QUERIES["gbt_holdout"](spark, sf).collect()
    assert 0 < row["positives"] < row["rows"] and 0 <= row["auc"] <= 1


def made(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = (x[:, 0] + (x[:, 1] > 0.3) + 0.3 * rng.normal(size=n) > 0.5).astype(float)
    x[rng.random(n) < 0.2, 0] = np.nan
    x[(y == 1) & (rng.random(n) < 0.4), 2] = np.nan  # missing says something here
    return x, y


def boosted(x, y, cuts, logistic, trees, depth, rate, l2, least):
    """Boosting row by row and cut by cut."""
    base = np.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    raw, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw)) if logistic else raw
        g, h = p - y, p * (1 - p) if logistic else np.ones(len(y))

        def grow(rows, d, g=g, h=h):
            best, total = (1e-12, None), g[rows].sum() ** 2 / (h[rows].sum() + l2)
            for f in range(x.shape[1]) if d < depth else ():
                v, missing = x[rows, f], np.isnan(x[rows, f])
                for c in cuts[f]:
                    for side in (True, False) if missing.any() else (None,):
                        left = (v <= c) | (missing & bool(side))
                        if min(left.sum(), (~left).sum()) < least:
                            continue
                        a, b = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - total
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, c, bool(left.sum() > (~left).sum()) if side is None else side, a, b))
            if best[1] is None:
                value = -rate * g[rows].sum() / (h[rows].sum() + l2)
                raw[rows] += value
                return value
            f, c, side, a, b = best[1]
            return f, c, side, grow(a, d + 1), grow(b, d + 1)

        out.append(grow(np.arange(len(y)), 0))
    return base, out


def walked(tree, row):
    while isinstance(tree, tuple):
        f, c, side, a, b = tree
        tree = a if (side if np.isnan(row[f]) else row[f] <= c) else b
    return tree


@pytest.mark.parametrize("logistic", [True, False])
def test_boosting_equals_brute_force(spark, logistic):
    x, y = made()
    y = y if logistic else y * 2 + np.nan_to_num(x[:, 0])
    cuts = [[-1.0, -0.35, 0.05, 0.55, 1.2]] * 3
    rows = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(t), "kept") for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double, score string").repartition(5)
    forest = boosting.fit(rows, ["a", "b", "c"], logistic=logistic, trees=11, depth=3, rate=0.3, l2=2.0, least=15, cuts=cuts)
    base, trees = boosted(x, y, cuts, logistic, 11, 3, 0.3, 2.0, 15)
    raw = np.array([base + sum(walked(t, r) for t in trees) for r in x])
    assert forest.base + forest.walk(x) == pytest.approx(raw, abs=1e-6)
    got = boosting.score(forest, rows.withColumnRenamed("score", "other"), "score").collect()
    assert len(got) == len(y) and all(r["other"] == "kept" for r in got)
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(1 / (1 + np.exp(-raw)) if logistic else raw), abs=1e-6)
    if logistic:
        assert np.mean((raw > 0) == (y == 1)) > 0.85


def test_boosting_without_classes_or_rows(spark):
    rows = spark.createDataFrame([(1.0, 1), (None, 1), (float("nan"), None)], "a double, y int")
    assert boosting.fit(rows, ["a"]).walk(np.array([[np.nan]])).tolist() == [0.0]
    assert boosting.fit(rows.limit(0), ["a"], logistic=False).base == 0.0


def ordered_fold(signals, rules):
    state, lost, out = gates.State(), 0.0, {}
    for k, (t, seq, close, gain, failed) in enumerate(sorted(signals)):
        verdict, lost, _ = gates.step(state, lost, t, close, gain, failed, k, rules)
        out[seq] = gates.VERDICTS[verdict]
    return out


def test_gates_by_ranges_equal_the_ordered_fold(spark):
    rng = np.random.default_rng(8)
    met = set()
    for rules in (gates.Rules(3, 4, 30.0, -2.0, 5, 8, 0.6, 50.0), gates.Rules(50, 100, 1.0, -4.0, 3, 500, 0.99, 20.0), gates.Rules(2, 2, 200.0, -99.0, 5, 4, 0.4, 500.0)):
        t = np.sort(rng.integers(0, 3000, 900)).astype(float)
        signals = [(float(x), int(k), float(x) + float(rng.integers(1, 90)), float(rng.normal(0.4 * np.sin(x / 150 + 2), 0.5)), bool(rng.random() < 0.5)) for k, x in enumerate(t)]
        rows = spark.createDataFrame(signals, "t double, seq long, close double, gain double, failed boolean").repartition(6)
        got = {r["seq"]: r["verdict"] for r in gates.decide(rows, rules).collect()}
        assert got == ordered_fold(signals, rules)
        met |= set(got.values())
    assert met == set(gates.VERDICTS)
    assert gates.decide(rows.limit(0), rules).count() == 0


def _path(spark, mids, dts):
    """Deep reserves: the position hardly moves the price, so returns are those of the middle price."""
    deep = 1e15
    path = [(i, deep * m, deep, float(t)) for i, (m, t) in enumerate(zip(mids, dts, strict=True))]
    schema = "key long, vc double, tc double, vk double, tk double, path array<struct<i:int,vs:double,vt:double,dt:double>>"
    return spark.createDataFrame([(1, deep * mids[-1], deep, deep * mids[0], deep, path)], schema)


COSTS = 0.025
ALMGREN = math.sinh(3 * 7 / 8) / math.sinh(3)


def _net(spark, policy, mids, dts):
    (r,) = policies.replay(_path(spark, mids, dts), policy).collect()
    return r["net"] + COSTS + 0.0015 * (1 + r["sells"]), r["sells"]


@pytest.mark.parametrize(
    "policy, mids, dts, gross, sells",
    [
        ("k_combined", [1, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6], [0, 1, 2, 6, 11, 16, 17], (1.1 + 1.3 + 1.4 + 1.5) / 8 + 0.5 * 1.6 - 1, 5),  # gaps of 5 s in profit
        ("k_combined", [1, 0.9, 0.8, 0.7], [0, 10, 20, 40], 0.7 - 1, 1),  # a loss is held to the end
        ("h_time_spaced", [1, 0.9, 0.8, 0.7], [0, 10, 24, 26], (0.9 + 0.7) / 8 + 0.75 * 0.7 - 1, 3),
        ("time_spaced", [1, 1, 2, 3], [0, 10, 40, 45], (2 * 2 + 0) / 8 + 0.75 * 3 - 1, 3),  # two slices are due at once
        ("b_frontload", [1, 1.1, 0.9, 1.2, 1.3], [0, 1, 2, 3, 4], (1.1 + 1.2 + 1.3) / 8 + 5 / 8 * 1.3 - 1, 4),
        ("c_hybrid_t30", [1, 1.1, 1.2, 1.3, 1.4, 2.0, 1.39, 9], [0, 5, 10, 15, 20, 25, 30, 35], (1.1 + 1.2 + 1.3 + 1.4) / 8 + 0.5 * 1.39 - 1, 5),
        ("f_hybrid_t50", [1, 1.1, 1.2, 1.3, 1.4, 2.0, 1.39, 9], [0, 5, 10, 15, 20, 25, 30, 35], (1.1 + 1.2 + 1.3 + 1.4) / 8 + 0.5 * 9 - 1, 5),
        ("almgren_chriss", [1, 1, 2, 3], [0, 10, 18, 80], (1 - ALMGREN) * 2 + ALMGREN * 3 - 1, 8),  # one slice after 8 of 60 s, the other seven at once
        ("level_tp_50", [1, 1.49, 1.5, 9], [0, 1, 2, 3], 0.5, 1),
        ("level_tp_100_t120", [1, 1.2, 1.3, 1.4], [0, 5, 124, 125], 0.4, 1),
        ("level_tp_100_s30_t120", [1, 1.2, 0.7, 3], [0, 5, 10, 15], -0.3, 1),
        ("soft_cut", [1, 0.8, 0.4, 0.4], [0, 1, 2, 3], 0.4 - 1, 3),  # a fifth of the rest at p = 0.4, twice, the rest at the end
    ],
)
def test_policies_by_hand(spark, policy, mids, dts, gross, sells):
    net, n = _net(spark, policy, mids, dts)
    assert net == pytest.approx(gross, rel=1e-5, abs=1e-5) and n == sells  # the position itself moves the price by a millionth


def test_paper_book_by_hand(spark):
    deep = 1e15
    schema = "key long, vc double, tc double, vk double, tk double, path array<struct<i:int,vs:double,vt:double,dt:double,p:double>>"
    case = lambda key, mids, ps: (key, deep * mids[-1], deep, deep, deep, [(i, deep * m, deep, float(i), float(p)) for i, (m, p) in enumerate(zip(mids, ps, strict=True))])
    rider = [1, 0.9] + [1.1 + 0.1 * k for k in range(12)]
    rows = [case(1, rider, [1.0] * 14), case(2, [1, 0.9, 0.8, 5], [1, 0.5, 0.05, 1]), case(3, [1, 0.9, 0.95], [1, 1, 1]), case(4, [1], [1])]
    got = {r["key"]: r for r in policies.paper_book(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k]["kind"] for k in (1, 2, 3, 4)] == ["rider", "cut", "hold", "hold"]
    at = sorted({round(k * 11 / 7) for k in range(8)})
    gross = [sum(rider[2 + i] for i in at) / len(at) - 1, -0.2, -0.05, 0.0]
    assert [got[k]["net"] + COSTS + 0.0015 * (1 + max(1, got[k]["slices"])) for k in (1, 2, 3, 4)] == pytest.approx(gross, abs=1e-5)


def test_quantiles_by_group(spark):
    """One group of most rows, ties, nulls as values and as a group."""
    rng = np.random.default_rng(6)
    rows = [("big" if rng.random() < 0.9 else None if rng.random() < 0.4 else "small", None if rng.random() < 0.1 else float(rng.integers(-20, 20) / 4)) for _ in range(3000)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in evaluation.spread_by(df, "g", "x", {"a": 0.0, "b": 0.25, "c": 0.9}, 0.1).collect()}
    assert set(got) == {"big", "small", None, "one"}
    for g, r in got.items():
        x = np.sort([v for k, v in rows if k == g and v is not None])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.quantile(x, [0.0, 0.25, 0.9]).tolist())
        assert r["tail"] == pytest.approx(x[: int(np.ceil(0.1 * len(x)))].mean())
    assert evaluation.spread_by(df.limit(0), "g", "x", {"a": 0.5}).count() == 0


def test_bins_go_where_values_go():
    """Walks by bins end at the leaves that walks by values end at, values at a cut and missing ones included."""
    rng = np.random.default_rng(5)
    cuts = [np.array([-1.0, 0.0, 0.5]), np.array([2.0])]
    nodes = [("a", 0.0, False, 1, 2), ("b", 2.0, True, 3, 4), ("a", 0.5, True, 5, 6), *((float(k),) for k in range(4))]
    forest = boosting.Forest.of(["a", "b"], [nodes, [("b", 2.0, False, 1, 2), (0.25,), (0.5,)]])
    x = np.stack([rng.choice([-2, -1, 0, 0.2, 0.5, 0.7, np.nan], 300), rng.choice([1, 2, 3, np.nan], 300)], axis=1)
    bins = np.stack([np.where(np.isnan(x[:, k]), len(c) + 1, np.searchsorted(c, x[:, k])) for k, c in enumerate(cuts)]).astype("<i2")
    assert boosting._Walk(forest, cuts)(bins).tolist() == forest.walk(x).tolist()
