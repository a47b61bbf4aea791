"""Stopping by regression against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import policies, stopping

NAMES = ("a", "b")


def _rows(keys: int, seed: int):
    rng = np.random.default_rng(seed)
    out = []
    for key in range(keys):
        n = int(rng.integers(1, 6))
        ret = rng.normal(0, 0.5, n)
        for i in range(n):
            a = None if rng.random() < 0.1 else float(rng.normal())
            out.append((key, i, float(ret[i]), float(ret[-1] + 0.1), a, float(1e6 * rng.random())))
    return out


def _brute(rows, least: int, ridge: float):
    """The same induction over lists: weights by least squares with the ridge as added rows."""
    later, found = {}, {}
    for i in sorted({r[1] for r in rows}, reverse=True):
        here = [r for r in rows if r[1] == i]
        x = np.array([[1.0, r[4] or 0.0, r[5]] for r in here])
        y = np.array([later.get(r[0], r[3]) for r in here])
        w = None
        if len(here) >= least:
            size = np.sqrt((x**2).mean(axis=0))
            scaled = np.vstack([x / size, np.sqrt(ridge * len(here)) * np.eye(3)])
            w = np.linalg.lstsq(scaled, np.concatenate([y, np.zeros(3)]), rcond=None)[0] / size
        later = {r[0]: (r[2] if w is not None and r[2] > v @ w else t) for r, v, t in zip(here, x, y, strict=True)}
        found[i] = (len(here), w)
    return found


def _frame(spark, rows):
    return spark.createDataFrame(rows, "key long, i int, ret double, final double, a double, b double")


def test_backward_induction_equals_numpy(spark):
    rows = _rows(300, 5)
    want = _brute(rows, 100, 1e-3)
    got = {r["i"]: r for r in stopping.backward(_frame(spark, rows).repartition(7), NAMES, least=100).collect()}
    assert got.keys() == want.keys()
    assert any(w is None for _, w in want.values()) and sum(w is not None for _, w in want.values()) > 1
    for i, (n, w) in want.items():
        assert got[i]["n"] == n
        assert got[i]["weights"] is None if w is None else got[i]["weights"] == pytest.approx(list(w), rel=1e-6, abs=1e-12)


def test_backward_without_rows_and_with_nulls(spark):
    assert stopping.backward(_frame(spark, []), NAMES).count() == 0
    rows = [(k, 0, 0.1 * k, None if k == 3 else 0.2, None, None) for k in range(6)] + [(9, 0, None, 1.0, 1.0, 1.0)]
    (r,) = stopping.backward(_frame(spark, rows), NAMES, least=1).collect()
    assert r["n"] == 5 and r["weights"][0] == pytest.approx(0.2, rel=2e-3) and r["weights"][1:] == [0.0, 0.0]


def test_going_on_without_weights_is_unknown(spark):
    rows = _frame(spark, [(1, 0, 0.1, 0.2, 2.0, None), (1, 1, 0.1, 0.2, float("nan"), 3.0), (1, 2, 0.1, 0.2, 1.0, 1.0)])
    weights = spark.createDataFrame([(0, 9, [0.5, 1.0, 2.0]), (1, 9, None)], "i int, n long, weights array<double>")
    got = {r["i"]: r["f"] for r in stopping.going_on(rows, weights, NAMES, margin=0.25).collect()}
    assert got == {0: 2.75, 1: None, 2: None}


def test_states_do_not_look_ahead(spark, sf):
    """Cut after a snapshot, the tape gives the same states up to it; only ``final`` reads on."""
    from tidemark.plans import stopping as plans
    from tidemark.plans.catalog import _anchored

    rows = _anchored(spark, sf)
    none = spark.createDataFrame([], "key long, entry_score double")
    make = lambda part: stopping.states(part, none, plans.EVERY, plans.MOST).drop("final", "entry_score")
    cut = 1 + 4 * plans.EVERY
    whole = make(rows).filter(F.col("i") <= 3)
    assert whole.count() > 0 and make(rows.filter(F.col("fwd") <= cut)).exceptAll(whole).isEmpty()


def test_fitted_weights_stop_some_positions(spark, sf):
    from tidemark.plans import stopping as plans

    rows = plans._states(spark, sf)
    weights = stopping.backward(rows, least=10)
    f = stopping.going_on(rows, weights)
    hits = rows.join(f, ["key", "i"]).filter("ret > f")
    assert weights.filter("weights is not null").count() > 3 and not hits.isEmpty()
    assert "almgren_chriss" in policies.REGISTRY
