"""Registered queries of stopping by regression. Same rules as :mod:`.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, features, policies, stopping
from ..sources.tape import events_tape
from .catalog import ANCHOR, STEPS, TAPE, _anchored, query, rounded
from .exits import MOST, RULES, _replay_sql, with_values
from .learned import FOREST

#: Every fourth row is a snapshot.
EVERY = 4

_SCORE = f"es AS (SELECT key, 1/(1+exp(-({FOREST.sql()}))) AS entry_score FROM (SELECT * FROM steps WHERE n=3))"
#: The state in SQL, after the tables of the tape, its steps and forward rows.
_STATES = f"""{STEPS.format(src='tape')}, {_SCORE}, sl AS (SELECT key, (fwd-1)//{EVERY} AS i, fwd, ret, dt, vsol, arg_max(ret,fwd) OVER (PARTITION BY key) AS fin FROM fw),
sn AS (SELECT *, greatest(0.0,least(1.0,(vsol/1e9-30)/85)) AS fill_k FROM sl WHERE (fwd-1)%{EVERY}=0 AND i<{MOST}),
wl AS (SELECT s.key, s.i, f.* EXCLUDE (key) FROM sn s JOIN fw f ON f.key=s.key AND f.fwd BETWEEN s.fwd-14 AND s.fwd),
sa AS (SELECT key, i, actor, sum(sol) AS s FROM wl WHERE NOT is_buy GROUP BY 1,2,3), so AS (SELECT key, i, count(*)::DOUBLE AS nsell_w, max(s)/sum(s) AS solo FROM sa GROUP BY 1,2),
fl AS (SELECT key, i, avg(CASE WHEN is_buy THEN 1.0 ELSE 0.0 END) AS buy_frac_w, sum(CASE WHEN is_buy THEN sol ELSE -sol END)/greatest(1e-6,max(ts)-min(ts)) AS vel_w FROM wl GROUP BY 1,2),
s1 AS (SELECT key, i, fill_k, dt-first_value(dt) OVER w AS dts, (1+ret)/(1+first_value(ret) OVER w)-1 AS ret, (1+fin)/(1+first_value(ret) OVER w)-1 AS final FROM sn WINDOW w AS (PARTITION BY key ORDER BY i)),
s2 AS (SELECT *, greatest(0.0, max(ret) OVER w) AS run_max_ret, (ret-lag(ret) OVER w)/nullif(dts-lag(dts) OVER w,0) AS velocity_ret_1, (ret-lag(ret,3) OVER w)/nullif(dts-lag(dts,3) OVER w,0) AS velocity_ret_3 FROM s1 WINDOW w AS (PARTITION BY key ORDER BY i)),
s3 AS (SELECT *, velocity_ret_1-lag(velocity_ret_1) OVER w AS accel_ret, sum(CASE WHEN ret>=run_max_ret-1e-9 THEN 1 ELSE 0 END) OVER w AS island FROM s2 WINDOW w AS (PARTITION BY key ORDER BY i)),
s4 AS (SELECT *, (row_number() OVER (PARTITION BY key, island ORDER BY i)-1)::DOUBLE AS time_since_run_max, (1+ret)/(1+run_max_ret)-1 AS dd, (run_max_ret-ret)/greatest(1+run_max_ret,1e-6) AS retracement_norm FROM s3),
state AS (SELECT key, CAST(i-1 AS INTEGER) AS i, ret, run_max_ret, dd, retracement_norm, velocity_ret_1, velocity_ret_3, accel_ret, time_since_run_max, dts, fill_k, buy_frac_w, coalesce(nsell_w,0) AS nsell_w, coalesce(solo,0) AS solo_sell_w, vel_w, entry_score, final
 FROM s4 JOIN fl USING (key, i) LEFT JOIN so USING (key, i) LEFT JOIN es USING (key) WHERE i>0)"""
#: Units of the state in which rounded results keep their digits.
_FAST = {"velocity_ret_1": 86400.0, "velocity_ret_3": 86400.0, "accel_ret": 86400.0}


def _states(spark: SparkSession, sf: str) -> DataFrame:
    decided = features.steps(events_tape(spark, sf)).filter("n = 3").select("key", "n", "gap", "rel", "sol", "tip")
    scores = boosting.score(FOREST, decided).select("key", F.col("score").alias("entry_score"))
    return stopping.states(_anchored(spark, sf), scores, EVERY, MOST)


@query(
    "stopping_states",
    f"WITH {TAPE}, {ANCHOR}, {_STATES} SELECT key, i, " + ", ".join(f"round({c}*{_FAST.get(c, 1.0)},6)+0 AS {c}" for c in (*stopping.STATE, "final")) + " FROM state",
)
def stopping_states(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 columns of a position's state at every snapshot (velocities a day)."""
    s = _states(spark, sf)
    return rounded(s.withColumns({c: F.col(c) * k for c, k in _FAST.items()}))


#: Weights given from outside, for every index: the constant, then those of ``STATE``.
GIVEN = [0.05, 0.3, 0.1, 0.0, -0.2, 0.0, 0.0, 0.0, 0.01, 0.0, -0.05, 0.2, -0.01, 0.1, 0.0, 0.15]
MARGIN = 0.01


def _replayed(spark: SparkSession, sf: str, rows: DataFrame, weights: DataFrame) -> DataFrame:
    found = policies.paths(_anchored(spark, sf), EVERY, MOST)
    return rounded(policies.replay(with_values(found, stopping.going_on(rows, weights, margin=MARGIN)), "lsm_continuation", RULES))


_F = "+".join(f"{w!r}*coalesce({c},0)" for c, w in zip(stopping.STATE, GIVEN[1:], strict=True) if w)


@query(
    "policy_lsm_given",
    _replay_sql("CASE WHEN ret>f0 THEN 1 ELSE 0 END", before=f", {_STATES}, pool2 AS (SELECT p.*, st.f0 FROM pool p JOIN (SELECT key, i, {GIVEN[0]!r}+{_F}+{MARGIN!r} AS f0 FROM state) st ON st.key=p.key AND st.i=p.i)", pool="pool2", every=EVERY),
)
def policy_lsm_given(spark: SparkSession, sf: str) -> DataFrame:
    """Positions stopped where the return exceeds what going on is worth by given weights."""
    rows = _states(spark, sf)
    weights = rows.select("i").distinct().withColumn("n", F.lit(0)).withColumn("weights", F.array(*map(F.lit, GIVEN)))
    return _replayed(spark, sf, rows, weights)


@query("policy_lsm_backward")
def policy_lsm_backward(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every index fitted backwards on four fifths of the keys, all positions stopped by them."""
    rows = _states(spark, sf)
    return _replayed(spark, sf, rows, stopping.backward(rows.filter("key % 5 <> 4")))
