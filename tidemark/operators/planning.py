"""Optimal stopping over a table of states: moves are counted by Spark, values iterated by joins.

A state is any number that bins what is known of a position; only states that occur have rows, so the tables grow with
the states that are seen and not with the product of the bins, and the tape is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept

#: Sweeps between two checks of the residual; checks after which values are no longer extrapolated.
SWEEPS, EXTRAPOLATED = 8, 12


def tables(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """states (state, stop: the mean of ``gain``, rows) and moves (state, nxt, n, reward) of the rows key, ``order``, state
    and gain. The last row of a key moves to no state (nxt is null) and brings its gain: it must be stopped at."""
    nxt = F.lead("state").over(Window.partitionBy("key").orderBy(order))
    stepped = rows.withColumn("nxt", nxt)
    states = rows.groupBy("state").agg(F.avg("gain").alias("stop"), F.count("*").alias("rows"))
    moves = stepped.groupBy("state", "nxt").agg(F.count("*").alias("n"), F.avg(F.when(F.col("nxt").isNull(), F.col("gain")).otherwise(0.0)).alias("reward"))
    return states, moves


def solve(states: DataFrame, moves: DataFrame, discount: float, tolerance: float = 1e-8) -> DataFrame:
    """state, stop, hold and sell: the value of stopping, of going on one move and then doing what is best, and whether
    stopping is no worse. The values are within ``tolerance`` of the fixed point of
    v = max(stop, sum of p * (reward + discount * v of the next state)); states without moves are worth what stopping brings,
    or nothing, if that is more.

    A sweep is a join of moves and values on the next state and a sum by state; moves of a state to itself are solved for at
    once. ``SWEEPS`` sweeps make one plan, whose result is cut from its lineage; the rest of the geometric series of
    changes is added then, at the rate at which they shrink. That only picks where the next sweeps start: what ends
    the iteration is the change in a sweep, which bounds the distance to the fixed point."""
    if not 0 <= discount < 1:
        raise ValueError("the discount is from 0 to below 1")
    total = moves.groupBy("state").agg(F.sum("n").alias("total"))
    p = moves.join(total, "state").select("state", "nxt", (F.col("n") / F.col("total")).alias("p"), "reward")
    own = p.groupBy("state").agg(F.sum(F.col("p") * F.col("reward")).alias("now"), F.coalesce(F.sum(F.when(F.col("nxt") == F.col("state"), F.col("p"))), F.lit(0.0)).alias("stay"))
    nought = F.lit(0.0)
    base = states.join(own, "state", "left").select("state", "stop", F.coalesce("now", nought).alias("now"), F.coalesce("stay", nought).alias("stay"))
    # one row of each state leads to itself without weight: with it, a sweep reads the values once
    selves = base.select("state", F.col("state").alias("nxt"), nought.alias("p"), "stop", "now", "stay")
    arcs = kept(p.filter("nxt is not null and nxt <> state").select("state", "nxt", "p").unionByName(selves, allowMissingColumns=True))

    def met(v: DataFrame) -> DataFrame:
        mine = F.col("state") == F.col("nxt")
        of = arcs.join(v.withColumnRenamed("state", "nxt"), "nxt").groupBy("state")
        kept_columns = [F.max(c).alias(c) for c in ("stop", "now", "stay")]
        return of.agg((F.sum(F.col("p") * F.col("v")) * discount).alias("later"), F.max(F.when(mine, F.col("v"))).alias("v"), F.max(F.when(mine, F.col("was"))).alias("was"), *kept_columns)

    def sweep(v: DataFrame) -> DataFrame:
        best = F.greatest("stop", (F.col("now") + F.col("later")) / (1 - discount * F.col("stay")))
        return met(v).select("state", best.alias("v"), F.col("v").alias("was"), F.col("was").alias("before"))

    v = arcs.filter("stop is not null").select("state", F.col("stop").alias("v"), F.col("stop").alias("was"))
    checks = 0
    while True:
        for _ in range(SWEEPS):
            v = sweep(v.select("state", "v", "was"))
        v = kept(v)
        checks += 1
        last, prior = v.agg(F.max(F.abs(F.col("v") - F.col("was"))), F.max(F.abs(F.col("was") - F.col("before")))).first()
        if not last or last * discount / (1 - discount) <= tolerance:
            break
        rate = min(last / prior, discount) if prior and checks <= EXTRAPOLATED else 0.0
        v = v.select("state", (F.col("v") + (F.col("v") - F.col("was")) * (rate / (1 - rate))).alias("v"), "was")
    hold = F.col("now") + discount * F.col("stay") * F.col("v") + F.col("later")
    return met(v.select("state", "v", "was")).select("state", "stop", hold.alias("hold"), (F.col("stop") >= hold).alias("sell"))


def first_stop(rows: DataFrame, table: DataFrame, order: str) -> DataFrame:
    """key, at, gain and forced: where each key stops by the table, at its first row in a state that sells; its last row, if
    there is none. States that the table does not know hold."""
    known = rows.join(table.select("state", "sell"), "state", "left")
    when = F.when(F.col("sell"), F.col(order))
    per = known.groupBy("key").agg(F.min(when).alias("hit"), F.min_by("gain", when).alias("hit_gain"), F.max(order).alias("last"), F.max_by("gain", order).alias("last_gain"))
    return per.select("key", F.coalesce("hit", "last").alias("at"), F.coalesce("hit_gain", "last_gain").alias("gain"), F.col("hit").isNull().alias("forced"))
