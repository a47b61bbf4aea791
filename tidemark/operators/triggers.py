"""Triggers: the row of a key at which a decision falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tape import VIRTUAL, by_key

UP_TO = (Window.unboundedPreceding, 0)


def with_triggers(tape: DataFrame, k: int = 3, v: float = 150.0) -> DataFrame:
    """The tape with cum_buy, k_idx (the k-th row) and v_idx (first row from the third on with cum_buy >= v)."""
    cum = F.sum(F.when(F.col("is_buy"), F.col("sol")).otherwise(0.0)).over(by_key().rowsBetween(*UP_TO))
    rows = tape.withColumn("cum_buy", cum)
    whole = Window.partitionBy("key")
    return rows.withColumns(
        {
            "k_idx": F.max(F.when(F.col("n") == k, F.col("n"))).over(whole),
            "v_idx": F.min(F.when((F.col("n") >= 3) & (F.col("cum_buy") >= v), F.col("n"))).over(whole),
        }
    )


def decisions(tape: DataFrame, k: int = 3, v: float = 150.0) -> DataFrame:
    """key, k_idx, v_idx and their later one, of keys at which both fire."""
    rows = with_triggers(tape, k, v).filter("n = 1 and k_idx is not null and v_idx is not null")
    return rows.select("key", "k_idx", "v_idx", F.greatest("k_idx", "v_idx").alias("decision"))


def fresh(tape: DataFrame, below: float = 3e9, tolerance: float = 5e7) -> DataFrame:
    """Rows on the classic curve, of keys whose first such row has real reserves under ``below``."""
    classic = tape.filter(F.abs(F.col("vsol") - VIRTUAL - F.col("rsol")) < tolerance)
    first = F.first("rsol").over(by_key().rowsBetween(*UP_TO))
    return classic.withColumn("first_rsol", first).filter(F.col("first_rsol") < below)


def cooldown(tape: DataFrame, ratio: float = 1.5, rest: int = 30) -> DataFrame:
    """Greedy re-triggers: a row at ``ratio`` times the key's first price fires, unless one fired within ``rest`` rows.

    What fires depends on what fired before, so a window cannot say it: a fold over the key's ordered hits does.
    """
    first = F.first("mid").over(by_key().rowsBetween(*UP_TO))
    hits = tape.withColumn("base", first).filter(F.col("mid") >= ratio * F.col("base"))
    lists = hits.groupBy("key").agg(F.array_sort(F.collect_list("n")).alias("hits"))
    start = F.array().cast("array<int>")

    def step(fired, n):
        return F.when((F.size(fired) == 0) | (n - F.element_at(fired, -1) > rest), F.concat(fired, F.array(n))).otherwise(fired)

    return lists.select("key", F.explode(F.aggregate("hits", start, step)).alias("n"))
