"""Joins on time: trailing intervals, as-of, strictly prior ranges, first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_interval(left: DataFrame, right: DataFrame, seconds: float, aggregates: list[Column], keep: list[str]) -> DataFrame:
    """For each row of ``left`` (key, ts and ``keep``), aggregates of ``right``'s rows of its key in [ts - seconds, ts].

    Time is cut into bins of ``seconds``: a row meets the bins its interval touches, at most two, by an equi-join.
    So a key with very many rows is spread over its bins, and the result does not depend on where bins begin.
    """
    bin_of = lambda c: F.floor(c / seconds).cast("long")
    probe = left.select("key", "ts", *keep).withColumn("bin", F.explode(F.sequence(bin_of(F.col("ts") - seconds), bin_of(F.col("ts")))))
    build = right.withColumnRenamed("ts", "ts_right").withColumn("bin", bin_of(F.col("ts_right")))
    met = probe.join(build, ["key", "bin"]).filter(F.col("ts_right").between(F.col("ts") - seconds, F.col("ts")))
    found = met.groupBy("key", "ts", *keep).agg(*aggregates)
    return left.select("key", "ts", *keep).join(found, ["key", "ts", *keep], "left")


def as_of(left: DataFrame, right: DataFrame, values: list[str], order: str = "seq") -> DataFrame:
    """Each row of ``left`` (key, ts, ``order``) with ``values`` of ``right``'s last row of its key at or before ts.

    Both sides form one stream in which a row of ``right`` precedes rows of ``left`` at the same time; the last value
    seen so far is the answer. One shuffle on the key, no range join.
    """
    a = left.select("*", F.lit(1).alias("side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"r_{v}") for v in values))
    b = right.select(*(F.col(c) if c in ("key", "ts", order) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("side"), *(F.col(v).alias(f"r_{v}") for v in values))
    w = Window.partitionBy("key").orderBy("ts", "side", order).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumns({v: F.last(f"r_{v}", ignorenulls=True).over(w) for v in values})
    return seen.filter("side = 1").drop("side", *(f"r_{v}" for v in values))


def prior_range(rows: DataFrame, slots: int) -> DataFrame:
    """slot, rows, and mean rows of the strictly prior ``slots`` slots (empty slots count nothing), over all keys.

    Counts per slot are summed first; a count then goes to the ``slots`` slots after it, so no window orders the whole
    tape in one task.
    """
    per = rows.groupBy("slot").agg(F.count("*").alias("c"))
    later = per.withColumn("slot", F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + slots))).groupBy("slot").agg(F.sum("c").alias("prior"), F.max("c").alias("prior_max"))
    return per.join(later, "slot", "left").select("slot", "c", (F.coalesce("prior", F.lit(0)) / F.lit(float(slots))).alias("prior_mean"), F.coalesce("prior_max", F.lit(0)).alias("prior_max"))


def first_sightings(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Earliest time of each ``on`` in both sources, and how much later the second saw it."""
    one, two = (x.groupBy(on).agg(F.min("ts").alias(f"ts_{n}")) for x, n in ((a, "a"), (b, "b")))
    return one.join(two, on).withColumn("lead", F.col("ts_b") - F.col("ts_a"))
