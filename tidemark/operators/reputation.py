"""Reputation of actors as of a cross, from outcomes of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rates(seen, won):
    return (won + 1) / (seen + 2)


#: Seconds of a bin of an actor's history: sums run inside bins, and their totals are carried over, so that an actor with
#: very many crosses is dealt over its bins.
BIN = 30 * 86400.0


def _credited(rows: DataFrame, at: str, inside) -> DataFrame:
    """``rows`` (actor, ``at``, y: null where nothing is told) with seen and won: what was told before, by bins."""
    rows = rows.withColumn("bin", F.floor(F.col(at) / BIN)).repartition("actor", "bin")  # one exchange for windows and totals
    w = inside(Window.partitionBy("actor", "bin"))
    totals = rows.groupBy("actor", "bin").agg(F.count("y").alias("c"), F.coalesce(F.sum("y"), F.lit(0)).alias("s"))
    earlier = Window.partitionBy("actor").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("actor", "bin", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    here = rows.withColumns({"c1": F.count("y").over(w), "s1": F.coalesce(F.sum("y").over(w), F.lit(0))})
    return here.join(carry, ["actor", "bin"]).withColumns({"seen": F.col("c0") + F.col("c1"), "won": F.col("s0") + F.col("s1")}).drop("bin", "c0", "c1", "s0", "s1")


def by_cross_order(members: DataFrame, smart: int = 3, good: float = 0.6) -> DataFrame:
    """Per cross: mean and largest Laplace rate of its actors over crosses before it in (cross_ts, key) order.

    ``members``: key, actor, cross_ts, y. Outcomes are credited right after their cross, which may be before they are
    known; :func:`by_resolution` is the version without that look-ahead.
    """
    rows = _credited(members, "cross_ts", lambda w: w.orderBy("cross_ts", "key").rowsBetween(Window.unboundedPreceding, -1))
    return _summary(rows.withColumn("rate", _rates(F.col("seen"), F.col("won"))), smart, good)


def by_resolution(members: DataFrame, smart: int = 3, good: float = 0.6) -> DataFrame:
    """The same with outcomes credited at ``resolved_ts``: only those strictly before the cross count.

    Crosses and resolutions of an actor form one stream; at equal times crosses come first.
    """
    ask = members.select("actor", "key", F.col("cross_ts").alias("at"), F.lit(0).alias("order"), F.lit(None).cast("int").alias("y"))
    tell = members.select("actor", "key", F.col("resolved_ts").alias("at"), F.lit(1).alias("order"), F.col("y").cast("int").alias("y"))
    rows = _credited(ask.union(tell), "at", lambda w: w.orderBy("at", "order").rangeBetween(Window.unboundedPreceding, Window.currentRow)).filter("order = 0")
    return _summary(rows.withColumn("rate", _rates(F.col("seen"), F.col("won"))), smart, good)


def _summary(rows: DataFrame, smart: int, good: float) -> DataFrame:
    rows = rows.select("key", "seen", "rate").repartition("key")  # a key's actors lie apart: sums made before would be as many as the rows
    return rows.groupBy("key").agg(F.avg("rate").alias("rep_mean"), F.max("rate").alias("rep_max"), F.avg((F.col("seen") > 0).cast("double")).alias("known"), F.sum(((F.col("seen") >= smart) & (F.col("rate") >= good)).cast("int")).alias("n_smart"))
