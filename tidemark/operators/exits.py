"""More exits and fill models over the rows after an anchor (see :mod:`.labels`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tape import by_key
from .labels import first


def at_or_last(rows: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """key and, for each name, the return at the first row with its condition, else the last return."""
    touch = rows.groupBy("key").agg(*(F.min_by("ret", F.when(c, F.col("fwd"))).alias(n) for n, c in hits.items()), F.max_by("ret", "fwd").alias("last"))
    return touch.select("key", *(F.coalesce(n, "last").alias(n) for n in hits))


def latency_fill(rows: DataFrame, lags: list[int]) -> DataFrame:
    """For each lag in rows: the price paid, against the decision's, and the last return from there."""
    each = rows.groupBy("key").agg(F.max_by("ret", "fwd").alias("last"), *(F.max(F.when(F.col("fwd") == lag + 1, F.col("ret"))).alias(f"slip_{lag}") for lag in lags))
    out = each.unpivot(["key", "last"], [f"slip_{lag}" for lag in lags], "lag", "slip").filter("slip is not null")
    return out.select("key", F.substring_index("lag", "_", -1).cast("int").alias("lag"), "slip", ((1 + F.col("last")) / (1 + F.col("slip")) - 1).alias("net"))


def landing(rows: DataFrame, tip: float) -> DataFrame:
    """The row at which an order lands: the first of a later slot that no row of that slot with a higher tip precedes
    in a leading run."""
    later = rows.filter(F.col("slot") > F.col("slot0")).withColumn("first_slot", F.min("slot").over(Window.partitionBy("key")))
    inside = later.filter(F.col("slot") == F.col("first_slot"))
    lead = F.min(F.when(F.col("tip") <= tip, F.col("fwd"))).over(Window.partitionBy("key"))
    rank = inside.withColumns({"lead": lead, "end": F.max("fwd").over(Window.partitionBy("key"))})
    return rank.groupBy("key", "first_slot").agg(F.coalesce(F.max("lead"), F.max("end") + 1).alias("lands_at"), F.sum((F.col("tip") > tip).cast("long")).alias("outbid_by"))


def hindsight(rows: DataFrame, caps: list[float]) -> DataFrame:
    """For each time cap: the best and the last return within it."""
    each = rows.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).filter(F.col("dt") <= F.col("cap"))
    return each.groupBy("key", "cap").agg(F.max("ret").alias("best"), F.max_by("ret", "fwd").alias("held"), F.min_by("fwd", F.struct(-F.col("ret"), F.col("fwd"))).alias("best_at"))


def core_and_runner(rows: DataFrame, core: float, trail: float, share: float) -> DataFrame:
    """``share`` leaves at ``core``; the rest at ``trail`` under the peak since then; what never leaves, at the end."""
    whole = Window.partitionBy("key")
    rows = rows.withColumn("hit", F.min(F.when(F.col("ret") >= core, F.col("fwd"))).over(whole))
    since = F.max(F.when(F.col("fwd") >= F.col("hit"), F.col("ret"))).over(by_key("fwd").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("peak", since)
    out = (F.col("fwd") > F.col("hit")) & (1 + F.col("ret") <= (1 + F.col("peak")) * (1 - trail))
    legs = rows.groupBy("key").agg(F.min_by("ret", F.when(F.col("fwd") == F.col("hit"), F.col("fwd"))).alias("core_ret"), F.min_by("ret", F.when(out, F.col("fwd"))).alias("runner_ret"), F.max_by("ret", "fwd").alias("last"))
    return legs.select("key", (F.coalesce("core_ret", "last") * share + F.coalesce("runner_ret", "last") * (1 - share)).alias("exit_ret"), F.col("core_ret").isNotNull().alias("core_sold"), F.col("runner_ret").isNotNull().alias("runner_sold"))


def recovery(rows: DataFrame, start: float, back: float) -> DataFrame:
    """Of keys that fall to ``start``: when, how far after it, and whether they come back to ``back``."""
    low = rows.groupBy("key").agg(first(F.col("ret") <= start).alias("fell")).filter("fell is not null")
    after = rows.join(low, "key").filter(F.col("fwd") > F.col("fell"))
    seen = after.groupBy("key").agg(F.min("ret").alias("lowest"), first(F.col("ret") >= back).alias("back_at"))
    return low.join(seen, "key", "left")
