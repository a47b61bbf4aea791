"""Labels and exits: what happens first after a decision, on later rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tape import by_key


def anchored(tape: DataFrame, at: int = 3) -> DataFrame:
    """Rows after the key's row ``at``, with fwd (1 from the next row on), ret and dt against that row."""
    whole = Window.partitionBy("key")
    anchor = {c: F.max(F.when(F.col("n") == at, F.col(c))).over(whole) for c in ("mid", "ts", "vsol", "vtok")}
    rows = tape.withColumns({f"{c}0": x for c, x in anchor.items()}).filter(F.col("n") > at)
    return rows.withColumns({"fwd": F.col("n") - at, "ret": F.col("mid") / F.col("mid0") - 1, "dt": F.col("ts") - F.col("ts0")})


def first(condition: Column, what: str = "fwd") -> Column:
    """First touch: the least ``what`` of a key's rows with ``condition``, as an aggregate."""
    return F.min(F.when(condition, F.col(what)))


def net(ret: Column, bps: float = 250.0) -> Column:
    return ret - F.lit(bps / 1e4)


def fixed_tp(rows: DataFrame, tp: float, horizon: int) -> DataFrame:
    """Exit at the first return >= ``tp`` within ``horizon`` rows, else at the last of them; the peak counts rows up to
    the exit only."""
    near = rows.filter(F.col("fwd") <= horizon)
    touch = near.groupBy("key").agg(first(F.col("ret") >= tp).alias("hit"), F.max("fwd").alias("last"))
    exits = touch.select("key", F.coalesce("hit", "last").alias("exit"), F.col("hit").isNotNull().alias("hit_tp"))
    return near.join(exits, "key").filter("fwd <= exit").groupBy("key", "exit", "hit_tp").agg(F.max_by("ret", "fwd").alias("exit_ret"), F.max("ret").alias("peak_ret"))


def barrier(rows: DataFrame, tp: float, stop: float) -> DataFrame:
    """First of take-profit and stop by time, under both rules for ties; neither: the last return, censored."""
    touch = rows.groupBy("key").agg(first(F.col("ret") >= tp, "dt").alias("t_tp"), first(F.col("ret") <= stop, "dt").alias("t_stop"), F.max_by("ret", "fwd").alias("last_ret"))
    tp_first = F.when(F.col("t_tp").isNotNull() & (F.col("t_stop").isNull() | (F.col("t_tp") <= F.col("t_stop"))), "tp").when(F.col("t_stop").isNotNull(), "stop").otherwise("censored")
    kinds = F.array(F.struct(F.coalesce("t_tp", F.lit(float("inf"))).alias("t"), F.lit("tp").alias("kind")), F.struct(F.coalesce("t_stop", F.lit(float("inf"))).alias("t"), F.lit("stop").alias("kind")))
    stop_first = F.when(F.col("t_tp").isNull() & F.col("t_stop").isNull(), "censored").otherwise(F.array_min(kinds)["kind"])
    return touch.select("key", "t_tp", "t_stop", tp_first.alias("tp_rule"), stop_first.alias("stop_rule"), "last_ret")


def trailing(rows: DataFrame, arm: float, trail: float, stop: float) -> DataFrame:
    """Hard stop until the return has once reached ``arm``, then an exit ``trail`` under the running peak."""
    peak = F.max("ret").over(by_key("fwd").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("peak", peak)
    out = F.when(F.col("peak") >= arm, (1 + F.col("ret")) <= (1 + F.col("peak")) * (1 - trail)).otherwise(F.col("ret") <= stop)
    touch = rows.groupBy("key").agg(first(out).alias("hit"), F.max("fwd").alias("last"))
    at = touch.select("key", F.coalesce("hit", "last").alias("fwd"), F.col("hit").isNull().alias("held"))
    return rows.join(at, ["key", "fwd"]).select("key", F.col("fwd").alias("exit"), "held", F.col("ret").alias("exit_ret"), "peak")


def time_stop(rows: DataFrame, seconds: float) -> DataFrame:
    """The last return within ``seconds`` of the anchor."""
    return rows.filter(F.col("dt") <= seconds).groupBy("key").agg(F.max("fwd").alias("exit"), F.max_by("ret", "fwd").alias("exit_ret"))


def level_tp(rows: DataFrame, levels: list[float], stop: float, seconds: float) -> DataFrame:
    """Take-profit, stop and time exits, tested in this order on each row, for every level at once."""
    each = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    phase = F.when(F.col("ret") >= F.col("level"), "tp").when(F.col("ret") <= stop, "stop").when(F.col("dt") >= seconds, "time")
    done = each.withColumn("phase", phase)
    touch = done.groupBy("key", "level").agg(F.min_by("phase", F.when(F.col("phase").isNotNull(), F.col("fwd"))).alias("phase"), first(F.col("phase").isNotNull()).alias("hit"), F.max("fwd").alias("last"))
    at = touch.select("key", "level", F.when(F.col("hit").isNotNull(), F.col("phase")).otherwise("held").alias("phase"), F.coalesce("hit", "last").alias("fwd"))
    return at.join(rows.select("key", "fwd", "ret"), ["key", "fwd"]).select("key", "level", "phase", F.col("fwd").alias("exit"), F.col("ret").alias("exit_ret"))


def future(rows: DataFrame) -> DataFrame:
    """Largest and smallest later return, the row itself excluded; after the last row, its own return."""
    w = by_key("fwd").rowsBetween(1, Window.unboundedFollowing)
    return rows.select("key", "fwd", F.coalesce(F.max("ret").over(w), F.col("ret")).alias("future_max"), F.coalesce(F.min("ret").over(w), F.col("ret")).alias("future_min"), F.max("ret").over(by_key("fwd").rowsBetween(0, Window.unboundedFollowing)).alias("best_from_here"))


def crosses(tape: DataFrame, multiples: list[float]) -> DataFrame:
    """For each multiple of the key's first price: the row that first reaches it, and the next row, which fills."""
    w = by_key()
    rows = tape.withColumns({"base": F.first("mid").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next_mid": F.lead("mid").over(w), "next_ts": F.lead("ts").over(w)})
    each = rows.withColumn("multiple", F.explode(F.array(*map(F.lit, multiples)))).filter(F.col("mid") >= F.col("multiple") * F.col("base"))
    return each.groupBy("key", "multiple").agg(F.min("n").alias("cross_n"), F.min_by("mid", "n").alias("cross_mid"), F.min_by("next_mid", "n").alias("fill_mid"), F.min_by("next_ts", "n").alias("fill_ts"))
