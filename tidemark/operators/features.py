"""Features of a key's rows up to a decision: nothing after it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tape import by_key


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def steps(tape: DataFrame) -> DataFrame:
    """The tape with change (of mid), gap (seconds since the row before) and rel (return since the first row)."""
    w = by_key()
    first = F.first("mid").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tape.withColumns({"change": F.col("mid") - F.lag("mid").over(w), "gap": F.col("ts") - F.lag("ts").over(w), "rel": F.col("mid") / first - 1})


def entry(rows: DataFrame, idx: Column) -> DataFrame:
    """The 11 entry features over each key's rows with n <= ``idx``: sums per actor first, then per key, in one pass."""
    part = rows.filter(F.col("n") <= idx)
    side = F.when(F.col("is_buy"), F.col("sol")).otherwise(-F.col("sol"))
    ends = F.struct("n", "mid", "ts", "sol")
    per = part.groupBy("key", "actor").agg(
        F.sum("sol").alias("s"), F.count("*").alias("c"), F.min(ends).alias("first"), F.max(ends).alias("last"), F.sum("change").alias("change"), F.sum(F.abs("change")).alias("way"), F.sum(F.col("is_buy").cast("int")).alias("buys"), F.sum(side).alias("net"),
        F.max("rel").alias("high"), F.min("rel").alias("low"),
    )
    total = per.groupBy("key").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), ratio(F.abs(F.sum("change")), F.sum("way")).alias("dir_eff"), F.sum("c").alias("c"), (F.sum("buys") / F.sum("c")).alias("buy_frac"), F.count("*").alias("uniq"), F.sum("net").alias("net_sol"), F.sum("s").alias("tot_sol"),
        F.max("s").alias("top"), F.greatest(F.lit(0.0), F.max("high")).alias("drawup"), F.least(F.lit(0.0), F.min("low")).alias("drawdown"),
    )
    span = F.greatest(F.lit(1e-6), F.col("last.ts") - F.col("first.ts"))
    return total.select("key", (F.col("last.mid") / F.col("first.mid") - 1).alias("win_ret"), "dir_eff", "buy_frac", "uniq", "net_sol", "tot_sol", (F.col("top") / F.col("tot_sol")).alias("single_actor_share"), (F.col("c") / span).alias("trades_per_sec"), F.col("first.sol").alias("entry_sol"), "drawup", "drawdown")


def four(value: Column, name: str) -> list[Column]:
    """Mean, median, 90th percentile and maximum of a key's values, 0 without any."""
    zero = F.lit(0.0)
    return [F.coalesce(x, zero).alias(f"{name}_{n}") for n, x in (("mean", F.avg(value)), ("p50", F.percentile(value, 0.5)), ("p90", F.percentile(value, 0.9)), ("max", F.max(value)))]


def snapshot(rows: DataFrame, idx: Column) -> DataFrame:
    """The 11 entry features, and counts, ages, gaps and sizes (10 and 8) over each key's rows with n <= ``idx``."""
    part = rows.filter(F.col("n") <= idx)
    buy, sell, zero = F.when(F.col("is_buy"), F.col("sol")), F.when(~F.col("is_buy"), F.col("sol")), F.lit(0.0)
    more = part.groupBy("key").agg(
        F.count("*").alias("n_trades"), F.greatest(F.lit(1e-6), F.max_by("ts", "n") - F.min_by("ts", "n")).alias("age_sec"), F.coalesce(F.sum(buy), zero).alias("cum_buy"), F.coalesce(F.sum(sell), zero).alias("cum_sell"), F.max_by("sol", "n").alias("last_sol"), F.max_by("is_buy", "n").cast("int").alias("last_is_buy"),
        F.coalesce(F.avg("gap"), zero).alias("gap_mean"), F.coalesce(F.percentile("gap", 0.5), zero).alias("gap_p50"), F.coalesce(F.percentile("gap", 0.9), zero).alias("gap_p90"), F.coalesce(F.min("gap"), zero).alias("gap_min"), *four(buy, "buy"), *four(sell, "sell"),
    )
    return entry(rows, idx).join(more, "key")


def last_n(rows: DataFrame, n: int) -> DataFrame:
    """The 11 aggregates of each key's last ``n`` rows."""
    back = F.row_number().over(by_key(F.desc("n")))
    part = rows.withColumn("back", back).filter(F.col("back") <= n)
    ends, side = F.struct("n", "mid", "ts", "is_buy", "sol"), F.when(F.col("is_buy"), F.col("sol")).otherwise(-F.col("sol"))
    per = part.groupBy("key", "actor").agg(F.sum("sol").alias("s"), F.count("*").alias("c"), F.min(ends).alias("first"), F.max(ends).alias("last"), F.sum(F.col("is_buy").cast("int")).alias("buys"), F.sum(side).alias("net"), F.max("sol").alias("most"))
    total = per.groupBy("key").agg(F.sum("c").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), (F.sum("buys") / F.sum("c")).alias("buy_frac"), F.sum("net").alias("net_sol"), F.sum("s").alias("tot_sol"), F.count("*").alias("uniq"), (F.max("s") / F.sum("s")).alias("top_share"), F.max("most").alias("max_sol"))
    span = F.col("last.ts") - F.col("first.ts")
    return total.select("key", "rows", span.alias("span"), (F.col("last.mid") / F.col("first.mid") - 1).alias("ret"), "buy_frac", "net_sol", "tot_sol", "uniq", "top_share", (F.col("rows") / F.greatest(F.lit(1e-6), span)).alias("trades_per_sec"), "max_sol", F.col("last.is_buy").cast("int").alias("last_is_buy"))


def execution(rows: DataFrame, values: dict[str, Column], tip: Column, route: Column, failed: Column) -> DataFrame:
    """Mean, median, 90th percentile and maximum of each of ``values``; rate and sum of tips; rates of routed and failed."""
    parts = [x for name, value in values.items() for x in four(value, name)]
    return rows.groupBy("key").agg(*parts, F.avg((tip > 0).cast("double")).alias("tip_rate"), F.sum(tip).alias("tip_sum"), F.avg(route.cast("double")).alias("route_rate"), F.avg(failed.cast("double")).alias("failed_rate"))


def cross(rows: DataFrame, multiple: float = 2.0, recent: int = 20) -> DataFrame:
    """The 22 features of a key's rows up to its first at ``multiple`` times its first price; ``rows`` with the columns of
    :func:`steps`."""
    hit = rows.filter(F.col("rel") >= multiple - 1).groupBy("key").agg(F.min("n").alias("cross_n"))
    part = rows.join(hit, "key").filter("n <= cross_n")
    near = F.col("n") > F.col("cross_n") - (recent + 1)
    buy = F.col("is_buy")
    ends = F.struct("n", "mid", "ts", "rsol", "gap")
    per = part.groupBy("key", "actor", "cross_n").agg(
        F.count("*").alias("c"), F.sum(buy.cast("int")).alias("nb"), F.sum("sol").alias("vol"), F.sum(F.when(buy, F.col("sol")).otherwise(0.0)).alias("bought"), F.max(F.when(buy, F.col("sol"))).alias("most"), F.sum((F.col("change") > 0).cast("int")).alias("ups"), F.min("rel").alias("low"), F.max("rel").alias("high"),
        F.min(ends).alias("first"), F.max(ends).alias("last"), F.min(F.when(near, ends)).alias("near"), F.sum(near.cast("int")).alias("near_c"), F.min(F.when(F.col("n") >= F.col("cross_n") - 10, ends)).alias("ref"),
    )
    t = per.groupBy("key", "cross_n").agg(
        F.sum("c").alias("ntr"), F.sum("nb").alias("nb"), F.sum("vol").alias("vol_sol"), F.sum("bought").alias("bought"), F.coalesce(F.max("most"), F.lit(0.0)).alias("max_buy_sol"), F.sum("ups").alias("ups"), F.min("low").alias("dd"), F.max("high").alias("max_runup"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("near").alias("near"), F.sum("near_c").alias("near_c"), F.min("ref").alias("ref"), F.count(F.when(F.col("near_c") > 0, 1)).alias("uniq"), F.count(F.when(F.col("nb") > 0, 1)).alias("n_buyers"), F.count(F.when(F.col("c") > F.col("nb"), 1)).alias("n_sellers"), F.max("c").alias("top"),
    )
    t = t.withColumns({"age": F.greatest(F.col("last.ts") - F.col("first.ts"), F.lit(1e-3)), "span": F.greatest(F.col("last.ts") - F.col("near.ts"), F.lit(0.1)), "vol": F.greatest("vol_sol", F.lit(1e-9))})
    tps = F.when(F.col("near_c") >= 2, (F.col("near_c") - 1) / F.col("span")).otherwise(0.0)
    return t.select(
        "key", "dd", (F.col("nb") / F.col("ntr")).alias("buy_frac"), "ntr", (F.col("last.mid") / F.col("ref.mid") - 1).alias("recent"), tps.alias("tps"), "uniq", F.col("age").alias("t_to_2x"), F.log("age").alias("log_t_to_2x"), (tps / F.greatest(F.col("ntr") / F.col("age"), F.lit(1e-9))).alias("accel"),
        F.coalesce("last.gap", F.lit(0.0)).alias("last_gap"), (F.col("last.rsol") / 1e9).alias("mcap_sol"), "vol_sol", (F.col("vol_sol") / F.col("ntr")).alias("sol_per_trade"), "max_buy_sol", (F.col("max_buy_sol") / F.col("vol")).alias("whale_frac"), ((2 * F.col("bought") - F.col("vol_sol")) / F.col("vol")).alias("net_flow"),
        "n_buyers", "n_sellers", (F.col("n_buyers") / (F.col("n_sellers") + 1)).alias("bs_ratio"), (F.col("top") / F.col("ntr")).alias("signer_conc"), (F.col("ups") / F.col("ntr")).alias("up_frac"), "max_runup",
    )


def rolling_flow(rows: DataFrame, size: int = 15, order: tuple[str, ...] = ("n",)) -> DataFrame:
    """For every row, its key's flow in the last ``size`` rows: shares of buys and of the largest actor, actors, velocity.
    A window gathers them, and sums are taken inside of it: no row is copied to its frames. ``order`` are columns that order
    a key's rows as ``n`` does; with those that numbered them, the window needs no sort of its own."""
    last = by_key(*order).rowsBetween(1 - size, 0)
    side = F.when(F.col("is_buy"), F.col("sol")).otherwise(-F.col("sol"))
    each = rows.select("key", "n", "ts", F.collect_list(F.struct("actor", "sol")).over(last).alias("held"), F.sum(F.col("is_buy").cast("int")).over(last).alias("buys"), F.sum(side).over(last).alias("net"), F.min("ts").over(last).alias("t0"))
    each = each.withColumn("who", F.array_sort(F.array_distinct(F.transform("held", lambda x: x["actor"]))))
    of = lambda who: F.aggregate("held", F.lit(0.0), lambda total, x: total + F.when(x["actor"].eqNullSafe(who), x["sol"]).otherwise(0.0))
    each = each.withColumn("sums", F.transform("who", of))
    share = F.array_max("sums") / F.aggregate("sums", F.lit(0.0), lambda total, x: total + x)
    return each.select("key", "n", (F.col("buys") / F.size("held")).alias("buy_frac"), F.size("who").alias("actors"), share.alias("top_share"), ratio(F.col("net"), F.col("ts") - F.col("t0")).alias("velocity"))


def kinematics(rows: DataFrame) -> DataFrame:
    """Velocity and acceleration of mid; null where no time has passed."""
    w = by_key()
    v = F.try_divide(F.col("mid") - F.lag("mid").over(w), F.col("ts") - F.lag("ts").over(w))
    out = rows.withColumn("velocity", v)
    return out.select("key", "n", "velocity", F.try_divide(F.col("velocity") - F.lag("velocity").over(w), F.col("ts") - F.lag("ts").over(w)).alias("accel"), (F.col("mid") / F.lag("mid", 3).over(w) - 1).alias("ret3"))


def since_high(rows: DataFrame) -> DataFrame:
    """Rows and seconds since the key's running maximum was last set."""
    w = by_key()
    before = F.max("mid").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("high", (F.col("mid") > F.coalesce(before, F.lit(float("-inf")))).cast("int"))
    flagged = flagged.withColumn("island", F.sum("high").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("key", "island").orderBy("n")
    return flagged.select("key", "n", "island", (F.row_number().over(island) - 1).alias("rows_since"), (F.col("ts") - F.first("ts").over(island)).alias("secs_since"))
