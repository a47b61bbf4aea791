"""Evaluation: splits, ranks, selections, distributions. Input: rows with score, y (0 or 1) and net.

Orders over all rows are global by nature. Ranks here come from counts per distinct score (:func:`ranked`), with a
prefix sum over buckets of scores, so that no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a global order is cut into at most: as many as there are shuffle partitions, which follow the data.
RANGES = 1000


def _in_ranges(rows: DataFrame, by: str, descending: bool) -> DataFrame:
    """``rows`` with ``part``: a number for each range of ``by`` between approximate quantiles, rising in the order asked
    for. The quantiles are a row of the same plan: nothing runs before the result is asked for."""
    n = max(2, min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    edges = rows.agg(F.array_distinct(F.percentile_approx(by, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(10 * n))).alias("edges"))
    part = F.size(F.filter(F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)), lambda e: e < F.col(by)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("part", -part if descending else part).drop("edges")  # one row of edges


def running(rows: DataFrame, by: str, values: list[str], descending: bool = False) -> DataFrame:
    """``rows`` (one per distinct ``by``) with inclusive running sums ``cum_<value>`` in the order of ``by``.

    Sums run inside ranges of ``by``, and the few range totals are carried over.
    """
    rows = _in_ranges(rows, by, descending)
    order = F.desc(by) if descending else F.asc(by)
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("part").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"carry_{v}") for v in values))
    out = rows.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values}).join(F.broadcast(carry), "part")  # RANGES rows at most
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"carry_{v}") for v in values}).drop("part", *(f"carry_{v}" for v in values))


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: the exact quantiles q0, q1, ... of ``value`` (nulls apart), with linear interpolation. Counts of distinct
    values and their running sums take the place of a sort in one task."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    cum = running(per, "v", ["m"]).crossJoin(F.broadcast(per.agg(F.sum("m").alias("n"))))  # one row of totals
    out = []
    for i, q in enumerate(shares):
        at = (F.col("n") - 1) * q
        held = lambda k: F.max(F.when((F.col("cum_m") - F.col("m") <= k) & (k < F.col("cum_m")), F.col("v")))
        low, high = held(F.floor(at)), held(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{i}"))
    return cum.agg(*out)


def spread_by(rows: DataFrame, group: str, value: str, shares: dict[str, float], tail: float | None = None, name: str = "tail") -> DataFrame:
    """For each ``group`` (null is a group too): the exact quantiles of ``value`` (nulls apart), linearly interpolated, under
    the names of ``shares``; with ``tail`` also the mean of its lowest share, rounded up to whole rows.

    Two levels: counts of distinct values, running sums of them inside (group, range of values), and the totals of the
    ranges before. So a group that holds most rows is dealt to as many tasks as there are ranges.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(F.struct(F.col(group).alias("group")).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("m"))
    per = _in_ranges(per, "v", False)
    inside = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.groupBy("g", "part").agg(F.sum("m").alias("c")).select("g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("g")).alias("n"))  # a row for each range
    cum = per.withColumn("cum", F.sum("m").over(inside)).join(carry, ["g", "part"]).withColumn("cum", F.col("cum") + F.col("before"))
    out = []
    for label, q in shares.items():
        at = (F.col("n") - 1) * q
        held = lambda k: F.max(F.when((F.col("cum") - F.col("m") <= k) & (k < F.col("cum")), F.col("v")))
        low, high = held(F.floor(at)), held(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(label))
    if tail is not None:
        k = F.ceil(F.col("n") * tail)
        taken = F.greatest(F.lit(0), F.least(F.col("m"), k - (F.col("cum") - F.col("m"))))
        out.append((F.sum(F.when(taken > 0, F.col("v") * taken)) / F.max(k)).alias(name))
    return cum.groupBy("g").agg(*out).select(F.col("g.group").alias(group), *shares, *([name] if tail is not None else []))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank."""
    per = rows.groupBy("score").agg(F.count("*").alias("m"), F.sum("y").alias("pos"))
    cum = running(per, "score", ["m"])
    mean_rank = F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2
    s = cum.agg(F.sum(mean_rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("m").alias("n"))
    return s.select((F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("rows"))


def youden(rows: DataFrame) -> DataFrame:
    """The score at which true-positive less false-positive rate is largest, and both rates."""
    per = rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cum = running(per, "score", ["pos", "neg"], descending=True)
    totals = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    rates = cum.crossJoin(F.broadcast(totals)).select("score", (F.col("cum_pos") / F.col("p")).alias("tpr"), (F.col("cum_neg") / F.col("q")).alias("fpr"))  # one row of totals
    best = F.max_by(F.struct("score", "tpr", "fpr"), F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("score").alias("s")))
    return rates.agg(best.alias("b")).select("b.score", "b.tpr", "b.fpr")


def ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the true empirical distributions, the sizes, and the asymptotic p-value
    2 exp(-2 d^2 n m / (n + m)), at most 1."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(value).alias("v"), F.lit(0), F.lit(1)))
    per = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cum = running(per, "v", ["a", "b"])
    totals = per.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    found = cum.crossJoin(F.broadcast(totals)).groupBy("na", "nb").agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("d"))
    return found.withColumn("p", F.least(F.lit(1.0), 2 * F.exp(-2 * F.pow("d", 2) * (F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))))))


def ordered(rows: DataFrame, by: str, *then: str, descending: bool = False) -> DataFrame:
    """``rows`` with rn, from 1 in the order of ``by`` and ``then``, and total: ranks inside ranges of ``by``, plus the
    rows of the ranges before."""
    rows = _in_ranges(rows, by, descending)
    inside = Window.partitionBy("part").orderBy(F.desc(by) if descending else F.asc(by), *then)
    sizes = rows.groupBy("part").agg(F.count("*").alias("c"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("total"))
    out = rows.withColumn("rn", F.row_number().over(inside)).join(F.broadcast(carry), "part")  # RANGES rows at most
    return out.withColumn("rn", F.col("rn") + F.col("before")).drop("part", "before")


def selection(rows: DataFrame, cut: Column, name: Column) -> DataFrame:
    """For each ``name``: of rows with ``cut``, how many, their rate, precision, mean, median, p25 and win rate of net,
    and the mean of the worst tenth."""
    picked = rows.withColumn("name", name).filter(cut)
    spread = spread_by(picked, "name", "net", {"net_p50": 0.5, "net_p25": 0.25}, 0.1, "es10")
    stats = picked.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("precision"), F.avg("net").alias("net_mean"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))
    return stats.join(spread, "name").select("name", "n", "precision", "net_mean", "net_p50", "net_p25", "win_rate", "es10")
