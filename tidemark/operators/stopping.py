"""Stopping by regression: what going on is worth as a linear function of a snapshot's state, fitted from the last
snapshot backwards.

At each index the state's products are summed by Spark, batch by batch, and only a matrix of the size of the state
comes to the driver. A snapshot is read at its own index only: rows lie in the shared folder by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amm
from ..sources.kept import kept, kept_by
from . import policies

#: The state of a snapshot, in this order.
STATE = (
    "ret", "run_max_ret", "dd", "retracement_norm", "velocity_ret_1", "velocity_ret_3", "accel_ret", "time_since_run_max", "dts", "fill_k", "buy_frac_w", "nsell_w", "solo_sell_w", "vel_w", "entry_score",
)


def _flow(last: Column) -> list[Column]:
    """Shares of buys, sellers, the largest seller's share and net flow a second of a short list of rows."""
    sells = F.filter(last, lambda x: ~x["is_buy"])
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["sol"])
    by = F.transform(F.array_distinct(F.transform(sells, lambda x: x["actor"])), lambda a: total(F.filter(sells, lambda x: x["actor"].eqNullSafe(a))))
    span = F.greatest(F.lit(1e-6), F.element_at(last, -1)["ts"] - F.element_at(last, 1)["ts"])
    return [
        (1 - F.size(sells) / F.size(last)).alias("buy_frac_w"), F.size(by).cast("double").alias("nsell_w"), F.coalesce(F.try_divide(F.array_max(by), total(sells)), F.lit(0.0)).alias("solo_sell_w"),
        ((total(last) - 2 * total(sells)) / span).alias("vel_w"),
    ]


def states(rows: DataFrame, scores: DataFrame, every: int = 3, most: int = 80, window: int = 15) -> DataFrame:
    """key, i, the 15 columns of ``STATE`` and ``final``, for each snapshot after the one of the entry.

    ``rows``: the key's rows after its decision (:func:`labels.anchored`); ``scores``: key, entry_score. Returns are those
    against the entry, the key's first snapshot; ``i`` counts from 0 at the snapshot after it; ``final`` is the return at the key's last
    row. What is not known yet - velocities of the first snapshots, or without time between two - is null, as is the score of
    a key without one. Keys with no snapshot after the entry have no rows."""
    whole, w = Window.partitionBy("key"), Window.partitionBy("key").orderBy("fwd")
    last = F.collect_list(F.struct("ts", "actor", "sol", "is_buy")).over(w.rowsBetween(1 - window, 0))
    held = rows.withColumns({"last": last, "end": F.max_by("ret", "fwd").over(whole)})
    snaps = policies.snapshots(held, every, most).select("key", "i", "dt", "end", amm.fill_share(F.col("vsol")).alias("fill_k"), "ret", *_flow(F.col("last")))
    w = Window.partitionBy("key").orderBy("i")
    base = 1 + F.first("ret").over(w)
    r = snaps.withColumns({"dts": F.col("dt") - F.first("dt").over(w), "final": (1 + F.col("end")) / base - 1, "ret": (1 + F.col("ret")) / base - 1})
    r = r.withColumn("run_max_ret", F.greatest(F.lit(0.0), F.max("ret").over(w)))
    speed = lambda k: F.try_divide(F.col("ret") - F.lag("ret", k).over(w), F.col("dts") - F.lag("dts", k).over(w))
    r = r.withColumns({"velocity_ret_1": speed(1), "velocity_ret_3": speed(3), "island": F.sum((F.col("ret") >= F.col("run_max_ret") - 1e-9).cast("int")).over(w)})
    fall = F.col("run_max_ret") - F.col("ret")
    r = r.withColumns(
        {
            "accel_ret": F.col("velocity_ret_1") - F.lag("velocity_ret_1").over(w), "dd": (1 + F.col("ret")) / (1 + F.col("run_max_ret")) - 1, "retracement_norm": fall / F.greatest(1 + F.col("run_max_ret"), F.lit(1e-6)),
            "time_since_run_max": (F.row_number().over(Window.partitionBy("key", "island").orderBy("i")) - 1).cast("double"),
        }
    )
    return r.filter("i > 0").join(scores.select("key", "entry_score"), "key", "left").select("key", (F.col("i") - 1).alias("i"), *STATE, "final")


def terms(names: tuple[str, ...] = STATE) -> Column:
    """A constant and the state, nulls and what is not finite as 0."""
    return F.array(F.lit(1.0), *(F.coalesce(amm.finite(F.col(c)), F.lit(0.0)) for c in names))


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: np.ndarray | None = None
    for b in batches:
        if len(b):
            x = np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy()])
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})


def solve(products: np.ndarray, ridge: float) -> np.ndarray:
    """Least squares from the products of terms and target (the last row and column), columns scaled to one size first."""
    a, b = products[:-1, :-1], products[:-1, -1]
    n = a[0, 0]
    size = np.sqrt(np.diag(a) / n)
    size[size == 0] = 1.0
    return np.linalg.solve(a / n / np.outer(size, size) + ridge * np.eye(len(a)), b / n / size) / size


def backward(rows: DataFrame, names: tuple[str, ...] = STATE, ridge: float = 1e-3, least: int = 30) -> DataFrame:
    """i, n and weights (of :func:`terms`): for each index, what going on from there is expected to bring.

    ``rows``: key, i (from 0, a bounded number), ret, final and the columns ``names``; one row for a key and index. From the
    last index down, the gain of going on - the return where the key is stopped later by the weights found so far, or its
    ``final`` one - is regressed on the state; then keys whose return is above the fit stop there. An index with fewer than
    ``least`` rows has no weights (null), and nobody stops at it. Without rows, an empty table."""
    spark = rows.sparkSession
    parts = kept_by(rows.filter("ret is not null and final is not null").select("key", "i", "ret", "final", terms(names).alias("x")), "i")
    found: list[tuple[int, int, list[float] | None]] = []
    later: DataFrame | None = None
    width = len(names) + 2
    for i in sorted((r[0] for r in parts.select("i").distinct().collect()), reverse=True):
        here = parts.filter(F.col("i") == i)
        here = here.withColumn("y", F.col("final")) if later is None else here.join(later, "key", "left").withColumn("y", F.coalesce("gain", "final"))
        sums = here.select("x", "y").mapInPandas(_products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        products = np.zeros(width * width)
        for r in sums:
            products[r["cell"]] = r["v"]
        products = products.reshape(width, width)
        n = round(products[0, 0])
        weights = [float(b) for b in solve(products, ridge)] if n >= least else None
        found.append((int(i), n, weights))
        stops = F.lit(False) if weights is None else F.col("ret") > value(F.array(*map(F.lit, weights)), F.col("x"))
        later = kept(here.select("key", F.when(stops, F.col("ret")).otherwise(F.col("y")).alias("gain")))
    return spark.createDataFrame(sorted(found), "i int, n long, weights array<double>")


def value(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def going_on(rows: DataFrame, weights: DataFrame, names: tuple[str, ...] = STATE, margin: float = 0.0) -> DataFrame:
    """key, i and f: what going on is expected to bring, plus a margin; null where the index has no weights. The table of
    weights has a row an index, as few as a path has snapshots."""
    known = rows.select("key", "i", terms(names).alias("x")).join(F.broadcast(weights.select("i", "weights")), "i", "left")
    return known.select("key", "i", (value(F.col("weights"), F.col("x")) + margin).alias("f"))
