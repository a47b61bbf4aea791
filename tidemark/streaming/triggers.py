"""Live twins of batch operators: the same results from a stream of the tape."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "key long, k_idx int, v_idx int, decision int"
STATE = "n int, cum_buy double, v_idx int, done boolean"


def decisions(tape: DataFrame, k: int = 3, v: float = 150.0, horizon: float | None = None) -> DataFrame:
    """Live :func:`..operators.triggers.decisions`: one row a key, when both triggers have fired.

    The state of a key is four numbers. Rows of a key must arrive in order across batches; within a batch they are
    put in order of ts and seq. With ``horizon``, a key that is silent for so many seconds of event time is forgotten.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, cum, v_idx, done = state.get if state.exists else (0, 0.0, -1, False)
        out, last = [], 0.0
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            n, last = n + 1, r.ts
            cum += r.sol if r.is_buy else 0.0
            if v_idx < 0 and n >= 3 and cum >= v:
                v_idx = n
            if not done and v_idx > 0 and n >= k:
                done = True
                out.append((key[0], k, v_idx, max(k, v_idx)))
        state.update((n, float(cum), v_idx, done))
        if horizon is not None:
            state.setTimeoutTimestamp(max(int((last + horizon) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "k_idx", "v_idx", "decision"])

    rows = tape.select("key", "seq", "ts", "is_buy", "sol")
    if horizon is None:
        return rows.groupBy("key").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)
    return with_time(rows, "1 hour").groupBy("key").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def crosses(tape: DataFrame, multiple: float, horizon: float) -> DataFrame:
    """Live cross and fill: the first row at ``multiple`` times the key's first price, then the next row, which fills.

    A key without a cross is forgotten ``horizon`` seconds of event time after its last row.
    """
    schema = "key long, cross_mid double, fill_mid double"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        base, cross, filled = state.get if state.exists else (0.0, 0.0, False)
        out, last = [], None
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            last = r
            if base == 0.0:
                base = r.mid
            elif cross and not filled:
                filled = True
                out.append((key[0], cross, r.mid))
            if not cross and r.mid >= multiple * base:
                cross = r.mid
        state.update((float(base), float(cross), filled))
        if last is not None:
            state.setTimeoutTimestamp(max(int((last.ts + horizon) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "cross_mid", "fill_mid"])

    timed = tape.withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", "1 hour")
    return timed.select("key", "seq", "ts", "mid", "at").groupBy("key").applyInPandasWithState(step, schema, "base double, cross double, filled boolean", "append", GroupStateTimeout.EventTimeTimeout)


def with_time(tape: DataFrame, late: str) -> DataFrame:
    return tape.withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", late)


def sessions(tape: DataFrame, gap: str = "86400 seconds", late: str = "1 hour") -> DataFrame:
    """Inactivity closes: sessions of each key, emitted once the watermark has passed their end."""
    s = with_time(tape, late).groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("rows"), F.sum("sol").alias("tot_sol"))
    return s.select("key", F.col("w.start").alias("opened"), F.col("w.end").alias("closes"), "rows", "tot_sol")


def volume(tape: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding volume."""
    w = F.window("at", size, slide or size)
    return with_time(tape, late).groupBy(w.alias("w")).agg(F.count("*").alias("rows"), F.sum("sol").alias("volume")).select(F.col("w.start").alias("start"), "rows", "volume")


def first_seen(rows: DataFrame, on: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each signature within the watermark."""
    return with_time(rows, late).dropDuplicatesWithinWatermark(on).drop("at")


def matched(pending: DataFrame, seen: DataFrame, within: int = 30, late: str = "1 minute") -> DataFrame:
    """Pending orders with the chain event of their signature up to ``within`` seconds later; null: expired."""
    a = with_time(pending, late).select("sig", F.col("at").alias("sent_at"), F.col("ts").alias("sent"))
    b = with_time(seen, late).select(F.col("sig").alias("sig_seen"), F.col("at").alias("seen_at"), F.col("ts").alias("seen"))
    near = F.expr(f"sig = sig_seen and seen_at >= sent_at and seen_at <= sent_at + interval {within} seconds")
    return a.join(b, near, "left_outer").select("sig", "sent", "seen")
