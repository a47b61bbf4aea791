"""A live harness: gate, triggers, score, fire, hold for the fill, exit - one stateful operator over a stream of the tape.

The state of a key is a dozen numbers. :func:`outcomes` is the same in batch, as first touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import triggers
from ..sources.tape import by_key

EVENTS = "key long, kind string, n int, ts double, score double, mid double, ret double, reason string"
STATE = "n int, cum_buy double, v_idx int, first double, phase int, score double, fill double, fill_ts double, asked double"
COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]
WATCH, AWAIT, OPEN, DONE = range(4)
NEVER = 1e17  # seconds: a wait from here on has no end


@dataclass(frozen=True)
class Plan:
    k: int = 3
    v: float = 150.0
    fire: float = 0.0  # least score; the score is the return since the key's first row
    take: float = 0.5
    cap: float = 604800.0  # seconds from fill to exit
    wait: float = 1e18  # seconds that a fill is awaited: later, the entry is given up


PLAN = Plan()


def outcomes(tape: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """key, decision, score, fired, fill_mid, exit_ret, reason (take, cap, or null) and censored: filled, but still open when
    the tape ends."""
    w = by_key()
    rows = triggers.with_triggers(tape, plan.k, plan.v).filter("k_idx is not null and v_idx is not null").withColumn("decision", F.greatest("k_idx", "v_idx"))
    rows = rows.withColumns({"first": F.first("mid").over(w.rowsBetween(Window.unboundedPreceding, 0)), "at": F.col("n") == F.col("decision")})
    whole = Window.partitionBy("key")
    rows = rows.withColumn("score", F.max(F.when(F.col("at"), F.col("mid") / F.col("first") - 1)).over(whole))
    fill = {c: F.max(F.when(F.col("n") == F.col("decision") + 1, F.col(c))).over(whole) for c in ("mid", "ts")}
    rows = rows.withColumns({"fired": F.col("score") >= plan.fire, "fill_mid": fill["mid"], "fill_ts": fill["ts"], "asked": F.max(F.when(F.col("at"), F.col("ts"))).over(whole)})
    held = F.col("fired") & (F.col("fill_ts") - F.col("asked") <= plan.wait)
    rows = rows.withColumn("fill_mid", F.when(held, F.col("fill_mid")))
    ret = F.col("mid") / F.col("fill_mid") - 1
    out = F.when(F.col("n") > F.col("decision") + 1, F.when(ret >= plan.take, "take").when(F.col("fill_mid").isNotNull() & (F.col("ts") - F.col("fill_ts") >= plan.cap), "cap"))
    rows = rows.withColumns({"ret": ret, "reason": out})
    when = F.when(F.col("reason").isNotNull(), F.col("n"))
    per = rows.groupBy("key", "decision", "score", "fired", "fill_mid").agg(F.min_by("ret", when).alias("exit_ret"), F.min_by("reason", when).alias("reason"))
    return per.withColumn("censored", F.col("fill_mid").isNotNull() & F.col("reason").isNull())


def state_of(tape: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The state of each key at the end of a tape, as :func:`run` would hold it, with ``ts``, the time of the key's last row.
    Written as a table and streamed before what follows, it hands a batch over to a stream."""
    known = outcomes(tape, plan).select("key", F.struct("decision", "score", "fired", "fill_mid", "reason").alias("o"))
    w = by_key()
    rows = triggers.with_triggers(tape, plan.k, plan.v).withColumn("decision", F.when(F.col("k_idx").isNotNull() & F.col("v_idx").isNotNull(), F.greatest("k_idx", "v_idx")))
    when = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    ends = rows.groupBy("key").agg(
        F.max("n").cast("int").alias("n"), F.max_by("cum_buy", "n").alias("cum_buy"), F.coalesce(F.first("v_idx"), F.lit(-1)).cast("int").alias("v_idx"), F.min_by("mid", "n").alias("first"),
        when("ts", F.col("decision")).alias("asked"), when("ts", F.col("decision") + 1).alias("next"), F.max("ts").alias("ts"),
    )
    both = ends.join(known, "key", "left")
    o, filled = F.col("o"), F.col("o.fill_mid").isNotNull()
    phase = F.when(o.isNull(), WATCH).when(~o["fired"], DONE).when(F.col("next").isNull(), AWAIT).when(~filled, DONE).when(o["reason"].isNull(), OPEN).otherwise(DONE)
    nought = F.lit(0.0)
    return both.select(
        "key", "n", "cum_buy", "v_idx", "first", phase.alias("phase"), F.coalesce(o["score"], nought).alias("score"), F.coalesce(o["fill_mid"], nought).alias("fill"),
        F.when(filled, F.col("next")).otherwise(nought).alias("fill_ts"), F.when(o.isNull(), nought).otherwise(F.col("asked")).alias("asked"), "ts",
    )


START = (0, 0.0, -1, 0.0, WATCH, 0.0, 0.0, 0.0, 0.0)


def advance(state: tuple, rows: pd.DataFrame, plan: Plan) -> tuple[tuple, list[tuple]]:
    """The state after the ordered rows of a key, and its events without the key. Each change of phase is the first place at
    which a condition on whole columns holds."""
    n0, cum, v_idx, first, phase, score, fill, fill_ts, asked = state
    ts, mid, m = rows["ts"].to_numpy(float), rows["mid"].to_numpy(float), len(rows)
    n = np.arange(n0 + 1, n0 + m + 1)
    bought = np.cumsum(np.append(cum, np.where(rows["is_buy"].to_numpy(bool), rows["sol"].to_numpy(float), 0.0)))[1:]
    first = first or float(mid[0])
    out: list[tuple] = []

    def place(holds: np.ndarray, start: int) -> int:
        return start + int(holds[start:].argmax()) if holds[start:].any() else m

    if v_idx < 0 and (i := place((n >= 3) & (bought >= plan.v), 0)) < m:
        v_idx = int(n[i])
    i = 0
    if phase == WATCH and v_idx > 0:
        i = place(n >= max(plan.k, v_idx), 0)
        if i < m:
            score, asked = float(mid[i] / first - 1), float(ts[i])
            phase = AWAIT if score >= plan.fire else DONE
            out.append(("decision", int(n[i]), asked, score, float(mid[i]), 0.0, "fire" if phase == AWAIT else "pass"))
            i += 1
    if phase == AWAIT and i < m:
        phase = OPEN if ts[i] - asked <= plan.wait else DONE
        if phase == OPEN:
            fill, fill_ts = float(mid[i]), float(ts[i])
        out.append(("fill" if phase == OPEN else "give_up", int(n[i]), float(ts[i]), score, float(mid[i]), 0.0, None))
        i += 1
    if phase == OPEN and i < m:
        ret = mid / fill - 1
        i = place((ret >= plan.take) | (ts - fill_ts >= plan.cap), i)
        if i < m:
            phase = DONE
            out.append(("exit", int(n[i]), float(ts[i]), score, float(mid[i]), float(ret[i]), "take" if ret[i] >= plan.take else "cap"))
    return (n0 + m, float(bought[-1]), v_idx, first, phase, score, fill, fill_ts, asked), out


def run(tape: DataFrame, plan: Plan = PLAN, horizon: float | None = None, late: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The events (decision, fill, give_up, exit) of a stream of the tape. Rows of a key arrive in order across batches, and
    are put in order of ts and seq within one.

    With ``late`` (how long rows may come late, "1 hour" with ``horizon``) keys have timers of event time: an entry that is
    not filled after ``plan.wait`` seconds is given up once the watermark has passed, also if the key has no row any more.
    With ``horizon``, a key that is silent for so many seconds is forgotten, whatever its phase; without, finished keys keep
    their few numbers. ``initial``, a stream of :func:`state_of`'s table, is read whole with the first batch: the states of
    these keys begin there, timers included."""
    late = late or ("1 hour" if horizon is not None else None)
    fields, handed = [f.split()[0] for f in STATE.split(", ")], initial is not None

    def timer(state: GroupState, phase: int, asked: float, last: float) -> None:
        due = [last + horizon] if horizon is not None else []
        due += [asked + plan.wait] if phase == AWAIT and plan.wait < NEVER else []
        if due:
            # one ms later: a row on the limit is no late one
            state.setTimeoutTimestamp(max(int(min(due) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            *_, phase, score, _, _, asked = held
            if phase == AWAIT and plan.wait < NEVER and state.getCurrentWatermarkMs() >= (asked + plan.wait) * 1000:
                state.update((*held[:4], DONE, *held[5:]))
                if horizon is not None:
                    timer(state, DONE, asked, asked + plan.wait)
                yield pd.DataFrame([(key[0], "give_up", held[0], asked + plan.wait, score, None, 0.0, None)], columns=COLUMNS)
            else:
                state.remove()
            return
        held, out = state.get if state.exists else START, []
        found = pd.concat(list(rows))
        last = float(found["ts"].max())
        if handed:
            carried = found[found["n"].notna()]
            if len(carried) and not state.exists:
                r = carried.iloc[0]
                held = tuple(int(r[c]) if isinstance(x, int) else float(r[c]) for c, x in zip(fields, START, strict=True))
            found = found[found["n"].isna()]
        if len(found):
            held, out = advance(held, found.sort_values(["ts", "seq"], kind="stable"), plan)
        state.update(held)
        if late is not None:
            timer(state, held[4], held[8], last)
        yield pd.DataFrame([(key[0], *e) for e in out], columns=COLUMNS)

    rows = tape.select("key", "seq", "ts", "mid", "sol", "is_buy")
    if initial is not None:
        rows = rows.unionByName(initial.select("key", "ts", *fields), allowMissingColumns=True)
    if late is None:
        return rows.groupBy("key").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
    timed = rows.withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
